"""Forward-backward over ordered sites for founder mosaics of any ploidy, in double precision.

One routine serves all ploidies: a state space is described by its transition applied to a vector, and the recursions are
the same. Every step is normalised; a step whose mass vanishes starts again from the uniform distribution.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from itertools import combinations_with_replacement, product

import numpy as np


def haploid_step(x: np.ndarray, switch) -> np.ndarray:
    """One founder (last axis) stays with 1 - switch or moves to another one, all alike; switch fits the other axes."""
    off = switch / max(x.shape[-1] - 1, 1)
    return (1 - switch - off) * x + off * x.sum(-1, keepdims=True)


def diploid_step(x: np.ndarray, switch) -> np.ndarray:
    """Two founders (last two axes) move independently."""
    off = switch / max(x.shape[-1] - 1, 1)
    b = 1 - switch - off
    rows, columns = x.sum(-1, keepdims=True), x.sum(-2, keepdims=True)
    return b * b * x + b * off * (rows + columns) + off * off * rows.sum(-2, keepdims=True)


class Moves:
    """Moves of many samples at once between states laid out flat: `along` forward, `against` for functions of the next state.

    A site costs a few calls: weights of all sites are made beforehand. Haploids and diploids that move evenly keep a share, and get back what
    two thin matrices add up (by founder, by both) and spread again.
    """

    def __init__(self, k: int, ploidy: int, shape: np.ndarray | None = None):
        self.k, self.ploidy, one = k, ploidy, np.eye(k)
        self.even = ploidy == 1 or ploidy == 2 and shape is None
        if ploidy == 1:
            self.sums = np.ones((k, 1))
        elif self.even:
            self.sums = np.hstack([np.kron(one, np.ones((k, 1))), np.kron(np.ones((k, 1)), one), np.ones((k * k, 1))])
        elif ploidy == 2:
            self.first, self.second = np.kron(shape, one), np.kron(one, shape)
        else:
            self.parts = np.hstack(list(stay_counts(k, ploidy))), np.hstack([p.T for p in stay_counts(k, ploidy)])
        if self.even:
            self.spread = np.ascontiguousarray(self.sums.T)
            self.counts = np.ones((len(self.spread.T), 1))
        else:
            self.counts = np.ones((k * k if ploidy == 2 else len(multisets(k, ploidy)), 1))

    def weights(self, switch: np.ndarray) -> list:
        """What `along` asks for at each site, from switches by sites and samples."""
        off = (switch / max(self.k - 1, 1))[..., None]
        switch = switch[..., None]
        stay = 1 - switch - off
        if self.ploidy == 1:
            return list(zip(stay, off, strict=True))
        if self.even:
            return list(zip(stay * stay, np.concatenate([np.repeat(stay * off, 2 * self.k, 2), off * off], 2), strict=True))
        if self.ploidy == 2:
            return list(zip(1 - switch, switch, strict=True))
        return list(zip(*[(1 - switch) ** m * off ** (self.ploidy - m) for m in range(self.ploidy + 1)], strict=True))

    def along(self, x: np.ndarray, w: tuple, back: bool = False) -> np.ndarray:
        """Samples by states moved with the weights of one site."""
        if self.even:
            sums = np.dot(x, self.sums)
            sums *= w[1]
            out = np.dot(sums, self.spread)
            out += x * w[0]
            return out
        if self.ploidy == 2:
            first, second = (self.first.T, self.second.T) if back else (self.first, self.second)
            x = w[0] * x + w[1] * (x @ first)
            return w[0] * x + w[1] * (x @ second)
        moved = (x @ self.parts[back]).reshape(len(x), self.ploidy + 1, -1)
        out = w[0] * moved[:, 0]
        for m in range(1, self.ploidy + 1):
            out += w[m] * moved[:, m]
        return out

    def against(self, x: np.ndarray, w: tuple) -> np.ndarray:
        return self.along(x, w, True)


class Pairs(Moves):
    """Diploids that move evenly, by unordered pairs of founders: emissions and moves treat both orders alike, so one of them stands for both.

    `counts` tells how many ordered pairs a state stands for; a distribution's entries are those of one of them.
    """

    def __init__(self, k: int):
        self.k, self.ploidy, self.even = k, 2, True
        states = multisets(k, 2)
        self.counts = np.array([[float(orderings(s))] for s in states])
        self.holds = np.array([[float(f in s) for f in range(k)] for s in states])
        self.sums = np.hstack([self.holds, self.counts])
        self.spread = np.vstack([np.array([[float(s.count(f)) for s in states] for f in range(k)]), np.ones((1, len(states)))])

    def weights(self, switch: np.ndarray) -> list:
        off = (switch / max(self.k - 1, 1))[..., None]
        stay = 1 - switch[..., None] - off
        return list(zip(stay * stay, np.concatenate([np.repeat(stay * off, self.k, 2), off * off], 2), strict=True))


def moves_of(k: int, ploidy: int, shape: np.ndarray | None = None) -> Moves:
    """How samples move: by unordered pairs where that is the same."""
    return Pairs(k) if ploidy == 2 and shape is None else Moves(k, ploidy, shape)


def multisets(k: int, ploidy: int) -> list[tuple[int, ...]]:
    """The unordered founder combinations of a ploidy."""
    return list(combinations_with_replacement(range(k), ploidy))


def orderings(state: tuple[int, ...]) -> int:
    """How many ordered combinations a multiset stands for."""
    n = math.factorial(len(state))
    for c in Counter(state).values():
        n //= math.factorial(c)
    return n


@lru_cache(maxsize=16)
def stay_counts(k: int, ploidy: int) -> np.ndarray:
    """[m, s, t]: the orderings of multiset t in which m copies of multiset s stay what they are."""
    states = multisets(k, ploidy)
    number = {s: i for i, s in enumerate(states)}
    out = np.zeros((ploidy + 1, len(states), len(states)))
    for i, s in enumerate(states):
        for to in product(range(k), repeat=ploidy):
            out[sum(a == b for a, b in zip(s, to, strict=True)), i, number[tuple(sorted(to))]] += 1
    return out


def polyploid_matrix(k: int, ploidy: int, switch: float) -> np.ndarray:
    """Transition matrix between multisets (rows from): all copies move independently, orderings added up."""
    off = switch / max(k - 1, 1)
    m = np.arange(ploidy + 1)
    return np.tensordot((1 - switch) ** m * off ** (ploidy - m), stay_counts(k, ploidy), 1)


def _unit(x: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rows made to sum to 1, in place; those without any mass uniform."""
    z = np.dot(x, ones)
    if z.min() > 0:
        x /= z
        return x
    return np.where(z > 0, x / np.where(z > 0, z, 1), 1.0 / ones.sum())


def _forward(e: np.ndarray, w: list, moves: Moves, ahead: np.ndarray | None, out: np.ndarray | None = None) -> np.ndarray:
    """The forward distribution of the last site; `out` takes all. e: sites, samples, flat states; w: weights."""
    along, ones = moves.along, moves.counts
    now = _unit(e[0].copy() if ahead is None else along(ahead, w[0]) * e[0], ones)
    if out is not None:
        out[0] = now
    for t in range(1, len(e)):
        now = along(now, w[t])
        now *= e[t]
        now = _unit(now, ones)
        if out is not None:
            out[t] = now
    return now


def _backward(e: np.ndarray, w: list, moves: Moves, behind: np.ndarray | None, out: np.ndarray | None = None) -> np.ndarray:
    """What the backward recursion hands to the site before the first; `out` takes what each site is handed."""
    against, ones = moves.against, moves.counts
    now = np.full(e.shape[1:], 1.0 / ones.sum()) if behind is None else behind
    for t in range(len(e) - 1, -1, -1):
        if out is not None:
            out[t] = now
        now = _unit(against(now * e[t], w[t]), ones)
    return now


def _scans(emission: np.ndarray, switch: np.ndarray, moves: Moves, ahead=None, behind=None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages of samples on the second axis.

    ahead and behind are messages from the stretches before and after this one, as `boundary` gives them; without them a
    chromosome begins or ends here.
    """
    e, w, ahead, behind = _flat(emission, switch, moves, ahead, behind)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    _forward(e, w, moves, ahead, alpha)
    _backward(e, w, moves, behind, beta)
    return alpha.reshape(emission.shape), beta.reshape(emission.shape)


def _flat(emission, switch, moves, ahead, behind):
    n = emission.shape[1]
    return emission.reshape(len(emission), n, -1), moves.weights(switch), None if ahead is None else ahead.reshape(n, -1), None if behind is None else behind.reshape(n, -1)


def boundary(emission: np.ndarray, switch: np.ndarray, moves: Moves, ahead=None, behind=None) -> tuple[np.ndarray, np.ndarray]:
    """(message for the stretch after this one, message for the one before), given what these sent; samples on the second axis.

    The first is the forward distribution of the last site, the second what the backward recursion hands to the site before
    the first. Only the running message is held.
    """
    e, w, ahead, behind = _flat(emission, switch, moves, ahead, behind)
    return _forward(e, w, moves, ahead).reshape(emission.shape[1:]), _backward(e, w, moves, behind).reshape(emission.shape[1:])


def forward_backward(emission: np.ndarray, switch: np.ndarray, step, back=None) -> np.ndarray:
    """Posterior of each site's states of one sample. emission: sites by state shape; switch[t] leads from t - 1 to t.

    step(x, switch) moves a distribution forward; back(x, switch) applies the transition to a function of the next state (the same
    as step where the transition is symmetric). `state_posteriors` does the same for many samples.
    """
    def unit(x: np.ndarray) -> np.ndarray:
        z = x.sum()
        return x / z if z > 0 else np.full(x.shape, 1.0 / x.size)

    n, back = len(emission), back or step
    alpha, beta = np.empty_like(emission), unit(np.ones_like(emission[0]))
    for t in range(n):
        alpha[t] = unit(emission[0] if t == 0 else step(alpha[t - 1], switch[t]) * emission[t])
    for t in range(n - 1, -1, -1):
        alpha[t] *= beta
        beta = unit(back(beta * emission[t], switch[t]))
    axes = tuple(range(1, emission.ndim))
    return alpha / np.maximum(alpha.sum(axes, keepdims=True), 1e-300)


def state_posteriors(emission: np.ndarray, switch: np.ndarray, moves: Moves, ahead=None, behind=None) -> np.ndarray:
    """Posterior of each site's states, of samples on the second axis; ahead and behind: see `boundary`."""
    alpha, beta = _scans(emission, switch, moves, ahead, behind)
    gamma = alpha
    gamma *= beta
    flat = gamma.reshape(*gamma.shape[:2], -1)
    flat /= np.maximum(flat @ moves.counts, 1e-300)
    return gamma


def haploid_xi(emission: np.ndarray, switch: np.ndarray, ahead=None, behind=None) -> np.ndarray:
    """Posterior of neighbouring founder pairs, by samples by founders by founders. emission: sites, samples, founders.

    One entry for each site but the first, whose pair with the site before it comes too where `ahead` is given.
    """
    alpha, beta = _scans(emission, switch, Moves(emission.shape[-1], 1), ahead, behind)
    if ahead is not None:
        alpha = np.concatenate([ahead[None], alpha])
        following, sw = emission * beta, switch
    else:
        following, sw = emission[1:] * beta[1:], switch[1:]
    k = emission.shape[-1]
    sw = sw[:, :, None, None]
    move = np.where(np.eye(k, dtype=bool), 1 - sw, sw / max(k - 1, 1))
    xi = alpha[:-1, :, :, None] * move * following[:, :, None, :]
    return xi / np.maximum(xi.sum((2, 3), keepdims=True), 1e-300)


def site_emissions(alt: np.ndarray, ref: np.ndarray, other: np.ndarray, q: np.ndarray, error: float, floor: float = 1e-5, whole=None) -> np.ndarray:
    """Scaled emissions, sites by samples by states, of states with alternative frequency q (sites by states) given weighted counts (sites by samples).

    whole(log) may put what whole fragments say into the logarithms before they are scaled.
    """
    third = error / 3
    p_alt = np.log(np.clip(q * (1 - error) + (1 - q) * third, floor, 1))[:, None]
    p_ref = np.log(np.clip((1 - q) * (1 - error) + q * third, floor, 1))[:, None]
    shape = alt.shape + (1,) * (q.ndim - 1)
    log = alt.reshape(shape) * p_alt
    log += ref.reshape(shape) * p_ref
    log += other.reshape(shape) * np.log(max(third, floor))
    if whole is not None:
        whole(log)
    log -= log.max(tuple(range(2, log.ndim)), keepdims=True)
    return np.exp(log, out=log)


def with_fragments(log: np.ndarray, site: np.ndarray, sample: np.ndarray, p: np.ndarray, ploidy: int, mode: str, floor: float = 1e-5, most: float = 1e10) -> None:
    """Puts whole fragments into log emissions (sites by samples by states) at their centres.

    p: fragments by founders. A state's probability of a fragment is the mean of its founders' (of both, for a diploid); the
    logarithms of a cell's fragments are added up, and take the place of the cell's own (`replace`) or are added to it (`augment`). Cells
    touched are scaled to a largest value of 0 and held at -log(most).
    """
    if not len(site):
        return
    k = p.shape[1]
    if ploidy == 1:
        state = p
    elif ploidy == 2 and log.ndim == 4:
        state = (p[:, :, None] + p[:, None, :]) / 2
    else:
        state = p @ np.array([[s.count(f) / ploidy for s in multisets(k, ploidy)] for f in range(k)])
    cells, which = np.unique(site * log.shape[1] + sample, return_inverse=True)
    total = np.zeros((len(cells), *state.shape[1:]))
    np.add.at(total, which, np.log(np.clip(state, floor, 1)))
    at = np.divmod(cells, log.shape[1])
    if mode == "augment":
        total += log[at]
    total -= total.max(tuple(range(1, total.ndim)), keepdims=True)
    log[at] = np.maximum(total, -np.log(most))


def genotype_posterior(gamma: np.ndarray, q: np.ndarray, ploidy: int) -> np.ndarray:
    """Sites by samples by ploidy + 1 genotype probabilities from state posteriors (haploid, diploid square or by `Pairs`, or multisets)."""
    k = q.shape[1]
    if ploidy == 1:
        alt = (gamma * q[:, None]).sum(2)
        return np.stack([1 - alt, alt], 2)
    if gamma.ndim == 4:
        a, b = q[:, :, None], q[:, None, :]
        each = np.stack([(1 - a) * (1 - b), a * (1 - b) + (1 - a) * b, a * b], 3)
        return gamma.reshape(*gamma.shape[:2], -1) @ each.reshape(len(q), -1, 3)
    if ploidy == 2:
        i, j = np.array(multisets(k, 2)).T
        a, b, n = q[:, i], q[:, j], 1.0 + (i != j)
        return gamma @ (np.stack([(1 - a) * (1 - b), a * (1 - b) + (1 - a) * b, a * b], 2) * n[:, None])
    out = np.zeros(gamma.shape[:2] + (ploidy + 1,))
    for s, state in enumerate(multisets(k, ploidy)):
        dist = np.ones((len(q), 1))
        for f in state:  # one copy after the other
            dist = np.pad(dist, ((0, 0), (0, 1))) * (1 - q[:, f : f + 1]) + np.pad(dist, ((0, 0), (1, 0))) * q[:, f : f + 1]
        out += gamma[:, :, s : s + 1] * dist[:, None]
    return out


def state_shape(k: int, ploidy: int) -> tuple[int, ...]:
    """The shape of a distribution over the states of a ploidy."""
    return (k,) if ploidy == 1 else (k, k) if ploidy == 2 else (len(multisets(k, ploidy)),)


def state_emissions(alt: np.ndarray, ref: np.ndarray, other: np.ndarray, q: np.ndarray, ploidy: int, error: float, begins: bool = True, whole=None, pairs: bool = False) -> np.ndarray:
    """Scaled emissions of the states of a ploidy, of a diploid's `Pairs` if asked for. q: sites by K. Where a chromosome `begins`, a multiset counts as often as it has orderings."""
    if ploidy == 1:
        return site_emissions(alt, ref, other, q, error, whole=whole)
    if pairs:
        i, j = np.array(multisets(q.shape[1], 2)).T
        return site_emissions(alt, ref, other, (q[:, i] + q[:, j]) / 2, error, whole=whole)
    if ploidy == 2:
        return site_emissions(alt, ref, other, (q[:, :, None] + q[:, None, :]) / 2, error, whole=whole)
    states = multisets(q.shape[1], ploidy)
    emission = site_emissions(alt, ref, other, np.stack([q[:, list(s)].mean(1) for s in states], 1), error, whole=whole)
    if begins:
        emission[0] *= np.array([orderings(s) for s in states], float) / q.shape[1] ** ploidy
    return emission


def founder_shares(gamma: np.ndarray, k: int, ploidy: int) -> np.ndarray:
    """Sites by samples by K founder shares from state posteriors."""
    if ploidy == 1:
        return gamma
    if ploidy == 2 and gamma.ndim == 3:
        return gamma @ Pairs(k).holds
    if ploidy == 2:
        one = np.eye(k)
        return gamma.reshape(*gamma.shape[:2], -1) @ (0.5 * (np.kron(one, np.ones((k, 1))) + np.kron(np.ones((k, 1)), one)))
    return gamma @ np.array([[s.count(f) / ploidy for f in range(k)] for s in multisets(k, ploidy)])


def posteriors(
    alt: np.ndarray, ref: np.ndarray, other: np.ndarray, q: np.ndarray, switch: np.ndarray, ploidy: int, error: float,
    shape: np.ndarray | None = None, begins: bool = True, ahead=None, behind=None, whole=None,
) -> tuple[np.ndarray, np.ndarray]:
    """(founder shares sites by samples by K, genotype probabilities) of many samples on one stretch of sites.

    alt, ref, other and switch are sites by samples, q sites by K; begins: see `state_emissions`; ahead and behind: see `boundary`; whole: see `site_emissions`.
    """
    k = q.shape[1]
    moves = moves_of(k, ploidy, shape)
    emission = state_emissions(alt, ref, other, q, ploidy, error, begins, whole, isinstance(moves, Pairs))
    gamma = state_posteriors(emission, switch, moves, ahead, behind)
    return founder_shares(gamma, k, ploidy), genotype_posterior(gamma, q, ploidy)


def posterior(alt: np.ndarray, ref: np.ndarray, other: np.ndarray, q: np.ndarray, switch: np.ndarray, ploidy: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """The same of one sample: its counts and switches by site."""
    hap, gp = posteriors(alt[:, None], ref[:, None], other[:, None], q, switch[:, None], ploidy, error)
    return hap[:, 0], gp[:, 0]
