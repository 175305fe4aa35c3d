"""Forward-backward kernels against enumeration of all paths, and invariants."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociweave.functions import forwardbackward as fb


def enumerated(emission, switch, matrix):
    """Posterior by summing over all paths; the first state has no prior."""
    n, k = emission.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = emission[0, path[0]]
        for t in range(1, n):
            p *= matrix(switch[t])[path[t - 1], path[t]] * emission[t, path[t]]
        for t, s in enumerate(path):
            out[t, s] += p
    return out / out.sum(1, keepdims=True)


def haploid_matrix(k):
    return lambda sw: np.where(np.eye(k) == 1, 1 - sw, sw / max(k - 1, 1))


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 3), st.integers(1, 4), st.integers(0, 10**6))
def test_haploid_equals_enumeration(k, n, seed):
    rng = np.random.default_rng(seed)
    e, sw = rng.random((n, k)) + 0.01, rng.random(n) * 0.5
    got = fb.forward_backward(e, sw, fb.haploid_step)
    assert np.allclose(got, enumerated(e, sw, haploid_matrix(k)))


def test_diploid_equals_enumeration_over_pairs():
    rng = np.random.default_rng(3)
    k, n = 2, 3
    e, sw = rng.random((n, k, k)) + 0.01, np.array([0, 0.2, 0.4])
    got = fb.forward_backward(e, sw, fb.diploid_step)
    h = haploid_matrix(k)
    want = enumerated(e.reshape(n, k * k), sw, lambda s: np.kron(h(s), h(s)))
    assert np.allclose(got.reshape(n, -1), want)


def test_diploid_is_an_outer_product_where_emissions_factorise():
    rng = np.random.default_rng(4)
    a, sw = rng.random((5, 3)) + 0.01, rng.random(5) * 0.3
    single = fb.forward_backward(a, sw, fb.haploid_step)
    double = fb.forward_backward(a[:, :, None] * a[:, None, :], sw, fb.diploid_step)
    assert np.allclose(double, single[:, :, None] * single[:, None, :])


@pytest.mark.parametrize("ploidy", [2, 3])
def test_polyploid_transitions_are_stochastic_and_match_the_diploid(ploidy):
    m = fb.polyploid_matrix(3, ploidy, 0.3)
    assert np.allclose(m.sum(1), 1)
    if ploidy == 2:
        x = np.random.default_rng(5).random((3, 3))
        x = (x + x.T) / 2
        states = fb.multisets(3, 2)
        flat = np.array([x[a, b] * (1 if a == b else 2) for a, b in states])
        step = fb.diploid_step(x, 0.3)
        assert np.allclose(flat @ m, [step[a, b] * (1 if a == b else 2) for a, b in states])


@pytest.mark.parametrize("ploidy", [1, 2, 3, 4])
def test_posteriors_sum_to_one(ploidy):
    rng = np.random.default_rng(ploidy)
    n, k = 6, 3
    w = rng.integers(0, 4, (3, n)).astype(float)
    hap, gp = fb.posterior(w[0], w[1], w[2], rng.random((n, k)), np.r_[1e-10, rng.random(n - 1) * 0.2], ploidy, 0.001)
    assert np.allclose(hap.sum(1), 1) and np.allclose(gp.sum(1), 1) and gp.shape == (n, ploidy + 1)


def test_vanished_mass_restarts_uniform():
    e = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert np.isfinite(fb.forward_backward(e, np.array([0.0, 0.0]), fb.haploid_step)).all()


@pytest.mark.parametrize("mode", [None, "replace", "augment"])
def test_unordered_pairs_equal_ordered_ones(mode):
    """Both orders of a pair of founders were scanned, 49 states for 28 with seven founders: F12 q_multistart, F6, F1."""
    rng = np.random.default_rng(6)
    n, m, k = 9, 4, 3
    w, q, sw = rng.integers(0, 4, (3, n, m)).astype(float), rng.random((n, k)), rng.random((n, m)) * 0.4
    site, sample, p = rng.integers(0, n, 6), rng.integers(0, m, 6), rng.random((6, k))
    whole = mode and (lambda log: fb.with_fragments(log, site, sample, p, 2, mode))
    pairs, square = fb.moves_of(k, 2), fb.Moves(k, 2)
    ahead, behind = (x + x.transpose(0, 2, 1) for x in rng.random((2, m, k, k)))
    i, j = np.array(fb.multisets(k, 2)).T
    few, all_ = (fb.state_emissions(w[1], w[0], w[2], q, 2, 0.001, True, whole, x) for x in (True, False))
    assert isinstance(pairs, fb.Pairs) and few.shape == (n, m, 6) and np.allclose(few, all_[:, :, i, j])
    for a, b in ((None, None), (ahead, behind)):
        short = [None if x is None else x[:, i, j] for x in (a, b)]
        for x, y in zip(fb.boundary(few, sw, pairs, *short), fb.boundary(all_, sw, square, a, b), strict=True):
            assert np.allclose(x, y[:, i, j], rtol=1e-12)
        x, y = fb.state_posteriors(few, sw, pairs, *short), fb.state_posteriors(all_, sw, square, a, b)
        assert np.allclose(fb.founder_shares(x, k, 2), fb.founder_shares(y, k, 2)) and np.allclose(fb.genotype_posterior(x, q, 2), fb.genotype_posterior(y, q, 2))
