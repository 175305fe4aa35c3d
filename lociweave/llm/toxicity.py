"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses, a clause into words, and words into the grammar's classes by a weighted lexicon: insults,
threats, targets, negations, reporting words and quotation marks. Transducers are tables: for each state and class the
next state and a factor. `matches` passes insults and threats, `negation` weakens what follows within its reach,
`reported` weakens what a reporting word introduces or quotation marks enclose, `targets` knows how near a target is.
Their product (`composed`) is made once and reads a clause from left to right; `targets` reads it from right to left as
well, since a target may follow what it belongs to. Both states together give the factor of each insult or threat: with a
target near an insult counts more, without one a threat counts little. Clauses with a match are scored by the sum of
their weights; a logistic model on a text's clause scores gives its score. Besides a fixed list, insults are learned from
labelled texts as words and word beginnings; the other classes are fixed lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.textkernel import steps
from lociweave.sources.scratch import forget, written

#: Labelled rows that the lexicon and the model are fitted on at most: those with the smallest id hashes.
FIT_ROWS = 20_000
#: Lengths of word beginnings in the lexicon.
STEMS = (3, 4, 5, 6)
#: A learned insult has this much evidence (likelihood ratio statistic) and occurs in this share of toxic texts.
LEAST_EVIDENCE, LEAST_SHARE = 16.0, 0.02

# Word lists of the grammar.
INSULTS = (
    "idiot moron stupid dumb loser trash garbage scum clown pathetic worthless disgusting ugly fool filthy "
    "dummkopf trottel abschaum widerlich wertlos erbärmlich imbécile crétin ordure pitoyable dégoûtant "
    "estúpido imbécil basura payaso patético asqueroso"
).split()
THREATS = "kill hurt destroy beat crush shoot stab burn umbringen töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she they them him her people du dich dir ihr euch tu te toi vous ils elles tú te usted ustedes ellos ellas".split()
NEGATIONS = "not no never without isn't aren't wasn't don't doesn't nicht kein keine nie ohne pas jamais sans nunca sin".split()
REPORTS = "said says told wrote called quoted claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
QUOTES = '"“”«»„'

#: Word weights of fixed insults and threats.
INSULT_WEIGHT, THREAT_WEIGHT = 3.0, 3.0
#: Factors of the transducers, and the words that a negation and a target reach.
NEGATED, REPORTED, TARGETED, UNTARGETED_THREAT = 0.4, 0.6, 1.25, 0.3
NEGATION_REACH, TARGET_REACH = 3, 6

_CLAUSE = regex.compile(r"[^.!?;:\n]+")
_UNIT = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*|[" + QUOTES + "]")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*")

CLASSES = INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)


@dataclass(frozen=True)
class Transducer:
    """after[state, class] is the next state, factor[state, class] what a word of the class is multiplied by; it starts in 0."""

    after: np.ndarray
    factor: np.ndarray


def _transducer(states: int, step, factor) -> Transducer:
    """The tables of step(state, class) and factor(state, class)."""
    return Transducer(
        np.array([[step(s, c) for c in CLASSES] for s in range(states)]),
        np.array([[factor(s, c) for c in CLASSES] for s in range(states)], float),
    )


def composed(one: Transducer, two: Transducer) -> Transducer:
    """Both side by side: a state for each pair of states, factors multiplied."""
    m = len(two.after)
    return Transducer(
        (one.after[:, None, :] * m + two.after[None, :, :]).reshape(-1, len(CLASSES)),
        (one.factor[:, None, :] * two.factor[None, :, :]).reshape(-1, len(CLASSES)),
    )


def _reach(opener: int, reach: int, within: float) -> Transducer:
    """State: how many words more the last word of class `opener` reaches."""
    return _transducer(
        reach + 1, lambda s, c: reach if c == opener else max(0, s - 1), lambda s, c: within if s and c in (INSULT, THREAT) else 1.0
    )


MATCHES = _transducer(1, lambda s, c: 0, lambda s, c: float(c in (INSULT, THREAT)))
NEGATING = _reach(NEGATION, NEGATION_REACH, NEGATED)
#: States: plain, after a reporting word, within quotation marks, both.
REPORTING = _transducer(
    4, lambda s, c: s | 1 if c == REPORT else s ^ 2 if c == QUOTE else s, lambda s, c: REPORTED if s and c in (INSULT, THREAT) else 1.0
)
TARGETING = _reach(TARGET, TARGET_REACH, 1.0)
#: The left-to-right product; its state modulo the states of TARGETING is that of TARGETING.
GRAMMAR = composed(composed(composed(MATCHES, NEGATING), REPORTING), TARGETING)
#: By class and whether a target is near.
NEAR = np.array([[UNTARGETED_THREAT if c == THREAT else 1.0, TARGETED if c == INSULT else 1.0] for c in CLASSES])
# rows as lists, which single words are looked up in faster
_AFTER, _FACTOR, _NEAR = GRAMMAR.after.tolist(), GRAMMAR.factor.tolist(), NEAR.tolist()
_TARGET_AFTER = TARGETING.after.tolist()


def clause_score(read: list[tuple[int, float]]) -> float:
    """The grammar's output over one clause of (class, weight): two passes, whatever its length."""
    near, state = [False] * len(read), 0
    for i in range(len(read) - 1, -1, -1):
        near[i] = state > 0
        state = _TARGET_AFTER[state][read[i][0]]
    total, state, reach = 0.0, 0, TARGET_REACH + 1
    for (kind, weight), right in zip(read, near, strict=True):
        if weight:
            total += weight * _FACTOR[state][kind] * _NEAR[kind][right or state % reach > 0]
        state = _AFTER[state][kind]
    return total


@dataclass
class Grammar:
    """The lexicon (term or `stem*` to weight) and the logistic model over clause features."""

    insults: dict[str, float]
    weights: tuple[float, ...] = ()
    _classes: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def classify(self, word: str) -> tuple[int, float]:
        """The class and weight of one unit."""
        found = self._classes.get(word)
        if found is None:
            found = self._classify(word)
            if len(self._classes) > 300_000:
                self._classes.clear()
            self._classes[word] = found
        return found

    def _classify(self, word: str) -> tuple[int, float]:
        weight = max([INSULT_WEIGHT if word in INSULTS else 0.0, self.insults.get(word, 0.0), *(self.insults.get(word[:k] + "*", 0.0) for k in STEMS if len(word) >= k)])
        if weight > 0:
            return INSULT, weight
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return kind, THREAT_WEIGHT if kind == THREAT else 0.0
        return (QUOTE if word in QUOTES else OTHER), 0.0

    def clause(self, units: list[str]) -> float:
        """The score of one clause."""
        return clause_score([self.classify(u) for u in units])

    def features(self, text: str) -> tuple[float, float, float, float]:
        """log(1 + sum) and maximum of clause scores, log(1 + matched clauses), and log(1 + matches per 100 words)."""
        low = text.lower()
        words = _WORD.findall(low)
        if not any(self.classify(w)[0] in (INSULT, THREAT) for w in set(words)):
            return 0.0, 0.0, 0.0, 0.0
        scores = [s for c in _CLAUSE.findall(low) if (s := self.clause(_UNIT.findall(c))) > 0]
        total = sum(scores)
        return math.log1p(total), max(scores, default=0.0), math.log1p(len(scores)), math.log1p(100 * total / max(1, len(words)))


def forms(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic texts, texts) of the labelled texts of a task, added up step by step."""
    for batch in batches:
        for part in steps(batch, most=8_000_000):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(forms(text or ""))
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(terms, pa.string()),
                    "bad": pa.array([counts[1][t] for t in terms], pa.int64()),
                    "n": pa.array([counts[0][t] + counts[1][t] for t in terms], pa.int64()),
                }
            )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; classes weigh as they occur."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learned(labelled: DataFrame) -> Grammar:
    """The grammar of labelled texts: labelled has doc_id, text, toxic (0 or 1).

    At most FIT_ROWS rows are used; the caller passes a sample of that size (`fit_sample`). Equal texts count once, so that
    copies do not make their words look typical. Without toxic or without clean texts no insult is learned
    and every score is the share of toxic labels (0 without labels), smoothed.
    """
    texts = labelled.where("text is not null and toxic in (0, 1)").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = written(texts)  # of bounded size, and read three times
    total, bad = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    terms = texts.mapInArrow(_tallied, "term string, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    insults: dict[str, float] = {}
    if 0 < bad < total:
        share = bad / total

        def part(seen, expected):
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        n, b = F.col("n").cast("double"), F.col("bad").cast("double")
        evidence = 2 * (part(b, n * share) + part(n - b, n * (1 - share)))
        odds = F.log((b + 0.5) / (bad + 1)) - F.log((n - b + 0.5) / (total - bad + 1))
        kept = terms.withColumn("evidence", evidence).withColumn("odds", odds)
        kept = kept.where((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") > 1) & (b >= LEAST_SHARE * bad))
        # at most 1 / LEAST_SHARE times the terms of a mean toxic text, as each of these is in that share of them
        insults = {r["term"]: r["odds"] for r in kept.collect()}
    grammar = Grammar(insults)
    rows = featured(texts.select("text", "toxic"), grammar).select("toxic", "features").limit(FIT_ROWS).toArrow()
    forget(texts)
    y = rows["toxic"].to_numpy().astype(float)
    x = np.array(rows["features"].to_pylist(), float).reshape(len(y), 4)
    # two smoothing rows keep the fit finite and the score of a text without matches low
    x, y = np.vstack([x, np.zeros((1, 4)), x.max(0, initial=0)[None]]), np.r_[y, 0.0, 1.0 if insults else 0.0]
    return Grammar(insults, fit_logistic(x, y))


def featured(docs: DataFrame, grammar: Grammar, added: str = "features") -> DataFrame:
    """`docs` (with text) plus `added` array<double>, the features; null texts are empty. Other columns pass through."""
    docs = docs.drop(added)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(grammar.insults)  # see `learned`: bounded by LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Grammar(sent.value)
        for batch in batches:
            for part in steps(batch):
                rows = [list(here.features(t or "")) for t in part.column("text").to_pylist()]
                columns = [*[part.column(name) for name in names], pa.array(rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, added])

    return docs.mapInArrow(run, f"{schema}, `{added}` array<double>")


def fit_sample(labels: DataFrame, docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of the labelled documents with the smallest id hashes, `rows` at most.

    The sample's ids and labels are of bounded size and so are sent to the documents, which stay where they are.
    """
    some = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """`docs` (with text) plus score double (0 to 1, higher is likelier toxic).

    Whole texts are read, null as empty; a text without matches gets the model's lowest score. Other columns, whatever
    their names, pass through, repeated rows too; an empty table gives no rows.
    """
    added = "features" + "_" * max(map(len, docs.columns))  # a name that no column has
    z = F.lit(grammar.weights[0])
    for i, w in enumerate(grammar.weights[1:]):
        z = z + F.lit(w) * F.get(added, F.lit(i))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return featured(docs.drop("score"), grammar, added).withColumn("score", 1 / (1 + F.exp(-z))).drop(added)
