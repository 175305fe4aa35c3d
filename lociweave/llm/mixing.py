"""Mixing sources to target weights: bounded iterative proportional fitting, as DataFrame operations only.

Documents are counted into cells (source, language, topic) of tokens. Each cell gets a keep probability, first the
same everywhere; then, margin by margin and round by round, the probabilities of a margin's cells are multiplied by
(target tokens / expected tokens), and held at 1 because no document can be kept more than once. A round's residual is the sum of
|target - expected| over all values of all margins, as a share of all tokens. Raking ends when it is nearly 0 or no longer
falls, which it does where no probabilities reach all targets, and gives the round with the smallest one. A document stays
if a number in [0, 1), made from its id by md5, is below its cell's probability.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.sources.scratch import forget, written

MARGINS = ("source", "lang", "topic")
#: Production parameters. A margin's target share of a value is its own share of tokens to this power, made to sum to 1:
#: 1 keeps the corpus as it is, 0 gives every value the same.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Share of all tokens that the sample aims at.
KEEP_SHARE = 0.6
#: Raking ends with a residual of this, or once PATIENCE rounds have lowered the smallest one by less than GAIN altogether.
TOLERANCE, GAIN, PATIENCE = 1e-6, 1e-5, 8
#: No more rounds than these are made, whatever they still gain.
MOST_ROUNDS = 2000
#: Up to so many cells (they are few beside documents) are one row of arrays, on which a job makes ROW_ROUNDS rounds; beyond that
#: cells stay rows, and a job makes JOB_ROUNDS rounds by windows. Both give the same probabilities.
CELLS_TOGETHER, ROW_ROUNDS, JOB_ROUNDS = 50_000, 250, 3
#: Topic rules, first match wins: a document with any of these strings has the topic.
TOPICS = (
    ("legal", ("icense", "opyright", "ICENSE")),
    ("contact", ("@", "://")),
    ("code", ("def ", "return ", "import ", "{", "};", "==")),
    ("table", (" | ", "\t")),
    ("dialogue", ('"', "“", "«")),
)
OTHER_TOPIC = "general"
#: Stands for a null source or language.
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The topic of a text by `TOPICS`; null and empty texts are general."""
    out = None
    for name, marks in TOPICS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        hit = F.coalesce(hit, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_TOPIC)


def tokens_of(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each document."""
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.coalesce("lang", F.lit(NONE)).alias("lang"),
        topic_of(F.col("text")).alias("topic"),
        tokens_of(F.col("text")).alias("n_tokens"),
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; null ids share one."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def targets(cells: DataFrame, margin: str, power: float, keep_share: float, shares: Mapping[str, float] | None = None) -> DataFrame:
    """(margin value, target) in tokens. `shares` gives wanted shares by value; without it powers of the own shares do."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
    if shares is not None:
        named = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        own = own.withColumn("weight", F.coalesce(named[F.col(margin)], F.lit(0.0)))
    else:
        own = own.withColumn("weight", F.when(F.col("own") > 0, F.pow(F.col("own").cast("double"), F.lit(power))).otherwise(0.0))
    all_tokens, all_weight = own.agg(F.sum("own"), F.sum("weight")).first()  # two numbers
    if not all_weight:
        return own.select(margin, F.lit(0.0).alias("target"))
    return own.select(margin, (F.lit(float(keep_share)) * F.lit(all_tokens) * F.col("weight") / F.lit(all_weight)).alias("target"))


def raked(
    cells: DataFrame,
    powers: Mapping[str, float] = POWERS,
    keep_share: float = KEEP_SHARE,
    tolerance: float = TOLERANCE,
    shares: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """cells (source, lang, topic, tokens; each cell once) with their keep probability p.

    Cells without tokens keep the start value where nothing moves their margins. Where the targets cannot all be met (more
    than all of a value's tokens would be needed, or cells are absent), the nearest probabilities found are returned; `residuals` tells how
    far from each target they are.
    """
    aims = {m: targets(cells, m, powers[m], keep_share, (shares or {}).get(m)) for m in MARGINS}
    start = cells.select(*MARGINS, "tokens", F.lit(float(keep_share)).alias("p"))
    for m in MARGINS:
        start = start.join(aims[m].withColumnRenamed("target", f"target_{m}"), m)
        start = start.withColumn(f"size_{m}", F.count(F.lit(1)).over(Window.partitionBy(m)))
    now = written(start)
    n_cells, all_tokens = now.agg(F.count(F.lit(1)), F.sum("tokens")).first()  # two numbers
    if not all_tokens:
        return now.select(*MARGINS, "tokens", "p")
    return _raked_as_arrays(now, all_tokens, tolerance) if n_cells <= CELLS_TOGETHER else _raked_as_rows(now, all_tokens, tolerance)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _expected(p: Column, tokens: Column, groups: Column) -> Column:
    """Expected tokens of every value of a margin; groups: the numbers of each value's cells."""
    return F.transform(groups, lambda g: F.aggregate(g, F.lit(0.0), lambda so_far, i: so_far + tokens[i] * p[i]))


_STATE = "struct<p:array<double>,best:array<double>,lowest:array<double>,ended:boolean>"


def _raked_as_arrays(start: DataFrame, all_tokens: int, tolerance: float) -> DataFrame:
    """The rounds as expressions over one row: the cells' tokens and probabilities, and of each margin its targets and its values' cells."""
    numbered = start.select("*", (F.row_number().over(Window.orderBy(*MARGINS)) - 1).alias("i"), *[(F.dense_rank().over(Window.orderBy(m)) - 1).alias(f"value_{m}") for m in MARGINS])
    numbered = written(numbered)
    cells = F.array_sort(F.collect_list(F.struct("i", *MARGINS, "tokens", "p", *[f"value_{m}" for m in MARGINS])))
    row = numbered.agg(cells.alias("cells"))
    for m in MARGINS:
        values = numbered.groupBy(f"value_{m}").agg(F.first(f"target_{m}").alias("target"), F.array_sort(F.collect_list("i")).alias("cells"))
        values = values.agg(F.array_sort(F.collect_list(F.struct(f"value_{m}", "target", "cells"))).alias(f"margin_{m}"))
        row = row.join(F.broadcast(values))  # one row each
    margin = [F.struct(
        F.col(f"margin_{m}.target").alias("target"), F.col(f"margin_{m}.cells").alias("groups"),
        F.col(f"cells.value_{m}").alias("value"),
    ) for m in MARGINS]
    p = F.col("cells.p")
    first = F.struct(p.alias("p"), p.alias("best"), F.array().cast("array<double>").alias("lowest"), F.lit(False).alias("ended")).cast(_STATE)
    row = row.select("cells", F.col("cells.tokens").cast("array<double>").alias("tokens"), F.array(*margin).alias("margins"), first.alias("state"))

    def step(p: Column, m: Column) -> Column:
        factors = F.transform(_expected(p, F.col("tokens"), m["groups"]), lambda e, j: F.when(e > 0, m["target"][j] / e).otherwise(1.0))
        return _let(factors, lambda f: F.transform(p, lambda x, i: F.least(F.lit(1.0), x * f[m["value"][i]])))

    def missed(p: Column) -> Column:
        def of(so_far: Column, m: Column) -> Column:
            gaps = F.zip_with(_expected(p, F.col("tokens"), m["groups"]), m["target"], lambda e, t: F.abs(t - e))
            return so_far + F.aggregate(gaps, F.lit(0.0), lambda x, y: x + y)

        return F.round(F.aggregate("margins", F.lit(0.0), of) / all_tokens, 9)

    def follow(state: Column, p: Column, residual: Column) -> Column:
        n = F.size(state["lowest"])
        last = F.coalesce(F.get(state["lowest"], n - 1), F.lit(float("inf")))
        least = F.least(residual, last)
        calm = (n >= PATIENCE) & (least > F.coalesce(F.get(state["lowest"], n - PATIENCE), F.lit(float("inf"))) - GAIN)
        return F.struct(
            p.alias("p"), F.when(residual < last, p).otherwise(state["best"]).alias("best"), F.concat(state["lowest"], F.array(least)).alias("lowest"),
            ((least <= tolerance) | calm | (n + 1 >= MOST_ROUNDS)).alias("ended"),
        ).cast(_STATE)

    def next_round(state: Column, _: Column) -> Column:
        after = F.aggregate("margins", state["p"], step)
        return F.when(state["ended"], state).otherwise(_let(after, lambda p: _let(missed(p), lambda r: follow(state, p, r)))).cast(_STATE)

    while True:
        after = written(row.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROW_ROUNDS)), F.col("state"), next_round)))
        forget(row)
        row = after
        if row.select("state.ended").first()[0]:
            break
    forget(numbered)
    out = row.select(F.explode(F.zip_with("cells", "state.best", lambda c, p: F.struct(*[c[m].alias(m) for m in MARGINS], c["tokens"].alias("tokens"), p.alias("p")))).alias("c"))
    return out.select("c.*")


def _raked_as_rows(now: DataFrame, all_tokens: int, tolerance: float) -> DataFrame:
    """The rounds as windows by each margin in turn, a few in each job."""
    column = "p"
    given = [*MARGINS, "tokens", *[f"{x}_{m}" for m in MARGINS for x in ("target", "size")]]
    lowest: list[float] = []  # the smallest residual up to each round
    best: tuple[DataFrame, str] | None = None
    while True:
        rows = now.select(*given, F.col(column).alias("p0"))
        for i in range(1, JOB_ROUNDS + 1):
            rows = _round(rows, f"p{i - 1}", f"p{i}", f"off{i}")
        job = written(rows.select(*given, *[f"{x}{i}" for i in range(1, JOB_ROUNDS + 1) for x in ("p", "off")]))
        off = job.agg(*[F.sum(f"off{i}") for i in range(1, JOB_ROUNDS + 1)]).first()  # a number for each round
        ended = False
        for i in range(1, JOB_ROUNDS + 1):
            residual = round(off[i - 1] / all_tokens, 9)
            if not lowest or residual < lowest[-1]:
                if best is not None and best[0] is not job:
                    forget(best[0])
                best = job, f"p{i}"
            lowest.append(min(residual, lowest[-1]) if lowest else residual)
            ended = lowest[-1] <= tolerance or len(lowest) >= MOST_ROUNDS
            ended = ended or len(lowest) > PATIENCE and lowest[-1] > lowest[-1 - PATIENCE] - GAIN
            if ended:
                break
        if now is not best[0]:
            forget(now)
        now, column = job, f"p{JOB_ROUNDS}"
        if ended:
            return best[0].select(*MARGINS, "tokens", F.col(best[1]).alias("p"))


def _round(rows: DataFrame, before: str, after: str, off: str) -> DataFrame:
    """One round from column `before` to `after`; `off` is what a cell adds to the residual of `after`."""
    p = F.col(before)
    for m in MARGINS:
        expected = F.sum(F.col("tokens") * p).over(Window.partitionBy(m))
        rows = rows.withColumn("expected", expected)
        step = F.when(F.col("expected") > 0, F.col(f"target_{m}") / F.col("expected")).otherwise(1.0)
        rows, p = rows.withColumn(after, F.least(F.lit(1.0), p * step)), F.col(after)
    missed = F.lit(0.0)
    for m in MARGINS:
        rows = rows.withColumn(f"expected_{m}", F.sum(F.col("tokens") * p).over(Window.partitionBy(m)))
        missed = missed + F.abs(F.col(f"target_{m}") - F.col(f"expected_{m}")) / F.col(f"size_{m}")
    return rows.withColumn(off, missed).drop("expected", *[f"expected_{m}" for m in MARGINS])


def residuals(
    calibrated: DataFrame, powers: Mapping[str, float] = POWERS, keep_share: float = KEEP_SHARE, shares: Mapping[str, Mapping[str, float]] | None = None
) -> DataFrame:
    """margin, value, target and expected tokens of every value of every margin of what `raked` returned."""
    out = None
    for m in MARGINS:
        aim = targets(calibrated.select(m, "tokens"), m, powers[m], keep_share, (shares or {}).get(m))
        got = calibrated.groupBy(m).agg(F.sum(F.col("tokens") * F.col("p")).alias("expected"))
        part = aim.join(got, m).select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "expected")
        out = part if out is None else out.unionByName(part)
    return out


def mixed(
    docs: DataFrame,
    powers: Mapping[str, float] = POWERS,
    keep_share: float = KEEP_SHARE,
    tolerance: float = TOLERANCE,
    shares: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (9 digits), kept of every document.

    docs: doc_id, text, source, lang; other columns are ignored. Null source and lang are the value `(none)`; null and empty
    texts have no tokens and the topic `general`. Rows that repeat an id share its decision. An empty table gives no rows.
    Targets that cannot be met are met as nearly as raking gets (see `raked`); no table makes it fail.
    The join of documents with cells is on three columns, of which a hot one may hold a third of all rows: the cells are
    few there, and adaptive execution splits the documents' side.
    """
    rows = written(described(docs))  # small beside the texts, which are read once
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    p = raked(cells, powers, keep_share, tolerance, shares).select(*MARGINS, F.round("p", 9).alias("probability"))
    return rows.join(p, list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept")
    )
