"""Linear mixed models of traits over relationship matrices that are never built: eigenvectors, heritability, whitening, association.

The standardised genotypes are a written table of dense tiles (samples by variants). The leading eigenvectors of the
relationship matrix, and of those that leave one group of variants out each, come from a randomised decomposition: products of
tiles with thin matrices, orthonormalised between passes, all left-out groups in the same jobs. On the driver are only
matrices of as many rows and columns as there are components. Likelihoods are aggregations over components, for all traits and
groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from lociweave.functions.distributions import neglog_erfc, neglog_t
from lociweave.operators.relatedness import z_scores
from lociweave.sources.scratch import forget, written

#: Samples and variants of a tile, at most about twice that.
TILE_SAMPLES, TILE_VARIANTS = 256, 1024
#: Columns of the sketch beyond the components asked for, and passes forth and back over the tiles after the first.
EXTRA, PASSES = 16, 4
#: No variant is left out of this run.
ALL = "all"
#: Eigenvalues below this part of the largest are noise, and no eigenvalue in a likelihood is below TOL.
NOISE, TOL = 1e-10, 1e-8


def standardised(long: DataFrame, scale: bool = True, groups: bool = False) -> DataFrame:
    """(id, variant, grp, z): dosage less its variant's mean, over its population deviation if `scale`. Missing dosages have no row.

    long: id, variant, dosage, and grp with `groups`. A variant without spread is 0 everywhere.
    """
    rows = long.where("dosage is not null").withColumn("grp", F.col("grp").cast("string") if groups else F.lit(""))
    if scale:
        return z_scores(rows, "grp")
    by = rows.groupBy("variant").agg(F.avg("dosage").alias("mean"))
    return rows.join(by, "variant").select("id", "variant", "grp", (F.col("dosage") - F.col("mean")).alias("z"))


_TILE = "block int, slice int, grp string, ids array<long>, variants array<long>, m binary"
_THIN = "run string, grp string, part int, names array<long>, m binary"


def tiled(z: DataFrame) -> DataFrame:
    """The tiles of (id, variant, grp, z) as a written table; a tile is of one group. Absent cells are 0."""
    blocks = max(1, -(-z.select("id").distinct().count() // TILE_SAMPLES))
    slices = max(1, -(-(z.select("grp", "variant").distinct().groupBy("grp").count().agg(F.max("count")).first()[0] or 0) // TILE_VARIANTS))

    def dense(rows: pa.Table) -> pa.Table:
        ids, i = np.unique(rows["id"].to_numpy(), return_inverse=True)
        variants, j = np.unique(rows["variant"].to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), len(variants)))
        m[i, j] = rows["z"].to_numpy()
        fixed = [[rows[c][0].as_py()] for c in ("block", "slice", "grp")]
        return pa.table([*fixed, [ids], [variants], [m.tobytes()]], schema=_arrow(_TILE))

    keyed = z.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("variant"), F.lit(slices)).cast("int").alias("slice"),
        "grp", F.col("id").cast("long").alias("id"), F.col("variant").cast("long").alias("variant"), "z",
    )
    return written(keyed.groupBy("block", "slice", "grp").applyInArrow(dense, _TILE))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def _sketch(variants: np.ndarray, columns: int) -> np.ndarray:
    """Normal numbers that depend on a variant's number and the column alone."""
    return np.array([np.random.default_rng([int(v) & (2**63 - 1), 17]).standard_normal(columns) for v in variants]).reshape(len(variants), columns)


def _added(thin: DataFrame) -> DataFrame:
    """Thin matrices of one (run, grp, part) added up by row name."""

    def add(rows: pa.Table) -> pa.Table:
        names = np.unique(rows["names"].combine_chunks().flatten().to_numpy())
        out = None
        for name, raw in zip(rows["names"].to_pylist(), rows["m"].to_pylist(), strict=True):
            m = _matrix(raw, len(name))
            out = np.zeros((len(names), m.shape[1])) if out is None else out
            out[np.searchsorted(names, name)] += m
        return pa.table([[rows["run"][0].as_py()], [rows["grp"][0].as_py()], [rows["part"][0].as_py()], [names], [out.tobytes()]], schema=_arrow(_THIN))

    return thin.groupBy("run", "grp", "part").applyInArrow(add, _THIN)


def _thin_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _arrow(_THIN).types, strict=True)], schema=_arrow(_THIN))


def _first_pass(tiles: DataFrame, runs: list[str], columns: int) -> DataFrame:
    """Genotypes times the sketch: thin matrices over sample blocks, for every run without its own group."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                y = _matrix(t["m"], len(t["ids"])) @ _sketch(np.array(t["variants"]), columns)
                yield _thin_rows([(run, "", t["block"], t["ids"], y.tobytes()) for run in runs if run == ALL or run != t["grp"]])

    return written(_added(tiles.mapInArrow(multiply, _THIN)))


def _times(tiles: DataFrame, thin: DataFrame, across: bool) -> DataFrame:
    """Tiles times a thin matrix over variants (`across`), which gives one over samples, or transposed the other way round.

    A tile meets the thin matrices of its slice or block in a join; products that belong together are added up by row name.
    """
    given = thin.select("run", F.col("grp").alias("of"), "part", F.col("names").alias("held"), F.col("m").alias("w"))
    own = (F.col("part") == F.col("slice")) & (F.col("of") == F.col("grp")) if across else F.col("part") == F.col("block")
    met = tiles.join(given, own).where((F.col("run") == ALL) | (F.col("run") != F.col("grp")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                m, w = _matrix(t["m"], len(t["ids"])), _matrix(t["w"], len(t["held"]))
                if across:
                    y = m @ w[np.searchsorted(t["held"], t["variants"])]
                    yield _thin_rows([(t["run"], "", t["block"], t["ids"], y.tobytes())])
                else:
                    y = m.T @ w[np.searchsorted(t["held"], t["ids"])]
                    yield _thin_rows([(t["run"], t["grp"], t["slice"], t["variants"], y.tobytes())])

    return written(_added(met.mapInArrow(multiply, _THIN)))


def _grams(thin: DataFrame) -> dict[str, np.ndarray]:
    """The product of every run's thin matrix with itself: matrices of as many rows and columns as the sketch has columns."""

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t in batch.to_pylist():
                m = _matrix(t["m"], len(t["names"]))
                sums[t["run"]] = sums.get(t["run"], 0) + m.T @ m
        yield _thin_rows([(run, "", 0, list(range(len(g))), g.tobytes()) for run, g in sums.items()])

    added = _added(thin.mapInArrow(square, _THIN)).collect()  # one small matrix for each run
    return {r["run"]: _matrix(bytes(r["m"]), len(r["names"])) for r in added}


def _turned(thin: DataFrame, by: dict[str, np.ndarray]) -> DataFrame:
    """Every run's thin matrix times a small one."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _thin_rows([(t["run"], t["grp"], t["part"], t["names"], (_matrix(t["m"], len(t["names"])) @ by[t["run"]]).tobytes()) for t in batch.to_pylist()])

    return written(thin.mapInArrow(multiply, _THIN))


def _orthonormal(thin: DataFrame, times: int = 1) -> DataFrame:
    """An orthonormal base of what every run's columns span; squares lose half of the digits, a second time gives them back."""
    for _ in range(times):
        turns = {}
        for run, gram in _grams(thin).items():
            values, vectors = np.linalg.eigh(gram)
            good = values > NOISE * max(values.max(initial=0), 1e-300)
            turns[run] = vectors[:, good] / np.sqrt(values[good])
        after = _turned(thin, turns)
        forget(thin)
        thin = after
    return thin


def eigenvectors(z: DataFrame, components: int, leave_out: bool = False) -> tuple[DataFrame, DataFrame]:
    """(run, id, u array), (run, k, s): leading eigenvectors and eigenvalues of the relationship matrix z z' / (variants - 1).

    z: id, variant, grp, z (see `standardised`). The run `all` takes all variants; with `leave_out` there is one more for each grp, without its
    variants. Components are in the order of falling s; fewer than asked for come where the matrix has no more. Exact where the rank is
    within components + EXTRA, else by PASSES subspace iterations. Signs are arbitrary.
    """
    tiles = tiled(z)
    counts = {r["grp"]: r["n"] for r in z.select("grp", "variant").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each group
    runs = [ALL, *sorted(counts)] if leave_out else [ALL]
    variants = {run: sum(counts.values()) - (counts[run] if run != ALL else 0) for run in runs}
    columns = components + EXTRA
    # a sketch as wide as the matrix is narrow spans all of it at once
    passes = PASSES if max(variants.values()) > columns and z.select("id").distinct().count() > columns else 0
    samples = _orthonormal(_first_pass(tiles, runs, columns), 1 if passes else 2)
    for k in range(passes + 1):
        across = _times(tiles, samples, False)
        if k == passes:
            break
        forget(samples)
        samples = _orthonormal(_times(tiles, across, True), 2 if k == passes - 1 else 1)
        forget(across)
    turns, values = {}, []
    for run, gram in _grams(across).items():
        s, v = np.linalg.eigh(gram)
        order = [i for i in np.argsort(-s)[:components] if s[i] > NOISE * s.max(initial=0)]
        turns[run] = v[:, order]
        values += [(run, k, float(s[i] / max(variants[run] - 1, 1))) for k, i in enumerate(order)]
    out = _turned(samples, turns)
    for df in (tiles, samples, across):
        forget(df)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                m = _matrix(t["m"], len(t["names"]))
                u = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([t["run"]] * len(m), pa.string()), pa.array(t["names"], pa.int64()), u], names=["run", "id", "u"])

    vectors = out.mapInArrow(rows, "run string, id long, u array<double>")
    return vectors, z.sparkSession.createDataFrame(values, "run string, k int, s double")


def principal_components(long: DataFrame, k: int = 2) -> DataFrame:
    """(id, pc array): principal components of samples in the long matrix id, variant, dosage, missing values at the mean; signs are arbitrary."""
    z = standardised(long, scale=False)
    u, s = eigenvectors(z, k)
    n = z.select("variant").distinct().count()
    sizes = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: F.sqrt(x["s"] * max(n - 1, 1))).alias("sizes"))
    return u.join(F.broadcast(sizes)).select("id", F.zip_with("u", "sizes", lambda a, b: a * b).alias("pc"))  # one row


def rotated(u: DataFrame, s: DataFrame, traits: DataFrame) -> DataFrame:
    """run, trait, k, s, r2, r, n, sp, sp0, of every component: the trait turned into the eigenvectors, over samples that have a value.

    traits: id, trait, value. r2: the square of the centred trait's part, r: the part of the trait as it is; s is that of all samples times the
    share of the eigenvector that the observed samples hold; n, sp, sp0: their number and the trait's variance (over n - 1 and n).
    """
    seen = traits.where("value is not null").join(u, "id")
    each = seen.select("run", "trait", "value", F.posexplode("u").alias("k", "x"))
    sums = each.groupBy("run", "trait", "k").agg(
        F.sum(F.col("x") * F.col("value")).alias("r"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("held"),
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("sp"), F.var_pop("value").alias("sp0"),
    )
    return sums.join(s, ["run", "k"]).select(
        "run", "trait", "k", (F.col("s") * F.col("held")).alias("s"), F.pow(F.col("r") - F.col("mean") * F.col("total"), F.lit(2.0)).alias("r2"), "r", "n", "sp", "sp0"
    )


def _likelihood(at: DataFrame, keys: list[str], reml: bool) -> DataFrame:
    """keys, h, likelihood: one aggregation over components; at: rows of `rotated` with a column h."""
    v = F.col("h") * F.col("sp") * F.greatest(F.col("s"), F.lit(TOL)) + (1 - F.col("h")) * F.col("sp")
    out = at.groupBy(*keys, "h").agg(
        F.sum(F.log(v)).alias("log_det"), F.sum(F.col("r2") / v).alias("quad"), F.sum(1 / v).alias("inverse"), F.max("n").alias("n")
    )
    value = -0.5 * (F.col("quad") + F.col("log_det") + F.col("n") * float(np.log(2 * np.pi)))
    return out.select(*keys, "h", (value - 0.5 * F.log("inverse") if reml else value).alias("likelihood"))


def heritability(parts: DataFrame, reml: bool = True, points: int = 33, rounds: int = 5) -> DataFrame:
    """run, trait, h2, likelihood, se, p: the share of a trait's variance that the relationship explains, in [0, 1].

    parts: from `rotated`. Every round evaluates the likelihood at `points` places of what is left of the interval, for all runs and
    traits in one aggregation, and goes on around the best. se is from the curvature there (null where it is not convex), p the likelihood
    ratio's against no heritability at all.
    """
    keys = ["run", "trait"]
    parts = written(parts)
    width, best = 1.0, parts.select(*keys).distinct().withColumn("h2", F.lit(0.5))
    for _ in range(rounds):
        step = width / (points - 1)
        low = F.least(F.greatest(F.col("h2") - width / 2, F.lit(0.0)), F.lit(1.0 - width))
        at = parts.join(best, keys).withColumn("h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * step)))
        top = F.max_by("h", F.struct("likelihood", -F.col("h")))
        after = written(_likelihood(at, keys, reml).groupBy(*keys).agg(top.alias("h2")))
        forget(best)
        best, width = after, 2 * step
    eps = 1e-4
    near = F.array(F.col("h2"), F.least(F.col("h2") + eps, F.lit(1.0)), F.greatest(F.col("h2") - eps, F.lit(0.0)), F.lit(0.0))
    at = parts.join(best, keys).select("*", F.posexplode(near).alias("which", "h"))
    ends = _likelihood(at, [*keys, "h2", "which"], reml).groupBy(*keys, "h2").pivot("which", [0, 1, 2, 3]).agg(F.first("likelihood"))
    curve = (2 * F.col("0") - F.col("1") - F.col("2")) / eps**2
    ratio = F.greatest(F.lit(0.0), 2 * (F.col("0") - F.col("3")))
    return ends.select(*keys, "h2", F.col("0").alias("likelihood"), F.when(curve > 0, F.sqrt(1 / curve)).alias("se"), F.pow(F.lit(10.0), -chi_neglog(ratio)).alias("p"))


@pandas_udf(DoubleType())
def normal_neglog(z: pd.Series) -> pd.Series:
    return pd.Series(neglog_erfc(np.abs(z.to_numpy(float)) / np.sqrt(2)))


@pandas_udf(DoubleType())
def t_neglog(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(neglog_t(t.to_numpy(float), df.to_numpy(float)))


def chi_neglog(x: Column) -> Column:
    """-log10 of the upper tail of chi squared with one degree of freedom."""
    return normal_neglog(F.sqrt(x))


def corrected(u: DataFrame, parts: DataFrame, h2: DataFrame, how: str, traits: DataFrame) -> DataFrame:
    """(run, trait, id, value): traits without what relatives share: `ystar` whitens, `blup_resid` takes the prediction off, `blup` is it.

    u and parts: see `eigenvectors` and `rotated`; h2: run, trait, h2. Whitened values and predictions exist for every sample that has
    eigenvectors, residuals for those with a value.
    """
    if how not in ("ystar", "blup", "blup_resid"):
        raise ValueError(f"unknown correction {how!r}: ystar, blup or blup_resid")
    at = parts.join(h2.select("run", "trait", "h2"), ["run", "trait"])
    v = F.greatest(F.col("sp0") * (F.col("h2") * F.greatest(F.col("s"), F.lit(TOL)) + 1 - F.col("h2")), F.lit(TOL))
    shared = F.col("h2") * F.col("s") / (F.col("h2") * F.col("s") + 1 - F.col("h2"))
    weight = F.col("r") / F.sqrt(v) if how == "ystar" else F.col("r") * shared
    # as many numbers as there are components, for every run and trait
    weights = at.groupBy("run", "trait").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", weight.alias("w")))), lambda x: x["w"]).alias("w"))
    out = u.join(weights, "run").select("run", "trait", "id", F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y).alias("value"))
    if how != "blup_resid":
        return out
    return out.withColumnRenamed("value", "shared").join(traits, ["id", "trait"]).select("run", "trait", "id", (F.col("value") - F.col("shared")).alias("value"))


def scaled_association(z: DataFrame, traits: DataFrame, stat: str = "ttest", sided: str = "two-sided") -> DataFrame:
    """variant, trait, beta, beta_se, stat, neglog_p, dof of standardised genotypes and traits.

    z: id, variant, grp, z; traits: id, trait, value, and run where a trait has a value of its own for each group. `ttest`, `wald` and `score` give
    p by t, by the normal distribution, and by that with the residuals of no effect; the last two return squares as stat. Degrees of
    freedom are the samples with both less one; without any, or without spread, results are null.
    """
    if stat not in ("ttest", "wald", "score") or sided not in ("two-sided", "one-sided"):
        raise ValueError(f"unknown test {stat!r} or side {sided!r}")
    own = ["run", "trait"] if "run" in traits.columns else ["trait"]
    seen = traits.where("value is not null")
    size = seen.groupBy(*own).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    y = seen.join(size, own).select(*own, "id", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).alias("y"))
    if "run" in own:
        y = y.withColumnRenamed("run", "grp")
    rows = z.join(y, ["id", "grp"] if "run" in own else "id").where("y is not null")
    s = rows.groupBy("variant", "trait").agg(
        F.sum(F.col("z") * F.col("y")).alias("xy"), F.sum(F.col("z") * F.col("z")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), (F.count(F.lit(1)) - 1).alias("dof")
    )
    beta = F.when(F.col("xx") > 1e-12, F.col("xy") / F.col("xx"))
    left = F.col("yy") if stat == "score" else F.greatest(F.lit(0.0), F.col("yy") - F.col("beta") * F.col("beta") * F.col("xx"))
    s = s.withColumn("beta", beta).withColumn("beta_se", F.when((F.col("dof") > 0) & (F.col("xx") > 1e-12), F.sqrt(left / (F.col("dof") * F.col("xx")))))
    s = s.withColumn("t", F.when(F.col("beta_se") > 0, F.col("beta") / F.col("beta_se")))
    p = t_neglog(F.col("t"), F.col("dof").cast("double")) if stat == "ttest" else normal_neglog(F.col("t"))
    p = F.when(F.col("t").isNotNull(), p + (float(np.log10(2)) if sided == "one-sided" else 0.0))
    shown = F.col("t") if stat == "ttest" else F.col("t") * F.col("t")
    return s.select("variant", "trait", "beta", "beta_se", shown.alias("stat"), p.alias("neglog_p"), "dof")


def gwas(long: DataFrame, traits: DataFrame, components: int, correction: str | None = "ystar", stat: str = "ttest", sided: str = "two-sided") -> DataFrame:
    """Association of every variant with every trait, corrected by the relationship of all other groups' variants.

    long: id, variant, dosage, grp (the variant's chromosome); traits: id, trait, value. Without a correction relatives count as they are.
    """
    z = written(standardised(long, groups=True))
    if correction is None:
        return scaled_association(z, traits, stat, sided)
    u, s = eigenvectors(z, components, leave_out=True)
    u = written(u)
    parts = written(rotated(u, s, traits))
    fitted = heritability(parts)
    y = corrected(u, parts, fitted, correction, traits).where(F.col("run") != ALL)
    return scaled_association(z, y, stat, sided)
