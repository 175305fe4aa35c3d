"""Boosted trees for several classes by Spark aggregations, and the read-aware features of a cell.

Features become bins once, written as one small binary for each row. Every pass over them sends to the driver what split
finding needs: sums of gradients by class, node, feature and bin, whose number does not depend on the rows. A task works out
a row's scores from the trees so far, so no state of rows is kept between passes and lost tasks are simply done again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.operators import posterior as gp_
from lociweave.sources.scratch import forget, written

#: The features of a cell, in the order of the contract.
FEATURES = (
    "dosage", "depth", "log_depth", "alt_fraction", "support_mask", "ref_count", "alt_count", "other_count", "total_count", "gp0", "gp1", "gp2",
    "max_prob", "margin", "entropy", "posterior_var", "variant_maf", "variant_info", "variant_hwe_deviation", "variant_hwe_chisq",
    "site_ref_count", "site_alt_count", "site_other_count", "site_total_count", "site_support_samples", "site_support_rate", "site_mean_depth",
)


def read_aware_features(cells: DataFrame, n_samples: int, keep: tuple[str, ...] = ("sample_id", "pos")) -> DataFrame:
    """keep and FEATURES of every cell; cells: sample_id, pos, dosage, gp, depth, ref_count, alt_count, other_count.

    Site features are one aggregation by site, joined back; sites without a statistic have 0 there. Rates and mean depth are over n_samples.
    """
    total = F.col("ref_count") + F.col("alt_count") + F.col("other_count")
    sums = cells.groupBy("pos").agg(
        *[F.sum(c).alias(f"site_{c}") for c in ("ref_count", "alt_count", "other_count")], F.sum(total).alias("site_total_count"), F.count_if(total > 0).alias("site_support_samples")
    )
    stats = gp_.site_statistics(cells).select("pos", F.col("maf").alias("variant_maf"), F.coalesce("info", F.lit(0.0)).alias("variant_info"), F.col("hwe_deviation").alias("variant_hwe_deviation"), F.col("hwe_chisq").alias("variant_hwe_chisq"))
    site = sums.join(stats, "pos").withColumn("site_support_rate", F.col("site_support_samples") / float(max(n_samples, 1))).withColumn("site_mean_depth", F.col("site_total_count") / float(max(n_samples, 1)))
    g = F.col("gp")
    own = {
        "log_depth": F.log1p(F.greatest(F.col("depth"), F.lit(0)).cast("double")), "total_count": total, "alt_fraction": (F.col("alt_count") + 0.5) / F.greatest(total + 1.0, F.lit(1.0)),
        "support_mask": (total > 0).cast("int"), **{f"gp{i}": F.get(g, F.lit(i)) for i in range(3)}, "max_prob": gp_.confidence(g), "margin": gp_.margin(g), "entropy": gp_.entropy(g),
        "posterior_var": F.greatest(F.lit(0.0), F.get(g, F.lit(1)) + 4 * F.get(g, F.lit(2)) - F.col("dosage") * F.col("dosage")),
    }
    rows = cells.withColumns(own).join(site, "pos")
    return rows.select(*keep, *[F.col(f).cast("double").alias(f) for f in FEATURES])


@dataclass
class Tree:
    """A tree of one depth as arrays: node i has children 2i + 1 and 2i + 2; bins above `cut` go right; feature -1 is a node that is not split."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node at `depth`, or the last one before it that is not split, of every row of bins."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            down = 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(f >= 0, down, at)
        return at


@dataclass
class Boosted:
    """A model: bin edges of each feature, first scores of each class, and for every round one tree a class."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    start: np.ndarray
    rate: float
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of feature values; missing ones are in the first."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.nodes(bins, self.depth)]
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least_rows: int, ridge: float) -> tuple[int, int, float]:
    """(feature, cut, gain) of one node from sums by feature and bin, the first on ties; feature -1 where no split gains anything."""
    if g.shape[1] < 2:
        return -1, 0, 0.0
    gl, hl, nl = (x.cumsum(1)[:, :-1] for x in (g, h, n))
    gt, ht, nt = g.sum(1, keepdims=True), h.sum(1, keepdims=True), n.sum(1, keepdims=True)
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    gain = np.where((nl >= least_rows) & (nt - nl >= least_rows), np.round(gain, 9), -np.inf)
    f, cut = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(cut), float(gain[f, cut])) if gain[f, cut] > 1e-9 else (-1, 0, 0.0)


def fitted(
    rows: DataFrame, features: tuple[str, ...], label: str, classes: int = 3, rounds: int = 12, depth: int = 3, rate: float = 0.3, max_bins: int = 32, least_rows: int = 20, ridge: float = 1.0
) -> Boosted:
    """Softmax boosting over all rows: `rounds` times one tree for each class, each of `depth` levels.

    rows: the features as numbers and the label, from 0; other labels take no part. Bin edges are approximate quantiles. A node is split where
    both sides keep least_rows; its leaf values are Newton steps. depth passes over the bins are made each round.
    """
    rows = rows.where(F.col(label).between(0, classes - 1))
    share = [(i + 1) / max_bins for i in range(max_bins - 1)]
    summary = rows.agg(*[F.percentile_approx(f, share, 10_000).alias(f) for f in features]).first()  # max_bins numbers for each feature
    edges = [np.unique(np.array([v for v in summary[f] or [] if v is not None], float)) for f in features]
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each class
    prior = np.array([counts.get(k, 0) + 1.0 for k in range(classes)])
    model = Boosted(tuple(features), edges, np.log(prior / prior.sum()), rate, depth)
    width, wide = max(len(e) for e in edges) + 1, len(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in model.bins(x)], pa.binary()), batch.column(label).cast(pa.int32())], names=["bins", "label"])

    table = written(rows.select(*[F.col(f).cast("double").alias(f) for f in features], label).mapInArrow(binned, "bins binary, label int"))
    for _ in range(rounds):
        size = 2 ** (depth + 1) - 1
        trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(classes)]
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            sums = _sums(table, model, trees, level, classes, wide, width)
            for k, tree in enumerate(trees):
                for j in range(many):
                    g, h, n = sums[:, k, j]
                    node, total = first + j, h[0].sum() + ridge
                    if level == 0:
                        tree.value[node] = -g[0].sum() / total
                    f, cut, _ = best_split(g, h, n, least_rows, ridge) if n[0].sum() else (-1, 0, 0.0)
                    if f >= 0:
                        tree.feature[node], tree.cut[node] = f, cut
                        left = -g[f, : cut + 1].sum() / (h[f, : cut + 1].sum() + ridge)
                        right = -g[f, cut + 1 :].sum() / (h[f, cut + 1 :].sum() + ridge)
                        tree.value[2 * node + 1], tree.value[2 * node + 2] = left, right
        model.rounds.append(trees)
    forget(table)
    return model


def _sums(table: DataFrame, model: Boosted, trees: list[Tree], level: int, classes: int, wide: int, width: int) -> np.ndarray:
    """Gradients, hessians and rows by class, node of the level, feature and bin: what one pass brings to the driver."""
    first, many = 2**level - 1, 2**level
    shape = (3, classes, many, wide, width)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, wide)
            y = batch.column("label").to_numpy()
            p = _softmax(model.scores(bins))
            for k in range(classes):
                node = trees[k].nodes(bins, level) - first
                here = np.flatnonzero(node >= 0)
                cell = (node[here, None] * wide + np.arange(wide)) * width + bins[here]
                g, h = p[here, k] - (y[here] == k), p[here, k] * (1 - p[here, k])
                for i, w in enumerate((g, h, np.ones(len(here)))):
                    out[i, k] += np.bincount(cell.ravel(), np.repeat(w, wide), many * wide * width).reshape(shape[2:])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["key", "m"])

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"key": pa.array([0], pa.int32()), "m": pa.array([sum(np.frombuffer(m) for m in rows["m"].to_pylist()).tobytes()], pa.binary())})

    parts = table.mapInArrow(gather, "key int, m binary").withColumn("key", (F.spark_partition_id() % 16).cast("int"))
    added = parts.groupBy("key").applyInArrow(add, "key int, m binary").collect()  # at most 16 arrays of a size that rows do not change
    return sum((np.frombuffer(bytes(r["m"])).reshape(shape) for r in added), np.zeros(shape))


def predicted(rows: DataFrame, model: Boosted, keep: tuple[str, ...] = ("sample_id", "pos"), least: float = 1e-6) -> DataFrame:
    """keep and gp, the probabilities of the classes, held at `least` and made to sum to 1."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in model.features], 1)
            p = np.clip(_softmax(model.scores(model.bins(x))), least, 1)
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "gp"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", gp array<double>"
    return rows.select(*keep, *[F.col(f).cast("double").alias(f) for f in model.features]).mapInArrow(score, schema)
