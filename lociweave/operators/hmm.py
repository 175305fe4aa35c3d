"""Founder-mosaic HMM as Spark jobs: emissions and fragments as joins, recursions as grouped maps, EM as a loop of both."""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import forwardbackward as kernels
from lociweave.operators.evidence import centres
from lociweave.operators.posterior import clipped
from lociweave.operators.sites import recombination
from lociweave.sources import byteranges
from lociweave.sources.scratch import forget, never_broadcast, shared_folder, written

ERROR, FLOOR = 0.001, 1e-5


def _log_emission(q: Column, ref: Column, alt: Column, other: Column, error: float) -> Column:
    third = error / 3
    p_alt = clipped(q * (1 - error) + (1 - q) * third, FLOOR, 1.0)
    p_ref = clipped((1 - q) * (1 - error) + q * third, FLOOR, 1.0)
    return alt * F.log(p_alt) + ref * F.log(p_ref) + other * F.log(F.lit(max(third, FLOOR)))


def haploid_emissions(evidence: DataFrame, panel: DataFrame, error: float = ERROR) -> DataFrame:
    """(sample_id, pos, founder, log_emission) of covered cells: one join on the site."""
    e = _log_emission(F.col("alt_prob"), F.col("ref_weight"), F.col("alt_weight"), F.col("other_weight"), error)
    return evidence.join(panel, "pos").select("sample_id", "pos", "founder", e.alias("log_emission"))


def diploid_emissions(evidence: DataFrame, panel: DataFrame, error: float = ERROR) -> DataFrame:
    """(sample_id, pos, f1 <= f2, log_emission): the panel is paired with itself at each site before the samples are joined."""
    pairs = panel.select("pos", F.col("founder").alias("f1"), F.col("alt_prob").alias("q1")).join(
        panel.select("pos", F.col("founder").alias("f2"), F.col("alt_prob").alias("q2")), "pos"
    ).where("f1 <= f2").withColumn("q", (F.col("q1") + F.col("q2")) / 2)
    e = _log_emission(F.col("q"), F.col("ref_weight"), F.col("alt_weight"), F.col("other_weight"), error)
    return evidence.join(pairs, "pos").select("sample_id", "pos", "f1", "f2", e.alias("log_emission"))


def _run(df: DataFrame) -> list[str]:
    return ["run"] if "run" in df.columns else []


def _only(df: DataFrame) -> list[str]:
    return ["only_run"] if "only_run" in df.columns else []


def fragment_likelihoods(observations: DataFrame, panel: DataFrame, max_difference: float = 1000.0) -> DataFrame:
    """(sample_id, fragment, founder, log_likelihood, scaled): base-quality errors multiplied along a fragment, the best founder 1, floored.

    A panel with a column run gives that first. An observation is dealt out once, with all founders of its site.
    """
    sites = never_broadcast(panel.groupBy("pos").agg(F.collect_list(F.struct(*_run(panel), "founder", "alt_prob")).alias("p")))
    met = observations.select("sample_id", "fragment", "pos", "code", "qual").join(sites, "pos").repartition("sample_id", "fragment")
    rows = met.select("sample_id", "fragment", "code", "qual", F.inline("p"))
    err = F.pow(F.lit(10.0), -F.col("qual") / 10.0)
    q = F.col("alt_prob")
    p_alt = clipped(q * (1 - err) + (1 - q) * err / 3, FLOOR, 1.0)
    p_ref = clipped((1 - q) * (1 - err) + q * err / 3, FLOOR, 1.0)
    p = F.when(F.col("code") == 1, p_alt).when(F.col("code") == 0, p_ref).otherwise(clipped(err / 3, FLOOR, 1.0))
    name = [*_run(panel), "sample_id", "fragment"]
    out = rows.groupBy(*name, "founder").agg(F.sum(F.log(p)).alias("log_likelihood"))
    top = F.max("log_likelihood").over(Window.partitionBy(*name))
    scaled = F.exp(F.greatest(F.col("log_likelihood") - top, F.lit(-float(np.log(max_difference)))))
    return out.withColumn("scaled", scaled)


def coupled(emissions: DataFrame, likelihoods: DataFrame, centres: DataFrame, mode: str, max_emission_difference: float = 1e10) -> DataFrame:
    """Haploid emissions with whole fragments counted at their centres: `replace` or `augment` the cells they touch.

    emissions: sample_id, pos, founder, log_emission; likelihoods from `fragment_likelihoods`; centres: sample_id, fragment, center.
    """
    if mode not in ("replace", "augment"):
        raise ValueError(f"unknown coupling mode {mode!r}: replace or augment")
    whole = _at_centres(likelihoods, centres)
    cells = emissions.groupBy("sample_id", "pos").agg(F.collect_list(F.struct("founder", "log_emission")).alias("l"))
    return _touched(cells.join(whole, ["sample_id", "pos"], "left"), F.col("l"), mode, max_emission_difference)


def coupled_evidence(evidence: DataFrame, panel: DataFrame, likelihoods: DataFrame, centres: DataFrame, mode: str, error: float = ERROR, max_emission_difference: float = 1e10) -> DataFrame:
    """`coupled` of `haploid_emissions`: a cell is dealt out as one row, with the founders of its site, and meets its fragments there."""
    if mode not in ("replace", "augment"):
        raise ValueError(f"unknown coupling mode {mode!r}: replace or augment")
    sites = never_broadcast(panel.groupBy("pos").agg(F.collect_list(F.struct("founder", "alt_prob")).alias("p")))
    cells = evidence.select("sample_id", "pos", "ref_weight", "alt_weight", "other_weight").join(sites, "pos")
    rows = cells.join(_at_centres(likelihoods, centres), ["sample_id", "pos"], "left")
    weights = F.col("ref_weight"), F.col("alt_weight"), F.col("other_weight")
    own = F.transform("p", lambda x: F.struct(x["founder"].alias("founder"), _log_emission(x["alt_prob"], *weights, error).alias("log_emission")))
    return _touched(rows, own, mode, max_emission_difference)


def _at_centres(likelihoods: DataFrame, centres: DataFrame) -> DataFrame:
    """(sample_id, pos, w): the summed logarithms of the fragments at their centres, by founder. Fragments are dealt out as one row each."""
    each = likelihoods.groupBy("sample_id", "fragment").agg(F.collect_list(F.struct("founder", F.log("scaled").alias("x"))).alias("s"))
    at = each.join(never_broadcast(centres.select("sample_id", "fragment", "center")), ["sample_id", "fragment"])
    at = at.select("sample_id", F.col("center").alias("pos"), "s").repartition("sample_id", "pos").select("sample_id", "pos", F.inline("s"))
    sums = at.groupBy("sample_id", "pos", "founder").agg(F.sum("x").alias("x"))
    return never_broadcast(sums.groupBy("sample_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("founder", "x"))).alias("w")))


def _touched(rows: DataFrame, own: Column, mode: str, most: float) -> DataFrame:
    """(sample_id, pos, founder, log_emission) of cells with w, what fragments say by founder, or null; own: an array of founder, log_emission."""
    def value(x: Column) -> Column:
        told = F.try_element_at("w", x["founder"])
        return F.coalesce(told, x["log_emission"]) if mode == "replace" else x["log_emission"] + F.coalesce(told, F.lit(0.0))

    values = F.transform(own, lambda x: F.struct(x["founder"].alias("founder"), value(x).alias("v")))
    rows = rows.select("sample_id", "pos", values.alias("values"))
    rows = rows.select("sample_id", "pos", F.array_max(F.col("values.v")).alias("top"), F.inline("values"))
    return rows.select("sample_id", "pos", "founder", F.greatest(F.col("v") - F.col("top"), F.lit(-float(np.log(most)))).alias("log_emission"))


#: Sites of a block, and bytes of one array of state distributions in a task: so many samples are scanned together.
CORE, ARRAY_BYTES, MOST_TOGETHER = 4096, 48 << 20, 64
#: Messages between blocks are final once a round changes none of them by more than this.
SETTLED = 1e-9
#: What a row on the samples' side of a group is.
_SAMPLE, _READS, _FRAGMENT, _AHEAD, _BEHIND = range(5)
_KEYS = ["chrom", "block", "part"]
_COUNTS = ("ref_count", "alt_count", "other_count")


def fragment_arrays(fragments: DataFrame, panel: DataFrame) -> DataFrame:
    """(sample_id, pos, p array by founder, and run if the panel has one) of every fragment at its centre. fragments: one observation for each position, see `compressed`."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("founder", "scaled"))), lambda x: x["scaled"])
    arrays = fragment_likelihoods(fragments, panel).groupBy(*_run(panel), "sample_id", "fragment").agg(p.alias("p"))
    at = centres(fragments).select("sample_id", "fragment", F.col("center").alias("pos"))
    return arrays.join(at, ["sample_id", "fragment"]).select(*_run(panel), "sample_id", "pos", "p")


class Grid(NamedTuple):
    """Reads and sites dealt out to groups, which scans with other founders at the same sites may share: see `laid_out`.

    Where a chromosome has several blocks, `own` are left's rows of samples alone, `files` is the folder of its reads, a file for each group
    (see `_packed`), and `tasks` how many tasks scan the groups.
    """

    left: DataFrame
    sites: DataFrame
    runs: list[int]
    blocks: int
    parts: int
    own: DataFrame | None = None
    files: str | None = None
    tasks: int = 1


class _Dealt(NamedTuple):
    """The two sides of a scan: rows of both, or with `sites` set only small rows on the left; then folders have its other rows and `sites` the right side."""

    left: DataFrame
    right: DataFrame | None
    folders: tuple[str, ...] = ()
    sites: str | None = None
    tasks: int = 1

    def mapped(self, scan, schema: str) -> DataFrame:
        """scan(left, right) of every group. What a task makes is many times what Spark sees it read, so no join may broadcast it."""
        if self.sites is None:
            return never_broadcast(self.left.groupBy(*_KEYS).cogroup(self.right.groupBy(*_KEYS)).applyInArrow(scan, schema))
        folders, sites = self.folders, self.sites

        def read(left: pa.Table) -> pa.Table:
            chrom, block, part = (left[c][0].as_py() for c in _KEYS)
            more = [x for x in (_unpacked(f, chrom, block, part) for f in folders) if x is not None]
            right = _unpacked(sites, chrom, block)
            left = pa.concat_tables([left, *more], promote_options="default")
            return scan(left, right.append_column("part", _column(part, len(right), pa.int32())))

        # a number that adaptive execution keeps: groups are few bytes and much work
        return never_broadcast(self.left.repartition(self.tasks, *_KEYS).groupBy(*_KEYS).applyInArrow(read, schema))


def _number(*key) -> int:
    """A group's number: a digest, as chromosomes have names."""
    return int(hashlib.sha256("/".join(map(str, reversed(key))).encode()).hexdigest(), 16)


def _packed(df: DataFrame, keys: list[str]) -> str:
    """Rows by group, each in a file of its own in a new shared folder, which is the result: rounds read them there and shuffle them no more."""
    folder = f"{shared_folder(df.sparkSession)}/groups-{uuid.uuid4().hex}"

    def store(rows: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        named = _number(*[rows[c][0].as_py() for c in keys])
        rows = rows if "part" not in keys else rows.drop_columns(keys)
        with pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(rows)
        return pa.table({"n": pa.array([byteranges.put(folder, named, out.getvalue())], pa.int64())})

    df.groupBy(*keys).applyInArrow(store, "n long").agg(F.sum("n")).collect()
    return folder


def _unpacked(folder: str, *key) -> pa.Table | None:
    """A group's rows, or None where it has none."""
    raw = byteranges.range_bytes(folder, _number(*key))
    return None if raw is None else pa.ipc.open_file(pa.BufferReader(raw)).read_all()


_ROW = {"generation": "double", "pos": "long", "ref_weight": "double", "alt_weight": "double", "other_weight": "double", "p": "array<double>"}


def _own(parts: int) -> Column:
    return F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int").alias("part")


def _rows(df: DataFrame, kind: int, parts: int, *has: str) -> DataFrame:
    """Rows of the samples' side. A null run stands for all of them."""
    names = _ROW | dict.fromkeys(_COUNTS, "int")
    rest = [F.col(n).cast(t).alias(n) if n in has else F.lit(None).cast(t).alias(n) for n, t in names.items()]
    run = F.col("run").cast("int") if "run" in df.columns else F.lit(None).cast("int")
    return df.select(run.alias("run"), "chrom", "block", _own(parts), "sample_id", F.lit(kind).alias("kind"), *rest)


def laid_out(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 2, core: int = CORE, counts: bool = False) -> Grid:
    """Rows of samples and reads, and the sites, by chrom, block and part.

    A chromosome is cut into blocks of `core` sites and samples into parts, so a group's size does not depend on the corpus. evidence
    and panel may each have a column run: then all runs are scanned in one job, and what they have in common is laid out once. `counts` takes in the
    numbers of reads beside their weights. Later scans may use the same grid with panels of the same runs, sites and founders. positions may
    have a column only_run, see `posteriors`.
    """
    runs = sorted({r[0] for df in (evidence, panel) if "run" in df.columns for r in df.select("run").distinct().collect()}) or [0]  # a handful
    founders = panel.select("founder").distinct().count()
    states = int(np.prod(kernels.state_shape(founders, ploidy))) if founders else 1
    together = max(1, min(MOST_TOGETHER, ARRAY_BYTES // (8 * core * states)))
    n_samples, longest = samples.count(), positions.groupBy("chrom").count().agg(F.max("count")).first()[0] or 0
    parts, blocks = max(1, -(-n_samples // together)), max(1, -(-longest // core))
    named = panel.select(*_run(panel), "pos").distinct()
    if "run" in named.columns and named.groupBy("pos").count().where(F.col("count") < named.select("run").distinct().count()).isEmpty():
        named = named.select("pos").distinct()  # all runs have the same sites
    chrom = Window.partitionBy(*_run(named), "chrom")
    at = F.floor((F.row_number().over(chrom.orderBy("pos")) - 1) / core).cast("int")
    rates = recombination(positions).join(never_broadcast(named), "pos")
    sites = rates.select(*_run(named), "chrom", "pos", "rate", at.alias("block"), F.count(F.lit(1)).over(chrom).alias("n"), *_only(positions))
    if blocks > 1:
        sites = written(sites)  # every round of messages reads it
    groups = sites.select("chrom", "block").distinct()
    # every sample gets a result at every site, so one row for each of its blocks is little beside that
    own = _rows(samples.withColumn("_", F.lit(1)).join(groups.withColumn("_", F.lit(1)), "_"), _SAMPLE, parts, "generation")
    seen = evidence.join(samples.select("sample_id"), "sample_id").join(_places(evidence, sites), _on(evidence, sites))
    has = ("pos", "ref_weight", "alt_weight", "other_weight", *(_COUNTS if counts else ()))
    reads = _rows(seen, _READS, parts, *has)
    grid = Grid(own.unionByName(reads), sites, runs, blocks, parts)
    if blocks == 1:
        return grid
    tasks = min(groups.count() * parts, int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return grid._replace(own=written(own), files=_packed(reads.select("run", *_KEYS, "sample_id", "kind", *has), _KEYS), tasks=max(1, tasks))


def _on(df: DataFrame, sites: DataFrame) -> list[str]:
    return [c for c in ("run", "pos") if c in df.columns and c in sites.columns]


def _places(df: DataFrame, sites: DataFrame) -> DataFrame:
    return never_broadcast(sites.select(*_run(sites), "chrom", "block", "pos"))


def _sides(grid: Grid, samples: DataFrame, panel: DataFrame, fragments: DataFrame | None) -> _Dealt:
    """The grid's rows with those of fragments, and rows of sites with founders."""
    whole = None
    if fragments is not None:
        whole = fragments.join(samples.select("sample_id"), "sample_id").join(_places(fragments, grid.sites), _on(fragments, grid.sites))
        whole = _rows(whole, _FRAGMENT, grid.parts, "pos", "p")
    by_site = panel.groupBy(*_run(panel), "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("founder", "alt_prob"))), lambda x: x["alt_prob"]).alias("q")
    )
    right = never_broadcast(grid.sites).join(by_site, _on(by_site, grid.sites))
    if "run" not in right.columns:
        right = right.withColumn("run", F.lit(None).cast("int"))
    names = ["chrom", "block", "pos", "rate", "q", "n", *_only(grid.sites)]
    if grid.blocks > 1:
        right = right.select(F.col("run").cast("int").alias("run"), *names)
        folders = [grid.files] + ([] if whole is None else [_packed(whole.select("run", *_KEYS, "sample_id", "kind", "pos", "p"), _KEYS)])
        return _Dealt(grid.own, None, tuple(folders), _packed(right, ["chrom", "block"]), grid.tasks)
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(grid.parts - 1))))
    # columns of their own: both sides come from the same sites
    right = right.select(*[F.col(c).alias(c) for c in ("run", "part", *names)])
    return _Dealt(grid.left if whole is None else grid.left.unionByName(whole), right)


def _groups(left: pa.Table, right: pa.Table, runs: list[int], ploidy: int):
    """The arrays of each run that has sites in this group."""
    if not len(left):
        return
    for run in runs:
        mine = [t.filter(pc.fill_null(pc.equal(t["run"], run), True)) for t in (left, right)]
        if len(mine[1]):
            yield _Group(*mine, run, ploidy)


class _Group:
    """One part of the samples on one block, as arrays: ids; pos; w, 3 by sites by samples; q; switch; messages from both sides."""

    def __init__(self, left: pa.Table, right: pa.Table, run: int, ploidy: int):
        right = right.take(pa.array(np.argsort(right["pos"].to_numpy(), kind="stable")))
        self.keys = {"run": run} | {name: right[name][0].as_py() for name in _KEYS}
        self.pos, self.n = right["pos"].to_numpy(), right["n"][0].as_py()
        self.only = right["only_run"].to_numpy(zero_copy_only=False) if "only_run" in right.column_names else None
        self.q = np.asarray(right["q"].combine_chunks().flatten(), float).reshape(len(self.pos), -1)
        kind, all_ids = left["kind"].to_numpy(), left["sample_id"].to_numpy()
        self.ids, pick = np.unique(all_ids[kind == _SAMPLE], return_index=True)
        generation = left["generation"].to_numpy(zero_copy_only=False)[kind == _SAMPLE][pick]
        self.switch = np.clip(1 - np.exp(-generation[None] * right["rate"].to_numpy()[:, None]), 1e-10, 1 - 1e-10)
        reads = kind == _READS
        self.w = np.zeros((3, len(self.pos), len(self.ids)))
        self._left, self._kind, self._ids = left, kind, all_ids
        self.covered = where = self._site(left, reads), np.searchsorted(self.ids, all_ids[reads])
        for i, name in enumerate(("ref_weight", "alt_weight", "other_weight")):
            self.w[i][where] = left[name].to_numpy(zero_copy_only=False)[reads]
        self.ahead, self.behind = self._message(_AHEAD), self._message(_BEHIND)

    def counts(self) -> list[np.ndarray]:
        """Numbers of reads of the `covered` cells: reference, alternative, other."""
        return [self._left[name].to_numpy(zero_copy_only=False)[self._kind == _READS] for name in _COUNTS]

    def _site(self, left: pa.Table, which: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pos, left["pos"].to_numpy(zero_copy_only=False)[which])

    def _arrays(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        which = np.flatnonzero(self._kind == kind)
        return which, np.asarray(self._left["p"].take(pa.array(which)).combine_chunks().flatten(), float).reshape(len(which), -1 if len(which) else 0)

    def _message(self, kind: int) -> np.ndarray | None:
        which, p = self._arrays(kind)
        if not len(which):
            return None
        return p[np.argsort(self._ids[which])].reshape(len(self.ids), -1)

    def whole(self, ploidy: int, mode: str):
        """What `site_emissions` asks for to take in fragments, or None."""
        which, p = self._arrays(_FRAGMENT)
        if not len(which):
            return None
        site, sample = self._site(self._left, self._kind == _FRAGMENT), np.searchsorted(self.ids, self._ids[which])
        return lambda log: kernels.with_fragments(log, site, sample, p, ploidy, mode)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[-1], dtype=np.int32)), flat)


def _column(value, n: int, kind: pa.DataType) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def _nothing(schema: str) -> pa.Table:
    """No rows of a schema in Spark's words."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.table({name: pa.nulls(0, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


_SENT = "run int, chrom string, block int, part int, sample_id long, kind int, p array<double>"


def _with_messages(dealt: _Dealt, runs: list[int], blocks: int, ploidy: int, error: float, core: int, shape: np.ndarray | None, mode: str) -> _Dealt:
    """The sides with what neighbouring blocks tell each block: forward distributions from before it and backward ones from after it.

    Every round scans all blocks with the messages of the round before. A message is exact once it has come from the chromosome's end, so
    blocks - 1 rounds are enough; they end sooner where what lies far away no longer matters, which is after two or three
    unless reads are few and sites close. What is held, shuffled and written is one distribution for each sample and border.
    """
    if blocks == 1:
        return dealt

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        sent = []
        for g in _groups(left, right, runs, ploidy):
            block, last = g.keys["block"], (g.n - 1) // core
            moves = kernels.moves_of(g.q.shape[1], ploidy, shape)
            emission = kernels.state_emissions(g.w[1], g.w[0], g.w[2], g.q, ploidy, error, block == 0, g.whole(ploidy, mode), isinstance(moves, kernels.Pairs))
            onward, backward = kernels.boundary(emission, g.switch, moves, g.ahead, g.behind)
            n = len(g.ids)
            for kind, to, message in ((_AHEAD, block + 1, onward), (_BEHIND, block - 1, backward)):
                if 0 <= to <= last:
                    fixed = [_column(g.keys["run"], n, pa.int32()), _column(g.keys["chrom"], n, pa.string()), _column(to, n, pa.int32()), _column(g.keys["part"], n, pa.int32())]
                    sent.append(pa.table([*fixed, pa.array(g.ids), _column(kind, n, pa.int32()), _lists(message.reshape(n, -1))], names=_SENT_NAMES))
        return pa.concat_tables(sent) if sent else _nothing(_SENT)

    messages = None
    for k in range(blocks - 1):
        given = dealt if messages is None else dealt._replace(left=dealt.left.unionByName(messages, allowMissingColumns=True))
        after = written(given.mapped(scan, _SENT))
        if messages is not None:
            names = ["run", "chrom", "block", "part", "sample_id", "kind"]
            gap = F.aggregate(F.zip_with("p", "was", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: F.greatest(x, y))
            change = after.join(messages.withColumnRenamed("p", "was"), names).agg(F.max(gap)).first()[0] or 0.0
            forget(messages)
        messages = after
        if k and change <= SETTLED:
            break
    return dealt._replace(left=dealt.left.unionByName(messages, allowMissingColumns=True))


_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _scanned(make, schema: str, evidence, positions, samples, panel, ploidy=2, error=ERROR, core=CORE, shape=None, fragments=None, mode="replace", grid=None, counts=False) -> DataFrame:
    """What make(group, founder shares, genotype probabilities) returns for every group, as one table of `schema`."""
    if mode not in ("replace", "augment"):
        raise ValueError(f"unknown coupling mode {mode!r}: replace or augment")
    grid = grid or laid_out(evidence, positions, samples, panel, ploidy, core, counts)
    dealt = _sides(grid, samples, panel, None if fragments is None else fragment_arrays(fragments, panel))
    dealt, runs = _with_messages(dealt, grid.runs, grid.blocks, ploidy, error, core, shape, mode), grid.runs

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for g in _groups(left, right, runs, ploidy):
            whole = g.whole(ploidy, mode)
            made.append(make(g, *kernels.posteriors(g.w[1], g.w[0], g.w[2], g.q, g.switch, ploidy, error, shape, g.keys["block"] == 0, g.ahead, g.behind, whole)))
        return pa.concat_tables(made) if made else _nothing(schema)

    return dealt.mapped(scan, schema)


def posteriors(
    evidence: DataFrame,
    positions: DataFrame,
    samples: DataFrame,
    panel: DataFrame,
    ploidy: int = 2,
    error: float = ERROR,
    core: int = CORE,
    shape: np.ndarray | None = None,
    fragments: DataFrame | None = None,
    mode: str = "replace",
    wanted: tuple[str, ...] = ("hap", "gp", "dosage"),
    grid: Grid | None = None,
) -> DataFrame:
    """(sample_id, chrom, pos, hap array, gp array, dosage) at every site of every sample; with run first where evidence or panel has one.

    Blocks of sites and parts of samples are scanned in tasks of their own, all samples of a part at once; blocks tell their
    neighbours what they know until nothing changes, so the result does not depend on `core`. Sites without reads take part with even
    emissions. `shape` is a founder transition shape, of founders squared numbers. `fragments` (sample_id, fragment, pos, code, qual, one
    observation for each position) count as a whole at their centres: instead of the cells they touch (`replace`) or with them (`augment`).
    Only the `wanted` of the last three columns leave the tasks, and where positions have a column only_run, a site's rows of that run only.
    """
    kinds = {"hap": "array<double>", "gp": "array<double>", "dosage": "double"}

    def make(g: _Group, hap: np.ndarray, gp: np.ndarray) -> pa.Table:
        pos = g.pos
        if g.only is not None:
            own = g.only == g.keys["run"]
            pos, hap, gp = pos[own], hap[own], gp[own]
        n = len(pos) * len(g.ids)
        values = {"hap": lambda: _lists(hap), "gp": lambda: _lists(gp), "dosage": lambda: pa.array((gp @ np.arange(ploidy + 1)).reshape(-1))}
        columns = [_column(g.keys["run"], n, pa.int32()), pa.array(np.tile(g.ids, len(pos))), _column(g.keys["chrom"], n, pa.string()), pa.array(np.repeat(pos, len(g.ids)))]
        return pa.table([*columns, *[values[w]() for w in wanted]], names=["run", "sample_id", "chrom", "pos", *wanted])

    schema = ", ".join(["run int, sample_id long, chrom string, pos long", *[f"{w} {kinds[w]}" for w in wanted]])
    out = _scanned(make, schema, evidence, positions, samples, panel, ploidy, error, core, shape, fragments, mode, grid)
    return out if "run" in evidence.columns or "run" in panel.columns else out.drop("run")


def scanned_founder_statistics(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 2, **how) -> DataFrame:
    """What `m_step` makes of posteriors and `alt_fractions`, summed where a block is scanned, so no cell leaves a task."""

    def make(g: _Group, hap: np.ndarray, gp: np.ndarray) -> pa.Table:
        weight = np.zeros((2, len(g.pos), len(g.ids)))
        weight[0][g.covered] = (g.w[1][g.covered] + 0.5) / (g.w[0][g.covered] + g.w[1][g.covered] + 1)
        weight[1][g.covered] = 1
        seen = np.flatnonzero(weight[1].any(1))
        numerator, denominator = ((w[:, None] @ hap)[:, 0][seen].reshape(-1) for w in weight)
        n, k = len(numerator), hap.shape[2]
        columns = [_column(g.keys["run"], n, pa.int32()), pa.array(np.repeat(g.pos[seen], k)), pa.array(np.tile(np.arange(k, dtype=np.int64), len(seen)))]
        return pa.table([*columns, pa.array(numerator), pa.array(denominator)], names=["run", "pos", "founder", "numerator", "denominator"])

    out = _scanned(make, "run int, pos long, founder long, numerator double, denominator double", evidence, positions, samples, panel, ploidy, **how)
    keys = ["run", "pos", "founder"] if "run" in evidence.columns or "run" in panel.columns else ["pos", "founder"]
    return out.groupBy(*keys).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))


def scanned_read_log_likelihoods(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 2, read_error: float = 0.01, floor: float = 1e-6, **how) -> DataFrame:
    """What `founders.read_log_likelihoods` makes of posteriors, summed where a block is scanned. A grid needs counts."""

    def make(g: _Group, hap: np.ndarray, gp: np.ndarray) -> pa.Table:
        alt = np.clip((gp @ np.arange(ploidy + 1))[g.covered] / max(ploidy, 1), floor, 1 - floor)
        ref_count, alt_count, other_count = g.counts()
        each = ref_count * np.log(np.clip((1 - alt) * (1 - read_error) + alt * (read_error / 3), floor, 1))
        each += alt_count * np.log(np.clip(alt * (1 - read_error) + (1 - alt) * (read_error / 3), floor, 1)) + other_count * np.log(max(read_error / 3, floor))
        some = np.unique(g.covered[1])
        total = np.bincount(g.covered[1], each, len(g.ids))[some]
        return pa.table([_column(g.keys["run"], len(some), pa.int32()), pa.array(g.ids[some]), pa.array(total)], names=["run", "sample_id", "x"])

    out = _scanned(make, "run int, sample_id long, x double", evidence, positions, samples, panel, ploidy, counts=True, **how)
    keys = ["run", "sample_id"] if "run" in evidence.columns or "run" in panel.columns else ["sample_id"]
    return out.groupBy(*keys).agg(F.sum("x").alias("read_log_likelihood"))


def scanned_pair_counts(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 1, **how) -> DataFrame:
    """What `pair_counts` makes of posteriors (without runs), summed where a block is scanned; blocks tell the shares at their ends to a join."""
    schema = "run int, chrom string, block int, sample_id long, is_end int, hap array<double>"

    def make(g: _Group, hap: np.ndarray, gp: np.ndarray) -> pa.Table:
        sums = np.einsum("nsi,nsj->ij", hap[:-1], hap[1:], optimize=True)
        ends = [(0, hap[0]), (1, hap[-1])]
        rows = [(g.keys["block"], g.ids, at, h) for at, h in ends] + [(-1, np.array([-1]), -1, sums.reshape(1, -1))]
        return pa.concat_tables(
            pa.table([_column(g.keys["run"], len(i), pa.int32()), _column(g.keys["chrom"], len(i), pa.string()), _column(b, len(i), pa.int32()), pa.array(i), _column(at, len(i), pa.int32()), _lists(h)], names=[x.split()[0] for x in schema.split(", ")])
            for b, i, at, h in rows
        )

    out = written(_scanned(make, schema, evidence, positions, samples, panel, ploidy, **how))
    k = F.sqrt(F.size("hap")).cast("int")
    inner = out.where("is_end = -1").select(k.alias("k"), F.posexplode("hap").alias("at", "n"))
    inner = inner.select(F.floor(F.col("at") / F.col("k")).cast("int").alias("i"), (F.col("at") % F.col("k")).alias("j"), "n")
    after = out.where("is_end = 0").select("chrom", (F.col("block") - 1).alias("block"), "sample_id", F.col("hap").alias("after"))
    across = out.where("is_end = 1").join(after, ["chrom", "block", "sample_id"]).select(F.posexplode("hap").alias("i", "x"), "after")
    across = across.select("i", "x", F.posexplode("after").alias("j", "y")).select("i", "j", (F.col("x") * F.col("y")).alias("n"))
    return inner.unionByName(across).groupBy("i", "j").agg(F.sum("n").alias("n"))


def scanned_switches(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, ploidy: int = 2, edge: float = 1e-6, **how) -> DataFrame:
    """What `ratetraining.interval_switches` makes of posteriors (without runs): all but the medians where a block is scanned; a join has the shares at blocks' ends."""
    schema = "chrom string, block int, pos long, sample_id long, is_end int, p array<double>"

    def make(g: _Group, hap: np.ndarray, gp: np.ndarray) -> pa.Table:
        inner = np.clip(1 - (hap[1:] * hap[:-1]).sum(2), edge, 1 - edge)
        rows = [(g.pos[1:], np.full(len(inner), -1), -1, inner)] + [(np.full(len(g.ids), g.pos[at]), g.ids, k, hap[at]) for k, at in ((0, 0), (1, -1))]
        return pa.concat_tables(
            pa.table([_column(g.keys["chrom"], len(p), pa.string()), _column(g.keys["block"], len(p), pa.int32()), pa.array(pos), pa.array(i), _column(at, len(p), pa.int32()), _lists(p)], names=[x.split()[0] for x in schema.split(", ")])
            for pos, i, at, p in rows
        )

    out = written(_scanned(make, schema, evidence, positions, samples, panel, ploidy, **how))
    inner = out.where("is_end = -1").select("chrom", "pos", "p")
    before = never_broadcast(out.where("is_end = 1").select("chrom", (F.col("block") + 1).alias("block"), "sample_id", F.col("p").alias("before")))
    same = F.aggregate(F.zip_with("p", "before", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    across = out.where("is_end = 0").join(before, ["chrom", "block", "sample_id"]).select("chrom", "pos", F.array(clipped(1 - same, edge, 1 - edge)).alias("p"))
    # a number for each sample
    each = inner.unionByName(across).groupBy("chrom", "pos").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    n = F.size("p")
    middle = (F.get("p", F.floor((n - 1) / 2).cast("int")) + F.get("p", F.floor(n / 2).cast("int"))) / 2
    return each.select("chrom", "pos", middle.alias("switch"))


def haploid_pair_posteriors(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame, error: float = ERROR, core: int = CORE) -> DataFrame:
    """(chrom, pos, i, j, n): summed posteriors that a haploid sample has founder i at the site before pos and j at pos.

    Sums over a part's samples leave a task, so what is shuffled does not grow with the samples of a part.
    """
    grid = laid_out(evidence, positions, samples, panel, 1, core)
    dealt, runs = _with_messages(_sides(grid, samples, panel, None), grid.runs, grid.blocks, 1, error, core, None, "replace"), grid.runs

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for g in _groups(left, right, runs, 1):
            xi = kernels.haploid_xi(kernels.site_emissions(g.w[1], g.w[0], g.w[2], g.q, error), g.switch, g.ahead, g.behind).sum(1)
            pos, k = g.pos[len(g.pos) - len(xi) :], g.q.shape[1]
            pairs = np.arange(k, dtype=np.int32)
            columns = [
                _column(g.keys["chrom"], len(pos) * k * k, pa.string()), pa.array(np.repeat(pos, k * k)),
                pa.array(np.tile(np.repeat(pairs, k), len(pos))), pa.array(np.tile(pairs, k * len(pos))), pa.array(xi.reshape(-1)),
            ]
            made.append(pa.table(columns, names=["chrom", "pos", "i", "j", "n"]))
        return pa.concat_tables(made) if made else _nothing("chrom string, pos long, i int, j int, n double")

    out = dealt.mapped(scan, "chrom string, pos long, i int, j int, n double")
    return out.groupBy("chrom", "pos", "i", "j").agg(F.sum("n").alias("n"))


def by_ploidy(evidence: DataFrame, positions: DataFrame, samples: DataFrame, panel: DataFrame) -> DataFrame:
    """Posteriors of samples with a `ploidy` column: one job per ploidy, united; ploidy 0 or less gives no rows."""
    out = None
    for row in samples.select("ploidy").distinct().where("ploidy > 0").orderBy("ploidy").collect():  # a handful of values
        some = samples.where(F.col("ploidy") == row["ploidy"])
        part = posteriors(evidence, positions, some, panel, row["ploidy"]).withColumn("ploidy", F.lit(row["ploidy"]))
        out = part if out is None else out.unionByName(part)
    return out


def m_step(haps: DataFrame, fractions: DataFrame) -> DataFrame:
    """(pos, founder, numerator, denominator): alternative fractions weighted by founder shares, by run if haps has one.

    haps: sample_id, pos, hap; fractions: sample_id, pos, fraction.
    """
    rows = haps.join(fractions, ["sample_id", "pos"]).select(*_run(haps), "pos", "fraction", F.posexplode("hap").alias("founder", "share"))
    return rows.groupBy(*_run(haps), "pos", F.col("founder").cast("long").alias("founder")).agg(
        F.sum(F.col("share") * F.col("fraction")).alias("numerator"), F.sum("share").alias("denominator")
    )


def alt_fractions(evidence: DataFrame) -> DataFrame:
    """(alt + 0.5) / (ref + alt + 1) of each covered cell, by quality weights."""
    return evidence.select("sample_id", "pos", ((F.col("alt_weight") + 0.5) / (F.col("ref_weight") + F.col("alt_weight") + 1)).alias("fraction"))


def updated_founders(panel: DataFrame, statistics: DataFrame, damping: float = 0.5) -> DataFrame:
    """Mutable founders moved towards numerator / denominator and held in [1e-4, 1 - 1e-4]; panel has immutable, and may have run.

    `damping` is the part of the old value that stays.
    """
    rows = panel.join(never_broadcast(statistics), [*_run(panel), "pos", "founder"], "left")
    new = F.when(F.col("denominator") > 1e-8, F.col("numerator") / F.col("denominator")).otherwise(F.col("alt_prob"))
    moved = clipped(damping * F.col("alt_prob") + (1 - damping) * new, 1e-4, 1 - 1e-4)
    return rows.select(*_run(panel), "pos", "founder", F.when(F.col("immutable") == 1, F.col("alt_prob")).otherwise(moved).alias("alt_prob"), "immutable")


def hardened(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """Mutable founders at 0.98 or 0.02: the n_alt of a site with the largest proposed + 0.05 * current, the highest index on ties.

    n_alt is the rounded mean times the number of mutable founders, kept off the ends where the site varies; a site with fewer
    than two mutable founders stays as proposed.
    """
    keys = [*_run(proposed), "pos", "founder"]
    rows = proposed.join(never_broadcast(current.select(*keys, F.col("alt_prob").alias("before"))), keys)
    mutable = F.col("immutable") == 0
    site = Window.partitionBy(*_run(proposed), "pos", "immutable")
    n, mean = F.count(F.lit(1)).over(site), clipped(F.avg("alt_prob").over(site), 0.0, 1.0)
    top = F.rint(mean * n)
    varies = (mean > 0.5 / n) & (mean < 1 - 0.5 / n)
    n_alt = F.when(varies, F.least(n - 1, F.greatest(F.lit(1), top))).otherwise(F.least(n, F.greatest(F.lit(0), top)))
    rank = F.row_number().over(site.orderBy(F.desc(F.round(F.col("alt_prob") + 0.05 * F.col("before"), 9)), F.desc("founder")))
    rows = rows.withColumn("n", n).withColumn("n_alt", n_alt).withColumn("rank", rank)
    value = F.when(~mutable | (F.col("n") < 2), F.col("alt_prob")).when(F.col("rank") <= F.col("n_alt"), 0.98).otherwise(0.02)
    return rows.select(*keys, value.alias("alt_prob"), "immutable")


def pair_counts(haps: DataFrame) -> DataFrame:
    """(i, j, n): summed products of neighbouring sites' founder shares. haps: sample_id, chrom, pos, hap."""
    order = Window.partitionBy("sample_id", "chrom").orderBy("pos")
    rows = haps.select("sample_id", F.lag("hap").over(order).alias("before"), "hap").where("before is not null")
    rows = rows.select(F.posexplode("before").alias("i", "x"), "hap").select("i", "x", F.posexplode("hap").alias("j", "y"))
    return rows.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


def factorised_transitions(counts: DataFrame, k: int, rank: int = 2, regularise: float = 1.0, most: float = 2.0) -> np.ndarray:
    """Row-stochastic k by k transition shape from pair counts: regularised, held, centred in logs, cut to `rank` by SVD, softmaxed.

    counts has k * k rows whatever the data, which is all that reaches the driver.
    """
    n = np.zeros((k, k))
    for row in counts.collect():
        n[row["i"], row["j"]] = row["n"]
    n = n + regularise / k
    p = n / n.sum(1, keepdims=True)
    log = np.clip(np.log(p * k), -most, most)
    log -= log.mean(1, keepdims=True)
    u, s, v = np.linalg.svd(log)
    low = (u[:, :rank] * s[:rank]) @ v[:rank]
    e = np.exp(low - low.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
