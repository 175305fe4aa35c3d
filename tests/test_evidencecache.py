"""The evidence cache: partial hits, wider blocks, newer commits, other settings, torn writes."""

from lociweave.operators import evidencecache as cache

SCHEMA = "sample_id long, pos long, depth long"
SITES = "chrom string, block long, pos long, ref string, alt string"
A = [("1", 0, 1, "A", "G"), ("1", 0, 2, "A", "C"), ("1", 1, 9, "T", "G")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def people(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "sample_id long")


def evidence(spark, *cells):
    return spark.createDataFrame(list(cells), f"chrom string, block long, {SCHEMA}")


def test_hits_and_misses(spark, tmp_path):
    folder, sites = str(tmp_path / "cache"), spark.createDataFrame(A, SITES)
    got, missing = cache.lookup(spark, folder, sites, people(spark, 1, 2), {"q": 5}, SCHEMA)
    assert rows(got) == [] and rows(missing) == [("1", b, s) for b in (0, 1) for s in (1, 2)]
    cache.store(evidence(spark, ("1", 0, 1, 1, 7), ("1", 0, 1, 2, 8), ("1", 1, 2, 9, 5)), sites, people(spark, 1, 2), folder, {"q": 5, "m": 1})
    ask = {"m": 1, "q": 5}
    got, missing = cache.lookup(spark, folder, sites, people(spark, 1, 2, 3), ask, SCHEMA)
    assert rows(got) == [("1", 0, 1, 1, 7), ("1", 0, 1, 2, 8), ("1", 1, 2, 9, 5)]
    assert rows(missing) == [("1", 0, 3), ("1", 1, 3)]
    # fewer sites are answered by the wider block, other alleles and other settings are not
    got, missing = cache.lookup(spark, folder, sites.where("pos = 2"), people(spark, 1), ask, SCHEMA)
    assert rows(got) == [("1", 0, 1, 2, 8)] and rows(missing) == []
    other = spark.createDataFrame([("1", 0, 1, "A", "T"), ("1", 1, 9, "T", "G")], SITES)
    got, missing = cache.lookup(spark, folder, other, people(spark, 1, 2), ask, SCHEMA)
    assert rows(got) == [("1", 1, 2, 9, 5)] and rows(missing) == [("1", 0, 1), ("1", 0, 2)]
    assert rows(cache.lookup(spark, folder, sites, people(spark, 1), {"q": 6, "m": 1}, SCHEMA)[0]) == []
    # a newer commit stands before an older one, for its samples alone
    cache.store(evidence(spark, ("1", 0, 1, 1, 70)), sites, people(spark, 1), folder, ask)
    got, missing = cache.lookup(spark, folder, sites, people(spark, 1, 2), ask, SCHEMA)
    assert rows(got) == [("1", 0, 1, 1, 70), ("1", 1, 2, 9, 5)] and rows(missing) == []


def test_torn_write_is_ignored(spark, tmp_path):
    folder, sites = str(tmp_path / "cache"), spark.createDataFrame(A, SITES)
    cache.store(evidence(spark, ("1", 0, 1, 1, 7)), sites, people(spark, 1), folder, {})
    evidence(spark, ("1", 0, 1, 1, 999)).write.partitionBy("chrom", "block").parquet(f"{folder}/part-torn/evidence")
    assert rows(cache.lookup(spark, folder, sites, people(spark, 1), {}, SCHEMA)[0]) == [("1", 0, 1, 1, 7)]


def test_files_do_not_grow_with_blocks(spark, tmp_path):
    folder = str(tmp_path / "cache")
    sites = spark.range(0, 400, 1, 4).selectExpr("'1' as chrom", "id div 2 as block", "id as pos", "'A' as ref", "'G' as alt")
    cells = sites.selectExpr("chrom", "block", "1L as sample_id", "pos", "2L as depth")
    part = cache.store(cells, sites, people(spark, 1), folder, {})
    assert all(len(list((tmp_path / "cache" / part / name).rglob("*.parquet"))) <= 4 for name in ("sites", "evidence"))
    got, missing = cache.lookup(spark, folder, sites.where("block >= 100"), people(spark, 1, 2), {}, SCHEMA)
    assert rows(got) == [("1", i // 2, 1, i, 2) for i in range(200, 400)]
    assert rows(missing) == [("1", b, 2) for b in range(100, 200)]


def test_hashes(spark):
    assert cache.settings_hash({"a": 1, "b": 2}) == cache.settings_hash({"b": 2, "a": 1}) != cache.settings_hash({"a": 1, "b": 3})
    sites = spark.createDataFrame(A, SITES)
    mixed = spark.createDataFrame(A[::-1], SITES)
    assert rows(cache.site_hashes(sites)) == rows(cache.site_hashes(mixed))
    changed = {r.block: r.sites_hash for r in cache.site_hashes(spark.createDataFrame([("1", 0, 1, "A", "T"), *A[1:]], SITES)).collect()}
    before = {r.block: r.sites_hash for r in cache.site_hashes(sites).collect()}
    assert changed[0] != before[0] and changed[1] == before[1]
