"""Depth caps told in rounds against the rule itself, fragment by fragment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import filters


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_rounds_equal_the_rule(spark, cap):
    """A sample was one group, which an executor had to hold: F9 q_depth_cap."""
    rng = np.random.default_rng(cap)
    rows = [(s, f, int(p)) for s in range(2) for f in range(150) for p in set(rng.integers(0, 25, rng.integers(1, 5)))]
    reads = spark.createDataFrame(rows + rows[:9], "sample_id long, fragment long, pos long").withColumn("x", F.lit("kept"))
    out = filters.depth_capped(reads, cap, seed=3)
    assert "sample_id#" not in "".join(x for x in out._jdf.queryExecution().toString().splitlines() if "FlatMapGroups" in x) and out.columns == reads.columns
    turns = reads.select("sample_id", "fragment", F.xxhash64("sample_id", "fragment", F.lit(3)).alias("turn")).distinct().collect()
    want = set()
    for s in range(2):
        depth = dict.fromkeys(range(25), 0)
        for t in sorted((t for t in turns if t.sample_id == s), key=lambda t: (t.turn, t.fragment)):
            mine = {p for a, f, p in rows if (a, f) == (s, t.fragment)}
            if any(depth[p] < cap for p in mine):
                want.add((s, t.fragment))
                depth |= {p: depth[p] + 1 for p in mine}
    got = out.collect()
    assert {(r.sample_id, r.fragment) for r in got} == want and 0 < len(want) < 300
    assert len(got) == sum((s, f) in want for s, f, _ in rows + rows[:9])
