"""Filter interaction audit by counting paths through the lattice of filter subsets.

A document is known by the set of filters that it fails, so documents are counted by (part, set) first. A state of the
lattice is a set of filters already applied, an edge the next one. What an edge removes does not depend on how its state was
reached: `ways_in` orders reach the state and `ways_out` orders leave the edge's other end, and their product is how many of
all orders take the edge. Removals weighted so give every filter's sum over all orders, and the steps of any order are read
from the same edges.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.sources.scratch import forget, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself: few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_chars = F.length(text)
    n_upper = n_chars - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * n_upper > 3 * n_chars,
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def failed_sets(docs: DataFrame, conditions: Mapping[str, Column], repeated: str | None = None) -> DataFrame:
    """doc_id, part, failed (bit i: condition i in the mapping's order, `repeated` last) of every row of docs.

    `repeated` names the condition that a row with a smaller doc_id anywhere in docs has the same text. A null text is the
    empty text; a null condition does not fail. Rows with a null doc_id are repeats of nothing, and nothing repeats them.
    """
    bits = F.lit(0)
    for i, condition in enumerate(conditions.values()):
        bits = bits + F.when(condition, 1 << i).otherwise(0)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("failed"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))
    if repeated is None:
        return rows.drop("digest")
    rows = written(rows)
    # one row for each text that occurs again; a text that a third of all rows share is one row after partial sums
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    bit = F.when(F.col("first") < F.col("doc_id"), 1 << len(conditions)).otherwise(0)
    out = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("failed") + bit).alias("failed"))
    out.scratch = (rows, first)
    return out


def ways(n: int) -> tuple[list[int], list[int]]:
    """(ways_in, ways_out) of every state of n filters: orders from the empty set to it, and from it to the full set."""
    states = range(1 << n)
    ways_in, ways_out = [1] + [0] * (len(states) - 1), [0] * (len(states) - 1) + [1]
    for state in states:
        for f in range(n):
            if state >> f & 1:
                ways_in[state] += ways_in[state ^ 1 << f]
    for state in reversed(states):
        for f in range(n):
            if not state >> f & 1:
                ways_out[state] += ways_out[state | 1 << f]
    return ways_in, ways_out


def edges(counted: DataFrame, names: str, marks: tuple[str, ...]) -> DataFrame:
    """What every edge of the lattice does in every part.

    counted: part, failed, n and, for each of marks, how many of these documents have it. Returns part, state, filter, weight
    (orders that take the edge), kept, removed, redundant, unique_fails and <mark>_lost for each mark. Every part has every
    edge; the work is parts times sets times edges, whatever the number of documents.
    """
    ways_in, ways_out = ways(len(names))
    every = F.array(*[
        F.struct(F.lit(state).alias("state"), F.lit(1 << f).alias("bit"), F.lit(name).alias("filter"), F.lit(ways_in[state] * ways_out[state | 1 << f]).cast("long").alias("weight"))
        for state in range(1 << len(names)) for f, name in enumerate(names) if not state >> f & 1
    ])
    rows = counted.select("*", F.inline(every))
    gone_before = F.col("failed").bitwiseAND(F.col("state")) != 0
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    return rows.groupBy("part", "state", "filter", "weight").agg(
        total(~gone_before & ~fails).alias("kept"),
        total(~gone_before & fails).alias("removed"),
        total(gone_before & fails).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        *[total(~gone_before & fails, mark).alias(f"{mark}_lost") for mark in marks],
    )


def audited(counted: DataFrame, names: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step and its edge's counts, and shapley: the step's filter's removals summed over all orders.

    counted: see `edges`. One row for each part, order of all filters (names has a letter for each) and step from 1; no part,
    no rows. Orders are as many as the factorial of the filters, parts times that is what comes out.
    """
    spark = counted.sparkSession
    by_edge = written(edges(counted, names, marks))
    steps = [
        ("".join(order), step + 1, sum(1 << names.index(x) for x in order[:step]), order[step])
        for order in permutations(names) for step in range(len(names))
    ]
    # as many rows as the filters' number says, whatever the data
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter string"))
    shapley = by_edge.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    return by_edge.join(shapley, ["part", "filter"]).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{mark}_lost" for mark in marks], "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over all docs, by lang (null: the empty string), with good and toxic losses.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. Filter E is "repeats a smaller doc_id's
    text". Null texts are empty texts; documents without a label are neither good nor toxic, one with several labels is what any
    of them says; rows that repeat an id count each. Empty docs give no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    sets = failed_sets(docs, failures(F.col("text")), "E")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = sets.join(written(marks), "doc_id", "left")
    counted = written(rows.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    ))
    for df in sets.scratch:
        forget(df)
    return audited(counted, "ABCDE", ("good", "toxic"))
