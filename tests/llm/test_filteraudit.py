"""The filter interaction audit against applying every order to every document."""

import random
from itertools import permutations
from math import factorial

from lociweave.llm import filteraudit as a


def test_ways_add_up():
    for n in (1, 3, 5):
        ways_in, ways_out = a.ways(n)
        for state in range(1 << n):
            size = bin(state).count("1")
            assert ways_in[state] == factorial(size) and ways_out[state] == factorial(n - size)
        taken = sum(ways_in[s] * ways_out[s | 1 << f] for s in range(1 << n) for f in range(n) if not s >> f & 1)
        assert taken == n * factorial(n)


def plain(docs, names):
    """docs: (part, failed names, good, toxic)."""
    out = []
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], dict.fromkeys(names, 0)
        rows = []
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                before = [d for d in mine if f in d[1] and set(order[: step - 1]) & set(d[1])]
                rows.append([part, "".join(order), step, len(left), len(gone), len(before), sum(d[1] == f for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        out += [tuple(r[:9]) + (shapley[r[9]],) for r in rows]
    return sorted(out)


def rows_of(df):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_lattice_against_all_orders(spark):
    rng = random.Random(3)
    docs = [(rng.choice("pq"), "".join(x for x in "XYZ" if rng.random() < 0.4), int(rng.random() < 0.5), int(rng.random() < 0.2)) for _ in range(200)]
    counted = {}
    for part, failed, good, toxic in docs:
        c = counted.setdefault((part, sum(1 << "XYZ".index(x) for x in failed)), [0, 0, 0])
        c[0] += 1
        c[1] += good
        c[2] += toxic
    df = spark.createDataFrame([(*k, *v) for k, v in counted.items()], "part string, failed int, n long, good long, toxic long")
    assert rows_of(a.audited(df, "XYZ", ("good", "toxic"))) == plain(docs, "XYZ")


def test_filters_and_odd_inputs(spark):
    many = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, many, "en", "x"), (2, many, "de", "x"), (2, many, "de", "x"), (3, None, None, "x"), (4, "", "", "x"), (5, many + " $", "en", "x"), (6, "AB c", "en", "x"),
        (7, "a a a", "en", "x"), (None, many, "en", "x"), (8, "word " * 50000, "en", "x"), (9, " ".join(f"É{i}" for i in range(250)), "en", "x"), (10, many.replace("w", "W", 24), "en", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, failed string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")

    def failed(doc_id, text):
        text, out = text or "", ""
        words = text.split()
        out += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text))
        out += "D" * any(x in text for x in "#$%&*|")
        return out + "E" * any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)

    want = [(lang or "", failed(i, t), int(i in (1, 5)), int(i in (5, 6))) for i, t, lang, _ in rows]
    assert rows_of(a.filter_audit(docs, labels)) == plain(want, "ABCDE")
    assert a.filter_audit(docs.limit(0), labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in a.filter_audit(docs, labels.limit(0)).collect()} == {(0, 0)}
