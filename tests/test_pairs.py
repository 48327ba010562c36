"""Operators on pairs send rows on, not pairs."""

import random

from loomspan.operators import genes as gn
from loomspan.operators import structures as st
from loomspan.operators import tracks as tr

ROWS = "chr string, start long, end long, name string"
MODELS = "name string, chr string, strand string, exons array<struct<start:long,end:long>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def models(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        at = r.choice([100, 2000, 5000])
        ex = [(at + 300 * k + r.randrange(40), at + 300 * k + 60 + r.randrange(40)) for k in range(r.randrange(1, 4))]
        out.append((f"g{i:03}", r.choice("xy"), r.choice("+-"), ex))
    return out + [(f"copy{i}", *m[1:]) for i, m in enumerate(out[: n // 2])]


def shared(a, b):
    return sum(max(min(e, f) - max(s, t), 0) for s, e in a[3] for t, f in b[3]) if a[1:3] == b[1:3] else 0


def test_stitched_overlap_of_dense_rows(spark):
    r = random.Random(3)
    a = [("x", s, s + r.choice([0, 1, 5, 40]), f"a{i}") for i, s in enumerate(r.choices(range(3000), k=300))]
    b = [("x", s, s + r.choice([0, 1, 3, 30]), f"b{i}") for i, s in enumerate(r.choices(range(3000), k=400))]
    got = tr.stitched_overlap(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS), 2)
    assert "rangeframe" in plan(got)  # islands, not all overlappers
    want = {}
    for _, s, e, name in a:
        reach, total = None, 0
        for t, f in sorted((t, f) for _, t, f, _ in b if t < e and f > s):
            low = max(reach, s) if reach is not None and t <= reach + 2 else t
            total, reach = total + max(min(f, e) - max(low, s), 0), max(f, reach or f)
        want[name] = total
    assert {x["name"]: x["score"] for x in got.collect()} == want


def test_exon_overlap_sends_no_pairs(spark):
    m = models(4, 60)
    g = spark.createDataFrame(m, MODELS)
    got = gn.exon_overlap(g, g)
    assert "aggregate [" not in plan(got)  # a pair is complete where it is found
    want = {(a[0], b[0], n, n / sum(e - s for s, e in a[3])) for a in m for b in m if (n := shared(a, b))}
    assert {tuple(x) for x in got.collect()} == want


def test_loci_compare_one_copy_and_send_a_forest(spark):
    m = models(5, 60)
    got = st.loci(spark.createDataFrame(m, MODELS), 0.5)
    up = {a[0]: a[0] for a in m}
    size = lambda a: sum(e - s for s, e in a[3])
    for _ in m:
        for a in m:
            up[a[0]] = min(up[b[0]] for b in m if a is b or shared(a, b) > 0.5 * min(size(a), size(b)))
    assert {x["name"]: x["locus"] for x in got.collect()} == up
    links = [(a, b) for a in "abc" for b in "abcdef" if a < b]
    import pandas as pd

    assert sorted(map(tuple, pd.concat(st._forest([pd.DataFrame(links, columns=["a", "b"])])).values)) == [(x, "a") for x in "bcdef"]


def test_truncated_lists_a_model_in_few_bins(spark):
    g = spark.createDataFrame([("g", "x", "+", [(0, 60), (1300, 1400)]), ("h", "x", "+", [(40, 60), (1300, 1400)])], MODELS)
    got = st.truncated(g, g, "5", 30)
    assert "/ 2048" in plan(got) or "2048" in plan(got)  # bins of 128 positions listed each of these eleven times
    assert [tuple(x) for x in got.collect()] == [("h", "g", 40)]


def test_loci_join_no_pairs(spark):
    m = models(6, 40) + [("s1", "x", "*", [(120, 160)]), ("s2", "y", "*", [(2020, 2070)]), ("no1", None, "+", [(1, 9)]), ("no2", "x", None, [(1, 9)]), ("no3", "x", "+", []), ("zero", "x", "+", [(130, 130)])]
    got = st.loci(spark.createDataFrame(m, MODELS), 0.5)
    assert "o_exons" not in plan(got)  # pairs of whole models grow with the square of a locus
    fits = lambda a, b: a[1] and b[1] and a[1] == b[1] and (a[2] == b[2] and a[2] or "*" in (a[2], b[2]))
    both = lambda a, b: sum(max(min(e, f) - max(s, t), 0) for s, e in a[3] for t, f in b[3]) if fits(a, b) else 0
    size = lambda a: sum(e - s for s, e in a[3])
    up = {a[0]: a[0] for a in m}
    for _ in m:
        for a in m:
            up[a[0]] = min(up[b[0]] for b in m if a is b or both(a, b) > 0.5 * min(size(a), size(b)))
    assert {x["name"]: x["locus"] for x in got.collect()} == up


def test_components_compare_few_pairs(monkeypatch):
    import numpy as np

    from loomspan.operators import bins

    n, seen, real = 4000, [0], bins.shared

    def count(s, e, i, j):
        seen[0] += len(i) * len(j)
        return real(s, e, i, j)

    monkeypatch.setattr(bins, "shared", count)
    s = np.arange(n, dtype=np.int64)[None, :] % 20
    assert not bins.components(s, s + 100, np.full(n, 100), 0.5).any()
    assert seen[0] < 20 * n


def test_exon_overlap_sends_models_once(spark):
    m = models(7, 40) + [("s1", "x", "*", [(120, 160)]), ("no2", "x", None, [(110, 190)]), ("no3", "x", "+", [])]
    g = spark.createDataFrame(m, MODELS)
    got = gn.exon_overlap(g, g, less=True)
    assert "join" not in plan(got)  # the two sides are one table
    fits = lambda a, b: a[2] and b[2] and (a[2] == b[2] or "*" in (a[2], b[2])) or "*" in (a[2], b[2])
    n = lambda a, b: sum(max(min(e, f) - max(s, t), 0) for s, e in a[3] for t, f in b[3]) if a[1] == b[1] and fits(a, b) else 0
    want = sorted((a[0], b[0], n(a, b), n(a, b) / sum(e - s for s, e in a[3])) for a in m for b in m if a[0] < b[0] and n(a, b))
    assert sorted(map(tuple, got.collect())) == want
    h = spark.createDataFrame(m, MODELS)
    assert sorted(map(tuple, gn.exon_overlap(g, h).where("name < o_name").collect())) == want


def test_truncated_sends_models_once(spark):
    m = models(8, 50) + [("null", "x", None, [(100, 900)]), ("none", "x", "+", [])]
    g, h = spark.createDataFrame(m, MODELS), spark.createDataFrame(m, MODELS)
    assert "join" not in plan(st.truncated(g, g, "5", 30))  # the two sides are one table
    for end in "53":
        want = []
        for a in m:
            for b in m:
                if a[3] and b[3] and a[2] and a[1:3] == b[1:3] and a[3][0][0] < b[3][-1][1] and a[3][-1][1] > b[3][0][0]:
                    missing = a[3][0][0] - b[3][0][0] if (a[2] == "-") == (end == "3") else b[3][-1][1] - a[3][-1][1]
                    want += [(a[0], b[0], missing)] if missing >= 30 else []
        assert want
        for other in (g, h):
            assert sorted(map(tuple, st.truncated(g, other, end, 30).collect())) == sorted(want)
