"""Golden values and brute-force comparisons on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import probability as pr
from loomspan.operators import genes as gn
from loomspan.operators import intervals as iv
from loomspan.operators import models as md
from loomspan.operators import stats as st


def frame(spark, rows):
    return spark.createDataFrame(rows, "chr string, start long, end long, name string")


def test_overlap_sizes(spark):
    rows = [("chr1", 0, 10, 10, 20, 0), ("chr1", 0, 10, 9, 15, 1), ("chr1", 10, 20, 9, 15, 5)]
    x = spark.createDataFrame(rows, "chr string, s long, e long, os long, oe long, want long")
    got = x.select(iv.overlap_size(F.col("s"), F.col("e"), F.col("os"), F.col("oe")).alias("n"), "want").collect()
    assert all(r["n"] == r["want"] for r in got)


def test_zero_length_overlap(spark):
    spans = [(208, 208), (246, 288), (290, 398), (428, 441), (451, 483), (489, 511), (515, 532)]
    b = frame(spark, [("c", s, e, str(k)) for k, (s, e) in enumerate(spans)])
    a = frame(spark, [("c", 188, 445, "q"), ("c", 240, 250, "r")])
    n = {r["name"]: r["n"] for r in iv.overlap_join(a, b).groupBy("name").agg(F.count("o_name").alias("n")).collect()}
    assert n == {"q": 4, "r": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps_across_spans(spark, monkeypatch, seed):
    """With spans of a few positions every carry is used; compared with plain loops."""
    monkeypatch.setattr(iv, "SPAN", 16)
    monkeypatch.setattr(iv, "_span", lambda p, size=16: F.floor((F.col(p) if isinstance(p, str) else p) / size).cast("long"))
    rng = random.Random(seed)
    rows = []
    for k in range(200):
        s = rng.randrange(600)
        rows.append((rng.choice("ab"), s, s + rng.randrange(1, 40), f"n{k}"))
    got = sorted((r["chr"], r["start"], r["end"], r["n"]) for r in iv.islands(frame(spark, rows)).collect())
    want = []
    for c, s, e in sorted((c, s, e) for c, s, e, _ in rows):
        if want and want[-1][0] == c and s < want[-1][2]:
            want[-1] = (c, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
    assert got == want
    deep = {(r["chr"], p): r["depth"] for r in iv.depth(frame(spark, rows)).collect() for p in range(r["start"], r["end"])}
    for c in "ab":
        for p in range(0, 640):
            assert deep.get((c, p), 0) == sum(1 for k, s, e, _ in rows if k == c and s <= p < e)


def test_empty_and_extra_columns(spark):
    empty = frame(spark, []).withColumn("bin", F.lit(1))
    some = frame(spark, [("c", 1, 5, "x")])
    assert iv.islands(empty).count() == 0
    assert iv.overlap_join(some, empty).count() == 0
    assert iv.anti(some, empty).count() == 1
    assert iv.semi(empty, some).columns == empty.columns


def test_coordinate_map(spark):
    exons = [(1000000, 1000100), (1001200, 1001250), (1002000, 1002300), (1005050, 1005200)]
    g = spark.createDataFrame([("g", "chr1", "+", exons)], "name string, chr string, strand string, exons array<struct<start:long,end:long>>")
    x = F.col("exons")
    got = g.select(*[gn.to_transcript(x, F.col("strand"), F.lit(p)).alias(str(p)) for p in (1000050, 1001200, 1001250, 1005199)]).first()
    assert tuple(got) == (50, 100, -1, 599)
    back = g.select(*[gn.to_genome(x, F.lit("-"), F.lit(k)).alias(str(k)) for k in (0, 599, 600)]).first()
    assert tuple(back) == (1005199, 1000000, -1)


def test_mann_whitney(spark):
    x, y = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10], [10, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]
    df = spark.createDataFrame([("g", "a", float(v)) for v in x] + [("g", "b", float(v)) for v in y], "k string, grp string, value double")
    r = st.mann_whitney(df, "k", "grp", "a", "b").first()
    assert abs(r["z"] - -4.000473456828313) < 1e-9
    p = spark.range(1).select(st.normal_two_sided(F.lit(r["z"])).alias("p")).first()["p"]
    assert abs(p - 6.321587792512684e-5) < 1e-6


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0,), (8.9,)], "x double").withColumn("k", F.lit("k"))
    h = st.histogram(df, ["k"], "x", 0.0, 10.0, 500).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 1] and [r["below"] for r in h] == [0.0, 0.5]


def test_viterbi_dice():
    rolls = [4, 5, 3, 1, 3, 2, 6, 5, 1, 2, 4, 5, 6]
    fair, loaded = [1 / 6] * 6, [0.1] * 5 + [0.5]
    path = md.viterbi_path([r - 1 for r in rolls], np.array([0.1, 0.9]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([fair, loaded]), np.array([0.05, 0.9]))
    assert len(path) == 13 and set(path) <= {0, 1}


def test_forward_backward_sums_to_one():
    ll, post = md.forward_backward([0, 1, 1, 0], np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.7, 0.3], [0.2, 0.8]]))
    assert ll < 0 and np.allclose(post.sum(axis=1), 1)


def test_alignment_scores():
    assert md.align_score("ACGT", "ACGT", 2, -1, 2, 1) == 8
    assert md.align_score("ACGT", "AGT", 2, -1, 2, 1, local=False) == 4
    assert md.align_score("", "AC", 2, -1, 2, 1, local=False) == -3


def test_factors_and_trees():
    rng = np.random.default_rng(0)
    w, h = rng.random((6, 2)), rng.random((2, 5))
    for cost in ("euclid", "poisson"):
        a, b = md.factorise(w @ h, rng.random((6, 2)) + 0.1, rng.random((2, 5)) + 0.1, 3000, cost)
        assert np.abs(a @ b - w @ h).max() < 2e-2
    merges = md.agglomerate(np.array([[0, 1, 5.0], [1, 0, 4.0], [5.0, 4.0, 0]]), "complete")
    assert merges == [(0, 1, 1.0, 2), (2, 3, 5.0, 3)]


def test_probabilities():
    k = np.arange(0, 30)
    cdf = pr.poisson_cdf_values(k, np.full(30, 4.2))
    assert np.allclose(cdf, np.cumsum(pr.poisson_pmf_values(k, np.full(30, 4.2))))
    assert pr.scan_p_values(np.array([1, 2]), np.array([0.1, 0.1]), np.array([10, 10]), np.array([1000, 1000])).tolist() == [1.0, 1.0]
    assert pr.hypergeometric_tail_values(np.array([10]), np.array([3]), np.array([4]), np.array([3]))[0] == 0.0
    assert pr.critical_value(0.01, 100, 100_000, 0.05) > 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    parent = list(range(60))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["comp"] for r in md.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
