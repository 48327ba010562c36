"""Binary alignments, paths, regression, matrices and support vector machines on small fixtures."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import probability, sequence
from loomspan.operators import learning, paths
from loomspan.sources import bam


def test_bam_with_sequences_tags_and_unmapped_reads(spark, tmp_path):
    """A file put together here from the format's description, its records cut by blocks anywhere."""
    seq, bases = "ACGTN", "=ACMGRSVTWYHKDBN"

    def record(ref, pos, name, flag, cigar, mate, mate_pos, seq, tags):
        codes = [bases.index(c) for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 7, 0, len(cigar), flag, len(seq), mate, mate_pos, 0) + name.encode() + b"\0"
        body += struct.pack(f"<{len(cigar)}I", *[n << 4 | op for n, op in cigar]) + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    tags = b"XAZtext\0" + b"XBBs" + struct.pack("<i", 2) + bytes(4) + b"XCA!" + b"NHC\x03"
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 900) for n in (b"c1", b"c2"))
    body += record(1, 99, "r1", 163, [(3, 4), (2, 0), (50, 3), (3, 0)], 1, 400, seq, tags) + record(-1, -1, "r2", 4, [], -1, -1, "", b"")
    for step in (7, 60_000):
        with open(tmp_path / f"x{step}.bam", "wb") as f:
            f.write(b"".join(bam._block(body[i : i + step]) for i in range(0, len(body), step)) + bam.END_BLOCK)
        one, two = bam.read_bam(spark, f"file://{tmp_path}/x{step}.bam").orderBy("name").collect()
        assert (one["chr"], one["start"], one["cigar"], one["seq"], one["nh"], one["mate_chr"], one["mate_start"]) == ("c2", 99, "3S2M50N3M", seq, 3, "c2", 400)
        assert [tuple(x) for x in one["exons"]] == [(99, 101), (151, 154)] and one["second"] and one["strand"] == "+"
        assert (two["chr"], two["start"], two["cigar"], two["exons"], two["mapped"], two["nh"]) == ("*", -1, "*", None, False, 1)
    with open(tmp_path / "cut.bam", "wb") as f:
        f.write(bam._block(body[:-5]))
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, f"file://{tmp_path}/cut.bam").collect()


def test_bam_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "name string, chr string, strand string, exons array<struct<start:bigint,end:bigint>>")
    bam.write_bam(none, f"file://{tmp_path}/none")
    assert bam.read_bam(spark, f"file://{tmp_path}/none").count() == 0


def test_paths_against_all_paths(spark):
    rng = random.Random(8)
    edges = sorted({(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.3})
    after = {a: [b for x, b in edges if x == a] for a in range(14)}

    def walk(path):
        if not after[path[-1]]:
            yield path
        for b in after[path[-1]]:
            yield from walk([*path, b])

    starts = {a for a, _ in edges} - {b for _, b in edges}
    every = [p for s in starts for p in walk([s])]
    want = {}
    for p in sorted(every, key=lambda p: (len(p), p)):
        want.setdefault((p[0], p[-1]), []).append(p)
    got = paths.shortest_paths(spark.createDataFrame(edges + edges[:3], "a long, b long"), 3).collect()
    assert {(r["source"], r["sink"], r["rank"]): r["path"] for r in got} == {(*k, i + 1): p for k, ps in want.items() for i, p in enumerate(ps[:3])}
    assert len(got) > 5 and paths.shortest_paths(spark.createDataFrame([], "a long, b long"), 3).count() == 0


def test_weights_peak_in_the_middle():
    assert np.allclose(paths.smoothing_weights(5, 2.0), np.array([1, 2, 4, 2, 1]) / 10) and paths.smoothing_weights(1, 2.0) == [1.0]


def test_regression_of_two_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(b), float(3 + 2 * a - b * (k + 1) + e)) for k in (0, 1) for a, b, e in rng.standard_normal((50, 3)) * [1, 1, 0.1]]
    got = {r["k"]: r for r in learning.linear_regression(spark.createDataFrame([*rows, (0, None, 1.0, 1.0), (7, 1.0, 1.0, 5.0)], "k long, a double, b double, y double"), "k", ["a", "b"], "y").collect()}
    for k in (0, 1):
        x = np.array([(1, a, b) for j, a, b, _ in rows if j == k])
        want = np.linalg.lstsq(x, np.array([y for j, *_, y in rows if j == k]), rcond=None)[0]
        assert np.allclose([got[k]["intercept"], *got[k]["slopes"]], want) and got[k]["r2"] > 0.98
    assert got[7]["slopes"] == [0.0, 0.0] and got[7]["intercept"] == 5.0 and got[7]["r2"] is None


def test_dense_matrix_without_inverse(spark):
    cells = [("a", 0, 0, 2.0), ("a", 1, 1, 4.0), ("b", 0, 0, 1.0), ("b", 0, 1, 1.0), ("b", 1, 0, 1.0), ("b", 1, 1, 1.0)]
    got = {r["k"]: r for r in learning.dense(spark.createDataFrame(cells, "k string, i int, j int, value double"), "k").collect()}
    assert got["a"]["inverse"] == [[0.5, 0.0], [0.0, 0.25]] and got["a"]["eigen"] == [2.0, 4.0] and got["a"]["cond"] == 2.0
    assert got["b"]["rank"] == 1 and got["b"]["inverse"] is None and abs(got["b"]["det"]) < 1e-12


def test_svm_on_separable_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(a), float(b), int(a + 2 * b > 0)) for k, (a, b) in enumerate(rng.standard_normal((400, 2))) if abs(a + 2 * b) > 0.2]
    got = learning.cross_validated_svm(spark.createDataFrame(rows, "k long, a double, b double, y int"), "k", ["a", "b"], "y", 3).collect()
    assert len(got) == len(rows) and np.mean([r["label"] == r["predicted"] for r in got]) > 0.97 and {r["fold"] for r in got} == {0, 1, 2}
    one = learning.cross_validated_svm(spark.createDataFrame([(k, 1.0, 1) for k in range(9)], "k long, a double, y int"), "k", ["a"], "y", 3).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_skellam_against_draws():
    rng = np.random.default_rng(4)
    for k, a, b in [(3, 2.0, 1.0), (-4, 1.5, 6.0), (0, 30.0, 25.0), (12, 300.0, 290.0)]:
        x = rng.poisson(a, 400_000) - rng.poisson(b, 400_000)
        assert abs(probability.skellam_tail_values(np.array([k]), np.array([a]), np.array([b]))[0] - min((x <= k).mean(), (x >= k).mean())) < 0.004


def test_flows(spark):
    rows = [("TTAG",), ("ccTnT",), ("",), ("N",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(sequence.flows(F.col("s"))).collect()]
    assert got == [[2, 1, 0], [0, 0, 2, 0], [], [], None]
