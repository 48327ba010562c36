"""Gene models: rows (name, chr, strand, exons) with exons a sorted array of disjoint struct<start, end>.

Arithmetic within a model uses array functions, so it stays in one row; joins between models explode the exons.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import bins
from loomspan.operators import intervals as iv

_LONG = "bigint"
#: Positions in a bin of a join of whole models: wider than in ``intervals``, as spans are longer than exons.
SPAN_BIN = 2048


def from_exon_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One model per key from rows with start and end: equal exons once, sorted."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("start").cast(_LONG).alias("start"), F.col("end").cast(_LONG).alias("end")))).alias("exons"))


def exon_rows(genes: DataFrame) -> DataFrame:
    """One row per exon with its 0-based place: name, chr, strand, start, end, k."""
    return genes.select("name", "chr", "strand", F.posexplode("exons").alias("k", "x")).select("name", "chr", "strand", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("k").cast(_LONG).alias("k"))


def gene_start(x: Column) -> Column:
    return F.array_min(F.transform(x, lambda e: e["start"]))


def gene_end(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda e: e["end"]))


def transcript_length(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast(_LONG), lambda a, e: a + e["end"] - e["start"])


def introns(x: Column) -> Column:
    """Gaps between neighbouring exons."""
    n = F.size(x)
    return F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))


def five_prime_exon(x: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.element_at(x, -1)).otherwise(F.element_at(x, 1))


def three_prime_exon(x: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.element_at(x, 1)).otherwise(F.element_at(x, -1))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Exons cut to [lo, hi); empty ones dropped."""
    cut = F.transform(x, lambda e: F.struct(F.greatest(e["start"], lo).alias("start"), F.least(e["end"], hi).alias("end")))
    return F.filter(cut, lambda e: e["start"] < e["end"])


def to_transcript(x: Column, strand: Column, position: Column) -> Column:
    """0-based place in the transcript, from its 5' end, of a genomic position; -1 outside the exons and at exon ends."""
    before = F.aggregate(x, F.lit(0).cast(_LONG), lambda a, e: a + F.greatest(F.least(e["end"], position) - e["start"], F.lit(0).cast(_LONG)))
    inside = F.exists(x, lambda e: (e["start"] <= position) & (position < e["end"]))
    return F.when(~inside, F.lit(-1).cast(_LONG)).when(strand == "-", transcript_length(x) - 1 - before).otherwise(before)


def to_genome(x: Column, strand: Column, place: Column) -> Column:
    """Genomic position of a 0-based place in the transcript; -1 outside."""
    n = transcript_length(x)
    p = F.when(strand == "-", n - 1 - place).otherwise(place)
    walk = F.aggregate(
        x,
        F.struct(p.cast(_LONG).alias("left"), F.lit(-1).cast(_LONG).alias("at")),
        lambda a, e: F.struct(
            (a["left"] - (e["end"] - e["start"])).alias("left"),
            F.when((a["left"] >= 0) & (a["left"] < e["end"] - e["start"]), e["start"] + a["left"]).otherwise(a["at"]).alias("at"),
        ),
    )
    return F.when((place >= 0) & (place < n), walk["at"]).otherwise(F.lit(-1).cast(_LONG))


def trim(x: Column, strand: Column, lo: Column, hi: Column) -> Column:
    """Exons of the transcript places [lo, hi) from the 5' end; null when that is empty or reaches out of the transcript."""
    n = transcript_length(x)
    a = F.when(strand == "-", n - hi).otherwise(lo).cast(_LONG)
    b = F.when(strand == "-", n - lo).otherwise(hi).cast(_LONG)
    start = F.struct(F.lit(0).cast(_LONG).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc, e):
        size = e["end"] - e["start"]
        s, t = F.greatest(a - acc["at"], F.lit(0).cast(_LONG)), F.least(b - acc["at"], size)
        piece = F.array(F.struct((e["start"] + s).alias("start"), (e["start"] + t).alias("end")))
        return F.struct((acc["at"] + size).alias("at"), F.when(s < t, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.when((lo >= 0) & (hi <= n) & (lo < hi), F.aggregate(x, start, step)["out"])


def from_end(x: Column, strand: Column, length: int, distance: int) -> Column:
    """The ``length`` places that end ``distance`` places before the 3' end; null if the transcript is too short."""
    n = transcript_length(x)
    return trim(x, strand, n - distance - length, n - distance)


def windows(genes: DataFrame, size: int, step: int) -> DataFrame:
    """name, start place and exons of each window of ``size`` places, every ``step`` places, that lies in the transcript."""
    n = transcript_length(F.col("exons"))
    places = F.when(n >= size, F.sequence(F.lit(0).cast(_LONG), n - size, F.lit(step).cast(_LONG)))
    x = genes.select("name", "strand", "exons", F.explode(places).alias("place"))
    return x.select("name", "place", trim(F.col("exons"), F.col("strand"), F.col("place"), F.col("place") + size).alias("exons"))


def same_introns(a: Column, b: Column) -> Column:
    """Equal intron chains of two models with several exons."""
    return (F.size(a) > 1) & (F.size(b) > 1) & (introns(a) == introns(b))


def almost_same(a: Column, b: Column, fudge: int) -> Column:
    """As many introns, and ends that differ by less than ``fudge`` each."""
    near = F.zip_with(introns(a), introns(b), lambda x, y: (F.abs(x["start"] - y["start"]) < fudge) & (F.abs(x["end"] - y["end"]) < fudge))
    ends = (F.abs(gene_start(a) - gene_start(b)) < fudge) & (F.abs(gene_end(a) - gene_end(b)) < fudge)
    return (F.size(a) == F.size(b)) & ends & F.forall(near, lambda v: v)


def compatible_introns(a: Column, b: Column) -> Column:
    """Number of introns that both models have."""
    return F.size(F.array_intersect(introns(a), introns(b)))


def exon_overlap(a: DataFrame, b: DataFrame, less: bool = False) -> DataFrame:
    """(name, o_name, shared, share): bases shared by exons of two models on compatible strands ("*" fits both), and their share of the first's length; ``less``: only pairs whose first name is the smaller.

    Whole models meet in the bins of their spans, so that a pair is complete where it is found and no pair is sent on.
    """
    rows = lambda df: span_rows(df, F.col("exons.start").alias("starts"), F.col("exons.end").alias("ends"))
    x = bins.sides(rows(a), rows(b), a is b)
    p = bins.by_bin(x, ["chr"], SPAN_BIN, functools.partial(_exon_pairs, less), "name string, o_name string, shared bigint, size bigint")
    return p.select("name", "o_name", "shared", (F.col("shared") / F.col("size")).alias("share"))


def _exon_pairs(less: bool, t: pa.Table):
    names, side, first, here = t.column("name").chunk(0), bins.values(t, "side"), bins.values(t, "first_"), bins.values(t, "bin_")[0]
    rank = pc.rank(names, tiebreaker="min").to_numpy().astype(np.int64)
    strands = t.column("strand").to_pylist()
    code = {x: k for k, x in enumerate(sorted({x for x in strands if x is not None and x != "*"}))}
    strand = np.array([-1 if x == "*" else -2 if x is None else code[x] for x in strands])
    s, e = bins.exons(t)
    size, points = np.where(e > s, e.astype(np.int64) - s, 0).sum(0), bool((s == e).any())
    left, right = (np.flatnonzero(side != x) for x in (bins.RIGHT, bins.LEFT))
    if less:
        left, right = left[np.argsort(rank[left], kind="stable")], right[np.argsort(rank[right], kind="stable")]
    for i, j in bins.tiles(left, right):
        if less and rank[i[0]] >= rank[j[-1]]:
            continue
        u, v = strand[i][:, None], strand[j]
        fits = ((u == v) & (u != -2)) | (u == -1) | (v == -1)
        fits &= np.maximum(first[i][:, None], first[j]) == here
        if less:
            fits &= rank[i][:, None] < rank[j]
        if not fits.any():
            continue
        n = bins.shared(s, e, i, j)
        x, y = np.nonzero(fits & ((n > 0) | bins.touching(s, e, i, j) if points else n > 0))
        if len(x):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i[x])), names.take(pa.array(j[y])), pa.array(n[x, y].astype(np.int64)), pa.array(size[i[x]])], names=["name", "o_name", "shared", "size"])


def span_rows(genes: DataFrame, *more: str) -> DataFrame:
    return genes.select("name", "chr", "strand", gene_start(F.col("exons")).alias("start"), gene_end(F.col("exons")).alias("end"), *more)


def without_repeats(genes: DataFrame, repeats: DataFrame, share: float) -> DataFrame:
    """Models of whose bases at most ``share`` lie in ``repeats``."""
    p = iv.overlap_join(exon_rows(genes), iv.islands(repeats).select("chr", "start", "end"))
    bad = p.groupBy("name").agg(F.sum(iv.overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))).alias("r"))
    x = genes.join(bad, "name", "left")
    return x.where(F.coalesce("r", F.lit(0)) <= share * transcript_length(F.col("exons"))).drop("r")


def merged_by(genes: DataFrame, key: str) -> DataFrame:
    """One model per value of ``key`` and chr and strand: the islands of all exons."""
    rows = genes.select(key, "chr", "strand", F.explode("exons").alias("x")).select(key, "chr", "strand", F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    return from_exon_rows(iv.islands(rows, [key, "chr", "strand"]), [key, "chr", "strand"])


def constituent_exons(genes: DataFrame, key: str) -> DataFrame:
    """Parts of exons (key, chr, start, end) that every model of the key covers."""
    n = genes.groupBy(key, "chr").agg(F.count(F.lit(1)).alias("models"))
    rows = genes.select(key, "chr", F.explode("exons").alias("x")).select(F.concat_ws("\x01", key, "chr").alias("chr"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    d = iv.depth(rows)
    both = F.split("chr", "\x01")
    d = d.select(both[0].alias(key), both[1].alias("chr"), "start", "end", "depth")
    return d.join(n, [key, "chr"]).where("depth = models").select(key, "chr", "start", "end")


def distinct_structures(genes: DataFrame) -> DataFrame:
    """One row (the smallest name) per chr, strand and exons."""
    return genes.groupBy("chr", "strand", "exons").agg(F.min("name").alias("name"))


def best_per_locus(genes: DataFrame, locus: str, score: str) -> DataFrame:
    """The model of highest score of each locus, the smallest name among equals."""
    return genes.groupBy(locus).agg(F.min_by("name", F.struct((-F.col(score)).alias("s"), "name")).alias("name"), F.max(score).alias(score))


def cigar(x: Column) -> Column:
    """Exon lengths as M and intron lengths as N."""
    first = F.transform(x, lambda e: F.concat((e["end"] - e["start"]).cast("string"), F.lit("M")))
    gap = F.concat(F.transform(introns(x), lambda e: F.concat((e["end"] - e["start"]).cast("string"), F.lit("N"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(first, gap, lambda a, b: F.concat(a, b)), "")


def blocks_of(start: Column, text: Column) -> Column:
    """Blocks from a CIGAR string: M, =, X and D advance in the block, N begins a new one, others don't move."""
    ops = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHPX=])"), 1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    init = F.struct(start.cast(_LONG).alias("lo"), start.cast(_LONG).alias("at"), empty.alias("out"))

    def step(a, op):
        n, kind = F.regexp_extract(op, r"\d+", 0).cast(_LONG), F.substring(op, -1, 1)
        done = F.concat(a["out"], F.array(F.struct(a["lo"].alias("start"), a["at"].alias("end"))))
        return F.when(kind == "N", F.struct((a["at"] + n).alias("lo"), (a["at"] + n).alias("at"), done.alias("out"))).otherwise(
            F.struct(a["lo"].alias("lo"), F.when(kind.isin("M", "=", "X", "D"), a["at"] + n).otherwise(a["at"]).alias("at"), a["out"].alias("out"))
        )

    end = F.aggregate(ops, init, step)
    return F.concat(end["out"], F.array(F.struct(end["lo"].alias("start"), end["at"].alias("end"))))


def junction_counts(reads: DataFrame, least: int) -> DataFrame:
    """(chr, start, end, strand, n) of introns that more than ``least`` reads (chr, strand, exons) have."""
    x = reads.select("chr", "strand", F.explode(introns(F.col("exons"))).alias("i"))
    return x.groupBy("chr", F.col("i.start").alias("start"), F.col("i.end").alias("end"), "strand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def five_three_utr(x: Column, strand: Column, cds_start: Column, cds_end: Column) -> tuple[Column, Column, Column]:
    """5' UTR, coding and 3' UTR exons."""
    left, right = clip(x, F.lit(0).cast(_LONG), cds_start), clip(x, cds_end, F.lit(1 << 62))
    return F.when(strand == "-", right).otherwise(left), clip(x, cds_start, cds_end), F.when(strand == "-", left).otherwise(right)


def rpkm(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """name, n, rpkm = n * 1e9 / (length * all counted reads)."""
    total = counts.agg(F.sum("n").alias("all_"))
    x = counts.join(genes.select("name", transcript_length(F.col("exons")).alias("len")), "name").join(F.broadcast(total))
    return x.select("name", "n", (F.col("n") * 1e9 / (F.col("len") * F.col("all_"))).alias("rpkm"))


def relative_coverage(genes: DataFrame, points: DataFrame, bins: int) -> DataFrame:
    """(name, bin, n): points (chr, pos) by their relative place in the transcript, from its 5' end."""
    x = iv.overlap_join(points.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), exon_rows(genes))
    y = x.select("start", F.col("o_name").alias("name")).join(genes.select("name", "strand", "exons"), "name")
    place = to_transcript(F.col("exons"), F.col("strand"), F.col("start"))
    k = F.floor(place * bins / transcript_length(F.col("exons"))).cast(_LONG)
    return y.groupBy("name", k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
