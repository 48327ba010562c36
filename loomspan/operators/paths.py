"""Paths through acyclic graphs, distances of mates within transcripts, smoothed tracks and uneven coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import genes as gn
from loomspan.operators import intervals as iv


def shortest_paths(edges: DataFrame, k: int) -> DataFrame:
    """(source, sink, rank, path): up to ``k`` paths with the fewest edges from every node without incoming to every reachable one without outgoing edges.

    ``edges`` (a, b) are acyclic. Paths of equal length come in the order of their nodes. Each round extends all paths by
    one edge and keeps the first ``k`` for each source and node: a path that isn't among them can't begin a better one.
    """
    from loomspan.plans.storage import written

    e = written(edges.select("a", "b").where("a <> b").distinct())
    step = e.select(F.col("a").alias("node"), F.col("b").alias("next"))
    sources = e.select(F.col("a").alias("source")).distinct().join(e.select(F.col("b").alias("source")).distinct(), "source", "left_anti")
    inner = e.select(F.col("a").alias("node")).distinct()
    front, done = sources.select("source", F.col("source").alias("node"), F.array("source").alias("path")), None
    first = Window.partitionBy("source", "node").orderBy("path")
    while True:
        x = front.join(step, "node").select("source", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        front = written(x.withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= k).drop("r_"))
        if front.isEmpty():
            break
        ended = front.join(inner, "node", "left_anti").select("source", F.col("node").alias("sink"), "path")
        done = ended if done is None else done.union(ended)
    if done is None:
        return front.select("source", F.col("node").alias("sink"), F.lit(1).alias("rank"), "path")
    best = Window.partitionBy("source", "sink").orderBy(F.size("path"), "path")
    return done.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("source", "sink", "rank", "path")


def insert_sizes(mates: DataFrame, genes: DataFrame) -> DataFrame:
    """(insert, n): how often the mates' outer positions (name, left, right) lie that far apart in the transcript of that name.

    Mates with an end outside the exons, or of unknown names, don't count.
    """
    place = lambda c: gn.to_transcript(F.col("exons"), F.col("strand"), F.col(c))
    x = mates.join(genes.select("name", "strand", "exons"), "name").withColumns({"l_": place("left"), "r_": place("right")})
    return x.where("l_ >= 0 AND r_ >= 0").groupBy(F.abs(F.col("r_") - F.col("l_")).alias("insert")).agg(F.count(F.lit(1)).alias("n"))


def smoothing_weights(window: int, rate: float) -> list[float]:
    """Weights that grow by ``rate`` from both ends to the middle of the window and sum to 1."""
    raw = [rate ** (i if i < max(window // 2, 1) else window - 1 - i) for i in range(window)]
    return [w / sum(raw) for w in raw]


def smoothed(df: DataFrame, key: str, order: str, value: str, window: int, rate: float = 1.5) -> DataFrame:
    """(key, order, smoothed): the weighted sum over each row and the ``window`` - 1 after it; keys' last rows, with fewer after them, are left out."""
    w = Window.partitionBy(key).orderBy(order)
    total = F.lit(0.0)
    for i, weight in enumerate(smoothing_weights(window, rate)):
        total = total + F.lead(value, i).over(w) * weight
    return df.withColumn("smoothed", total).where("smoothed IS NOT NULL").select(key, order, "smoothed")


def uniformity(genes: DataFrame, items: DataFrame) -> DataFrame:
    """(name, exonic, intronic, ratio): covering bases per base of the exons, the mean of the same over the introns, and the second by the first (null without exonic coverage)."""

    def per_base(blocks: DataFrame) -> DataFrame:
        """(name, start, size, bases) for each block."""
        b = blocks.withColumn("id_", F.concat_ws("|", "name", "start"))
        p = iv.overlap_join(b.select("id_", "chr", "start", "end"), items.select("chr", "start", "end"))
        hit = p.groupBy("id_").agg(F.sum(iv.overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))).alias("bases"))
        return b.join(hit, "id_", "left").select("name", (F.col("end") - F.col("start")).alias("size"), F.coalesce("bases", F.lit(0)).alias("bases"))

    rows = lambda x: genes.select("name", "chr", F.explode(x).alias("x")).select("name", "chr", F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    ex = per_base(rows(F.col("exons"))).groupBy("name").agg((F.sum("bases") / F.sum("size")).alias("exonic"))
    gaps = rows(gn.introns(F.col("exons"))).where("end > start")
    it = per_base(gaps).groupBy("name").agg(F.avg(F.col("bases") / F.col("size")).alias("intronic"))
    x = ex.join(it, "name", "left").withColumn("intronic", F.coalesce("intronic", F.lit(0.0)))
    return x.select("name", "exonic", "intronic", F.when(F.col("exonic") > 0, F.col("intronic") / F.col("exonic")).alias("ratio"))


# ---- edits of sequences; positions are 0-based, ends exclusive ----


def deleted(s: Column, start: Column, end: Column) -> Column:
    """``s`` without [start, end)."""
    return F.concat(F.substr(s, F.lit(1), start), F.substr(s, end + 1))


def inserted(s: Column, piece: Column, at: Column) -> Column:
    """``s`` with ``piece`` before position ``at``."""
    return F.concat(F.substr(s, F.lit(1), at), piece, F.substr(s, at + 1))


def inverted(s: Column, start: Column, end: Column) -> Column:
    """``s`` with [start, end) replaced by its reverse complement."""
    from loomspan.functions.sequence import reverse_complement

    return F.concat(F.substr(s, F.lit(1), start), reverse_complement(F.substr(s, start + 1, end - start)), F.substr(s, end + 1))


def translocated(a: Column, a_start: Column, a_end: Column, b: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """Both sequences with the two pieces exchanged."""
    x, y = F.substr(a, a_start + 1, a_end - a_start), F.substr(b, b_start + 1, b_end - b_start)
    return inserted(deleted(a, a_start, a_end), y, a_start), inserted(deleted(b, b_start, b_end), x, b_start)
