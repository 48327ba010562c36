"""Counts over regions and windows, scans with significance, permutations of interval sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import probability as pr
from loomspan.operators import intervals as iv


def stitched_overlap(a: DataFrame, b: DataFrame, buffer: int = 2) -> DataFrame:
    """(name, score): bases of each row of ``a`` under its overlappers in ``b``, these stitched first where they are at most ``buffer`` apart.

    Each place (chr, start, end) is compared once, with the islands of ``b``, which are disjoint: the overlappers cover
    what the islands cover, and what lies between two neighbouring islands that both overlap the place is stitched.
    """
    place = ["chr", "start", "end"]
    cover = iv.islands(b.select(*place)).select(*place)
    p = iv.overlap_join(a.select(*place).distinct(), cover, width=1024)
    piece = F.struct(F.col("o_start").alias("s"), F.col("o_end").alias("e"))
    x = p.groupBy(*place).agg(F.array_sort(F.collect_list(piece)).alias("o"))
    inside = F.aggregate("o", F.lit(0).cast("long"), lambda n, r: n + F.least(r["e"], F.col("end")) - F.greatest(r["s"], F.col("start")))
    gaps = F.zip_with(F.slice("o", 1, F.size("o") - 1), F.slice("o", 2, F.size("o")), lambda r, t: t["s"] - r["e"])
    x = x.select(*place, (inside + F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + F.when(g <= buffer, g).otherwise(0))).alias("w"))
    return a.select("name", *place).join(x, place, "left").select("name", F.coalesce("w", F.lit(0)).alias("score"))


def covered_in(regions: DataFrame, items: DataFrame) -> DataFrame:
    """(name, covered): bases of each region that some item covers."""
    p = iv.overlap_join(regions.select("name", "chr", "start", "end"), iv.islands(items).select("chr", "start", "end"))
    got = p.groupBy("name").agg(F.sum(iv.overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))).alias("covered"))
    return regions.select("name").join(got, "name", "left").select("name", F.coalesce("covered", F.lit(0)).alias("covered"))


def contained_counts(regions: DataFrame, items: DataFrame) -> DataFrame:
    """(name, n): items that lie wholly in each region."""
    p = iv.overlap_join(regions.select("name", "chr", "start", "end"), items.select("chr", "start", "end"))
    got = p.where((F.col("o_start") >= F.col("start")) & (F.col("o_end") <= F.col("end"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return regions.select("name").join(got, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def unique_overlappers(items: DataFrame, target: DataFrame, exclude: DataFrame) -> DataFrame:
    """Items that overlap ``target`` and nothing of ``exclude``."""
    return iv.anti(iv.semi(items, target), exclude)


def read_counts(regions: DataFrame, blocks: DataFrame, weight: str | None = None) -> DataFrame:
    """(name, n): reads with a block (read, chr, start, end[, weight]) in each region, every read once, by its weight."""
    extra = [weight] if weight else []
    p = iv.overlap_join(regions.select("name", "chr", "start", "end"), blocks.select("read", "chr", "start", "end", *extra))
    once = p.select("name", "o_read", *[f"o_{c}" for c in extra]).distinct()
    n = F.sum(f"o_{weight}") if weight else F.count(F.lit(1)).cast("double")
    got = once.groupBy("name").agg(n.alias("n"))
    return regions.select("name").join(got, "name", "left").select("name", F.coalesce("n", F.lit(0.0)).alias("n"))


def window_ratio(windows: DataFrame, over: DataFrame, under: DataFrame) -> DataFrame:
    """(id, ratio): rows of ``over`` per million, plus 0.1, by the same of ``under``, in each window (id, chr, start, end)."""
    x, y = (iv.score_summary(windows, s, key="id").select("id", F.col("n").alias(c)) for s, c in ((over, "n1"), (under, "n2")))
    total = over.agg(F.count(F.lit(1)).alias("t1")).crossJoin(under.agg(F.count(F.lit(1)).alias("t2")))  # one row
    rate = lambda n, t: F.col(n) * 1e6 / F.col(t) + 0.1
    return x.join(y, "id").join(F.broadcast(total)).select("id", (rate("n1", "t1") / rate("n2", "t2")).alias("ratio"))


def scanned(points: DataFrame, width: int, sizes: DataFrame) -> DataFrame:
    """(chr, pos, count, p): the rolling count at each position and its scan p-value; ``sizes`` (chr, n, length) give the rates, one row per chromosome."""
    s = sizes.select(F.col("chr").alias("c_"), (F.col("n") / F.col("length")).alias("rate_"), F.col("length").cast("double").alias("length_"))
    x = iv.rolling_count(points, width).join(F.broadcast(s), F.col("chr") == F.col("c_"))
    return x.select("chr", "pos", "count", pr.scan_p_value("count", "rate_", F.lit(float(width)), "length_").alias("p"))


def significant_regions(points: DataFrame, widths: list[int], alpha: float) -> DataFrame:
    """(width, chr, start, end, n): merged windows whose count is at or above the first one with a scan p-value below ``alpha``.

    The critical count is found for each chromosome (one row each on the driver) and width.
    """
    stats = points.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("length")).collect()
    out = None
    for width in widths:
        limits = [(r["chr"], pr.critical_value(r["n"] / r["length"], float(width), float(r["length"]), alpha)) for r in stats if r["length"]]
        limit = points.sparkSession.createDataFrame(limits, "c_ string, least_ long")
        hit = iv.rolling_count(points, width).join(F.broadcast(limit), F.col("chr") == F.col("c_")).where(F.col("count") >= F.col("least_"))
        x = iv.islands(hit.select("chr", F.col("pos").alias("start"), (F.col("pos") + width).alias("end"))).select(F.lit(width).alias("width"), "chr", "start", "end", "n")
        out = x if out is None else out.union(x)
    return out


def two_sample_scan(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(chr, pos, a, b, ratio): at every position of either sample (chr, pos) both rolling counts and (a + 1) / (b * scale + 1), its negative reciprocal below 1.

    scale: rows of ``a`` by rows of ``b``.
    """
    both = a.select("chr", "pos").distinct().union(b.select("chr", "pos").distinct()).distinct()
    mark = lambda df: df.select("chr", "pos", F.lit(1).alias("w"))
    x = _weighted_rolling(both, mark(a), width, "a").join(_weighted_rolling(both, mark(b), width, "b"), ["chr", "pos"])
    total = a.agg(F.count(F.lit(1)).alias("ta")).crossJoin(b.agg(F.count(F.lit(1)).alias("tb")))  # one row
    r = (F.col("a") + 1) / (F.col("b") * F.col("ta") / F.col("tb") + 1)
    return x.join(F.broadcast(total)).select("chr", "pos", "a", "b", F.when(r < 1, -1 / r).otherwise(r).alias("ratio"))


def _weighted_rolling(at: DataFrame, points: DataFrame, width: int, name: str) -> DataFrame:
    """Sum of ``w`` over [pos, pos + width) at every position of ``at``; spans get a copy of the first ``width`` positions of the next."""
    per = points.groupBy("chr", "pos").agg(F.sum("w").alias("w")).withColumn("own", F.lit(0))
    x = per.unionByName(at.select("chr", "pos", F.lit(0).alias("w"), F.lit(1).alias("own"))).withColumn("span_", F.floor(F.col("pos") / iv.SPAN))
    halo = x.where((F.col("own") == 0) & (F.pmod(F.col("pos"), F.lit(iv.SPAN)) < width)).withColumn("span_", F.col("span_") - 1)
    w = Window.partitionBy("chr", "span_").orderBy("pos").rangeBetween(0, width - 1)
    return x.unionByName(halo).withColumn(name, F.sum("w").over(w)).where("own = 1").select("chr", "pos", name)


def contiguous(points: DataFrame, gap: int) -> DataFrame:
    """Points (chr, pos, value) with ``region``, the first position of their region: regions part where neighbours are ``gap`` or more apart.

    A last point of a chromosome that is a region of its own is dropped.
    """
    at = iv.islands(points.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), gap=gap - 1)
    last = points.groupBy("chr").agg(F.max("pos").alias("last_"))
    kept = at.join(last, "chr").where(~((F.col("n") == 1) & (F.col("start") == F.col("last_")))).select("chr", F.col("start").alias("region"), "start", "end")
    p = iv.overlap_join(points.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "pos", "value"), kept)
    return p.select("chr", "pos", "value", F.col("o_region").alias("region"))


def probe_sums(points: DataFrame, gap: int, width: int) -> DataFrame:
    """(chr, pos, region, total): sum over each probe and the ``width`` next ones of its region; probes too near the region's end give none."""
    w = Window.partitionBy("chr", "region").orderBy("pos")
    x = contiguous(points, gap).withColumns({"total": F.sum("value").over(w.rowsBetween(0, width)), "n": F.count(F.lit(1)).over(w.rowsBetween(0, width))})
    return x.where(F.col("n") == width + 1).select("chr", "pos", "region", "total")


def pile_up(starts: DataFrame, width: int) -> DataFrame:
    """(chr, strand, start, n): starts (chr, strand, pos) in tumbling windows."""
    return starts.groupBy("chr", "strand", (F.floor(F.col("pos") / width) * width).cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n"))


def _draw(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def shuffled_scores(df: DataFrame, seed: int, key: str = "name") -> DataFrame:
    """Rows (key, chr, score) with the scores dealt anew within each chromosome, by hash order."""
    own = Window.partitionBy("chr").orderBy(key)
    other = Window.partitionBy("chr").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key)
    x = df.select(key, "chr", F.row_number().over(own).alias("r"))
    y = df.select(F.col("chr").alias("c_"), F.row_number().over(other).alias("r_"), "score")
    return x.join(y, (F.col("chr") == F.col("c_")) & (F.col("r") == F.col("r_"))).select(key, "chr", "score")


def placed_anew(df: DataFrame, sizes: DataFrame, seeds: int) -> DataFrame:
    """(perm, name, chr, start, end): every interval ``seeds`` times at a place of its chromosome (chr, length) that its hash picks, its length kept."""
    x = df.join(F.broadcast(sizes.select(F.col("chr").alias("c_"), "length")), F.col("chr") == F.col("c_")).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    room = F.greatest(F.col("length") - (F.col("end") - F.col("start")), F.lit(1))
    start = F.pmod(_draw(F.col("perm"), F.col("name")), room)
    return x.select("perm", "name", "chr", start.alias("start"), (start + F.col("end") - F.col("start")).alias("end"))


def overlap_significance(a: DataFrame, b: DataFrame, sizes: DataFrame, seeds: int) -> DataFrame:
    """One row: rows of ``a`` that overlap ``b``, and the share of permutations with as many or more."""
    observed = iv.semi(a, b).agg(F.count(F.lit(1)).alias("observed"))
    hits = iv.semi(placed_anew(a, sizes, seeds), b).groupBy("perm").agg(F.count(F.lit(1)).alias("n"))
    every = a.sparkSession.range(1, seeds + 1).select(F.col("id").cast("int").alias("perm")).join(hits, "perm", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.join(F.broadcast(observed)).groupBy("observed").agg((F.sum((F.col("n") >= F.col("observed")).cast("int")) / seeds).alias("p"))


def hit_probability(b: DataFrame, sizes: DataFrame, size: int, draws: int) -> DataFrame:
    """One row: the share of ``draws`` random intervals of ``size`` that overlap ``b``, and the share of bases that ``b`` covers.

    A draw falls on the concatenated chromosomes (one row each), so longer ones get more.
    """
    w = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("before", F.coalesce(F.sum("length").over(w), F.lit(0)))
    total = sizes.agg(F.sum("length").alias("t")).first()["t"]
    d = b.sparkSession.range(1, draws + 1).select("id", F.pmod(_draw(F.lit("hit"), F.col("id")), F.lit(total)).alias("g"))
    d = d.join(F.broadcast(at), (F.col("g") >= F.col("before")) & (F.col("g") < F.col("before") + F.col("length")))
    d = d.select("id", "chr", (F.col("g") - F.col("before")).alias("start"), (F.col("g") - F.col("before") + size).alias("end"))
    hit = iv.semi(d, b).agg((F.count(F.lit(1)) / draws).alias("hit"))
    cover = iv.covered_bases(b).agg((F.sum("covered") / total).alias("covered"))
    return hit.join(F.broadcast(cover))


def indexed(df: DataFrame) -> DataFrame:
    """Rows with ``index``, their 0-based place by (start, end, name) on the chromosome."""
    x = df.withColumn("span_", F.floor(F.col("start") / iv.SPAN))
    x = iv.carried(x, ["chr"], "span_", {"sum:before_": F.lit(1)})
    w = Window.partitionBy("chr", "span_").orderBy("start", "end", "name")
    return x.withColumn("index", F.coalesce("before_", F.lit(0)) + F.row_number().over(w) - 1).drop("span_", "before_")


def chromosome_order(chrom: Column) -> list[Column]:
    """Sort keys: numbered chromosomes by number first, others by name."""
    number = F.regexp_extract(chrom, r"^[A-Za-z]*(\d+)$", 1).try_cast("long")
    return [number.isNull(), number, chrom]


def excluded(s: Column, e: Column, rs: Column, re: Column) -> Column:
    """One or two pieces, as an array, of [s, e) without [rs, re)."""
    parts = F.array(F.struct(s.alias("start"), F.least(e, rs).alias("end")), F.struct(F.greatest(s, re).alias("start"), e.alias("end")))
    return F.filter(parts, lambda p: p["start"] < p["end"])


def anchor_points(points: DataFrame, sets: int) -> DataFrame:
    """(chr, pos) that ``sets`` different sets (set, chr, pos) have."""
    return points.groupBy("chr", "pos").agg(F.count_distinct("set").alias("n")).where(F.col("n") == sets).select("chr", "pos")


def duplicates(pairs: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """(keys, n, names): read pairs of which all keys are equal, more than one of a kind; names in order."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names")).where("n > 1")


def library_size(pairs: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each value of ``by``: pairs, different ones, and the share of duplicates."""
    kinds = pairs.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("m"))
    return kinds.groupBy(by).agg(F.sum("m").alias("pairs"), F.count(F.lit(1)).alias("different"), (1 - F.count(F.lit(1)) / F.sum("m")).alias("duplicated"))
