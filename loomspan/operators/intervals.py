"""Interval algebra on half-open (chr, start, end) frames.

Overlap joins are equi-joins on (chr, bin): each interval is listed once for every bin of ``width`` positions it
touches, and a pair is kept only in the first bin that both touch, so nothing is found twice and no ``distinct``
is needed. Sweeps (islands, depth, nearest) don't need a whole chromosome in one task: positions are cut into
spans, a window runs within a span, and what earlier spans hand on (a running maximum, a sum, a last row) comes
from one aggregate row per span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distance between intervals of different chromosomes.
FAR = 1_000_000_000
#: Positions in a bin of an overlap join, and in a span of a sweep.
BIN, SPAN = 128, 32_768


# ---- predicates and arithmetic on a pair of intervals (start, end columns) ----


def length(s: Column, e: Column) -> Column:
    return e - s


def middle(s: Column, e: Column) -> Column:
    return F.floor((s + e) / 2.0 + 0.5).cast("long")


def location(chrom: Column, s: Column, e: Column) -> Column:
    return F.concat(chrom, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))


def parse_location(text: Column) -> tuple[Column, Column, Column]:
    """chr, start, end of a ``chr:start-end`` literal."""
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return part(1), part(2).cast("long"), part(3).cast("long")


def overlaps(s: Column, e: Column, os: Column, oe: Column, buffer: int = 0) -> Column:
    return (s < oe + buffer) & (e > os - buffer)


def overlap_size(s: Column, e: Column, os: Column, oe: Column) -> Column:
    return F.greatest(F.least(e, oe) - F.greatest(s, os), F.lit(0).cast("long"))


def distance(s: Column, e: Column, os: Column, oe: Column, same_chr: Column | None = None) -> Column:
    """0 for overlapping or touching intervals, else the gap; FAR across chromosomes."""
    gap = F.greatest(F.greatest(s, os) - F.least(e, oe), F.lit(0).cast("long"))
    return gap if same_chr is None else F.when(same_chr, gap).otherwise(F.lit(FAR).cast("long"))


def contains(s: Column, e: Column, os: Column, oe: Column) -> Column:
    return (s <= os) & (e >= oe)


def almost_equal(s: Column, e: Column, os: Column, oe: Column, fudge: int) -> Column:
    return (F.abs(s - os) < fudge) & (F.abs(e - oe) < fudge)


#: Bits of ``relation``.
LESSER, GREATER, OVERLAPPING = 1, 2, 4


def relation(s: Column, e: Column, os: Column, oe: Column) -> Column:
    bits = [F.when(s < os, LESSER).otherwise(0), F.when(e > oe, GREATER).otherwise(0), F.when(overlaps(s, e, os, oe), OVERLAPPING).otherwise(0)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def adjacent(s: Column, e: Column, os: Column, oe: Column) -> Column:
    return (e == os) | (s == oe)


def extend_reads(df: DataFrame, by: int) -> DataFrame:
    """Plus-strand rows grow at the end, others at the start."""
    plus = F.col("strand") == "+"
    return df.withColumns({"start": F.when(plus, F.col("start")).otherwise(F.col("start") - by), "end": F.when(plus, F.col("end") + by).otherwise(F.col("end"))})


def shift(df: DataFrame, by: int) -> DataFrame:
    return df.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def promoter(df: DataFrame, up: int, down: int) -> DataFrame:
    """Plus: [start - up, start + down); others: [end - down, end + up)."""
    plus = F.col("strand") == "+"
    return df.withColumns({"start": F.when(plus, F.col("start") - up).otherwise(F.col("end") - down), "end": F.when(plus, F.col("start") + down).otherwise(F.col("end") + up)})


# ---- overlap joins ----


def _binned(df: DataFrame, prefix: str, width: int, buffer: int = 0) -> DataFrame:
    first = F.floor((F.col("start") - buffer) / width).cast("long")
    last = F.floor((F.greatest(F.col("end") - 1, F.col("start")) + buffer) / width).cast("long")
    return df.withColumn(f"{prefix}first_", first).withColumn("bin_", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", buffer: int = 0, stranded: bool = False, width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals: the columns of ``a`` and those of ``b`` as ``o_<name>``. how: inner or left.

    ``buffer`` pads ``b``; ``stranded`` also asks for equal strands in any case.
    """
    x = _binned(a, "a_", width)
    y = _binned(b, "b_", width, buffer)
    y = y.select(*[F.col(c).alias(f"o_{c}") for c in b.columns], "b_first_", F.col("bin_").alias("o_bin_"))
    on = (F.col("chr") == F.col("o_chr")) & (F.col("bin_") == F.col("o_bin_")) & (F.col("bin_") == F.greatest("a_first_", "b_first_"))
    on &= overlaps(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"), buffer)
    if stranded:
        on &= F.lower("strand") == F.lower("o_strand")
    pairs = x.join(y, on, "inner").select(*a.columns, *[f"o_{c}" for c in b.columns])
    if how == "inner":
        return pairs
    alone = anti(a, b, buffer, stranded, width)
    return pairs.unionByName(alone, allowMissingColumns=True)


def semi(a: DataFrame, b: DataFrame, buffer: int = 0, stranded: bool = False, width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b``."""
    return _exists(a, b, "left_semi", buffer, stranded, width)


def anti(a: DataFrame, b: DataFrame, buffer: int = 0, stranded: bool = False, width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap none of ``b``."""
    return _exists(a, b, "left_anti", buffer, stranded, width)


def _exists(a: DataFrame, b: DataFrame, how: str, buffer: int, stranded: bool, width: int) -> DataFrame:
    """An interval overlaps a set if it overlaps the set's islands; these are disjoint, so the bins hold few rows.

    All rows of an equal (chr, start, end[, strand]) share their answer: it is looked up once for each.
    """
    keys = ["chr", "start", "end"] + (["strand_"] if stranded else [])
    base = a.withColumn("strand_", F.lower("strand")) if stranded else a
    other = b.select("chr", (F.col("start") - buffer).alias("start"), (F.col("end") + buffer).alias("end"), *([F.lower("strand").alias("strand_")] if stranded else []))
    group = ["chr", "strand_"] if stranded else ["chr"]
    whole = islands(other.where(F.col("end") > F.col("start")), group).select(*group, "start", "end")
    points = other.where(F.col("end") == F.col("start")).distinct()
    cover = whole.unionByName(points.select(*whole.columns))
    x = _binned(base.select(*keys).distinct(), "a_", width)
    y = _binned(cover, "b_", width)
    y = y.select(*[F.col(c).alias(f"o_{c}") for c in cover.columns], F.col("bin_").alias("o_bin_"))
    on = (F.col("chr") == F.col("o_chr")) & (F.col("bin_") == F.col("o_bin_")) & overlaps(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))
    if stranded:
        on &= F.col("strand_") == F.col("o_strand_")
    hit = x.join(y, on, "left_semi").select(*keys).distinct()
    return base.join(hit, keys, how).select(*a.columns)


def intersect(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Clipped pairs (chr, start, end, name ``a_b``, score of a); pairs with one span collapse to the smallest name."""
    p = overlap_join(a, b, width=width)
    clipped = p.select("chr", F.greatest("start", "o_start").alias("start"), F.least("end", "o_end").alias("end"), F.concat_ws("_", "name", "o_name").alias("name"), "score")
    return clipped.groupBy("chr", "start", "end").agg(F.min(F.struct("name", "score")).alias("x")).select("chr", "start", "end", "x.name", "x.score")


def score_summary(regions: DataFrame, items: DataFrame, key: str = "name", width: int = BIN) -> DataFrame:
    """For each region: count, sum and mean score of its overlappers (none: 0, 0 and NaN), and bases shared."""
    p = overlap_join(regions, items, width=width)
    size = overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))
    agg = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("o_score").alias("total"), F.sum(size).alias("bases"))
    out = regions.select(key).join(agg, key, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(key, n.alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.when(n > 0, F.col("total") / n).otherwise(F.lit(float("nan"))).alias("mean"), F.coalesce("bases", F.lit(0)).alias("bases"))


# ---- sweeps ----


def carried(df: DataFrame, keys: list[str], span: str, aggs: dict[str, Column], after: bool = False) -> DataFrame:
    """``df`` with, for each name, the aggregate over all rows of the same keys in earlier (``after``: later) spans.

    ``aggs``: name -> (aggregate over rows, how to combine spans) given as a max/min/sum of a column by name prefix
    ``max:``, ``min:`` or ``sum:``. One row per (keys, span) is aggregated first; the window runs over those rows.
    """
    combine = {"max": F.max, "min": F.min, "sum": F.sum}
    kinds = {name: (combine[name.split(":")[0]], name.split(":")[1]) for name in aggs}
    per = df.groupBy(*keys, span).agg(*[fn(aggs[name]).alias(col) for name, (fn, col) in kinds.items()])
    order = F.col(span).desc() if after else F.col(span).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"k_{k}_") for k in [*keys, span]], *[fn(col).over(w).alias(col) for fn, col in kinds.values()])
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"k_{k}_") for k in [*keys, span]])
    return df.join(per, on).drop(*[f"k_{k}_" for k in [*keys, span]])


def _span(position: Column | str, size: int = SPAN) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / size).cast("long")


def islands(df: DataFrame, keys: list[str] | None = None, gap: int = 0, names: bool = False) -> DataFrame:
    """Merged intervals (keys, start, end, n): an interval joins the island before it if it starts before its end + ``gap``.

    Touching intervals stay apart at gap 0. ``names``: also name, the members' names in (start, end, name) order, joined by "-".
    """
    keys = keys or ["chr"]
    x = df.withColumn("span_", _span("start"))
    x = carried(x, keys, "span_", {"max:before_": F.col("end")})
    order = ["start", "end"] + (["name"] if names else [])
    w = Window.partitionBy(*keys, "span_").orderBy(*order)
    reach = F.greatest(F.col("before_"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("new_", F.coalesce((F.col("start") >= reach + gap).cast("int"), F.lit(1)))
    x = carried(x, keys, "span_", {"max:head_": F.when(F.col("new_") == 1, F.col("start"))})
    # equal rows are peers: only the first of them begins an island, and another sort may put it behind the others
    last = F.max(F.when(F.col("new_") == 1, F.col("start"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("island_", F.coalesce(last, F.col("head_")))
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")]
    if names:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "name"))), lambda r: r["name"]), "-").alias("name"))
    return x.groupBy(*keys, "island_").agg(*aggs).drop("island_")


def depth(df: DataFrame) -> DataFrame:
    """Runs of equal depth (chr, start, end, depth), depth above 0: +1/-1 events summed along each chromosome."""
    ends = df.where(F.col("end") > F.col("start"))
    ev = ends.select("chr", F.col("start").alias("pos"), F.lit(1).alias("d")).union(ends.select("chr", F.col("end"), F.lit(-1)))
    ev = ev.groupBy("chr", "pos").agg(F.sum("d").alias("d")).withColumn("span_", _span("pos"))
    ev = carried(ev, ["chr"], "span_", {"sum:before_": F.col("d")})
    ev = carried(ev, ["chr"], "span_", {"min:after_": F.col("pos")}, after=True)
    w = Window.partitionBy("chr", "span_").orderBy("pos")
    here = F.coalesce(F.col("before_"), F.lit(0)) + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = ev.select("chr", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("after_")).alias("end"), here.cast("long").alias("depth"))
    return out.where("depth > 0")


def covered_bases(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bases covered once or more, and the plain sum of lengths, for each key."""
    keys = keys or ["chr"]
    once = islands(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    total = df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    return total.join(once, keys)


def complement(a: DataFrame, b: DataFrame, key: str = "name", width: int = BIN) -> DataFrame:
    """The pieces (key, chr, start, end) of each interval of ``a`` that no interval of ``b`` covers."""
    cover = islands(b.where(F.col("end") > F.col("start")))
    p = overlap_join(a.select(key, "chr", "start", "end"), cover.select("chr", "start", "end"), width=width)
    cut = p.groupBy(key, "chr", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("o_start").alias("s"), F.col("o_end").alias("e")))).alias("c"))
    lows = F.concat(F.array(F.col("start")), F.transform("c", lambda x: x["e"]))
    highs = F.concat(F.transform("c", lambda x: x["s"]), F.array(F.col("end")))
    parts = F.filter(F.arrays_zip(lows.alias("s"), highs.alias("e")), lambda x: x["s"] < x["e"])
    some = cut.select(key, "chr", F.explode(parts).alias("x")).select(key, "chr", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    return some.unionByName(anti(a, b).select(key, "chr", "start", "end"))


def dissect(df: DataFrame) -> DataFrame:
    """Disjoint segments (chr, start, end, depth) cut at every boundary of the intervals."""
    bounds = df.select("chr", F.explode(F.array("start", "end")).alias("pos")).distinct().withColumn("span_", _span("pos"))
    bounds = carried(bounds, ["chr"], "span_", {"min:after_": F.col("pos")}, after=True)
    w = Window.partitionBy("chr", "span_").orderBy("pos")
    segs = bounds.select("chr", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("after_")).alias("end")).where("end is not null")
    p = overlap_join(segs, df.select("chr", "start", "end"))
    return p.groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("depth"))


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each row of ``a`` (chr, start, end, name): nearest (name in b) and distance.

    An overlapper if there is one (the first by start, end, name), else the nearer of the row of ``b`` before it,
    the last by (start, end, name), and the row after it; a tie goes to the one before. No row on the chromosome: null.

    No pairs are made: the first overlapper is the first row of ``b`` that ends behind the row's start, and only a row
    that ends behind all earlier ones can be that (see ``_records``). Frames look back only, in both orders: one that
    reaches to the partition's end is computed anew for each row.
    """
    row = F.struct("start", "end", "name")
    none = F.lit(None).cast("struct<start:bigint,end:bigint,name:string>")
    rows = lambda df, own: df.select("chr", F.col("start").alias("pos"), F.col("end").alias("tail"), F.lit(own).alias("own"), row.cast("struct<start:bigint,end:bigint,name:string>").alias("row"), none.alias("first"))
    # a record stands at its end, before all rows that start there
    records = _records(b).select("chr", F.col("end"), F.lit(-(1 << 63)).cast("long"), F.lit(2), none, row.cast("struct<start:bigint,end:bigint,name:string>"))
    both = rows(a, 1).union(rows(b, 0)).union(records).withColumn("span_", _span("pos"))
    of_b = F.when(F.col("own") == 0, F.col("row"))
    both = carried(both, ["chr"], "span_", {"max:left_": of_b})
    both = carried(both, ["chr"], "span_", {"min:right_": of_b, "min:later_": F.col("first")}, after=True)
    w = Window.partitionBy("chr", "span_").orderBy("pos", "tail", "own").rowsBetween(Window.unboundedPreceding, -1)
    v = Window.partitionBy("chr", "span_").orderBy(F.desc("pos"), F.desc("tail"), F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.max(of_b).over(w), F.col("left_"))
    nxt = F.coalesce(F.min(of_b).over(v), F.col("right_"))
    over = F.coalesce(F.min("first").over(v), F.col("later_"))
    x = both.select("own", "row", prev.alias("p"), nxt.alias("q"), over.alias("h")).where("own = 1")
    x = x.select("row.start", "row.end", "row.name", "p", "q", F.when(overlaps(F.col("row.start"), F.col("row.end"), F.col("h.start"), F.col("h.end")), F.col("h")).alias("hit"))
    gap = lambda c: F.when(F.col(c).isNotNull(), distance(F.col("start"), F.col("end"), F.col(f"{c}.start"), F.col(f"{c}.end")))
    x = x.withColumns({"dp": gap("p"), "dq": gap("q")})
    first = F.col("dp").isNotNull() & (F.col("dq").isNull() | (F.col("dp") <= F.col("dq")))
    return x.select(
        "name",
        F.when(F.col("hit").isNotNull(), F.col("hit.name")).when(first, F.col("p.name")).otherwise(F.col("q.name")).alias("nearest"),
        F.when(F.col("hit").isNotNull(), F.lit(0).cast("long")).when(first, F.col("dp")).otherwise(F.col("dq")).alias("distance"),
    )


def _records(df: DataFrame) -> DataFrame:
    """Rows (chr, start, end, name) that end behind every earlier one by (start, end, name): their starts and ends both ascend."""
    x = df.select("chr", "start", "end", "name", _span("start").alias("span_"))
    x = carried(x, ["chr"], "span_", {"max:before_": F.col("end")})
    w = Window.partitionBy("chr", "span_").orderBy("start", "end", "name").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("reach_", F.greatest(F.col("before_"), F.max("end").over(w)))
    return x.where("reach_ is null or end > reach_").select("chr", "start", "end", "name")


def upstream_downstream(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, upstream: end position of the last row of ``b`` by start that starts before the row; downstream: first start of ``b`` at or after its end + 1."""
    both = a.select("chr", F.col("start").alias("pos"), "end", "name", F.lit(0).alias("kind")).union(b.select("chr", "start", "end", F.lit(None).cast("string"), F.lit(1)))
    both = both.withColumn("row", F.when(F.col("kind") == 1, F.struct("pos", "end"))).withColumn("span_", _span("pos"))
    both = carried(both, ["chr"], "span_", {"max:left_": F.col("row")})
    w = Window.partitionBy("chr", "span_").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, -1)
    up = both.withColumn("u", F.coalesce(F.max("row").over(w), F.col("left_"))).where("kind = 0").select("chr", "end", "name", F.col("u.end").alias("upstream"))
    after = up.select("chr", (F.col("end") + 1).alias("pos"), "name", "upstream", F.lit(0).alias("kind")).union(b.select("chr", "start", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(1)))
    after = after.withColumn("row", F.when(F.col("kind") == 1, F.col("pos"))).withColumn("span_", _span("pos"))
    after = carried(after, ["chr"], "span_", {"min:right_": F.col("row")}, after=True)
    v = Window.partitionBy("chr", "span_").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # looks back: see ``nearest``
    return after.withColumn("d", F.coalesce(F.min("row").over(v), F.col("right_"))).where("kind = 0").select("name", "upstream", F.col("d").alias("downstream"))


# ---- windows over positions ----


def slide(regions: DataFrame, window: int, overlap: int) -> DataFrame:
    """Windows (chr, name, start, end) of each region, starting every window - overlap positions; the first one always, later ones only while they fit."""
    step = window - overlap
    last = F.greatest(F.col("start"), F.col("start") + F.floor((F.col("end") - window - F.col("start")) / step).cast("long") * step)
    starts = F.sequence(F.col("start"), last, F.lit(step).cast("long"))
    return regions.select("chr", "name", F.explode(starts).alias("start")).withColumn("end", F.col("start") + window)


def masked_windows(windows: DataFrame, mask: DataFrame, share: float) -> DataFrame:
    """Windows of which at most ``share`` is masked."""
    keys = ["chr", "name", "start", "end"]
    hit = overlap_join(windows.select(*keys), islands(mask).select("chr", "start", "end"))
    bad = hit.groupBy(*keys).agg(F.sum(overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))).alias("m"))
    return windows.join(bad.where(F.col("m") > share * (F.col("end") - F.col("start"))), keys, "left_anti")


def rolling_count(starts: DataFrame, width: int) -> DataFrame:
    """For each position (chr, pos) that has a row: number of rows with pos in [pos, pos + width). A range frame; spans hand on their neighbours' counts by a copy of their first ``width`` positions."""
    per = starts.groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("span_", _span("pos"))
    halo = per.where(F.pmod(F.col("pos"), F.lit(SPAN)) < width).withColumn("span_", F.col("span_") - 1).withColumn("n0", F.lit(0))
    both = per.withColumn("n0", F.lit(1)).unionByName(halo)
    w = Window.partitionBy("chr", "span_").orderBy("pos").rangeBetween(0, width - 1)
    return both.withColumn("count", F.sum("n").over(w)).where("n0 = 1").select("chr", "pos", "count")


def neighbours(df: DataFrame, most: int) -> DataFrame:
    """Each row (chr, start, end, strand, name) with the next one by (start, end, name): orientation divergent, convergent or same, where their distance is at most ``most``."""
    x = df.withColumn("row", F.struct("start", "end", "name", "strand")).withColumn("span_", _span("start"))
    x = carried(x, ["chr"], "span_", {"min:right_": F.col("row")}, after=True)
    w = Window.partitionBy("chr", "span_").orderBy("start", "end", "name")
    x = x.withColumn("q", F.coalesce(F.lead("row").over(w), F.col("right_"))).where("q is not null")
    d = distance(F.col("start"), F.col("end"), F.col("q.start"), F.col("q.end"))
    kind = F.when(F.col("strand") == F.col("q.strand"), "same").when((F.col("strand") == "-") & (F.col("q.strand") == "+"), "divergent").otherwise("convergent")
    return x.select("name", F.col("q.name").alias("next_name"), kind.alias("orientation"), d.alias("distance")).where(F.col("distance") <= most)
