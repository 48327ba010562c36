"""Mixing sources to target weights by weighted fair queueing (operator 2). DataFrame functions only.

Each source's documents are put in a fixed shuffled order (md5 of a seed and the id) and may be sent up to
``max_repeats`` times in that order. A document's *virtual finish time* is the words that its source has sent
with it, divided by the source's target. All sends are ordered by finish time across the sources, and the
order is cut off where the budget is used up. So every source's share is near its target at any point.

Neither sum runs over a whole source or the whole table in one task: the shuffled order begins with a hash
prefix, so sums per (source, prefix) are taken first and the running sums need only the rows of one prefix;
the cut is found in slices of the finish time, and only the slice that holds it is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, whole_key

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the virtual time 0 to 4 in which the cut is looked for (later sends share the last), twice.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """64-bit hash of the text; null and empty texts differ."""
    return F.xxhash64(text, text.isNull())


def cyclic_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """(source, weight): the sources by code point, null last, get the weights in turn. One row per source is sorted, no documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sizes: DataFrame, share: float, max_repeats: int) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, weight, source_size): ``share`` of all sizes by weight, none above max_repeats times its size.

    The sources are ordered by the budget a unit of weight at which they would be full; those before the
    level that uses the budget up are full, and the others share the rest by weight. A weight of 0 gives 0.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    x = sizes.withColumn("cap", cap).withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    up = Window.orderBy(F.col("full_at").asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("rest", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
    x = x.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    level = F.when((F.col("left") > 0) & (F.col("full_at") * F.col("left") > F.col("rest")), F.col("rest") / F.col("left"))
    x = x.withColumn("level", F.max(level).over(every))
    target = F.when(F.col("weight") > 0, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).otherwise(0.0)
    return x.select("source", "source_size", target.alias("target"))


def _cut(sends: DataFrame, budget: float) -> tuple[float, float, int]:
    """A short span [lo, hi) of finish times in which the budget is used up, and the words before it.

    Slices are powers of two wide, so their bounds are exact; the last one is open until the cut is known to lie before it.
    """
    inf = float("inf")
    lo, hi, width, used = 0.0, inf, 4.0 / SLICES, 0
    for _ in range(12):
        inside = sends.where((F.col("finish") >= F.lit(lo)) & (F.col("finish") < F.lit(hi)))
        k = F.least(F.floor((F.col("finish") - F.lit(lo)) / F.lit(width)), F.lit(SLICES - 1)).cast("long")
        rows = inside.groupBy(k.alias("k")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        run = rows.withColumn("r", F.sum("w").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
        first = run.where(F.col("r") + F.lit(used) > F.lit(budget)).orderBy("k").first()
        if first is None:  # all that is left fits
            return inf, inf, used
        used += first["r"] - first["w"]
        lo += first["k"] * width
        if first["k"] == SLICES - 1 and hi == inf:
            width *= 64
        else:
            hi, width = lo + width, width / SLICES
        if first["n"] <= SLICES:
            break
    return lo, hi, used


def fair_mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_repeats: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, text_hash, size, source_size, target, repeats, taken.

    text_hash: ``text_hash(text)``, which tells rows with one id and source apart. size: words of the whole text (null: 0). The sources' weights are ``weights`` in turn, by code point,
    null last. The mix has ``share`` times all words, no document more than ``max_repeats`` times. repeats:
    how often the mix has the document; taken: its words in it. Reruns give the same rows.

    Empty and null texts have size 0 and are never taken. Rows with one id and source stand next to each
    other in the order, by size and text_hash, and equal rows are told apart by position only. Rows without id
    are ordered by their texts. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = text_hash(F.col("text"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), own.cast("string")))).cast("binary"))
    sized = docs.select("doc_id", "source", own.alias("text_hash"), word_count(F.col("text")).alias("size"), order.alias("h"))
    sized = scratch.cut(sized.withColumn("bucket", F.substring("h", 1, 3)), "sized")

    sums = scratch.cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    target = scratch.cut(water_fill(totals.join(cyclic_weights(totals.select("source"), weights).select(whole_key("source").alias("s"), "weight"), whole_key("source") == F.col("s")).drop("s"), share, max_repeats), "target")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(target.select(whole_key("source").alias("s"), "source_size", "target"), whole_key("source") == F.col("s")).drop("s", "words")
    starts = starts.select(whole_key("source", "bucket").alias("b"), "before", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("within", within).join(starts, whole_key("source", "bucket") == F.col("b"))
    placed = placed.select("doc_id", "source", "text_hash", "size", "h", "source_size", "target", (F.col("before") + F.col("within")).alias("sent"))
    placed = scratch.cut(placed, "placed")

    sends = placed.where("size > 0 and target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    sends = sends.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("sent")) / F.col("target"))
    total = target.agg(F.sum("target").alias("t"), F.sum("source_size").alias("s")).first()
    budget = min(total["t"] or 0.0, share * (total["s"] or 0))
    lo, hi, used = _cut(sends, budget)
    inside = sends.where((F.col("finish") >= F.lit(lo)) & (F.col("finish") < F.lit(hi)))
    running = F.sum("size").over(Window.orderBy("finish", "h", "source", "turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = inside.withColumn("r", running).where(F.col("r") + F.lit(used) <= F.lit(budget))
    cut = edge.groupBy("source", "doc_id", "sent").agg(F.count(F.lit(1)).alias("n"))
    cut = cut.select(whole_key("source", "doc_id", "sent").alias("c"), "n")
    sure = [F.when((F.col("target") > 0) & (F.col("size") > 0) & ((F.lit(t) * F.col("source_size") + F.col("sent")) / F.col("target") < F.lit(lo)), 1).otherwise(0) for t in range(max_repeats)]
    out = placed.join(cut, whole_key("source", "doc_id", "sent") == F.col("c"), "left")
    out = out.withColumn("repeats", sum(sure[1:], sure[0]).cast("long") + F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))
