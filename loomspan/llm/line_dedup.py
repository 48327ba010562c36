"""Boilerplate lines by distinct-site spread (operator 8). DataFrame functions only.

A line that stands on many sites is boilerplate. Its spread is the number of distinct sites (sources) that
have it. Lines seen too seldom to reach the limit are set aside by a plain count first. For the others a
HyperLogLog sketch of the sites is built for each line hash; sketches are merged by the aggregation, before
and after the shuffle, so a line with a third of all rows costs one small sketch a task. Lines whose estimate
is well above or below the limit are decided by it; those near it are counted exactly.

Only hashes of lines are shuffled until the spread is known; then each document gets the hashes of its own
wide lines, and its lines are filtered in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, fresh, only_ids, whole_key

#: log2 of a sketch's buckets (its standard error is about 0.83 / 2 ** (LG_K / 2)) and the standard errors around the limit within which lines are counted exactly.
LG_K, NEAR_ERRORS = 12, 8.0
#: White space that is left out at a line's ends when lines are compared.
BLANKS = " \t\x0b\f\r"


def line_hash(line: Column) -> Column:
    """64-bit hash of the line without white space at its ends; null for blank lines."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def wide_lines(lines: DataFrame, min_sites: int, scratch: Scratch) -> DataFrame:
    """Hashes of the lines in ``lines`` (hash, site) that at least ``min_sites`` distinct non-null sites have.

    Exact: the estimate decides only lines whose spread can't be on the other side of the limit by NEAR_ERRORS standard errors.
    """
    lines = lines.where("site is not null").select("hash", "site")
    often = scratch.cut(lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("hash"), "often")
    rows = only_ids(lines, "hash", often, often.count())
    spread = rows.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = scratch.cut(spread, "spread")
    margin = max(1.0, NEAR_ERRORS * 0.83 / 2 ** (LG_K / 2) * min_sites)
    sure = spread.where(F.col("sites") >= min_sites + margin).select("hash")
    near = spread.where((F.col("sites") < min_sites + margin) & (F.col("sites") >= min_sites - margin)).select("hash")
    exact = only_ids(lines, "hash", near, near.count()).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("sites"))
    return scratch.cut(sure.union(exact.where(F.col("sites") >= min_sites).select("hash")), "wide")


def remove_wide_lines(docs: DataFrame, min_sites: int = 8, max_share: float | None = None, site: str = "source") -> DataFrame:
    """``docs`` with the lines of ``text`` that at least ``min_sites`` sites have taken out; adds n_lines and n_removed (long).

    Lines are split at line feeds. Compared are lines without white space at their ends, by a 64-bit hash; blank
    lines are never removed. All copies of a wide line go, on every site and on rows without one (a null site
    doesn't count towards the spread). A document whose every line (blank ones apart) is wide is a copy
    rather than a page with boilerplate around its own text; it is left whole, for near-duplicate removal to judge.
    With ``max_share``, so is one of whose lines more than that share are wide. The kept lines stay as they are, in their order. Null texts stay null with 0 lines; an empty
    text is one blank line. Every row is returned once, repeated rows as well. Columns n_lines and n_removed in
    ``docs`` are replaced, all others kept. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    text_hash = F.xxhash64("text")
    parts = F.split("text", "\n", -1)
    lines = docs.select("doc_id", text_hash.alias("th"), F.col(site).cast("string").alias("site"), F.explode(parts).alias("line"))
    lines = lines.select("doc_id", "th", "site", line_hash(F.col("line")).alias("hash")).where("hash is not null")
    lines = scratch.cut(lines, "lines")
    wide = wide_lines(lines, min_sites, scratch)
    gone = only_ids(lines, "hash", wide, wide.count()).groupBy("doc_id", "th").agg(F.collect_set("hash").alias("wide_"))
    of_doc, gone_lines, kept_lines = fresh(docs, "of_doc", "gone_lines", "kept_lines")
    gone = scratch.cut(gone.select(whole_key("doc_id", "th").alias(of_doc), F.col("wide_").alias(gone_lines)), "gone")
    both = docs.join(gone, whole_key("doc_id", text_hash) == F.col(of_doc), "left")
    full = F.size(F.filter(parts, lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    kept = F.filter(parts, lambda x: ~F.coalesce(F.array_contains(gone_lines, line_hash(x)), F.lit(False)))
    n_wide = F.size(parts) - F.size(kept)
    few = F.col(gone_lines).isNotNull() & (n_wide < full if max_share is None else n_wide <= F.lit(max_share) * full)
    out = both.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), kept_lines: F.when(few, kept)})
    out = out.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size(kept_lines), F.lit(0)).cast("long"))
    text = F.coalesce(F.array_join(kept_lines, "\n"), F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_removed")
