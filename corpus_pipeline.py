"""A corpus pipeline of five stages over ``documents``; each stage's result is written as Parquet and read by the next.

Every stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, language_id, line_dedup, mixing, ngram_join
from loomspan.llm.common import Scratch, crc_mod, fresh, only_ids, whole_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower mean probability over its bytes is rejected.
MIN_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language reaches MIN_LANGUAGE_SCORE, go."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    found = language_id.identify(docs.select(*COLUMNS), usable=~held)
    return found.where((F.col("lang_pred") != language_id.NO_LANGUAGE) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least eight sources have are taken out of the texts that have other lines too; n_chars follows the text."""
    out = line_dedup.remove_wide_lines(docs.select(*COLUMNS), min_sites=8)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Rows without id take part under a number from their text, above those of the ids in use. Rows with one id
    are one document: of equal texts one row stays, different texts all stay or go. Texts without words stay, once for each id.
    """
    (own,) = fresh(docs.select(*COLUMNS), "own_id")
    without_id = F.shiftrightunsigned(mixing.text_hash(F.col("text")), 2) + F.lit(1 << 62)
    docs = docs.select(*COLUMNS).withColumn(own, F.coalesce("doc_id", without_id))
    scratch = Scratch(spark)
    groups = scratch.cut(ngram_join.jaccard_components(docs.select(F.col(own).alias("doc_id"), "text"), width=5, num=8, den=10), "groups")
    kept = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n"))
    kept = scratch.cut(kept, "kept")
    several = kept.where("n > 1").select(own)
    n_kept, n_several = kept.count(), several.count()
    out = only_ids(docs, own, kept.where("n = 1").select(own), n_kept)
    if n_several:
        rows = only_ids(docs, own, several, n_several).groupBy(own, mixing.text_hash(F.col("text")).alias("h")).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("r"))
        out = out.select(*COLUMNS).union(rows.select(*[f"r.{c}" for c in COLUMNS]))
    return out.select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the shares of their target weights; a document that the mix takes twice comes twice, one that it doesn't take goes.

    Rows with one id, source and text share what the mix takes of them: each comes as often as it goes round, the rest is made up by one of them.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark)
    taken = mixing.fair_mix(docs, weights=[5.0, 2.0, 1.0], share=1.5, max_repeats=2).groupBy(whole_key("doc_id", "source", "text_hash").alias("key_")).agg(F.sum("repeats").alias("sent_"), F.count(F.lit(1)).alias("rows_"))
    taken = scratch.cut(taken.where("sent_ > 0"), "taken")
    own = docs.withColumn("own_", whole_key(F.col("doc_id"), F.col("source"), mixing.text_hash(F.col("text"))))
    both = own.join(taken.where("sent_ >= rows_").select("key_", F.expr("sent_ div rows_").alias("turns_")), F.col("own_") == F.col("key_"))
    rest = taken.where("sent_ % rows_ > 0").select("key_", (F.col("sent_") % F.col("rows_")).alias("turns_"))
    if n := rest.count():
        some = only_ids(own, "own_", rest.select(F.col("key_").alias("own_")), n).select(*own.columns).dropDuplicates(["own_"])
        both = both.union(some.join(rest, F.col("own_") == F.col("key_")))
    return both.withColumn("turn_", F.explode(F.sequence(F.lit(1), F.col("turns_").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and token_ids (little-endian unsigned 32-bit integers) of every text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, pattern).select("doc_id", "source", "lang", "n_tokens", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("jaccard_join", one_of_each_group),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

#: SQL can't express language ID by a trained network.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.cut(docs, name)
    return docs
