"""Inputs of the queries: the driver's tables as intervals, genes, matrices and sequences, and the same in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.ship import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with the DuckDB SQL for its result."""

    def put(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Interval set A from lineitem: chr, start, end, name, strand, score."""
    start = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long") * 100 + F.col("l_partkey") % 100
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("c"), (F.col("l_suppkey") % 25).cast("string")).alias("chr"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"),
        F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.col("l_quantity").alias("score"),
    )


ITEMS = """items AS (
  SELECT 'c' || (l_suppkey % 25) AS chr, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 100 + l_partkey % 100 AS s,
         date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 100 + l_partkey % 100 + l_quantity::BIGINT AS e,
         concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS name, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_quantity AS score
  FROM lineitem)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Interval set B from orders: chr, start, end, name, strand, score."""
    start = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long") * 100 + F.col("o_custkey") % 100
    return table(spark, d, "orders").select(
        F.concat(F.lit("c"), (F.col("o_orderkey") % 25).cast("string")).alias("chr"),
        start.alias("start"),
        (start + 20 + F.col("o_custkey") % 40).alias("end"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("o_custkey") % 7).cast("double").alias("score"),
    )


SPANS = """spans AS (
  SELECT 'c' || (o_orderkey % 25) AS chr, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 100 + o_custkey % 100 AS s,
         date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 100 + o_custkey % 100 + 20 + o_custkey % 40 AS e,
         'o' || o_orderkey AS name, CASE WHEN o_orderstatus = 'O' THEN '+' ELSE '-' END AS strand, (o_custkey % 7)::DOUBLE AS score
  FROM orders)"""
BOTH = f"WITH {ITEMS},\n{SPANS}"
#: Overlap of i (items) and o (spans).
HIT = "i.chr = o.chr AND i.s < o.e AND i.e > o.s"


def genes(spark: SparkSession, d: str) -> DataFrame:
    """Gene models: one per order, its line numbers' intervals as exons on one axis: name, chr, strand, exons (sorted, disjoint)."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"))
    x = x.select("k", (F.col("k") % 1000 * 5000 + F.col("l_linenumber").cast("long") * 200 + F.col("p") % 50).alias("s"), "q")
    ex = F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), (F.col("s") + F.col("q") + 10).alias("end"))))
    return x.groupBy("k").agg(ex.alias("exons")).select(
        F.concat(F.lit("g"), F.col("k").cast("string")).alias("name"),
        F.concat(F.lit("c"), (F.col("k") % 25).cast("string")).alias("chr"),
        F.when(F.col("k") % 2 == 0, "+").otherwise("-").alias("strand"),
        "exons",
    )


GENES = """exons AS (
  SELECT 'g' || l_orderkey AS name, 'c' || (l_orderkey % 25) AS chr, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         l_orderkey % 1000 * 5000 + l_linenumber::BIGINT * 200 + min(l_partkey) % 50 AS s,
         l_orderkey % 1000 * 5000 + l_linenumber::BIGINT * 200 + min(l_partkey) % 50 + min(l_quantity)::BIGINT + 10 AS e
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
ex AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s, e) AS k, count(*) OVER (PARTITION BY name) AS n,
              lead(s) OVER (PARTITION BY name ORDER BY s, e) AS next_s,
              coalesce(sum(e - s) OVER (PARTITION BY name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
              sum(e - s) OVER (PARTITION BY name)::BIGINT AS len,
              min(s) OVER (PARTITION BY name) AS g0, max(e) OVER (PARTITION BY name) AS g1
       FROM exons)"""


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Long matrix: row = p_brand, col = year shipped, value = summed price in thousands, rounded."""
    li, pa = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(pa, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("row"), F.year("l_shipdate").cast("string").alias("col"))
    return x.agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))


MATRIX = """m AS (
  SELECT p_brand AS "row", year(l_shipdate)::VARCHAR AS col, sum(l_quantity::BIGINT)::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def grouped(spark: SparkSession, d: str) -> DataFrame:
    """Values of two groups for each gene: gene = p_brand, grp = l_returnflag is 'R' or not, sample = customer bucket, value."""
    li, pa = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
    return x.select(F.col("p_brand").alias("gene"), F.when(F.col("l_returnflag") == "R", "a").otherwise("b").alias("grp"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") % 3).alias("batch"))


GROUPED = """v AS (
  SELECT p_brand AS gene, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS grp, l_quantity AS value, l_orderkey % 3 AS batch
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Sequences: the letters A, C, G, T, N of each benchmark text, case kept: id, seq."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace("text", "[^ACGTNacgtn]", "").alias("seq"))


SEQS = """q AS (SELECT item_id AS id, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS seq FROM benchmark)"""
