"""Queries of further matrix, statistics and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import sequence as sq
from loomspan.operators import matrix as mx
from loomspan.operators import stats as st
from loomspan.plans.bind import GROUPED, MATRIX, SEQS, grouped, matrix, query, table, texts

_M = '"row", col, value'


@query(f"WITH {MATRIX}, k AS (SELECT *, dense_rank() OVER (ORDER BY \"row\") - 1 AS k FROM m WHERE col IN ('1995', '1997')) SELECT {_M} FROM k WHERE k IN (0, 3, 7, 20)")
def matrix_submatrix(spark, d):
    return mx.submatrix(matrix(spark, d), [0, 3, 7, 20], ["1995", "1997"])


@query(f"WITH {MATRIX} SELECT {_M} FROM m WHERE \"row\" IN (SELECT \"row\" FROM m WHERE col = '1996' AND value < 9500 AND value > 8000)")
def matrix_by_column(spark, d):
    return mx.by_column(matrix(spark, d), "1996", below=9500.0, above=8000.0)


@query(f"WITH {MATRIX}, z AS (SELECT \"row\", col, CASE WHEN col < '1995' THEN 0 ELSE value END AS value FROM m) SELECT DISTINCT col FROM z WHERE value <> 0")
def matrix_non_trivial(spark, d):
    return mx.non_trivial_columns(matrix(spark, d).withColumn("value", F.when(F.col("col") < "1995", 0.0).otherwise(F.col("value"))))


@query(f"WITH {MATRIX} SELECT {_M} FROM m UNION ALL SELECT 'again ' || \"row\", col, value + 1 FROM m")
def matrix_append_rows(spark, d):
    m = matrix(spark, d)
    return mx.append_rows(m, m.select(F.concat(F.lit("again "), F.col("row")).alias("row"), F.concat(F.lit("year "), F.col("col")).alias("col"), (F.col("value") + 1).alias("value")))


@query(f"WITH {MATRIX} SELECT col, (row_number() OVER (PARTITION BY col ORDER BY value, \"row\") - 1)::INTEGER AS rank, value FROM m")
def matrix_sorted_columns(spark, d):
    return mx.sorted_columns(matrix(spark, d))


@query(f"WITH {MATRIX}, f AS (SELECT \"row\", col, floor(value / 100) AS v FROM m) SELECT \"row\", col, rank() OVER (PARTITION BY col ORDER BY v DESC) - 1 + (count(*) OVER (PARTITION BY col, v) - 1) / 2.0::DOUBLE AS value FROM f")
def matrix_ranked_descending(spark, d):
    return mx.ranked(matrix(spark, d).withColumn("value", F.floor(F.col("value") / 100)), "col", descending=True)


@query(f"WITH {MATRIX} SELECT \"row\", col, CASE WHEN value >= 9000 THEN 1 WHEN value <= 8000 THEN -1 ELSE 0 END::DOUBLE AS value FROM m")
def matrix_discretised(spark, d):
    return mx.discretised(matrix(spark, d), 9000.0, 8000.0)


@query(f"WITH {MATRIX}, c AS (SELECT \"row\", col, least(greatest(value, 5000), 9200)::DOUBLE AS value FROM m), w AS (SELECT *, max(value) OVER (PARTITION BY \"row\") AS hi, min(value) OVER (PARTITION BY \"row\") AS lo FROM c) SELECT {_M} FROM w WHERE hi / lo >= 1.2 AND hi - lo >= 1500")
def matrix_preprocessed(spark, d):
    return mx.preprocessed(matrix(spark, d), 5000.0, 9200.0, 1.2, 1500.0)


@query("SELECT l_returnflag AS flag, round(covar_samp(l_quantity, l_discount), 6) AS covariance, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def stats_covariance(spark, d):
    x = st.covariance(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_quantity", "l_discount")
    return x.select("flag", F.round("covariance", 6).alias("covariance"), F.round("sd", 6).alias("sd"))


@query(f"WITH {GROUPED}, a AS (SELECT gene, batch, avg(value) AS m FROM v GROUP BY ALL) SELECT gene, round(avg(m), 6) AS mean FROM a GROUP BY gene")
def stats_mean_of_means(spark, d):
    return st.mean_of_means(grouped(spark, d), "gene", "batch", "value").withColumn("mean", F.round("mean", 6))


_HIST = "h AS (SELECT l_returnflag = 'R' AS r, floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT r, bin, n / sum(n) OVER (PARTITION BY r) AS p FROM h)"


def _hist(spark, d, returned):
    x = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R" if returned else F.col("l_returnflag") != "R")
    return x.groupBy(F.floor(F.col("l_quantity") / 5).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HIST} SELECT round(sum(a.p * log2(a.p / b.p)) + sum(b.p * log2(b.p / a.p)), 9) AS divergence FROM s a JOIN s b ON a.bin = b.bin AND a.r AND NOT b.r")
def stats_symmetric_divergence(spark, d):
    share = lambda h: h.join(F.broadcast(h.agg(F.sum("n").alias("t")))).select("bin", (F.col("n") / F.col("t")).alias("p"))
    return st.symmetric_divergence(share(_hist(spark, d, True)), share(_hist(spark, d, False))).select(F.round("divergence", 9).alias("divergence"))


@query(f"WITH {_HIST} SELECT bin, sum(n)::DOUBLE + 0.5::DOUBLE AS n FROM h GROUP BY bin")
def stats_added_distribution(spark, d):
    return st.added_distribution(_hist(spark, d, True), _hist(spark, d, False), 0.5).select("bin", F.col("n").cast("double").alias("n"))


_RIBO = "c AS (SELECT l_partkey AS name, count(*) FILTER (l_returnflag = 'R') AS ribo, count(*) FILTER (l_returnflag <> 'R') AS rna, avg(l_discount) AS p, count(*) FILTER (l_quantity > 25) AS cds, count(*) FILTER (l_quantity <= 25) AS utr, min(l_suppkey) + 10 AS a, max(l_suppkey) + 20 AS b FROM lineitem GROUP BY 1)"


def _ribo(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    r, q = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(n(r).alias("ribo"), n(~r).alias("rna"), F.avg("l_discount").alias("p"), n(q).alias("cds"), n(~q).alias("utr"), (F.min("l_suppkey") + 10).alias("cds_length"), (F.max("l_suppkey") + 20).alias("utr_length"))


@query(f"WITH {_RIBO} SELECT name, round(CASE WHEN p < 0.0491 THEN (ribo + 1)::DOUBLE / (rna + 1) ELSE -99 END, 6) AS te, round((cds + 1)::DOUBLE / a / ((utr + 1)::DOUBLE / b), 6) AS score FROM c")
def stats_ribosome_scores(spark, d):
    c = _ribo(spark, d)
    return st.translational_efficiency(c, 0.0491).join(st.release_score(c), "name").select("name", F.round("te", 6).alias("te"), F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, least(floor((c_acctbal - lo) * 12 / (hi - lo)), 11)::INTEGER AS bin FROM customer, e")
def stats_expression_bins(spark, d):
    return st.expression_bins(table(spark, d, "customer"), "c_acctbal", 12).select("c_custkey", "bin")


@query(f"WITH {MATRIX}, o AS (SELECT \"row\" AS a, lead(\"row\") OVER (ORDER BY \"row\") AS b FROM (SELECT DISTINCT \"row\" FROM m)) SELECT a, b, round(corr(x.value, y.value), 6) AS r FROM o JOIN m x ON x.\"row\" = a JOIN m y ON y.\"row\" = b AND x.col = y.col GROUP BY a, b")
def stats_neighbour_correlation(spark, d):
    from pyspark.sql import Window

    m = matrix(spark, d)
    names = m.select(F.col("row").alias("a")).distinct()
    pairs = names.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b is not null")
    return st.neighbour_correlation(m, pairs).withColumn("r", F.round("r", 6))


@query(f"WITH {SEQS}, k AS (SELECT id, upper(seq) AS seq, unnest(range(0, greatest(len(seq) - 4, 0))) AS k FROM q) SELECT id, k::INTEGER AS place FROM k WHERE list_sum(list_transform(range(1, 6), lambda i: CASE WHEN seq[k + i] <> 'ACGTA'[i] THEN 1 ELSE 0 END)) <= 2")
def sequence_oligo_places(spark, d):
    return texts(spark, d).select("id", F.explode(sq.oligo_places(F.col("seq"), "ACGTA", 2)).alias("place"))


_GAPS = "g AS (SELECT id, replace(upper(seq), 'A', '-') AS t, lower(seq) AS o FROM q WHERE len(seq) > 12)"


@query(f"""WITH {SEQS}, {_GAPS}, p AS (SELECT *, unnest([0, 3, 9]) AS p FROM g)
SELECT id, p::INTEGER AS place, (CASE WHEN t[p + 1] = '-' THEN -1 ELSE len(replace(t[1 : p], '-', '')) END)::INTEGER AS in_sequence,
coalesce(list_min(list_filter(range(0, len(t)), lambda k: t[k + 1] <> '-' AND len(replace(t[1 : k], '-', '')) = p)), -1)::INTEGER AS in_alignment FROM p""")
def sequence_gap_places(spark, d):
    t = texts(spark, d).where("length(seq) > 12").select("id", F.replace(F.upper("seq"), F.lit("A"), F.lit("-")).alias("t"), F.explode(F.array(*map(F.lit, (0, 3, 9)))).alias("place"))
    return t.select("id", "place", sq.to_sequence(F.col("t"), F.col("place")).alias("in_sequence"), sq.to_alignment(F.col("t"), F.col("place")).alias("in_alignment"))


@query(f"WITH {SEQS}, {_GAPS} SELECT id, array_to_string(list_transform(range(1, len(t) + 1), lambda k: CASE WHEN t[k] = '-' THEN '' ELSE o[k] END), '') AS text FROM g")
def sequence_without_gap_columns(spark, d):
    t = texts(spark, d).where("length(seq) > 12").select("id", F.replace(F.upper("seq"), F.lit("A"), F.lit("-")).alias("t"), F.lower("seq").alias("o"))
    return t.select("id", sq.without_gap_columns(F.col("t"), F.col("o")).alias("text"))


_PROBS = "p AS (SELECT p_partkey AS id, p_size / 100.0::DOUBLE AS a, (50 - p_size) / 100.0::DOUBLE AS c, p_size / 200.0::DOUBLE AS g, (1 - p_size / 100.0::DOUBLE - (50 - p_size) / 100.0::DOUBLE - p_size / 200.0::DOUBLE) AS t FROM part)"


@query(f"""WITH {_PROBS}, i AS (SELECT *, 2 + CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(c) ELSE 0 END + CASE WHEN g > 0 THEN g * log2(g) ELSE 0 END + CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END AS bits FROM p)
SELECT id, round(bits, 6) AS bits, round(t, 6) AS rc_first_a, CASE WHEN bits >= 0.4 THEN 3 ELSE 1 END::INTEGER AS kept,
round(CASE WHEN a > 0 THEN a * log2(a / 0.25) ELSE 0 END + CASE WHEN c > 0 THEN c * log2(c / 0.25) ELSE 0 END + CASE WHEN g > 0 THEN g * log2(g / 0.25) ELSE 0 END + CASE WHEN t > 0 THEN t * log2(t / 0.25) ELSE 0 END + 2, 6) AS divergence FROM i""")
def sequence_weight_matrices(spark, d):
    """Matrices of three columns: even, certain, and one of the part's own; an even first column is trimmed away."""
    s = F.col("p_size")
    own = [s / 100.0, (50 - s) / 100.0, s / 200.0, 1 - s / 100.0 - (50 - s) / 100.0 - s / 200.0]
    even, sure = F.lit(0.25), [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)]
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(*[F.array(o, v, even, o) for o, v in zip(own, sure)]).alias("m"))
    x = x.select("id", F.transform("m", lambda r: F.array(r[2], r[1], r[0])).alias("m"), F.transform("m", lambda r: F.array(r[3], r[1], r[0])).alias("w"))
    flat = F.array(*[F.array(*[F.lit(0.25)] * 3)] * 4)
    size = F.size(sq.trimmed_matrix(F.col("w"), 0.4)[0])
    return x.select("id", F.round(sq.information(F.col("m"))[2], 6).alias("bits"), F.round(sq.reverse_complement_matrix(F.col("m"))[0][0], 6).alias("rc_first_a"), size.alias("kept"), F.round(sq.matrix_divergence(F.col("m"), flat), 6).alias("divergence"))


@query(f"WITH {SEQS}, l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), w AS (SELECT a.x || b.x || c.x AS word FROM l a, l b, l c), k AS (SELECT upper(substr(seq, k, 3)) AS word FROM (SELECT seq, unnest(range(1, greatest(len(seq) - 1, 1))) AS k FROM q)) SELECT w.word, count(k.word) AS n FROM w LEFT JOIN k USING (word) GROUP BY w.word")
def sequence_all_words(spark, d):
    t = texts(spark, d).where("length(seq) >= 3")
    k = t.select(F.explode(F.sequence(F.lit(1), F.length("seq") - 2)).alias("k"), "seq").select(F.upper(F.col("seq").substr(F.col("k"), F.lit(3))).alias("word"))
    return sq.all_words(spark, 3).join(k.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
