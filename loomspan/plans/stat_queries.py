"""Queries of the matrix and statistics operators. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import matrix as mx
from loomspan.operators import stats as st
from loomspan.plans.bind import GROUPED, MATRIX, grouped, matrix, query, table


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _m(x: str) -> str:
    return f'SELECT "row", col, round({x}, 6) AS value FROM m'


@query(f"WITH {MATRIX} {_m('value - avg(value) OVER (PARTITION BY col)')}")
def matrix_mean_centre_columns(spark, d):
    return _r(mx.centre(matrix(spark, d), "col", "mean"), "value")


@query(f"""WITH {MATRIX} {_m('value - median(value) OVER (PARTITION BY "row")')}""")
def matrix_median_centre_rows(spark, d):
    return _r(mx.centre(matrix(spark, d), "row", "median"), "value")


@query(f"""WITH {MATRIX} {_m('value / median(value) OVER (PARTITION BY col)')}""")
def matrix_median_ratio_columns(spark, d):
    return _r(mx.ratio(matrix(spark, d), "col", "median"), "value")


@query(f"""WITH {MATRIX} {_m('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} WINDOW w AS (PARTITION BY "row")""")
def matrix_z_rows(spark, d):
    return _r(mx.z_normalise(matrix(spark, d), "row"), "value")


@query(f"""WITH {MATRIX}, k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value, "row") AS k FROM m), a AS (SELECT k, avg(value) AS v FROM k GROUP BY k)
SELECT "row", col, round(v, 6) AS value FROM k JOIN a USING (k)""")
def matrix_quantile_normalise(spark, d):
    return _r(mx.quantile_normalise(matrix(spark, d)), "value")


@query(f"""WITH {MATRIX}, g AS (SELECT "row", exp(avg(ln(value))) AS g FROM m GROUP BY "row" HAVING min(value) > 0)
SELECT col, round(1 / median(value / g), 6) AS factor FROM m JOIN g USING ("row") GROUP BY col""")
def matrix_size_factors(spark, d):
    return _r(mx.size_factors(matrix(spark, d)), "factor")


@query(f"""WITH {MATRIX} SELECT "row", value, row_number() OVER (ORDER BY value DESC, "row") AS position FROM m WHERE col = '1995' ORDER BY position LIMIT 10""")
def matrix_top_rows(spark, d):
    return mx.top_rows(matrix(spark, d), "1995", 10).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {MATRIX} SELECT a."row" AS "row", b.col AS col, round(sum(a.value * b.value), 6) AS value FROM m a JOIN (SELECT col AS "row", "row" AS col, value FROM m WHERE "row" < 'Brand#2') b ON a.col = b."row" GROUP BY ALL""")
def matrix_product(spark, d):
    m = matrix(spark, d)
    return _r(mx.product(m, mx.transpose(m.where("row < 'Brand#2'"))), "value")


@query(f"""WITH {MATRIX} SELECT "row", col, round(floor(log2(greatest(value, 3) + 1) * log2(greatest(value, 3) + 1) + 0.5), 6) AS value FROM m""")
def matrix_log_square_round_floor(spark, d):
    return _r(mx.rounded(mx.squared(mx.log2_plus(mx.floored(matrix(spark, d), 3.0), 1.0))), "value")


@query(f"""WITH {MATRIX}, d AS (SELECT p_brand AS "row", min(split_part(p_type, ' ', 1)) AS description FROM part GROUP BY p_brand)
SELECT description, col, median(value) AS value FROM m JOIN d USING ("row") GROUP BY ALL""")
def matrix_collapse_rows(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_brand").alias("row")).agg(F.min(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("description"))
    return mx.collapse_rows(matrix(spark, d), names)


@query(f"""WITH {MATRIX}, c AS (SELECT col, avg(value) AS mu, stddev_samp(value) AS sd FROM m WHERE "row" < 'Brand#3' GROUP BY col) SELECT "row", col, round((value - mu) / sd, 6) AS value FROM m JOIN c USING (col)""")
def matrix_control_z(spark, d):
    m = matrix(spark, d)
    return _r(mx.control_z(m, m.where("row < 'Brand#3'").select("row")), "value")


@query(f"""WITH {MATRIX}, l AS (SELECT "row", col, log2(value + 1) AS value FROM m), k AS (SELECT "row" FROM l GROUP BY "row" HAVING pow(2, max(value) - min(value)) > 1.2) SELECT "row", col, round(value, 6) AS value FROM l WHERE "row" IN (SELECT "row" FROM k)""")
def matrix_invariant_rows(spark, d):
    return _r(mx.invariant_rows(mx.log2_plus(matrix(spark, d), 1.0), 1.2), "value")


@query(f"""WITH {MATRIX} SELECT "row", sum(CASE WHEN col = '1994' THEN value END) AS y1994, sum(CASE WHEN col = '1996' THEN value END) AS y1996 FROM m WHERE "row" NOT IN (SELECT p_brand FROM part WHERE p_brand LIKE '%5') GROUP BY "row" """)
def matrix_pivot_exclude(spark, d):
    out = table(spark, d, "part").where(F.col("p_brand").like("%5")).select(F.col("p_brand").alias("row"))
    w = mx.pivot(mx.exclude_rows(matrix(spark, d), out), ["1994", "1996"])
    return w.select("row", F.col("1994").alias("y1994"), F.col("1996").alias("y1996"))


@query(f"""WITH {MATRIX}, w AS (SELECT "row", sum(CASE WHEN col = '1994' THEN value END) AS a, sum(CASE WHEN col = '1996' THEN value END) AS b FROM m GROUP BY "row") SELECT "row", 'a' AS col, a AS value FROM w UNION ALL SELECT "row", 'b', b FROM w""")
def matrix_melt(spark, d):
    w = mx.pivot(matrix(spark, d), ["1994", "1996"]).select(F.col("row").alias("id"), F.col("1994").alias("a"), F.col("1996").alias("b"))
    return mx.melt(w, "id")


@query(f"""WITH {MATRIX} SELECT a."row", a.col, a.value - b.value AS value FROM m a JOIN (SELECT "row", (col::INTEGER + 1)::VARCHAR AS col, value FROM m) b USING ("row", col)""")
def matrix_minus_previous(spark, d):
    m = matrix(spark, d)
    return mx.combine(m, m.withColumn("col", (F.col("col").cast("int") + 1).cast("string")), lambda a, b: a - b)


@query(f"""WITH {GROUPED}, c AS (SELECT batch, median(value) AS mid FROM v WHERE gene < 'Brand#2' GROUP BY batch) SELECT gene, batch, sum(value - mid) AS total, count(*) AS n FROM v JOIN c USING (batch) GROUP BY ALL""")
def matrix_batch_centre(spark, d):
    return mx.batch_centre(grouped(spark, d), F.col("gene") < "Brand#2").groupBy("gene", "batch").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GROUPED} SELECT gene, median(value) AS med, quantile_cont(value, 0.9) AS q9, round(avg(value), 6) AS mean, sum(value) AS total, min(value) AS lo, max(value) AS hi,
round(stddev_samp(value), 6) AS sd, round(exp(avg(ln(value))), 6) AS geo, round(covar_samp(value, batch), 6) AS cov, round(corr(value, batch), 6) AS r FROM v GROUP BY gene""")
def stats_describe(spark, d):
    x = grouped(spark, d).groupBy("gene").agg(
        st.quantile("value", 0.5).alias("med"), st.quantile("value", 0.9).alias("q9"), st.mean_skipping_nan("value").alias("mean"), F.sum("value").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        st.standard_deviation("value").alias("sd"), st.geometric_mean("value").alias("geo"), F.covar_samp("value", "batch").alias("cov"), F.corr("value", "batch").alias("r"),
    )
    return _r(x, "mean", "sd", "geo", "cov", "r")


@query(f"WITH {GROUPED}, a AS (SELECT gene, median(value) AS median FROM v GROUP BY gene) SELECT gene, median, median(abs(value - median)) AS mad FROM v JOIN a USING (gene) GROUP BY ALL")
def stats_mad(spark, d):
    return st.median_absolute_deviation(grouped(spark, d), ["gene"], "value")


_TWO = f"""{GROUPED}, t AS (SELECT gene, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2, avg(value) FILTER (grp = 'a') AS m1, avg(value) FILTER (grp = 'b') AS m2,
var_samp(value) FILTER (grp = 'a') AS v1, var_samp(value) FILTER (grp = 'b') AS v2 FROM v GROUP BY gene HAVING n1 > 1 AND n2 > 1)"""


@query(f"""WITH {_TWO} SELECT gene, n1, n2, round((m1 - m2) * sqrt(n1 * n2) / ((sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) + 3) * sqrt(n1 + n2)), 6) AS t, round(m1 / m2, 6) AS fold, round(greatest(m1 / m2, m2 / m1), 6) AS abs_fold FROM t""")
def stats_t_and_fold(spark, d):
    x = st.two_groups(grouped(spark, d), "gene", "grp", "a", "b")
    return _r(x.select("gene", "n1", "n2", st.t_statistic(3.0).alias("t"), st.fold().alias("fold"), st.absolute_fold().alias("abs_fold")), "t", "fold", "abs_fold")


@query(f"""WITH {GROUPED}, p AS (SELECT gene, batch, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM v GROUP BY ALL),
t AS (SELECT gene, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM p GROUP BY gene) SELECT gene, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM t WHERE k > 1 AND n > k""")
def stats_anova(spark, d):
    return _r(st.anova_f(grouped(spark, d), "gene", "batch"), "f")


@query(f"""WITH {GROUPED}, r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rk FROM v),
s AS (SELECT gene, sum(rk) FILTER (grp = 'a') AS r1, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2 FROM r GROUP BY gene)
SELECT gene, n1, n2, (r1 - n1 * (n1 + 1) / 2)::DOUBLE AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM s WHERE n1 > 0 AND n2 > 0""")
def stats_mann_whitney(spark, d):
    return _r(st.mann_whitney(grouped(spark, d), "gene", "grp", "a", "b"), "z")


@query(f"""WITH x AS (SELECT p_brand AS gene, l_quantity - l_linenumber * 8 AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY abs(d)) + (count(*) OVER (PARTITION BY gene, abs(d)) - 1) / 2.0 AS rk FROM x)
SELECT gene, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w, round((coalesce(sum(rk) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*)::DOUBLE * (count(*) + 1) * (2 * count(*) + 1) / 24), 6) AS z FROM r GROUP BY gene""")
def stats_signed_rank(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 8).cast("double").alias("y"))
    return _r(st.signed_rank(x, "gene", "x", "y"), "z")


@query(f"""WITH {GROUPED}, p AS (SELECT gene, value, count(*) FILTER (grp = 'a') AS a, count(*) FILTER (grp = 'b') AS b FROM v GROUP BY ALL)
SELECT gene, round(max(g), 6) AS d FROM (SELECT gene, abs((sum(a) OVER w)::DOUBLE / sum(a) OVER (PARTITION BY gene) - (sum(b) OVER w)::DOUBLE / sum(b) OVER (PARTITION BY gene)) AS g FROM p WINDOW w AS (PARTITION BY gene ORDER BY value)) GROUP BY gene""")
def stats_two_sample_ks(spark, d):
    return _r(st.two_sample_ks(grouped(spark, d), "gene", "grp", "a", "b"), "d")


@query(f"""WITH x AS (SELECT p_brand AS gene, l_quantity AS x, l_discount AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT gene, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY gene ORDER BY y) + (count(*) OVER (PARTITION BY gene, y) - 1) / 2.0 AS ry FROM x)
SELECT gene, round(corr(rx, ry), 6) AS rho FROM r GROUP BY gene""")
def stats_spearman(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return _r(st.spearman(x, "gene", "x", "y"), "rho")


@query(f"""WITH {GROUPED} SELECT gene, round(CASE WHEN u > -n THEN u ELSE n END, 6) AS maxmean, round(pt, 6) AS t FROM (
SELECT gene, sum(CASE WHEN value > 25 THEN value - 25 ELSE 0 END) / count(*) AS u, sum(CASE WHEN value <= 25 THEN value - 25 ELSE 0 END) / count(*) AS n, avg(value - 25) / (stddev_samp(value - 25) / sqrt(count(*))) AS pt FROM v GROUP BY gene)""")
def stats_maxmean_paired_t(spark, d):
    x = grouped(spark, d).withColumn("x", F.col("value") - 25)
    return _r(x.groupBy("gene").agg(st.max_mean("x").alias("maxmean"), st.paired_t("x").alias("t")), "maxmean", "t")


@query(f"""WITH {GROUPED}, h AS (SELECT gene, least(floor((value - 1) / 4.9), 9)::BIGINT AS bin, count(*) AS n FROM v WHERE value BETWEEN 1 AND 50 GROUP BY ALL)
SELECT gene, bin, round(1 + bin * 4.9::DOUBLE, 6) AS lo, n, round(coalesce((sum(n) OVER w)::DOUBLE, 0) / sum(n) OVER (PARTITION BY gene), 6) AS below FROM h WINDOW w AS (PARTITION BY gene ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stats_histogram(spark, d):
    return _r(st.histogram(grouped(spark, d), ["gene"], "value", 1.0, 50.0, 10), "lo", "below")


@query(f"""WITH {GROUPED}, h AS (SELECT grp, least(floor((value - 1) / 4.9), 9)::BIGINT AS bin, count(*) AS n FROM v GROUP BY ALL),
a AS (SELECT bin, n / sum(n) OVER () AS p FROM h WHERE grp = 'a'), b AS (SELECT bin, n / sum(n) OVER () AS q FROM h WHERE grp = 'b'),
x AS (SELECT coalesce(p, 0)::DOUBLE AS p, coalesce(q, 0)::DOUBLE AS q FROM a FULL JOIN b USING (bin))
SELECT round(sum((p - q) * (p - q) / (p + q)), 6) AS chi2, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS kl,
round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js FROM x""")
def stats_histogram_distances(spark, d):
    h = st.histogram(grouped(spark, d), ["grp"], "value", 1.0, 50.0, 10)
    return _r(st.histogram_distances(h.where("grp = 'a'").select("bin", "n"), h.where("grp = 'b'").select("bin", "n")), "chi2", "kl", "js")


@query(f"""WITH {GROUPED}, c AS (SELECT gene, batch, count(*)::DOUBLE AS n FROM v GROUP BY ALL), p AS (SELECT gene, n / sum(n) OVER (PARTITION BY gene) AS p FROM c) SELECT gene, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY gene""")
def stats_entropy(spark, d):
    from pyspark.sql import Window

    c = grouped(spark, d).groupBy("gene", "batch").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("gene")))
    return _r(c.groupBy("gene").agg(st.entropy("p").alias("entropy")), "entropy")


def _p_values(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), (((F.col("p_partkey") * 7919) % 10007 + 1) / 10008.0).alias("p"))
    return x


_P = "pv AS (SELECT p_partkey::VARCHAR AS name, ((p_partkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS p FROM part)"


@query(f"WITH {_P}, i AS (SELECT *, row_number() OVER (ORDER BY p DESC, name) AS i FROM pv) SELECT name, p, min(p * i) OVER (ORDER BY i) AS adjusted FROM i")
def stats_hochberg(spark, d):
    return st.hochberg(_p_values(spark, d))


@query(f"WITH {_P}, i AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM pv) SELECT coalesce(max(CASE WHEN p <= i / n * 0.9::DOUBLE THEN p END), min(p)) AS cutoff FROM i")
def stats_fdr_cutoff(spark, d):
    return st.fdr_cutoff(_p_values(spark, d), 0.9)


@query("""WITH o AS (SELECT p_partkey::VARCHAR AS name, p_retailprice AS x FROM part), n AS (SELECT o_totalprice % 2000 AS x FROM orders), c AS (SELECT count(*) AS c FROM n)
SELECT name, x, round(1 - (SELECT count(*) FROM n WHERE n.x < o.x)::DOUBLE / c, 6) AS p FROM o, c""")
def stats_empirical_p(spark, d):
    o = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("x"))
    return _r(st.empirical_p(o, table(spark, d, "orders").select((F.col("o_totalprice") % 2000).alias("x"))), "p")


@query("""WITH g AS (SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, p_retailprice - 1500 AS r, p_type AS set_name FROM part),
n AS (SELECT count(*) AS n FROM g), s AS (SELECT DISTINCT set_name FROM g), k AS (SELECT set_name, count(*) AS k, sum(abs(r)) AS t FROM g GROUP BY set_name),
x AS (SELECT s.set_name, g.pos, sum(CASE WHEN g.set_name = s.set_name THEN abs(r) / t ELSE -1.0::DOUBLE / (n - k) END) OVER (PARTITION BY s.set_name ORDER BY g.pos) AS v FROM s CROSS JOIN g JOIN k ON k.set_name = s.set_name CROSS JOIN n)
SELECT set_name, round(CASE WHEN greatest(max(v), 0) >= -least(min(v), 0) THEN max(v) ELSE least(min(v), 0) END, 6) AS score FROM x GROUP BY set_name""")
def stats_running_sum_enrichment(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part")
    ranked = p.select(F.col("p_partkey").alias("gene"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("pos"), (F.col("p_retailprice") - 1500).alias("r"))
    return _r(st.running_sum_enrichment(ranked, p.select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene"))), "score")


@query("""WITH o AS (SELECT p_partkey::VARCHAR AS name, p_retailprice AS x FROM part), q AS (SELECT o_totalprice % 2100 AS x FROM orders),
r AS (SELECT name, x, CASE WHEN (SELECT count(*) FROM q WHERE q.x >= o.x) = 0 THEN 0.1::DOUBLE ELSE (SELECT count(*) FROM q WHERE q.x >= o.x) / 10.0::DOUBLE / (SELECT count(*) FROM o p WHERE p.x >= o.x) END AS f FROM o)
SELECT name, x, round(least(min(f) OVER (ORDER BY x, name DESC), 1), 6) AS fdr FROM r""")
def stats_permutation_fdr(spark, d):
    o = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("x"))
    return _r(st.permutation_fdr(o, table(spark, d, "orders").select((F.col("o_totalprice") % 2100).alias("x")), 10), "fdr")
