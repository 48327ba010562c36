"""Queries of counts, scans and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import genes as gn
from loomspan.operators import intervals as iv
from loomspan.operators import tracks as tr
from loomspan.plans.bind import BOTH, GENES, HIT, ITEMS, SPANS, genes, items, query, spans, table


def _points(df):
    return df.select("chr", F.col("start").alias("pos"))


@query(f"""{BOTH}, p AS (SELECT i.name, i.s, i.e, o.s AS a, o.e AS b, max(o.e) OVER (PARTITION BY i.name ORDER BY o.s, o.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM items i JOIN spans o ON {HIT}),
w AS (SELECT name, sum(greatest(least(b, e) - greatest(CASE WHEN a <= r + 2 THEN greatest(r, s) ELSE a END, s), 0)) AS w FROM p GROUP BY name) SELECT name, coalesce(w, 0)::BIGINT AS score FROM items LEFT JOIN w USING (name)""")
def track_stitched_overlap(spark, d):
    return tr.stitched_overlap(items(spark, d), spans(spark, d), 2)


@query(f"""{BOTH}, x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM items),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x), isl AS (SELECT chr, min(s) AS s, max(e) AS e FROM y GROUP BY chr, g)
SELECT o.name, coalesce(sum(CASE WHEN i.s IS NOT NULL THEN least(o.e, i.e) - greatest(o.s, i.s) END), 0)::BIGINT AS covered FROM spans o LEFT JOIN isl i ON {HIT} GROUP BY o.name""")
def track_covered_in(spark, d):
    return tr.covered_in(spans(spark, d), items(spark, d))


@query(f"{BOTH} SELECT o.name, count(i.name) AS n FROM spans o LEFT JOIN items i ON {HIT} AND i.s >= o.s AND i.e <= o.e GROUP BY o.name")
def track_contained_counts(spark, d):
    return tr.contained_counts(spans(spark, d), items(spark, d))


@query(f"{BOTH} SELECT i.name, i.chr, i.s AS start FROM items i WHERE EXISTS (SELECT 1 FROM spans o WHERE {HIT} AND o.strand = '+') AND NOT EXISTS (SELECT 1 FROM spans o WHERE {HIT} AND o.strand = '-')")
def track_unique_overlappers(spark, d):
    o = spans(spark, d)
    return tr.unique_overlappers(items(spark, d), o.where("strand = '+'"), o.where("strand = '-'")).select("name", "chr", "start")


@query(f"WITH {GENES}, {SPANS}, p AS (SELECT DISTINCT o.name, x.name AS read, 1.0::DOUBLE / x.n AS w FROM spans o JOIN ex x ON x.chr = o.chr AND x.s < o.e AND x.e > o.s) SELECT name, round(coalesce(sum(w), 0), 6)::DOUBLE AS n, count(read)::DOUBLE AS reads FROM spans LEFT JOIN p USING (name) GROUP BY name")
def track_read_counts(spark, d):
    b = genes(spark, d).withColumn("w", F.lit(1.0) / F.size("exons")).select(F.col("name").alias("read"), "chr", "w", F.explode("exons").alias("x")).select("read", "chr", "w", F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    o = spans(spark, d)
    return tr.read_counts(o, b, "w").select("name", F.round("n", 6).alias("n")).join(tr.read_counts(o, b).select("name", F.col("n").alias("reads")), "name")


@query(f"""{BOTH}, t AS (SELECT count(*) FILTER (strand = '+') AS t1, count(*) FILTER (strand = '-') AS t2 FROM items), c AS (SELECT o.name, count(i.name) FILTER (i.strand = '+') AS n1, count(i.name) FILTER (i.strand = '-') AS n2 FROM spans o LEFT JOIN items i ON {HIT} GROUP BY o.name)
SELECT name AS id, round((n1 * 1e6::DOUBLE / t1 + 0.1) / (n2 * 1e6::DOUBLE / t2 + 0.1), 6) AS ratio FROM c, t""")
def track_window_ratio(spark, d):
    x = items(spark, d)
    return tr.window_ratio(spans(spark, d).withColumnRenamed("name", "id"), x.where("strand = '+'"), x.where("strand = '-'")).withColumn("ratio", F.round("ratio", 6))


_ROLL = """p AS (SELECT chr, s AS pos, count(*) AS n FROM items GROUP BY ALL), st AS (SELECT chr, sum(n) AS n, max(pos) AS len FROM p GROUP BY chr)"""
_SCAN = """exp((c - 1) * ln(mu) - mu - lgamma(c)) AS pm, list_sum(list_transform(range(0, c::BIGINT), lambda i: exp(i * ln(mu) - mu - lgamma(i + 1)))) AS cd"""
_P = "CASE WHEN c <= 2 THEN 1 ELSE least(abs(1 - cd * exp(-((c - mu) / c * (rate * (len - {w}) * pm)))), 1) END"


@query(f"""WITH {ITEMS}, {_ROLL}, r AS (SELECT chr, pos, sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 499 FOLLOWING)::BIGINT AS c FROM p),
m AS (SELECT r.*, st.n::DOUBLE / len AS rate, st.n::DOUBLE / len * 500 AS mu, len FROM r JOIN st USING (chr)), q AS (SELECT *, {_SCAN} FROM m) SELECT chr, pos, c AS count, round({_P.format(w=500)}, 5) AS p FROM q""")
def track_scanned(spark, d):
    x = _points(items(spark, d))
    sizes = x.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("length"))
    return tr.scanned(x, 500, sizes).withColumn("p", F.round("p", 5))


@query(f"""WITH {ITEMS}, {_ROLL}, w AS (SELECT unnest([300, 1000]) AS w), g AS (SELECT chr, w, len, n::DOUBLE / len AS rate, n::DOUBLE / len * w AS mu, unnest(range(1, 400)) AS c FROM st, w), q AS (SELECT *, {_SCAN} FROM g),
k AS (SELECT chr, w, min(c) AS least FROM q WHERE {_P.format(w='w')} < 0.05 GROUP BY chr, w),
r AS (SELECT 300 AS w, chr, pos, sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 299 FOLLOWING) AS c FROM p UNION ALL SELECT 1000, chr, pos, sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) FROM p),
h AS (SELECT r.w, r.chr, pos AS s, pos + r.w AS e FROM r JOIN k ON k.chr = r.chr AND k.w = r.w AND c >= least), x AS (SELECT *, max(e) OVER (PARTITION BY w, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h),
y AS (SELECT *, sum(CASE WHEN m IS NULL OR s >= m THEN 1 ELSE 0 END) OVER (PARTITION BY w, chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT w::INTEGER AS width, chr, min(s) AS start, max(e) AS "end", count(*) AS n FROM y GROUP BY w, chr, g""")
def track_significant_regions(spark, d):
    return tr.significant_regions(_points(items(spark, d)), [300, 1000], 0.05)


@query(f"""WITH {ITEMS}, b AS (SELECT chr, s AS pos, sum(CASE WHEN strand = '+' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS b FROM items GROUP BY ALL), t AS (SELECT sum(a)::DOUBLE AS ta, sum(b) AS tb FROM b),
r AS (SELECT chr, pos, sum(a) OVER w AS a, sum(b) OVER w AS b FROM b WINDOW w AS (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING)), q AS (SELECT *, (a + 1) / (b * ta / tb + 1) AS x FROM r, t)
SELECT chr, pos, a::BIGINT AS a, b::BIGINT AS b, round(CASE WHEN x < 1 THEN -1 / x ELSE x END, 6) AS ratio FROM q""")
def track_two_sample_scan(spark, d):
    x = items(spark, d)
    return tr.two_sample_scan(_points(x.where("strand = '+'")), _points(x.where("strand = '-'")), 1000).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {ITEMS}, p AS (SELECT chr, s AS pos, sum(score) AS v FROM items GROUP BY ALL), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w < 40 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY chr ORDER BY pos)),
h AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos) AS k FROM g), i AS (SELECT *, min(pos) OVER (PARTITION BY chr, k) AS region FROM h),
z AS (SELECT chr, pos, region, sum(v) OVER w AS total, count(*) OVER w AS n FROM i WINDOW w AS (PARTITION BY chr, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT chr, pos, region, total FROM z WHERE n = 4""")
def track_probe_sums(spark, d):
    x = items(spark, d).groupBy("chr", F.col("start").alias("pos")).agg(F.sum("score").alias("value"))
    return tr.probe_sums(x, 40, 3)


@query(f"WITH {ITEMS} SELECT chr, strand, s // 500 * 500 AS start, count(*) AS n FROM items GROUP BY ALL")
def track_pile_up(spark, d):
    return tr.pile_up(items(spark, d).select("chr", "strand", F.col("start").alias("pos")), 500)


@query(f"""WITH {SPANS}, x AS (SELECT name, chr, row_number() OVER (PARTITION BY chr ORDER BY name) AS r FROM spans), y AS (SELECT chr, score, row_number() OVER (PARTITION BY chr ORDER BY md5('5|' || name), name) AS r FROM spans) SELECT name, chr, score FROM x JOIN y USING (chr, r)""")
def track_shuffled_scores(spark, d):
    return tr.shuffled_scores(spans(spark, d), 5)


_SIZES = "z AS (SELECT chr, max(e) AS len FROM spans GROUP BY chr)"


def _sizes(o):
    return o.groupBy("chr").agg(F.max("end").alias("length"))


@query(f"""{BOTH}, {_SIZES}, a AS (SELECT name, chr, s, e FROM spans), ob AS (SELECT count(*) AS observed FROM a i WHERE EXISTS (SELECT 1 FROM items o WHERE {HIT})),
q AS (SELECT perm, name, chr, ('0x' || substr(md5(perm || '|' || name), 1, 8))::BIGINT % greatest(len - (e - s), 1) AS s, e - s AS n FROM a JOIN z USING (chr), (SELECT unnest(range(1, 11)) AS perm)),
i AS (SELECT perm, name, chr, s, s + n AS e FROM q), h AS (SELECT perm, count(*) AS n FROM i WHERE EXISTS (SELECT 1 FROM items o WHERE {HIT}) GROUP BY perm) SELECT observed, sum(CASE WHEN n >= observed THEN 1 ELSE 0 END) / 10.0::DOUBLE AS p FROM h, ob GROUP BY observed""")
def track_overlap_significance(spark, d):
    o = spans(spark, d)
    return tr.overlap_significance(o, items(spark, d), _sizes(o), 10)


@query(f"""WITH {SPANS}, {_SIZES}, c AS (SELECT chr, len, coalesce(sum(len) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(len) OVER () AS t FROM z),
g AS (SELECT id, ('0x' || substr(md5('hit|' || id), 1, 8))::BIGINT % (SELECT max(t) FROM c) AS g FROM (SELECT unnest(range(1, 5001)) AS id)), i AS (SELECT id, chr, g - b AS s, g - b + 50 AS e FROM g JOIN c ON g >= b AND g < b + len),
x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans)
SELECT (SELECT count(*) FROM i WHERE EXISTS (SELECT 1 FROM spans o WHERE {HIT})) / 5000.0::DOUBLE AS hit, (SELECT sum(greatest(e - greatest(s, coalesce(r, s)), 0)) FROM x) / (SELECT max(t) FROM c)::DOUBLE AS covered""")
def track_hit_probability(spark, d):
    o = spans(spark, d)
    return tr.hit_probability(o, _sizes(o), 50, 5000)


@query(f"WITH {ITEMS} SELECT name, chr, row_number() OVER (PARTITION BY chr ORDER BY s, e, name) - 1 AS \"index\" FROM items")
def track_indexed(spark, d):
    return tr.indexed(items(spark, d)).select("name", "chr", "index")


@query(f"WITH {SPANS}, c AS (SELECT DISTINCT chr FROM spans UNION SELECT 'cX' UNION SELECT 'cM') SELECT chr, row_number() OVER (ORDER BY try_cast(chr[2:] AS BIGINT) IS NULL, try_cast(chr[2:] AS BIGINT), chr) AS position FROM c")
def track_chromosome_order(spark, d):
    from pyspark.sql import Window

    c = spans(spark, d).select("chr").distinct().union(spark.createDataFrame([("cX",), ("cM",)], "chr string")).distinct()
    return c.select("chr", F.row_number().over(Window.orderBy(*tr.chromosome_order(F.col("chr")))).alias("position"))


@query(f"WITH {ITEMS}, p AS (SELECT name, chr, s AS a, least(e, s + 10) AS b FROM items UNION ALL SELECT name, chr, greatest(s, s + 25), e FROM items) SELECT name, chr, a AS start, b AS \"end\" FROM p WHERE a < b")
def track_excluded(spark, d):
    s, e = F.col("start"), F.col("end")
    return items(spark, d).select("name", "chr", F.explode(tr.excluded(s, e, s + 10, s + 25)).alias("p")).select("name", "chr", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@query(f"{BOTH} SELECT chr, s AS pos FROM items INTERSECT SELECT chr, s FROM spans")
def track_anchor_points(spark, d):
    a, b = _points(items(spark, d)).withColumn("set", F.lit("a")), _points(spans(spark, d)).withColumn("set", F.lit("b"))
    return tr.anchor_points(a.union(b), 2)


@query("SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n, string_agg(l_orderkey || '.' || l_linenumber, ' ' ORDER BY l_orderkey || '.' || l_linenumber) AS names FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def track_duplicates(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"))
    return tr.duplicates(x, ["a", "b"]).select("a", "b", "n", F.array_join("names", " ").alias("names"))


@query("WITH k AS (SELECT l_returnflag AS class, l_partkey, l_suppkey, count(*) AS m FROM lineitem GROUP BY ALL) SELECT class, sum(m)::BIGINT AS pairs, count(*) AS different, 1 - count(*)::DOUBLE / sum(m) AS duplicated FROM k GROUP BY class")
def track_library_size(spark, d):
    return tr.library_size(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "class"), ["l_partkey", "l_suppkey"], "class")


@query(f"{BOTH} SELECT i.name, o.name AS o_name, greatest(i.s, o.s) AS a, least(i.e, o.e) AS b, least(i.s, o.s) AS c, greatest(i.e, o.e) AS d, i.score + o.score AS score FROM items i JOIN spans o ON {HIT}")
def track_pairwise(spark, d):
    """Intersection and union of overlapping pairs; stitching adds the scores."""
    p = iv.overlap_join(items(spark, d), spans(spark, d))
    return p.select("name", "o_name", F.greatest("start", "o_start").alias("a"), F.least("end", "o_end").alias("b"), F.least("start", "o_start").alias("c"), F.greatest("end", "o_end").alias("d"), (F.col("score") + F.col("o_score")).alias("score"))


@query(f"{BOTH} SELECT DISTINCT i.chr, greatest(i.s, o.s) AS start, least(i.e, o.e) AS \"end\" FROM items i JOIN spans o ON {HIT}")
def track_take_intersection(spark, d):
    return iv.intersect(items(spark, d), spans(spark, d)).select("chr", "start", "end")


@query(f"""WITH {GENES}, {ITEMS}, pt AS (SELECT chr, s AS pos FROM items), h AS (SELECT ex.name, k, count(pos) AS n FROM ex LEFT JOIN pt ON pt.chr = ex.chr AND pos >= s AND pos < e GROUP BY ex.name, k) SELECT name, round(stddev_samp(n) / avg(n), 6) AS cv FROM h GROUP BY name HAVING sum(n) > 0 AND count(*) > 1""")
def track_uniformity(spark, d):
    """Coefficient of variation of the counts of a model's exons."""
    x = gn.exon_rows(genes(spark, d)).withColumn("id", F.concat_ws(":", "name", "k"))
    pt = items(spark, d).select("chr", "start", (F.col("start") + 1).alias("end"), "score")
    n = iv.score_summary(x, pt, key="id").select(F.substring_index("id", ":", 1).alias("name"), "n")
    return n.groupBy("name").agg(F.round(F.stddev_samp("n") / F.avg("n"), 6).alias("cv"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).where("t > 0 and k > 1").select("name", "cv")
