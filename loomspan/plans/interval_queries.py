"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import intervals as iv
from loomspan.plans.bind import BOTH, HIT, ITEMS, SPANS, items, query, spans


@query(f"""WITH {ITEMS},
x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM items),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS n FROM y GROUP BY chr, g""")
def interval_merge(spark, d):
    return iv.islands(items(spark, d))


@query(f"""WITH {ITEMS},
x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM items),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r + 15 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e, name ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS n, string_agg(name, '-' ORDER BY s, e, name) AS name FROM y GROUP BY chr, g""")
def interval_stitch(spark, d):
    return iv.islands(items(spark, d), gap=15, names=True)


@query(f"""{BOTH} SELECT i.name AS name, o.name AS o_name, least(i.e, o.e) - greatest(i.s, o.s) AS shared FROM items i JOIN spans o ON {HIT}""")
def interval_overlap_join(spark, d):
    p = iv.overlap_join(items(spark, d), spans(spark, d))
    return p.select("name", "o_name", iv.overlap_size(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end")).alias("shared"))


@query(f"""{BOTH} SELECT i.name AS name, o.name AS o_name FROM items i LEFT JOIN spans o ON {HIT} AND i.strand = o.strand""")
def interval_overlap_left_stranded(spark, d):
    return iv.overlap_join(items(spark, d), spans(spark, d), how="left", stranded=True).select("name", "o_name")


@query(f"""{BOTH} SELECT i.name, i.chr, i.s AS start, i.e AS "end" FROM items i WHERE EXISTS (SELECT 1 FROM spans o WHERE {HIT})""")
def interval_semi(spark, d):
    return iv.semi(items(spark, d), spans(spark, d)).select("name", "chr", "start", "end")


@query(f"""{BOTH} SELECT i.name, i.chr, i.s AS start, i.e AS "end" FROM items i WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE {HIT})""")
def interval_minus(spark, d):
    return iv.anti(items(spark, d), spans(spark, d)).select("name", "chr", "start", "end")


@query(f"""{BOTH} SELECT i.name FROM items i WHERE EXISTS (SELECT 1 FROM spans o WHERE i.chr = o.chr AND i.s < o.e + 10 AND i.e > o.s - 10)""")
def interval_semi_padded(spark, d):
    return iv.semi(items(spark, d), spans(spark, d), buffer=10).select("name")


@query(f"""{BOTH} SELECT i.name FROM items i WHERE EXISTS (SELECT 1 FROM spans o WHERE {HIT} AND i.strand = o.strand)""")
def interval_semi_stranded(spark, d):
    return iv.semi(items(spark, d), spans(spark, d), stranded=True).select("name")


@query(f"""{BOTH}, c AS (SELECT i.chr AS chr, greatest(i.s, o.s) AS s, least(i.e, o.e) AS e, i.name || '_' || o.name AS name, i.score AS score FROM items i JOIN spans o ON {HIT})
SELECT chr, s AS start, e AS "end", min(name) AS name, arg_min(score, name) AS score FROM c GROUP BY chr, s, e""")
def interval_intersect(spark, d):
    return iv.intersect(items(spark, d), spans(spark, d))


@query(f"""{BOTH} SELECT o.name, count(i.name) AS n, coalesce(sum(i.score), 0)::DOUBLE AS total, coalesce(sum(i.score)::DOUBLE / count(i.name), 'NaN'::DOUBLE) AS mean,
coalesce(sum(CASE WHEN i.name IS NOT NULL THEN least(i.e, o.e) - greatest(i.s, o.s) END), 0)::BIGINT AS bases FROM spans o LEFT JOIN items i ON {HIT} GROUP BY o.name""")
def interval_score_summary(spark, d):
    return iv.score_summary(spans(spark, d), items(spark, d))


@query(f"""{BOTH} SELECT i.name, (i.score + CASE WHEN EXISTS (SELECT 1 FROM spans o WHERE {HIT}) THEN 1 ELSE 0 END)::DOUBLE AS score FROM items i""")
def interval_increment_score(spark, d):
    a = items(spark, d)
    hit = iv.semi(a, spans(spark, d)).select("name").withColumn("hit", F.lit(1.0))
    return a.join(hit, "name", "left").select("name", (F.col("score") + F.coalesce("hit", F.lit(0.0))).alias("score"))


@query(f"""{BOTH}, l AS (SELECT i.name AS name, i.s AS s, i.e AS e, i.chr AS chr FROM items i),
b AS (SELECT l.name, arg_max(o.name, {{'s': o.s, 'e': o.e, 'n': o.name}}) AS p, max({{'s': o.s, 'e': o.e, 'n': o.name}}) AS ps FROM l JOIN spans o ON o.chr = l.chr AND (o.s < l.s OR (o.s = l.s AND o.e <= l.e)) GROUP BY l.name),
f AS (SELECT l.name, min({{'s': o.s, 'e': o.e, 'n': o.name}}) AS qs FROM l JOIN spans o ON o.chr = l.chr AND (o.s > l.s OR (o.s = l.s AND o.e > l.e)) GROUP BY l.name),
h AS (SELECT l.name, min({{'s': o.s, 'e': o.e, 'n': o.name}}) AS hs FROM l JOIN spans o ON o.chr = l.chr AND l.s < o.e AND l.e > o.s GROUP BY l.name),
z AS (SELECT l.*, ps, qs, hs, greatest(l.s - ps.e, ps.s - l.e, 0) AS dp, greatest(qs.s - l.e, l.s - qs.e, 0) AS dq FROM l LEFT JOIN b USING (name) LEFT JOIN f USING (name) LEFT JOIN h USING (name))
SELECT name, CASE WHEN hs IS NOT NULL THEN hs.n WHEN ps IS NOT NULL AND (qs IS NULL OR dp <= dq) THEN ps.n ELSE qs.n END AS nearest,
CASE WHEN hs IS NOT NULL THEN 0 WHEN ps IS NOT NULL AND (qs IS NULL OR dp <= dq) THEN dp WHEN qs IS NOT NULL THEN dq END::BIGINT AS distance FROM z""")
def interval_nearest(spark, d):
    return iv.nearest(items(spark, d), spans(spark, d))


@query(f"""{BOTH} SELECT name, (SELECT max({{'s': o.s, 'e': o.e}}).e FROM spans o WHERE o.chr = i.chr AND o.s < i.s) AS upstream,
(SELECT min(o.s) FROM spans o WHERE o.chr = i.chr AND o.s >= i.e + 1) AS downstream FROM items i""")
def interval_upstream_downstream(spark, d):
    return iv.upstream_downstream(items(spark, d), spans(spark, d))


@query(f"""WITH {SPANS}, ev AS (SELECT chr, p, sum(v) AS v FROM (SELECT chr, s AS p, 1 AS v FROM spans UNION ALL SELECT chr, e, -1 FROM spans) GROUP BY chr, p),
r AS (SELECT chr, p AS start, lead(p) OVER (PARTITION BY chr ORDER BY p) AS "end", sum(v) OVER (PARTITION BY chr ORDER BY p)::BIGINT AS depth FROM ev)
SELECT * FROM r WHERE depth > 0""")
def interval_depth(spark, d):
    return iv.depth(spans(spark, d))


@query(f"""WITH {SPANS}, x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans)
SELECT chr, sum(e - s)::BIGINT AS total, sum(greatest(e - greatest(s, coalesce(r, s)), 0))::BIGINT AS covered FROM x GROUP BY chr""")
def interval_covered_bases(spark, d):
    return iv.covered_bases(spans(spark, d))


_ISLANDS = """x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x),
isl AS (SELECT chr, min(s) AS s, max(e) AS e FROM y GROUP BY chr, g)"""


@query(f"""{BOTH}, {_ISLANDS},
p AS (SELECT i.name AS name, i.chr AS chr, i.s AS s, i.e AS e, o.s AS os, o.e AS oe FROM items i LEFT JOIN isl o ON {HIT}),
g AS (SELECT name, chr, CASE WHEN k = 1 THEN s ELSE pe END AS a, CASE WHEN os IS NULL THEN e ELSE os END AS b FROM (
        SELECT *, row_number() OVER w AS k, lag(oe) OVER w AS pe FROM p WINDOW w AS (PARTITION BY name ORDER BY os))
      UNION ALL SELECT name, chr, max(oe), max(e) FROM p WHERE os IS NOT NULL GROUP BY name, chr)
SELECT name, chr, a AS start, b AS "end" FROM g WHERE a < b OR (a = b AND FALSE)""")
def interval_complement(spark, d):
    return iv.complement(items(spark, d), spans(spark, d)).where(F.col("end") > F.col("start"))


@query(f"""WITH {SPANS}, b AS (SELECT DISTINCT chr, p FROM (SELECT chr, s AS p FROM spans UNION ALL SELECT chr, e FROM spans)),
g AS (SELECT chr, p AS s, lead(p) OVER (PARTITION BY chr ORDER BY p) AS e FROM b)
SELECT g.chr AS chr, g.s AS start, g.e AS "end", count(*) AS depth FROM g JOIN spans o ON o.chr = g.chr AND o.s < g.e AND o.e > g.s GROUP BY ALL""")
def interval_dissect(spark, d):
    return iv.dissect(spans(spark, d))


@query(f"""WITH {ITEMS} SELECT name, e - s AS len, floor((s + e) / 2.0 + 0.5)::BIGINT AS middle, chr || ':' || s || '-' || e AS location, chr AS l_chr, s AS l_start, e AS l_end FROM items""")
def interval_projection(spark, d):
    s, e = F.col("start"), F.col("end")
    x = items(spark, d).select("name", iv.length(s, e).alias("len"), iv.middle(s, e).alias("middle"), iv.location(F.col("chr"), s, e).alias("location"))
    chrom, lo, hi = iv.parse_location(F.col("location"))
    return x.withColumns({"l_chr": chrom, "l_start": lo, "l_end": hi})


@query(f"""WITH {SPANS}, x AS (SELECT *, lead(name) OVER w AS n2, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM spans WINDOW w AS (PARTITION BY chr ORDER BY s, e, name))
SELECT name, n2 AS next_name, ((CASE WHEN s < s2 THEN 1 ELSE 0 END) | (CASE WHEN e > e2 THEN 2 ELSE 0 END) | (CASE WHEN s < e2 AND e > s2 THEN 4 ELSE 0 END))::INTEGER AS relation,
e = s2 OR s = e2 AS adjacent, s <= s2 AND e >= e2 AS contains, abs(s - s2) < 30 AND abs(e - e2) < 30 AS near, greatest(s2 - e, s - e2, 0)::BIGINT AS distance FROM x WHERE n2 IS NOT NULL""")
def interval_relations(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("chr").orderBy("start", "end", "name")
    x = spans(spark, d).withColumn("q", F.lead(F.struct("name", "start", "end")).over(w)).where("q is not null")
    p = (F.col("start"), F.col("end"), F.col("q.start"), F.col("q.end"))
    return x.select("name", F.col("q.name").alias("next_name"), iv.relation(*p).alias("relation"), iv.adjacent(*p).alias("adjacent"), iv.contains(*p).alias("contains"), iv.almost_equal(*p, 30).alias("near"), iv.distance(*p).alias("distance"))


@query(f"""WITH {ITEMS} SELECT name, CASE WHEN strand = '+' THEN s - 50 ELSE e - 20 END AS start, CASE WHEN strand = '+' THEN s + 20 ELSE e + 50 END AS "end" FROM items""")
def interval_promoter(spark, d):
    return iv.promoter(items(spark, d), 50, 20).select("name", "start", "end")


@query(f"""WITH {ITEMS} SELECT name, 7 + CASE WHEN strand = '+' THEN s ELSE s - 25 END AS start, 7 + CASE WHEN strand = '+' THEN e + 25 ELSE e END AS "end" FROM items""")
def interval_extend_shift(spark, d):
    return iv.shift(iv.extend_reads(items(spark, d), 25), 7).select("name", "start", "end")


_WINDOWS = """win AS (SELECT chr, name, unnest(generate_series(s, greatest(s, s + (e - 20 - s) // 8 * 8), 8)) AS s FROM spans WHERE e >= s + 20
UNION ALL SELECT chr, name, s FROM spans WHERE e < s + 20)"""


@query(f"""WITH {SPANS}, {_WINDOWS} SELECT chr, name, s AS start, s + 20 AS "end" FROM win""")
def window_slide(spark, d):
    return iv.slide(spans(spark, d), 20, 12)


@query(f"""{BOTH}, {_WINDOWS}, c AS (SELECT w.name, w.s, count(i.name) AS n, sum(i.score) AS total FROM win w LEFT JOIN items i ON i.chr = w.chr AND i.s < w.s + 20 AND i.e > w.s GROUP BY w.name, w.s)
SELECT name, s AS start, n, coalesce(total, 0)::DOUBLE AS total FROM c WHERE n BETWEEN 1 AND 40""")
def window_slide_and_count(spark, d):
    w = iv.slide(spans(spark, d), 20, 12).withColumn("id", F.concat_ws(":", "name", "start"))
    got = iv.score_summary(w, items(spark, d), key="id")
    return w.join(got, "id").where("n between 1 and 40").select("name", "start", "n", "total")


@query(f"""{BOTH}, {_WINDOWS}, mask AS (SELECT chr, s, e FROM items WHERE score >= 48),
x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM mask),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x),
isl AS (SELECT chr, min(s) AS s, max(e) AS e FROM y GROUP BY chr, g),
c AS (SELECT w.chr, w.name, w.s, coalesce(sum(CASE WHEN i.s IS NOT NULL THEN least(i.e, w.s + 20) - greatest(i.s, w.s) END), 0) AS m FROM win w LEFT JOIN isl i ON i.chr = w.chr AND i.s < w.s + 20 AND i.e > w.s GROUP BY ALL)
SELECT chr, name, s AS start, s + 20 AS "end" FROM c WHERE m <= 5""")
def window_masked(spark, d):
    return iv.masked_windows(iv.slide(spans(spark, d), 20, 12), items(spark, d).where("score >= 48"), 0.25)


@query(f"""WITH {ITEMS}, p AS (SELECT chr, s AS pos, count(*) AS n FROM items GROUP BY ALL)
SELECT chr, pos, (sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING))::BIGINT AS count FROM p""")
def window_rolling_count(spark, d):
    return iv.rolling_count(items(spark, d).select("chr", F.col("start").alias("pos")), 1000)


@query(f"""WITH {ITEMS}, p AS (SELECT chr, s AS pos, count(*) AS n FROM items GROUP BY ALL),
c AS (SELECT chr, pos AS s, pos + 1000 AS e, sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING) AS c FROM p),
k AS (SELECT * FROM c WHERE c > 20), x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM k),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT chr, min(s) AS start, max(e) AS "end", count(*) AS n FROM y GROUP BY chr, g""")
def window_scan_genome(spark, d):
    c = iv.rolling_count(items(spark, d).select("chr", F.col("start").alias("pos")), 1000).where("count > 20")
    return iv.islands(c.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1000).alias("end")))


@query(f"""WITH {SPANS}, x AS (SELECT *, lead(name) OVER w AS n2, lead(s) OVER w AS s2, lead(e) OVER w AS e2, lead(strand) OVER w AS t2 FROM spans WINDOW w AS (PARTITION BY chr ORDER BY s, e, name))
SELECT name, n2 AS next_name, CASE WHEN strand = t2 THEN 'same' WHEN strand = '-' AND t2 = '+' THEN 'divergent' ELSE 'convergent' END AS orientation, greatest(s2 - e, s - e2, 0)::BIGINT AS distance
FROM x WHERE n2 IS NOT NULL AND greatest(s2 - e, s - e2, 0) <= 500""")
def interval_neighbours(spark, d):
    return iv.neighbours(spans(spark, d), 500)


@query(f"""WITH {SPANS} SELECT chr, count(*) AS n, sum(e - s)::BIGINT AS bases, max(e) AS length, count(*)::DOUBLE / max(e) AS lambda, (SELECT 1e9::DOUBLE / count(*) FROM spans) AS rpkm FROM spans GROUP BY chr""")
def interval_chromosome_stats(spark, d):
    x = spans(spark, d)
    total = x.agg(F.count(F.lit(1)).alias("all_"))
    per = x.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.max("end").alias("length"))
    return per.join(F.broadcast(total)).select("chr", "n", "bases", "length", (F.col("n") / F.col("length")).alias("lambda"), (F.lit(1e9) / F.col("all_")).alias("rpkm"))


@query(f"""WITH {ITEMS}, {SPANS}, z AS (SELECT CASE WHEN dist <= 0 THEN 0 ELSE dist // 100 + 1 END AS bin FROM (
SELECT i.name, min(greatest(o.s - i.e, i.s - o.e, 0)) AS dist FROM items i JOIN spans o ON o.chr = i.chr GROUP BY i.name, i.chr, i.s, i.e)) SELECT bin::BIGINT AS bin, count(*) AS n FROM z GROUP BY bin""")
def interval_distance_histogram(spark, d):
    x = iv.nearest(items(spark, d), iv.islands(spans(spark, d)).withColumn("name", F.col("start").cast("string")))
    return x.where("distance is not null").groupBy(F.when(F.col("distance") <= 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("distance") / 100).cast("long") + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
