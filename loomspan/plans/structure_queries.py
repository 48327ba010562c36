"""Queries of set operations on gene models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import genes as gn
from loomspan.operators import structures as st
from loomspan.plans.bind import GENES, ITEMS, SPANS, genes, items, query, spans

_LIST = "string_agg(s || '-' || e, ',' ORDER BY s, e)"
#: All models again with other ends: the first start 5 bases on where the number of exons divides by 3, the last end 7 on where it is even.
VARIANTS = f"""{GENES},
vx AS (SELECT 'v' || name[2:] AS name, chr, strand, k, n, s + CASE WHEN k = 1 AND n % 3 = 0 THEN 5 ELSE 0 END AS s, e + CASE WHEN k = n AND n % 2 = 0 THEN 7 ELSE 0 END AS e FROM ex)"""


def variants(spark, d):
    x, n = F.col("exons"), F.size("exons")
    lo, hi = gn.gene_start(x) + F.when(n % 3 == 0, 5).otherwise(0), gn.gene_end(x) + F.when(n % 2 == 0, 7).otherwise(0)
    first = F.transform(x, lambda e, k: F.struct(F.when(k == 0, lo).otherwise(e["start"]).alias("start"), F.when(k == n - 1, hi).otherwise(e["end"]).alias("end")))
    return genes(spark, d).select(F.concat(F.lit("v"), F.expr("substring(name, 2)")).alias("name"), "chr", "strand", first.alias("exons"))


def single(spark, d):
    """The spans of the orders as models of one exon."""
    return spans(spark, d).select("name", "chr", "strand", F.array(F.struct("start", "end")).alias("exons"))


def _text(x):
    return F.array_join(F.transform(x, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")


def _locus():
    return F.concat_ws(":", "chr", "strand", F.floor(gn.gene_start(F.col("exons")) / 5000).cast("string"))


_LOCUS_SQL = "chr || ':' || strand || ':' || (g0 // 5000)"


@query(f"""WITH {VARIANTS}, a AS (SELECT name, chr, strand, {_LIST} AS x FROM ex GROUP BY ALL), b AS (SELECT DISTINCT chr, strand, x FROM (SELECT name, chr, strand, {_LIST} AS x FROM vx GROUP BY ALL))
SELECT name, b.x IS NOT NULL AS found FROM a LEFT JOIN b USING (chr, strand, x)""")
def structure_exact_sets(spark, d):
    a, b = genes(spark, d), variants(spark, d)
    return st.exact_intersection(a, b).select("name", F.lit(True).alias("found")).union(st.exact_subtraction(a, b).select("name", F.lit(False)))


@query(f"""WITH {GENES}, {SPANS}, r AS (SELECT DISTINCT x.name FROM ex x JOIN spans o ON x.chr = o.chr AND x.strand = o.strand AND x.s < o.e AND x.e > o.s),
t AS (SELECT DISTINCT x.name FROM ex x JOIN ex y ON x.chr = y.chr AND x.strand = y.strand AND x.s < y.e AND x.e > y.s WHERE y.name IN (SELECT name FROM r))
SELECT DISTINCT name, name NOT IN (SELECT name FROM t) AS recursive FROM ex WHERE name NOT IN (SELECT name FROM r)""")
def structure_exon_difference(spark, d):
    a, b = genes(spark, d), single(spark, d)
    far = st.exon_difference(a, b, recursive=True).select("name", F.lit(True).alias("r"))
    return st.exon_difference(a, b).select("name").join(far, "name", "left").select("name", F.coalesce("r", F.lit(False)).alias("recursive"))


@query(f"""WITH {GENES}, {SPANS}, g AS (SELECT name, chr, strand, min(s) AS s, max(e) AS e FROM ex GROUP BY name, chr, strand)
SELECT name, EXISTS (SELECT 1 FROM spans o WHERE o.chr = g.chr AND o.strand = g.strand AND g.s < o.e AND g.e > o.s) AS hit FROM g""")
def structure_span_overlap(spark, d):
    a, b = genes(spark, d), single(spark, d)
    return st.span_overlap(a, b, stranded=True).select("name", F.lit(True).alias("hit")).union(st.span_overlap(a, b, stranded=True, keep=False).select("name", F.lit(False)))


@query(f"WITH {GENES}, {SPANS}, c AS (SELECT DISTINCT x.name AS name, o.name AS region, greatest(x.s, o.s) AS s, least(x.e, o.e) AS e FROM ex x JOIN spans o ON x.chr = o.chr AND x.s < o.e AND x.e > o.s) SELECT name, region, {_LIST} AS exons FROM c GROUP BY name, region")
def structure_clipped(spark, d):
    return st.clipped_to(genes(spark, d), spans(spark, d)).select("name", "region", _text(F.col("exons")).alias("exons"))


@query(f"""WITH {GENES}, {ITEMS}, x AS (SELECT *, max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM items),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x), isl AS (SELECT chr, min(s) AS s, max(e) AS e FROM y GROUP BY chr, g),
h AS (SELECT ex.name, sum(least(ex.e, i.e) - greatest(ex.s, i.s)) AS r FROM ex JOIN isl i ON i.chr = ex.chr AND ex.s < i.e AND ex.e > i.s GROUP BY ex.name)
SELECT DISTINCT name FROM ex LEFT JOIN h USING (name) WHERE coalesce(r, 0) <= 0.2 * len""")
def structure_without_repeats(spark, d):
    return gn.without_repeats(genes(spark, d), items(spark, d), 0.2).select("name")


@query(f"""WITH {VARIANTS}, ei AS (SELECT name, strand, k, n, s, e, lead(s) OVER w AS i FROM ex WINDOW w AS (PARTITION BY name ORDER BY s, e)), vi AS (SELECT name, k, n, s, e, lead(s) OVER w AS i FROM vx WINDOW w AS (PARTITION BY name ORDER BY s, e)),
p AS (SELECT a.name AS name, max(a.n) AS n, count(*) FILTER (a.i IS NOT NULL AND a.e = b.e AND a.i = b.i) AS shared, bool_and(abs(a.s - b.s) < 6 AND abs(a.e - b.e) < 6) AS near FROM ei a JOIN vi b ON b.name = 'v' || a.name[2:] AND a.k = b.k GROUP BY a.name)
SELECT name, shared::INTEGER AS shared, n > 1 AND shared = n - 1 AS same, near AS almost, near AS contains FROM p""")
def structure_compared(spark, d):
    b = variants(spark, d).select(F.concat(F.lit("g"), F.expr("substring(name, 2)")).alias("name"), F.col("strand").alias("o_strand"), F.col("exons").alias("y"))
    p = genes(spark, d).join(b, "name")
    x, y = F.col("exons"), F.col("y")
    return p.select("name", gn.compatible_introns(x, y).alias("shared"), gn.same_introns(x, y).alias("same"), gn.almost_same(x, y, 6).alias("almost"), st.almost_contains(x, F.col("strand"), y, F.col("o_strand"), 6).alias("contains"))


@query(f"""WITH {VARIANTS}, l AS (SELECT name, name[2:] AS locus, s, e FROM ex UNION ALL SELECT name, name[2:], s, e FROM vx), m AS (SELECT locus, count(DISTINCT name) AS models FROM l GROUP BY locus),
ev AS (SELECT locus, p, sum(v) AS v FROM (SELECT locus, s AS p, 1 AS v FROM l UNION ALL SELECT locus, e, -1 FROM l) GROUP BY ALL),
r AS (SELECT locus, p AS start, lead(p) OVER (PARTITION BY locus ORDER BY p) AS "end", sum(v) OVER (PARTITION BY locus ORDER BY p) AS depth FROM ev)
SELECT locus, start, "end" FROM r JOIN m USING (locus) WHERE depth = models""")
def structure_constituent_exons(spark, d):
    both = genes(spark, d).unionByName(variants(spark, d)).withColumn("locus", F.expr("substring(name, 2)"))
    return gn.constituent_exons(both, "locus").select("locus", "start", "end")


@query(f"WITH {GENES} SELECT DISTINCT name FROM ex WHERE n >= 3 AND len >= 120")
def structure_size_filter(spark, d):
    return st.filtered(genes(spark, d), 3, 120).select("name")


@query(f"WITH {GENES}, l AS (SELECT DISTINCT name, {_LOCUS_SQL} AS locus FROM ex) SELECT name FROM l WHERE locus NOT IN (SELECT locus FROM l GROUP BY locus HAVING count(*) > 15)")
def structure_crowded_loci(spark, d):
    return st.crowded_out(genes(spark, d), _locus(), 15).select("name")


@query(f"""WITH {GENES}, c AS (SELECT name, s - CASE WHEN k = 1 THEN CASE WHEN strand = '-' THEN 30 ELSE 12 END ELSE 0 END AS s, e + CASE WHEN k = n THEN CASE WHEN strand = '-' THEN 12 ELSE 30 END ELSE 0 END AS e FROM ex) SELECT name, {_LIST} AS exons FROM c GROUP BY name""")
def structure_extended(spark, d):
    return genes(spark, d).select("name", _text(st.extended(F.col("exons"), F.col("strand"), 12, 30)).alias("exons"))


@query(f"""WITH {GENES}, {ITEMS}, l AS (SELECT chr, strand, arg_max(s, CASE WHEN strand = '-' THEN -k ELSE k END) AS s, arg_max(e, CASE WHEN strand = '-' THEN -k ELSE k END) AS e FROM ex GROUP BY name, chr, strand)
SELECT i.name, i.chr, i.s AS start, EXISTS (SELECT 1 FROM l WHERE l.chr = i.chr AND l.strand = i.strand AND l.s < i.e AND l.e > i.s) AS inside FROM items i
WHERE EXISTS (SELECT 1 FROM l WHERE l.chr = i.chr AND l.strand = i.strand AND l.s - CASE WHEN l.strand = '-' THEN 40 ELSE 0 END < i.e AND l.e + CASE WHEN l.strand = '-' THEN 0 ELSE 40 END > i.s)""")
def structure_last_exon(spark, d):
    a, g = items(spark, d).withColumn("id", F.monotonically_increasing_id()), genes(spark, d)
    keys = ["name", "chr", "start", "end", "strand"]
    hit = st.on_last_exon(a.select(*keys).distinct(), g).select(*keys, F.lit(True).alias("inside"))
    return st.on_last_exon(a.select(*keys), g, or_after=40).join(hit, keys, "left").select("name", "chr", "start", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"""WITH {ITEMS}, {SPANS}, i AS (SELECT DISTINCT o.name, o.chr, o.s, o.e, i.s AS a, i.e AS b FROM spans o JOIN items i ON i.chr = o.chr AND i.s > o.s AND i.e < o.e AND i.e > i.s),
lo AS (SELECT DISTINCT name, p FROM (SELECT name, s AS p FROM spans UNION ALL SELECT name, b FROM i)), hi AS (SELECT DISTINCT name, p FROM (SELECT name, e AS p FROM spans UNION ALL SELECT name, a FROM i)),
w AS (SELECT l.name, l.p AS a, h.p AS b FROM lo l JOIN hi h ON l.name = h.name AND l.p < h.p)
SELECT name, a AS start, b AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.name = w.name AND w.a <= i.a AND i.b <= w.b)""")
def structure_alternative_pieces(spark, d):
    return st.alternative_pieces(spans(spark, d), items(spark, d)).select("name", "start", "end")


_REACH = """u AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r AS (SELECT a AS id, a AS o FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.o = u.a), c AS (SELECT id, min(o) AS low FROM r GROUP BY id)"""


@query(f"""WITH RECURSIVE {GENES}, sh AS (SELECT x.name AS a, y.name AS b, sum(least(x.e, y.e) - greatest(x.s, y.s))::DOUBLE AS w, min(x.len) AS la, min(y.len) AS lb FROM ex x JOIN ex y ON x.chr = y.chr AND x.strand = y.strand AND x.s < y.e AND x.e > y.s AND x.name < y.name GROUP BY ALL),
links AS (SELECT a, b FROM sh WHERE greatest(w / la, w / lb) > 0.5), {_REACH} SELECT DISTINCT name, coalesce(low, name) AS locus FROM ex LEFT JOIN c ON c.id = name""")
def structure_loci(spark, d):
    return st.loci(genes(spark, d), 0.5)


@query(f"""WITH RECURSIVE {GENES}, links AS (SELECT x.name AS a, y.name AS b FROM ex x JOIN ex y ON x.chr = y.chr AND x.strand = y.strand AND x.n = y.n AND x.k = y.k AND x.name < y.name AND abs(x.s - y.s) < 25 AND abs(x.e - y.e) < 25 GROUP BY x.name, y.name, x.n HAVING count(*) = x.n),
{_REACH} SELECT DISTINCT name, coalesce(low, name) AS same_as FROM ex LEFT JOIN c ON c.id = name""")
def structure_fudged_groups(spark, d):
    return st.fudged_groups(genes(spark, d), 25)


@query(f"""WITH {VARIANTS}, a AS (SELECT name, chr, strand, len, string_agg(e || '-' || next_s, ',' ORDER BY s, e) FILTER (next_s IS NOT NULL) AS i FROM ex GROUP BY ALL),
vi AS (SELECT *, lead(s) OVER (PARTITION BY name ORDER BY s, e) AS next_s FROM vx), b AS (SELECT name, chr, strand, string_agg(e || '-' || next_s, ',' ORDER BY s, e) FILTER (next_s IS NOT NULL) AS i FROM vi GROUP BY ALL),
m AS (SELECT chr, strand, i, arg_min(name, (-len, name)) AS isoform, max(len) AS score FROM a WHERE i IS NOT NULL GROUP BY ALL) SELECT b.name, isoform, score FROM b LEFT JOIN m USING (chr, strand, i) WHERE i IS NOT NULL""")
def structure_compatible_isoform(spark, d):
    return st.compatible_isoform(variants(spark, d), genes(spark, d).withColumn("len", gn.transcript_length(F.col("exons"))), "len")


@query(f"""WITH {VARIANTS}, w AS (SELECT name, chr, strand, s + 4 AS s, e + 4 AS e, k FROM vx), p AS (SELECT x.name, greatest(x.s, w.s) AS s, least(x.e, w.e) AS e FROM ex x JOIN w ON w.name = 'v' || x.name[2:] AND x.s < w.e AND x.e > w.s),
i AS (SELECT name, {_LIST} AS inside FROM p GROUP BY name), size AS (SELECT name, sum(e - s)::BIGINT AS n FROM p GROUP BY name), wl AS (SELECT 'g' || name[2:] AS name, sum(e - s)::BIGINT AS n FROM w GROUP BY 1)
SELECT DISTINCT ex.name, coalesce(inside, '') AS inside, ex.len - coalesce(size.n, 0) AS minus, ex.len + wl.n - coalesce(size.n, 0) AS either FROM ex JOIN wl USING (name) LEFT JOIN i USING (name) LEFT JOIN size USING (name)""")
def structure_block_algebra(spark, d):
    moved = F.transform("exons", lambda e: F.struct((e["start"] + 4).alias("start"), (e["end"] + 4).alias("end")))
    b = variants(spark, d).select(F.concat(F.lit("g"), F.expr("substring(name, 2)")).alias("name"), moved.alias("y"))
    x, y = F.col("exons"), F.col("y")
    size = gn.transcript_length
    return genes(spark, d).join(b, "name").select("name", _text(st.block_intersection(x, y)).alias("inside"), size(st.block_minus(x, y)).alias("minus"), size(st.block_union(x, y)).alias("either"))


_SPAN = "g AS (SELECT name, chr, strand, min(s) AS s, max(e) AS e FROM ex GROUP BY name, chr, strand)"


@query(f"WITH {GENES}, {_SPAN}, {SPANS} SELECT g.name AS name, o.name AS o_name, least(g.e, o.e) - greatest(g.s, o.s) AS shared FROM g JOIN spans o ON o.chr = g.chr AND o.strand <> g.strand AND g.s < o.e AND g.e > o.s")
def structure_antisense(spark, d):
    return st.antisense(genes(spark, d), single(spark, d))


@query(f"WITH {GENES}, {_SPAN}, p AS (SELECT a.name AS name, b.name AS o_name, CASE WHEN a.strand = '+' THEN a.s - b.s ELSE b.e - a.e END AS missing FROM g a JOIN g b ON a.chr = b.chr AND a.strand = b.strand AND a.s < b.e AND a.e > b.s) SELECT * FROM p WHERE missing >= 30")
def structure_truncated_start(spark, d):
    g = genes(spark, d)
    return st.truncated(g, g, "5", 30)


@query(f"""WITH {GENES}, {_SPAN}, {SPANS}, x AS (SELECT *, max(e) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans),
y AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS q FROM x), isl AS (SELECT chr, strand, min(s) AS s, max(e) AS e FROM y GROUP BY chr, strand, q)
SELECT g.name, count(*) AS n FROM g JOIN isl o ON o.chr = g.chr AND o.strand = g.strand AND g.s < o.e AND g.e > o.s GROUP BY g.name HAVING count(*) > 1""")
def structure_run_on(spark, d):
    return st.run_on(genes(spark, d), single(spark, d))


@query(f"""WITH {GENES}, i AS (SELECT name, {_LOCUS_SQL} AS locus, max(n) AS n, coalesce(string_agg(e || '-' || next_s, ',' ORDER BY s, e) FILTER (next_s IS NOT NULL), '') AS i FROM ex GROUP BY ALL), c AS (SELECT locus, i, count(*) AS m FROM i GROUP BY ALL)
SELECT locus, sum(m)::BIGINT AS models, sum(CASE WHEN i <> '' THEN m ELSE 0 END)::BIGINT AS spliced, count(*) FILTER (i <> '') AS chains, coalesce(max(m) FILTER (i <> ''), 0)::BIGINT AS most FROM c GROUP BY locus""")
def structure_locus_statistics(spark, d):
    return st.locus_statistics(genes(spark, d), _locus())


@query(f"""WITH {SPANS}, n AS (SELECT 'o' || o_orderkey AS name, 'k' || o_custkey AS new_name FROM orders WHERE o_orderpriority <> '5-LOW'), s AS (SELECT 'o' || o_orderkey AS name, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F')
SELECT n.new_name AS name, chr, spans.s AS start, coalesce(s.score, spans.score) AS score FROM spans JOIN n USING (name) LEFT JOIN s USING (name)""")
def structure_renamed(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name")
    scored = st.with_scores(spans(spark, d), o.where("o_orderstatus = 'F'").select(key, F.col("o_totalprice").alias("score")))
    return st.with_new_names(scored, o.where("o_orderpriority <> '5-LOW'").select(key, F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("new_name"))).select("name", "chr", "start", "score")
