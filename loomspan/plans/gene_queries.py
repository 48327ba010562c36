"""Queries of the gene-model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import genes as gn
from loomspan.operators import intervals as iv
from loomspan.plans.bind import GENES, genes, query, table

#: SQL text of an exon or intron list.
_LIST = "string_agg(s || '-' || e, ',' ORDER BY s, e)"


def _text(x):
    return F.array_join(F.transform(x, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")


@query(f"WITH {GENES} SELECT name, min(g0) AS start, max(g1) AS \"end\", min(len) AS len, count(*)::INTEGER AS n, {_LIST} AS exons FROM ex GROUP BY name")
def gene_summary(spark, d):
    return genes(spark, d).select("name", gn.gene_start(F.col("exons")).alias("start"), gn.gene_end(F.col("exons")).alias("end"), gn.transcript_length(F.col("exons")).alias("len"), F.size(F.col("exons")).alias("n"), _text(F.col("exons")).alias("exons"))


@query(f"WITH {GENES} SELECT name, coalesce(string_agg(e || '-' || next_s, ',' ORDER BY s, e) FILTER (next_s IS NOT NULL), '') AS introns, arg_max(s, CASE WHEN strand = '-' THEN k ELSE -k END) AS five, arg_max(e, CASE WHEN strand = '-' THEN -k ELSE k END) AS three FROM ex GROUP BY name")
def gene_introns_and_ends(spark, d):
    return genes(spark, d).select("name", _text(gn.introns(F.col("exons"))).alias("introns"), gn.five_prime_exon(F.col("exons"), F.col("strand"))["start"].alias("five"), gn.three_prime_exon(F.col("exons"), F.col("strand"))["end"].alias("three"))


@query(f"""WITH {GENES}, p AS (SELECT name, strand, s, e, k, n, before, len, g0, g1, unnest([g0 + 30, g0 + 215, g1 - 1, g1]) AS p FROM ex)
SELECT name, p AS position, coalesce(max(CASE WHEN s <= p AND p < e THEN CASE WHEN strand = '-' THEN len - 1 - (before + p - s) ELSE before + p - s END END), -1)::BIGINT AS place FROM p GROUP BY name, p""")
def gene_to_transcript(spark, d):
    g = genes(spark, d).withColumn("p", F.explode(F.array_distinct(F.array(gn.gene_start(F.col("exons")) + 30, gn.gene_start(F.col("exons")) + 215, gn.gene_end(F.col("exons")) - 1, gn.gene_end(F.col("exons"))))))
    return g.select("name", F.col("p").alias("position"), gn.to_transcript(F.col("exons"), F.col("strand"), F.col("p")).alias("place"))


@query(f"""WITH {GENES}, p AS (SELECT *, unnest([0, 17, 60, 9999]) AS q FROM ex), r AS (SELECT *, CASE WHEN strand = '-' THEN len - 1 - q ELSE q END AS t FROM p)
SELECT name, q::BIGINT AS place, coalesce(max(CASE WHEN q < len AND before <= t AND t < before + e - s THEN s + t - before END), -1)::BIGINT AS position FROM r GROUP BY name, q""")
def gene_to_genome(spark, d):
    g = genes(spark, d).withColumn("q", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 17, 60, 9999)])))
    return g.select("name", F.col("q").alias("place"), gn.to_genome(F.col("exons"), F.col("strand"), F.col("q")).alias("position"))


_TRIM = """r AS (SELECT *, CASE WHEN strand = '-' THEN len - {hi} ELSE {lo} END AS a, CASE WHEN strand = '-' THEN len - {lo} ELSE {hi} END AS b FROM ex WHERE {lo} >= 0 AND {hi} <= len),
c AS (SELECT *, s + greatest(a - before, 0) AS cs, s + least(b - before, e - s) AS ce FROM r)"""


@query(f"WITH {GENES}, {_TRIM.format(lo='10', hi='70')} SELECT name, string_agg(cs || '-' || ce, ',' ORDER BY cs) AS exons FROM c WHERE cs < ce GROUP BY name")
def gene_trim(spark, d):
    return genes(spark, d).select("name", gn.trim(F.col("exons"), F.col("strand"), F.lit(10), F.lit(70)).alias("t")).where("t is not null").select("name", _text(F.col("t")).alias("exons"))


@query(f"WITH {GENES}, {_TRIM.format(lo='(len - 60)', hi='(len - 20)')} SELECT name, string_agg(cs || '-' || ce, ',' ORDER BY cs) AS exons FROM c WHERE cs < ce GROUP BY name")
def gene_from_end(spark, d):
    return genes(spark, d).select("name", gn.from_end(F.col("exons"), F.col("strand"), 40, 20).alias("t")).where("t is not null").select("name", _text(F.col("t")).alias("exons"))


@query(f"WITH {GENES}, w AS (SELECT name, len, min(strand) AS strand FROM ex GROUP BY name, len), p AS (SELECT name, unnest(range(0, len - 49, 25)) AS place FROM w WHERE len >= 50) SELECT name, place FROM p")
def gene_windows(spark, d):
    return gn.windows(genes(spark, d), 50, 25).where("exons is not null").select("name", "place")


@query(f"WITH {GENES}, g AS (SELECT name, list(e - s ORDER BY s, e) AS l, list(next_s - e ORDER BY s, e) AS i FROM ex GROUP BY name) SELECT name, array_to_string(list_transform(range(1, len(l) + 1), lambda k: l[k] || 'M' || coalesce(i[k] || 'N', '')), '') AS cigar FROM g")
def gene_cigar(spark, d):
    return genes(spark, d).select("name", gn.cigar(F.col("exons")).alias("cigar"))


@query(f"WITH {GENES} SELECT name, {_LIST} AS exons FROM ex GROUP BY name HAVING coalesce(bool_and(next_s > e), true)")
def gene_cigar_round_trip(spark, d):
    g = genes(spark, d).where(~F.exists(gn.introns(F.col("exons")), lambda i: i["start"] >= i["end"]))
    return g.select("name", _text(gn.blocks_of(gn.gene_start(F.col("exons")), gn.cigar(F.col("exons")))).alias("exons"))


@query(f"""WITH {GENES}, i AS (SELECT chr, e AS s, next_s AS e, strand FROM ex WHERE next_s IS NOT NULL) SELECT chr, s AS start, e AS "end", strand, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > 1""")
def gene_junction_counts(spark, d):
    return gn.junction_counts(genes(spark, d), 1)


@query(f"""WITH {GENES}, p AS (SELECT a.name AS name, b.name AS o_name, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared, min(a.len) AS len FROM ex a JOIN ex b ON a.chr = b.chr AND a.strand = b.strand AND a.s < b.e AND a.e > b.s AND a.name < b.name GROUP BY ALL)
SELECT name, o_name, shared, round(shared::DOUBLE / len, 6) AS share FROM p""")
def gene_exon_overlap(spark, d):
    g = genes(spark, d)
    return gn.exon_overlap(g, g, less=True).withColumn("share", F.round("share", 6))


@query(f"""WITH {GENES}, x AS (SELECT name, chr, strand, s, e, 'k' || (substr(name, 2)::BIGINT % 1000) AS locus FROM ex),
y AS (SELECT *, max(e) OVER (PARTITION BY locus, chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
z AS (SELECT *, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY locus, chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM y),
m AS (SELECT locus, chr, strand, min(s) AS s, max(e) AS e FROM z GROUP BY locus, chr, strand, g) SELECT locus, chr, strand, {_LIST} AS exons FROM m GROUP BY ALL""")
def gene_merge_by_locus(spark, d):
    g = genes(spark, d).withColumn("locus", F.concat(F.lit("k"), (F.substring("name", 2, 20).cast("long") % 1000).cast("string")))
    return gn.merged_by(g, "locus").select("locus", "chr", "strand", _text(F.col("exons")).alias("exons"))


@query(f"""WITH {GENES}, g AS (SELECT name, chr, min(strand) AS strand, {_LIST} AS x FROM ex GROUP BY ALL) SELECT chr, strand, x AS exons, min(name) AS name FROM g GROUP BY ALL""")
def gene_distinct_structures(spark, d):
    return gn.distinct_structures(genes(spark, d)).select("chr", "strand", _text(F.col("exons")).alias("exons"), "name")


@query(f"""WITH {GENES}, g AS (SELECT name, min(len) AS len, 'k' || (substr(name, 2)::BIGINT % 1000) AS locus FROM ex GROUP BY name) SELECT locus, arg_min(name, (-len, name)) AS name, max(len) AS len FROM g GROUP BY locus""")
def gene_best_per_locus(spark, d):
    g = genes(spark, d).select("name", gn.transcript_length(F.col("exons")).alias("len"), F.concat(F.lit("k"), (F.substring("name", 2, 20).cast("long") % 1000).cast("string")).alias("locus"))
    return gn.best_per_locus(g, "locus", "len")


@query(f"""WITH {GENES}, c AS (SELECT *, g0 + (g1 - g0) // 4 AS c0, g1 - (g1 - g0) // 4 AS c1 FROM ex)
SELECT name, coalesce(sum(greatest(least(e, c1) - greatest(s, c0), 0)), 0)::BIGINT AS coding, (CASE WHEN min(strand) = '-' THEN sum(greatest(e - greatest(s, c1), 0)) ELSE sum(greatest(least(e, c0) - s, 0)) END)::BIGINT AS five FROM c GROUP BY name""")
def gene_utr(spark, d):
    lo, hi = gn.gene_start(F.col("exons")), gn.gene_end(F.col("exons"))
    quarter = F.floor((hi - lo) / 4).cast("long")
    five, coding, _ = gn.five_three_utr(F.col("exons"), F.col("strand"), lo + quarter, hi - quarter)
    return genes(spark, d).select("name", gn.transcript_length(coding).alias("coding"), gn.transcript_length(five).alias("five"))


@query(f"""WITH {GENES}, p AS (SELECT 'c' || (o_custkey % 25) AS chr, o_orderkey % 1000 * 5000 + o_custkey % 1600 AS pos FROM orders),
c AS (SELECT ex.name AS name, count(*) AS n, min(len) AS len FROM ex JOIN p ON p.chr = ex.chr AND s <= pos AND pos < e GROUP BY ex.name)
SELECT name, n, round(n * 1e9::DOUBLE / (len * (SELECT sum(n) FROM c)), 4) AS rpkm FROM c""")
def gene_rpkm(spark, d):
    g = genes(spark, d)
    p = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("chr"), (F.col("o_orderkey") % 1000 * 5000 + F.col("o_custkey") % 1600).alias("start"))
    hits = iv.overlap_join(p.withColumn("end", F.col("start") + 1), gn.exon_rows(g)).groupBy(F.col("o_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return gn.rpkm(hits, g).withColumn("rpkm", F.round("rpkm", 4))


@query(f"""WITH {GENES}, p AS (SELECT 'c' || (o_custkey % 25) AS chr, o_orderkey % 1000 * 5000 + o_custkey % 1600 AS pos FROM orders),
h AS (SELECT ex.name AS name, len, CASE WHEN strand = '-' THEN len - 1 - (before + pos - s) ELSE before + pos - s END AS place FROM ex JOIN p ON p.chr = ex.chr AND s <= pos AND pos < e)
SELECT name, (place * 10 // len)::BIGINT AS bin, count(*) AS n FROM h GROUP BY ALL""")
def gene_relative_coverage(spark, d):
    p = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("chr"), (F.col("o_orderkey") % 1000 * 5000 + F.col("o_custkey") % 1600).alias("pos"))
    return gn.relative_coverage(genes(spark, d), p, 10)
