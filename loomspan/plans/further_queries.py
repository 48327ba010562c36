"""Queries of binary alignments, paths, mates, smoothing, edits, regression, dense matrices and support vector machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import probability as pr
from loomspan.functions import sequence as sq
from loomspan.operators import genes as gn
from loomspan.operators import learning as ln
from loomspan.operators import paths as pt
from loomspan.plans.bind import BOTH, GENES, MATRIX, ORACLES, SEQS, genes, items, matrix, query, table, texts
from loomspan.plans.source_queries import _path, _text
from loomspan.sources import bam
from loomspan.sources import formats as fm


@query(ORACLES["source_sam"])
def source_bam(spark, d):
    """Models as spliced binary alignments."""
    path, g = _path(spark), genes(spark, d)
    bam.write_bam(g.where(~F.exists(gn.introns(F.col("exons")), lambda i: i["start"] >= i["end"])), path)
    return fm.passing_reads(bam.read_bam(spark, path), 10).select("name", "chr", "strand", "start", "mapq", _text(F.col("exons")).alias("exons"), "mapped", "duplicate")


_STEPS = f"""WITH RECURSIVE {GENES}, e AS (SELECT DISTINCT s // 25 AS a, next_s // 25 AS b FROM ex WHERE next_s IS NOT NULL AND s // 25 <> next_s // 25)"""


@query(f"""{_STEPS}, w AS (SELECT DISTINCT a AS source, a AS node, [a] AS path FROM e WHERE a NOT IN (SELECT b FROM e)
UNION ALL SELECT source, b, list_append(path, b) FROM w JOIN e ON node = a),
r AS (SELECT source, node AS sink, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS rank, path FROM w WHERE node NOT IN (SELECT a FROM e))
SELECT source, sink, rank::INTEGER AS rank, array_to_string(path, '>') AS path FROM r WHERE rank <= 3""")
def graph_shortest_paths(spark, d):
    """Exons of all models by the 25 bases that they begin in; up to three paths from each first to each last one."""
    starts = F.transform("exons", lambda e: F.expr("0L") + F.floor(e["start"] / 25))
    n = F.greatest(F.size("exons") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(starts, F.lit(1), n).alias("a"), F.slice(starts, F.lit(2), n).alias("b"))
    edges = genes(spark, d).select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    return pt.shortest_paths(edges, 3).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"""WITH {GENES}, m AS (SELECT DISTINCT name, g0 + 5 AS p, g0 + 15 + 200 * j AS q FROM ex, (SELECT unnest([1, 2, 3]) AS j)),
a AS (SELECT m.name, p, q, before + p - s AS t FROM m JOIN ex ON m.name = ex.name AND s <= p AND p < e),
b AS (SELECT a.name, abs(before + q - s - t) AS insert FROM a JOIN ex ON a.name = ex.name AND s <= q AND q < e)
SELECT insert::BIGINT AS insert, count(*) AS n FROM b GROUP BY ALL""")
def pair_insert_sizes(spark, d):
    """Mates that begin five bases into each model and 10 beyond the same place of one of the next exons."""
    g = genes(spark, d)
    left = F.array_min(F.transform("exons", lambda e: e["start"])) + 5
    mates = g.select("name", left.alias("left"), F.explode(F.array(*[left + 10 + 200 * j for j in (1, 2, 3)])).alias("right"))
    return pt.insert_sizes(mates, g)


@query(f"""WITH {MATRIX}, w AS (SELECT "row", col, value, lead(value) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(value, 3) OVER w AS v3 FROM m WINDOW w AS (PARTITION BY "row" ORDER BY col))
SELECT "row", col, round((value + 1.5 * v1 + 1.5 * v2 + v3) / 5, 6) AS smoothed FROM w WHERE v3 IS NOT NULL""")
def track_smoothed(spark, d):
    return pt.smoothed(matrix(spark, d), "row", "col", "value", 4).withColumn("smoothed", F.round("smoothed", 6))


@query(f"""{BOTH}, {GENES}, cover AS (SELECT x.name, x.s, x.e, coalesce(sum(CASE WHEN i.s IS NOT NULL THEN least(x.e, i.e) - greatest(x.s, i.s) END), 0) AS bases FROM ex x LEFT JOIN items i ON i.chr = x.chr AND i.s < x.e AND i.e > x.s GROUP BY ALL),
gaps AS (SELECT name, chr, e AS s, next_s AS e FROM ex WHERE next_s > e),
bare AS (SELECT g.name, g.s, g.e, coalesce(sum(CASE WHEN i.s IS NOT NULL THEN least(g.e, i.e) - greatest(g.s, i.s) END), 0) AS bases FROM gaps g LEFT JOIN items i ON i.chr = g.chr AND i.s < g.e AND i.e > g.s GROUP BY ALL),
a AS (SELECT name, sum(bases) / sum(e - s) AS exonic FROM cover GROUP BY name), b AS (SELECT name, avg(bases / (e - s)) AS intronic FROM bare GROUP BY name)
SELECT name, round(exonic, 6) AS exonic, round(coalesce(intronic, 0), 6) AS intronic, round(CASE WHEN exonic > 0 THEN coalesce(intronic, 0) / exonic END, 6) AS ratio FROM a LEFT JOIN b USING (name)""")
def gene_uniformity(spark, d):
    return pt.uniformity(genes(spark, d), items(spark, d)).withColumns({c: F.round(c, 6) for c in ("exonic", "intronic", "ratio")})


_RC = "reverse(translate(substr(seq, 11, 20), 'ACGTacgt', 'TGCAtgca'))"


@query(f"""WITH {SEQS} SELECT id, substr(seq, 1, 10) || substr(seq, 31) AS deleted, substr(seq, 1, 10) || 'ACGT' || substr(seq, 11) AS inserted,
substr(seq, 1, 10) || {_RC} || substr(seq, 31) AS inverted,
substr(seq, 1, 10) || substr(reverse(seq), 1, 5) || substr(seq, 31) AS swapped, substr(seq, 11, 20) || substr(reverse(seq), 6) AS swapped_other FROM q WHERE length(seq) >= 30""")
def sequence_edits(spark, d):
    """A piece deleted, inserted, inverted, and exchanged with the beginning of the reversed sequence."""
    s, lo, hi = F.col("seq"), F.lit(10), F.lit(30)
    one, two = pt.translocated(s, lo, hi, F.reverse(s), F.lit(0), F.lit(5))
    x = texts(spark, d).where(F.length("seq") >= 30)
    return x.select("id", pt.deleted(s, lo, hi).alias("deleted"), pt.inserted(s, F.lit("ACGT"), lo).alias("inserted"), pt.inverted(s, lo, hi).alias("inverted"), one.alias("swapped"), two.alias("swapped_other"))


@query(f"""WITH {SEQS}, r AS (SELECT id, regexp_extract_all(regexp_replace(upper(seq), '[^ACGT]', '', 'g'), 'A+|C+|G+|T+') AS r FROM q),
u AS (SELECT id, unnest(r) AS run, generate_subscripts(r, 1) AS i, len(r) AS n FROM r), p AS (SELECT *, instr('TACG', substr(run, 1, 1)) - 1 AS p FROM u),
g AS (SELECT *, coalesce((p - lag(p) OVER (PARTITION BY id ORDER BY i) - 1 + 4) % 4, p) AS idle FROM p),
t AS (SELECT id, string_agg(repeat('0,', idle::INTEGER) || CASE WHEN i < n THEN len(run) || ',' ELSE '' END, '' ORDER BY i) AS flows FROM g GROUP BY id)
SELECT q.id, coalesce(flows, '') AS flows FROM q LEFT JOIN t USING (id)""")
def sequence_flows(spark, d):
    f = sq.flows(F.col("seq")).cast("array<string>")
    return texts(spark, d).select("id", F.concat(F.array_join(f, ","), F.when(F.size(f) > 0, ",").otherwise("")).alias("flows"))


@query("""WITH v AS (SELECT l_suppkey % 20 AS k, l_linenumber AS x, l_quantity AS y FROM lineitem)
SELECT k, round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2 FROM v GROUP BY k""")
def regression_by_key(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"))
    return ln.linear_regression(x, "k", ["x"], "y").select("k", F.round("intercept", 6).alias("intercept"), F.round(F.col("slopes")[0], 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query("""WITH v AS (SELECT l_suppkey % 20 AS k, l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem),
s AS (SELECT k, sum(x * x) / 1000 AS a, sum(x * y) / 1000 AS b, sum(y * y) / 1000 AS d FROM v GROUP BY k)
SELECT k, 2 AS rank, round(a * d - b * b, 3) AS det, round(d / (a * d - b * b), 5) AS first, round((a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2, 5) AS least FROM s""")
def dense_matrices(spark, d):
    """Rank, determinant, inverse and eigenvalues of the products of two columns for each key."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), F.array(F.col("l_linenumber").cast("double"), "l_quantity").alias("v"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.sum(F.col("v")[i] * F.col("v")[j]) / 1000).alias("value")) for i in (0, 1) for j in (0, 1)])
    m = li.groupBy("k").agg(cells.alias("c")).select("k", F.explode("c").alias("c")).select("k", "c.i", "c.j", "c.value")
    x = ln.dense(m, "k")
    return x.select("k", "rank", F.round("det", 3).alias("det"), F.round(F.col("inverse")[0][0], 5).alias("first"), F.round(F.col("eigen")[0], 5).alias("least"))


@query("""WITH v AS (SELECT l_linenumber AS a, (l_partkey % 7 + 1) AS b, count(*) % 23 - 11 AS k FROM lineitem GROUP BY ALL),
t AS (SELECT a, b, k, unnest(range(0, 121)) AS j FROM v),
p AS (SELECT a, b, k, exp(j * ln(b) - b - lgamma(j + 1)) AS share, CASE WHEN k + j >= 0 THEN list_sum([exp(i * ln(a) - a - lgamma(i + 1)) FOR i IN range(0, k + j + 1)]) ELSE 0 END AS below,
             CASE WHEN k + j >= 0 THEN exp((k + j) * ln(a) - a - lgamma(k + j + 1)) ELSE 0 END AS here FROM t)
SELECT a, b, k, round(least(sum(share * below), 1 - sum(share * below) + sum(share * here)), 6) + 0.0 AS p FROM p GROUP BY a, b, k""")
def skellam_tails(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("a"), (F.col("l_partkey") % 7 + 1).alias("b")).agg((F.count(F.lit(1)) % 23 - 11).alias("k"))
    return x.withColumn("p", F.round(pr.skellam_tail("k", "a", "b"), 6) + 0.0)


@query()
def svm_cross_validated(spark, d):
    """Whether a part costs more than 1,500, from its size and key, each row judged by a machine that didn't see its fold."""
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), (F.col("p_partkey") % 1000).alias("place"), (F.col("p_retailprice") > 1500).cast("int").alias("dear"))
    return ln.cross_validated_svm(x, "p_partkey", ["size", "place"], "dear", 3)
