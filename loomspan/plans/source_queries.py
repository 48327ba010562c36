"""Readers and writers as queries: rows are written in a format to the shared folder and read back; the SQL gives the rows themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.genes import introns
from loomspan.plans.bind import BOTH, GENES, ITEMS, MATRIX, SEQS, SPANS, genes, items, matrix, query, spans, table, texts
from loomspan.plans.storage import folder
from loomspan.sources import formats as fm

#: SQL text of an exon list.
_LIST = "string_agg(s || '-' || e, ',' ORDER BY s, e)"


def _path(spark) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def _put(lines: DataFrame, value: Column) -> str:
    path = _path(lines.sparkSession)
    lines.select(value.alias("value")).write.text(path)
    return path


def _tabs(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def _text(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")


@query(f"WITH {GENES} SELECT name, chr, strand, min(g0) AS start, max(g1) AS \"end\", 3.5::DOUBLE AS score, {_LIST} AS exons FROM ex GROUP BY name, chr, strand")
def source_bed12(spark, d):
    path = _path(spark)
    fm.write_bed(genes(spark, d).withColumn("score", F.lit(3.5)), path)
    return fm.read_bed(spark, path).select("name", "chr", "strand", "start", "end", "score", _text(F.col("exons")).alias("exons"))


@query(f"""WITH {SPANS} SELECT chr, s AS start, e AS "end", chr || ':' || s || '-' || e AS name, '*' AS strand, 0::DOUBLE AS score FROM spans
UNION ALL SELECT chr, s, e, name, '*', 0 FROM spans""")
def source_short_bed(spark, d):
    """Lines of three and of four columns in one folder."""
    x = spans(spark, d)
    three, four = _put(x, _tabs("chr", "start", "end")), _put(x, _tabs("chr", "start", "end", "name"))
    return fm.read_bed(spark, three).unionByName(fm.read_bed(spark, four)).select("chr", "start", "end", "name", "strand", "score")


@query(f"WITH {SPANS} SELECT chr, s AS start, e AS \"end\", name, strand, score FROM spans WHERE chr IN ('c3', 'c11') AND s < 200000 AND e > 120000 AND score > 2")
def source_bed_region(spark, d):
    """One region's records above a score: the reader's filters."""
    path = _put(spans(spark, d), _tabs("chr", "start", "end", "name", "score", "strand"))
    return fm.in_region(fm.above_score(fm.read_bed(spark, path), 2.0), ["c3", "c11"], 120_000, 200_000).select("chr", "start", "end", "name", "strand", "score")


@query(f"WITH {ITEMS} SELECT chr, s AS start, e AS \"end\", score FROM items")
def source_bedgraph(spark, d):
    path = _path(spark)
    fm.write_bedgraph(items(spark, d), path)
    return fm.read_bedgraph(spark, path)


@query(f"WITH {ITEMS}, p AS (SELECT chr, s, sum(score) AS v FROM items GROUP BY ALL) SELECT line FROM (SELECT 'variableStep chrom=' || chr || ' span=1' AS line FROM (SELECT DISTINCT chr FROM p) UNION ALL SELECT (s + 1) || ' ' || v::BIGINT || '.0' FROM p)")
def source_wig(spark, d):
    path = _path(spark)
    fm.write_wig(items(spark, d).groupBy("chr", "start").agg(F.sum("score").alias("score")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {SPANS} SELECT chr, 'src' AS source, 'region' AS feature, s AS start, e AS \"end\", score, strand, name AS id, strand || 'x' AS note FROM spans")
def source_gff(spark, d):
    path = _path(spark)
    x = spans(spark, d).withColumn("attrs", F.create_map(F.lit("ID"), F.col("name"), F.lit("Note"), F.concat("strand", F.lit("x"))))
    fm.write_gff(x, path, "src", "region")
    got = fm.read_gff(spark, path)
    return got.select("chr", "source", "feature", "start", "end", "score", "strand", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Note"].alias("note"))


@query(f"WITH {GENES} SELECT name, chr, strand, 'L' || chr AS gene_id, {_LIST} AS exons FROM ex GROUP BY name, chr, strand")
def source_gtf(spark, d):
    path = _path(spark)
    fm.write_gtf(genes(spark, d).withColumn("gene_id", F.concat(F.lit("L"), F.col("chr"))), path)
    return fm.read_gtf_genes(spark, path).select("name", "chr", "strand", "gene_id", _text(F.col("exons")).alias("exons"))


@query(f"WITH {SPANS} SELECT chr, max(e) AS size FROM spans GROUP BY chr")
def source_sizes(spark, d):
    return fm.read_sizes(spark, _put(spans(spark, d).groupBy("chr").agg(F.max("end").alias("size")), F.concat_ws(" ", "chr", F.col("size").cast("string"))))


@query("SELECT c_name AS id FROM customer")
def source_list(spark, d):
    return fm.read_list(spark, _put(table(spark, d, "customer"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))))


@query(f"WITH {GENES} SELECT name, chr, strand, sum(e - s)::BIGINT AS matches, 0::BIGINT AS mismatches, min(g0) AS start, max(g1) AS \"end\", {_LIST} AS exons FROM ex GROUP BY name, chr, strand")
def source_psl(spark, d):
    path = _path(spark)
    fm.write_psl(genes(spark, d), path)
    return fm.read_psl(spark, path).select("name", "chr", "strand", "matches", "mismatches", "start", "end", _text(F.col("exons")).alias("exons"))


@query(f"WITH {GENES} SELECT name, chr, strand, min(g0) AS start, 30 AS mapq, {_LIST} AS exons, true AS mapped, false AS duplicate FROM ex GROUP BY name, chr, strand HAVING coalesce(bool_and(next_s > e), true)")
def source_sam(spark, d):
    """Models as spliced alignments."""
    path = _path(spark)
    g = genes(spark, d)
    fm.write_sam(g.where(~F.exists(introns(F.col("exons")), lambda i: i["start"] >= i["end"])), path)
    return fm.passing_reads(fm.read_sam(spark, path), 10).select("name", "chr", "strand", "start", "mapq", _text(F.col("exons")).alias("exons"), "mapped", "duplicate")


_PAIRS = "p AS (SELECT o_orderkey AS k, 'c' || (o_custkey % 25) AS chr, (o_custkey * 7 % 90000)::BIGINT AS s, (o_custkey * 7 % 90000 + 100 + o_orderkey % 200)::BIGINT AS t FROM orders)"


@query(f"WITH {_PAIRS} SELECT 'r' || k AS name, chr, least(s, t) AS start, greatest(s + 50, t + 50) AS \"end\" FROM p")
def source_pairs(spark, d):
    """Read pairs of a text alignment file as fragments."""
    o = table(spark, d, "orders")
    s = F.col("o_custkey") * 7 % 90000
    x = o.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("chr"), s.alias("s"), (s + 100 + F.col("o_orderkey") % 200).alias("t"))
    end = lambda flag, a, b: _tabs("name", F.lit(flag), "chr", F.col(a) + 1, F.lit(30), F.lit("50M"), F.lit("="), F.col(b) + 1, F.lit(0), F.lit("*"), F.lit("*"))
    return fm.fragments(fm.read_sam(spark, _put(x, F.concat_ws("\n", end(67, "s", "t"), end(131, "t", "s")))))


@query(f"WITH {_PAIRS} SELECT 'r' || k AS name, chr, strand, abs(t - s) + 1 AS distance FROM (SELECT *, '+' AS strand FROM p) WHERE t - s BETWEEN 120 AND 250")
def source_mate_pairs(spark, d):
    """Ends aligned on their own, matched by read name with a distance limit."""
    o = table(spark, d, "orders")
    s = F.col("o_custkey") * 7 % 90000
    ends = lambda at: o.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("o_custkey") % 25).cast("string")).alias("chr"), F.lit("+").alias("strand"), at.alias("start"), (at + 1).alias("end"), F.lit(1.0).alias("score"))
    got = fm.mate_pairs(ends(s), ends(s + 100 + F.col("o_orderkey") % 200), 121, 251)
    return got.select("name", "chr", "strand", "distance")


@query("SELECT l_orderkey::VARCHAR AS name, arg_min('c' || (l_suppkey % 25), (-l_quantity, 'c' || (l_suppkey % 25), l_partkey)) AS chr, max(l_quantity) AS score, count(*) AS n_places FROM lineitem GROUP BY l_orderkey")
def source_best_mappers(spark, d):
    """Reads with several places: the best one, and how many there were."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"), F.concat(F.lit("c"), (F.col("l_suppkey") % 25).cast("string")).alias("chr"), F.col("l_partkey").alias("start"), F.col("l_quantity").alias("score"))
    return fm.unique_or_best(x, "score").select("name", "chr", "score", "n_places")


@query(f"WITH {SEQS} SELECT 'r' || id || ' x' AS name, seq, '' AS descr, repeat('@', len(seq)::INTEGER) AS qual FROM q WHERE len(seq) > 0")
def source_fastq(spark, d):
    """Quality lines may begin with the record sign."""
    path = _path(spark)
    x = texts(spark, d).where("length(seq) > 0")
    fm.write_fastq(x.select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(" x")).alias("name"), "seq", F.lit("").alias("descr"), F.repeat(F.lit("@"), F.length("seq")).alias("qual")), path)
    return fm.read_fastq(spark, path)


@query(f"WITH {SEQS} SELECT 's' || id AS id, seq FROM q WHERE len(seq) > 0")
def source_fasta(spark, d):
    path = _path(spark)
    fm.write_fasta(texts(spark, d).where("length(seq) > 0").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), "seq"), path, 30)
    return fm.read_fasta(spark, path)


@query(f"""WITH {SEQS} SELECT id::DOUBLE AS score, 'hg' AS species, 'c' || id % 5 AS chr, (id * 10)::BIGINT AS start, len(seq)::BIGINT AS size, seq AS text FROM q WHERE len(seq) > 0
UNION ALL SELECT id::DOUBLE, 'mm', 'c' || id % 7, (id * 20)::BIGINT, len(replace(upper(seq), 'T', ''))::BIGINT, replace(upper(seq), 'T', '-') FROM q WHERE len(seq) > 0""")
def source_alignment_blocks(spark, d):
    x = texts(spark, d).where("length(seq) > 0")
    other = F.replace(F.upper("seq"), F.lit("T"), F.lit("-"))
    row = lambda species, n, start, text: F.struct(F.lit(species).alias("species"), F.concat(F.lit("c"), (F.col("id") % n).cast("string")).alias("chr"), start.alias("start"), F.length(F.replace(text, F.lit("-"), F.lit(""))).cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(1000000).cast("long").alias("source_size"), text.alias("text"))
    path = _path(spark)
    fm.write_maf(x.select(F.col("id").cast("double").alias("score"), F.array(row("hg", 5, F.col("id") * 10, F.col("seq")), row("mm", 7, F.col("id") * 20, other)).alias("rows")), path)
    return fm.read_maf(spark, path).select("score", F.explode("rows").alias("r")).select("score", "r.species", "r.chr", "r.start", "r.size", "r.text")


@query(f"WITH {SEQS} SELECT id, text FROM (SELECT 's' || id AS id, seq AS text FROM q WHERE len(seq) > 0)")
def source_phylip(spark, d):
    """Alignment rows in PHYLIP form: a head line, then names and texts."""
    path = _path(spark)
    fm.write_phylip(texts(spark, d).where("length(seq) > 0").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.col("seq").alias("text")), path)
    return fm.read_phylip(spark, path)


@query(f"WITH {MATRIX} SELECT upper(\"row\") AS \"row\", col, value FROM m")
def source_expression_matrix(spark, d):
    path = _path(spark)
    m = matrix(spark, d)
    fm.write_gct(m, path, [r["col"] for r in m.select("col").distinct().orderBy("col").collect()])
    return fm.read_gct(spark, path).where("value is not null").select("row", "col", "value")


@query(f"WITH {MATRIX} SELECT \"row\", col, value FROM m")
def source_plain_matrix(spark, d):
    path = _path(spark)
    m = matrix(spark, d)
    fm.write_matrix(m, path, [r["col"] for r in m.select("col").distinct().orderBy("col").collect()])
    return fm.read_matrix(spark, path).where("value is not null").select("row", "col", "value")


@query(f"WITH {MATRIX} SELECT DISTINCT col AS sample, CASE WHEN col::INTEGER % 2 = 0 THEN 'even' ELSE 'odd' END AS \"group\" FROM m")
def source_phenotypes(spark, d):
    path = _path(spark)
    samples = [r["col"] for r in matrix(spark, d).select("col").distinct().orderBy("col").collect()]
    fm.write_cls(spark, path, [(s, "even" if int(s) % 2 == 0 else "odd") for s in samples])
    return fm.read_cls(spark, path, samples)


@query("SELECT DISTINCT p_type AS set_name, 'P' || p_partkey AS gene FROM part")
def source_gene_sets(spark, d):
    sets = table(spark, d, "part").groupBy("p_type").agg(F.concat_ws("\t", F.transform(F.array_sort(F.collect_set("p_partkey")), lambda k: F.concat(F.lit("p"), k.cast("string")))).alias("g"))
    return fm.read_gmt(spark, _put(sets, F.concat_ws("\t", "p_type", F.lit("na"), "g")))


@query("SELECT 'S' || p_size AS set_name, 'P' || p_partkey AS gene FROM part WHERE p_size <= 12")
def source_gene_set_columns(spark, d):
    """Sets as columns: names in the first line, notes in the second, one member of each set in every further line."""
    p = table(spark, d, "part").where("p_size <= 12")
    sizes = [r["p_size"] for r in p.select("p_size").distinct().orderBy("p_size").collect()]
    sets = p.groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("g"))
    rows = sets.select("p_size", F.posexplode("g").alias("k", "gene")).groupBy("k").pivot("p_size", sizes).agg(F.first("gene"))
    body = rows.select(F.concat_ws("\t", *[F.coalesce(F.concat(F.lit("p"), F.col(f"`{s}`").cast("string")), F.lit("")) for s in sizes]).alias("value"))
    head = spark.createDataFrame([("\t".join(f"S{s}" for s in sizes) + "\n" + "\t".join("na" for _ in sizes),)], "value string")
    path = _path(spark)
    head.withColumn("o", F.lit(0)).union(body.withColumn("o", F.lit(1))).repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
    return fm.read_gmx(spark, path)


@query("SELECT 'P' || p_partkey AS probe, 'B' || upper(p_brand) AS gene, p_type AS title FROM part")
def source_probe_names(spark, d):
    x = table(spark, d, "part")
    return fm.read_chip(spark, _put(x, _tabs(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.concat(F.lit("b"), F.col("p_brand")), "p_type")))


@query(f"WITH {SPANS} SELECT chr, s AS start, e AS \"end\", name AS \"row\", v.col AS col, CASE WHEN v.col = 'a' THEN score ELSE score * 2 END AS value FROM spans, (SELECT unnest(['a', 'b']) AS col) v")
def source_located_matrix(spark, d):
    path = _path(spark)
    fm.write_igv(spans(spark, d).select("chr", "start", "end", "name", F.col("score").alias("a"), (F.col("score") * 2).alias("b")), path)
    return fm.read_igv(spark, path)


@query(f"WITH {SPANS} SELECT chr, s AS start, e AS \"end\", strand, 'R' || strand AS \"repeat\", 'F/' || chr AS family, score FROM spans")
def source_repeats(spark, d):
    f = [F.col("score").cast("int"), F.lit("1.0"), F.lit("0.0"), F.lit("0.0"), F.col("chr"), F.col("start") + 1, F.col("end"), F.lit("(0)"), F.when(F.col("strand") == "-", "C").otherwise("+"), F.concat(F.lit("R"), F.col("strand")), F.concat(F.lit("F/"), F.col("chr"))]
    return fm.read_repeat_masker(spark, _put(spans(spark, d), F.concat_ws("  ", F.lit(""), *[c.cast("string") for c in f])))


@query(f"WITH {SPANS} SELECT s AS start, e AS \"end\", (score + 1)::BIGINT AS period, 2.5::DOUBLE AS copies, score, 'ACG' AS consensus FROM spans")
def source_tandem_repeats(spark, d):
    f = [F.col("start") + 1, F.col("end"), F.col("score").cast("int") + 1, F.lit("2.5"), F.lit(3), F.lit(90), F.lit(0), F.col("score").cast("int"), F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit("1.0"), F.lit("ACG"), F.lit("ACGACG")]
    return fm.read_tandem_repeats(spark, _put(spans(spark, d), F.concat_ws(" ", *[c.cast("string") for c in f])))


@query(f"WITH {GENES} SELECT name, chr, strand, min(g0) AS cds_start, max(g1) AS cds_end, {_LIST} AS exons FROM ex GROUP BY name, chr, strand")
def source_gene_table(spark, d):
    lo, hi = F.array_min(F.transform("exons", lambda e: e["start"])), F.array_max(F.transform("exons", lambda e: e["end"]))
    parts = [F.col("name"), F.col("chr"), F.col("strand"), lo, hi, lo, hi, F.size("exons"), F.concat_ws(",", F.transform("exons", lambda e: e["start"].cast("string"))), F.concat_ws(",", F.transform("exons", lambda e: e["end"].cast("string")))]
    got = fm.read_gene_table(spark, _put(genes(spark, d), _tabs(*parts)))
    return got.select("name", "chr", "strand", "cds_start", "cds_end", _text(F.col("exons")).alias("exons"))


@query("SELECT 'm' || p_partkey AS name, round(p_size / 100.0, 4) AS a, round(1 - p_size / 100.0, 4) AS t, 2 AS n FROM part")
def source_weight_matrices(spark, d):
    path = _path(spark)
    p = F.round(F.col("p_size") / 100.0, 4)
    zero, q = F.lit(0.0), F.round(1 - F.col("p_size") / 100.0, 4)
    x = table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), F.array(F.array(p, zero), F.array(zero, p), F.array(zero, zero), F.array(q, q)).alias("probs"))
    fm.write_pwm(x, path)
    got = fm.read_pwm(spark, path)
    return got.select("name", F.col("probs")[0][0].alias("a"), F.col("probs")[3][0].alias("t"), F.size(F.col("probs")[0]).alias("n"))


@query("SELECT 'n' || o_custkey AS a, 'k' || (o_orderkey % 10) AS b, count(*) AS n FROM orders GROUP BY ALL")
def source_graph(spark, d):
    path = _path(spark)
    e = table(spark, d, "orders").groupBy(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("k"), (F.col("o_orderkey") % 10).cast("string")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    fm.write_dot(e, path)
    return fm.read_dot(spark, path)


@query("SELECT 'n' || c_custkey || chr(9) || CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END || chr(9) || c_mktsegment AS line FROM customer WHERE abs(c_acctbal) >= 500")
def source_network(spark, d):
    path = _path(spark)
    fm.write_network(table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_acctbal").alias("weight")), path, 500.0)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"{BOTH} SELECT chr, s AS start, e AS \"end\", name, strand, score, position FROM (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS position FROM spans)")
def source_sorted_bed(spark, d):
    """Lines by falling score over all files; the position comes from file order and place."""
    path = _path(spark)
    fm.write_sorted_bed(spans(spark, d), path, [F.desc("score"), F.asc("name")])
    got = fm.read_bed(spark, path).select("chr", "start", "end", "name", "strand", "score")
    return fm.numbered(got, [F.desc("score"), F.asc("name")], "position")


@query(f"WITH {GENES} SELECT name || chr(9) || chr || chr(9) || strand || chr(9) || min(g0) || chr(9) || max(g1) || chr(9) || count(*) || chr(9) || string_agg(s, ',' ORDER BY s) || ',' || chr(9) || string_agg(e, ',' ORDER BY s) || ',' AS line FROM ex GROUP BY name, chr, strand")
def source_flat_genes(spark, d):
    path = _path(spark)
    fm.write_flat_genes(genes(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {SPANS} SELECT chr, s AS start, e AS \"end\", name, score, 'bed' AS format FROM spans UNION ALL SELECT chr, s, e, name, score, 'gff' FROM spans UNION ALL SELECT chr, s, e, '', score, 'bedgraph' FROM spans")
def source_any_annotation(spark, d):
    """One reader that picks the format by name."""
    x, gff, graph = spans(spark, d), _path(spark), _path(spark)
    fm.write_gff(x.withColumn("attrs", F.create_map(F.lit("ID"), F.col("name"))), gff, "s", "f")
    fm.write_bedgraph(x, graph)
    paths = {"bed": _put(x, _tabs("chr", "start", "end", "name", "score")), "gff": gff, "bedgraph": graph}
    parts = [fm.read_annotations(spark, p, kind).withColumn("format", F.lit(kind)) for kind, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
