"""Readers and writers of text formats, as projections over Spark's text source.

Line formats are read with ``spark.read.text`` and split by expressions, so files split across tasks freely.
Record formats whose records span lines (FASTA, FASTQ, alignment blocks) set the line separator to what begins a
record. Lines that a format calls comments are dropped; empty lines are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BIG = "bigint"


def _lines(spark: SparkSession, path: str, comments: str = "^(#|track|browser)") -> DataFrame:
    return spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(comments))


def _fields(df: DataFrame, separator: str = "\t") -> DataFrame:
    return df.select(F.split("value", separator, -1).alias("f"))


def _at(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def _number(k: int, kind: str = _BIG) -> Column:
    return F.trim(_at(k)).try_cast(kind)


def _ints(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(_BIG))


def _or(c: Column, other: Column | str) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(other) if isinstance(other, str) else other).otherwise(c)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED12 and more: chr, start, end, name, score, strand, cds_start, cds_end, rgb, exons, extra.

    A missing name is ``chr:start-end``, a missing strand "*", a missing score 0; without blocks the interval is
    the only exon. Columns past the twelfth that are numbers become extra scores.
    """
    f = _fields(_lines(spark, path))
    start, end = _number(1), _number(2)
    blocks = F.zip_with(_ints(_at(11)), _ints(_at(10)), lambda s, n: F.struct((start + s).alias("start"), (start + s + n).alias("end")))
    one = F.array(F.struct(start.alias("start"), end.alias("end")))
    return f.select(
        _at(0).alias("chr"),
        start.alias("start"),
        end.alias("end"),
        _or(_at(3), F.concat(_at(0), F.lit(":"), _at(1), F.lit("-"), _at(2))).alias("name"),
        F.coalesce(_number(4, "double"), F.lit(0.0)).alias("score"),
        _or(_at(5), "*").alias("strand"),
        F.coalesce(_number(6), start).alias("cds_start"),
        F.coalesce(_number(7), end).alias("cds_end"),
        F.when(F.size("f") == 7, _at(6)).otherwise(_at(8)).alias("rgb"),
        F.when(F.size("f") >= 12, blocks).otherwise(one).alias("exons"),
        F.filter(F.transform(F.slice("f", F.lit(13), F.greatest(F.size("f") - 12, F.lit(0))), lambda x: x.try_cast("double")), lambda x: x.isNotNull()).alias("extra"),
    )


def write_bed(genes: DataFrame, path: str) -> None:
    """BED12 lines of models (chr, name, score, strand, exons)."""
    lo, hi = F.array_min(F.transform("exons", lambda e: e["start"])), F.array_max(F.transform("exons", lambda e: e["end"]))
    sizes = F.array_join(F.transform("exons", lambda e: (e["end"] - e["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["start"] - lo).cast("string")), ",")
    parts = ["chr", lo.cast("string"), hi.cast("string"), "name", F.col("score").cast("string"), "strand", lo.cast("string"), hi.cast("string"), F.lit("0,0,0"), F.size("exons").cast("string"), sizes, starts]
    genes.select(F.concat_ws("\t", *parts)).write.text(path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(_lines(spark, path))
    return f.select(_at(0).alias("chr"), _number(1).alias("start"), _number(2).alias("end"), _number(3, "double").alias("score"))


def write_bedgraph(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.col("score").cast("string"))).write.text(path)


def write_wig(df: DataFrame, path: str, span: int = 1) -> None:
    """variableStep lines: one declaration per chromosome and its 1-based positions in order."""
    body = df.select("chr", (F.col("start") + 1).alias("p"), F.concat_ws(" ", (F.col("start") + 1).cast("string"), F.col("score").cast("string")).alias("line"))
    head = df.select("chr").distinct().select("chr", F.lit(0).cast(_BIG).alias("p"), F.concat(F.lit("variableStep chrom="), F.col("chr"), F.lit(f" span={span}")).alias("line"))
    head.union(body).repartitionByRange("chr").sortWithinPartitions("chr", "p").select("line").write.text(path)


def _attributes(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), 0)
    key = lambda x: F.regexp_extract(x, pattern, 1)
    value = lambda x: F.regexp_extract(x, pattern, 2)
    return F.map_from_entries(F.array_distinct(F.transform(found, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns; positions become 0-based half-open; attrs is a map of ``key=value`` or ``key "value"`` pairs."""
    f = _fields(_lines(spark, path, "^#"))
    return f.select(
        _at(0).alias("chr"), _at(1).alias("source"), _at(2).alias("feature"), (_number(3) - 1).alias("start"), _number(4).alias("end"),
        _number(5, "double").alias("score"), _or(F.when(_at(6) != ".", _at(6)), "*").alias("strand"), _at(7).alias("frame"),
        _attributes(_at(8), r'([A-Za-z_][\w.-]*)[= ]"?([^";]*)"?').alias("attrs"),
    )


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """Models from exon lines: name (transcript_id), gene_id, chr, strand, exons."""
    x = read_gff(spark, path).where("feature = 'exon'").withColumns({"name": F.col("attrs")["transcript_id"], "gene_id": F.col("attrs")["gene_id"]})
    return x.groupBy("name", "gene_id", "chr", "strand").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))


def write_gtf(genes: DataFrame, path: str, source: str = "loomspan") -> None:
    x = genes.select("name", "gene_id", "chr", "strand", F.explode("exons").alias("e"))
    attrs = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; transcript_id "'), F.col("name"), F.lit('";'))
    x.select(F.concat_ws("\t", "chr", F.lit(source), F.lit("exon"), (F.col("e.start") + 1).cast("string"), F.col("e.end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)).write.text(path)


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of 21 columns: name, chr, strand, matches, mismatches, start, end, exons."""
    f = _fields(_lines(spark, path, r"^(#|psLayout|match|\s|-)")).where(F.size("f") >= 21)
    blocks = F.zip_with(_ints(_at(20)), _ints(_at(18)), lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))
    return f.select(_at(9).alias("name"), _at(13).alias("chr"), F.substring(_at(8), 1, 1).alias("strand"), _number(0).alias("matches"), _number(1).alias("mismatches"), _number(15).alias("start"), _number(16).alias("end"), blocks.alias("exons"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Text alignment rows: name, flag, chr, start (0-based), mapq, cigar, exons, strand, mapped, duplicate, second, mate_chr, mate_start, seq, nh (null: 1)."""
    from loomspan.operators.genes import blocks_of

    f = _fields(_lines(spark, path, "^@"))
    flag, start = _number(1, "int"), _number(3) - 1
    bit = lambda v: flag.bitwiseAND(F.lit(v)) != 0
    tags = F.array_join(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), "\t")
    nh = F.regexp_extract(tags, r"NH:i:(\d+)", 1)
    return f.select(
        _at(0).alias("name"), flag.alias("flag"), _at(2).alias("chr"), start.alias("start"), _number(4, "int").alias("mapq"), _at(5).alias("cigar"),
        F.when(_at(5) != "*", blocks_of(start, _at(5))).alias("exons"), F.when(bit(16), "-").otherwise("+").alias("strand"), (~bit(4)).alias("mapped"),
        bit(1024).alias("duplicate"), bit(128).alias("second"), F.when(_at(6) == "=", _at(2)).otherwise(_at(6)).alias("mate_chr"), (_number(7) - 1).alias("mate_start"),
        _at(9).alias("seq"), F.when(nh != "", nh.try_cast("int")).otherwise(1).alias("nh"),
    )


def passing_reads(reads: DataFrame, min_mapq: int = 0, strand: str | None = None, second: bool | None = None) -> DataFrame:
    """Mapped, no duplicates, mapping quality above ``min_mapq``, optionally one strand and one side of the pair."""
    keep = F.col("mapped") & ~F.col("duplicate") & (F.col("mapq") > min_mapq)
    if strand:
        keep &= F.col("strand") == strand
    if second is not None:
        keep &= F.col("second") == second
    return reads.where(keep)


def fragments(reads: DataFrame) -> DataFrame:
    """Spans of read pairs on one chromosome: name, chr, start, end."""
    a, b = reads.where(~F.col("second")), reads.where("second")
    end = lambda c: F.array_max(F.transform(c, lambda e: e["end"]))
    b = b.select("name", F.col("chr").alias("chr2"), F.col("start").alias("s2"), end(F.col("exons")).alias("e2"))
    p = a.select("name", "chr", "start", end(F.col("exons")).alias("e1")).join(b, "name").where("chr = chr2")
    return p.select("name", "chr", F.least("start", "s2").alias("start"), F.greatest("e1", "e2").alias("end"))


def unique_or_best(reads: DataFrame, score: str = "mapq") -> DataFrame:
    """One row per read name: its best by score, the first by (chr, start) among equals; ``n_places`` says how many it had."""
    from pyspark.sql import Window

    w = Window.partitionBy("name")
    x = reads.withColumn("n_places", F.count(F.lit(1)).over(w)).withColumn("k_", F.row_number().over(w.orderBy(F.desc(score), "chr", "start")))
    return x.where("k_ = 1").drop("k_")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, descr, qual. Records begin at a line feed and "@"; a quality line that begins with "@" is joined back."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(@[^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*)"), 1)).alias("r"))
    p = F.split("r", "\n", -1)
    return x.select(F.substring(p[0], 2, 1 << 30).alias("name"), p[1].alias("seq"), F.substring(p[2], 2, 1 << 30).alias("descr"), p[3].alias("qual"))


def write_fastq(df: DataFrame, path: str, by: str | None = None) -> None:
    """Four-line records; ``by``: one folder per value of that column (demultiplexing)."""
    line = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+"), F.col("descr"), F.lit("\n"), F.col("qual")).alias("value")
    if by:
        df.select(line, by).write.partitionBy(by).text(path)
    else:
        df.select(line).write.text(path)


def demultiplex(df: DataFrame, barcodes: DataFrame, length: int, mismatch: bool = False) -> DataFrame:
    """Reads with ``sample`` of the barcode (barcode, sample) that they begin with, "remainder" without one; mismatch: one other base is allowed."""
    x = df.withColumn("code_", F.upper(F.substring("seq", 1, length)))
    b = barcodes.select(F.upper("barcode").alias("code_"), "sample")
    if mismatch:
        k = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.transform(F.array(*map(F.lit, "ACGTN")), lambda c: F.concat(F.substring("code_", F.lit(1), i - 1), c, F.substring("code_", i + 1, F.lit(length)))))))
        b = b.select(k.alias("code_"), "sample").groupBy("code_").agg(F.min("sample").alias("sample"), F.count_distinct("sample").alias("n")).where("n = 1").drop("n")
    return x.join(F.broadcast(b), "code_", "left").withColumn("sample", F.coalesce("sample", F.lit("remainder"))).drop("code_")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq: the first word of the header and the joined lines."""
    x = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substr(value, instr(value, '\\n') + 1)")
    return x.select(F.split(F.trim(head), r"\s+")[0].alias("id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    wrapped = F.array_join(F.regexp_extract_all("seq", F.lit(f"(.{{1,{width}}})"), 1), "\n")
    df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped)).write.text(path)


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Alignment blocks: score and rows array<struct<species, chr, start, size, strand, source_size, text>>."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.concat(F.lit("\n"), F.col("value")), r"\na ")).alias("b"))
    x = x.where(F.col("b").rlike(r"(^|\n)s "))
    score = F.regexp_extract("b", r"score=([-\d.eE]+)", 1).try_cast("double")
    rows = F.transform(F.filter(F.split("b", "\n"), lambda l: l.startswith("s ")), lambda l: F.split(F.trim(l), r"\s+"))
    part = lambda p: F.struct(
        F.substring_index(p[1], ".", 1).alias("species"), F.when(p[1].contains("."), F.regexp_replace(p[1], r"^[^.]*\.", "")).alias("chr"),
        p[2].cast(_BIG).alias("start"), p[3].cast(_BIG).alias("size"), p[4].alias("strand"), p[5].try_cast(_BIG).alias("source_size"), F.element_at(p, -1).alias("text"),
    )
    return x.select(score.alias("score"), F.transform(rows, part).alias("rows"))


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix (row, description, col, value) of an expression file; names upper-cased. The header lines are read on the driver."""
    head = [r["value"] for r in spark.read.text(path).limit(3).collect()]
    names = head[2].split("\t")[2:]
    f = _fields(spark.read.text(path).where((F.col("value") != head[0]) & (F.col("value") != head[1]) & (F.col("value") != head[2]) & (F.length("value") > 0)))
    ragged = F.when(F.size("f") != len(names) + 2, F.raise_error(F.lit("a row has another number of columns than the header")).cast("string")).otherwise(_at(0))
    x = f.select(F.upper(ragged).alias("row"), _at(1).alias("description"), F.posexplode(F.slice("f", 3, max(len(names), 1))).alias("k", "v"))
    cols = F.array(*map(F.lit, names))
    return x.select("row", "description", F.get(cols, F.col("k")).alias("col"), F.col("v").try_cast("double").alias("value"))


def write_gct(m: DataFrame, path: str, cols: list[str]) -> None:
    wide = m.groupBy("row").pivot("col", cols).agg(F.first("value"))
    n = wide.count()
    head = m.sparkSession.createDataFrame([(0, f"#1.2\n{n}\t{len(cols)}\nName\tDescription\t" + "\t".join(cols))], "k int, value string")
    body = wide.select(F.lit(1).alias("k"), F.concat_ws("\t", "row", "row", *[F.col(f"`{c}`").cast("string") for c in cols]).alias("value"))
    head.union(body).repartitionByRange(1, "k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix of a tab-separated table with a header and row names first."""
    from loomspan.operators.matrix import melt

    wide = spark.read.option("sep", "\t").option("header", True).csv(path)
    key = wide.columns[0]
    return melt(wide.select(key, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in wide.columns[1:]]), key)


def read_cls(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(sample, group) of a phenotype file's third line."""
    line = [r["value"] for r in spark.read.text(path).limit(3).collect()][2].split()
    return spark.createDataFrame(list(zip(samples, line)), "sample string, group string")


def read_gmt(spark: SparkSession, path: str, more_than: int = 0) -> DataFrame:
    """(set_name, gene): members upper-cased, once each; sets with more than ``more_than`` members."""
    f = _fields(_lines(spark, path, "^#"))
    genes = F.array_distinct(F.filter(F.transform(F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0))), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return f.select(_at(0).alias("set_name"), genes.alias("g")).where(F.size("g") > more_than).select("set_name", F.explode("g").alias("gene"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(_lines(spark, path, "^#"), r"\s+")
    return f.select(_at(0).alias("chr"), _number(1).alias("size"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("id"))


def read_pwm(spark: SparkSession, path: str) -> DataFrame:
    """name, probs: four rows (A, C, G, T) under each ``>name``."""
    x = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    rows = F.filter(F.split("value", "\n"), lambda l: F.trim(l) != "")
    return x.select(F.trim(rows[0]).alias("name"), F.transform(F.slice(rows, 2, 4), lambda l: F.transform(F.split(F.trim(l), r"\s+"), lambda v: v.cast("double"))).alias("probs"))


def read_repeat_masker(spark: SparkSession, path: str) -> DataFrame:
    """chr, start (0-based), end, strand, repeat, family, score of an .out table."""
    f = _fields(_lines(spark, path, r"^\s*(SW|score|There)").select(F.trim("value").alias("value")), r"\s+")
    return f.select(_at(4).alias("chr"), (_number(5) - 1).alias("start"), _number(6).alias("end"), F.when(_at(8) == "C", "-").otherwise("+").alias("strand"), _at(9).alias("repeat"), _at(10).alias("family"), _number(0, "double").alias("score"))


def read_tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Hit rows of a tandem-repeat .dat file: start (0-based), end, period, copies, score, consensus."""
    f = _fields(spark.read.text(path).where(F.col("value").rlike(r"^\d+ \d+ \d+ ")), " ")
    return f.select((_number(0) - 1).alias("start"), _number(1).alias("end"), _number(2).alias("period"), _number(3, "double").alias("copies"), _number(7, "double").alias("score"), _at(13).alias("consensus"))


def read_gene_table(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Gene tables with comma lists of exon starts and ends: name, chr, strand, cds_start, cds_end, exons. offset: columns before the name."""
    f = _fields(_lines(spark, path, "^#"))
    k = offset
    exons = F.zip_with(_ints(_at(k + 8)), _ints(_at(k + 9)), lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    return f.select(_at(k).alias("name"), _at(k + 1).alias("chr"), _at(k + 2).alias("strand"), _number(k + 5).alias("cds_start"), _number(k + 6).alias("cds_end"), exons.alias("exons"))


def read_igv(spark: SparkSession, path: str) -> DataFrame:
    """Long matrix whose rows are intervals: chr, start, end, row, col, value."""
    wide = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path)
    a, b, c, d, *cols = wide.columns
    x = wide.select(F.col(f"`{a}`").alias("chr"), F.col(f"`{b}`").cast(_BIG).alias("start"), F.col(f"`{c}`").cast(_BIG).alias("end"), F.col(f"`{d}`").alias("row"), *[F.col(f"`{v}`").try_cast("double").alias(v) for v in cols])
    return x.unpivot(["chr", "start", "end", "row"], cols, "col", "value")


def write_dot(edges: DataFrame, path: str) -> None:
    """Graph lines ``a -> b [label=n]`` in one digraph."""
    head = edges.sparkSession.createDataFrame([(0, "digraph g {"), (2, "}")], "k int, value string")
    body = edges.select(F.lit(1).alias("k"), F.concat(F.lit('"'), F.col("a"), F.lit('" -> "'), F.col("b"), F.lit('" [label='), F.col("n").cast("string"), F.lit("];")).alias("value"))
    head.union(body).repartitionByRange(1, "k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    p = r'^"([^"]+)" -> "([^"]+)" \[label=(\d+)\];'
    x = spark.read.text(path).where(F.col("value").rlike(p))
    return x.select(F.regexp_extract("value", p, 1).alias("a"), F.regexp_extract("value", p, 2).alias("b"), F.regexp_extract("value", p, 3).cast(_BIG).alias("n"))


def write_network(edges: DataFrame, path: str, least: float) -> None:
    """``a<TAB>relation<TAB>b`` lines of edges whose weight is at least ``least`` in size."""
    edges.where(F.abs("weight") >= least).select(F.concat_ws("\t", "a", F.when(F.col("weight") > 0, "up").otherwise("down"), "b")).write.text(path)


def above_score(df: DataFrame, least: float) -> DataFrame:
    """Rows whose score is above ``least``, not equal to it."""
    return df.where(F.col("score") > least)


def in_region(df: DataFrame, chrs: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows on the given chromosomes that overlap [start, end)."""
    keep = F.col("chr").isin(chrs) if chrs else F.lit(True)
    if start is not None:
        keep &= F.col("end") > start
    if end is not None:
        keep &= F.col("start") < end
    return df.where(keep)


def read_annotations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """chr, start, end, name, score of a file of the named format: bed, gff, bedgraph, psl."""
    if kind == "bed":
        return read_bed(spark, path).select("chr", "start", "end", "name", "score")
    if kind == "gff":
        return read_gff(spark, path).select("chr", "start", "end", F.coalesce(F.col("attrs")["ID"], F.lit("")).alias("name"), "score")
    if kind == "bedgraph":
        return read_bedgraph(spark, path).select("chr", "start", "end", F.lit("").alias("name"), "score")
    if kind == "psl":
        return read_psl(spark, path).select("chr", "start", "end", "name", F.col("matches").cast("double").alias("score"))
    raise ValueError(f"no reader for {kind}")


def write_gff(df: DataFrame, path: str, source: str, feature: str) -> None:
    """Nine columns of rows (chr, start, end, score, strand, attrs); attributes as ``key=value;`` in order of key."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    df.select(F.concat_ws("\t", "chr", F.lit(source), F.lit(feature), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.col("score").cast("string"), "strand", F.lit("."), pairs)).write.text(path)


def _ends(exons: str = "exons") -> tuple[Column, Column]:
    return F.array_min(F.transform(exons, lambda e: e["start"])), F.array_max(F.transform(exons, lambda e: e["end"]))


def write_psl(genes: DataFrame, path: str) -> None:
    """Alignment rows of 21 columns for models taken as perfect alignments."""
    lo, hi = _ends()
    size = F.aggregate("exons", F.lit(0).cast(_BIG), lambda a, e: a + e["end"] - e["start"]).cast("string")
    sizes = F.concat_ws(",", F.transform("exons", lambda e: (e["end"] - e["start"]).cast("string")))
    starts = F.concat_ws(",", F.transform("exons", lambda e: e["start"].cast("string")))
    zero = [F.lit("0")] * 7
    genes.select(F.concat_ws("\t", size, *zero, "strand", "name", size, F.lit("0"), size, "chr", F.lit("0"), lo.cast("string"), hi.cast("string"), F.size("exons").cast("string"), sizes, F.lit("0"), starts)).write.text(path)


def write_sam(genes: DataFrame, path: str, mapq: int = 30) -> None:
    """Models (name, chr, strand, exons) as spliced alignment rows without sequences."""
    from loomspan.operators.genes import cigar

    flag = F.when(F.col("strand") == "-", "16").otherwise("0")
    genes.select(F.concat_ws("\t", "name", flag, "chr", (_ends()[0] + 1).cast("string"), F.lit(str(mapq)), cigar(F.col("exons")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))).write.text(path)


def mate_pairs(left: DataFrame, right: DataFrame, least: int, most: int) -> DataFrame:
    """Ends (name, chr, strand, start, end, score) that were aligned on their own, matched by name: the best pair on one chromosome and strand.

    distance: from the first base of one to the last of the other, between ``least`` and ``most``. The pair of
    highest summed score wins, the shorter among equals.
    """
    b = right.select("name", "chr", "strand", *[F.col(c).alias(f"r_{c}") for c in ("start", "end", "score")])
    p = left.join(b, ["name", "chr", "strand"]).withColumn("distance", F.greatest("end", "r_end") - F.least("start", "r_start")).where(F.col("distance").between(least, most))
    best = F.min_by(F.struct("chr", "strand", "start", "r_start", "distance"), F.struct(-(F.col("score") + F.col("r_score")), "distance", "start", "r_start"))
    return p.groupBy("name").agg(best.alias("p")).select("name", "p.*")


def write_maf(blocks: DataFrame, path: str) -> None:
    """Alignment blocks (score, rows as ``read_maf`` gives them)."""
    line = lambda r: F.concat_ws(" ", F.lit("s"), F.concat(r["species"], F.lit("."), r["chr"]), r["start"].cast("string"), r["size"].cast("string"), r["strand"], r["source_size"].cast("string"), r["text"])
    blocks.select(F.concat_ws("\n", F.concat(F.lit("a score="), F.col("score").cast("string")), F.array_join(F.transform("rows", line), "\n"), F.lit(""))).write.text(path)


def write_phylip(rows: DataFrame, path: str) -> None:
    """Rows (id, text): a line with the number of rows and the longest text, then one line each. One file."""
    n, most = rows.agg(F.count(F.lit(1)), F.max(F.length("text"))).first()
    head = rows.sparkSession.createDataFrame([(0, f"{n} {most or 0}")], "k int, value string")
    head.union(rows.select(F.lit(1), F.concat_ws(" ", "id", "text"))).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(path)


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """id, text of the rows below the head line."""
    x = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").rlike(r"^\s*\d+\s+\d+\s*$"))
    p = F.split(F.trim("value"), r"\s+", 2)
    return x.select(p[0].alias("id"), F.regexp_replace(p[1], r"\s", "").alias("text"))


def write_matrix(m: DataFrame, path: str, cols: list[str]) -> None:
    """A tab-separated table with a header and row names first."""
    m.groupBy("row").pivot("col", cols).agg(F.first("value")).write.option("sep", "\t").option("header", True).csv(path)


def write_cls(spark: SparkSession, path: str, groups: list[tuple[str, str]]) -> None:
    """The three lines of a phenotype file from (sample, group) in order."""
    kinds = list(dict.fromkeys(g for _, g in groups))
    body = f"{len(groups)} {len(kinds)} 1\n# {' '.join(kinds)}\n{' '.join(g for _, g in groups)}"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)


def read_gmx(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, gene) of sets written as columns: names, notes, then members, upper-cased. The names are read on the driver."""
    names = spark.read.text(path).first()["value"].split("\t")
    notes = spark.read.text(path).limit(2).collect()[1]["value"]
    x = _fields(spark.read.text(path).where((F.col("value") != "\t".join(names)) & (F.col("value") != notes)))
    sets = F.array(*map(F.lit, names))
    x = x.select(F.posexplode("f").alias("k", "gene")).select(F.get(sets, F.col("k")).alias("set_name"), F.upper(F.trim("gene")).alias("gene"))
    return x.where("gene <> ''")


def read_chip(spark: SparkSession, path: str) -> DataFrame:
    """probe, gene, title of a probe annotation table, the first two upper-cased."""
    return _fields(_lines(spark, path, "^(#|Probe Set ID)")).select(F.upper(_at(0)).alias("probe"), F.upper(_at(1)).alias("gene"), _at(2).alias("title"))


def write_igv(df: DataFrame, path: str) -> None:
    """Rows (chr, start, end, name, then one column per sample) with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_pwm(df: DataFrame, path: str) -> None:
    """``>name`` and four tab-separated rows (A, C, G, T) of rows (name, probs)."""
    lines = F.transform("probs", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), "\t"))
    df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.array_join(lines, "\n"))).write.text(path)


def write_sorted_bed(df: DataFrame, path: str, order: list[Column]) -> None:
    """Lines in the given order over all files: range-partitioned and sorted."""
    df.orderBy(*order).select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("score").cast("string"), "strand")).write.text(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the 1-based position of each row in the order: rows are numbered within range partitions, and the sizes of those before are added."""
    from pyspark.sql import Window

    from loomspan.plans.storage import written

    x = written(df.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn("id_", F.monotonically_increasing_id()))
    before = x.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("id_").alias("low_"))
    before = before.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "before_", "low_")
    return x.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("id_") - F.col("low_") + 1).drop("part_", "id_", "before_", "low_")


def write_flat_genes(genes: DataFrame, path: str) -> None:
    """One line per model: name, chr, strand, start, end, number of exons, comma lists of starts and of ends."""
    lo, hi = _ends()
    part = lambda k: F.concat(F.array_join(F.transform("exons", lambda e: e[k].cast("string")), ","), F.lit(","))
    genes.select(F.concat_ws("\t", "name", "chr", "strand", lo.cast("string"), hi.cast("string"), F.size("exons").cast("string"), part("start"), part("end"))).write.text(path)
