"""Readers and writers on small files."""

import glob

from pyspark.sql import functions as F

from loomspan.sources import formats as fm


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def text_of(folder):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{folder}/part-*")))


def test_bed(spark, tmp_path):
    p = put(tmp_path, "x.bed", "track name=t\nchr1\t10\t20\nchr1\t5\t50\tg1\t3.5\t-\t6\t40\t0,0,0\t2\t10,20,\t0,25,\t7\nchr2\t1\t2\tn\t\t\n")
    r = {x["name"]: x for x in fm.read_bed(spark, p).collect()}
    assert r["chr1:10-20"]["strand"] == "*" and r["chr1:10-20"]["score"] == 0.0
    assert [(e["start"], e["end"]) for e in r["g1"]["exons"]] == [(5, 15), (30, 50)] and r["g1"]["extra"] == [7.0]
    out = str(tmp_path / "out")
    fm.write_bed(fm.read_bed(spark, p).where("name = 'g1'"), out)
    assert text_of(out).split("\t")[:4] == ["chr1", "5", "50", "g1"]
    again = fm.read_bed(spark, out).first()
    assert again["exons"] == r["g1"]["exons"]


def test_gtf_round_trip(spark, tmp_path):
    p = put(tmp_path, "x.gtf", '#c\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "G"; transcript_id "T";\nchr1\ts\texon\t1\t5\t.\t+\t.\tgene_id "G"; transcript_id "T";\nchr1\ts\tCDS\t1\t5\t.\t+\t0\tgene_id "G"; transcript_id "T";\n')
    g = fm.read_gtf_genes(spark, p)
    r = g.first()
    assert r["name"] == "T" and [(e["start"], e["end"]) for e in r["exons"]] == [(0, 5), (10, 20)]
    out = str(tmp_path / "gtf")
    fm.write_gtf(g, out)
    assert fm.read_gtf_genes(spark, out).first()["exons"] == r["exons"]


def test_sam(spark, tmp_path):
    p = put(tmp_path, "x.sam", "@HD\tVN:1\nr1\t16\tchr1\t101\t30\t5M10N5M\t=\t201\t0\tACGTACGTAC\t*\tNH:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\nr1\t128\tchr1\t201\t10\t4M\t=\t101\t0\tACGT\t*\n")
    r = fm.read_sam(spark, p).orderBy("start").collect()
    one = next(x for x in r if x["start"] == 100)
    assert [(e["start"], e["end"]) for e in one["exons"]] == [(100, 105), (115, 120)] and one["strand"] == "-" and one["nh"] == 2
    assert fm.passing_reads(fm.read_sam(spark, p), 20).count() == 1
    f = fm.fragments(fm.read_sam(spark, p).where("mapped")).first()
    assert (f["start"], f["end"]) == (100, 204)
    u = fm.unique_or_best(fm.read_sam(spark, p)).where("name = 'r1'").first()
    assert u["mapq"] == 30 and u["n_places"] == 2


def test_fastq_and_barcodes(spark, tmp_path):
    p = put(tmp_path, "x.fq", "@a 1\nACGTT\n+\n@IIII\n@b\nTTTTT\n+d\nIIIII\n")
    x = fm.read_fastq(spark, p)
    assert [(r["name"], r["seq"], r["descr"], r["qual"]) for r in x.orderBy("name").collect()] == [("a 1", "ACGTT", "", "@IIII"), ("b", "TTTTT", "d", "IIIII")]
    codes = spark.createDataFrame([("ACG", "s1"), ("GGG", "s2")], "barcode string, sample string")
    assert {r["name"]: r["sample"] for r in fm.demultiplex(x, codes, 3).collect()} == {"a 1": "s1", "b": "remainder"}
    near = spark.createDataFrame([("AGG", "s1")], "barcode string, sample string")
    assert {r["name"]: r["sample"] for r in fm.demultiplex(x, near, 3, mismatch=True).collect()}["a 1"] == "s1"
    out = str(tmp_path / "fq")
    fm.write_fastq(x.withColumn("k", F.lit("z")), out, "k")
    assert fm.read_fastq(spark, out + "/k=z").count() == 2


def test_fasta_maf_pwm(spark, tmp_path):
    p = put(tmp_path, "x.fa", ">one d\nACGT\nAC\n>two\nTT\n")
    x = fm.read_fasta(spark, p)
    assert {r["id"]: r["seq"] for r in x.collect()} == {"one": "ACGTAC", "two": "TT"}
    fm.write_fasta(x, str(tmp_path / "fa"), 4)
    assert {r["id"]: r["seq"] for r in fm.read_fasta(spark, str(tmp_path / "fa")).collect()} == {"one": "ACGTAC", "two": "TT"}
    m = put(tmp_path, "x.maf", "##maf\na score=2.5\ns hg.chr1 10 4 + 100 AC-GT\ns mm.chr2 5 3 - 90 A--GT\n\na score=1\ns hg.chr1 20 2 + 0 AC\n")
    b = fm.read_maf(spark, m).orderBy("score").collect()
    assert [len(r["rows"]) for r in b] == [1, 2] and b[1]["rows"][1]["species"] == "mm" and b[1]["rows"][1]["text"] == "A--GT"
    w = put(tmp_path, "x.pwm", ">p\n0.1\t0.2\n0.3\t0.4\n0.5\t0.3\n0.1\t0.1\n")
    assert fm.read_pwm(spark, w).first()["probs"][1] == [0.3, 0.4]


def test_matrices_and_sets(spark, tmp_path):
    p = put(tmp_path, "x.gct", "#1.2\n2\t2\nName\tDescription\ts1\ts2\ng1\td\t1\t2\ng2\td\t3\t4.5\n")
    m = fm.read_gct(spark, p)
    assert {(r["row"], r["col"]): r["value"] for r in m.collect()} == {("G1", "s1"): 1.0, ("G1", "s2"): 2.0, ("G2", "s1"): 3.0, ("G2", "s2"): 4.5}
    fm.write_gct(m, str(tmp_path / "gct"), ["s1", "s2"])
    assert fm.read_gct(spark, str(tmp_path / "gct")).count() == 4
    t = put(tmp_path, "x.tab", "id\ta\tb\nr\t1\t2\n")
    assert {(r["row"], r["col"], r["value"]) for r in fm.read_matrix(spark, t).collect()} == {("r", "a", 1.0), ("r", "b", 2.0)}
    g = put(tmp_path, "x.gmt", "S\td\ta\tB\tb\nT\td\tx\n")
    assert {(r["set_name"], r["gene"]) for r in fm.read_gmt(spark, g, 1).collect()} == {("S", "A"), ("S", "B")}
    c = put(tmp_path, "x.cls", "2 2 1\n# a b\n0 1\n")
    assert {(r["sample"], r["group"]) for r in fm.read_cls(spark, c, ["s1", "s2"]).collect()} == {("s1", "0"), ("s2", "1")}


def test_small_tables(spark, tmp_path):
    assert fm.read_sizes(spark, put(tmp_path, "sizes", "chr1 247249719\nchr2\t5\n")).count() == 2
    b = fm.read_bedgraph(spark, put(tmp_path, "x.bg", "chr1\t1\t5\t2.5\nchr1\t7\t9\t1\n"))
    fm.write_wig(b, str(tmp_path / "wig"))
    assert text_of(str(tmp_path / "wig")).split("\n")[:2] == ["variableStep chrom=chr1 span=1", "2 2.5"]
    d = put(tmp_path, "x.dat", "banner\n\nSequence: s\n10 40 3 10.3 3 80 10 50 30 30 20 20 1.9 ACG ACGACG\n")
    assert fm.read_tandem_repeats(spark, d).first()["consensus"] == "ACG"
    r = put(tmp_path, "x.out", "   SW  perc\nscore div\n\n  463  1.3 0.6 1.7 chr1 10001 10468 (249) + (CCCTAA)n Simple_repeat 1 463 (0) 1\n")
    assert fm.read_repeat_masker(spark, r).first()["start"] == 10000
    e = spark.createDataFrame([("a", "b", 3)], "a string, b string, n long")
    fm.write_dot(e, str(tmp_path / "dot"))
    assert fm.read_dot(spark, str(tmp_path / "dot")).collect() == e.collect()
    k = put(tmp_path, "k.txt", "T\tchr1\t+\t0\t90\t5\t80\t2\t0,50,\t10,90,\n")
    f = put(tmp_path, "l.txt", "a\n\nb\n")
    assert fm.read_list(spark, f).count() == 2
    p = put(tmp_path, "x.psl", "psLayout\n" + "\t".join(["10", "1", "0", "0", "0", "0", "0", "0", "+", "q", "20", "0", "11", "chr1", "100", "5", "30", "2", "5,6,", "0,5,", "5,24,"]) + "\n")
    assert [(x["start"], x["end"]) for x in fm.read_psl(spark, p).first()["exons"]] == [(5, 10), (24, 30)]
    del k


def test_stream(spark, tmp_path):
    from loomspan.streaming import counts

    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0, 1), ("2024-01-01 00:00:05", "a", 2.0, 1), ("2024-01-01 05:00:00", "b", 4.0, 2)], "ts string, event_type string, value double, user_id long")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double, user_id long").parquet(str(tmp_path / "in"))
    q = counts.windowed(s, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
