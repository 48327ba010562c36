"""Queries of the sequence functions, over letters A C G T N of the benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import sequence as sq
from loomspan.plans.bind import SEQS, query, table, texts

@query(f"WITH {SEQS} SELECT id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc, length(regexp_replace(seq, '[^GCgc]', '', 'g')) / length(seq) AS gc, (length(seq) - length(translate(seq, 'Aa', '')))::INTEGER AS a, round(64.9 + 41 * (length(regexp_replace(seq, '[^GCgc]', '', 'g')) - 16.4) / length(seq), 6) AS tm FROM q")
def sequence_composition(spark, d):
    return texts(spark, d).select("id", sq.reverse_complement(F.col("seq")).alias("rc"), sq.gc_content(F.col("seq")).alias("gc"), sq.base_count(F.col("seq"), "Aa").alias("a"), F.round(sq.melting_temperature(F.col("seq")), 6).alias("tm"))


@query(f"WITH {SEQS} SELECT id, list_filter(range(0, greatest(length(seq) - 1, 1)), lambda i: upper(seq[i + 1 : i + 2]) = 'CG') AS cpg FROM q")
def sequence_cpg(spark, d):
    return texts(spark, d).select("id", F.transform(sq.cpg_positions(F.col("seq")), lambda i: i.cast("long")).alias("cpg"))


@query(f"WITH {SEQS} SELECT id, translate(seq, 'Cc', 'Tt') AS plain, list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN upper(seq[i]) = 'C' AND upper(seq[i + 1]) <> 'G' THEN translate(seq[i], 'Cc', 'Tt') ELSE seq[i] END), 'string_agg', '') AS methylated FROM q")
def sequence_bisulfite(spark, d):
    return texts(spark, d).select("id", sq.bisulfite(F.col("seq")).alias("plain"), sq.bisulfite(F.col("seq"), methylated=True).alias("methylated"))


@query(f"WITH {SEQS} SELECT id, length(regexp_replace(seq, '[^acgtn]', '', 'g'))::INTEGER AS masked, translate(seq, 'acgtn', 'NNNNN') AS hard, array_to_string(list_transform(string_split(seq, ''), lambda x: CASE WHEN instr('ACGT-acgt', x) = 0 THEN 9 ELSE instr('ACGT-acgt', x) - 1 END), ',') AS codes, translate(seq, 'n', 'N') AS decoded FROM q")
def sequence_masks_and_codes(spark, d):
    x = texts(spark, d).withColumn("c", sq.encode_bases(F.col("seq")))
    return x.select("id", sq.soft_masked(F.col("seq")).alias("masked"), sq.mask(F.col("seq")).alias("hard"), F.array_join("c", ",").alias("codes"), sq.decode_bases(F.col("c")).alias("decoded"))


@query(f"WITH {SEQS}, x AS (SELECT id, seq, unnest(range(0, greatest(length(seq) - 1, 0) + 1, 15)) AS start FROM q) SELECT id, start, seq[start + 1 : start + 20] AS piece FROM x")
def sequence_chunks(spark, d):
    return texts(spark, d).select("id", F.explode(sq.chunks(F.col("seq"), 20, 5)).alias("x")).select("id", F.col("x.start").cast("long").alias("start"), F.col("x.seq").alias("piece"))


@query(f"WITH {SEQS}, x AS (SELECT id, seq, unnest(range(0, length(seq) - 20, 15)) AS start FROM q WHERE length(seq) > 20) SELECT id, start, seq[start + 1 : start + 20] AS piece FROM x")
def sequence_sliding(spark, d):
    return texts(spark, d).select("id", F.explode(sq.sliding(F.col("seq"), 20, 5)).alias("x")).select("id", F.col("x.start").cast("long").alias("start"), F.col("x.seq").alias("piece"))


@query(f"WITH {SEQS}, x AS (SELECT upper(seq[i : i + 4]) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM q)) SELECT kmer, count(*) AS n FROM x GROUP BY kmer")
def sequence_kmers(spark, d):
    return sq.kmer_counts(texts(spark, d), "seq", 5)


@query(f"WITH {SEQS}, x AS (SELECT upper(seq[i : i + 4]) AS k FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM q)), y AS (SELECT k[1 : j] || 'X' || k[j + 2 : 5] AS kmer FROM (SELECT k, unnest(range(0, 5)) AS j FROM x)) SELECT kmer, count(*) AS n FROM y GROUP BY kmer")
def sequence_kmers_mismatch(spark, d):
    return sq.kmer_counts(texts(spark, d), "seq", 5, mismatch=True)


@query(f"WITH {SEQS} SELECT id, regexp_extract_all(upper(seq), '(?:[A][CGT][AG]){{1,}}|(?:[CT][T]){{1,}}') AS hits, list_transform(regexp_extract_all(regexp_replace(upper(seq), '(A+|C+|G+|T+|N+)', '\\1|', 'g'), '[ACGTN]+'), lambda x: length(x)::INTEGER) AS runs FROM q")
def sequence_motifs(spark, d):
    return texts(spark, d).select("id", sq.motif_matches(F.col("seq"), "ABR-YT").alias("hits"), sq.homopolymer_runs(F.upper(F.col("seq"))).alias("runs"))


@query(f"WITH {SEQS} SELECT id, regexp_replace(seq, '^[Aa]+|[Aa]+$', '', 'g') AS ends, seq[4:] AS rest, regexp_matches(left(seq, 2), '^([Aa]+|[Tt]+)$') OR regexp_matches(right(seq, 2), '^([Aa]+|[Tt]+)$') AS poly, regexp_matches(seq, '^([Aa]+|[Tt]+)$') AS poly_all FROM q")
def sequence_trims(spark, d):
    return texts(spark, d).select("id", sq.trim_ends(F.col("seq"), "a").alias("ends"), sq.trim_first(F.col("seq"), 3).alias("rest"), sq.is_partial_poly_a(F.col("seq"), 2).alias("poly"), sq.is_poly_a(F.col("seq")).alias("poly_all"))


@query(f"""WITH {SEQS}, n AS (SELECT id, seq, unnest(range(0, 5)) AS n FROM q),
l AS (SELECT id, max(n) FILTER (lower(seq[1 : n]) = right('ttan', n)) AS cut, max(n) FILTER (n < 4 AND upper(right(seq, n)) = left('TAGA', n)) AS tail FROM n GROUP BY id)
SELECT id, seq[cut + 1 :] AS linker, CASE WHEN instr(upper(seq), 'TAGA') > 0 THEN left(seq, instr(upper(seq), 'TAGA') - 1) ELSE left(seq, length(seq) - tail) END AS adaptor FROM q JOIN l USING (id)""")
def sequence_linker_adaptor(spark, d):
    return texts(spark, d).select("id", sq.trim_linker(F.col("seq"), "TTAN").alias("linker"), sq.trim_adaptor(F.col("seq"), "TAGA").alias("adaptor"))


@query(f"""WITH {SEQS}, s AS (SELECT id, upper(seq) AS u, unnest(range(1, greatest(length(seq) - 2, 1) + 1)) AS i FROM q), a AS (SELECT id, u[i:] AS t FROM s WHERE u[i : i + 2] = 'ATG'),
c AS (SELECT id, t, list_filter(range(1, length(t) - 1, 3), lambda k: t[k : k + 2] IN ('TAA', 'TAG', 'TGA'))[1] AS stop FROM a), o AS (SELECT id, t[1 : stop + 2] AS orf FROM c WHERE stop IS NOT NULL)
SELECT id, count(orf) AS n, (max(length(orf)))::INTEGER AS longest, arg_min(orf, (-length(orf), orf)) AS best FROM (SELECT q.id, orf FROM q LEFT JOIN o USING (id)) GROUP BY id""")
def sequence_open_frames(spark, d):
    x = texts(spark, d).withColumns({"o": sq.open_frames(F.col("seq")), "best": sq.longest_frame(F.col("seq"))})
    return x.select("id", F.size("o").cast("long").alias("n"), F.length("best").alias("longest"), "best")


@query(f"WITH {SEQS} SELECT id, CASE WHEN p IN ('GT-AG', 'GC-AG', 'AT-AC') THEN '+' WHEN p IN ('CT-AC', 'CT-GC', 'GT-AT') THEN '-' ELSE '*' END AS strand FROM (SELECT id, upper(left(seq, 2)) || '-' || upper(right(seq, 2)) AS p FROM q)")
def sequence_splice_orientation(spark, d):
    return texts(spark, d).select("id", sq.splice_orientation(F.substring(F.col("seq"), 1, 2), F.substring(F.col("seq"), -2, 2)).alias("strand"))


#: A 4-column matrix for the query (rows: places; columns: A, C, G, T).
PWM = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.1, 0.2, 0.6, 0.1], [0.25, 0.25, 0.25, 0.25], [0.05, 0.05, 0.05, 0.85]]
_PWM = "[" + ", ".join("[" + ", ".join(map(str, r)) + "]::DOUBLE[]" for r in PWM) + "]"


@query(f"""WITH {SEQS}, t AS (SELECT id, upper(seq) AS u, '+' AS strand FROM q UNION ALL SELECT id, reverse(translate(upper(seq), 'ACGT', 'TGCA')), '-' FROM q),
w AS (SELECT id, strand, u, unnest(range(0, length(u) - 4)) AS start FROM t WHERE length(u) >= 5),
s AS (SELECT id, strand, start, round(list_sum(list_transform(range(1, 6), lambda k: CASE WHEN instr('ACGT', u[start + k]) > 0 THEN ln(({_PWM})[k][instr('ACGT', u[start + k])] / 0.25) ELSE 0 END)), 9) AS score FROM w)
SELECT id, score, start, strand FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, strand) AS k FROM s) WHERE k = 1""")
def sequence_pwm(spark, d):
    x = texts(spark, d).withColumn("x", sq.pwm_best(F.col("seq"), PWM)).where("x is not null")
    return x.select("id", "x.score", F.col("x.start").cast("long").alias("start"), "x.strand")


@query("SELECT conv_id, turn, length(text) AS n, upper(left(text, 5)) AS barcode FROM conversations WHERE upper(left(text, 5)) IN (SELECT upper(left(text, 5)) FROM conversations GROUP BY 1 HAVING count(*) > 1)")
def sequence_barcode_split(spark, d):
    x = table(spark, d, "conversations").withColumn("barcode", sq.upper_prefix(F.col("text"), 5))
    codes = x.groupBy("barcode").count().where("count > 1").select("barcode")
    return x.join(codes, "barcode").select("conv_id", "turn", F.length("text").cast("long").alias("n"), "barcode")
