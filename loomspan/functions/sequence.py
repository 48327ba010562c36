"""Sequence functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """A<->T, C<->G in either case; other characters stay."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


#: Letters whose upper case in full is several letters, and the one letter that stands for it (most keep their own).
_WIDE = [c for c in map(chr, range(0xDF, 0xFB18)) if not 0xD800 <= ord(c) <= 0xDFFF and len(c.upper()) > 1]
_NARROW = "".join("\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in _WIDE)


def upper_prefix(s: Column, n: int) -> Column:
    """The first ``n`` letters, each as one upper-case letter: where the full mapping gives several, the simple one holds (sharp s: U+1E9E)."""
    letters = [F.substring(s, k, 1) for k in range(1, n + 1)]
    return F.concat(*[F.when(F.length(F.upper(c)) <= 1, F.upper(c)).otherwise(F.translate(c, "".join(_WIDE), _NARROW)) for c in letters])


def base_count(s: Column, bases: str) -> Column:
    return F.length(s) - F.length(F.translate(s, bases, ""))


def gc_content(s: Column) -> Column:
    """Share of G and C in any case; null for an empty sequence."""
    return F.when(F.length(s) > 0, base_count(s, "GCgc") / F.length(s))


def melting_temperature(s: Column) -> Column:
    return F.when(F.length(s) > 0, 64.9 + 41 * (base_count(s, "GCgc") - 16.4) / F.length(s))


def cpg_positions(s: Column) -> Column:
    """0-based places of CG, in any case."""
    u = F.upper(s)
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - 2, F.lit(0))), lambda i: F.substring(u, i + 1, 2) == "CG")


def bisulfite(s: Column, methylated: bool = False) -> Column:
    """C becomes T, case kept; methylated: except before G."""
    if not methylated:
        return F.translate(s, "Cc", "Tt")
    return F.regexp_replace(F.regexp_replace(s, "C(?![Gg])", "T"), "c(?![Gg])", "t")


def soft_masked(s: Column) -> Column:
    """Number of lower-case bases."""
    return base_count(s, "acgtn")


def mask(s: Column) -> Column:
    return F.translate(s, "acgtn", "NNNNN")


def gap_positions(s: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), lambda i: F.substring(s, i + 1, 1) == "-")


def ungapped(s: Column) -> Column:
    return F.translate(s, "-", "")


def encode_bases(s: Column) -> Column:
    """Array of small integers: A0 C1 G2 T3 gap4 a5 c6 g7 t8, others 9."""
    place = F.transform(F.split(s, ""), lambda x: F.instr(F.lit("ACGT-acgt"), x) - 1)
    return F.transform(place, lambda i: F.when(i < 0, 9).otherwise(i).cast("smallint"))


def decode_bases(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda i: F.substring(F.lit("ACGT-acgtN"), i.cast("int") + 1, 1)), "")


def chunks(s: Column, size: int, overlap: int) -> Column:
    """Array of (start, seq): starts every size - overlap while they lie in the sequence; the last one is what is left."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(s, i + 1, F.lit(size)).alias("seq")))


def sliding(s: Column, window: int, overlap: int) -> Column:
    """Array of (start, seq) of full windows every window - overlap; a window that ends with the sequence is not made."""
    last = F.length(s) - window - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(window - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(s, i + 1, F.lit(window)).alias("seq")))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, upper-cased, in order."""
    u = F.upper(s)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(u, i, F.lit(k)))


def one_mismatch(kmer: Column, k: int) -> Column:
    """The k patterns that have X in one place."""
    return F.array(*[F.concat(F.substring(kmer, 1, i), F.lit("X"), F.substring(kmer, i + 2, k)) for i in range(k)])


def kmer_counts(df: DataFrame, seq: str, k: int, mismatch: bool = False) -> DataFrame:
    """(kmer, n): occurrences over all sequences; mismatch: of patterns with one X instead."""
    x = df.select(F.explode(kmers(F.col(seq), k)).alias("kmer"))
    if mismatch:
        x = x.select(F.explode(one_mismatch(F.col("kmer"), k)).alias("kmer"))
    return x.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


#: Bases that each ambiguity code stands for.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def motif_pattern(motif: str, least: int = 1) -> str:
    """Regular expression of cores separated by "-", any of them, each repeated ``least`` times or more."""
    core = lambda m: "".join(f"[{AMBIGUITY[c]}]" for c in m.upper())
    return "|".join(f"(?:{core(m)}){{{least},}}" for m in motif.split("-"))


def motif_matches(s: Column, motif: str, least: int = 1) -> Column:
    return F.regexp_extract_all(F.upper(s), F.lit(f"({motif_pattern(motif, least)})"), 1)


def homopolymer_runs(s: Column) -> Column:
    """Lengths of runs of one character, in order."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), 1), F.length)


def is_poly_a(s: Column) -> Column:
    return s.rlike("^([Aa]+|[Tt]+)$")


def is_partial_poly_a(s: Column, n: int) -> Column:
    """All A or all T in the first or the last n characters."""
    return is_poly_a(F.substring(s, 1, n)) | is_poly_a(F.substring(s, -n, n))


def trim_ends(s: Column, letter: str) -> Column:
    """Without runs of ``letter`` (any case) at both ends."""
    c = f"[{letter.upper()}{letter.lower()}]"
    return F.regexp_replace(s, f"^{c}+|{c}+$", "")


def trim_first(s: Column, n: int) -> Column:
    return F.substring(s, n + 1, 1 << 30)


def trim_linker(s: Column, linker: str) -> Column:
    """Without the longest suffix of ``linker`` that the sequence begins with, in any case."""
    cut = F.lit(0)
    for n in range(1, len(linker) + 1):
        cut = F.when(F.lower(F.substring(s, 1, n)) == linker[-n:].lower(), n).otherwise(cut)
    return F.substring(s, cut + 1, F.lit(1 << 30))


def trim_adaptor(s: Column, adaptor: str) -> Column:
    """Cut at the first occurrence of ``adaptor``, or at the longest of its prefixes that the sequence ends with."""
    at = F.instr(F.upper(s), adaptor.upper())
    tail = F.lit(0)
    for n in range(1, len(adaptor)):
        tail = F.when(F.upper(F.substring(s, -n, n)) == adaptor[:n].upper(), n).otherwise(tail)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.substring(s, F.lit(1), F.length(s) - tail))


def open_frames(s: Column) -> Column:
    """From each ATG in each frame to the next stop in frame, the stop included; frames without a stop are left out."""
    u = F.upper(s)
    codon = "(?:(?!TAA|TAG|TGA)[ACGTN]{3})*?(?:TAA|TAG|TGA)"
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(u, i, F.lit(3)) == "ATG")
    return F.filter(F.transform(starts, lambda i: F.regexp_extract(F.substring(u, i, F.lit(1 << 30)), f"^(ATG{codon})", 1)), lambda x: x != "")


def longest_frame(s: Column) -> Column:
    """The longest of ``open_frames`` (first in text order among equals); null if there is none."""
    found = F.array_sort(F.transform(open_frames(s), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.get(found, F.lit(0))["x"]


def splice_orientation(donor: Column, acceptor: Column) -> Column:
    """Strand from an intron's first and last two bases: GT-AG, GC-AG, AT-AC plus; their reverse complements minus; else "*"."""
    pair = F.concat(F.upper(donor), F.lit("-"), F.upper(acceptor))
    return F.when(pair.isin("GT-AG", "GC-AG", "AT-AC"), "+").when(pair.isin("CT-AC", "CT-GC", "GT-AT"), "-").otherwise("*")


def pwm_best(s: Column, matrix: list[list[float]], background: float = 0.25) -> Column:
    """(score, start, strand) of the best placement over both strands: sum of log(p / background); the first among equals. Null when the sequence is shorter than the matrix."""
    w = len(matrix)
    table = [{b: float(p) for b, p in zip("ACGT", row)} for row in matrix]

    def at(u: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, row in enumerate(table):
            base = F.substring(u, i + k, F.lit(1))
            value = F.lit(0.0)
            for b, p in row.items():
                value = F.when(base == b, F.log(F.lit(max(p, 1e-9) / background))).otherwise(value)
            total = total + value
        return total

    u, v = F.upper(s), reverse_complement(F.upper(s))
    starts = F.sequence(F.lit(1), F.length(s) - w + 1)
    score = lambda t, strand: F.transform(starts, lambda i: F.struct((-F.round(at(t, i), 9)).alias("n"), (i - 1).alias("start"), F.lit(strand).alias("strand")))
    best = F.array_min(F.concat(score(u, "+"), score(v, "-")))
    return F.when(F.length(s) >= w, F.struct((-best["n"]).alias("score"), best["start"].alias("start"), best["strand"].alias("strand")))


def mismatches(window: Column, oligo: Column) -> Column:
    """Places at which two texts of one length differ."""
    return F.aggregate(F.zip_with(F.split(window, ""), F.split(oligo, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v)


def oligo_places(seq: Column, oligo: str, most: int) -> Column:
    """0-based places at which ``oligo`` fits with at most ``most`` mismatches, case ignored."""
    n = len(oligo)
    every = F.when(F.length(seq) >= n, F.sequence(F.lit(0), F.length(seq) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda k: mismatches(F.upper(seq.substr(k + 1, F.lit(n))), F.lit(oligo.upper())) <= most)


def to_sequence(text: Column, place: Column) -> Column:
    """Place in the sequence without gaps of a place in an aligned text; -1 on a gap."""
    before = F.length(F.replace(text.substr(F.lit(1), place), F.lit("-"), F.lit("")))
    return F.when(text.substr(place + 1, F.lit(1)) == "-", F.lit(-1)).otherwise(before)


def to_alignment(text: Column, place: Column) -> Column:
    """Place in an aligned text of a place in its sequence without gaps; -1 outside."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda k: (text.substr(k + 1, F.lit(1)) != "-") & (F.length(F.replace(text.substr(F.lit(1), k), F.lit("-"), F.lit(""))) == place))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def without_gap_columns(reference: Column, other: Column) -> Column:
    """The characters of ``other`` at the places where ``reference`` has no gap."""
    return F.array_join(F.zip_with(F.split(reference, ""), F.split(other, ""), lambda a, b: F.when(a == "-", "").otherwise(b)), "")


def information(probs: Column) -> Column:
    """Information content in bits of each column of a weight matrix (four arrays of probabilities): 2 plus the sum of p log2 p."""
    part = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.transform(F.arrays_zip(*[probs[k].alias(f"b{k}") for k in range(4)]), lambda c: F.lit(2.0) + part(c["b0"]) + part(c["b1"]) + part(c["b2"]) + part(c["b3"]))


def reverse_complement_matrix(probs: Column) -> Column:
    """Rows A, C, G, T read backwards and swapped with those of their complements."""
    return F.transform(F.reverse(probs), lambda row: F.reverse(row))


def trimmed_matrix(probs: Column, least: float) -> Column:
    """Columns from the first to the last one with ``least`` bits."""
    good = F.transform(information(probs), lambda v: v >= least)
    first, back = F.array_position(good, True), F.array_position(F.reverse(good), True)
    return F.transform(probs, lambda row: F.when(first > 0, F.slice(row, first.cast("int"), (F.size(row) - first - back + 2).cast("int"))).otherwise(F.array().cast("array<double>")))


def matrix_divergence(p: Column, q: Column) -> Column:
    """Sum over all cells of p log2(p / q); cells with a zero are skipped."""
    cell = lambda a, b: F.when((a > 0) & (b > 0), a * F.log2(a / b)).otherwise(0.0)
    rows = F.zip_with(p, q, lambda a, b: F.aggregate(F.zip_with(a, b, cell), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v)


def all_words(spark, k: int, alphabet: str = "ACGT"):
    """One row (word) for each text of k letters, by digits of a number."""
    n = len(alphabet)
    letters = [F.substring(F.lit(alphabet), 1, n).substr((F.floor(F.col("id") / n**p) % n + 1).cast("int"), F.lit(1)) for p in range(k - 1, -1, -1)]
    return spark.range(n**k).select(F.concat(*letters).alias("word"))


def flows(s: Column, order: str = "TACG") -> Column:
    """How many bases each flow of nucleotides in the cyclic ``order`` takes up, zeros included; the last run of bases, which no flow has ended, is left out.

    Characters other than A, C, G, T are taken out first; case doesn't count.
    """
    runs = F.regexp_extract_all(F.regexp_replace(F.upper(s), "[^ACGT]", ""), F.lit(r"((.)\2*)"), 1)
    place = lambda r: F.translate(F.substring(r, 1, 1), order, "0123").cast("int")
    idle = lambda r, i: F.when(i == 0, place(r)).otherwise(F.pmod(place(r) - place(F.get(runs, i - 1)) - 1, F.lit(4)))
    out = F.flatten(F.transform(runs, lambda r, i: F.concat(F.array_repeat(F.lit(0), idle(r, i)), F.array(F.length(r)))))
    return F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
