"""Document fingerprints by SimHash (operator 5).

The terms of a text are its words and its pairs of neighbouring words; short texts also give runs of four
bytes. Each distinct term votes with its weight, 1 + log(count) and half of that for single words, for or
against each of 128 bits by the bits of its hash; a bit is set where the votes are positive.

``near_pairs`` finds all pairs of fingerprints within a Hamming radius by block tables: the bits are cut into
radius + LEAD blocks; two fingerprints within the radius agree in LEAD whole blocks at least, so one table for each
choice of LEAD blocks, keyed by them (the permutation that puts them first), finds every pair by equi-joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, ship, tidy

FINGERPRINT_BITS, LEAD = 128, 3
#: Texts of fewer bytes also give runs of four bytes.
SHORT_BYTES = 200
WORDS_KEPT = 400_000

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _M2
    x = (x ^ (x >> _U(29))) * _M1
    return x ^ (x >> _U(32))


def fingerprint(text: str) -> bytes:
    """128 bits; a text without words or bytes has all bits 0."""
    body = text.encode()
    words = body.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    terms, weights = [h], [np.full(len(h), 0.5)]
    if len(h) > 1:
        terms.append(_mix(h[:-1]) * _M1 + h[1:])
        weights.append(np.ones(len(h) - 1))
    if 4 <= len(body) < SHORT_BYTES:
        b = np.frombuffer(body, np.uint8).astype(np.uint64)
        terms.append((b[:-3] << _U(24)) | (b[1:-2] << _U(16)) | (b[2:-1] << _U(8)) | b[3:] | _U(1 << 40))
        weights.append(np.full(len(b) - 3, 0.5))
    term, first, count = np.unique(np.concatenate(terms), return_index=True, return_counts=True)
    weight = (np.concatenate(weights)[first] * (1 + np.log(count))).astype(np.float32)
    votes = np.zeros(FINGERPRINT_BITS, np.float32)
    for lo in range(0, len(term), 8192):
        t = term[lo : lo + 8192]
        bits = np.unpackbits(np.stack([_mix(t), _mix(t + _M1)], axis=1).view(np.uint8), axis=1)
        w = weight[lo : lo + 8192]
        votes += 2 * (w @ bits.astype(np.float32)) - w.sum()
    return np.packbits(votes > 1e-3).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the share of bits that differ."""
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / FINGERPRINT_BITS


def edited(text: str, following: str) -> str:
    """The last quarter of the characters (rounded down) replaced by the first as many of ``following``, or by all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _row(doc_id: int | None, text: str, own: bytes, following: str, its: bytes) -> tuple:
    new = edited(text, following)
    theirs = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), theirs.hex(), likeness(own, theirs), likeness(own, its)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, its edited text's, and their likeness and that to the next document's.

    The next document is the one with the next doc_id (null first; of equal ids by the hash of the text), after
    the last the first; a single document is its own next. The edited text is ``edited(text, next text)``.
    Null texts count as empty. Equal texts have equal fingerprints. An empty table gives no rows. Other columns
    are not read.

    The documents are range-partitioned once; each partition is read in order, and the last document of a
    partition, whose next one begins another, is finished in a second step over one row per partition.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None

        def out(done, first_text=None, last_text=None):
            cols = [pa.array(x, kind) for x, kind in zip(zip(*done), _KINDS)]
            size = len(done)
            edge = [pa.array([part] * size, pa.int64()), pa.array([first_text] * size, pa.string()), pa.array([last_text] * size, pa.string())]
            return pa.RecordBatch.from_arrays([*cols, *edge], names=[*_NAMES, "part", "first_text", "last_text"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                done = []
                x = batch.slice(lo, 512)
                for doc_id, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    own = fingerprint(text) if last is None or text != last[1] else last[2]
                    if last is not None:
                        done.append(_row(*last, text, own))
                    else:
                        first = text
                    last = (doc_id, text, own)
                if done:
                    yield out(done)
        if last is not None:
            yield out([(last[0], len(last[1]), None, last[2].hex(), None, None, None)], first, last[1])

    scratch = Scratch(spark)
    main = scratch.cut(dealt.mapInArrow(tidy(run), f"{_FIELDS}, part long, first_text string, last_text string"), "main")
    ends = main.where("last_text is not null")
    parts = sorted(r["part"] for r in ends.select("part").collect())  # one small number per partition
    if not parts:
        return main.select(*_NAMES)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    heads = ends.select(F.col("part").alias("next_part"), "first_text")
    seams = ends.select("doc_id", "part", "last_text").join(F.broadcast(following), "part").join(heads, "next_part").select("doc_id", "last_text", "first_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_row(i, a, fingerprint(a), b, fingerprint(b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done), _KINDS)], names=_NAMES)

    return main.where("last_text is null").select(*_NAMES).union(seams.mapInArrow(tidy(finish), _FIELDS))


def _word(hex_: Column, k: int) -> Column:
    """Hex digits 8k to 8k + 7 as a number."""
    return F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long")


def near_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints (hex strings of equal length) in column ``fingerprint``, a < b, at most ``radius`` bits apart.

    Equal fingerprints are one class and make no pairs; nulls make none. Every pair is found, and returned once.
    """
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    digits = FINGERPRINT_BITS // 4
    blocks = radius + LEAD
    if blocks > digits:
        raise ValueError("the radius leaves no whole hex digit a block")
    edge = [digits * k // blocks for k in range(blocks + 1)]
    piece = [F.substring("fingerprint", edge[k] + 1, edge[k + 1] - edge[k]) for k in range(blocks)]
    tables = list(combinations(range(blocks), LEAD))
    keys = F.array(*[F.concat(F.lit(f"{t}:"), *[piece[k] for k in chosen]) for t, chosen in enumerate(tables)])
    rows = distinct.select("fingerprint", F.explode(keys).alias("key"))
    a, b = rows.withColumnRenamed("fingerprint", "a"), rows.withColumnRenamed("fingerprint", "b")
    words = digits // 8
    distance = sum((F.bit_count(_word(F.col("a"), k).bitwiseXOR(_word(F.col("b"), k))) for k in range(1, words)), F.bit_count(_word(F.col("a"), 0).bitwiseXOR(_word(F.col("b"), 0))))
    # the planner takes the rows for as small as the table before explode(): unhinted it broadcasts them, by way of the driver
    both = a.join(b.hint("merge"), "key").where("a < b").withColumn("distance", distance).where(F.col("distance") <= radius)
    return both.select("a", "b", "distance").distinct()


def fingerprints_with_neighbours(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint_with_next`` with class_id and n_near (long).

    A class is the rows of one fingerprint, class_id its smallest doc_id (null if none has one). n_near: other rows
    whose fingerprint is equal or within ``radius`` bits. Repeated rows and rows without id count as rows of their own;
    null texts count as empty, and texts without words share one fingerprint. Long texts are read whole. An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(fingerprint_with_next(docs), "rows")
    classes = scratch.cut(rows.groupBy(F.col("fingerprint").alias("p")).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    pairs = scratch.cut(near_pairs(classes.select(F.col("p").alias("fingerprint")), radius), "pairs")
    ways = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = ways.join(classes.select(F.col("p").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("n"))
    known = classes.join(near, classes["p"] == near["a"], "left").select("p", "class_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_near"))
    return rows.join(known, rows["fingerprint"] == known["p"]).drop("p")
