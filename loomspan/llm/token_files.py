"""Token ids in binary files (operator 9).

A *shard* file holds the documents of one range of ids in ascending order:

    magic "LSTK0001" | sha256 of the dictionary (32 bytes) | one zstandard frame per document, each
    compressed alone with the shared dictionary | index: per document doc_id (int64), start of its ids
    within the shard (uint64), number of ids (uint64), offset of its frame (uint64) | number of
    documents (uint64), offset of the index (uint64)

A frame's content is the document's ids as little-endian unsigned 32-bit integers. To read one short
document: read the last 16 bytes, the index, then its frame only. ``dictionary-<sha256>.zdict`` stands
beside the shards. Shards are written under a temporary name and renamed, so a task that runs twice
leaves one whole file.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bpe import PieceEncoder
from loomspan.llm.common import Scratch, hash_fraction, ship, tidy

MAGIC = b"LSTK0001"
INDEX = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u8"), ("offset", "<u8")])
#: Bounded sample on which the dictionary is trained: documents, ids of each (a span from anywhere in the whole text), size of the dictionary.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 2048, 64 << 10
#: Texts (bytes, roughly) that go into one shard.
SHARD_BYTES = 24 << 20
#: Bytes of one generation of remembered ids (see ``bpe``).
CACHED_BYTES = 64 << 20
#: The fixed pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class LibraryEncoder(PieceEncoder):
    """The tokenizers library, asked once for each pre-token.

    With a byte-level pre-tokenizer (``add_prefix_space`` off) a text's ids are those of its pre-tokens, one
    after the other; they are found and remembered as in ``PieceEncoder``. Texts with the string of an added
    token, and all texts of other tokenizers, go to the library whole. ``special``: whether special tokens' strings
    in a text become special ids, the library's default (off: ordinary text).
    """

    def __init__(self, body: bytes, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(body)
        self.tokenizer.encode_special_tokens = not special
        kind = self.tokenizer.pre_tokenizer
        self.by_piece = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        super().__init__(self.of_piece, BYTE_LEVEL_PATTERN, CACHED_BYTES)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}
        self.space = chr(self.alphabet[ord(" ")])

    def of_piece(self, piece: str) -> bytes:
        """Ids of one pre-token by the library's model."""
        plain = piece.isascii() and piece.isprintable()  # only its spaces change
        letters = piece.replace(" ", self.space) if plain else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return super().encode(text) if self.by_piece and not any(t in text for t in self.added) else self.library(text)


@functools.lru_cache(maxsize=2)
def _encoder(body: bytes, special: bool) -> LibraryEncoder:
    return LibraryEncoder(body, special)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays; empty if there are too few to train one."""
    import zstandard

    samples = [s for s in samples if s]
    size = min(size, sum(map(len, samples)) // 10)
    if len(samples) < 8 or size < 512:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def shard_bytes(docs: list[tuple[int, bytes]], dictionary: bytes, level: int = 1) -> bytes:
    """One shard of (doc_id, ids) in the order given."""
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    out, index, start = [MAGIC, hashlib.sha256(dictionary).digest()], np.zeros(len(docs), INDEX), 0
    at = sum(map(len, out))
    for k, (doc_id, ids) in enumerate(docs):
        frame = pack.compress(ids)
        index[k] = (doc_id, start, len(ids) // 4, at)
        out.append(frame)
        at += len(frame)
        start += len(ids) // 4
    return b"".join([*out, index.tobytes(), struct.pack("<QQ", len(docs), at)])


class ShardReader:
    """Random access to one shard: ``index`` (fields of INDEX) and ``ids(k)``."""

    def __init__(self, file, dictionary: bytes):
        import zstandard

        size = file.size()
        head = file.read_at(40, 0)
        if head[:8] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or written with another dictionary")
        n, self.end = struct.unpack("<QQ", file.read_at(16, size - 16))
        self.file, self.index = file, np.frombuffer(file.read_at(n * INDEX.itemsize, self.end), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> bytes:
        lo = int(self.index["offset"][k])
        hi = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.end
        return self.unpack.decompress(self.file.read_at(hi - lo, lo))


@dataclass
class TokenFiles:
    """What ``write`` leaves: the folder, the dictionary's hash and, for each shard in order, its file, documents and ids before it."""

    folder: str
    dictionary_sha256: str
    shards: list[tuple[str, int, int]]


def _sample(rows: DataFrame, n_rows: int, body: bytes, special: bool) -> list[bytes]:
    """Ids of about SAMPLE_DOCS texts of any length; of each a span of SAMPLE_IDS at most, cut out on the executors at a place that the text's hash picks."""
    shared = rows.sparkSession.sparkContext.broadcast(body)
    drawn = rows.where((F.col("text") != "") & (hash_fraction("doc_id", "text") < min(1.0, 1.2 * SAMPLE_DOCS / max(n_rows, 1)))).select("text", F.xxhash64("doc_id", "text").alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, special)
        for batch in batches:
            for text, h in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = encoder.encode(text.as_py())
                at = 4 * (h % max(1, len(ids) // 4 - SAMPLE_IDS + 1))
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([ids[at : at + 4 * SAMPLE_IDS]], pa.binary())], names=["h", "ids"])

    return [r["ids"] for r in drawn.mapInArrow(tidy(cut), "h long, ids binary").orderBy("h", "ids").limit(2 * SAMPLE_DOCS).collect()]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shard_size: int = SHARD_BYTES, special: bool = False) -> TokenFiles:
    """Encode every whole text with the tokenizers library, append ``end_id`` and write shards in ascending doc_id order.

    ``folder``: a URI that the executors share. A null or empty text is its end id alone. A null doc_id
    comes first and is written as the smallest 64-bit integer. Rows with one doc_id stay separate, in order
    of their texts' hash. An empty table leaves no shards. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        body = f.read()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, n_rows = rows.agg(F.sum(F.length("text").cast("long")), F.count(F.lit(1))).first()
    size = size or 0
    dictionary = train_dictionary(_sample(rows, n_rows, body, special))
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary-{digest}.zdict") as f:
        f.write(dictionary)
    n = max(1, -(-size // shard_size), min(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    shared = spark.sparkContext.broadcast((body, dictionary))
    end = struct.pack("<I", end_id)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, docs = TaskContext.get().partitionId(), _encoder(shared.value[0], special), []
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                x = batch.slice(lo, 512)
                ids = map(encoder.encode, x.column(1).to_pylist())
                docs += zip((-(1 << 63) if i is None else i for i in x.column(0).to_pylist()), (i + end for i in ids))
        if not docs:
            return
        name, (store, base) = f"shard-{part:06d}.lstk", _open(folder)
        own = f"{base}/.{uuid.uuid4().hex}-{name}"
        with store.open_output_stream(own) as f:
            f.write(shard_bytes(docs, shared.value[1]))
        store.move(own, f"{base}/{name}")
        total = sum(len(ids) for _, ids in docs) // 4
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(docs)]), pa.array([total])], names=["part", "name", "n_docs", "n_tokens"])

    done = sorted(dealt.mapInArrow(tidy(put), "part long, name string, n_docs long, n_tokens long").collect())
    shards, before = [], 0
    for _, name, n_docs, n_tokens in done:
        shards.append((name, n_docs, before))
        before += n_tokens
    return TokenFiles(folder, digest, shards)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Rows doc_id, start (ids of all documents before it), n_tokens, ids (binary) of every document in the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files.shards:
        return spark.createDataFrame([], schema)
    folder, digest = files.folder, files.dictionary_sha256
    shards = spark.createDataFrame([(name, before) for name, _, before in files.shards], "name string, before long").repartition(len(files.shards), "name")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, before in batch.itertuples(index=False):
                store, base = _open(folder)
                with store.open_input_file(f"{base}/dictionary-{digest}.zdict") as f:
                    dictionary = f.read()
                with store.open_input_file(f"{base}/{name}") as f:
                    shard = ShardReader(f, dictionary)
                    for lo in range(0, len(shard.index), 512):
                        x = shard.index[lo : lo + 512]
                        yield pd.DataFrame({"doc_id": x["doc_id"], "start": x["start"].astype("int64") + before, "n_tokens": x["n_tokens"].astype("int64"), "ids": [shard.ids(k) for k in range(lo, lo + len(x))]})

    return shards.mapInPandas(get, schema)


def written_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all documents, encoded as the library does by default, read the files back: doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the ids' bytes)."""
    spark = docs.sparkSession
    files = write(docs, Scratch(spark).path("tokens"), tokenizer_path, end_id, special=True)
    lost = F.col("doc_id") == F.lit(-(1 << 63))
    return read(spark, files).select(F.when(~lost, F.col("doc_id")).alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
