"""Binary alignments: blocks of a few ten kilobytes, each compressed on its own, with length-prefixed records across them.

A record can begin only where the one before it ends, so one task reads a file from front to end, block by block,
and holds no more than a batch of rows; many files are read side by side. The writer makes one file per partition.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.genes import blocks_of, cigar
from loomspan.ship import ship

# Fixed values of the format: letters of CIGAR operations and of bases by code, the empty block that ends a file.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of records to a compressed block, rows to a batch.
BLOCK_BYTES, BATCH_ROWS = 60_000, 4096

_TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_INT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_FIXED = struct.Struct("<iiBBHHHiiii")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _Blocks:
    """The decompressed bytes of a stream of blocks, read on demand."""

    def __init__(self, file):
        self.file, self.rest = file, b""

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer only at the end of the file."""
        parts, have = [self.rest], len(self.rest)
        while have < n:
            head = self.file.read(12)
            if not head:
                break
            if len(head) < 12 or head[:3] != b"\x1f\x8b\x08":
                raise ValueError("not a block of compressed alignments")
            extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
            at, size = 0, None
            while at < len(extra):
                kind, length = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
                if kind == b"BC":
                    size = struct.unpack_from("<H", extra, at + 4)[0] + 1
                at += 4 + length
            if size is None:
                raise ValueError("a block without its size")
            body = self.file.read(size - 12 - len(extra))
            parts.append(zlib.decompress(body[:-8], -15))
            have += len(parts[-1])
        whole = b"".join(parts)
        self.rest = whole[n:]
        return whole[:n]


def _hits(tags: bytes) -> int:
    """The NH tag; 1 without it."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if name == b"NH" and kind in _TAG_INT:
            return struct.unpack_from(_TAG_INT[kind], tags, at)[0]
        if kind in _TAG_SIZE:
            at += _TAG_SIZE[kind]
        elif kind == "B":
            at += 5 + _TAG_SIZE[chr(tags[at])] * struct.unpack_from("<I", tags, at + 1)[0]
        else:  # text up to a zero byte
            at = tags.index(b"\0", at) + 1
    return 1


def _records(file) -> Iterator[tuple]:
    """name, flag, chr, start, mapq, cigar, mate_chr, mate_start, seq, nh of each record of a file."""
    blocks = _Blocks(file)
    if blocks.take(4) != b"BAM\1":
        raise ValueError("not a file of binary alignments")
    number = lambda: struct.unpack("<i", blocks.take(4))[0]
    blocks.take(number())
    names = []
    for _ in range(number()):
        names.append(blocks.take(number())[:-1].decode())
        blocks.take(4)
    of = lambda k: names[k] if k >= 0 else "*"
    pair = [a + b for a in BASES for b in BASES]
    while head := blocks.take(4):
        body = blocks.take(size := struct.unpack("<i", head)[0])
        if len(body) < size:
            raise ValueError("a record is cut off")
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, _ = _FIXED.unpack_from(body)
        at = _FIXED.size
        name = body[at : at + n_name - 1].decode()
        at += n_name
        ops = "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in struct.unpack_from(f"<{n_ops}I", body, at)) or "*"
        at += 4 * n_ops
        seq = "".join(map(pair.__getitem__, body[at : at + (n_seq + 1) // 2]))[:n_seq] or "*"
        at += (n_seq + 1) // 2 + n_seq
        yield name, flag, of(ref), pos, mapq, ops, "*" if mate < 0 else of(mate), mate_pos, seq, _hits(body[at:])


_SCHEMA = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chr", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_chr", pa.string()), ("mate_start", pa.int64()), ("seq", pa.string()), ("nh", pa.int32())])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``formats.read_sam`` from the binary files at ``path`` (a file, folder or pattern), one task a file."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, own = _open(uri)
                with store.open_input_stream(own, buffer_size=1 << 20) as f:
                    rows = []
                    for row in _records(f):
                        rows.append(row)
                        if len(rows) == BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    kinds = "name string, flag int, chr string, start long, mapq int, cigar string, mate_chr string, mate_start long, seq string, nh int"
    n = max(1, files.count())
    x = files.repartition(min(n, 10_000)).mapInArrow(run, kinds)
    bit = lambda v: F.col("flag").bitwiseAND(F.lit(v)) != 0
    return x.select(
        "name", "flag", "chr", "start", "mapq", "cigar", F.when(F.col("cigar") != "*", blocks_of(F.col("start"), F.col("cigar"))).alias("exons"),
        F.when(bit(16), "-").otherwise("+").alias("strand"), (~bit(4)).alias("mapped"), bit(1024).alias("duplicate"), bit(128).alias("second"),
        "mate_chr", "mate_start", "seq", "nh",
    )


def _block(body: bytes) -> bytes:
    """One compressed block."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(body) + z.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<HccHH", 6, b"B", b"C", 2, len(data) + 25)
    return head + data + struct.pack("<II", zlib.crc32(body), len(body))


def _bin(lo: int, hi: int) -> int:
    """The smallest bin of the format's index that holds [lo, hi)."""
    hi -= 1
    first = 4681
    for shift in (14, 17, 20, 23, 26):
        if lo >> shift == hi >> shift:
            return first + (lo >> shift)
        first = (first - 1) // 8
    return 0


def _record(ref: int, start: int, end: int, name: str, flag: int, mapq: int, ops: str) -> bytes:
    own = name.encode() + b"\0"
    codes = [int(n) << 4 | OPERATIONS.index(k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", ops)]
    body = _FIXED.pack(ref, start, len(own), mapq, _bin(start, end), len(codes), flag, 0, -1, -1, 0) + own + struct.pack(f"<{len(codes)}I", *codes)
    return struct.pack("<i", len(body)) + body


def write_bam(genes: DataFrame, path: str, mapq: int = 30) -> None:
    """Models (name, chr, strand, exons) as spliced alignments without sequences, in files sorted by position, one per partition.

    The names and lengths of the chromosomes, one row each, come to the driver for the header. A file gets its name when it
    is whole, so a task that runs again replaces its own. An empty table gives one file without records.
    """
    spark = genes.sparkSession
    ship(spark)
    ends = F.array_max(F.transform("exons", lambda e: e["end"]))
    x = genes.select("chr", F.array_min(F.transform("exons", lambda e: e["start"])).alias("start"), ends.alias("end"), "name", F.when(F.col("strand") == "-", 16).otherwise(0).alias("flag"), cigar(F.col("exons")).alias("cigar"))
    chroms = sorted((r["chr"], r["n"]) for r in x.groupBy("chr").agg(F.max("end").alias("n")).collect())
    number = {c: k for k, (c, _) in enumerate(chroms)}
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in chroms)).encode()
    refs = b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in chroms)
    header = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(chroms)) + refs

    store, base = _open(path)
    store.create_dir(base, recursive=True)
    if not chroms:
        with store.open_output_stream(f"{base}/part-00000.bam") as f:
            f.write(_block(header) + END_BLOCK)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = _open(path)
        own, n = f"{base}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(own) as f:
            for lo in range(0, len(header), BLOCK_BYTES):
                f.write(_block(header[lo : lo + BLOCK_BYTES]))
            held = bytearray()
            for batch in batches:
                for c, s, e, name, flag, ops in zip(*(col.to_pylist() for col in batch.columns)):
                    held += _record(number[c], s, e, name, flag, mapq, ops)
                    n += 1
                    while len(held) >= BLOCK_BYTES:
                        f.write(_block(bytes(held[:BLOCK_BYTES])))
                        del held[:BLOCK_BYTES]
            if held:
                f.write(_block(bytes(held)))
            f.write(END_BLOCK)
        store.move(own, f"{base}/part-{part:05d}.bam")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    x.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start", "name").mapInArrow(put, "n long").agg(F.sum("n")).collect()
