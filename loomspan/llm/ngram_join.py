"""N-gram Jaccard join by parity sketches (operator 3).

A document is the set of its distinct word shingles. Two sets link when
``den * |A & B| >= num * |A | B|``. Then ``|A ^ B| <= d = (den - num) * (|A| + |B|) // (den + num)``.

*Size bands.* Sizes are cut into bands; a document takes part in its own band and in those of the larger
sizes that it can still link with, so each linked pair meets in the band of its larger member.

*Pigeonhole.* In a band with largest size U, ``d <= D = (den - num) * 2U // (den + num)``. The shingles are
dealt by hash into more than D blocks, and each block is summed up as the XOR of its shingles' hashes. A
linked pair differs in at most D blocks, so it agrees in one at least, and is found by an equi-join on
(band, block, XOR). To keep empty blocks out of the join there are some spare blocks: a document with no more
empty blocks than spare ones must agree with its partner in a block that isn't empty. Documents with more
repeat the same with another dealing (both of a pair do, or one of them has found the other); the last
dealing also joins empty blocks, so no pair is lost. The first dealing leaves out shingles that a sample
shows to be common: the bound holds for the other shingles too, and boilerplate then makes no candidates.

*Sketch bound.* One bit for each shingle, XORed into a bit sketch: the Hamming distance of two sketches is at most
``|A ^ B|``, so candidates with a larger distance than d are dropped before any text is read; first by 128 bits
that travel with the join keys, then by sketches of about as many bits as the set has shingles.

*Verification.* The texts of the remaining pairs are compared exactly (on 64-bit shingle hashes).

*Groups of copies.* Equal sets are one class with one representative and are never paired. In a block that
many share, only a forest of nearest pairs is verified at first; further pairs are compared only where their
members are not in one component by then. Large blocks are cut into tiles; members travel to a tile with their
sketches, those with a near partner there once more with their shingle hashes, and a tile gives back a forest of
links, so rows grow with members and not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import BROADCAST_IDS, Scratch, components, hash_fraction, only_ids, release, ship, tidy

#: Rows of a block up to which all its pairs are compared at once; larger blocks are cut into tiles of about this size.
TILE = 512
#: Shingles of a tile's members, about.
TILE_HASHES = 1 << 20
#: Bounded sample that shows common shingles: documents, least share of them, most shingles kept.
SAMPLE_DOCS, COMMON_SHARE, COMMON_MOST = 2000, 0.002, 200_000
#: Ratio of the sizes that a band spans, number of dealings, and standard deviations of the number of empty blocks that the spare ones hold.
BAND, DEALINGS, SPARE_SIGMAS = 1.5, 4, 2.0
WORDS_KEPT = 150_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M1
    x = (x ^ (x >> _U(29))) * _M2
    return x ^ (x >> _U(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = _WordHash()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words (fewer words: the whole sequence as one; none: empty).

    Words are runs of characters other than ASCII white space; A-Z are lower-cased.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(out))


class Bands:
    """Sizes cut into bands, with the blocks of each. Link: den * |A & B| >= num * |A | B|."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]

    def of(self, size: int) -> int:
        e = self.edges
        while e[-1] <= size:
            e.append(max(e[-1] + 1, int(e[-1] * BAND)))
        return int(np.searchsorted(e, size, side="right")) - 1

    def bound(self, a, b):
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int]:
        """Largest difference D of a linked pair in the band, and number of blocks."""
        most = self.edges[band + 1] - 1
        d = self.bound(most, most)
        if not d:
            return 0, 1
        spare = 1
        for _ in range(30):  # until it holds the empty blocks to expect of the band's smallest sets, and some more
            n = d + 1 + spare
            empty = n * math.exp(-self.edges[band] / n)
            if spare >= empty + SPARE_SIGMAS * math.sqrt(empty):
                break
            spare = math.ceil(empty + SPARE_SIGMAS * math.sqrt(empty))
        return d, d + 1 + spare


def _keys(hashes: np.ndarray, common: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of one document."""
    size, out, deals = len(hashes), [], {}
    first = bands.of(size)
    last = bands.of(size * bands.den // bands.num)
    for band in range(first, last + 1):
        d, n = bands.blocks(band)
        if not d:
            continue  # only equal sets link at these sizes
        if band > first and bands.bound(size, bands.edges[band]) < bands.edges[band] - size:
            continue
        for deal in range(DEALINGS):
            if deal not in deals:
                if deal:
                    deals[deal] = np.sort(_mix(hashes + _U(deal)))
                elif len(common):
                    deals[deal] = hashes[common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes]
                else:
                    deals[deal] = hashes
            h = deals[deal]
            block = ((h >> _U(32)) * _U(n)) >> _U(32)
            starts = np.flatnonzero(np.diff(block, prepend=_U(n + 1))) if len(h) else np.zeros(0, np.int64)
            code = _U((band << 36) + (deal << 32))
            got = block[starts]
            out.append(_mix((np.bitwise_xor.reduceat(h, starts) if len(starts) else got) + _mix(got + code)))
            if n - len(starts) <= n - d - 1:
                break
            if deal == DEALINGS - 1:
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), got)
                out.append(_mix(_mix(empty + code) + _M2))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes & _U(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def whole_sketch(hashes: np.ndarray) -> bytes:
    """One bit for each hash, XORed into the smallest power of two of bits that is 128 or more and not below the set's size."""
    bits = 1 << max(7, (max(len(hashes), 1) - 1).bit_length())
    parity = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is first folded to the other's length."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a) * 8, len(b) * 8
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _near(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole sketches are within the bound: no linked pair is dropped."""
    s = sketch.where("n > 0").select("doc_id", "n", "bits")
    both = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [sketch_distance(x, y) <= (den - num) * (n + m) // (den + num) for n, m, x, y in zip(na, nb, sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), bits (its whole sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out, bits = np.zeros((3, batch.num_rows), np.int64), []
            for k, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_py(), width)
                out[0, k] = len(h)
                bits.append(whole_sketch(h))
                out[1:, k] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out), pa.array(bits, pa.binary())], names=["doc_id", "n", "f1", "f2", "bits"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, bits binary")


def _key_rows(docs: DataFrame, width: int, num: int, den: int, common: bytes) -> DataFrame:
    """key, a (doc_id), n, s1, s2 (parity sketch): one row for each join key of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, known = Bands(num, den), np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids, fixed, keys = part.column(0).to_numpy(), [], []
                for text in part.column(1):
                    h = shingle_hashes(text.as_py(), width)
                    fixed.append((len(h), *_sketch(h)))
                    keys.append(_keys(h, known, bands) if len(h) else h)
                times = [len(k) for k in keys]
                cols = [np.repeat(c, times) for c in (ids, *np.array(fixed, np.int64).T)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, cols)], names=["key", "a", "n", "s1", "s2"])

    return docs.mapInArrow(tidy(run), "key long, a long, n long, s1 long, s2 long")


def _common(docs: DataFrame, width: int) -> bytes:
    """Hashes of the shingles in at least COMMON_SHARE of a bounded sample, sorted. Any set of hashes leaves the join exact."""
    share = min(1.0, 1.5 * SAMPLE_DOCS / max(docs.count(), 1))
    sample = docs.where(F.col("text").isNotNull() & (hash_fraction("doc_id") < share)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                h = shingle_hashes(text.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    seen = sample.mapInArrow(tidy(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= max(3, math.ceil(COMMON_SHARE * SAMPLE_DOCS))).orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").collect()
    return np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64)).tobytes()


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _fits(i: np.ndarray, j: np.ndarray, x: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidate pairs may link by size and sketch, and their Hamming distances."""
    n, m = x["n"][i], x["n"][j]
    far = _popcount(x["s1"][i] ^ x["s1"][j]).astype(np.int64) + _popcount(x["s2"][i] ^ x["s2"][j])
    return (far <= (den - num) * (n + m) // (den + num)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num), far


def _scan(num: int, den: int, every: bool = False):
    """A function over rows (key, a, n, s1, s2) sorted by key: kind 0: a pair to verify; 1: a member of a block with pairs left to compare.

    Of a dense block's pairs only a forest of nearest ones comes out; with ``every`` none of them, for all will be compared in tiles.
    """
    names = ["key", "a", "n", "s1", "s2"]

    def work(x: dict[str, np.ndarray], more: bool) -> list[tuple]:
        """All pairs within each run of a key; more: the run goes on, so its members are kept for later."""
        key, size = x["key"], len(x["key"])
        i, found, off = np.arange(size), [], 1
        while len(i):
            i = i[: np.searchsorted(i, size - off)]
            i = i[key[i] == key[i + off]]
            if len(i):
                ok, far = _fits(i, i + off, x, num, den)
                ok &= x["a"][i] != x["a"][i + off]
                found.append((i[ok], i[ok] + off, far[ok]))
            off += 1
        out = []
        if found:
            a, b, far = map(np.concatenate, zip(*found))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run = np.searchsorted(starts, np.arange(size), side="right") - 1
            count, members = np.bincount(run[a], minlength=len(starts)), np.bincount(run, minlength=len(starts))
            dense = (count > 4 * members) | more
            nearest = np.full(size, 1 << 40)
            np.minimum.at(nearest, b, (far << 20) + (b - a))
            keep = ~dense[run[a]] | (nearest[b] == (far << 20) + (b - a)) & (not every)
            out.append((0, a[keep], b[keep]))
            if dense.any():
                out.append((1, np.flatnonzero(dense[run]), None))
        elif more:
            out.append((1, np.arange(size), None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, np.int64) for k in names}
        going = None  # the key of a run that was too long to hold

        def give(x, upto, more):
            part = {k: v[:upto] for k, v in x.items()}
            for kind, i, j in work(part, more):
                zero = np.zeros(len(i), np.int64)
                cols = [part["key"][i], part["a"][i], part["a"][j] if kind == 0 else zero, part["n"][i], part["s1"][i], part["s2"][i]]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(zero + kind), *map(pa.array, cols)], names=["kind", "key", "a", "b", "n", "s1", "s2"])

        def ready(x, last):
            nonlocal held, going
            while len(x["key"]):
                key = x["key"]
                end = int(np.searchsorted(key != key[0], True)) if going is not None and key[0] == going else 0
                if end:  # the rest of a long run, in pieces of TILE
                    cut = min(end, TILE)
                    if cut < TILE and end == len(key) and not last:
                        break
                    yield from give(x, cut, True)
                    x = {k: v[cut:] for k, v in x.items()}
                    continue
                going = None
                edges = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
                starts = np.concatenate([[0], edges[:-1]])
                long = np.flatnonzero(edges - starts > TILE)
                stop = int(starts[long[0]]) if len(long) else len(key) if last else int(starts[-1])
                if stop:
                    yield from give(x, stop, False)
                    x = {k: v[stop:] for k, v in x.items()}
                if len(long):
                    going = int(x["key"][0])
                elif not last:
                    break
            held = x

        for batch in batches:
            new = {k: np.concatenate([held[k], batch.column(p).to_numpy()]) for p, k in enumerate(names)}
            yield from ready(new, False)
        yield from ready(held, True)

    return run


class _Tile:
    """Members of one part of a block: ids, sizes, components and whole sketches, folded to one length."""

    def __init__(self, x: dict[str, list], num: int, den: int):
        self.a, self.n = np.array(x["a"], np.int64), np.array(x["n"], np.int64)
        self.num, self.den = num, den
        self.comp = np.unique(np.array(x["comp"], np.int64), return_inverse=True)[1]
        length = min(map(len, x["bits"]))
        self.bits = np.stack([_folded(b, length) for b in x["bits"]])

    def partners(self, i: int, apart: bool) -> np.ndarray:
        """Later members that may link with member i by size and sketch; apart: those of other components only."""
        n, m = self.n[i], self.n[i + 1 :]
        ok = np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num
        if apart:
            ok &= self.comp[i + 1 :] != self.comp[i]
        at = np.flatnonzero(ok)
        far = np.bitwise_count(self.bits[i + 1 + at] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        return at[far <= (self.den - self.num) * (n + m[at]) // (self.den + self.num)] + i + 1


def _folded(sketch: bytes, length: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > length:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each (key, p, q) of sorted batches, as lists by column."""
    held, at = None, None
    for batch in batches:
        x = batch.to_pydict()
        ids = list(zip(x["key"], x["p"], x["q"]))
        lo = 0
        while lo < len(ids):
            hi = lo + 1
            while hi < len(ids) and ids[hi] == ids[lo]:
                hi += 1
            part = {k: v[lo:hi] for k, v in x.items()}
            if ids[lo] == at:
                held = {k: held[k] + v for k, v in part.items()}
            else:
                if held:
                    yield held
                held, at = part, ids[lo]
            lo = hi
    if held:
        yield held


_TILE_ROW = "key long, p long, q long, a long, n long, comp long, bits binary"


def _hopeful(num: int, den: int, apart: bool):
    """A function over the rows of tiles: those members that may link with another of their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_tile(batches):
            tile, some = _Tile(x, num, den), np.zeros(len(x["a"]), bool)
            for i in range(len(some)):
                near = tile.partners(i, apart)
                some[near] = True
                some[i] |= len(near) > 0
            if some.any():
                yield pa.RecordBatch.from_pydict(x).filter(pa.array(some))

    return run


def _linked(num: int, den: int, apart: bool):
    """A function over the rows of tiles with the members' shingle hashes: links (a, b) by exact comparison.

    apart: members of one component, given or found so far, aren't compared any more, so that fewer links than members come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_tile(batches):
            tile = _Tile(x, num, den)
            sets = [np.frombuffer(h, np.uint64) for h in x["hashes"]]
            sizes = np.array([len(h) for h in sets])
            words, ids = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mark, a, b = np.zeros(len(words), bool), [], []
            for i in range(len(sets)):
                near = tile.partners(i, apart)
                if not len(near):
                    continue
                own = ids[starts[i] : starts[i + 1]]
                mark[own] = True
                for j in near:
                    if apart and tile.comp[i] == tile.comp[j]:
                        continue
                    same = int(np.count_nonzero(mark[ids[starts[j] : starts[j + 1]]]))
                    if den * same >= num * (sizes[i] + sizes[j] - same):
                        a.append(tile.a[i])
                        b.append(tile.a[j])
                        if apart:
                            tile.comp[tile.comp == tile.comp[j]] = tile.comp[i]
                mark[own] = False
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    return run


def _tiles(dense: DataFrame, sketch: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows of all pairs of tiles of the blocks in ``dense`` (key, a): _TILE_ROW. Without ``comps`` (id, comp) each member is its own component.

    Blocks of one component have nothing left to compare, and of blocks with the same members one is enough.
    A block is cut into tiles of about TILE members and TILE_HASHES shingles.
    """
    ids = dense.select(F.col("a").alias("doc_id")).distinct()
    member = sketch.where("n > 0").select("doc_id", "n", "bits").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "a")
    if comps is not None:
        member = member.join(comps.select(F.col("id").alias("a"), "comp"), "a", "left")
    else:
        member = member.withColumn("comp", F.lit(None).cast("long"))
    rows = dense.select("key", "a").join(member.withColumn("comp", F.coalesce("comp", "a")), "a")
    block = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all_"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr("bit_xor(xxhash64(a))").alias("x1"), F.expr("bit_xor(xxhash64(a, 1))").alias("x2"))
    block = block.where("lo <> hi").groupBy("m", "x1", "x2").agg(F.min("key").alias("key"), F.first("all_").alias("all_"))
    block = block.select("key", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("all_") / TILE_HASHES)).cast("long").alias("g"))
    rows = rows.join(block, "key").withColumn("t", F.pmod(F.xxhash64("a", "key"), "g"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return rows.select("key", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "a", "n", "comp", "bits")


def _crossing(docs: DataFrame, tiles: DataFrame, scratch: Scratch, width: int, num: int, den: int, apart: bool) -> DataFrame:
    """Links (a, b) between members of a tile. Rows go by tile, never by pair: first the members with a sketch near another's, then these with their shingle hashes."""
    keys = ["key", "p", "q"]
    hopeful = scratch.cut(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_hopeful(num, den, apart)), _TILE_ROW), "hopeful")
    ids = hopeful.select(F.col("a").alias("doc_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                hashes = [shingle_hashes(t.as_py(), width).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary())], names=["a", "hashes"])

    hashes = only_ids(docs.select("doc_id", "text"), "doc_id", ids, hopeful.count()).dropDuplicates(["doc_id"]).mapInArrow(tidy(run), "a long, hashes binary")
    both = hopeful.join(hashes, "a").select(*keys, "a", "n", "comp", "bits", "hashes")
    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_linked(num, den, apart)), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts link. ``pairs``: a written table."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = only_ids(docs.select("doc_id", "text"), "doc_id", ids, 2 * pairs.count())
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, h, keep = None, None, []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if (a, ta) != last:
                    last, h = (a, ta), shingle_hashes(ta.as_py(), width)
                g = shingle_hashes(tb.as_py(), width)
                same = len(np.intersect1d(h, g, assume_unique=True))
                keep.append(den * same >= num * (len(h) + len(g) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, count_links: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Documents link when ``den * |A & B| >= num * |A | B|`` over their distinct shingles of ``width`` words
    (default: five words, 0.8). component_id is the smallest doc_id reachable by links, itself included.

    Null, empty and blank texts have no shingles and link with nothing: component_id is their own doc_id.
    Repeated rows are returned as often as they come; equal doc_ids are one document. A row without doc_id
    links no others; it gets the component of an equal set, else null. An empty table gives no rows. Other
    columns are not read. With ``count_links`` every candidate pair is verified, and n_links is added: the other rows that a
    row links with directly, those of an equal set included.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    sketch = scratch.cut(_sketches(docs, width), "sketch")
    classes = scratch.cut(sketch.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    copies = sketch.join(classes.where("m > 1"), ["f1", "f2", "n"]).where("doc_id <> rep").select("doc_id").distinct()
    copies = scratch.cut(copies.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "copies")
    few = copies.count() <= BROADCAST_IDS
    reps = docs.where("doc_id is not null").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select("doc_id", "text")
    rows = _key_rows(reps, width, num, den, _common(docs, width))
    scanned = rows.repartition(F.col("key")).sortWithinPartitions("key", "a").mapInArrow(tidy(_scan(num, den, count_links)), "kind long, key long, a long, b long, n long, s1 long, s2 long")
    scan = scratch.cut(scanned, "scan")
    del rows, scanned
    release(spark)

    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = scratch.cut(ordered(scan.where("kind = 0")), "pairs")
    near = scratch.cut(_near(pairs, sketch, num, den), "near")
    links = scratch.cut(_verified(docs, near, width, num, den), "links")
    comps = scratch.cut(components(spark, links, scratch), "comps")

    dense = scratch.cut(scan.where("kind = 1").select("key", "a").distinct(), "dense")
    tiles = _tiles(dense, sketch, None if count_links else comps)
    more = scratch.cut(_crossing(docs, tiles, scratch, width, num, den, not count_links), "more")
    if not more.isEmpty():
        links = links.union(more)
        comps = scratch.cut(components(spark, links, scratch), "comps2")
    roots = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    roots = roots.select("f1", "f2", "n", F.coalesce("comp", "rep").alias("component_id"))
    if count_links:
        once = ordered(links)
        m = classes.select(F.col("rep").alias("other"), "m")
        both = once.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(once.select("b", "a")).join(m, "other").groupBy("rep").agg(F.sum("m").alias("others"))
        own = classes.join(both, "rep", "left").select("f1", "f2", "n", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"))
        roots = roots.join(own, ["f1", "f2", "n"])
    out = sketch.select("doc_id", "n", "f1", "f2").join(roots, ["f1", "f2", "n"], "left")
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return out.select(*cols, *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []))
