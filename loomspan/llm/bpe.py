"""Byte-level BPE by backtracking over longest matches (operator 1).

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton over all tokens finds, for
every position, the longest token that starts there. Encoding walks forward with the longest match and
accepts a token if the pair (last token, token) is *compatible*: merging their joined bytes would give
back these two tokens. If not, it tries the next shorter token with the same start, and if none is left
it takes back the last token. Each position is given up at most once, so the work is linear in the piece.
A sequence of pairwise compatible tokens is the one that the merges in rank order give.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import ship, tidy

#: Texts longer than this are split into pieces lazily, so that the pieces of a huge text aren't held at once.
LAZY_CHARS = 1 << 20
#: Bytes of a worker's memory that one generation of remembered pieces takes at most, what an entry takes besides its
#: characters and ids, the longest piece that is remembered, and most remembered pairs of tokens.
CACHED_BYTES, ENTRY_BYTES, CACHED_CHARS, KNOWN_PAIRS = 14 << 20, 180, 64, 150_000
#: Patterns in which a lone space between other characters starts a piece, whatever stands around it.
SPACE_STARTS_PIECE = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
#: Vocabulary files are broadcast; larger ones are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(body: bytes) -> list[bytes]:
    """The tokens of a rank file (lines of base64 token and rank) in order of rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines()) if a}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return tokens


class BacktrackBPE:
    """Exact merges of a byte-level vocabulary in linear time. ``tokens``: bytes by rank."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        # The next shorter token that starts a token; a token's final merge; -1 and itself where there is none.
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in tokens]
        self.merge, self.halves = {}, [(i, i) for i in range(len(tokens))]
        self.known: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.ids.get(t[self.lengths[left] :], i)
                if left < i and right < i and self._compatible(left, right):
                    self.merge[left, right], self.halves[i] = i, (left, right)
                    break
                left = self.shorter[left]
        self.known.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges at the seam, the latest first: no merge across it may come before those that built the two tokens."""
        limit = len(self.tokens)
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        known = self.known[left, right] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ids.get(piece)) is not None:
            return [whole]
        lengths, shorter, known, n = self.lengths, self.shorter, self.known.get, len(piece)
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[i]] = i  # ends ascend, so the longest is set last
        closed, out, at, token, last = set(), [], 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if end not in closed:
                    if last < 0:
                        break
                    if (fits := known((last, token))) is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            elif out:
                closed.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Recent(dict):
    """A cache of two generations of ``size`` bytes each: when the younger is full it becomes the older, and hits there are moved back."""

    def __init__(self, compute, size: int):
        self.compute, self.size, self.held, self.old = compute, size, 0, {}

    def __missing__(self, key):
        out = self.old[key] if key in self.old else self.compute(key)
        if len(key) <= CACHED_CHARS:
            self.held += ENTRY_BYTES + len(key) + len(out or b"")
            if self.held > self.size:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.held, self.old = 0, {}


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; ``encode_piece`` gives those of one piece.

    A lone space between two characters that aren't white space always begins a piece of the byte-level
    patterns served here, so a text is cut there first and the ids of each part are remembered. A part of
    letters only is one piece with its space, and is remembered once. Texts in which some part has white
    space at an end go through the pattern as a whole.
    """

    def __init__(self, encode_piece, pattern: str, cached: int = CACHED_BYTES):
        import regex

        self.encode_piece, self.pattern, self.splits = encode_piece, regex.compile(pattern), pattern in SPACE_STARTS_PIECE
        self.pieces, self.parts = _Recent(encode_piece, cached), _Recent(self._part, cached)

    def forget(self) -> None:
        """Give the remembered ids' memory back: a worker process goes on to other tasks."""
        self.pieces.forget()
        self.parts.forget()

    def _part(self, part: str) -> bytes | None:
        if part.isalpha():
            return self.encode_piece(" " + part)
        return b"".join(map(self._shared, self.pattern.findall(" " + part))) if part and part.strip() == part else None

    def _shared(self, piece: str) -> bytes:
        """Ids of a piece, from the parts if it is one."""
        word = piece[1:]
        return self.parts[word] if piece[0] == " " and word.isalpha() else self.pieces[piece]

    def _whole(self, text: str) -> bytes:
        pieces = self.pattern.findall(text) if len(text) < LAZY_CHARS else (m[0] for m in self.pattern.finditer(text))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if self.splits and len(text) < LAZY_CHARS:
            first, *rest = text.split(" ")
            if first and first.strip() == first:
                try:
                    return self._whole(first) + b"".join(map(self.parts.__getitem__, rest))
                except TypeError:  # a part that has no ids of its own
                    pass
        return self._whole(text)


class TextEncoder(PieceEncoder):
    """The pieces encoded by BacktrackBPE."""

    def __init__(self, body: bytes, pattern: str):
        self.bpe = BacktrackBPE(read_ranks(body))
        super().__init__(lambda p: _packed(self.bpe.encode_piece(p.encode())), pattern)


@functools.lru_cache(maxsize=2)
def _encoder(body: bytes, pattern: str) -> TextEncoder:
    return TextEncoder(body, pattern)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        body = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(body) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return body


def _mapped(df: DataFrame, column: str, into: dict[str, str], make) -> DataFrame:
    """Add columns ``into`` (name: type) that the function ``make()[0]`` returns for each value of ``column``, in Arrow batches; ``make()[1]`` is called at the end."""
    if clash := set(into) & set(df.columns):
        df = df.drop(*clash)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {v}" for k, v in into.items()])
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, done = make()
        for batch in batches:
            # long texts come in batches of 10,000 rows at most; results leave in smaller ones
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [work(x.as_py()) for x in part.column(part.schema.get_field_index(column))]
                new = [pa.array([r[k] for r in rows], type=kinds[v]) for k, v in enumerate(into.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *into])
        done()

    return df.mapInArrow(tidy(run), schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` (long) and ``token_ids`` (binary: little-endian unsigned 32-bit ids).

    Each match of ``pattern`` is encoded separately with the ranks; no special tokens. Null and empty
    texts give no ids. Equal texts give equal ids, and rows are never moved (no shuffle). Columns of these
    two names in ``df`` are replaced; all others are kept. An empty table gives an empty table.
    """
    ship(df.sparkSession)
    body = df.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path))

    def make():
        encoder = _encoder(body.value, pattern)

        def work(value: str | None):
            ids = encoder.encode(value or "")
            return len(ids) // 4, ids

        return work, encoder.forget

    return _mapped(df, text, {"n_tokens": "long", "token_ids": "binary"}, make)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` (binary: the bytes of the tokens of ``ids``; null ids give no bytes)."""
    ship(df.sparkSession)
    body = df.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path))

    def make():
        tokens = read_ranks(body.value)
        return lambda value: (b"".join(map(tokens.__getitem__, np.frombuffer(value or b"", dtype="<u4").tolist())),), lambda: None

    return _mapped(df, ids, {"decoded": "binary"}, make)


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode the ids."""
    out = decode(encode(df.select("doc_id", "text"), ranks_path, pattern).select("doc_id", "n_tokens", "token_ids"), ranks_path)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
