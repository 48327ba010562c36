"""Parts of letters are remembered once, whatever the order and surroundings in which they come."""

import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomspan.llm import bpe, token_files  # noqa: E402

PIECES = ["word", "wörd", "日本", "Ǆ", "ͅ", "it's", "x1", "²", "...", "a.\nB", "\n", "  ", "\t", "\x1c", "\x85", "\xa0", " ", "é", "é", "'ll", "", "𐐀", "$$$"]


def test_letters_are_letters_of_the_pattern():
    import regex

    letter = regex.compile(r"\p{L}")
    others = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and not letter.match(chr(c))]
    assert others == []


@pytest.mark.parametrize("cached", [1 << 20, 600])
def test_parts_give_the_ids_of_the_libraries(cached):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        files = token_files.LibraryEncoder(f.read())
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        body = f.read()
    own = bpe.TextEncoder(body, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(body))}, special_tokens={})
    for e in (files, own):
        e.pieces.size = e.parts.size = cached  # the smaller one turns the caches over all the time
    draw = random.Random(7)
    for _ in range(1500):
        text = draw.choice(["", " "]).join(draw.choice(PIECES) for _ in range(draw.randrange(12)))
        assert files.encode(text) == files.library(text), repr(text)
        ids = lib.encode_ordinary(text)
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
