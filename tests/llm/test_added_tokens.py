"""Ids are those of the tokenizers library with its defaults."""

import struct
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomspan.llm import token_files  # noqa: E402


def test_digests_follow_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|> it's", "plain text", "<|endoftext", None, "x <|endoftext|><|endoftext|>\n\n y"]
    got = {r["doc_id"]: r for r in token_files.written_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 2).collect()}
    at = 0
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert 50256 in lib.encode(texts[0], add_special_tokens=False).ids
