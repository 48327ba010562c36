"""Stages of the corpus pipeline on repeated rows, rows without ids, clashing columns and empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomspan.llm import ngram_join  # noqa: E402
from test_llm import DOCS, brute_components  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"w{k}" for k in range(40))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def kept(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_one_row_of_each_group_stays(spark):
    rows = [(1, LONG, "a"), (2, LONG + " x", "a"), (None, LONG, "a"), (None, "alone here", "b"), (None, "alone here", "b"), (5, "five five", "a"), (5, "five five", "a"), (6, None, "a"), (7, "", "a"), (8, "one", "a"), (8, "two", "a")]
    got = kept(STAGES["jaccard_join"](spark, frame(spark, rows).withColumns({"own_id": F.lit(1), "component_id": F.lit("x"), "n": F.lit(2)}), ""))
    assert got == {(1, LONG): 1, (None, "alone here"): 1, (5, "five five"): 1, (6, None): 1, (7, ""): 1, (8, "one"): 1, (8, "two"): 1}


def test_mix_gives_equal_rows_what_is_taken(spark):
    one = [(1, "a b c", "a"), (1, "a b c", "a")]
    assert sum(kept(STAGES["source_mix"](spark, frame(spark, one), "")).values()) == 3
    odd = [(None, None, None), (None, "a b", None), (None, "a b c d", None), (2, "x", "b"), (2, "x", "b"), (3, "", "b")]
    got = kept(STAGES["source_mix"](spark, frame(spark, odd).withColumns({"key_": F.lit(1), "size": F.lit("s"), "rows_": F.lit(0)}), ""))
    assert all(t for _, t in got) and 1 <= sum(got.values()) <= 8


def test_stages_take_empty_tables_and_odd_rows(spark):
    odd = frame(spark, [(None, None, None), (1, "", "a"), (2, " \n ", "b"), (3, "word " * 5000, "c"), (3, "word " * 5000, "c")]).withColumns({"lang_pred": F.lit(1), "n_lines": F.lit("x"), "turn_": F.lit(0), "token_ids": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), "").count() == 0, name
        out = stage(spark, odd, "")
        assert out.count() <= 10
        if name != "byte_bpe":
            assert out.columns == corpus_pipeline.COLUMNS


def test_encoded_keeps_every_row(spark):
    got = STAGES["byte_bpe"](spark, frame(spark, [(1, "a b", "a"), (1, "a b", "a"), (None, None, None)]), "").collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], len(r["token_ids"])) for r in got) == [(0, 0, 0), (1, 2, 8), (1, 2, 8)]


@pytest.mark.parametrize("tile", [8, 512])
def test_links_in_tiles(spark, monkeypatch, tile):
    """Blocks of one tile and of many: components and numbers of links against brute force."""
    import random

    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base, texts = [rng.choice(words) for _ in range(120)], ["", "a b"]
    for _ in range(70):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            x[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(x))
    rows = list(enumerate(texts))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} if t else set() for i, t in rows}
    links = {i: sum(j != i and bool(s & o) and 100 * len(s & o) >= 90 * len(s | o) for j, o in sets.items()) for i, s in sets.items()}
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, count_links=True).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 90, 100)
    assert {r["doc_id"]: r["n_links"] for r in got} == links
