"""Null ids, repeated rows, long texts and ties for each operator; independent fits and brute force where there is no SQL."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomspan.llm import bpe, fingerprints, language_id, line_dedup, mixing, ngram_join, quality, queries, token_files, url_filter, vector_dedup  # noqa: E402
from test_llm import DOCS, PATTERN, RANKS, brute_components, documents, reference_encoding  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)


# ---- 1, 9: long texts, equal and missing ids ----


def test_ids_of_very_long_texts(spark):
    """Beyond LAZY_CHARS the pieces come one at a time."""
    text = "The quick brown fox, 12345 times!\n" * (bpe.LAZY_CHARS // 34 + 2)
    assert len(text) > bpe.LAZY_CHARS
    ids = reference_encoding().encode_ordinary(text)
    got = bpe.round_trip_digests(documents(spark, [text]), RANKS, PATTERN).first()
    assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_files_with_equal_and_missing_ids_and_a_long_text(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    long = "The quick brown fox, 12345 times!\n" * (bpe.LAZY_CHARS // 34 + 2)
    rows = [(None, "no id", "en", "a"), (5, "five", "en", "a"), (5, "five", "en", "a"), (5, "other five", "en", "a"), (7, long, "en", "b"), (9, None, None, None)]
    got = token_files.written_digests(frame(spark, rows), JSON, 2).orderBy("start").collect()

    def crc(t):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        return len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))

    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or 0, *crc(t)) for i, t, _, _ in rows)
    assert [r["start"] for r in got] == list(itertools.accumulate([r["n_tokens"] for r in got[:-1]], initial=0))
    assert [r["doc_id"] for r in got] == [None, 5, 5, 5, 7, 9]


# ---- 2 ----


def test_mix_of_rows_without_ids(spark):
    rows = [(None, "a b c", "en", "x"), (None, "a b c", "en", "x"), (None, "d", "en", None), (1, None, "en", "y"), (2, "e f " * 20, "en", "y")]
    got = mixing.fair_mix(frame(spark, rows), weights=[5.0, 2.0, 1.0], share=1.5, max_repeats=2).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 1, 3, 3, 40]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["target"] for r in got if r["size"] == 3} == {12.0} and {r["target"] for r in got if r["size"] == 1} == {2.0}


# ---- 3 ----


def test_links_of_long_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(60_000)}" for _ in range(30_000)]
    near, far = list(base), list(base)
    for k in range(0, 30_000, 300):
        near[k] = "new"
    for k in range(0, 30_000, 40):
        far[k] = "new"
    rows = [(4, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (8, " ".join(base)), (9, "W1 w2"), (10, "w1\tW2")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([(i, t.lower()) for i, t in rows], 3, 90, 100)


# ---- 4 ----


def test_ratios_and_weights_against_an_independent_fit():
    """Log-count ratios by counting; the dual solution's objective against subgradient steps on the primal."""
    rng = np.random.default_rng(5)
    label = np.arange(60) % 2
    rows = [np.unique(np.r_[0, rng.integers(1, 12, 4) + 6 * y]) for y in label]
    ratio = quality.log_count_ratios(rows, label)
    count = {y: np.array([sum(f in r for r, z in zip(rows, label) if z == y) + quality.SMOOTH for f in range(20)], float) for y in (0, 1)}
    want = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    shift = (ratio[:20] - want)[1:]  # sums over the whole feature space shift all by one constant; feature 0 is the intercept
    assert np.allclose(shift, shift[0], atol=1e-9) and ratio[0] == 1
    y = np.where(label == 1, 1.0, -1.0)
    x = np.zeros((60, 20))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
    objective = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    w = quality.dual_coordinate_descent(rows, [x[i, r] for i, r in enumerate(rows)], y, 20, cost=1.0, passes=300)
    v, best = np.zeros(20), np.inf
    for k in range(1, 20_001):
        v = v - (v - (y * (y * (x @ v) < 1)) @ x) / k
        best = min(best, objective(v)) if k > 1000 else best
    assert abs(objective(w) - best) < 0.01 * best


def test_features_across_a_border_of_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abcDE 12.,\n$é") for _ in range(500))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 64)
    assert (quality.features(text) == whole).all()


def test_quality_of_odd_rows(spark):
    docs = [(k, ("fine words here " if k % 2 else "$$$ !!! ### ") * 5, "en", "a") for k in range(60)]
    docs += [(None, "fine words here", "en", "a"), (1, docs[1][1], "en", "b"), (90, "x" * 100_000, "en", "a"), (91, None, "en", "a"), (92, "", "en", "a")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 0, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.held_out_scores(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in got if r["doc_id"] in (91, 92)}) == 1
    assert quality.held_out_scores(frame(spark, []), labels).count() == 0


# ---- 5 ----


def plain_fingerprint(text):
    """SimHash by its definition, bit by bit, with the operator's term hashes."""
    import xxhash

    mask, m1, m2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def mix(x):
        x = ((x ^ (x >> 29 + 3)) * m2) & mask
        x = ((x ^ (x >> 29)) * m1) & mask
        return x ^ (x >> 32)

    body = text.encode()
    h = [xxhash.xxh64_intdigest(w) for w in body.lower().split()]
    terms = [(t, 0.5) for t in h] + [((mix(a) * m1 + b) & mask, 1.0) for a, b in itertools.pairwise(h)]
    if 4 <= len(body) < fingerprints.SHORT_BYTES:
        terms += [(int.from_bytes(body[k : k + 4], "big") | 1 << 40, 0.5) for k in range(len(body) - 3)]
    weight, count = {}, {}
    for t, w in terms:
        weight.setdefault(t, w)
        count[t] = count.get(t, 0) + 1
    votes = np.zeros(128)
    for t in weight:
        bits = np.unpackbits(np.array([mix(t), mix((t + m1) & mask)], np.uint64).view(np.uint8))
        votes += np.where(bits, 1, -1) * weight[t] * (1 + np.log(count[t]))
    return votes


@pytest.mark.parametrize("n", [0, 1, 7, 300, 12_000])
def test_fingerprint_by_its_definition(n):
    """12,000 words are more terms than are voted on at once."""
    rng = random.Random(n)
    text = " ".join(f"{rng.choice('abc')}{rng.randrange(9000)}" for _ in range(n))
    votes = plain_fingerprint(text)
    bits = np.unpackbits(np.frombuffer(fingerprints.fingerprint(text), np.uint8)).astype(bool)
    clear = np.abs(votes) > 0.05  # elsewhere single precision decides
    assert (bits[clear] == (votes > 0)[clear]).all() and (clear.mean() > 0.9 or n == 0)


def test_neighbours_of_odd_rows(spark):
    text = "some words that stand in a text of their own " * 8
    rows = [(3, text, "en", "a"), (3, text, "en", "a"), (None, text, "en", "a"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "quite another text of other words altogether, not like it", "en", "a")]
    got = fingerprints.fingerprints_with_neighbours(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_near"]) for r in got) == [(0, 3, 2), (3, 3, 2), (3, 3, 2), (7, 7, 1), (8, 7, 1), (9, 9, 0)]
    assert fingerprints.fingerprints_with_neighbours(frame(spark, [])).count() == 0


# ---- 6 ----


def test_languages_of_odd_rows(spark):
    words = {"en": ["the", "and", "water", "with"], "de": ["der", "und", "wasser", "mit"]}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words[g]) for _ in range(30)), g, "s") for k, g in enumerate(rng.choices(list(words), k=160))]
    odd = [(None, "the water and the water", None, "s"), (900, "der und wasser mit " * 6000, None, "s"), (901, rows[0][1], "en", "s"), (901, rows[0][1], "en", "s"), (902, "", "de", "s")]
    got = language_id.held_out_predictions(frame(spark, rows + odd)).collect()
    by = lambda i: [r for r in got if r["doc_id"] == i]
    assert len(got) == len(rows) + len(odd) and by(None)[0]["lang_pred"] == "en" and not by(None)[0]["held_out"]
    assert by(900)[0]["lang_pred"] == "de" and by(902)[0]["lang_pred"] == "und"
    assert len({(r["lang_pred"], r["score"]) for r in by(901) + by(0)}) == 1
    assert {r["lang_pred"] for r in language_id.held_out_predictions(frame(spark, rows[:4]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 7 ----


def test_vectors_that_repeat_or_lack_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(4, a), (4, a), (None, a), (2, [0.99, 0.05, 0.0]), (None, b), (6, b), (None, None), (8, [0.0, 0.0, 1.0])]
    got = vector_dedup.linked_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(4, 3, 2, False), (4, 3, 2, False), (None, 3, 2, None), (2, 3, 2, True), (None, 1, 6, None), (6, 1, 6, True), (None, 0, None, None), (8, 0, 8, True)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got))) == sorted(map(key, want))


# ---- 8 ----


def test_lines_of_rows_that_repeat_or_lack_ids(spark):
    rows = [(k, f"all over\nown {k}", "en", f"s{k}") for k in range(9)]
    long = "\n".join(f"line {k}" for k in range(50_000))
    odd = [(None, "all over\nmine", "en", "s1"), (None, "all over\nyours", "en", None), (3, "all over\nown 3", "en", "s3"), (20, long + "\n all over\t", "en", "s2"), (21, "", "en", "s2")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_wide_lines(frame(spark, rows + odd), 8).collect())
    assert got == sorted([(k, f"own {k}", 2, 1) for k in range(9)] + [(3, "own 3", 2, 1), (-1, "mine", 2, 1), (-1, "yours", 2, 1), (20, long, 50_001, 1), (21, "", 1, 0)])


# ---- 10 ----


def test_trees_as_sql_follow_the_fitted_model_and_learn(spark):
    """The written-out trees against the library's own predictions, and verdicts on hosts that no rule decides."""
    rng = random.Random(6)
    rows = []
    for k in range(1200):
        bad, ruled = k % 2, k % 3
        host = f"{rng.choice('abcdef')}.{('bad' if bad else 'god') if ruled else 'mix'}.org"
        path = "/" + "/".join((f"{rng.randrange(10**8)}" if bad else rng.choice(["news", "about", "team", "help"])) for _ in range(3))
        rows.append((k, f"https://{host}{path}?{'a=1&b=2&c=3' if bad else ''}"))
    rules = [("block", "bad.org", "/"), ("allow", "god.org", "/")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    judged = [r for r in got.values() if r["rule"] is None]
    assert len(judged) == 400 and np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in judged]) > 0.98
    assert all(0 <= r["block_score"] <= 1 for r in got.values())

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = spark.createDataFrame([(rng.random(), rng.random()) for _ in range(300)], "f_a double, f_b double").withColumn("label", ((F.col("f_a") + F.col("f_b")) > 1).cast("double"))
    x = VectorAssembler(inputCols=["f_a", "f_b"], outputCol="features").transform(x).cache()
    model = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, seed=7).fit(x)
    margin = " + ".join(f"{float(w)!r}D * ({url_filter._tree_sql(t.rootNode(), ['a', 'b'])})" for t, w in zip(model._java_obj.trees(), model._java_obj.treeWeights()))
    score = url_filter.UrlModel(margin, x, 0.5, ["a", "b"]).score()
    for r in model.transform(x).withColumn("own", score).collect():
        assert abs(r["own"] - r["probability"][1]) < 1e-9


def test_rules_of_equal_length_and_long_urls(spark):
    rules = [("block", "a.com", "/x"), ("allow", "com", "/x/yz"), ("allow", "com", "/")]
    long = "http://a.com/" + "seg/" * 25_000
    rows = [(1, "http://a.com/x/yz"), (2, "http://b.com/x/yz"), (3, long), (3, long), (None, "http://A.com/x")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    pick = sorted((r["page_id"] or 0, r["rule"], r["verdict"], len(r["path"])) for r in got)
    size = len(long) - len("http://a.com")
    assert pick == [(0, "a.com/x", "block", 2), (1, "com/x/yz", "allow", 5), (2, "com/x/yz", "allow", 5), (3, "com/", "allow", size), (3, "com/", "allow", size)]
    tied = [("block", "a.com", "/a"), ("allow", "com", "/abc")]
    one = spark.createDataFrame([(1, "http://a.com/abc")], "page_id long, url string")
    for order, want in ((tied, ("a.com/a", "block")), (tied[::-1], ("com/abc", "allow"))):
        got = url_filter.filter_urls(one, order).first()
        assert (got["rule"], got["verdict"]) == want


def test_queries_are_the_ten():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 10
