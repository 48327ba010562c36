"""Neighbours of fingerprints count documents, not fingerprints."""

from loomspan.llm import fingerprints


def test_members_of_a_class_count(spark, monkeypatch):
    same = ["a b c d e f g h"] * 3
    texts = same + ["A  b c d e f g h", "something else here", None]
    df = spark.createDataFrame(list(enumerate(texts, 5)) + [(None, texts[0])], "doc_id long, text string")
    got = fingerprints.fingerprints_with_neighbours(df, radius=3).collect()
    print_of = [fingerprints.fingerprint(r["text"] or "") for r in df.collect()]
    near = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() <= 3
    want = {a.hex(): sum(near(a, b) for b in print_of) - 1 for a in print_of}
    assert len(got) == len(texts) + 1 and all(r["n_near"] == want[r["fingerprint"]] for r in got)
    assert want[print_of[0].hex()] >= 3
    assert {r["class_id"] for r in got if r["fingerprint"] == print_of[0].hex()} == {5}
