"""Pages that are mostly boilerplate lose it in the pipeline."""

import corpus_pipeline
from loomspan.llm import line_dedup


def test_mostly_wide_pages_lose_their_wide_lines(spark):
    wide = [f"menu {k}" for k in range(9)]
    rows = [(k, "\n".join([*wide, "", f"own {k}"]), "en", f"site{k}", 0) for k in range(10)]
    rows.append((50, "\n".join(wide), "en", "site1", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in line_dedup.remove_wide_lines(df).collect()}
    assert all(out[k]["text"] == f"\nown {k}" and out[k]["n_removed"] == 9 for k in range(10))
    assert out[50]["text"] == "\n".join(wide) and out[50]["n_removed"] == 0
    assert {r["text"] for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()} == {r["text"] for r in out.values()}
