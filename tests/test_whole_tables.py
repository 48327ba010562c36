"""Reference queries run over whole tables and texts."""

from loomspan.operators import models as md
from loomspan.plans.catalog import QUERIES


def test_alignment_reads_whole_texts(spark, tmp_path):
    text = "".join("acgt"[(k * k + k // 7) % 4] for k in range(150))
    texts = [(1, text), (2, "short"), (3, "x" * 60 + text[:90])]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["alignment_score"] for r in QUERIES["align_local"](spark, str(tmp_path)).collect()}
    assert got == {k: md.align_score(t, t[29:], 2.0, -1.0, 2.0, 1.0) for k, t in texts}
    assert got[1] == 2.0 * 121
