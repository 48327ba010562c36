"""What grows with the rows must not go through the driver."""

import random

from loomspan.llm import fingerprints as fp


def test_block_tables_are_not_broadcast(spark, tmp_path):
    r = random.Random(1)
    hexes = [f"{r.getrandbits(128):032x}" for _ in range(300)]
    hexes += [f"{int(h, 16) ^ 5:032x}" for h in hexes[:20]]
    spark.createDataFrame([(h,) for h in hexes], "fingerprint string").write.parquet(str(tmp_path / "p"))
    pairs = fp.near_pairs(spark.read.parquet(str(tmp_path / "p")), 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {tuple(sorted((h, f"{int(h, 16) ^ 5:032x}"))) for h in hexes[:20]}
