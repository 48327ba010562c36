"""Visits of cells take no disk: vectors are written a fixed number of times, however many cells they visit."""

import numpy as np

from loomspan.llm import common
from loomspan.llm import vector_dedup as vd


def test_visits_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(vd, "CELL_ROWS", 20)
    monkeypatch.setattr(vd, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))  # 30 cells in few dimensions: most rows visit many
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    written, cut = [], common.Scratch.cut
    monkeypatch.setattr(common.Scratch, "cut", lambda self, d, name: (out := cut(self, d, name), written.append((name, out.count() if "unit" in out.columns else 0)))[0])
    got = {r["vec_id"]: r for r in vd.linked_components(df, 0.9).collect()}
    assert sum(n for _, n in written) <= 3 * len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(low, np.where(near, low[None], len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()
