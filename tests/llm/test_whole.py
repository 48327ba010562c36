"""Operators of the llm subpackage do the whole job where their tables are large."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomspan.llm import common, vector_dedup  # noqa: E402

# ---- 7: vectors ----


def low_rank(seed, n, rank, dims):
    """n unit vectors near a subspace of ``rank`` dimensions: differences point along the centroids."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, dims)) + 0.01 * rng.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("rank,threshold", [(3, 0.9), (6, 0.9), (64, 0.9), (6, 0.5), (6, 1.0), (3, -0.2)])
def test_visits_lose_no_pair(rank, threshold):
    u = low_rank(rank, 700, rank, 64)
    u[1] = u[0]
    c = vector_dedup.spherical_kmeans(u, 25)
    near = u @ c.T
    home, goes = near.argmax(axis=1), vector_dedup.visits(near, c, threshold)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    first, second = np.where(home[i] <= home[j], i, j), np.where(home[i] <= home[j], j, i)
    assert len(i) and goes[first, home[second]].all()


def test_many_cells_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 40)
    u = low_rank(1, 800, 5, 32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.concatenate([u, u[:5]]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_dedup.linked_components(df).collect()}
    u = np.concatenate([u, u[:5]])
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = common.forest(len(u), *np.nonzero(link))
    low = {r: min(np.flatnonzero(root == r)) for r in set(root)}
    assert sum(r["n_links"] for r in got.values()) == link.sum()
    assert all((got[k]["n_links"], got[k]["component_id"]) == (link[k].sum(), low[root[k]]) for k in range(len(u)))
