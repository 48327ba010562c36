"""Clustering, factorisation, sequence models, alignment, graphs and permutation tests.

Steps that are sequential within one item run as Arrow UDFs, one item at a time; loops over the whole table run
on the driver with small state (centroids, factors of a gene-level matrix), each round one distributed pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.probability import hypergeometric_tail


# ---- clustering ----


def nearest_centroid(df: DataFrame, vector: str, centroids: list[list[float]], metric: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with ``cluster`` (0-based, the first among equals) and ``distance``; rows without a finite distance get cluster len(centroids)."""
    d = [metric(F.col(vector), F.array(*[F.lit(float(v)) for v in c])) for c in centroids]
    x = df.withColumn("d_", F.array(*d))
    x = x.withColumn("d_", F.transform("d_", lambda v: F.when(F.isnan(v) | v.isNull(), F.lit(float("inf"))).otherwise(v)))
    best = F.array_min("d_")
    return x.withColumns({"cluster": F.when(best < float("inf"), F.array_position("d_", best).cast("int") - 1).otherwise(len(centroids)), "distance": best}).drop("d_")


def k_means(df: DataFrame, vector: str, centroids: list[list[float]], metric: Callable[[Column, Column], Column], rounds: int) -> tuple[DataFrame, list[list[float]]]:
    """Batch k-means from the given centroids: assignments and the centroids they were made with. A centroid without rows stays."""
    for _ in range(rounds):
        x = nearest_centroid(df, vector, centroids, metric).where(F.col("cluster") < len(centroids))
        n = len(centroids[0])
        means = x.groupBy("cluster").agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(n)]).alias("c"))
        new = {r["cluster"]: list(r["c"]) for r in means.collect()}  # one row per cluster
        moved = [new.get(k, c) for k, c in enumerate(centroids)]
        if all(math.isclose(u, v, abs_tol=1e-12) for a, b in zip(moved, centroids) for u, v in zip(a, b)):
            break
        centroids = moved
    return nearest_centroid(df, vector, centroids, metric), centroids


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((b - row) ** 2).sum(axis=1) for row in a]))


def silhouette(df: DataFrame, vector: str, metric=_euclidean, block: int = 512) -> DataFrame:
    """(id, cluster, s) of rows (id, cluster, vector): (b - a) / max(a, b) with a the mean distance to the own cluster, itself included, b the least mean to another.

    Rows are dealt into blocks by the hash of their id, and every pair of blocks is one task's work; sums and
    numbers for each (row, cluster) leave a task, never pairs. ``metric``: distances (rows of a, rows of b).
    """
    g = max(1, -(-df.count() // block))
    x = df.select("id", "cluster", F.col(vector).alias("v"), F.pmod(F.xxhash64("id"), F.lit(g)).alias("t"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    sides = x.select("id", "cluster", "v", F.col("t").alias("p"), every.alias("q"), F.lit(0).alias("side")).union(x.select("id", "cluster", "v", every.alias("p"), F.col("t").alias("q"), F.lit(1).alias("side")))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "total": [], "n": []})
        d = metric(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()))
        kinds, at = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        out = [pd.DataFrame({"id": a["id"], "cluster": a["cluster"], "other": kind, "total": d[:, at == k].sum(axis=1), "n": int((at == k).sum())}) for k, kind in enumerate(kinds)]
        return pd.concat(out, ignore_index=True)

    kind = df.schema["id"].dataType.simpleString()
    per = sides.groupBy("p", "q").applyInPandas(sums, f"id {kind}, cluster int, other int, total double, n long")
    means = per.groupBy("id", "cluster", "other").agg((F.sum("total") / F.sum("n")).alias("d"))
    own, other = F.max(F.when(F.col("other") == F.col("cluster"), F.col("d"))), F.min(F.when(F.col("other") != F.col("cluster"), F.col("d")))
    return means.groupBy("id", "cluster").agg(own.alias("a"), other.alias("b")).select("id", "cluster", ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def agglomerate(distance: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of hierarchical clustering; new clusters are numbered from n. The smallest pair of numbers goes first among equals."""
    d = {(i, j): float(distance[i, j]) for i in range(len(distance)) for j in range(i + 1, len(distance))}
    size, out, nxt = {i: 1 for i in range(len(distance))}, [], len(distance)
    while len(size) > 1:
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        for k in size:
            if k not in (a, b):
                x, y = d.pop((min(a, k), max(a, k))), d.pop((min(b, k), max(b, k)))
                mean = (size[a] * x + size[b] * y) / (size[a] + size[b])
                d[k, nxt] = {"complete": max(x, y), "single": min(x, y), "average": mean}[linkage]
        d.pop((a, b))
        size[nxt] = size.pop(a) + size.pop(b)
        out.append((a, b, h, size[nxt]))
        nxt += 1
    return out


def factorise(v: np.ndarray, w: np.ndarray, h: np.ndarray, rounds: int, cost: str = "euclid") -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors of v by multiplicative updates: H first, then W with the new H."""
    tiny = 1e-12
    for _ in range(rounds):
        if cost == "euclid":
            h = h * (w.T @ v) / np.maximum(w.T @ w @ h, tiny)
            w = w * (v @ h.T) / np.maximum(w @ h @ h.T, tiny)
        else:
            h = h * (w.T @ (v / np.maximum(w @ h, tiny))) / np.maximum(w.sum(axis=0)[:, None], tiny)
            w = w * ((v / np.maximum(w @ h, tiny)) @ h.T) / np.maximum(h.sum(axis=1)[None, :], tiny)
    return w, h


# ---- gene sets and permutations ----


def set_enrichment(members: DataFrame, chosen: DataFrame, total: int) -> DataFrame:
    """(set_name, size, hits, p): hypergeometric tail of the chosen genes in each set; ``members`` (set_name, gene), ``chosen`` (gene)."""
    c = chosen.select("gene").distinct().withColumn("hit", F.lit(1))
    x = members.dropDuplicates(["set_name", "gene"]).join(c, "gene", "left").groupBy("set_name").agg(F.count(F.lit(1)).alias("size"), F.count("hit").alias("hits"))
    drawn = c.agg(F.count(F.lit(1)).alias("drawn"))
    return x.join(F.broadcast(drawn)).select("set_name", "size", "hits", hypergeometric_tail(F.lit(total), "size", "drawn", "hits").alias("p"))


def permuted_labels(samples: list[str], size: int, rounds: int, seed: int) -> list[tuple[int, list[str]]]:
    """Group memberships: all combinations if there are fewer than ``rounds``, else seeded draws."""
    from itertools import combinations

    if math.comb(len(samples), size) <= rounds:
        return [(k, list(c)) for k, c in enumerate(combinations(samples, size))]
    rng = np.random.default_rng(seed)
    return [(k, sorted(rng.choice(samples, size, replace=False).tolist())) for k in range(rounds)]


def permutation_differences(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(perm, gene, diff): mean of the samples in a permutation's group less that of the others, in one pass; ``labels`` (perm, sample), few rows."""
    perms = labels.select("perm").distinct()
    x = values.join(F.broadcast(perms)).join(F.broadcast(labels.withColumn("in_", F.lit(True))), ["perm", "sample"], "left")
    inside = F.avg(F.when(F.col("in_"), F.col("value")))
    return x.groupBy("perm", "gene").agg((inside - F.avg(F.when(F.col("in_").isNull(), F.col("value")))).alias("diff"))


def family_wise(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """(gene, diff, p): share of permutations whose largest (for negative: smallest) difference is at least as extreme."""
    ends = permuted.groupBy("perm").agg(F.max("diff").alias("hi"), F.min("diff").alias("lo"))
    x = observed.join(F.broadcast(ends))
    return x.groupBy("gene", "diff").agg(F.avg(F.when(F.col("diff") >= 0, (F.col("hi") >= F.col("diff")).cast("double")).otherwise((F.col("lo") <= F.col("diff")).cast("double"))).alias("p"))


def deterministic_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, in the order of a hash of the seed and the keys."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")), *keys).limit(n)


# ---- sequence models ----


def viterbi_path(observed: list[int], start: np.ndarray, move: np.ndarray, emit: np.ndarray, end: np.ndarray | None = None) -> list[int]:
    """Most likely states in log space; zero probabilities become a large negative number."""
    if not len(observed):
        return []
    with np.errstate(divide="ignore"):
        lg = lambda x: np.maximum(np.log(x), -1e10)
        s, m, e, t = lg(start), lg(move), lg(emit), None if end is None else lg(end)
    score, back = s + e[:, observed[0]], []
    for o in observed[1:]:
        via = score[:, None] + m
        back.append(via.argmax(axis=0))
        score = via.max(axis=0) + e[:, o]
    state = int((score if t is None else score + t).argmax())
    path = [state]
    for b in reversed(back):
        path.append(state := int(b[state]))
    return path[::-1]


def forward_backward(observed: list[int], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood and (places, states) posterior, with scaling."""
    n, k = len(observed), len(start)
    f, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t, o in enumerate(observed):
        f[t] = (start if t == 0 else f[t - 1] @ move) * emit[:, o]
        c[t] = f[t].sum()
        f[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = move @ (emit[:, observed[t + 1]] * b[t + 1]) / c[t + 1]
    return float(np.log(c).sum()), f * b


def decode_states(df: DataFrame, column: str, start, move, emit, end=None) -> DataFrame:
    """``df`` with ``states`` (array<int>), the Viterbi path of an array of symbols; one row is one sequence."""
    model = [np.asarray(x, float) for x in (start, move, emit)] + [None if end is None else np.asarray(end, float)]

    @F.pandas_udf("array<int>")
    def path(s: pd.Series) -> pd.Series:
        return s.map(lambda o: viterbi_path(list(o), model[0], model[1], model[2], model[3]))

    return df.withColumn("states", path(column))


def align_score(a: str, b: str, match: float, mismatch: float, gap_open: float, gap_extend: float, local: bool = True) -> float:
    """Best affine-gap alignment score; a gap of length n costs gap_open + (n - 1) * gap_extend. One row of the table at a time."""
    neg = -1e18
    n = len(b)
    h = np.zeros(n + 1) if local else np.concatenate([[0.0], -(gap_open + gap_extend * np.arange(n))])
    down, best = np.full(n + 1, neg), 0.0
    bs = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, ch in enumerate(a, 1):
        s = np.where(bs == ord(ch), match, mismatch)
        down = np.maximum(down - gap_extend, h - gap_open)
        new = np.empty(n + 1)
        new[0] = 0.0 if local else -(gap_open + gap_extend * (i - 1))
        base = np.maximum(h[:-1] + s, down[1:])
        if local:
            base = np.maximum(base, 0.0)
        right, cell = neg, new[0]
        for j in range(n):
            right = max(right - gap_extend, cell - gap_open)
            cell = max(base[j], right)
            new[j + 1] = cell
        h = new
        best = max(best, float(h.max()))
    return best if local else float(h[-1])


def align(df: DataFrame, a: str, b: str, match: float = 2.0, mismatch: float = -1.0, gap_open: float = 2.0, gap_extend: float = 1.0, local: bool = True) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([align_score(p, q, match, mismatch, gap_open, gap_extend, local) for p, q in zip(x, y)])

    return df.withColumn("alignment_score", score(a, b))


def loess(df: DataFrame, key: str, x: str, y: str, span: float) -> DataFrame:
    """(key, x, fitted): local linear regression with tricube weights on the nearest ``span`` share of each key's rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        u, v = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        k, out = max(2, math.ceil(span * len(u))), np.empty(len(u))
        for i, p in enumerate(u):
            d = np.abs(u - p)
            near = np.argsort(d, kind="stable")[:k]
            top = d[near].max()
            w = (1 - (d[near] / top) ** 3) ** 3 if top > 0 else np.ones(len(near))
            mx, my = np.average(u[near], weights=w + 1e-12), np.average(v[near], weights=w + 1e-12)
            var = ((w + 1e-12) * (u[near] - mx) ** 2).sum()
            slope = ((w + 1e-12) * (u[near] - mx) * (v[near] - my)).sum() / var if var > 0 else 0.0
            out[i] = my + slope * (p - mx)
        return pd.DataFrame({key: pdf[key], x: u, "fitted": out})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).groupBy(key).applyInPandas(fit, f"{key} {kind}, {x} double, fitted double")


def best_stretch(values: Column, cut: float) -> Column:
    """(start, end, total) of the contiguous part of an array whose values less ``cut`` have the largest sum; the first among equals."""
    init = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("lo"), F.lit(0).alias("i"), F.lit(0.0).alias("best"), F.lit(0).alias("s"), F.lit(0).alias("e"))

    def step(a, v):
        run = a["run"] + v - cut
        lo = F.when(a["run"] <= 0, a["i"]).otherwise(a["lo"])
        run = F.when(a["run"] <= 0, v - cut).otherwise(run)
        better = run > a["best"]
        return F.struct(run.alias("run"), lo.alias("lo"), (a["i"] + 1).alias("i"), F.when(better, run).otherwise(a["best"]).alias("best"), F.when(better, lo).otherwise(a["s"]).alias("s"), F.when(better, a["i"] + 1).otherwise(a["e"]).alias("e"))

    out = F.aggregate(values, init, step)
    return F.struct(out["s"].alias("start"), out["e"].alias("end"), out["best"].alias("total"))


# ---- graphs ----


def splice_graph(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (chr, start, end, n): exons; edges (chr, a_start, a_end, b_start, b_end, n): introns between neighbouring exons."""
    nodes = genes.select("chr", F.explode("exons").alias("x")).groupBy("chr", F.col("x.start").alias("start"), F.col("x.end").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    n = F.size("exons")
    pairs = F.zip_with(F.slice("exons", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("exons", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    edges = genes.select("chr", F.explode(pairs).alias("p")).groupBy("chr", F.col("p.a.start").alias("a_start"), F.col("p.a.end").alias("a_end"), F.col("p.b.start").alias("b_start"), F.col("p.b.end").alias("b_end")).agg(F.count(F.lit(1)).alias("n"))
    return nodes, edges


def frequent_edges(edges: DataFrame, share: float = 0.1) -> DataFrame:
    """Edges with at least ``share`` of what leaves their source node; totals are taken before anything is dropped."""
    w = Window.partitionBy("chr", "a_start", "a_end")
    return edges.withColumn("f_", F.col("n") / F.sum("n").over(w)).where(F.col("f_") >= share).drop("f_")


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """(a, b, hops): pairs joined by a path of at most ``hops`` edges (a, b), with the fewest hops."""
    paths = edges.select("a", "b").distinct().withColumn("hops", F.lit(1))
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c")).distinct()
    last = paths
    for k in range(2, hops + 1):
        last = last.join(step, "b").select("a", F.col("c").alias("b"), F.lit(k).alias("hops")).distinct()
        paths = paths.union(last)
    return paths.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over ``edges`` (a, b), by smallest-neighbour hooks and rewritten edges, written out each round."""
    from loomspan.plans.storage import written

    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():  # each round leaves at most half of the nodes that still have edges
        both = e.select(F.col("a").alias("id"), F.col("b").alias("n")).union(e.select("b", "a"))
        hook = written(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("to")))
        e = written(
            e.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(hook.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        if labels is None:
            labels = hook.withColumnRenamed("to", "comp")
        else:
            labels = written(labels.join(hook.select(F.col("id").alias("comp"), "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
    return labels if labels is not None else e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
