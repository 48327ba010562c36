"""Near-duplicate vectors by spherical k-means cells (operator 7).

Equal vectors are one class first. Centroids are fitted on a bounded sample; each class belongs to the cell of
its nearest centroid and also visits every later cell that a linked vector may belong to. Classes are written once,
by cell; a task takes a block of one cell and reads the cells that it visits from these files, so that visits, whose
number may grow with the square of the table, take no disk. Blocks are compared by matrix products. The points as near to two centroids as to each other
are a hyperplane through the origin; the way from a vector to a linked one of the other cell crosses it, so the
vector's angle to it is at most the angle of the threshold (see ``visits``). No pair is lost.
Counts of links and a spanning forest leave a block, never its pairs. Components join the forests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, components, forest, release, ship

#: Bounded sample that the centroids are fitted on, classes a cell holds on average, most cells, k-means rounds.
SAMPLE_ROWS, CELL_ROWS, MOST_CELLS, ROUNDS = 20_000, 2000, 4096, 8
#: Added to the bound on visits for rounding.
ROUNDING = 1e-7
#: Rows of a block.
BLOCK = 1024
#: Screening in single precision keeps pairs this far below the limit; they are then decided in double precision.
SLACK = 1e-4


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centroids of the unit rows x: each row joins the centroid of largest cosine, centroids are the rows' normed sums."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(size > 1e-12, new / np.maximum(size, 1e-12), c)
    return c


def visits(near: np.ndarray, centroids: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells each row visits: its own (of largest cosine ``near`` to the unit ``centroids``) and those after it that may hold a linked row.

    A row a of cell i linked with b of cell j has near[i] - near[j] <= sin(angle of ``threshold``) * |c_i - c_j|,
    and so has b the other way round; it is enough that the row of the earlier cell visits.
    """
    home = near.argmax(axis=1)
    lower = threshold - 1e-12
    own = near[np.arange(len(near)), home][:, None]
    if lower > 0:
        apart = np.sqrt(np.maximum(2 - 2 * (centroids[home] @ centroids.T), 0))
        reach = own - near <= math.sqrt(max(1 - lower * lower, 0.0)) * apart + ROUNDING
    else:
        reach = np.ones(near.shape, bool)
    cell = np.arange(near.shape[1])[None]
    return (cell == home[:, None]) | (reach & (cell > home[:, None]))


def _unit(v: list | None) -> list | None:
    """The vector scaled to length 1 in double precision; None if null, empty, zero, or with null or non-finite components."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top  # neither overflow nor underflow of the squares
    return a / np.linalg.norm(a)


def _units(df: DataFrame) -> DataFrame:
    """(vec_id, key binary, unit binary): the unit vectors' sha256 and bytes, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [None if (v := _unit(x)) is None else (v + 0.0).tobytes() for x in b.column(1).to_pylist()]
            key = [None if v is None else hashlib.sha256(v).digest() for v in u]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(u, pa.binary())], names=["vec_id", "key", "unit"])

    return df.mapInArrow(run, "vec_id long, key binary, unit binary")


def linked_components(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link where their cosine in double precision is at least ``threshold``; no pair below it is linked.
    n_links: other vectors linked directly; component_id: smallest vec_id reachable by links, itself included;
    kept: vec_id = component_id. Vectors of different lengths never link. Null or empty vectors, zero ones and
    those with null or non-finite components link with nothing. Repeated rows (equal vec_id and vector) count as
    vectors of their own in n_links. Rows without vec_id link like others, but don't name a component. An empty
    table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    units = _units(vectors.select("vec_id", "embedding"))
    rows = scratch.cut(units.select("vec_id", "key"), "rows")  # the vectors themselves go with their classes only
    classes = units.where("unit is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("unit").alias("unit"))
    classes = scratch.cut(classes.withColumn("rep", F.xxhash64("unit")), "classes")
    release(spark)
    sizes = classes.groupBy(F.length("unit").alias("bytes")).count().collect()  # one row per vector length
    counts, edges = [], []
    for r in sizes:
        got = scratch.cut(_one_length(scratch, classes.where(F.length("unit") == r["bytes"]), r["count"], r["bytes"] // 8, threshold), f"found{r['bytes']}")
        counts.append(got.where("other is null").select("rep", "n"))
        edges.append(got.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    count, edge = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:]):
        count, edge = count.union(c), edge.union(e)
    comps = scratch.cut(components(spark, edge, scratch), "comps")
    out = classes.join(count.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    out = out.withColumn("comp", F.coalesce("comp", "rep"))
    lowest = out.groupBy("comp").agg(F.min("low").alias("component_id"))
    out = scratch.cut(out.join(lowest, "comp").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"), "out")
    full = rows.join(out, "key", "left")
    comp = F.coalesce("component_id", "vec_id")
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def _one_length(scratch: Scratch, classes: DataFrame, n: int, dims: int, threshold: float) -> DataFrame:
    """Rows (rep, n, other): weighted link counts (other null) and forest edges (n 0) of one length's classes."""
    spark = classes.sparkSession
    k = max(1, min(MOST_CELLS, math.ceil(n / CELL_ROWS)))
    sample = classes.select("unit", "rep").orderBy("rep").limit(SAMPLE_ROWS).select("unit").collect()
    centroids = spherical_kmeans(np.stack([np.frombuffer(r["unit"], np.float64) for r in sample]), k)
    shared = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                home = (np.stack([np.frombuffer(u, np.float64) for u in part.column(0).to_pylist()]) @ c.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home), *part.columns], names=["home", "unit", "rep", "mult"])

    folder = scratch.path(f"cells{dims}")
    placed = classes.select("unit", "rep", "mult").mapInArrow(place, "home long, unit binary, rep long, mult long")
    placed.repartition("home").sortWithinPartitions("home").write.partitionBy("home").parquet(folder)
    sizes = spark.read.parquet(folder).groupBy(F.col("home").cast("long").alias("home")).count().collect()  # at most MOST_CELLS rows
    cells = sorted(r["home"] for r in sizes)
    block = BLOCK
    work = [(r["home"], p) for r in sizes for p in range(-(-r["count"] // block))]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, p in batch.itertuples(index=False):
                ua, ra, ma = next(islice(_blocks(folder, cell, block), p, None))
                seen = visits(ua @ shared.value.T, shared.value, threshold)
                for other in cells:
                    rows = np.flatnonzero(seen[:, other]) if other > cell else np.arange(len(ua)) if other == cell else []
                    if len(rows):
                        for ub, rb, mb in _blocks(folder, other, block):
                            if len(out := _links(ua[rows], ra[rows], ma[rows], ub, rb, mb, other == cell, threshold)):
                                yield out

    n = min(len(work), 4 * max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame(work, "cell long, p long").repartition(n).mapInPandas(compare, "rep long, n long, other long")


def _blocks(folder: str, cell: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """unit, rep and mult of a cell's classes from its files, ``size`` rows at a time; the same blocks each time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    def arrays(t: pa.Table):
        return np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(t.num_rows, -1), t["rep"].to_numpy(), t["mult"].to_numpy()

    store, base = fs.FileSystem.from_uri(f"{folder}/home={cell}")
    held, n = [], 0
    for path in sorted(x.path for x in store.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(".parquet")):
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(size, columns=["unit", "rep", "mult"]):
                held.append(batch)
                n += batch.num_rows
                while n >= size:
                    t = pa.Table.from_batches(held)
                    yield arrays(t.slice(0, size))
                    held, n = t.slice(size).to_batches(), n - size
    if n:
        yield arrays(pa.Table.from_batches(held))


def _links(ua, ra, ma, ub, rb, mb, same: bool, threshold: float) -> pd.DataFrame:
    """Rows (rep, n, other) of two blocks: weighted link counts (other null) and forest edges (n 0).

    ``same``: blocks of one cell, which are met in either order, so that each time the first counts its own; else the pair meets here only, for both.
    """
    i, j = np.nonzero(ua.astype(np.float32) @ ub.astype(np.float32).T >= threshold - SLACK)
    keep = ra[i] != rb[j]
    i, j = i[keep], j[keep]
    cosine = np.concatenate([np.einsum("nd,nd->n", ua[i[lo : lo + 65536]], ub[j[lo : lo + 65536]]) for lo in range(0, max(len(i), 1), 65536)])
    i, j = i[cosine >= threshold], j[cosine >= threshold]
    na = np.bincount(i, weights=mb[j], minlength=len(ra)).astype(np.int64)
    nb = np.bincount([] if same else j, weights=[] if same else ma[i], minlength=len(rb)).astype(np.int64)
    ids, local = np.unique(np.concatenate([ra, rb]), return_inverse=True)
    root = forest(len(ids), local[i], local[len(ra) + j])
    linked = np.flatnonzero(root != np.arange(len(ids)))
    out_n = pd.DataFrame({"rep": np.concatenate([ra[na > 0], rb[nb > 0]]), "n": np.concatenate([na[na > 0], nb[nb > 0]])})
    out_n["other"] = pd.array([pd.NA] * len(out_n), dtype="Int64")
    out_e = pd.DataFrame({"rep": ids[linked], "n": 0, "other": pd.array(ids[root[linked]], dtype="Int64")})
    return pd.concat([out_n, out_e], ignore_index=True)
