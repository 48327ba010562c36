"""Shared helpers: scratch tables, bounded samples, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.ship import ship  # noqa: F401

#: Largest number of 8-byte ids that may be broadcast (its count is checked first); beyond it a shuffle join is used.
BROADCAST_IDS = 1_000_000

_roots: dict[str, tuple[SparkSession, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder for intermediate tables: under spark.checkpoint.dir, or a local one where that is unset under a local master."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="loomspan-scratch-")
        _roots[app] = (spark, f"{base.rstrip('/')}/loomspan-{uuid.uuid4().hex[:12]}")
    return _roots[app][1]


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, root in _roots.values():
        with contextlib.suppress(Exception):
            remove(spark, root)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of DataFrames that nothing refers to any more; it does so only after a garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return a worker process's freed memory to the system: the process stays for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """The batch function ``run``, with freed memory given back when its batches end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Scratch:
    """Written tables that cut lineage. ``free`` drops those that later steps no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex[:12]}", {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a lost executor costs a re-read, not a recomputation."""
        self.paths[name] = path = self.path(f"{name}-{len(self.paths)}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def whole_key(*cols: Column | str) -> Column:
    """One string that is never null and differs wherever the columns do, null included: joins on it use plain equality."""
    part = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in part])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hash_fraction(*cols: Column | str) -> Column:
    """A deterministic value in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def only_ids(df: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column named ``key``, ``n`` rows): a broadcast while n is within BROADCAST_IDS."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b), both of one orderable type: rows (id, comp), comp the smallest id.

    Contraction: every vertex hooks to its smallest neighbour and the edges are rewritten with these
    hooks until none is left. Each round at least halves the vertices that still have edges. Vertices
    without edges, nulls and loops don't appear. Nothing is collected; hot vertices are pre-aggregated by min().
    """
    e = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, k = None, 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("id"), F.col("b").alias("n")).union(e.select(F.col("b"), F.col("a")))
        hooks = scratch.cut(both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("to")), f"hooks{k}")
        ha, hb = hooks.select(F.col("id").alias("a"), F.col("to").alias("ta")), hooks.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        new = e.join(ha, "a").join(hb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        e = scratch.cut(new, f"edges{k}")
        if labels is None:
            labels = hooks.select("id", F.col("to").alias("comp"))
        else:
            step = hooks.select(F.col("id").alias("comp"), "to")
            labels = scratch.cut(labels.join(step, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), f"labels{k}")
        k += 1
    kind = edges.schema["a"].dataType
    if labels is None:
        return e.select(F.col("a").cast(kind).alias("id"), F.col("b").cast(kind).alias("comp"))
    return labels


def forest(n: int, i, j):
    """Smallest member of each of n local nodes' component, linked by the index arrays i, j (numpy)."""
    import numpy as np

    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        i, j, low = i[keep], j[keep], np.minimum(a[keep], b[keep])
        np.minimum.at(label, a[keep], low)
        np.minimum.at(label, b[keep], low)
        while (label[label] != label).any():
            label = label[label]
    return label
