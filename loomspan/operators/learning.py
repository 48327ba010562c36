"""Least squares, small dense matrices and support vector machines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, key: str, terms: list) -> DataFrame:
    """(key, m): the sums of products of every two ``terms``, row by row, from one aggregation with partial sums."""
    sums = [F.sum(a * b) for a in terms for b in terms]
    return df.groupBy(key).agg(F.array(*sums).alias("m"))


def linear_regression(df: DataFrame, key: str, xs: list[str], y: str) -> DataFrame:
    """(key, intercept, slopes, r2) of ``y`` on ``xs`` by least squares for each key; rows with a null are left out.

    Only sums of products reach the Python side, one small row a key. Where the ``xs`` depend on each other, the solution of
    least length is given; r2 is null where y doesn't vary.
    """
    size = len(xs) + 2
    rows = df.select(key, *xs, y).dropna()
    # centred on each key's means first: sums of squares of large values would lose digits
    means = rows.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in [*xs, y]])
    x = rows.join(means, key).select(key, *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in [*xs, y]])
    m = _moments(x, key, [F.lit(1.0), *[F.col(c) for c in [*xs, y]]]).join(means, key)

    def fit(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = np.array(row["m"], float).reshape(size, size)
                slopes = np.linalg.lstsq(s[1:-1, 1:-1], s[1:-1, -1], rcond=None)[0]
                r2 = float(slopes @ s[1:-1, -1] / s[-1, -1]) if s[-1, -1] > 0 else None
                out.append((row[key], row[f"mean_{y}"] - float(sum(b * row[f"mean_{c}"] for b, c in zip(slopes, xs))), slopes.tolist(), r2))
            yield pd.DataFrame(out, columns=[key, "intercept", "slopes", "r2"])

    return m.mapInPandas(fit, f"{key} {dict(df.dtypes)[key]}, intercept double, slopes array<double>, r2 double")


def dense(df: DataFrame, key: str) -> DataFrame:
    """(key, rank, det, cond, inverse, singular, eigen) of each key's square matrix (key, i, j, value), i and j from 0, absent entries 0.

    det, inverse and eigen (real parts, ascending) belong to square matrices; inverse is null where the rank is not full.
    A matrix is one row for its task: meant for small ones.
    """
    x = df.groupBy(key).agg(F.collect_list(F.struct("i", "j", F.col("value").cast("double").alias("value"))).alias("c"))

    def work(batches):
        for pdf in batches:
            out = []
            for name, cells in zip(pdf[key], pdf["c"]):
                n = 1 + max(max(c["i"], c["j"]) for c in cells)
                a = np.zeros((n, n))
                for c in cells:
                    a[c["i"], c["j"]] += c["value"]
                rank, s = int(np.linalg.matrix_rank(a)), np.linalg.svd(a, compute_uv=False)
                inverse = np.linalg.inv(a).tolist() if rank == n else None
                cond = float(s[0] / s[-1]) if s[-1] > 0 else float("inf")
                out.append((name, rank, float(np.linalg.det(a)), cond, inverse, s.tolist(), sorted(np.linalg.eigvals(a).real.tolist())))
            yield pd.DataFrame(out, columns=[key, "rank", "det", "cond", "inverse", "singular", "eigen"])

    return x.mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, rank int, det double, cond double, inverse array<array<double>>, singular array<double>, eigen array<double>")


def cross_validated_svm(df: DataFrame, key: str, xs: list[str], label: str, folds: int, cost: float = 0.01, passes: int = 50) -> DataFrame:
    """(key, fold, label, predicted): a linear support vector machine on ``xs``, each row judged by the machine that its fold had no part in.

    ``label`` is 0 or 1. The fold comes from the key's hash. ``cost`` weighs the squared weights against the hinge loss.
    A fold whose training rows have one label only predicts this label.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from loomspan.plans.storage import written

    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int")
    rows = written(df.select(F.col(key), fold.alias("fold"), F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in xs]).dropna())
    ready = VectorAssembler(inputCols=xs, outputCol="features").transform(rows)
    seen = {(r["fold"], r["label"]) for r in rows.select("fold", "label").distinct().collect()}  # two rows a fold at most
    out = None
    for k in sorted({f for f, _ in seen}):
        others = {y for f, y in seen if f != k}
        test = ready.where(F.col("fold") == k)
        if len(others) < 2:
            got = test.withColumn("predicted", F.lit(next(iter(others), 0.0)))
        else:
            model = LinearSVC(maxIter=passes, regParam=cost, standardization=True).fit(ready.where(F.col("fold") != k))
            got = model.transform(test).withColumn("predicted", F.when(vector_to_array("rawPrediction")[1] > 0, 1.0).otherwise(0.0))
        got = got.select(key, "fold", F.col("label").cast("int").alias("label"), F.col("predicted").cast("int").alias("predicted"))
        out = got if out is None else out.union(got)
    return out if out is not None else rows.select(key, "fold", F.col("label").cast("int").alias("label"), F.col("label").cast("int").alias("predicted"))
