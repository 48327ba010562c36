"""Named matrices in long form: one row (row, col, value) per cell, wide only at sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(by: str) -> Window:
    return Window.partitionBy(by)


def melt(wide: DataFrame, key: str) -> DataFrame:
    """Wide to long: every other column becomes a col."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "col", "value").withColumnRenamed(key, "row")


def pivot(m: DataFrame, cols: list[str]) -> DataFrame:
    """Long to wide with the given columns; missing cells are null."""
    return m.groupBy("row").pivot("col", cols).agg(F.first("value"))


def select_rows(m: DataFrame, names: list[str]) -> DataFrame:
    return m.where(F.col("row").isin(names))


def exclude_rows(m: DataFrame, names: DataFrame) -> DataFrame:
    """Without the rows named in ``names`` (row)."""
    return m.join(names.select("row").distinct(), "row", "left_anti")


def centre(m: DataFrame, by: str, how: str) -> DataFrame:
    """Values less the mean or median of their row or column."""
    mid = F.avg("value") if how == "mean" else F.percentile("value", F.lit(0.5))
    return m.withColumn("value", F.col("value") - mid.over(_window(by)))


def ratio(m: DataFrame, by: str, how: str) -> DataFrame:
    """Values over the mean or median of their row or column; a negative value is an error."""
    mid = F.avg("value") if how == "mean" else F.percentile("value", F.lit(0.5))
    checked = F.when(F.col("value") < 0, F.raise_error(F.lit("a ratio needs values of 0 or more")).cast("double")).otherwise(F.col("value"))
    return m.withColumn("value", checked / mid.over(_window(by)))


def z_normalise(m: DataFrame, by: str) -> DataFrame:
    w = _window(by)
    return m.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w))


def quantile_normalise(m: DataFrame) -> DataFrame:
    """Each column's k-th smallest value becomes the mean of all columns' k-th smallest; ties by row name.

    Order positions come from a window per column; only (rank, mean) pairs are aggregated across columns.
    """
    ranked = m.withColumn("rank", F.row_number().over(_window("col").orderBy("value", "row")))
    means = ranked.groupBy("rank").agg(F.avg("value").alias("value"))
    return ranked.drop("value").join(means, "rank").select("row", "col", "value")


def size_factors(m: DataFrame) -> DataFrame:
    """(col, factor): 1 / median over rows of value / geometric mean of the row; rows with a zero drop out."""
    logs = F.when(F.min("value").over(_window("row")) > 0, F.exp(F.avg(F.log("value")).over(_window("row"))))
    return m.withColumn("r", F.col("value") / logs).where("r is not null").groupBy("col").agg((1 / F.percentile("r", F.lit(0.5))).alias("factor"))


def top_rows(m: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows of largest value in column ``by``, ties by name, with their position."""
    best = m.where(F.col("col") == by).orderBy(F.desc("value"), "row").limit(n)
    return best.select("row", "value", F.row_number().over(Window.orderBy(F.desc("value"), "row")).alias("position"))


def invariant_rows(m: DataFrame, fold: float) -> DataFrame:
    """Without rows whose spread of log2 values is at most log2(fold)."""
    spread = F.pow(F.lit(2.0), F.max("value").over(_window("row")) - F.min("value").over(_window("row")))
    return m.withColumn("spread_", spread).where(F.col("spread_") > fold).drop("spread_")


def collapse_rows(m: DataFrame, names: DataFrame) -> DataFrame:
    """Median over the rows of one description; ``names`` (row, description)."""
    return m.join(names, "row").groupBy("description", "col").agg(F.percentile("value", F.lit(0.5)).alias("value"))


def combine(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """Cell by cell ``op(left, right)`` over cells that both have."""
    return a.join(b.withColumnRenamed("value", "other_"), ["row", "col"]).select("row", "col", op(F.col("value"), F.col("other_")).alias("value"))


def log2_plus(m: DataFrame, fudge: float) -> DataFrame:
    return m.withColumn("value", F.log2(F.col("value") + fudge))


def squared(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.col("value") * F.col("value"))


def rounded(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.floor(F.col("value") + 0.5).cast("double"))


def floored(m: DataFrame, low: float) -> DataFrame:
    return m.withColumn("value", F.greatest("value", F.lit(low)))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: join on the inner name, sum of products per (row, col)."""
    left, right = a.select("row", F.col("col").alias("k"), F.col("value").alias("x")), b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def batch_centre(values: DataFrame, controls: Column) -> DataFrame:
    """value less the median of its batch's controls (gene, batch, value kept): the controls' own values stay the basis for every row."""
    mid = values.where(controls).groupBy("batch").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    return values.join(F.broadcast(mid), "batch").withColumn("value", F.col("value") - F.col("mid")).drop("mid")


def control_z(m: DataFrame, controls: DataFrame) -> DataFrame:
    """z of each value against the control rows of its column; ``controls`` (row)."""
    c = m.join(controls.select("row").distinct(), "row").groupBy("col").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return m.join(F.broadcast(c), "col").select("row", "col", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value"))


def _numbered(m: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): the 0-based place of each row or column name; one row per name."""
    return m.select(by).distinct().select(by, (F.row_number().over(Window.orderBy(by)) - 1).alias(name))


def submatrix(m: DataFrame, rows: list[int] | None = None, cols: list[str] | None = None) -> DataFrame:
    """The rows of these places (by name) and the columns of these names."""
    if cols is not None:
        m = m.where(F.col("col").isin(cols))
    if rows is not None:
        m = m.join(F.broadcast(_numbered(m, "row", "k_").where(F.col("k_").isin(rows)).select("row")), "row", "left_semi")
    return m.select("row", "col", "value")


def by_column(m: DataFrame, col: str, below: float | None = None, above: float | None = None) -> DataFrame:
    """Rows whose value in column ``col`` is under ``below`` and over ``above``."""
    keep = m.where(F.col("col") == col)
    if below is not None:
        keep = keep.where(F.col("value") < below)
    if above is not None:
        keep = keep.where(F.col("value") > above)
    return m.join(keep.select("row").distinct(), "row", "left_semi").select("row", "col", "value")


def non_trivial_columns(m: DataFrame) -> DataFrame:
    """(col): columns with a value that isn't zero."""
    return m.where("value <> 0").select("col").distinct()


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of ``b`` under those of ``a``, by position: b's k-th column, by name, becomes a's k-th."""
    names = _numbered(a, "col", "k_").withColumnRenamed("col", "name_").join(_numbered(b, "col", "k_"), "k_").select("col", "name_")
    return a.select("row", "col", "value").union(b.join(F.broadcast(names), "col").select("row", "name_", "value"))


def sorted_columns(m: DataFrame) -> DataFrame:
    """(col, rank, value): each column's values in order, on their own; ranks from 0."""
    return m.select("col", (F.row_number().over(_window("col").orderBy("value", "row")) - 1).alias("rank"), "value")


def ranked(m: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Values replaced by their 0-based rank in their row or column, the mean of the places for ties."""
    order = F.desc("value") if descending else F.asc("value")
    w = _window(by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, "value"))
    return m.withColumn("value", F.rank().over(w.orderBy(order)) - 1 + (ties - 1) / 2.0)


def discretised(m: DataFrame, up: float, down: float) -> DataFrame:
    """1 from ``up`` on, -1 to ``down``, else 0."""
    return m.withColumn("value", F.when(F.col("value") >= up, 1.0).when(F.col("value") <= down, -1.0).otherwise(0.0))


def preprocessed(m: DataFrame, low: float, high: float, fold: float, spread: float) -> DataFrame:
    """Values cut to [low, high]; rows stay with max / min of ``fold`` and max - min of ``spread`` at least."""
    x = m.withColumn("value", F.least(F.greatest("value", F.lit(low)), F.lit(high)))
    most, least = F.max("value").over(_window("row")), F.min("value").over(_window("row"))
    return x.withColumns({"a_": most / least, "b_": most - least}).where((F.col("a_") >= fold) & (F.col("b_") >= spread)).select("row", "col", "value")
