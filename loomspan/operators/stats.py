"""Statistics over groups, as aggregate expressions and short plans.

Where the usual name would mislead, functions are named by what they compute. Sums are taken in one pass over
partial aggregates; ranks need one window per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(x: Column | str, p: float) -> Column:
    """Linear interpolation at p * (n - 1)."""
    return F.percentile(x, F.lit(p))


def mean_skipping_nan(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.avg(F.when(~F.isnan(c), c))


def standard_deviation(x: Column | str) -> Column:
    return F.stddev_samp(x)


def geometric_mean(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.min(c) > 0, F.exp(F.avg(F.log(F.when(c > 0, c))))).otherwise(0.0)


def entropy(p: Column | str) -> Column:
    """-sum of p log2 p over the group's shares p."""
    c = F.col(p) if isinstance(p, str) else p
    return -F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0))


def median_absolute_deviation(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, median, mad), unscaled."""
    mid = df.groupBy(*keys).agg(quantile(x, 0.5).alias("median"))
    return df.join(mid, keys).groupBy(*keys, "median").agg(quantile(F.abs(F.col(x) - F.col("median")), 0.5).alias("mad"))


def max_mean(x: Column | str) -> Column:
    """The mean (over all) of the positive parts or of the others, whichever is larger in size; a tie gives the negative one."""
    c = F.col(x) if isinstance(x, str) else x
    up, down = F.sum(F.when(c > 0, c).otherwise(0.0)) / F.count(c), F.sum(F.when(c <= 0, c).otherwise(0.0)) / F.count(c)
    return F.when(up > -down, up).otherwise(down)


def two_groups(df: DataFrame, key: str, group: str, a: str, b: str, x: str = "value") -> DataFrame:
    """(key, n1, n2, m1, m2, v1, v2): counts, means and variances of the two groups; keys with fewer than two values in a group drop out."""
    g = F.col(group)
    part = lambda v: F.when(g == v, F.col(x))
    out = df.where(g.isin(a, b)).groupBy(key).agg(
        *[F.count(part(v)).alias(f"n{k}") for k, v in ((1, a), (2, b))],
        *[F.avg(part(v)).alias(f"m{k}") for k, v in ((1, a), (2, b))],
        *[F.var_samp(part(v)).alias(f"v{k}") for k, v in ((1, a), (2, b))],
    )
    return out.where("n1 > 1 and n2 > 1")


def t_statistic(fudge: float = 3.0) -> Column:
    """From the columns of ``two_groups``: pooled, with ``fudge`` added to the deviation."""
    n1, n2 = F.col("n1"), F.col("n2")
    s = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    return (F.col("m1") - F.col("m2")) * F.sqrt(n1 * n2) / ((s + fudge) * F.sqrt(n1 + n2))


def fold(log: bool = False) -> Column:
    """Ratio of the means m1, m2 (log: of 2 to their power)."""
    return F.pow(F.lit(2.0), F.col("m1") - F.col("m2")) if log else F.col("m1") / F.col("m2")


def absolute_fold() -> Column:
    return F.greatest(fold(), 1 / fold())


def z_score(x: Column, mean: Column, sd: Column, n: Column | None = None) -> Column:
    """(x - mean) / sd; with n: times its root (against the error of a mean)."""
    z = (x - mean) / sd
    return z if n is None else z * F.sqrt(n)


def paired_t(difference: Column | str) -> Column:
    return F.avg(difference) / (F.stddev_samp(difference) / F.sqrt(F.count(difference)))


def anova_f(df: DataFrame, key: str, group: str, x: str = "value") -> DataFrame:
    """(key, f): between-group over within-group mean squares, from counts, sums and sums of squares."""
    v = F.col(x)
    per = df.groupBy(key, group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    tot = per.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return tot.where("k > 1 and n > k").select(key, (between / within).alias("f"))


def mean_rank(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``df`` with 0-based ``rank`` of x among the keys' rows, ties averaged."""
    w, same = Window.partitionBy(*keys).orderBy(x), Window.partitionBy(*keys, x)
    return df.withColumn("rank", F.rank().over(w) - 1 + (F.count(F.lit(1)).over(same) - 1) / 2.0)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail of z, by a rational approximation of the error function (absolute error below 1.5e-7)."""
    # fixed values: coefficients of the approximation
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, key: str, group: str, a: str, b: str, x: str = "value") -> DataFrame:
    """(key, n1, n2, u, z): rank-sum test with averaged ties and no tie correction of the deviation."""
    r = mean_rank(df.where(F.col(group).isin(a, b)), [key], x)
    one = F.col(group) == a
    s = r.groupBy(key).agg(F.sum(F.when(one, F.col("rank") + 1)).alias("r1"), F.count(F.when(one, 1)).alias("n1"), F.count(F.when(~one, 1)).alias("n2")).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    return s.select(key, "n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def signed_rank(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, w, z): paired signed-rank test; zero differences stay and count as not positive."""
    d = df.withColumn("d", F.col(x) - F.col(y)).withColumn("abs_", F.abs("d"))
    r = mean_rank(d, [key], "abs_")
    s = r.groupBy(key).agg(F.sum(F.when(F.col("d") > 0, F.col("rank") + 1).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return s.select(key, "n", "w", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def two_sample_ks(df: DataFrame, key: str, group: str, a: str, b: str, x: str = "value") -> DataFrame:
    """(key, d): largest distance of the two groups' empirical distributions."""
    one = F.col(group) == a
    per = df.where(F.col(group).isin(a, b)).groupBy(key, x).agg(F.count(F.when(one, 1)).alias("a"), F.count(F.when(~one, 1)).alias("b"))
    w, every = Window.partitionBy(key).orderBy(x), Window.partitionBy(key)
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(every) - F.sum("b").over(w) / F.sum("b").over(every))
    return per.withColumn("d", gap).groupBy(key).agg(F.max("d").alias("d"))


def spearman(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, rho): correlation of averaged ranks."""
    r = mean_rank(mean_rank(df, [key], x).withColumnRenamed("rank", "rx"), [key], y)
    return r.groupBy(key).agg(F.corr("rx", "rank").alias("rho"))


def histogram(df: DataFrame, keys: list[str], x: str, low: float, high: float, bins: int, clamp: bool = False) -> DataFrame:
    """(keys, bin, lo, n, below): equal-width bins, the largest value in the last one; values outside are left out, or put in the outer bins. below: share in lower bins."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("long")
    inside = df if clamp else df.where(F.col(x).between(low, high))
    per = inside.groupBy(*keys, F.greatest(k, F.lit(0).cast("long")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0)) / F.sum("n").over(Window.partitionBy(*keys))
    return per.select(*keys, "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"), "n", below.alias("below"))


def histogram_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chi2, kl, js): distances of two histograms (bin, n); bins empty in either are skipped in kl (log2)."""
    pa = a.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select("bin", "p")
    pb = b.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).select("bin", "q")
    x = pa.join(pb, "bin", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = lambda u, v: F.when((u > 0) & (v > 0), u * F.log2(u / v)).otherwise(0.0)
    return x.agg(
        F.sum(F.when(p + q > 0, (p - q) * (p - q) / (p + q)).otherwise(0.0)).alias("chi2"),
        F.sum(part(p, q)).alias("kl"),
        F.sqrt(F.greatest(F.sum(part(p, m) + part(q, m)) / 2, F.lit(0.0))).alias("js"),
    )


def hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with ``adjusted``: from the largest p down, the least so far of p times its 1-based position from the top."""
    x = df.withColumn("i", F.row_number().over(Window.orderBy(F.desc(p), "name")))
    return x.withColumn("adjusted", F.min(F.col(p) * F.col("i")).over(Window.orderBy("i"))).drop("i")


def fdr_cutoff(df: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """(cutoff): the largest p that is at most (i / n) * alpha with i from 0; the smallest p if none is."""
    x = df.select(p, (F.row_number().over(Window.orderBy(p)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    return x.agg(F.coalesce(F.max(F.when(F.col(p) <= F.col("i") / F.col("n") * alpha, F.col(p))), F.min(p)).alias("cutoff"))


def empirical_p(observed: DataFrame, null: DataFrame) -> DataFrame:
    """``observed`` (name, x) with p = share of ``null`` (x) that is at least x. One sort of both; no pairs."""
    both = observed.select("name", "x", F.lit(0).alias("k")).union(null.select(F.lit(None).cast("string"), "x", F.lit(1)))
    less = F.sum("k").over(Window.orderBy("x", "k").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("k").over(Window.partitionBy(F.lit(0)))
    return both.withColumn("p", 1 - F.coalesce(less, F.lit(0)) / total).where("k = 0").select("name", "x", "p")


def running_sum_enrichment(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """(set_name, score): weighted running sum over ``ranked`` (gene, pos, r), hits up by |r| over the set's total, misses down by 1 over their number; the value of largest size.

    Only hits are joined: between two hits the sum falls evenly, so its extremes stand right at and right before hits.
    """
    n = ranked.count()
    hit = members.join(ranked, "gene").withColumn("w", F.abs("r"))
    every = Window.partitionBy("set_name")
    w = every.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = hit.withColumns({"k": F.count(F.lit(1)).over(every), "up": F.sum("w").over(w) / F.sum("w").over(every), "j": F.count(F.lit(1)).over(w)})
    miss = F.lit(1.0) / (F.lit(n) - F.col("k"))
    at = F.col("up") - (F.col("pos") - F.col("j")) * miss  # pos from 1
    before = F.col("up") - F.col("w") / F.sum("w").over(every) - (F.col("pos") - F.col("j")) * miss
    x = x.withColumns({"at": at, "before": before})
    hi, lo = F.max("at"), F.least(F.min("before"), F.lit(0.0))
    return x.groupBy("set_name").agg(F.when(hi >= -lo, hi).otherwise(lo).alias("score"))


def permutation_fdr(observed: DataFrame, permuted: DataFrame, rounds: int) -> DataFrame:
    """(name, x, fdr): expected number of permuted values at least x over observed ones at least x; none permuted: 1 / rounds; least so far from the smallest x up, 1 at most."""
    both = observed.select("name", "x", F.lit(1).alias("o"), F.lit(0).alias("q")).union(permuted.select(F.lit(None).cast("string"), "x", F.lit(0), F.lit(1)))
    w = Window.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = both.withColumns({"no": F.sum("o").over(w), "nq": F.sum("q").over(w)}).where("o = 1")
    raw = F.when(F.col("nq") == 0, F.lit(1.0 / rounds)).otherwise(F.col("nq") / F.lit(float(rounds)) / F.col("no"))
    return x.select("name", "x", F.least(F.min(raw).over(Window.orderBy("x", F.desc("name"))), F.lit(1.0)).alias("fdr"))


def covariance(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Sample covariance and variance's root of two columns for each value of ``by``."""
    return df.groupBy(by).agg(F.covar_samp(x, y).alias("covariance"), F.stddev_samp(x).alias("sd"))


def mean_of_means(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """(by, mean): the mean over the groups' means."""
    return df.groupBy(by, group).agg(F.avg(value).alias("m")).groupBy(by).agg(F.avg("m").alias("mean"))


def symmetric_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: KL(p, q) + KL(q, p) in bits over (bin, p) tables; bins that either lacks are skipped."""
    x = p.select("bin", F.col("p").alias("a")).join(q.select("bin", F.col("p").alias("b")), "bin").where("a > 0 and b > 0")
    return x.agg(F.sum(F.col("a") * F.log2(F.col("a") / F.col("b"))).alias("pq"), F.sum(F.col("b") * F.log2(F.col("b") / F.col("a"))).alias("qp")).select((F.col("pq") + F.col("qp")).alias("divergence"))


def added_distribution(p: DataFrame, q: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """(bin, n): the counts of two histograms (bin, n) added bin by bin, with a pseudocount for each bin of either."""
    return p.select("bin", "n").union(q.select("bin", "n")).groupBy("bin").agg((F.sum("n") + pseudo).alias("n"))


def translational_efficiency(counts: DataFrame, least: float) -> DataFrame:
    """(name, te): (ribo + 1) / (rna + 1) of rows (name, ribo, rna, p) with p below ``least``; -99 for others."""
    return counts.select("name", F.when(F.col("p") < least, (F.col("ribo") + 1) / (F.col("rna") + 1)).otherwise(-99.0).alias("te"))


def release_score(counts: DataFrame) -> DataFrame:
    """(name, score): (coding + 1) / coding length by (trailing + 1) / trailing length."""
    return counts.select("name", ((F.col("cds") + 1) / F.col("cds_length") / ((F.col("utr") + 1) / F.col("utr_length"))).alias("score"))


def expression_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin``, 0 to bins - 1: equal widths from the least to the largest value."""
    edge = df.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    k = F.least(F.floor((F.col(value) - F.col("lo_")) * bins / (F.col("hi_") - F.col("lo_"))), F.lit(bins - 1)).cast("int")
    return df.join(F.broadcast(edge)).withColumn("bin", F.coalesce(k, F.lit(0))).drop("lo_", "hi_")


def neighbour_correlation(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, r): Pearson correlation of two rows' values over the columns of a long matrix, for each pair (a, b)."""
    x = pairs.join(m.select(F.col("row").alias("a"), "col", F.col("value").alias("x")), "a").join(m.select(F.col("row").alias("b"), F.col("col").alias("c_"), F.col("value").alias("y")), "b").where("col = c_")
    return x.groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
