"""Queries of the probability functions, models, permutations and graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspan.functions import probability as pr
from loomspan.operators import models as md
from loomspan.plans.bind import GENES, MATRIX, genes, matrix, query, table


@query("""WITH k AS (SELECT l_linenumber AS k, (l_quantity / 10)::DOUBLE AS rate FROM lineitem GROUP BY ALL)
SELECT k, rate, round(exp(k * ln(rate) - rate - lgamma(k + 1)), 6) AS pmf, round(list_sum(list_transform(range(0, k + 1), lambda i: exp(i * ln(rate) - rate - lgamma(i + 1)))), 6) AS cdf FROM k""")
def probability_poisson(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), (F.col("l_quantity") / 10).alias("rate")).distinct()
    return k.select("k", "rate", F.round(pr.poisson_pmf(F.col("k"), F.col("rate")), 6).alias("pmf"), F.round(pr.poisson_cdf("k", "rate"), 6).alias("cdf"))


@query("""WITH c AS (SELECT o_custkey % 40 AS k, (o_orderkey % 7 + 1) / 1000.0::DOUBLE AS rate FROM orders GROUP BY ALL), m AS (SELECT *, rate * 500 AS mu FROM c WHERE k > 0),
p AS (SELECT k, rate, mu, exp((k - 1) * ln(mu) - mu - lgamma(k)) AS pm, list_sum(list_transform(range(0, k), lambda i: exp(i * ln(mu) - mu - lgamma(i + 1)))) AS cd FROM m)
SELECT k, rate, round(CASE WHEN k <= 2 THEN 1 ELSE least(abs(1 - cd * exp(-((k - mu) / k * (rate * (100000 - 500) * pm)))), 1) END, 6) AS p FROM p""")
def probability_scan(spark, d):
    c = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k"), ((F.col("o_orderkey") % 7 + 1) / 1000.0).alias("rate")).distinct().where("k > 0")
    return c.select("k", "rate", F.round(pr.scan_p_value("k", "rate", F.lit(500.0), F.lit(100000.0)), 6).alias("p"))


@query("""WITH s AS (SELECT DISTINCT p_type AS set_name, p_partkey AS gene FROM part), c AS (SELECT p_partkey AS gene FROM part WHERE p_size < 20), t AS (SELECT (SELECT count(*) FROM part) AS n, (SELECT count(*) FROM c) AS d),
x AS (SELECT set_name, count(*) AS size, count(c.gene) AS hits FROM s LEFT JOIN c USING (gene) GROUP BY set_name),
j AS (SELECT set_name, size, hits, n, d, unnest(range(hits, greatest(least(size, d), hits))) AS j FROM x, t),
p AS (SELECT set_name, sum(exp(lgamma(size + 1) - lgamma(j + 1) - lgamma(size - j + 1) + lgamma(n - size + 1) - lgamma(d - j + 1) - lgamma(n - size - d + j + 1) - lgamma(n + 1) + lgamma(d + 1) + lgamma(n - d + 1))) AS p FROM j WHERE d - j <= n - size AND d >= j GROUP BY set_name)
SELECT set_name, size, hits, round(CASE WHEN hits = 0 THEN 1 ELSE coalesce(p, 0) END, 6) AS p FROM x LEFT JOIN p USING (set_name)""")
def sets_hypergeometric(spark, d):
    p = table(spark, d, "part")
    x = md.set_enrichment(p.select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene")), p.where("p_size < 20").select(F.col("p_partkey").alias("gene")), p.count())
    return x.withColumn("p", F.round("p", 6))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), c AS (SELECT v AS c FROM e WHERE vec_id = 0)
SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))), 6) AS euclid, round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - c[i]))), 6) AS manhattan,
list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (CASE WHEN v[i] > 0.05 THEN 1 WHEN v[i] < -0.05 THEN -1 ELSE 0 END) <> (CASE WHEN c[i] > 0.05 THEN 1 WHEN c[i] < -0.05 THEN -1 ELSE 0 END) THEN 1 ELSE 0 END))::INTEGER AS trinary FROM e, c""")
def vector_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    x = e.join(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("c"))))
    v, c = F.col("v"), F.col("c")
    return x.select("vec_id", F.round(pr.euclidean(v, c), 6).alias("euclid"), F.round(pr.manhattan(v, c), 6).alias("manhattan"), pr.trinary_hamming(v, c, 0.05).alias("trinary"))


def _first_vectors(spark, d, n):
    rows = table(spark, d, "embeddings").where(F.col("vec_id") < n).orderBy("vec_id").select("embedding").collect()
    return [[float(v) for v in r["embedding"]] for r in rows]


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), c AS (SELECT vec_id AS k, v AS c FROM e WHERE vec_id < 5),
d AS (SELECT e.vec_id, k, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))) AS d FROM e, c)
SELECT vec_id, arg_min(k, (d, k))::INTEGER AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def cluster_nearest_centroid(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return md.nearest_centroid(e, "v", _first_vectors(spark, d, 5), pr.euclidean).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query()
def cluster_k_means(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return md.k_means(e, "v", _first_vectors(spark, d, 5), pr.euclidean, 5)[0].select("vec_id", "cluster", "distance")


@query("""WITH e AS (SELECT vec_id AS id, (vec_id % 4)::INTEGER AS cluster, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id, a.cluster, b.cluster AS o, avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))) AS d FROM e a, e b GROUP BY ALL),
s AS (SELECT id, cluster, max(d) FILTER (o = cluster) AS a, min(d) FILTER (o <> cluster) AS b FROM p GROUP BY ALL) SELECT id, cluster, round((b - a) / greatest(a, b), 6) AS s FROM s""")
def cluster_silhouette(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).cast("int").alias("cluster"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return md.silhouette(e, "v").withColumn("s", F.round("s", 6))


@query()
def cluster_hierarchical(spark, d):
    """Merges of the matrix's rows (brands): few rows, so the tree is built on the driver."""
    wide = matrix(spark, d).groupBy("row").pivot("col").agg(F.first("value")).orderBy("row").toPandas().fillna(0.0)
    x = wide.drop(columns="row").to_numpy(float)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return spark.createDataFrame(md.agglomerate(dist, "complete"), "a int, b int, height double, size int")


@query()
def factor_nmf(spark, d):
    """Two factors of the brand by year matrix (gene-level, small), by Poisson updates from fixed starts."""
    wide = matrix(spark, d).groupBy("row").pivot("col").agg(F.first("value")).orderBy("row").toPandas().fillna(0.0)
    v = wide.drop(columns="row").to_numpy(float)
    rng = np.random.default_rng(1)
    w, _ = md.factorise(v, rng.random((len(v), 2)) + 0.1, rng.random((2, v.shape[1])) + 0.1, 50, "poisson")
    return spark.createDataFrame(pd.DataFrame({"row": wide["row"], "w1": w[:, 0], "w2": w[:, 1]}))


@query(f"""WITH {MATRIX}, p AS (SELECT unnest([0, 1, 2]) AS perm), l AS (SELECT 0 AS perm, '1998' AS s UNION ALL SELECT 0, '1999' UNION ALL SELECT 1, '1995' UNION ALL SELECT 1, '1996' UNION ALL SELECT 2, '1998' UNION ALL SELECT 2, '1997'),
x AS (SELECT p.perm, "row" AS gene, value, l.s IS NOT NULL AS i FROM m CROSS JOIN p LEFT JOIN l ON l.perm = p.perm AND l.s = col) SELECT perm, gene, round(avg(value) FILTER (i) - avg(value) FILTER (NOT i), 6) AS diff FROM x GROUP BY ALL""")
def permutation_differences(spark, d):
    labels = spark.createDataFrame([(0, "1998"), (0, "1999"), (1, "1995"), (1, "1996"), (2, "1998"), (2, "1997")], "perm int, sample string")
    x = matrix(spark, d).select(F.col("row").alias("gene"), F.col("col").alias("sample"), "value")
    return md.permutation_differences(x, labels).withColumn("diff", F.round("diff", 6))


@query(f"""WITH {MATRIX}, c AS (SELECT DISTINCT col FROM m), l AS (SELECT a.col AS x, b.col AS y FROM c a, c b WHERE a.col < b.col),
q AS (SELECT x, y, "row" AS gene, avg(value) FILTER (col IN (x, y)) - avg(value) FILTER (col NOT IN (x, y)) AS diff FROM m, l GROUP BY ALL),
e AS (SELECT max(diff) AS hi, min(diff) AS lo FROM q GROUP BY x, y), o AS (SELECT gene, diff FROM q WHERE x = '1995' AND y = '1996')
SELECT gene, round(diff, 6) AS diff, round(avg(CASE WHEN diff >= 0 THEN (hi >= diff)::INTEGER ELSE (lo <= diff)::INTEGER END), 6) AS p FROM o, e GROUP BY gene, diff""")
def permutation_family_wise(spark, d):
    x = matrix(spark, d).select(F.col("row").alias("gene"), F.col("col").alias("sample"), "value")
    cols = [r["sample"] for r in x.select("sample").distinct().orderBy("sample").collect()]
    perms = md.permuted_labels(cols, 2, 1000, seed=1)
    labels = spark.createDataFrame([(k, s) for k, names in perms for s in names], "perm int, sample string")
    q = md.permutation_differences(x, labels)
    k = next(k for k, names in perms if names == ["1995", "1996"])
    return md.family_wise(q.where(F.col("perm") == k).select("gene", "diff"), q).select("gene", F.round("diff", 6).alias("diff"), F.round("p", 6).alias("p"))


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5('9|' || c_custkey), c_custkey LIMIT 40")
def sample_without_replacement(spark, d):
    return md.deterministic_sample(table(spark, d, "customer"), 40, 9, "c_custkey").select("c_custkey", "c_mktsegment")


@query()
def hmm_viterbi(spark, d):
    """States of each user's events in order of time, two states over five kinds of event."""
    x = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.length("event_type") % 5).alias("o")))), lambda e: e["o"]).alias("o"))
    return md.decode_states(x, "o", [0.9, 0.1], [[0.95, 0.05], [0.1, 0.9]], [[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]]).select("user_id", F.array_join("states", "").alias("states"))


@query()
def align_local(spark, d):
    """Each whole text against itself from its 30th character on."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"), F.expr("substring(text, 30)").alias("b"))
    return md.align(b, "a", "b").select("item_id", "alignment_score")


@query()
def smooth_loess(spark, d):
    x = matrix(spark, d).select("row", F.col("col").cast("double").alias("x"), "value")
    return md.loess(x, "row", "x", "value", 0.6)


@query("""WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
s AS (SELECT user_id, i, j, list_sum(list_transform(v[i : j], lambda x: x - 50)) AS t FROM a, unnest(range(1, len(v) + 1)) AS x(i), unnest(range(1, len(v) + 1)) AS y(j) WHERE j >= i)
SELECT user_id, round(greatest(max(t), 0), 4) AS total FROM s GROUP BY user_id""")
def window_best_stretch(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("v"))
    return x.select("user_id", md.best_stretch(F.col("v"), 50.0).alias("b")).select("user_id", F.round("b.total", 4).alias("total"))


@query(f"WITH {GENES} SELECT chr, s AS a_start, e AS a_end, next_s AS b_start, count(*) AS n FROM ex WHERE next_s IS NOT NULL GROUP BY ALL")
def graph_splice_edges(spark, d):
    return md.splice_graph(genes(spark, d))[1].groupBy("chr", "a_start", "a_end", "b_start").agg(F.sum("n").alias("n"))


@query(f"""WITH {GENES}, g AS (SELECT chr, s, e, next_s, lead(e) OVER (PARTITION BY name ORDER BY s, e) AS next_e FROM ex), x AS (SELECT chr, s, e, next_s, next_e, count(*) AS n FROM g WHERE next_s IS NOT NULL GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY chr, s, e) AS f FROM x)
SELECT chr, s AS a_start, e AS a_end, next_s AS b_start, next_e AS b_end, n FROM f WHERE f >= 0.6""")
def graph_frequent_edges(spark, d):
    return md.frequent_edges(md.splice_graph(genes(spark, d))[1], 0.6)


_EDGES = "e AS (SELECT o_custkey AS a, 1000000 + o_orderkey // 40 AS b FROM orders)"


@query(f"""WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS o FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.o = u.a) SELECT id, min(o) AS comp FROM r GROUP BY id""")
def graph_components(spark, d):
    o = table(spark, d, "orders")
    return md.connected(o.select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_orderkey") / 40) + 1000000).cast("long").alias("b")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem), p AS (SELECT a, b, 1 AS hops FROM e UNION SELECT p.a, e.b, p.hops + 1 FROM p JOIN e ON p.b = e.a WHERE p.hops < 3) SELECT a, b, min(hops) AS hops FROM p GROUP BY ALL""")
def graph_reach(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"))
    return md.reach(e, 3)
