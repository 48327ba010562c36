"""URL features know every labelled suffix and every character."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import url_filter


def test_every_suffix_has_its_share(spark):
    rows = [(f"https://d{k}.net/{j}", f"d{k}.net", f"/{j}", int(k % 2 == 0)) for k in range(700) for j in range(1 + k % 6)]
    df = spark.createDataFrame(rows, "url string, host string, path string, blocked int")
    model = url_filter.train(df, trees=1, depth=1)
    got = {r["host"]: r["f_suffix_share"] for r in url_filter.features(df, model.shares, model.base).collect()}
    base = sum(r[3] for r in rows) / len(rows)
    for k in range(700):
        n = 1 + k % 6
        assert got[f"d{k}.net"] == pytest.approx((n * (k % 2 == 0) + 5 * base) / (n + 5))


def test_entropy_is_over_characters(spark):
    urls = ["0123", "0000", "a-_.b", "", "é漢𝔘é", "https://x.com/a?b=1&c=2#%"]
    df = spark.createDataFrame([(u, "", "") for u in urls], "url string, host string, path string")
    for r in df.withColumn("e", url_filter.lexical()["entropy"]).collect():
        n = len(r["url"])
        assert r["e"] == pytest.approx(sum(-v / n * math.log2(v / n) for v in Counter(r["url"]).values()))
