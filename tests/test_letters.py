"""Upper case letter by letter, as DuckDB's upper gives it."""

import duckdb
from pyspark.sql import functions as F

from loomspan.functions import sequence as sq

TEXTS = ["er\xdfau", "\ufb01ne", "\u1f80\u1f88\u1fb3b", "\u01f0x\u0149", "na\xefve more", "abc", "", "\U00010428\U0001f600ok", "\xff\xb5\u0131i", None]


def test_one_letter_stays_one(spark):
    got = [r["u"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").orderBy("k").select(sq.upper_prefix(F.col("t"), 5).alias("u")).collect()]
    assert got == [duckdb.execute("select upper(left(?::VARCHAR, 5))", [t]).fetchall()[0][0] for t in TEXTS]
