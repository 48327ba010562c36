"""Written intermediate tables, in the shared folder that spark.checkpoint.dir names, or a local one where it is unset under a local master."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def folder(spark) -> str:
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if app not in _own:
        _own[app] = f"{base or 'file://' + tempfile.mkdtemp(prefix='loomspan-')}/plans-{uuid.uuid4().hex[:8]}"
    return _own[app]


def written(df: DataFrame) -> DataFrame:
    """Write and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
