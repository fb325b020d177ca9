"""Sessions, table access and lineage cuts of the analytics engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "vigilake", **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC and adaptive execution."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the cluster by their key. A small file, or one whose rows are in one group, is read by one task whatever the
    cluster's size; this goes before work that costs far more than moving a row's key."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 32), key)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that the cluster shares and read it back, so that its lineage is one scan."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vigilake-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
