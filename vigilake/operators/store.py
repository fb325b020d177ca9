"""Graph tables in a folder, by file, so that a changed file replaces its own rows alone.

nodes(id, kind, symbol, file, proc) and edges(src, dst, slot, tag, file) lie in partitions of a hash of the file. A tombstone takes
a file's nodes and all edges at them away and names the procedures that lose something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(PARTS)).cast("int"))


def save(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, rows in (("nodes", nodes), ("edges", edges)):
        _dealt(rows).repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges; of one file only its partition is read."""
    out = []
    for name in ("nodes", "edges"):
        rows = spark.read.parquet(f"{folder}/{name}")
        if file is not None:
            part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(file)), F.lit(PARTS)).cast("int")).first()[0]
            rows = rows.where((F.col("part") == part) & (F.col("file") == file))
        out.append(rows.drop("part"))
    return out[0], out[1]


def without(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges without files(file), and the procedures (proc) of other files that had an edge to one of their nodes."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id")
    left = nodes.join(files.select("file").distinct(), "file", "left_anti")
    cut_off = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).unionAll(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")))
    procs = left.join(cut_off.distinct(), "id", "left_semi").select("proc").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept, procs


def replace(spark: SparkSession, folder: str, nodes: DataFrame, edges: DataFrame, scratch: str) -> None:
    """Put the rows of some files in place of their old ones: the partitions they lie in are written anew, the others stay."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        new = _dealt(rows)
        files, parts = new.select("file").distinct(), [r.part for r in new.select("part").distinct().collect()]
        old = spark.read.parquet(f"{folder}/{name}").where(F.col("part").isin(*parts)).join(files, "file", "left_anti")
        # what is read must not be overwritten while it is read
        old.select(*new.columns).unionByName(new).write.mode("overwrite").parquet(f"{scratch}/{name}")
        spark.read.parquet(f"{scratch}/{name}").repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a text dump: nodes, then edges by tag."""
    a = nodes.select(F.lit(0).alias("o"), F.format_string("node %d %s %s", "id", "kind", F.coalesce("symbol", F.lit(""))).alias("value"))
    b = edges.select(F.lit(1).alias("o"), F.format_string("%s %d -> %d", F.lower("tag"), "src", "dst").alias("value"))
    return a.unionAll(b).orderBy("o", "value").select("value")
