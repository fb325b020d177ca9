"""Reactive edges: what writes to a channel, what reads it, and what is rebuilt by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.fixpoint import reach

WRITES, READS = ("add", "addError", "addStream", "emit", "notifyListeners", "state="), ("listen", "of", "read", "watch")


def edges(nodes: DataFrame) -> DataFrame:
    """src, dst, channel, tag of nodes(node, channel, method, builds): flows from writers to readers, triggers from writers to build
    methods, and a loop at every writer and reader."""
    w = nodes.where(F.col("method").isin(*WRITES)).select(F.col("node").alias("src"), "channel").distinct()
    r = nodes.where(F.col("method").isin(*READS)).select(F.col("node").alias("dst"), "channel").distinct()
    b = nodes.where("builds").select(F.col("node").alias("dst"), "channel").distinct()
    tagged = lambda rows, tag: rows.select("src", "dst", "channel", F.lit(tag).alias("tag"))
    loops = tagged(w.withColumn("dst", F.col("src")), "ReactiveWrite").unionAll(tagged(r.withColumn("src", F.col("dst")), "ReactiveRead"))
    return tagged(w.join(r, "channel"), "ReactiveFlow").unionAll(tagged(w.join(b, "channel"), "RebuildTrigger")).unionAll(loops)


def watched(entries: DataFrame, flow: DataFrame, watches: DataFrame) -> DataFrame:
    """proc, provider that a procedure watches on some path: entries(proc, node), flow(src, dst), watches(node, provider)."""
    return reach(entries.select("proc", "node"), flow, ["proc"]).join(watches, "node").select("proc", "provider").distinct()
