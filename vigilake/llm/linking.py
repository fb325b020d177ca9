"""Connected groups over links between ids, with nothing collected on the driver.

Up to LOCAL distinct links are joined in one task, which holds 16 bytes a link and about ten times that while it sorts. More
links go through alternating large-star and small-star rounds. Every round is written to the shared folder, so its
lineage is one scan and a lost executor costs one round at most. Joins on a hub's id are uneven: the links of one hub stream
through one task, sorted on disk. Buckets send few of them, as members that are linked already do not come again. Each round
is several jobs whose plans, code and task records stay on the driver, so few links are not worth any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C


#: Distinct links that one task joins; results do not depend on it.
LOCAL = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ids in links (u, v), and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return ids, ids[root]


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches):
        held = [[np.asarray(b.column(k)).astype(np.int64) for k in range(2)] for b in batches if b.num_rows]
        if not held:
            return
        ids, root = least_reached(*(np.concatenate(x) for x in zip(*held)))
        for i in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], ["id", "root"])

    return e.coalesce(1).mapInArrow(run, "id long, root long")


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in links(a, b); root is the smallest id that it reaches. Null ends are ignored."""
    e = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    e = C.cut(e, C.SMALL)
    state = _state(e)
    if state[0] <= LOCAL:
        roots = C.cut(_in_one_task(e), C.SMALL)
        C.drop(e.sparkSession, e)
        return roots
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(C.grown(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(C.grown(least), "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = C.cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), C.SMALL)
        C.drop(e.sparkSession, e)
        e, before, state = after, state, _state(after)
        if before == state:
            break
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def link_buckets(hits: DataFrame, near: Column) -> DataFrame:
    """Links(a, b) that leave the same groups as all pairs of a bucket that near() accepts would.

    hits has one row for each member of a bucket: bucket, id, f (what pairs are compared by), home (the pair counts
    only if one of its members is at home in the bucket), hub and hub_f (the bucket's smallest member at home). near
    compares f and other_f. Members are compared with their hub first; then pairs are compared exactly where a bucket
    still holds more than one group, so no link between groups is lost, and pairs inside a group are never listed.
    """
    star = hits.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "f", F.col("hub_f").alias("other_f")).where(near)
    links = C.cut(star.select("a", "b").distinct(), "star")
    own = hits.join(C.grown(components(links).withColumnRenamed("id", "gid")), F.col("id") == F.col("gid"), "left").select(
        "bucket", "id", "f", "home", F.coalesce("root", "id").alias("root")
    )
    own = C.cut(own, "grouped")
    mixed = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if("home").alias("n")).where("lo <> hi and n > 1").select("bucket")
    left = C.cut(own.join(C.grown(mixed), "bucket"), "mixed")
    x, y = left.where("home"), left.select("bucket", F.col("id").alias("other"), F.col("f").alias("other_f"), F.col("root").alias("other_root"), F.col("home").alias("other_home"))
    pairs = x.join(C.grown(y), "bucket").where((F.col("root") != F.col("other_root")) & (~F.col("other_home") | (F.col("id") < F.col("other"))) & near)
    return links.unionAll(C.cut(pairs.select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "rest"))


def across(links: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Those of links(a, b, more) whose ends are in different groups(id, root); an id in no group is its own."""
    x = links.join(C.grown(groups.select(F.col("id").alias("a"), F.col("root").alias("ra"))), "a", "left")
    x = x.join(C.grown(groups.select(F.col("id").alias("b"), F.col("root").alias("rb"))), "b", "left")
    return x.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", *more)
