"""Policies as predicates: evaluation over rows and bounded search for counterexamples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"=": "__eq__", "<>": "__ne__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def column(tree: dict | str, user: Column) -> Column:
    """A Column for a predicate tree; what is opaque is false, so a policy never covers more than is known."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    op = tree["op"]
    if op in ("and", "or"):
        out = column(tree["args"][0], user)
        for x in tree["args"][1:]:
            out = out & column(x, user) if op == "and" else out | column(x, user)
        return out
    if op == "not":
        return ~column(tree["args"][0], user)
    if op in ("true", "false"):
        return F.lit(op == "true")
    if op == "uid_eq":
        return F.col(tree["column"]) == user
    if op in COMPARE:
        return getattr(F.col(tree["column"]), COMPARE[op])(F.lit(tree["value"]))
    if op in ("like", "not_like"):
        out = F.col(tree["column"]).like(tree["value"])
        return ~out if op == "not_like" else out
    return F.lit(False)


def counterexamples(rows: DataFrame, client: Column, policy: dict | str, users: int) -> DataFrame:
    """Rows and users (0 to users - 1) that the client asks for and the policy does not allow."""
    tried = rows.withColumn("user", F.explode(F.sequence(F.lit(0), F.lit(users - 1))))
    return tried.where(client & ~F.coalesce(column(policy, F.col("user")), F.lit(False)))


def verdict(service_role: Column, tainted: Column, violated: Column) -> Column:
    """unsafe where outside data meets the service role, else violated where a client's rows are not all allowed, else safe."""
    return F.when(service_role & tainted, "unsafe").when(violated, "violated").otherwise("safe")


def correlate(clients: DataFrame, rows: DataFrame, policies: dict[str, dict | str], users: int) -> DataFrame:
    """client, verdict of clients(client, table, asks, service_role, tainted) whose rows(table, row columns) are asked for where column
    asks is the user: each policy is one predicate, a table without one allows nothing."""
    ok = F.lit(False)
    for name, tree in sorted(policies.items()):
        ok = F.when(F.col("table") == name, F.coalesce(column(tree, F.col("user")), F.lit(False))).otherwise(ok)
    tried = rows.withColumn("user", F.explode(F.sequence(F.lit(0), F.lit(users - 1)))).withColumn("ok", ok)
    bad = tried.groupBy("table").agg(F.bool_or(~F.col("ok")).alias("any_bad"), F.bool_or(~F.col("ok") & (F.col("owner") == F.col("user"))).alias("own_bad"))
    both = clients.join(bad, "table", "left")
    violated = F.when(F.col("asks") == "own", F.coalesce("own_bad", F.lit(False))).otherwise(F.coalesce("any_bad", F.lit(False)))
    return both.select("client", verdict(F.col("service_role"), F.col("tainted"), violated).alias("verdict"))
