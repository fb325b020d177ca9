"""Queries on call graphs, patterns and graph stores whose tables are made from rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators import fixpoint, patterns, policy, reactive, rls, store
from vigilake.plans.registry import query
from vigilake.session import spread, table


def numbered(spark, sf, edges: list[tuple], names: list[str], name: str = "nation", key: str = "n_nationkey", step: int = 100) -> DataFrame:
    """A copy of small edges for each row of a table, its node numbers moved by the key; a tuple's last value is the variant (None: every one)."""
    k = F.col(key) * step
    parts = None
    for e in edges:
        one = table(spark, sf, name).where(F.lit(True) if e[-1] is None else F.col(key) % 3 == e[-1]).select(*((k + v).alias(n) for n, v in zip(names, e)))
        parts = one if parts is None else parts.unionAll(one)
    return parts


#: main 0-9 calls f (10 to 19) at 1 and at 5; f calls g (20 to 29) at 12. Variant 1: g does not pass on. Variant 2: the source is in g.
FLOW = [(0, 1, None), (2, 3, None), (4, 5, None), (6, 7, None), (10, 12, None), (13, 19, None), (20, 21, None), (21, 29, 0), (21, 29, 2)]
CALLS = [(1, 10, 19, 2, None), (5, 10, 19, 6, None), (12, 20, 29, 13, None)]


def _graph(spark, sf):
    return numbered(spark, sf, FLOW, ["src", "dst"]), numbered(spark, sf, CALLS, ["site", "entry", "exit", "after"])


@query("ifds_calls", "SELECT n_nationkey * 100 + s AS source, n_nationkey * 100 + t AS sink FROM nation JOIN (VALUES (0, 0, 3), (0, 0, 21), (1, 0, 21), (2, 21, 3), (2, 21, 7), (2, 21, 21)) v(m, s, t) ON n_nationkey % 3 = m")
def ifds_calls(spark, sf):
    """From 0 a fact comes out of f at 3, never at 7; without a path through g it gets down to 21 only; from g it comes out at both."""
    flow, calls = _graph(spark, sf)
    sources = numbered(spark, sf, [(0, 0), (0, 1), (21, 2)], ["node"])
    return fixpoint.ifds(sources, flow, calls, numbered(spark, sf, [(3, None), (7, None), (21, None)], ["node"]))


@query("ifds_summaries", "SELECT n_nationkey * 100 + s AS src, n_nationkey * 100 + t AS dst FROM nation JOIN (VALUES (1, 2), (5, 6), (12, 13)) v(s, t) ON n_nationkey % 3 <> 1")
def ifds_summaries(spark, sf):
    return fixpoint.summaries(*_graph(spark, sf))


@query("ifds_statistics", "SELECT count(*) FILTER (n_nationkey % 3 <> 1) * 3 AS summaries, count(*) * 7 + count(*) FILTER (n_nationkey % 3 <> 1) AS edges, count(*) * 2 AS procedures FROM nation")
def ifds_statistics(spark, sf):
    return fixpoint.statistics(*_graph(spark, sf))


@query("call_linking", "SELECT c_custkey * 10 AS site, n_nationkey * 100 AS entry, n_nationkey * 100 + 9 AS exit, c_custkey * 10 + 1 AS after FROM customer JOIN nation ON c_nationkey = n_nationkey")
def call_linking(spark, sf):
    sites = table(spark, sf, "customer").select((F.col("c_custkey") * 10).alias("site"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("symbol"), (F.col("c_custkey") * 10 + 1).alias("after"))
    procs = table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("symbol"), (F.col("n_nationkey") * 100).alias("entry"), (F.col("n_nationkey") * 100 + 9).alias("exit"))
    return fixpoint.link_calls(sites, procs)


@query("outside_parameters", "SELECT c_custkey AS node FROM customer WHERE c_custkey % 4 IN (0, 2)")
def outside_parameters(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("Payload", "count", "userInput_", "i"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    names = F.when(F.col("c_custkey") % 4 == 2, F.lit("URL")).otherwise(names)
    return fixpoint.outside_parameters(table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), names.alias("name"))).select("node")


@query("def_use", "SELECT o_custkey AS proc, o_orderkey AS def, o_orderkey + 1 AS use FROM orders WHERE o_orderkey % 2 = 0")
def def_use(spark, sf):
    o = table(spark, sf, "orders")
    defs = o.select(F.col("o_custkey").alias("proc"), (F.col("o_orderkey") + 1).alias("node"), F.col("o_orderkey").alias("def"), F.lit("v").alias("var"))
    uses = o.select(F.col("o_custkey").alias("proc"), (F.col("o_orderkey") + 1).alias("node"), F.when(F.col("o_orderkey") % 2 == 0, "v").otherwise("w").alias("var"))
    return fixpoint.def_use(defs, uses)


def code_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Calls of db.query, one for each part: receiver in slot 0, arguments in slots 2 and 3, by key."""
    p = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k")
    node = lambda n, kind, symbol: p.select((F.col("k") * 10 + n).alias("id"), F.lit(kind).alias("kind"), symbol.alias("symbol"), F.concat(F.lit("f"), (F.col("k") % 7).cast("string")).alias("file"), F.col("k").alias("proc"))
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("k") % len(texts) + 1).cast("int"))
    nodes = node(0, "MethodCall", pick("db.query", "db.query", "db.close")).unionAll(node(1, "Identifier", F.lit("db"))).unionAll(node(2, "Identifier", pick("sql", "x"))).unionAll(node(3, "Identifier", pick("sql", "y", "x", "x", "sql")))
    edge = lambda slot, to: p.select((F.col("k") * 10).alias("src"), (F.col("k") * 10 + to).alias("dst"), F.lit(slot).alias("slot"), F.lit("AST").alias("tag"), F.concat(F.lit("f"), (F.col("k") % 7).cast("string")).alias("file"))
    return nodes, edge(0, 1).unionAll(edge(2, 2)).unionAll(edge(3, 3))


@query("pattern_scan", "SELECT p_partkey * 10 AS id, 'f' || (p_partkey % 7) AS file FROM part WHERE p_partkey % 3 < 2")
def pattern_scan(spark, sf):
    return patterns.scan(*code_graph(spark, sf), ["$D.query(...)"])


@query("pattern_bindings", "SELECT p_partkey * 10 AS id, 'db' AS d, CASE p_partkey % 2 WHEN 0 THEN 'sql' ELSE 'x' END AS a FROM part WHERE p_partkey % 3 < 2 AND (CASE p_partkey % 2 WHEN 0 THEN 'sql' ELSE 'x' END) = ['sql', 'y', 'x', 'x', 'sql'][p_partkey % 5 + 1]")
def pattern_bindings(spark, sf):
    """A name that stands twice must be bound to one text."""
    got = patterns.match(*code_graph(spark, sf), patterns.compile_pattern("$D.query($A, $A)"))
    return got.select("id", F.element_at("bound", "D").alias("d"), F.element_at("bound", "A").alias("a"))


@query("pattern_not", "SELECT p_partkey * 10 AS id, 'f' || (p_partkey % 7) AS file FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 2 = 1")
def pattern_not(spark, sf):
    return patterns.scan(*code_graph(spark, sf), ["db.query(...)"], ["db.query(sql, ...)"])


@query("subtypes", "SELECT p_partkey, p_partkey % 4 < 3 AS sub FROM part")
def subtypes(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Stream<int>?").when(k == 1, "Mine").when(k == 2, "Other<Stream>").otherwise("Plain")
    supers = F.when(k == 1, F.array(F.lit("Object"), F.lit("Stream<T>"))).when(k == 2, F.array(F.lit("Stream"))).when(k == 3, F.array(F.lit("StreamX")))
    return table(spark, sf, "part").select("p_partkey", patterns.is_subtype(name, supers, "Stream").alias("sub"))


@query("tombstones", "SELECT 'node' AS what, count(*) AS n FROM part WHERE p_partkey % 7 <> 3 UNION ALL SELECT 'edge', count(*) * 3 FROM part WHERE p_partkey % 7 NOT IN (2, 3) UNION ALL SELECT 'edge2', count(*) * 3 FROM part WHERE p_partkey % 7 = 2 UNION ALL SELECT 'proc', count(*) FROM part WHERE p_partkey % 7 = 2 AND p_partkey + 1 IN (SELECT p_partkey FROM part)")
def tombstones(spark, sf):
    """Each call also calls the next part's call; the parts of one file go."""
    nodes, edges = code_graph(spark, sf)
    calls = nodes.where("kind = 'MethodCall'").select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"), F.lit(9).alias("slot"), F.lit("Call").alias("tag"), "file")
    left, kept, procs = store.without(nodes, edges.unionByName(calls), spark.createDataFrame([("f3",)], "file string"))
    count = lambda name, rows: rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    own = kept.where("tag = 'AST'")
    return count("node", left.where("kind = 'MethodCall'")).unionAll(count("edge", own.where("file not in ('f2')"))).unionAll(count("edge2", own.where("file = 'f2'"))).unionAll(count("proc", procs.where("proc % 7 = 2")))


@query("graph_dump", "SELECT 'node ' || (p_partkey * 10) || ' MethodCall ' || ['db.query', 'db.query', 'db.close'][p_partkey % 3 + 1] AS value FROM part UNION ALL SELECT 'ast ' || (p_partkey * 10) || ' -> ' || (p_partkey * 10 + 1) FROM part")
def graph_dump(spark, sf):
    nodes, edges = code_graph(spark, sf)
    return store.dump(nodes.where("kind = 'MethodCall'"), edges.where("slot = 0"))


KINDS = "CASE event_type WHEN 'signup' THEN 'emit' WHEN 'error' THEN 'listen' WHEN 'purchase' THEN 'build' ELSE 'other' END"


@query("reactive_edges", f"""WITH e AS (SELECT DISTINCT user_id % 50 AS node, {KINDS} AS kind, user_id % 7 AS channel FROM events), w AS (SELECT node, channel FROM e WHERE kind = 'emit'), r AS (SELECT node, channel FROM e WHERE kind = 'listen'), b AS (SELECT node, channel FROM e WHERE kind = 'build')
SELECT w.node AS src, r.node AS dst, w.channel AS channel, 'ReactiveFlow' AS tag FROM w JOIN r USING (channel) UNION ALL SELECT w.node, b.node, w.channel, 'RebuildTrigger' FROM w JOIN b USING (channel)
UNION ALL SELECT node, node, channel, 'ReactiveWrite' FROM w UNION ALL SELECT node, node, channel, 'ReactiveRead' FROM r""")
def reactive_edges(spark, sf):
    t = F.col("event_type")
    method = F.when(t == "signup", "emit").when(t == "error", "listen").otherwise("other")
    return reactive.edges(table(spark, sf, "events").select((F.col("user_id") % 50).alias("node"), (F.col("user_id") % 7).alias("channel"), method.alias("method"), (t == "purchase").alias("builds")))


@query("watched_providers", "SELECT n_nationkey AS proc, 'p' || v AS provider FROM nation JOIN (VALUES (0, 3), (0, 5), (1, 3), (2, 3), (2, 5)) t(m, v) ON n_nationkey % 3 = m")
def watched_providers(spark, sf):
    """Node 3 watches p3 and 5 watches p5; in variant 1 the branch to 5 is missing."""
    entries = table(spark, sf, "nation").select(F.col("n_nationkey").alias("proc"), (F.col("n_nationkey") * 100).alias("node"))
    flow = numbered(spark, sf, [(0, 1, None), (1, 3, None), (3, 1, None), (1, 5, 0), (1, 5, 2), (6, 7, None)], ["src", "dst"])
    watches = numbered(spark, sf, [(3, 3, None), (5, 5, None), (7, 7, None)], ["node", "p"]).withColumn("provider", F.concat(F.lit("p"), (F.col("p") % 100).cast("string"))).select("node", "provider")
    return reactive.watched(entries, flow, watches)


@query("correlate", "SELECT s_suppkey AS client, CASE WHEN s_suppkey % 12 = 0 THEN 'unsafe' WHEN s_suppkey % 3 = 2 OR s_suppkey % 2 = 1 THEN 'violated' ELSE 'safe' END AS verdict FROM supplier")
def correlate(spark, sf):
    """Tables 0 and 1 let owners in, table 2 has no policy; clients with odd keys ask for all rows."""
    k = F.col("s_suppkey")
    clients = table(spark, sf, "supplier").select(k.alias("client"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("table"), F.when(k % 2 == 0, "own").otherwise("all").alias("asks"), (k % 4 == 0).alias("service_role"), (k % 12 == 0).alias("tainted"))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("t"), (F.col("n_nationkey") % 3).cast("string")).alias("table"), (F.col("n_nationkey") % 4).alias("owner"))
    own = {"op": "uid_eq", "column": "owner"}
    return policy.correlate(clients, rows, {"t0": own, "t1": own}, 4)


@query("behind_functions", "SELECT 'c' || c_custkey AS path, 'T' || c_nationkey AS table_name, CASE WHEN c_nationkey % 2 = 0 THEN 'a' || c_nationkey END AS fn FROM customer")
def behind_functions(spark, sf):
    accesses = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("table"))
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("n"))
    functions = n.select(F.concat(F.lit("b"), "n").alias("fn"), F.concat(F.lit("t"), "n").alias("table"), F.lit("z.ts").alias("path")).unionAll(n.select(F.concat(F.lit("a"), "n").alias("fn"), F.concat(F.lit("T"), "n").alias("table"), F.lit("y.ts").alias("path")))
    return rls.behind_functions(accesses, functions).select("path", F.col("table").alias("table_name"), "fn")
