"""Queries over the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as X
from vigilake.operators import fixpoint
from vigilake.plans import fact_queries, finding_queries, graph_queries, rule_queries  # noqa: F401
from vigilake.plans.registry import ORACLES, QUERIES, query
from vigilake.session import cut, spread, table

__all__ = ["ORACLES", "QUERIES"]


# lines and scalar functions

@query("lines_explode", "SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def lines_explode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


@query("public_ip", """SELECT doc_id, ip FROM (SELECT doc_id, ip, list_transform(string_split(ip, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS o FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS ip FROM documents))
WHERE list_bool_and(list_transform(o, lambda x: x BETWEEN 0 AND 255)) AND o[1] NOT IN (0, 10, 127) AND o[1] < 224
 AND NOT (o[1] = 169 AND o[2] = 254) AND NOT (o[1] = 172 AND o[2] BETWEEN 16 AND 31) AND NOT (o[1] = 192 AND o[2] = 168) AND NOT (o[1] = 100 AND o[2] BETWEEN 64 AND 127)
 AND NOT (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) AND NOT (o[1] = 198 AND o[2] IN (18, 19)) AND NOT (o[1] = 198 AND o[2] = 51 AND o[3] = 100) AND NOT (o[1] = 203 AND o[2] = 0 AND o[3] = 113)""")
def public_ip(spark, sf):
    ips = table(spark, sf, "documents").where(F.col("text").rlike(r"[0-9]\.[0-9]")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0)).alias("ip"))
    return ips.where(X.public_ipv4(F.col("ip")))


@query("entropy_top", """SELECT word, round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT word, c, count(*) / length(word) AS p FROM (
  SELECT word, unnest(string_split(word, '')) AS c FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{20,200}')) AS word FROM documents)) GROUP BY word, c) GROUP BY word ORDER BY entropy DESC, word LIMIT 50""")
def entropy_top(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,200}"), 0)).alias("word")).distinct()
    return words.select("word", F.round(X.entropy(F.col("word")), 9).alias("entropy")).orderBy(F.desc("entropy"), "word").limit(50)


@query("byte_sizes", "SELECT p_partkey, p_size::BIGINT * CASE p_size % 4 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 ELSE 1 END AS n_bytes FROM part")
def byte_sizes(spark, sf):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" B"), F.lit("kb"), F.lit("MB"), F.lit(" g")), F.col("p_size") % 4 + 1))
    return table(spark, sf, "part").select("p_partkey", X.byte_size(text).alias("n_bytes"))


@query("context_window", "SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 4 FOLLOWING) AS context FROM conversations")
def context_window(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-8, 4)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "\n").alias("context"))


# joins


@query("nearest_element", "SELECT s_suppkey, arg_min(c_custkey, (abs(c_acctbal - s_acctbal), c_custkey)) AS nearest FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey")
def nearest_element(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    left = s.select("s_suppkey", F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("at"))
    return nearest(left, c.select("c_custkey", F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("at")), "s_suppkey", "c_custkey").select("s_suppkey", "nearest")


def nearest(left: DataFrame, right: DataFrame, lk: str, rk: str) -> DataFrame:
    """lk, nearest: of the rows of right in one's group, the key rk with the least (absolute difference of at, key); groups without one give none.

    Rows of a group are sorted by at, so the nearest are the last before a row and the first after it. Only where a neighbour's own
    neighbour is as far (differences are rounded), or at is no finite number, a row is compared with its whole group.
    """
    gap = lambda c: F.abs(F.col(c) - F.col("at"))
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    rows = left.where(F.col("grp").isNotNull()).select(lk, "grp", "at")
    places = right.where(F.col("grp").isNotNull() & finite("at")).groupBy("grp", "at").agg(F.min(rk).alias("key"))
    up, down = (Window.partitionBy("grp").orderBy(o, "mine") for o in (F.asc("at"), F.desc("at")))
    order = Window.partitionBy("grp").orderBy("at")
    places = places.select("grp", "at", F.struct(F.col("at").alias("p"), "key", F.lag("at").over(order).alias("under"), F.lead("at").over(order).alias("over")).alias("place"))
    both = places.withColumn("mine", F.lit(0)).unionByName(rows.where(finite("at")).withColumn("mine", F.lit(1)), allowMissingColumns=True)
    for name, w in (("lo", up), ("hi", down)):
        both = both.withColumn(name, F.last("place", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.least(*(F.when(F.col(n).isNotNull(), F.struct(gap(f"{n}.p").alias("gap"), F.col(f"{n}.key").alias("key"))) for n in ("lo", "hi")))
    far = F.coalesce(gap("lo.under") == gap("lo.p"), F.lit(False)) | F.coalesce(gap("hi.over") == gap("hi.p"), F.lit(False))
    seen = cut(both.where("mine = 1").select(lk, "grp", "at", best.alias("best"), far.alias("far")))
    whole = seen.where("far or best is null").select(lk, "grp", "at").unionAll(rows.where(~finite("at")))
    pairs = whole.join(right.select("grp", F.col("at").alias("p"), F.col(rk).alias("key")), "grp")
    pairs = pairs.select(lk, F.struct(gap("p").isNull().alias("none"), gap("p").alias("gap"), "key").alias("best"))
    near = seen.where("not far and best is not null").select(lk, F.struct(F.lit(False).alias("none"), F.col("best.gap").alias("gap"), F.col("best.key").alias("key")).alias("best"))
    return near.unionAll(pairs).groupBy(lk).agg(F.min("best").alias("best")).select(lk, F.col("best.key").alias("nearest"))


# graphs: customers, orders, parts and suppliers as typed edges

EDGES_SQL = """edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_partkey % 10 = 0
  UNION SELECT DISTINCT 's' || l_suppkey, 'p' || (l_partkey + 10) FROM lineitem WHERE l_partkey % 50 = 0)"""


def edges(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    p, s = lambda c: F.concat(F.lit("p"), c.cast("string")), lambda c: F.concat(F.lit("s"), c.cast("string"))
    a = l.where("l_partkey % 10 = 0").select(p(F.col("l_partkey")).alias("src"), s(F.col("l_suppkey")).alias("dst"))
    b = l.where("l_partkey % 50 = 0").select(s(F.col("l_suppkey")).alias("src"), p(F.col("l_partkey") + 10).alias("dst"))
    return cut(a.unionAll(b).distinct())


@query("graph_reachability", f"WITH RECURSIVE {EDGES_SQL}, r(node) AS (SELECT 'p10' UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r")
def graph_reachability(spark, sf):
    return fixpoint.reach(spark.createDataFrame([("p10",)], "node string"), edges(spark, sf))


@query("affected_set", f"WITH RECURSIVE {EDGES_SQL}, bi AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(node) AS (SELECT 'p50' UNION SELECT dst FROM r JOIN bi ON src = node) SELECT node FROM r")
def affected_set(spark, sf):
    e = edges(spark, sf)
    return fixpoint.reach(spark.createDataFrame([("p50",)], "node string"), e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query("ifds_intra", f"""WITH RECURSIVE {EDGES_SQL}, f(source, node) AS (SELECT s, s FROM (VALUES ('p10'), ('p500')) v(s) UNION SELECT source, dst FROM f JOIN edges ON src = node WHERE NOT (node LIKE 's%' AND CAST(substr(node, 2) AS BIGINT) % 3 = 0))
SELECT source, node AS sink FROM f WHERE node LIKE 'p%' AND CAST(substr(node, 2) AS BIGINT) % 100 = 60""")
def ifds_intra(spark, sf):
    e = edges(spark, sf)
    nodes = e.select(F.col("src").alias("node")).unionAll(e.select(F.col("dst").alias("node"))).distinct()
    number = F.substring("node", 2, 20).try_cast("long")
    clean = nodes.where(F.col("node").startswith("s") & (number % 3 == 0))
    sinks = nodes.where(F.col("node").startswith("p") & (number % 100 == 60))
    return fixpoint.taint(spark.createDataFrame([("p10",), ("p500",)], "node string"), e, clean, sinks)


FLOW_SQL = """turns AS (SELECT conv_id AS proc, turn AS node, role AS var FROM conversations), flow AS (SELECT DISTINCT a.proc AS proc, a.node AS src, b.node AS dst FROM turns a JOIN turns b ON a.proc = b.proc AND (b.node = a.node + 1 OR (b.node = a.node + 3 AND a.node % 2 = 0)))"""


@query("reaching_definitions", f"""WITH RECURSIVE {FLOW_SQL}, r(proc, pos, def, var) AS (SELECT proc, node, node, var FROM turns UNION
  SELECT r.proc, f.dst, r.def, r.var FROM r JOIN flow f ON f.proc = r.proc AND f.src = r.pos WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.proc = r.proc AND t.node = f.dst AND t.var = r.var))
SELECT DISTINCT r.proc AS proc, f.dst AS node, r.def AS def, r.var AS var FROM r JOIN flow f ON f.proc = r.proc AND f.src = r.pos""")
def reaching_definitions(spark, sf):
    turns = cut(table(spark, sf, "conversations").select(F.col("conv_id").alias("proc"), F.col("turn").alias("node"), F.col("role").alias("var")).distinct())
    step = turns.select("proc", F.col("node").alias("src"), F.explode(F.when(F.col("node") % 2 == 0, F.array(F.col("node") + 1, F.col("node") + 3)).otherwise(F.array(F.col("node") + 1))).alias("dst"))
    flow = cut(step.join(turns.select("proc", F.col("node").alias("dst")), ["proc", "dst"], "left_semi").distinct())
    return fixpoint.reaching_definitions(turns, flow)


# lexical and policy extraction over scripts that are written from the tables' rows

def _script(df: DataFrame, path, content) -> DataFrame:
    return df.select(path.alias("path"), content.alias("content"))


@query("ddl_policies", """SELECT 'c' || c_custkey AS path, 'p' || c_custkey AS name, lower(c_mktsegment) AS "table", CASE WHEN c_custkey % 3 = 0 THEN 'all' ELSE 'select' END AS operation,
 '{"op": "and", "args": [{"op": "uid_eq", "column": "user_id"}, {"op": "=", "column": "nation", "value": "' || c_nationkey || '"}]}' AS using_json FROM customer""")
def ddl_policies(spark, sf):
    from vigilake.sources import ddl

    c = spread(table(spark, sf, "customer"), "c_custkey")
    op = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(" for select")
    text = F.format_string("-- policy\ncreate policy p%d on %s%s using (auth.uid() = user_id and nation = '%d');", "c_custkey", "c_mktsegment", op, "c_nationkey")
    return ddl.policies(_script(c, F.concat(F.lit("c"), F.col("c_custkey").cast("string")), text)).select("path", "name", "table", "operation", "using_json")


@query("ddl_owner_columns", "SELECT 't' || s_suppkey AS path, 't' || s_suppkey AS \"table\", CASE s_nationkey % 3 WHEN 0 THEN 'user_id' WHEN 1 THEN 'boss' END AS \"column\" FROM supplier WHERE s_nationkey % 3 < 2")
def ddl_owner_columns(spark, sf):
    from vigilake.sources import ddl

    s = spread(table(spark, sf, "supplier"), "s_suppkey")
    column = F.when(F.col("s_nationkey") % 3 == 0, "user_id uuid").when(F.col("s_nationkey") % 3 == 1, "boss bigint references auth.users(id)").otherwise("plain text")
    text = F.format_string("create table t%d (id int, note text default 'user_id uuid', %s);", "s_suppkey", column)
    return ddl.owner_columns(_script(s, F.concat(F.lit("t"), F.col("s_suppkey").cast("string")), text))


@query("call_arguments", "SELECT 'p' || p_partkey AS path, 2 AS line, chr(39) || p_brand || chr(39) || '|f(' || p_size || ', 1)' AS args FROM part WHERE p_partkey % 4 <> 0")
def call_arguments(spark, sf):
    from vigilake.operators import lexer

    p = spread(table(spark, sf, "part"), "p_partkey")
    text = F.format_string("// note\n%sclient.rpc('%s', f(%d, 1));", F.when(F.col("p_partkey") % 4 == 0, "// ").otherwise(""), "p_brand", "p_size")
    return lexer.calls(_script(p, F.concat(F.lit("p"), F.col("p_partkey").cast("string")), text), r"\w+\.rpc").select("path", "line", F.array_join("args", "|").alias("args"))


@query("taint_paths", """SELECT 'o' || o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'sql' ELSE 'command' END AS sink, CASE WHEN o_orderkey % 8 = 5 THEN 'medium' ELSE 'high' END AS confidence FROM orders WHERE o_orderkey % 4 IN (0, 1)""")
def taint_paths(spark, sf):
    from vigilake.operators import taint

    o, k = spread(table(spark, sf, "orders"), "o_orderkey"), F.col("o_orderkey")
    hops = F.when(k % 8 == 5, "let b = a; let c = b; let d = c; let e = d; exec(e);").otherwise("exec(a);")
    text = F.when(k % 4 == 0, "const a = req.query.a;\ndb.query('select ' + a);").when(k % 4 == 1, F.concat(F.lit("let a = req.body.a;\n"), hops)).when(k % 4 == 2, "const a = parseInt(req.query.a);\ndb.query('select ' + a);").otherwise("db.query('select ?', [req.query.a]);")
    return taint.findings(_script(o, F.concat(F.lit("o"), k.cast("string")), text)).select("path", "sink", "confidence")
