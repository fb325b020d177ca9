"""Fact tables, row-level security, dependencies and scalar functions over files that are written from table rows.

Each query gives a row of a table one of a few texts by its key; the SQL knows what is found in each text, so it is independent
of the expressions that find it.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.functions import columns as X
from vigilake.functions import paths
from vigilake.operators import policy, rls
from vigilake.plans.registry import query
from vigilake.session import spread, table
from vigilake.sources import facts


def written(spark, sf, name: str, key: str, path: str, variants: list[str]) -> DataFrame:
    """path, content: a file for each row of a table, its text chosen by the key; {k} stands for the key."""
    k = F.col(key)
    text = F.element_at(F.array(*map(F.lit, variants)), (k % len(variants) + 1).cast("int"))
    fill = lambda c: F.replace(c, F.lit("{k}"), k.cast("string"))
    return spread(table(spark, sf, name).select(key), key).select(fill(F.lit(path)).alias("path"), fill(text).alias("content"))


def known(name: str, key: str, n: int, path: str, columns: list[str], rows: list[tuple]) -> str:
    """SQL of the rows (variant, values...) that are found in a table's files."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    text = {c for c, v in zip(columns, rows[0][1:]) if isinstance(v, str)}
    pick = ", ".join(f"replace(v.{c}, '{{k}}', {key}::VARCHAR) AS {c}" if c in text else f"v.{c} AS {c}" for c in columns)
    values = ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)
    return f"SELECT replace('{path}', '{{k}}', {key}::VARCHAR) AS path, {pick} FROM {name} JOIN (VALUES {values}) v(m, {', '.join(columns)}) ON {key} % {n} = m"


CUSTOMER = ("customer", "c_custkey")
PART = ("part", "p_partkey")
APP = "lib/a{k}.dart"

ACCESSES = ["final a = 1;\nfinal r = await c.from('t{k}').select().eq('id', 1);", "c.storage.from('b{k}').upload('x', d);", "c.from('Orders')\n  .upsert({'a': 1});\nc.from('x');", "c.from('a').delete(); c.from('b').insert(x);"]


@query("table_accesses", known(*CUSTOMER, 4, APP, ["table_name", "operation", "line"], [(0, "t{k}", "select", 2), (2, "Orders", "upsert", 1), (3, "a", "delete", 1), (3, "b", "insert", 1)]))
def table_accesses(spark, sf):
    return facts.table_accesses(written(spark, sf, *CUSTOMER, APP, ACCESSES)).select("path", F.col("table").alias("table_name"), "operation", "line")


BUCKETS = ["c.storage.from('avatars').upload('$userId/{k}.png', f);", "c.storage\n  .from('public').getPublicUrl('a{k}');", "let a{k};\nc.storage.from('docs');", "c.from('docs').select();"]


@query("storage_bucket_uses", known(*CUSTOMER, 4, APP, ["bucket", "operation", "line", "own_path", "sensitive"], [(0, "avatars", "upload", 1, True, True), (1, "public", "getpublicurl", 1, False, False), (2, "docs", "access", 2, False, False)]))
def storage_bucket_uses(spark, sf):
    return facts.bucket_uses(written(spark, sf, *CUSTOMER, APP, BUCKETS))


@query("public_buckets", known(*CUSTOMER, 4, APP, ["bucket", "line"], [(0, "avatars", 1), (1, "public", 1)]))
def public_buckets(spark, sf):
    words = F.split(F.lower("bucket"), "[^a-z0-9]+")
    return facts.bucket_uses(written(spark, sf, *CUSTOMER, APP, BUCKETS)).where(F.size(F.array_intersect(words, F.array(*map(F.lit, ("assets", "avatars", "images", "public", "uploads"))))) > 0).select("path", "bucket", "line")


UPLOADS = ["s.upload('a{k}', f);", "if (fileSize > 5) return;\ns.upload('a{k}', f, contentType: 'image/png');", "validateUploadFile(f);\ns.uploadBinary('a{k}', f);", "void validateUploadFile(File f) {\n}\ns.upload('a{k}', f);"]


@query("upload_calls", known(*CUSTOMER, 4, APP, ["line", "type_checked", "size_checked", "helper"], [(0, 1, False, False, False), (1, 2, True, True, False), (2, 2, False, False, True), (3, 3, False, False, False)]))
def upload_calls(spark, sf):
    return facts.uploads(written(spark, sf, *CUSTOMER, APP, UPLOADS))


@query("client_locations", known(*CUSTOMER, 2, APP, ["line"], [(0, 1), (0, 3)]))
def client_locations(spark, sf):
    return facts.client_locations(written(spark, sf, *CUSTOMER, APP, ["final a = SupabaseClient(u, k);\n\nfinal b = SupabaseClient (u, k);", "final a = clientOf(u);"]))


@query("env_entries", known(*CUSTOMER, 1, "conf{k}/.env", ["line", "key", "value"], [(0, 1, "A", "{k}"), (0, 3, "B", "x y"), (0, 4, "D", "q")]))
def env_entries(spark, sf):
    return facts.env_entries(written(spark, sf, *CUSTOMER, "conf{k}/.env", ["A={k}\n# C=2\nB='x y'\nD = \"q\"  \nE=#no\nlower=1"]))


@query("env_not_ignored", "SELECT 'p' || c_custkey || '/.env' AS path FROM customer WHERE c_custkey % 5 IN (1, 2, 4)")
def env_not_ignored(spark, sf):
    lists = written(spark, sf, *CUSTOMER, "p{k}/.gitignore", ["# all\n.env", "*.log", ".env\n!.env", "/p{k}/.en?", "!.env\n.env\n!*.env"])
    return facts.uncovered_env(lists.unionAll(written(spark, sf, *CUSTOMER, "p{k}/.env", ["A={k}"])))


@query("file_classes", "SELECT 'f' || c_custkey || s AS path, kind FROM customer JOIN (VALUES (0, '.dart', 'dart'), (1, '.sql', 'sql'), (2, '/.env.local', 'env'), (3, '/pubspec.yaml', 'pubspec'), (4, '.yml', 'yaml'), (5, '.md', 'markdown'), (6, '.tsx', 'script'), (7, '.c', 'other')) v(m, s, kind) ON c_custkey % 8 = m")
def file_classes(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, (".dart", ".sql", "/.env.local", "/pubspec.yaml", ".yml", ".md", ".tsx", ".c"))), (F.col("c_custkey") % 8 + 1).cast("int"))
    path = F.concat(F.lit("f"), F.col("c_custkey").cast("string"), ends)
    return table(spark, sf, "customer").select(path.alias("path"), facts.suffix_classes(path).alias("kind"))


@query("generated_code", "SELECT 'lib/m' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.g.dart' ELSE '.dart' END AS path, c_custkey % 3 < 2 AS generated FROM customer")
def generated_code(spark, sf):
    k = F.col("c_custkey")
    path = F.concat(F.lit("lib/m"), k.cast("string"), F.when(k % 3 == 0, ".g.dart").otherwise(".dart"))
    text = F.when(k % 3 == 1, "// a\n// GENERATED CODE - do not edit\nclass A {}").otherwise("class A {}" + "\n" * 9 + "// generated by hand")
    return table(spark, sf, "customer").select(path.alias("path"), facts.generated(path, text).alias("generated"))


# row-level security: scripts come from nations, accesses from customers

def rls_scripts(spark, sf) -> DataFrame:
    own = "create table t{k} (id int, boss uuid references auth.users(id));\n"
    rules = ["", "create policy p{k} on t{k} for select using (true);", "alter table t{k} enable row level security;\ncreate policy p{k} on t{k} for select using (true);", "alter table public.t{k} force row level security;\ncreate policy p{k} on t{k} using (auth.uid() = boss);"]
    return written(spark, sf, "nation", "n_nationkey", "sql/{k}.sql", [(own if i % 3 == 0 else "-- t{k}\n") + rules[i % 4] for i in range(12)])


def rls_accesses(spark, sf) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("await c.from('T"), n, F.when(k % 2 == 0, "').select();").otherwise("').update(x);"))
    return facts.table_accesses(table(spark, sf, "customer").select(F.concat(F.lit("lib/c"), k.cast("string"), F.lit(".dart")).alias("path"), text.alias("content")))


FIRST = "SELECT c_nationkey AS n, CASE c_custkey % 2 WHEN 0 THEN 'select' ELSE 'update' END AS operation, min('lib/c' || c_custkey || '.dart') AS path FROM customer GROUP BY 1, 2"


@query("missing_rls", f"""SELECT path, 'T' || n AS table_name, operation, CASE n % 4 WHEN 2 THEN 'medium' ELSE 'high' END AS severity, CASE n % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence,
 CASE n % 4 WHEN 0 THEN 'no script' WHEN 1 THEN 'not enabled' ELSE 'no policy' END AS problem FROM ({FIRST}) WHERE n % 4 IN (0, 1) OR n % 4 = 2 AND operation = 'update'""")
def missing_rls(spark, sf):
    return rls.unsecured(rls_accesses(spark, sf), rls_scripts(spark, sf)).select("path", F.col("table").alias("table_name"), "operation", "severity", "confidence", "problem")


@query("policy_suggestion", f"SELECT 'T' || n AS table_name, operation, 'auth.uid() = boss' AS rule FROM ({FIRST}) WHERE n % 3 = 0 AND (n % 4 = 0 OR n % 4 IN (1, 2) AND operation = 'update')")
def policy_suggestion(spark, sf):
    return rls.suggestions(rls_accesses(spark, sf), rls_scripts(spark, sf)).select(F.col("table").alias("table_name"), "operation", "rule")


@query("unsafe_rpc", "SELECT 'lib/r' || c_custkey || '.dart' AS path, 'fn' || c_nationkey AS fn FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 3 = 0")
def unsafe_rpc(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("await c.rpc('fn"), n, F.lit("', params: {});"))).when(k % 3 == 1, "await c.rpc('fn$x');").otherwise(F.concat(F.lit("// c.rpc('fn"), n, F.lit("');")))
    files = table(spark, sf, "customer").select(F.concat(F.lit("lib/r"), k.cast("string"), F.lit(".dart")).alias("path"), text.alias("content"))
    head, guard = "create or replace function public.fn{k}(a int) returns int ", "where auth.uid() = boss "
    scripts = written(spark, sf, "nation", "n_nationkey", "sql/{k}.sql", [head + "security definer as $$ select 1 $$;", head + f"security definer as $$ select 1 {guard}$$;", head + "as $$ select 1 $$;"])
    return rls.unsafe_calls(files, scripts).select("path", "fn")


@query("rls_evidence", "SELECT * FROM (VALUES ('a', 'strong'), ('b', 'weak'), ('c', 'strong'), ('d', 'weak'), ('e', 'none')) v(case_, level)")
def rls_evidence(spark, sf):
    """Five projects, each with a file for every nation; what an earlier kind of evidence says wins."""
    f = lambda path, *texts: written(spark, sf, "nation", "n_nationkey", path, list(texts))
    plain, code = f("a{k}.md", "about {k}"), f("lib/{k}.dart", "// rls", "where(auth.uid())")
    cases = [("a", code.unionAll(f("{k}.sql", "-- rls", "create policy p on t using (true);"))), ("b", code.unionAll(f("{k}.sql", "select 'row level security';"))), ("c", plain.unionAll(code)), ("d", f("a{k}.md", "x", "Row Level Security is on")), ("e", plain)]
    out = None
    for name, files in cases:
        one = rls.evidence(files).select(F.lit(name).alias("case_"), "level")
        out = one if out is None else out.unionAll(one)
    return out


@query("policy_coverage", """SELECT p_partkey, op, sets[k + 1] AS ops, CASE WHEN k = 0 THEN true WHEN k = 1 THEN op = 'insert' WHEN k = 2 THEN op IN ('insert', 'update', 'upsert') ELSE false END AS covered
 FROM (SELECT p_partkey, ['select', 'insert', 'update', 'delete', 'upsert'][p_partkey % 5 + 1] AS op, (p_partkey // 5) % 4 AS k, ['all', 'insert', 'insert,update', ''] AS sets FROM part)""")
def policy_coverage(spark, sf):
    k = F.col("p_partkey")
    op = F.element_at(F.array(*map(F.lit, ("select", "insert", "update", "delete", "upsert"))), (k % 5 + 1).cast("int"))
    ops = F.element_at(F.array(*map(F.lit, ("all", "insert", "insert,update", ""))), (F.floor(k / 5) % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", op.alias("op"), ops.alias("ops")).withColumn("covered", rls.covered(F.col("op"), F.split("ops", ",")))


@query("ownership_filter", known(*CUSTOMER, 5, APP, ["table_name", "operation"], [(0, "orders", "select"), (3, "messages", "update")]))
def ownership_filter(spark, sf):
    texts = ["c.from('orders').select();", "c.from('orders').select().eq('user_id', u);", "c.from('messages').select('id').or('receiver_id.eq.{k},sender_id.eq.{k}');", "c.from('messages').update(x).eq('id', {k});", "c.from('orders').insert(x);"]
    none = spark.createDataFrame([], "table string, column string")
    return facts.unfiltered(facts.table_accesses(written(spark, sf, *CUSTOMER, APP, texts)), none).select("path", F.col("table").alias("table_name"), "operation")


@query("owner_columns_ladder", "SELECT * FROM (VALUES ('orders', 'boss'), ('messages', 'receiver_id,sender_id'), ('profiles', 'id')) v(table_name, columns) UNION ALL SELECT 'tbl' || n_nationkey, '13' FROM nation")
def owner_columns_ladder(spark, sf):
    """Scripts first, then well-known tables, then every usual name (given by its count)."""
    names = table(spark, sf, "nation").select(F.concat(F.lit("tbl"), F.col("n_nationkey").cast("string")).alias("table")).unionAll(spark.createDataFrame([("orders",), ("messages",), ("profiles",)], "table string"))
    own = facts.owner_columns(names, spark.createDataFrame([("Orders", "boss")], "table string, column string"))
    return own.select(F.col("table").alias("table_name"), F.when(F.size("columns") > 2, F.size("columns").cast("string")).otherwise(F.array_join("columns", ",")).alias("columns"))


# dependencies, edge functions, offsets

@query("vulnerable_versions", known(*PART, 4, "p{k}/pubspec.yaml", ["line", "name", "version", "fixed"], [(0, 2, "dio", "^4.{k}.0", "5.0.0"), (2, 3, "local_auth", ">=2.0.9 <3", "2.1.0")]))
def vulnerable_versions(spark, sf):
    texts = ["dependencies:\n  dio: ^4.{k}.0\n  http: 0.13.1", "dependencies:\n  dio: 5.0.0\n  other: 0.0.1", "dependencies:\n  mobx: any\n  local_auth: '>=2.0.9 <3'", "name: dio"]
    return facts.vulnerable(facts.pubspec_dependencies(written(spark, sf, *PART, "p{k}/pubspec.yaml", texts))).select("path", "line", "name", "version", "fixed")


@query("typosquat", known(*PART, 3, "p{k}/package.json", ["line", "name", "section", "meant"], [(0, 1, "expres", "dependencies", "express"), (1, 3, "react-domm", "peerDependencies", "react-dom"), (1, 4, "crossenv", "peerDependencies", "cross-env")]))
def typosquat(spark, sf):
    texts = ['{"dependencies": {"expres": "{k}"}, "devDependencies": {"lodash": "2"}, "scripts": {"vuee": "x"}}', '{"name": "a{k}",\n "peerDependencies": {\n  "react-domm": "1",\n  "crossenv": "2"}}', '{"dependencies": {"expres": 1']
    return facts.misspelt(facts.npm_dependencies(written(spark, sf, *PART, "p{k}/package.json", texts))).select("path", "line", "name", "section", "meant")


@query("edge_functions", known("supplier", "s_suppkey", 3, "supabase/functions/f{k}/index.ts", ["service_role", "params"], [(0, True, "a|b"), (1, False, "z"), (2, False, "")]))
def edge_functions(spark, sf):
    texts = ["const c = createClient(u, env.SERVICE_ROLE_KEY);\nf(req.query.b, req.body.a, req.body.a);", "const c = createClient(u, anon); f(request.params.z);", "const service_role = {k};"]
    return facts.edge_functions(written(spark, sf, "supplier", "s_suppkey", "supabase/functions/f{k}/index.ts", texts)).select("path", "service_role", F.array_join("params", "|").alias("params"))


COMMENTED = "eval(1); // eval(2)\n/* eval\n eval */ s = '// '; eval(3);"


@query("comment_offsets", known(*CUSTOMER, 2, APP, ["place", "line"], [(0, 0, 1), (0, COMMENTED.rindex("eval"), 3)]))
def comment_offsets(spark, sf):
    files = written(spark, sf, *CUSTOMER, APP, [COMMENTED, "// eval(1)\n/* /* eval */ eval */"])
    return facts.outside_comments(facts.matches(files, r"\beval\b"), files).select("path", F.col("at").alias("place"), "line")


@query("tainted_local_to_sink", "SELECT 'o' || o_orderkey || '.dart' AS path, 'q' AS name, 0 AS start, length('final q = input + ' || o_orderkey || ';') + 4 AS at FROM orders WHERE o_orderkey % 4 = 0")
def tainted_local_to_sink(spark, sf):
    texts = ["final q = input + {k};\ndb.rawQuery(q);", "final q = input;\n" + " " * 600 + "db.rawQuery(q);", "db.rawQuery(q);\nfinal q = input + {k};", "final q = input;\ndb.rawQuery(other{k});"]
    return facts.tainted_locals(written(spark, sf, "orders", "o_orderkey", "o{k}.dart", texts), r"final (\w+) = input", r"rawQuery\((\w+)")


@query("bmc_counterexample", "SELECT c_custkey, i AS user_no FROM customer, range(0, 8) t(i) WHERE c_mktsegment = 'BUILDING' AND NOT (c_nationkey = i AND c_acctbal > 1000)")
def bmc_counterexample(spark, sf):
    tree = {"op": "and", "args": [{"op": "uid_eq", "column": "c_nationkey"}, {"op": ">", "column": "c_acctbal", "value": 1000}]}
    return policy.counterexamples(table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING", tree, 8).select("c_custkey", F.col("user").cast("long").alias("user_no"))


@query("policy_evaluation", "SELECT c_custkey, (c_nationkey = 3 OR c_mktsegment LIKE 'B%') AND NOT (c_acctbal < 0) AS allowed FROM customer")
def policy_evaluation(spark, sf):
    import json

    from vigilake.sources.ddl import predicate

    tree = json.dumps(predicate("(auth.uid() = c_nationkey or c_mktsegment like 'B%') and not (c_acctbal < 0)"))
    return table(spark, sf, "customer").select("c_custkey", policy.column(tree, F.lit(3)).alias("allowed"))


@query("gitignore_last_match", "SELECT page_id, page_id % 5 IN (0, 2) AS ignored FROM pages")
def gitignore_last_match(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("x/y.tmp", "a/keep.tmp", "a/b", "c/b", "a/x/b/c"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", paths.ignored(names, [("a", "b/"), ("", "*.tmp"), ("", "!keep.tmp"), ("", "# *")]).alias("ignored"))


# scalar functions over texts by key

def chosen(spark, sf, texts: list[str]) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int")).alias("t"))


def by_key(values: list, kind: str, name: str) -> str:
    return f"SELECT p_partkey, CASE p_partkey % {len(values)} {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END::{kind} AS {name} FROM part"


RANDOM = "Zq7Wx2Vt9Rn4Lm8Bp1Cd6Fg3Hj5Ky"
CLAIMS = base64.urlsafe_b64encode(b'{ "iss": "' + RANDOM.encode() + b'" }').decode()
WORDS = [RANDOM, "deadbeef" * 3, RANDOM[:12] + " " + RANDOM[12:], "https://" + RANDOM, "sha256-" + RANDOM, "a" * 24 + "B1", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "${" + RANDOM + "}", CLAIMS, "Zq7Wx2", "./" + RANDOM, RANDOM + "+/"]


@query("high_entropy_secret", by_key(["true"] + ["false"] * 10 + ["true"], "BOOLEAN", "secret"))
def high_entropy_secret(spark, sf):
    return chosen(spark, sf, WORDS).select("p_partkey", X.high_entropy_secret(F.col("t")).alias("secret"))


@query("placeholder_secret", by_key(["true", "true", "true", "false", "false"], "BOOLEAN", "placeholder"))
def placeholder_secret(spark, sf):
    return chosen(spark, sf, ["changeme-now", "0" * 20, "your_key_here", RANDOM, "0" * 10]).select("p_partkey", X.placeholder(F.col("t")).alias("placeholder"))


@query("ttl_seconds", by_key([3600, 86400, 7200, 300, "NULL"], "BIGINT", "seconds"))
def ttl_seconds(spark, sf):
    return chosen(spark, sf, ["3600", "Duration(days: 1)", "const Duration( hours: 2 )", " 300 ", "ttl"]).select("p_partkey", X.ttl_seconds(F.col("t")).alias("seconds"))


@query("durations", by_key([250, 5000, 120000, 1000, "NULL"], "BIGINT", "ms"))
def durations(spark, sf):
    return chosen(spark, sf, ["250ms", "5s", "2 m", "1000", "5h"]).select("p_partkey", X.milliseconds(F.col("t")).alias("ms"))


@query("public_ipv6", by_key(["true", "false", "false", "false", "false", "true", "false", "false"], "BOOLEAN", "public"))
def public_ipv6(spark, sf):
    return chosen(spark, sf, ["2600:1f18::1", "::1", "fe80::1", "2001:db8::5", "1::2::3", "2a00:1450:4001:81b:0:0:0:200e", "12345::1", "fd00:1::2"]).select("p_partkey", X.public_ipv6(F.col("t")).alias("public"))


@query("plain_symbols", by_key(["'a.b.c'", "'a.b(x)'", "'q'", "'a.b'"], "VARCHAR", "symbol"))
def plain_symbols(spark, sf):
    return chosen(spark, sf, ["a?.b['c']", "a . b( x )", "'q'", "a[\"b\"]"]).select("p_partkey", X.plain_symbol(X.unquoted(F.col("t"))).alias("symbol"))


@query("confidence_reasons", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a flow from a source to this sink was followed' WHEN 1 THEN 'a pattern with some context; other uses are possible' ELSE 'no reason is recorded' END AS reason FROM part")
def confidence_reasons(spark, sf):
    k = F.col("p_partkey")
    conf, method = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium"), F.when(k % 3 == 0, "taint").when(k % 3 == 1, "regex").otherwise("regex")
    return table(spark, sf, "part").select("p_partkey", X.confidence_reason(conf, method).alias("reason"))


@query("url_validity", by_key(["true", "true", "false", "false", "true", "false"], "BOOLEAN", "valid"))
def url_validity(spark, sf):
    return chosen(spark, sf, ["https://abc.supabase.co", "http://localhost:54321", "http://abc.supabase.co", "ftp://a.b", "http://192.168.1.5:8000", "not a url"]).select("p_partkey", X.backend_url(F.col("t")).alias("valid"))


@query("path_functions", "SELECT DISTINCT url, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS folder, len(string_split(url, '/')) - 1 AS depth, CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE replace(url, '//', '/') END AS relative FROM pages")
def path_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("url", paths.base(u).alias("base"), paths.folder(u).alias("folder"), paths.depth(u).cast("long").alias("depth"), paths.relative(u, "https:/").alias("relative")).distinct()


# taint: one flow a text

FLOWS = [
    "function handle(input, res) {\n  db.query('select ' + input);\n}", "function handle(input, other) {\n  db.query('select ' + input);\n}",
    "function raw() { return req.body.a; }\nconst a = raw();\nexec(a);", "class A {\n  constructor(req) { this.q = req.query.q; }\n  run() { db.query('x' + this.q); }\n}",
    "const t = {};\nObject.assign(t, req.body);\nexec(t.cmd);", "const a = req.body.a;\nusers.find({ $where: a });", "const a = req.body.a;\nusers.find({ name: a });",
    "const a = req.body.a;\nvalidateName(a);\nexec(a);", "const a = req.body.a;\nsettings.execute('go ' + a);", "const a = req.body.a;\nuserDb.execute(a);",
    "app.get('/', ({ body }, res) => {\n  eval(body);\n});", "const a = JSON.parse(req.body.a);\nel.innerHTML = a;",
]


@query("taint_flows", known("orders", "o_orderkey", len(FLOWS), "o{k}.ts", ["line", "sink", "confidence"], [(0, 2, "sql", "high"), (2, 3, "command", "high"), (3, 3, "sql", "high"), (4, 3, "command", "medium"), (5, 2, "nosql", "high"), (9, 2, "sql", "high"), (10, 2, "code", "high"), (11, 2, "html", "high")]))
def taint_flows(spark, sf):
    """Handler parameters, functions that return a source, fields set in a constructor, Object.assign, query operators, validation, receivers."""
    from vigilake.operators import taint

    return taint.findings(written(spark, sf, "orders", "o_orderkey", "o{k}.ts", FLOWS)).select("path", "line", "sink", "confidence")


@query("dynamic_sinks", known("orders", "o_orderkey", 5, "o{k}.ts", ["line", "sink"], [(0, 1, "sql"), (2, 2, "command")]))
def dynamic_sinks(spark, sf):
    """A tainted line is left to the flow; constants, numbers and checked values are no dynamic parts."""
    from vigilake.operators import taint

    texts = ["db.query(`select ${name}`);", "db.query(`select ${TABLE}`);", "let b;\nexec('ls ' + dir);", "const a = req.body.a;\ndb.query('x' + a);", "const n = parseInt(x);\ndb.query('x' + n);"]
    return taint.dynamic_sinks(written(spark, sf, "orders", "o_orderkey", "o{k}.ts", texts)).select("path", "line", "sink")
