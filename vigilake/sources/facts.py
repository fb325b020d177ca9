"""Fact tables from application sources: table accesses, buckets, uploads, clients, environment entries, dependencies, edge functions.

A kernel over Arrow batches walks one file at a time; what it returns is joined and filtered as DataFrames. Null content counts
as empty, and repeated files give repeated rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.lexer import _rows, tokens
from vigilake.sources.ddl import OWNER_NAMES

OPERATIONS = "select|insert|update|delete|upsert"
FROM = re.compile(r"\.from\(\s*(['\"])([\w:-]+)\1\s*\)")
STORED = re.compile(r"\.storage\s*\.from\(\s*(['\"])([\w.-]+)\1\s*\)")
USES = re.compile(r"(?i)\.(uploadbinary|upload|download|list|remove|getpublicurl)\s*\(")
OWN_PATH = re.compile(r"(?i)\$(?:uid|userid)\b|\$\{[^}]*(?:uid|\.id)[^}]*\}|auth\.uid\(\)|currentuser\.id|user\.id\b|\buid\b")
KNOWN_OWNERS = {t: ["user_id"] for t in ("comments", "notes", "orders", "posts", "todos")} | {t: ["id"] for t in ("profiles", "users")} | {"messages": ["receiver_id", "sender_id"]}


def statement_at(text: str, start: int, most: int) -> str:
    """Text from a place to the end of its statement, most characters at most."""
    part = text[start : start + most]
    head, semicolon, _ = part.partition(";")
    return head + semicolon


def line_at(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def around(text: str, line: int, before: int, after: int) -> str:
    return "\n".join(text.split("\n")[max(0, line - 1 - before) : line + after])


def accesses_of(text: str) -> list[tuple]:
    out = []
    for m in FROM.finditer(text):
        if ".storage" in text[max(0, m.start() - 30) : m.start()]:
            continue
        snippet = statement_at(text, m.start(), 360)
        if op := re.search(rf"(?i)\.({OPERATIONS})\s*\(", snippet):
            line = line_at(text, m.start())
            out.append((m[2], op[1].lower(), line, snippet, around(text, line, 40, 2)))
    return out


def table_accesses(files: DataFrame) -> DataFrame:
    """path, table, operation, line, snippet, context of each client query; storage calls and calls without an operation are none."""
    some = files.where(F.col("content").contains(".from("))
    return _rows(some, "path string, table string, operation string, line long, snippet string, context string", accesses_of)


def bucket_uses(files: DataFrame) -> DataFrame:
    """path, bucket, operation (access if none follows), line, own_path, sensitive: from the first 200 characters of its arguments."""

    def each(text):
        for m in STORED.finditer(text):
            snippet = statement_at(text, m.start(), 320)
            op = USES.search(snippet)
            args = snippet[op.end() : op.end() + 200] if op else ""
            yield m[2], op[1].lower() if op else "access", line_at(text, m.start()), str(bool(OWN_PATH.search(args))), str(bool(re.search("(?i)private|profile|avatar|user", args)))

    rows = _rows(files.where(F.col("content").contains(".storage")), "path string, bucket string, operation string, line long, own string, sensitive string", lambda t: list(each(t)))
    return rows.select("path", "bucket", "operation", "line", (F.col("own") == "True").alias("own_path"), (F.col("sensitive") == "True").alias("sensitive"))


TYPE_CHECK = re.compile(r"(?i)contenttype|mime|filetype|allowed(?:types|extensions)|pickimage|imagepicker|endswith\([ ]*['\"][^'\"]*[.]\w+['\"]")
SIZED = "(?:" + "|".join([r"bytes\.length", "contentLength", "file_?size", r"lengthSync\(\)", "max(?:File|Upload)?Size", r"picked\w*\.size", "sizeInBytes"]) + ")"
SIZE_CHECK = re.compile(rf"(?i)\b{SIZED}[^;\n]{{0,40}}[<>]|[<>][^;\n]{{0,40}}\b{SIZED}|(?:assert|if) ?\([^)]*\b{SIZED}")
HELPER = re.compile(r"(?i)\b(?:assert|check|ensure|guard|sanitize|validate|verify)\w*(?:attachment|avatar|file|image|media|upload)\w*\s*\(")
DEFINES = re.compile(r"^[ \t]*(?:[\w?,<>]+[ \t]+)+\w+[ \t]*\([^;]*\)[ \t]*(?:async[ \t]*)?(?:=>|\{)")


def uploads(files: DataFrame) -> DataFrame:
    """path, line, type_checked, size_checked, helper of each upload call: what the 40 lines before to 6 after show, and whether a
    validation helper is called (not defined) in the 12 lines before."""

    def each(text):
        lines = text.split("\n")
        for m in re.finditer(r"\.upload(?:Binary)?\s*\(", text):
            line = line_at(text, m.start())
            near = around(text, line, 40, 6)
            helper = any(HELPER.search(x) and not DEFINES.search(x) for x in lines[max(0, line - 13) : line])
            yield line, str(bool(TYPE_CHECK.search(near))), str(bool(SIZE_CHECK.search(near))), str(helper)

    rows = _rows(files.where(F.col("content").contains(".upload")), "path string, line long, t string, s string, h string", lambda t: list(each(t)))
    return rows.select("path", "line", (F.col("t") == "True").alias("type_checked"), (F.col("s") == "True").alias("size_checked"), (F.col("h") == "True").alias("helper"))


def client_locations(files: DataFrame) -> DataFrame:
    """path, line of directly made clients."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.where(F.col("text").rlike(r"\bSupabaseClient\s*\(")).select("path", (F.col("i") + 1).alias("line"))


def env_entries(files: DataFrame) -> DataFrame:
    """path, line, key, value of environment files: one quote layer less, values that start with # left out."""
    from vigilake.functions.columns import unquoted

    own = files.where(F.col("path").rlike(r"(^|/)\.env(\.[^/]*)?$"))
    lines = own.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    rx = r"^[ \t]*([A-Z_0-9]+)[ \t]*=[ \t]*(.*?)[ \t]*$"
    rows = lines.where(F.col("text").rlike(rx)).select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("text", rx, 1).alias("key"), F.regexp_extract("text", rx, 2).alias("value"))
    return rows.where(~F.col("value").startswith("#")).withColumn("value", unquoted(F.col("value")))


def uncovered_env(files: DataFrame) -> DataFrame:
    """path of environment files that no ignore file above them covers. Patterns of an ignore file count for files below its folder;
    the last match wins, deeper ignore files come later. Files and patterns are joined on the folders above a file."""
    from vigilake.functions import paths

    name = F.element_at(F.split("path", "/"), -1)
    env = files.where(name.rlike(r"^\.env(\.|$)")).select("path", F.split("path", "/").alias("parts"))
    above = env.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("folder"))
    lists = files.where(name == ".gitignore")

    def rules_of(text):
        return [(i, line) for i, line in enumerate(text.split("\n")) if paths.ignore_regex(line)]

    lines = _rows(lists, "path string, nth long, line string", rules_of).withColumn("folder", F.regexp_replace("path", r"/?\.gitignore$", ""))
    both = above.join(lines.select("folder", "nth", "line"), "folder")

    def decide(batches):
        import pyarrow as pa

        for b in batches:
            hit = [bool(re.search(paths.ignore_regex(line, folder), path)) for path, folder, line in zip(*(b.column(c).to_pylist() for c in ("path", "folder", "line")))]
            yield b.filter(pa.array(hit, pa.bool_()))

    hits = both.select("path", "folder", "nth", "line").mapInArrow(decide, "path string, folder string, nth long, line string")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    last = hits.groupBy("path").agg(F.max_by(~F.trim("line").startswith("!"), F.struct(depth, "folder", "nth")).alias("ignored"))
    return env.select("path").join(last.where("ignored").select("path"), "path", "left_anti")


def _with_owners(rows: DataFrame, ddl_columns: DataFrame) -> DataFrame:
    """Rows with a table, and the owner columns of it: a join with what scripts say, which is no more than the scripts' tables."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in sorted(KNOWN_OWNERS.items()) for x in kv))
    found = ddl_columns.groupBy(F.lower("table").alias("_low")).agg(F.array_sort(F.collect_set("column")).alias("_own"))
    both = rows.withColumn("_low", F.lower("table")).join(found, "_low", "left")
    usual = F.array(*map(F.lit, sorted(OWNER_NAMES)))
    return both.withColumn("columns", F.coalesce("_own", F.element_at(known, F.col("_low")), usual)).drop("_low", "_own")


def owner_columns(tables: DataFrame, ddl_columns: DataFrame) -> DataFrame:
    """table, columns: from scripts, else of well-known tables, else every usual name. ddl_columns has table, column."""
    return _with_owners(tables.select("table").distinct(), ddl_columns)


def filters_by_owner(snippet: Column, columns: Column) -> Column:
    """Whether a query's text filters by one of the columns; the expression is made of a row's columns, one for all of them."""
    any_of = F.concat(F.lit("(?:"), F.array_join(columns, "|"), F.lit(")"))
    forms = (r"(?i)\.(or|filter|match|eq)\([^\n;]{0,140}['\"]", r"['\"]"), (r"(?i)\.or\([ ]*['\"][^'\"]*\b", r"\.eq\b")
    one, other = (F.rlike(snippet, F.concat(F.lit(a), any_of, F.lit(z))) for a, z in forms)
    return (F.size(columns) > 0) & (one | other)


def unfiltered(accesses: DataFrame, ddl_columns: DataFrame) -> DataFrame:
    """Accesses without a filter on an owner column. Each access looks its columns up, so a table that most accesses name is not
    gathered in one task."""
    rows = accesses.where(F.col("table").isNotNull() & ~F.col("operation").isin("insert"))
    return _with_owners(rows, ddl_columns).where(~filters_by_owner(F.col("snippet"), F.col("columns"))).select("table", *(c for c in accesses.columns if c != "table"), "columns")


#: Name and first version without the known fault.
FIXED = dict(x.split("@") for x in """cached_network_image@3.3.0 dio@5.0.0 encrypt@5.0.0 flutter_bloc@8.1.0 flutter_html@3.0.0 flutter_inappwebview@6.0.0 freezed@2.4.0 http@0.13.0
 http_parser@4.0.0 image_picker@0.8.6 json_serializable@6.6.0 local_auth@2.1.0 mobx@2.2.0 photo_view@0.14.0 pointycastle@3.7.0 url_launcher@6.1.0 webview_flutter@4.0.0""".split())  # fmt: skip
#: Misspelt package name and the one that was meant.
MEANT = dict(x.split(">") for x in """angualr>angular axiios>axios axois>axios cross-env.js>cross-env crossenv>cross-env eslintt>eslint expres>express expresss>express loadsh>lodash
 lodahs>lodash momnet>moment monent>moment prettierx>prettier react-domm>react-dom reactt>react reatc>react vuee>vue""".split())  # fmt: skip


def pubspec_dependencies(files: DataFrame) -> DataFrame:
    """path, line, name, version of dependency lines."""
    own = files.where(F.col("path").rlike(r"(^|/)pubspec\.yaml$"))
    lines = own.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    rx = r"^\s+([a-z0-9_]+):\s*['\"]?([^'\"#]+?)['\"]?\s*$"
    return lines.where(F.col("text").rlike(rx)).select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("text", rx, 1).alias("name"), F.regexp_extract("text", rx, 2).alias("version"))


def vulnerable(dependencies: DataFrame) -> DataFrame:
    """Dependencies below the first sound version; versions without a number are left alone."""
    from vigilake.functions.columns import semver_key

    bad = dependencies.sparkSession.createDataFrame(sorted(FIXED.items()), "name string, fixed string").withColumn("_key", semver_key(F.col("fixed")))
    return dependencies.where(F.col("version").rlike(r"\d")).join(F.broadcast(bad), "name").where(semver_key(F.col("version")) < F.col("_key")).drop("_key")


SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def npm_dependencies(files: DataFrame) -> DataFrame:
    """path, line, name, section of package files; a file that is no JSON has none."""

    def each(text):
        try:
            doc = json.loads(text)
        except ValueError:
            return []
        parts = [(s, doc.get(s)) for s in SECTIONS] if isinstance(doc, dict) else []
        return [(line_at(text, max(0, text.find(f'"{n}"'))), n, s) for s, deps in parts if isinstance(deps, dict) for n in deps]

    own = files.where(F.col("path").rlike(r"(^|/)package\.json$"))
    return _rows(own, "path string, line long, name string, section string", each)


def misspelt(dependencies: DataFrame) -> DataFrame:
    """Dependencies whose name is a known misspelling, with the name that was meant."""
    return dependencies.join(F.broadcast(dependencies.sparkSession.createDataFrame(sorted(MEANT.items()), "name string, meant string")), "name")


def edge_functions(files: DataFrame) -> DataFrame:
    """path, service_role, params: functions that make a client with the service role, and the request fields that they read."""
    own = files.where(F.col("path").rlike(r"functions/.*\.ts$"))
    role = F.col("content").contains("createClient") & F.col("content").rlike(r"(?i)service_?role")
    fields = F.regexp_extract_all("content", F.lit(r"\breq(?:uest)?\.(?:body|query|params)\.(\w+)"), 1)
    return own.groupBy("path").agg(F.bool_or(role).alias("service_role"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(fields)))).alias("params"))


def outside_comments(places: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of places(path, at) that lie in no comment of their file: an anti join on the path and a bounded range."""
    from vigilake.operators.lexer import comment_spans

    spans = comment_spans(files).select(F.col("path").alias("_p"), "start", "end")
    return places.join(spans, (F.col("path") == F.col("_p")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left_anti")


def matches(files: DataFrame, regex: str) -> DataFrame:
    """path, at (offset from 0), line, text of all matches in whole files."""
    rx = re.compile(regex)
    return _rows(files, "path string, at long, line long, text string", lambda t: [(m.start(), line_at(t, m.start()), m[0]) for m in rx.finditer(t)])


def tainted_locals(files: DataFrame, source: str, sink: str, reach: int = 600) -> DataFrame:
    """path, name, start, at: sinks that use a local whose last tainted assignment in the file lies at most reach characters before.

    source and sink are expressions with the local's name as group 1."""
    s, k = re.compile(source), re.compile(sink)

    def each(text):
        return [(m[1], m.start(), 0) for m in s.finditer(text)] + [(m[1], m.start(), 1) for m in k.finditer(text)]

    places = _rows(files, "path string, name string, at long, used long", each).where(F.col("path").isNotNull() & F.col("name").isNotNull())
    last = F.max(F.when(F.col("used") == 0, F.col("at"))).over(Window.partitionBy("path", "name"))
    return places.withColumn("start", last).where((F.col("used") == 1) & (F.col("at") - F.col("start")).between(0, reach)).select("path", "name", "start", "at")


def code_only(text: str) -> str:
    """Text with comments blank."""
    out = list(text)
    for kind, a, z in tokens(text):
        if kind == "comment":
            out[a:z] = " " * (z - a)
    return "".join(out)


def suffix_classes(path: Column) -> Column:
    """dart, sql, env, markdown, yaml, pubspec, script or other, by a file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.when(name == "pubspec.yaml", "pubspec").when(name.rlike(r"^\.env(\.|$)"), "env")
    for kind, rx in (("dart", r"\.dart$"), ("sql", r"\.sql$"), ("markdown", r"\.md$"), ("yaml", r"\.ya?ml$"), ("script", r"\.(ts|tsx|js|jsx)$")):
        out = out.when(name.rlike(rx), kind)
    return out.otherwise("other")


def generated(path: Column, content: Column) -> Column:
    """Generated code: by the name's ending, or a notice in the first eight lines."""
    named = path.rlike(r"\.(g|freezed|gr|mocks|config|chopper|pb|pbenum|pbgrpc|pbjson|gen|auto_mappr|reflectable)\.dart$|(^|/)(generated|\.dart_tool)/|\.(min\.js|d\.ts)$|_pb\.(js|ts)$")
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 8), "\n")
    return named | head.rlike(r"(?i)generated (code|file|by)|do not (edit|modify)|@generated|auto-?generated")
