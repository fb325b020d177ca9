"""Runs rules of the catalogue over files, as one pass over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.operators.catalog import Rule

BEFORE, AFTER = 8, 4


NEVER = "(?!)"
#: Lines that start as a comment are not reported.
COMMENT = r"^\s*(//|\*|/\*)"


def _sql(text: str) -> str:
    """A string literal of Spark SQL; a bare $ could start a variable."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _gates(rules: list[Rule]) -> Column:
    """Numbers of the rules that a whole file may hold; one parsed expression, as making it by calls takes seconds."""
    parts = []
    by_path: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        # line starts and ends count in whole files too
        ok = [f"content RLIKE {_sql('(?m)' + r.regex)}"]
        ok += [f"content RLIKE {_sql(r.file_has)}"] * bool(r.file_has) + [f"NOT content RLIKE {_sql(r.file_ok)}"] * bool(r.file_ok)
        by_path.setdefault(r.ext, []).append(f"CASE WHEN {' AND '.join(ok)} THEN {i} END")
    # the path comes first, once for all rules of a kind of file: texts of other kinds never meet their expressions
    for ext, cases in by_path.items():
        parts.append(f"CASE WHEN path RLIKE {_sql(ext)} THEN array({', '.join(cases)}) END")
    return F.expr(f"array_compact(flatten(array_compact(array({', '.join(parts)}))))")


def run(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """kind, code, severity, confidence, category, cwe, message, file, line, col, text: one row a finding; col is where it starts.

    Whole files are tested first, and only a file and rule that hold together are taken apart into lines; the rest of a rule
    comes from a table that is as long as the catalogue. Lines of one file and rule follow each other, so each expression
    is compiled once for them.
    """
    about = ("kind", "code", "severity", "confidence", "category", "cwe", "message")
    spec = [(i, *(getattr(r, n) for n in about), r.regex, r.unless or NEVER, r.near, r.near_ok or NEVER, bool(r.near or r.near_ok)) for i, r in enumerate(rules)]
    kinds = ", ".join(f"{n} string" for n in (*about, "rx", "unless", "near", "near_ok"))
    spec = files.sparkSession.createDataFrame(spec, f"rule int, {kinds}, looks boolean")
    hits = files.select("path", "content", F.explode(_gates(rules)).alias("rule"))
    split = hits.join(F.broadcast(spec), "rule").withColumn("ls", F.split("content", "\n")).drop("content")
    rows = split.select("*", F.posexplode("ls").alias("i", "text"))
    rows = rows.where(F.rlike("text", F.col("rx")) & ~F.rlike("text", F.col("unless")) & ~F.col("text").rlike(COMMENT))
    first = F.greatest(F.col("i") - BEFORE, F.lit(0))
    context = F.when(F.col("looks"), F.array_join(F.slice("ls", first + 1, F.col("i") + AFTER + 1 - first), "\n")).otherwise(F.lit(""))
    rows = rows.withColumn("context", context).where(~F.col("looks") | F.rlike("context", F.col("near")) & ~F.rlike("context", F.col("near_ok")))
    return rows.select(*about, F.col("path").alias("file"), (F.col("i") + 1).alias("line"), F.expr("instr(text, regexp_substr(text, rx))").alias("col"), "text")


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle(rules: list[Rule], files_sql: str, columns: str = "kind, code, severity, confidence, category, cwe, message, file, line, text") -> str:
    parts = []
    for r in rules:
        ok = [f"regexp_matches(text, {_quote(r.regex)})", f"regexp_matches(path, {_quote(r.ext)})", f"NOT regexp_matches(text, {_quote(COMMENT)})"]
        if r.unless:
            ok.append(f"NOT regexp_matches(text, {_quote(r.unless)})")
        if r.file_has:
            ok.append(f"regexp_matches(content, {_quote(r.file_has)})")
        if r.file_ok:
            ok.append(f"NOT regexp_matches(content, {_quote(r.file_ok)})")
        context = f"array_to_string(ls[greatest(line - {BEFORE}, 1):line + {AFTER}], chr(10))"
        if r.near:
            ok.append(f"regexp_matches({context}, {_quote(r.near)})")
        if r.near_ok:
            ok.append(f"NOT regexp_matches({context}, {_quote(r.near_ok)})")
        about = ", ".join(f"{_quote(getattr(r, n))} AS {n}" for n in ("kind", "code", "severity", "confidence", "category", "cwe", "message"))
        parts.append(f"SELECT {about}, path AS file, line, text FROM numbered WHERE {' AND '.join(ok)}")
    body = "\nUNION ALL ".join(parts)
    return f"""WITH {files_sql},
parted AS (SELECT path, content, string_split(content, chr(10)) AS ls FROM files),
numbered AS (SELECT path, content, ls, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line FROM parted),
found AS ({body})
SELECT {columns} FROM found"""
