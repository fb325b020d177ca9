"""Row-level security: client accesses against scripts, remote procedures, suggestions and levels of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.lexer import calls
from vigilake.sources import ddl, facts

STRONG, WEAK = r"(?i)create\s+policy|enable\s+row\s+level\s+security", r"(?i)row[\s_-]*level[\s_-]*security|\brls\b"


def first_seen(accesses: DataFrame) -> DataFrame:
    """The first access of each table and operation, by path and line."""
    w = Window.partitionBy(F.lower("table"), "operation").orderBy("path", "line")
    return accesses.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def covered(operation, operations):
    """Whether a set of policy operations covers one: all, the same, or for upsert both halves."""
    both = F.array_contains(operations, "insert") & F.array_contains(operations, "update")
    return F.array_contains(operations, "all") | F.array_contains(operations, operation) | (operation == "upsert") & both


def unsecured(accesses: DataFrame, scripts: DataFrame, evidence: str = "none") -> DataFrame:
    """path, line, table, operation, severity, confidence, problem: no script secures the table (high), policies without row-level
    security (high), or no policy for the operation (medium). One row for the first access of each table and operation."""
    seen = first_seen(accesses).withColumn("low", F.lower("table"))
    p = ddl.policies(scripts).groupBy(F.col("table").alias("low")).agg(F.collect_set("operation").alias("ops"))
    on = ddl.rls_enabled(scripts).select(F.col("table").alias("low"), F.lit(True).alias("enabled"))
    both = seen.join(p, "low", "left").join(on, "low", "left")
    ops, enabled = F.coalesce("ops", F.array().cast("array<string>")), F.coalesce("enabled", F.lit(False))
    problem = F.when((F.size(ops) == 0) & ~enabled, "no script").when(~enabled, "not enabled").when(~covered(F.col("operation"), ops), "no policy")
    out = both.withColumn("problem", problem).where("problem is not null")
    severity = F.when(F.col("problem") == "no policy", "medium").otherwise("high")
    confidence = F.when((F.col("problem") == "no script") & F.lit(evidence != "weak"), "high").otherwise("medium")
    return out.select("path", "line", "table", "operation", severity.alias("severity"), confidence.alias("confidence"), "problem")


def suggestions(accesses: DataFrame, scripts: DataFrame) -> DataFrame:
    """table, operation, rule for the first accesses that no policy covers: owner columns of scripts, else of well-known tables."""
    seen = first_seen(accesses)
    p = ddl.policies(scripts).groupBy(F.col("table").alias("low")).agg(F.collect_set("operation").alias("ops"))
    bare = seen.withColumn("low", F.lower("table")).join(p, "low", "left")
    bare = bare.where(~F.coalesce(covered(F.col("operation"), F.col("ops")), F.lit(False)))
    own = facts.owner_columns(seen, ddl.owner_columns(scripts)).where(F.size("columns") < len(ddl.OWNER_NAMES))
    rule = F.array_join(F.transform("columns", lambda c: F.concat(F.lit("auth.uid() = "), c)), " OR ")
    return bare.join(own, "table").select("table", "operation", rule.alias("rule"))


def unsafe_calls(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """path, line, fn: remote calls by a plain literal of functions that run with their definer's rights and check nobody."""
    named = calls(files, r"[\w.]+\.rpc").select("path", "line", F.regexp_extract(F.col("args")[0], r"^['\"]([^'\"$]+)['\"]$", 1).alias("fn"))
    bad = ddl.definer_functions(scripts).where("unsafe").select("fn")
    return named.join(bad, "fn", "left_semi").select("path", "line", "fn")


def evidence(files: DataFrame) -> DataFrame:
    """One row, level: strong where a script declares it; else weak where one mentions it; else strong where code asks for the user id;
    else weak where code or a document mentions it; else none."""
    kind, text = facts.suffix_classes(F.col("path")), F.col("content")
    sql = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), "--[^\n]*", "")
    code = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), "//[^\n]*", "")
    rank = F.when((kind == "sql") & sql.rlike(STRONG), 0).when((kind == "sql") & sql.rlike(WEAK), 1).when((kind == "dart") & code.rlike(r"(?i)auth\.uid\(\)"), 2)
    rank = rank.when(kind.isin("dart", "markdown") & text.rlike(WEAK), 3).otherwise(4)
    levels = F.array(*map(F.lit, ("strong", "weak", "strong", "weak", "none")))
    return files.agg(F.element_at(levels, F.coalesce(F.min(rank), F.lit(4)) + 1).alias("level"))




def behind_functions(accesses: DataFrame, functions: DataFrame) -> DataFrame:
    """path, table, fn: each access with the first edge function (by path) that works on its table, null if none; functions has fn, table, path."""
    w = Window.partitionBy(F.lower("table")).orderBy("path")
    first = functions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.lower("table").alias("low"), "fn")
    return accesses.withColumn("low", F.lower("table")).join(first, "low", "left").select("path", "table", "fn")
