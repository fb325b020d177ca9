"""Rules over sample files written from table rows, and the whole catalogue over documents and pages.

A query for one code scans a file for each row of part and each sample of the code: the text to be reported, the one that is
clean, or the first behind comment marks, by the row's key. Its SQL knows the findings from the key and the samples' marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import rules
from vigilake.operators.catalog import RULES
from vigilake.operators.rules import _quote, _sql
from vigilake.plans import samples as S
from vigilake.plans.registry import ORACLES, QUERIES
from vigilake.session import spread, table
from vigilake.sources import corpus

COLUMNS = ["kind", "code", "severity", "confidence", "category", "cwe", "message", "file", "line", "text"]


def sample_files(keys: DataFrame, samples: list[S.Sample], prefix: Column) -> DataFrame:
    """path, content of a file for each key(k string, mode int) and sample: mode 0 is reported, 1 clean, 2 reported text behind comment marks."""
    rows = ", ".join(f"named_struct('i', '{i}', 'path', {_sql(s.path)}, 'reported', {_sql(s.reported)}, 'clean', {_sql(s.clean)})" for i, s in enumerate(samples))
    all_ = spread(keys, "k").select("*", F.explode(F.expr(f"array({rows})")).alias("s"))
    text = F.when(F.col("mode") == 0, F.col("s.reported")).when(F.col("mode") == 1, F.col("s.clean")).otherwise(F.concat(F.lit("// "), F.replace("s.reported", F.lit("\n"), F.lit("\n// "))))
    fill = lambda c: F.replace(c, F.lit("{k}"), F.col("k"))
    return all_.select(F.concat(prefix, F.col("s.i"), F.lit("/"), fill(F.col("s.path"))).alias("path"), fill(text).alias("content"), "k")


def expected(samples: list[S.Sample], table_: str, key: str, where: str, prefix: str) -> str:
    """The findings of samples in SQL: one SELECT for each mark."""
    fill = lambda t: f"replace({_quote(t)}, '{{k}}', {key}::VARCHAR)"
    parts = []
    for i, s in enumerate(samples):
        for r, line, text in s.hits:
            about = ", ".join(f"{_quote(getattr(r, n))} AS {n}" for n in COLUMNS[:7])
            parts.append(f"SELECT {about}, {prefix} || '{i}/' || {fill(s.path)} AS file, {line} AS line, {fill(text)} AS text, {key} AS k, {i} AS sample FROM {table_} WHERE {where}")
    return "\nUNION ALL ".join(parts)


def _rule_query(chosen, samples):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        keys = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 3).alias("mode"))
        return rules.run(sample_files(keys, samples, F.lit("")), chosen).select(*COLUMNS)

    return run


for _kind, _code in sorted({(r.kind, r.code) for r in RULES}):
    _chosen, _own = [r for r in RULES if (r.kind, r.code) == (_kind, _code)], S.of(_kind, _code)
    _name = f"rule_{_kind}_{_code}".replace("-", "_").replace(".", "_")
    QUERIES[_name], ORACLES[_name] = _rule_query(_chosen, _own), f"SELECT {', '.join(COLUMNS)} FROM ({expected(_own, 'part', 'p_partkey', 'p_partkey % 3 = 0', chr(39) * 2)})"


def files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.files_from_documents(table(spark, sf, "documents")).unionAll(corpus.files_from_pages(table(spark, sf, "pages")))


def rules_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return rules.run(files(spark, sf), RULES).select(*COLUMNS)


QUERIES["rules_catalogue"], ORACLES["rules_catalogue"] = rules_catalogue, rules.oracle(RULES, corpus.FILES_SQL)
