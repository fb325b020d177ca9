"""What happens to findings after detection: order, duplicates, suppression, baselines, noise, thresholds, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions import columns as X

def order() -> list[Column]:
    return [X.severity_rank(F.col("severity")), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("message"), F.col("code"), F.col("kind"), F.coalesce("text", F.lit(""))]



def keep_first(found: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the first in report order."""
    w = Window.partitionBy(*keys).orderBy(*order())
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_best(found: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the lowest severity rank, then the lowest confidence rank, then the first."""
    w = Window.partitionBy(*keys).orderBy(X.severity_rank(F.col("severity")), X.confidence_rank(F.col("confidence")), *order())
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fingerprint() -> Column:
    return X.fnv1a64(F.concat(F.col("code"), F.lit("\x01"), F.col("file"), F.lit("\x01"), F.col("message")))


def context_hash(found: DataFrame, files: DataFrame) -> DataFrame:
    """SHA-1 (16 digits) of the lines two before to two after a finding, white space collapsed. Only files with findings are cut into lines."""
    keys = ["kind", "code", "file", "line"]
    at = found.select(*keys).distinct().groupBy(F.col("file").alias("path")).agg(F.collect_set(F.struct("kind", "code", F.col("line"))).alias("at"))
    rows = files.join(at, "path").select(F.col("path").alias("file"), F.split("content", "\n").alias("ls"), F.explode("at").alias("f")).select("file", "ls", "f.*")
    first = F.greatest(F.col("line") - 2, F.lit(1))
    near = F.transform(F.slice("ls", first, F.col("line") + 3 - first), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return rows.select(*keys, F.substring(F.sha1(F.array_join(near, "\n")), 1, 16).alias("context_hash"))


def suppressed(found: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings without a directive (file, line, code or *) on their line: two anti joins on equal keys."""
    exact = directives.where("code <> '*'").select("file", "line", "code").distinct()
    every = directives.where("code = '*'").select("file", "line").distinct()
    return found.join(exact, ["file", "line", "code"], "left_anti").join(every, ["file", "line"], "left_anti")


LOW_SIGNAL = ("generic-secret", "high-entropy-secret")


def quieter(found: DataFrame) -> DataFrame:
    """In non-production paths severity and confidence fall by one step, and findings of low confidence and of low-signal codes go."""
    off, low = X.non_production(F.coalesce("file", F.lit(""))), F.coalesce(F.col("confidence") == "low", F.lit(False)) | F.col("code").isin(*LOW_SIGNAL)
    down = lambda c: F.when(off & (F.col(c) == "high"), "medium").when(off & (F.col(c) == "medium"), "low").otherwise(F.col(c))
    return found.where(~(off & low)).withColumn("severity", down("severity")).withColumn("confidence", down("confidence"))


def top_n(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(*order()).limit(n)


#: What makes findings the same: the first form has no place in the line.
SAME, SAME_PLACE = ("code", "file", "line", "message"), ("code", "file", "line", "col", "message")


def v1_fingerprint() -> Column:
    return F.concat_ws("|", F.col("code"), F.coalesce("file", F.lit("")), F.substring("message", 1, 60))


def not_in_baseline(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings (with context_hash) that match no entry(fingerprint, context_hash) by context first, then by v1 fingerprint."""
    left = found.withColumn("_f", v1_fingerprint())
    left = left.join(entries.where("context_hash is not null").select("context_hash").distinct(), "context_hash", "left_anti")
    return left.join(entries.select(F.col("fingerprint").alias("_f")).distinct(), "_f", "left_anti").select(*found.columns)


def at_least(found: DataFrame, severity: str | None, confidence: str | None) -> DataFrame:
    """Findings that reach both levels; null levels count as none."""
    for level, column, rank in ((severity, "severity", X.severity_rank), (confidence, "confidence", X.confidence_rank)):
        if level:
            found = found.where(rank(F.col(column)) <= rank(F.lit(level)))
    return found


def outside(found: DataFrame, patterns: list[str]) -> DataFrame:
    """Findings whose path no line of an ignore file names: a whole path, a folder with / at its end, *suffix, or a segment."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (F.col("file") == p)
        if p.endswith("/"):
            hit = hit | F.col("file").startswith(p)
        if p.startswith("*"):
            hit = hit | F.col("file").endswith(p[1:])
        if "/" not in p and "*" not in p:
            hit = hit | F.array_contains(F.split("file", "/"), p)
    return found.where(F.col("file").isNull() | ~hit)


def configured(found: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Per-rule settings: enabled false and exclude globs drop findings; severity replaces one that is there."""
    from vigilake.functions.paths import glob_regex

    drop, severity = F.lit(False), F.col("severity")
    for code, s in settings.items():
        mine = F.col("code") == code
        if s.get("enabled") is False:
            drop = drop | mine
        for g in s.get("exclude", ()):
            drop = drop | (mine & F.coalesce(F.col("file").rlike(glob_regex(g)), F.lit(False)))
        if s.get("severity"):
            severity = F.when(mine & F.col("severity").isNotNull(), s["severity"]).otherwise(severity)
    return found.where(~drop).withColumn("severity", severity)


def mobile_order(found: DataFrame, directives: DataFrame, settings: dict[str, dict], known: DataFrame) -> DataFrame:
    """The mobile scanner's steps: settings, first of the same, inline suppression, baseline. Sorting is left to the report."""
    kept = keep_first(configured(found, settings), *SAME)
    return suppressed(kept, directives).withColumn("_p", fingerprint()).join(known.select(F.col("fingerprint").alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def web_order(found: DataFrame, directives: DataFrame, ignored: list[str], changed: DataFrame | None, old: DataFrame, entries: DataFrame, least: tuple = (None, None)) -> DataFrame:
    """The web scanner's steps: suppression and ignored paths, noise, best of the same, changed files only (None: all), keys of an
    earlier report, baseline, levels. found carries context_hash."""
    kept = keep_best(quieter(outside(suppressed(found, directives), ignored)), *SAME_PLACE)
    if changed is not None:
        kept = kept.join(changed.select("file").distinct(), "file", "left_semi")
    kept = kept.withColumn("_k", F.concat_ws(":", "code", "file", F.col("line").cast("string"))).join(old.select(F.col("key").alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return at_least(not_in_baseline(kept, entries), *least)


def merged(parts: list[DataFrame]) -> DataFrame:
    """Reports of several roots as one: findings side by side under root; re-count what is needed from the union."""
    out = parts[0].withColumn("root", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("root", F.lit(i)))
    return out
