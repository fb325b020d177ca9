"""Inline suppression directives as rows of lines that they cover."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.operators.lexer import _rows

WORD = "sast-ignore"
NEXT, NAMED = rf"//\s*{WORD}-next-line", rf"//\s*{WORD}\s+([-\w]+)"
ANY_NEXT, ANY_NAMED = (re.compile(rf"(?i)/[/*]\s*{WORD}{end}") for end in (r"-next-line\b", r"\s+([-\w]+)"))
WINDOW = 8
OPEN, CLOSE = "([{", ")]}"


def statement(lines: list[str], origin: int) -> tuple[int, int] | None:
    """First and last line (from 0) of the statement below a directive: from the first line of code until brackets and quotes are
    closed and a line ends in ; or }, WINDOW lines below the directive at most."""
    start = next((i for i in range(origin + 1, len(lines)) if not re.match(r"\s*($|//|\*|/\*)", lines[i])), None)
    if start is None:
        return None
    depth, quote, end = [0, 0, 0], "", start
    last = min(len(lines) - 1, origin + WINDOW)
    while end <= last:
        for c in re.findall(r"\\.|.", lines[end]):
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c in OPEN:
                depth[OPEN.index(c)] += 1
            elif c in CLOSE:
                depth[CLOSE.index(c)] = max(0, depth[CLOSE.index(c)] - 1)
        if not any(depth) and not quote and (not lines[end].strip() or lines[end].strip()[-1] in ";}"):
            break
        end += 1
    return start, min(end, len(lines) - 1)


def windows_of(text: str) -> list[tuple[int, str]]:
    lines, out = text.split("\n"), set()
    for i, line in enumerate(lines):
        for code in ["*"] * bool(ANY_NEXT.search(line)) + ANY_NAMED.findall(line):
            if found := statement(lines, i):
                out |= {(n + 1, code) for n in range(found[0], found[1] + 1)}
    return sorted(out)


def windows(files: DataFrame) -> DataFrame:
    """file, line, code (* is every code) that directives cover down to the end of the statement below them."""
    some = files.where(F.col("content").rlike(r"(?i)/[/*]\s*sast-ignore"))
    return _rows(some, "path string, line long, code string", windows_of).select(F.col("path").alias("file"), F.col("line").cast("int").alias("line"), "code")


def adjacent(files: DataFrame) -> DataFrame:
    """file, line, code by the simple form: the line below a directive, and its own line if it names a code."""
    lines = files.where(F.col("content").contains("sast-ignore")).select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    named = lines.withColumn("code", F.regexp_extract("text", NAMED, 1)).where("code <> ''")
    own = named.select("file", (F.col("i") + 1).alias("line"), "code")
    below = named.select("file", (F.col("i") + 2).alias("line"), "code")
    return lines.where(F.col("text").rlike(NEXT)).select("file", (F.col("i") + 2).alias("line"), F.lit("*").alias("code")).unionAll(own).unionAll(below).distinct()


def hits(found: DataFrame, directives: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """code, n, review: findings that a directive keeps back, by code; five or more are worth a review of the rule."""
    d = directives.groupBy("file", "line").agg(F.collect_set("code").alias("codes"))
    kept_back = found.join(d, ["file", "line"]).where(F.array_contains("codes", "*") | F.array_contains(F.col("codes"), F.col("code")))
    return kept_back.groupBy("code").agg(F.count("*").alias("n")).withColumn("review", F.col("n") >= 5)
