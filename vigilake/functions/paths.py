"""Globs of settings and of ignore files as regular expressions, and path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """** crosses folders, * and ? do not; without a wildcard the glob is a path or a folder."""
    if not re.search(r"[*?]", glob):
        return f"^{re.escape(glob.rstrip('/'))}(/.*)?$"
    glob = glob + "**" if glob.endswith("/") else glob
    out, i = "", 0
    while i < len(glob):
        for token, rx in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, i):
                out, i = out + rx, i + len(token)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def ignore_regex(pattern: str, folder: str = "") -> str | None:
    """A line of an ignore file in a folder ('' is the root) as an expression over whole paths; None if it says nothing."""
    line = pattern.strip().lstrip("!").replace("\\", "/").rstrip("/")
    if not line or pattern.strip().startswith("#"):
        return None
    rooted, line = line.startswith("/"), line.lstrip("/")
    body = "".join({"*": "[^/]*", "**": ".*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", line))
    base = "" if rooted or not folder else re.escape(folder) + "/"
    return f"^{base}{'' if '/' in line or rooted else '(?:.*/)?'}{body}$"


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the last of rules(folder, line) that matches a path ignores it; shallow folders come first, then by name."""
    out = F.lit(False)
    for folder, line in sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[0])):
        if rx := ignore_regex(line, folder):
            out = F.when(path.rlike(rx), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return out


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def relative(path: Column, root: str) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    return F.when(clean.startswith(root.rstrip("/") + "/"), F.substr(clean, F.lit(len(root.rstrip("/")) + 2))).otherwise(clean)
