"""Settings files and change lists, read on the driver: a few lines that filters and semi joins are made from."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

LEVELS = {"error": "high", "critical": "high", "high": "high", "warning": "medium", "warn": "medium", "medium": "medium", "info": "low", "note": "low", "low": "low"}


def _scalar(text: str):
    text = text.strip()
    if re.fullmatch(r"'.*'|\".*\"", text):
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), int(text) if re.fullmatch(r"-?\d+", text) else text)


def parse_yaml(text: str):
    """Maps, lists and scalars by indentation: what settings files are written in. Anchors and block texts are not read."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", line) for line in text.split("\n")) if x.strip()]

    def block(i: int, depth: int):
        if i < len(rows) and rows[i][1].startswith("- "):
            out: list | dict = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("- "):
                out.append(_scalar(rows[i][1][2:]))
                i += 1
            return out, i
        out = {}
        while i < len(rows) and rows[i][0] == depth:
            key, _, rest = rows[i][1].partition(":")
            i += 1
            if rest.strip():
                out[_scalar(key)] = _scalar(rest)
            elif i < len(rows) and (rows[i][0] > depth or rows[i][0] == depth and rows[i][1].startswith("- ")):
                out[_scalar(key)], i = block(i, rows[i][0])
            else:
                out[_scalar(key)] = None
        return out, i

    return block(0, rows[0][0])[0] if rows else {}


def parse(text: str, name: str = ".json") -> dict[str, dict]:
    """Per-rule settings: enabled, severity and exclude. A rule may be given as true, false, a level, or a map; rules that are not known stay."""
    doc = (json.loads(text) if name.endswith(".json") else parse_yaml(text)) or {}
    out = {}
    for code, given in (doc.get("rules") or {}).items():
        if isinstance(given, bool):
            out[code] = {"enabled": given}
        elif isinstance(given, str):
            out[code] = {"enabled": False} if given.lower() == "off" else {"severity": LEVELS[given.lower()]} if given.lower() in LEVELS else {}
        elif isinstance(given, dict):
            level = str(given.get("severity") or "").lower()
            out[code] = {"enabled": given.get("enabled", True) is not False, "exclude": list(given.get("exclude") or ())} | ({"severity": LEVELS[level]} if level in LEVELS else {})
    for glob in doc.get("exclude") or ():
        out.setdefault("*", {"exclude": []})["exclude"].append(glob)
    return out


def changed(spark: SparkSession, names: str | None, status: str | None) -> DataFrame | None:
    """file of changed files, from the lines of a name-only diff and of a short status; a renamed file has its new name. None if the diff
    could not be made: then every file counts."""
    if names is None:
        return None
    found = {x.strip() for x in names.split("\n") if x.strip()}
    for line in (status or "").split("\n"):
        if len(line) > 3:
            found.add(line[3:].split(" -> ")[-1].strip().strip('"'))
    return spark.createDataFrame([(f,) for f in sorted(found)], "file string")
