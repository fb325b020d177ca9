"""Lexical extraction that regular expressions cannot do: comment spans, literals, balanced arguments.

Each function takes files(path, content) and returns rows, from a kernel over Arrow batches that holds one file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: Where a comment or a literal may start, the marks of block comments, and what lies between a plain literal's quotes.
START, BLOCK = re.compile(r"//|/\*|['\"`]|r(?=['\"])"), re.compile(r"/\*|\*/")
PLAIN = {q: re.compile(rf"[^{q}\\{end}]*(?:\\[\s\S][^{q}\\{end}]*)*") for q, end in (("'", r"\n"), ('"', r"\n"), ("`", ""))}
RAW = {q: re.compile(rf"[^{q}\n]*") for q in "'\""}
BRACKET, PARTS = re.compile(r"[()\[\]{}]"), re.compile(r"[()\[\]{},]")
PAIRS = {"(": ")", "[": "]", "{": "}"}


def _literal_end(text: str, i: int) -> int:
    """Offset behind the string literal that starts at i (raw, triple or plain)."""
    raw = text[i] == "r"
    q = text[i + raw]
    start = i + raw
    if text.startswith(q * 3, start):
        end = text.find(q * 3, start + 3)
        return len(text) if end < 0 else end + 3
    return min((RAW if raw else PLAIN)[q].match(text, start + 1).end() + 1, len(text))


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of comments and literals; block comments nest, an unterminated one runs to the end."""
    at, n = 0, len(text)
    while m := START.search(text, at):
        i, c = m.start(), m[0]
        if c == "//":
            end = text.find("\n", i)
            at = n if end < 0 else end
            yield "comment", i, at
        elif c == "/*":
            depth, at = 1, n
            for k in BLOCK.finditer(text, i + 2):
                depth += 1 if k[0] == "/*" else -1
                if not depth:
                    at = k.end()
                    break
            yield "comment", i, at
        elif c == "r" and i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            at = i + 1
        else:
            at = _literal_end(text, i)
            yield "literal", i, at


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """Text with spaces in spans that are in order and apart; line ends stay."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        part = text[s:e]
        out += text[at:s], "\n".join(" " * len(x) for x in part.split("\n")) if "\n" in part else " " * (e - s)
        at = e
    return "".join(out) + text[at:]


def closing(text: str, at: int) -> int:
    """Offset of the bracket that closes the one at an offset, past literals and comments; -1 if there is none."""
    stack = []
    for m in BRACKET.finditer(without(text, [(s, e) for _, s, e in tokens(text) if s > at]), at):
        c = m[0]
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return m.start()
    return -1


def arguments(body: str) -> list[str]:
    """Top-level arguments of the text between two brackets."""
    out, depth, start = [], 0, 0
    for m in PARTS.finditer(without(body, [(s, e) for _, s, e in tokens(body)])):
        c = m[0]
        if c == ",":
            if not depth:
                out.append(body[start : m.start()].strip())
                start = m.end()
        else:
            depth += 1 if c in PAIRS else -1
    rest = body[start:].strip()
    return [*out, rest] if rest else out


#: Characters and rows of a batch that a kernel gives back.
OUT_CHARS, OUT_ROWS = 4 << 20, 10_000


def _rows(files: DataFrame, schema: str, each) -> DataFrame:
    """Rows (path, *values) of each(text). Rows of many files leave in one batch, up to OUT_CHARS and the rows of one file; what each()
    gives for a text of the batch that came before is used again."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if "long" in x else pa.list_(pa.string()) if "array" in x else pa.string() for x in schema.split(", ")]

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*held)), kinds)], names)

    def run(batches):
        for b in batches:
            known, held, size = {}, [], 0
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                if (got := known.get(text)) is None:
                    rows = list(each(text))
                    got = known[text] = rows, sum(_chars(v) for r in rows for v in r)
                rows, chars = got
                if rows:
                    held += [(path, *r) for r in rows]
                    size += chars
                if size >= OUT_CHARS or len(held) >= OUT_ROWS:
                    yield batch_of(held)
                    known, held, size = {}, [], 0
            if held:
                yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, schema)


def _chars(value) -> int:
    return len(value) if isinstance(value, str) else sum(map(_chars, value)) if isinstance(value, list) else 0


def comment_spans(files: DataFrame) -> DataFrame:
    """path, start, end of comments."""
    return _rows(files, "path string, start long, end long", lambda t: [(s, e) for k, s, e in tokens(t) if k == "comment"])


def literals(files: DataFrame) -> DataFrame:
    """path, start, end, body of string literals."""
    return _rows(files, "path string, start long, end long, body string", lambda t: [(s, e, t[s:e].lstrip("r").strip("'\"`")) for k, s, e in tokens(t) if k == "literal"])


def calls(files: DataFrame, name: str) -> DataFrame:
    """path, start, line, args of calls whose dotted name matches the expression, outside comments."""
    rx = re.compile(rf"(?<![\w.])(?:{name})\s*\(")

    def each(text):
        spans = [(s, e) for k, s, e in tokens(text) if k == "comment"]
        for m in rx.finditer(text):
            if any(s <= m.start() < e for s, e in spans):
                continue
            end = closing(text, m.end() - 1)
            if end >= 0:
                yield m.start(), text.count("\n", 0, m.start()) + 1, arguments(text[m.end() : end])

    return _rows(files, "path string, start long, line long, args array<string>", lambda t: list(each(t)))
