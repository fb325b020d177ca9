"""Code patterns over graph tables: nodes(id, kind, symbol, file) and edges(src, dst, slot).

A pattern is a call in the shape of source text: receiver.method(argument, ...), with $X for anything (the same text wherever it
stands twice) and ... for any arguments. A compiled pattern is a tree of clauses; a scan turns each clause into a filter, and each
child into a join on its slot (0 receiver, 2 and on arguments). An excluded pattern takes its matches away.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLS = ("MethodCall", "FunctionCall", "ConstructorCall", "Call")


@dataclass(frozen=True)
class Pattern:
    """kinds and a symbol's ending or part, or a name that it is bound to; children by slot."""

    kinds: tuple[str, ...] = ()
    ends: str = ""
    holds: str = ""
    name: str = ""
    children: tuple[tuple[int, Pattern], ...] = ()


def compile_pattern(text: str) -> Pattern:
    from vigilake.operators.lexer import arguments, closing

    text = text.strip().rstrip(";")
    if re.fullmatch(r"\$\w+", text):
        return Pattern(name=text[1:])
    m = re.match(r"([$\w.]+)\s*\(", text)
    if not m or closing(text, m.end() - 1) != len(text) - 1:
        return Pattern(holds=text)
    args = [(i + 2, compile_pattern(a)) for i, a in enumerate(arguments(text[m.end() : -1])) if a and a != "..."]
    receiver, dot, method = m[1].rpartition(".")
    if not dot:
        return Pattern(kinds=CALLS, ends=method, children=tuple(args))
    own = [] if receiver == "..." else [(0, compile_pattern(receiver))]
    return Pattern(kinds=("MethodCall",), ends="." + method, children=(*own, *args))


def _test(p: Pattern) -> Column:
    ok = F.lit(True)
    if p.kinds:
        ok = ok & F.col("kind").isin(*p.kinds)
    if p.ends:
        ok = ok & F.col("symbol").endswith(p.ends)
    if p.holds:
        ok = ok & F.col("symbol").contains(p.holds)
    return ok


def names_of(p: Pattern) -> list[str]:
    """Names of a pattern as often as they stand in it."""
    return [p.name] * bool(p.name) + [n for _, child in p.children for n in names_of(child)]


def match(nodes: DataFrame, edges: DataFrame, p: Pattern, names: set[str] | None = None) -> DataFrame:
    """id, bound (map of names to symbols) of nodes that match; names that are bound twice must agree.

    names: those that are bound (None: all); without any there is no map. Joins are merge joins: what a filter leaves of a graph's
    nodes may be any part of them, and Spark sizes rows that are made from a narrow table so low that it would broadcast them.
    """
    names = set(names_of(p)) if names is None else names
    bound = F.create_map(F.lit(p.name), F.col("symbol")) if p.name in names else F.create_map().cast("map<string,string>")
    out = nodes.where(_test(p)).select("id", *[bound.alias("bound")] * bool(names))
    for slot, child in p.children:
        # the first edge of a slot counts
        first = edges.where(F.col("slot") == slot).groupBy("src").agg(F.min("dst").alias("dst"))
        below = match(nodes, edges, child, names).withColumnRenamed("id", "dst")
        both = out.join(first.hint("merge"), F.col("id") == F.col("src"))
        if not names:
            out = both.join(below.hint("merge"), "dst").select("id")
            continue
        both = both.join(below.withColumnRenamed("bound", "more").hint("merge"), "dst")
        out = both.where(consistent(F.col("bound"), F.col("more"))).select("id", merged(F.col("bound"), F.col("more")).alias("bound"))
    return out


def consistent(a: Column, b: Column) -> Column:
    """Whether two maps agree wherever both have a key."""
    return F.forall(F.map_keys(a), lambda k: ~F.map_contains_key(b, k) | (F.element_at(a, k) == F.element_at(b, k)))


def merged(a: Column, b: Column) -> Column:
    return F.map_from_entries(F.array_union(F.map_entries(a), F.map_entries(b)))


def scan(nodes: DataFrame, edges: DataFrame, wanted: list[str], unwanted: list[str] = ()) -> DataFrame:
    """id, file of nodes that match one of the wanted patterns and none of the unwanted."""

    def ids(text: str) -> DataFrame:
        p = compile_pattern(text)
        names = names_of(p)
        return match(nodes, edges, p, {n for n in names if names.count(n) > 1}).select("id")

    out = None
    for text in wanted:
        out = ids(text) if out is None else out.unionAll(ids(text))
    for text in unwanted:
        out = out.join(ids(text).hint("merge"), "id", "left_anti")
    return nodes.join(out.hint("merge"), "id", "left_semi").select("id", "file")


def base_type(name: Column) -> Column:
    """A type's name without arguments and nullability."""
    return F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"[?\s]", "")


def is_subtype(name: Column, supertypes: Column, wanted: str) -> Column:
    """Whether a type is the wanted one, or has it among its flattened supertypes."""
    return (base_type(name) == wanted) | F.coalesce(F.exists(supertypes, lambda t: base_type(t) == wanted), F.lit(False))
