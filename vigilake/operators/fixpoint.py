"""Fixpoints over edges: semi-naive rounds that join the frontier, drop what is known and write each round out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut


#: Rounds after which what is known is written as one table, so that plans do not grow with the number of rounds.
MERGE = 8


class Known:
    """Rows that rounds have found, each once."""

    def __init__(self, rows: DataFrame):
        self.all = self.new = cut(rows.distinct())
        self.keys, self.rounds = rows.columns, 0

    def add(self, found: DataFrame) -> bool:
        """Take what is not known yet as the new frontier; false if there is none."""
        self.new = cut(found.select(*self.keys).distinct().join(self.all, self.keys, "left_anti"))
        if self.new.isEmpty():
            return False
        self.all, self.rounds = self.all.unionAll(self.new), self.rounds + 1
        if self.rounds % MERGE == 0:
            self.all = cut(self.all)
        return True


def reach(seeds: DataFrame, edges: DataFrame, keep: list[str] = ()) -> DataFrame:
    """All (keep..., node) reachable from seeds(keep..., node) over edges(src, dst), seeds included. Cycles end by the anti join."""
    known = Known(seeds.select(*keep, "node"))
    step = edges.select(F.col("src").alias("node"), "dst")
    while known.add(known.new.join(step, "node").select(*keep, F.col("dst").alias("node"))):
        pass
    return known.all


def reaching_definitions(gen: DataFrame, flow: DataFrame) -> DataFrame:
    """proc, node, def, var that reach the entry of a node: gen(proc, node, var), flow(proc, src, dst). A node that defines var kills others."""
    out = gen.select("proc", F.col("node").alias("def"), "var", F.col("node").alias("at"))
    known = frontier = cut(out.distinct())
    kills = gen.select("proc", F.col("node").alias("dst"), "var").distinct()
    entries = None
    while not frontier.isEmpty():
        into = frontier.join(flow.select("proc", F.col("src").alias("at"), "dst"), ["proc", "at"]).select("proc", "def", "var", "dst").distinct()
        new = into.select("proc", F.col("dst").alias("node"), "def", "var")
        entries = new if entries is None else entries.unionAll(new)
        through = into.join(kills, ["proc", "dst", "var"], "left_anti").select("proc", "def", "var", F.col("dst").alias("at"))
        frontier = cut(through.join(known, ["proc", "def", "var", "at"], "left_anti"))
        known = known.unionAll(frontier)
    return entries.distinct() if entries is not None else gen.select("proc", "node", F.col("node").alias("def"), "var").limit(0)


def taint(sources: DataFrame, edges: DataFrame, sanitizers: DataFrame, sinks: DataFrame) -> DataFrame:
    """source, sink pairs of an intraprocedural propagation: facts flow over edges(src, dst) and end at sanitizers(node)."""
    seeds = sources.select(F.col("node").alias("source"), "node")
    open_ = edges.join(sanitizers.select(F.col("node").alias("src")), "src", "left_anti")
    facts = reach(seeds, open_, ["source"])
    return facts.join(sinks.select("node"), "node").select("source", F.col("node").alias("sink")).distinct()


def summaries(flow: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst of call sites and return sites between which the callee has a path, nested calls included.

    Semi-naive: a fact (entry, node) goes on over flow and over the summaries so far; a new summary goes on from the facts
    that already stand at its call site. No fact is worked on twice."""
    base = flow.select("src", "dst")
    facts = Known(calls.select("entry", F.col("entry").alias("node")))
    found = None
    while True:
        ends = facts.new.join(calls, (facts.new["entry"] == calls["entry"]) & (facts.new["node"] == calls["exit"])).select(F.col("site").alias("src"), F.col("after").alias("dst"))
        if found is None:
            found = Known(ends)
            fresh = found.all
        else:
            fresh = found.new if found.add(ends) else ends.limit(0)
        edges = base.unionAll(found.all).select(F.col("src").alias("node"), "dst")
        on = facts.new.join(edges, "node").select("entry", F.col("dst").alias("node"))
        late = facts.all.join(fresh.select(F.col("src").alias("node"), "dst"), "node").select("entry", F.col("dst").alias("node"))
        if not facts.add(on.unionAll(late)):
            return found.all


def ifds(sources: DataFrame, flow: DataFrame, calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """source, sink with calls and returns matched: flow(src, dst), calls(site, entry, exit, after).

    A fact flows over edges inside procedures, over summaries from call site to return site, up to callers of the procedure it
    started in, and then down into callees, but never from one call site through a callee to another's return site."""
    level = flow.select("src", "dst").unionAll(summaries(flow, calls))
    up = level.unionAll(calls.select(F.col("exit").alias("src"), F.col("after").alias("dst")))
    down = level.unionAll(calls.select(F.col("site").alias("src"), F.col("entry").alias("dst")))
    first = reach(sources.select(F.col("node").alias("source"), "node"), up, ["source"])
    facts = reach(first, down, ["source"])
    return facts.join(sinks.select("node"), "node").select("source", F.col("node").alias("sink")).distinct()


def statistics(flow: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: edges, summaries and procedures of a call graph."""
    return summaries(flow, calls).agg(F.count("*").alias("summaries")).crossJoin(flow.agg(F.count("*").alias("edges"))).crossJoin(calls.agg(F.count_distinct("entry").alias("procedures")))


def affected(procedures: DataFrame, calls: DataFrame) -> DataFrame:
    """node: procedures that a change may concern, over calls(src, dst) in both directions."""
    return reach(procedures.select("node"), calls.select("src", "dst").unionAll(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def link_calls(sites: DataFrame, procedures: DataFrame) -> DataFrame:
    """site, entry, exit, after of sites(site, symbol, after) whose symbol is that of procedures(symbol, entry, exit)."""
    return sites.join(procedures, "symbol").select("site", "entry", "exit", "after")


#: Parameter names that hold outside data.
OUTSIDE = "args argv body buffer bytes command content cookie cookies data filename form header headers host html input json message path payload param params query raw req request search sql src text url user_input uri value".split()


def outside_parameters(parameters: DataFrame) -> DataFrame:
    """Parameters(node, name) that are sources by their name, whatever its case."""
    return parameters.where(F.lower("name").isin(*OUTSIDE))


def def_use(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """proc, def, use of definitions that reach(proc, node, def, var) the node that uses(proc, node, var) their variable."""
    return definitions.join(uses, ["proc", "node", "var"]).select("proc", "def", F.col("node").alias("use"))
