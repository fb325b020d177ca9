"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into 32-bit segments. Two fingerprints that differ in at most r bits differ in at most
r // segments bits of one segment, so each fingerprint is entered in a table under its segments' values and visits,
for every segment, the values in a Hamming ball of radius one around its own; what it meets is verified by the whole
distance. A differing bit is 0 on one side, and that side visits: balls are only walked from 0 to 1, half of each.
Rows with the same fingerprint enter as one, and what a bucket links is settled by linking.link_buckets.

fingerprints(): null or empty text has no words and fingerprint zero; ids may repeat, every row gets its result; a row
with a null id takes part with its text but names no group. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C
from vigilake.llm.linking import across, components, link_buckets
from vigilake.llm.shingles import SHINGLE, common_shingles, hashes, rarest_first, shingle_sets

RADIUS = 2


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows h[at[i]:at[i + 1]] of 64-bit hashes, the bits set in over half of them; none: zero."""
    out = np.zeros(len(at) - 1, "<u8")
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
        over = 2 * votes > (at[1:] - at[:-1])[full][:, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_texts(data: np.ndarray, off: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of each row, as a signed long."""
    raw, at = data.tobytes(), off.tolist()
    each = [hashes(raw[a:b], words) for a, b in zip(at[:-1], at[1:])]
    ends = np.cumsum([0, *map(len, each)])
    flat = np.fromiter((x for e in each for x in e), np.uint64, ends[-1])
    return majority(flat, ends).view(np.int64)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id, fp: the 64-bit fingerprint as a signed long."""

    def kernel(part, data, off):
        return {"id": part.column(0), "fp": fingerprint_texts(data, off, words)}

    return C.map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id long, fp long", kernel, limit=1 << 20)


def within(bits: int):
    return F.bit_count(F.col("f").bitwiseXOR(F.col("other_f"))) <= bits


def meet(nodes: DataFrame, width: int) -> DataFrame:
    """hits for link_buckets from nodes(id, f, segs array<long> of width bits): who is at home in a bucket and who visits it."""
    one = F.lit(1).cast("long")
    entered = nodes.select("id", "f", F.posexplode("segs").alias("seg", "own")).select("id", "f", (F.col("seg").cast("long") * F.lit(1 << 40)).alias("base"), "own")
    flips = F.array(*(F.lit(1 << i).cast("long") for i in range(width)))
    ball = F.concat(F.array(F.lit(0).cast("long")), F.filter(flips, lambda b: F.col("own").bitwiseAND(b) == 0))
    members = entered.select("id", "f", "base", "own", F.explode(ball).alias("flip"))
    members = members.select((F.col("base") + F.col("own") + F.col("flip")).alias("bucket"), "id", "f", (F.col("flip") == 0).alias("home"))
    tables = entered.groupBy((F.col("base") + F.col("own")).alias("bucket")).agg(F.min(F.struct("id", "f")).alias("hub"), F.count(one).alias("n"))
    tables = tables.select("bucket", "n", F.col("hub.id").alias("hub"), F.col("hub.f").alias("hub_f"))
    return members.join(C.grown(tables), "bucket").where("not home or n > 1").select("bucket", "id", "f", "home", "hub", "hub_f")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links(a, b) that leave the groups that all pairs of nodes(fp, id; one row a fingerprint) of at most radius bits would."""
    if radius > 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    halves = F.array(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("fp", 32))
    return link_buckets(C.cut(meet(nodes.select("id", F.col("fp").alias("f"), halves.alias("segs")), 32), "hits"), within(radius))


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """key, fp, component: the smallest id reachable over links of at most radius bits, the own id included."""
    rows = C.cut(fingerprints(docs, key=key, text=text, words=words), "fingerprints")
    nodes = C.cut(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = components(fingerprint_links(nodes, radius)).withColumnRenamed("id", "rid")
    named = nodes.join(C.grown(roots), F.col("id") == F.col("rid"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "id").alias("component"))
    return rows.join(C.grown(named), F.col("fp") == F.col("of"), "left").select(F.col("id").alias(key), "fp", "component")


#: Near copies: the least Jaccard similarity of sets of SHINGLE-word shingles.
SIMILARITY = 0.8
#: Shingles that prefixes are longer by; a pair shares one more than that.
MORE = 3


def least_common(n):
    """Shingles that a set of n has in common with any set that is similar enough."""
    return -(-4 * n // 5)


def prefix(n: int) -> int:
    """How many of n shingles, in an order that all texts share, hold MORE + 1 of any text that is similar enough."""
    return min(n, n - least_common(n) + 1 + MORE)


def shingle_set(text: str | None) -> set[int]:
    return set(hashes((text or "").encode(), SHINGLE))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more."""
    x = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        import pyarrow as pa

        last: dict[int, set[int]] = {}
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist())):
                if b not in last:
                    last = {b: shingle_set(batch["tb"][i].as_py())}
                s, t = shingle_set(batch["ta"][i].as_py()), last[b]
                both = len(s & t)
                keep.append(both >= SIMILARITY * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return x.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def entries(nodes: DataFrame) -> DataFrame:
    """bucket, id, f: each text under the shingles of its prefix; f is the count of its set (upper half) and the place in its order."""
    common, count = common_shingles(nodes)

    def kernel(part, data, off):
        sets = [rarest_first(s, common, count) for s in shingle_sets(data, off)]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        many = np.fromiter((prefix(k) for k in n.tolist()), np.int64, len(sets))
        first = np.concatenate([s[:k] for s, k in zip(sets, many.tolist())])
        place = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        return {"bucket": first.view(np.int64), "id": np.repeat(np.asarray(part.column(0)).astype(np.int64), many), "f": np.repeat(n << 32, many) | place}

    return C.map_texts(nodes.select("id", "text"), "bucket long, id long, f long", kernel, limit=1 << 20)


def candidates(met: DataFrame) -> DataFrame:
    """a, b, shared from met(a, b, f, other_f), one row for each prefix shingle that two texts share: pairs that may be similar.

    A pair that is similar enough has at least 4/5 of the larger set in common, so its prefixes share MORE + 1 shingles (all
    that are common, if these are fewer). Before and behind each shared one, at most what either set has there can be common too.
    """
    size, place = (lambda f: F.shiftrightunsigned(f, 32)), (lambda f: F.col(f).bitwiseAND(F.lit((1 << 32) - 1)))
    n, m, i, j = size("f"), size("other_f"), place("f"), place("other_f")
    around = F.least(i, j) + 1 + F.least(n - 1 - i, m - 1 - j)
    alike = met.where((F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (around * 9 >= (n + m) * 4))
    per = alike.groupBy("a", "b", size("f").alias("n"), size("other_f").alias("m")).agg(F.count("*").alias("shared"), F.max(place("f")).alias("i"), F.max(place("other_f")).alias("j"))
    larger = F.greatest("n", "m")
    most = F.col("shared") + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    return per.where((F.col("shared") >= F.least(F.lit(MORE + 1), larger - F.floor(larger / 5))) & (most * 9 >= (F.col("n") + F.col("m")) * 4)).select("a", "b", "shared")


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, component for every row with a key: groups linked by SimHash fingerprints and by similarity of five-word shingles.

    Texts whose fingerprints, those of groups(), differ in at most RADIUS bits are linked first. Fingerprints miss many pairs with
    a part of their own, so texts in different groups are then compared by their shingles. Candidates come from prefixes: of two sets of which 4/5 of the union is common, the first n - ceil(4 n / 5) + 1 + MORE
    shingles of each in any common order, here rarest first, share MORE + 1, so no pair is missed. Members of a shingle are
    compared with its hub first (the smallest id), each text with the hub it shares most with and then with those in other
    groups; where a shingle still holds more than one group, pairs across groups are compared. Every pair is verified on its
    whole texts. Texts of the same words in order are one node; null and empty texts are alike. Rows without a key are left out;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def kernel(part, data, off):
        raw, at = data.tobytes(), off.tolist()
        same = [xxhash.xxh3_128_digest(b" ".join(raw[a:b].lower().split())) for a, b in zip(at[:-1], at[1:])]
        return {"id": part.column(0), "same": same, "fp": fingerprint_texts(data, off, 3)}

    marked = C.cut(C.map_texts(rows, "id long, same binary, fp long", kernel, limit=1 << 20), "words")
    nodes = C.cut(marked.groupBy("same").agg(F.min("id").alias("id"), F.min("fp").alias("fp")), "nodes")
    since = C.mark()
    points = C.cut(nodes.groupBy("fp").agg(F.min("id").alias("id")), "points")
    equal = nodes.withColumnRenamed("id", "a").join(C.grown(points.withColumnRenamed("id", "b")), "fp").where("a <> b").select("a", "b")
    alike = C.cut(fingerprint_links(points).unionAll(equal), "alike")
    texts = C.cut(rows.join(nodes.select("id"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    entered = C.cut(entries(texts), "entries")
    tables = entered.groupBy("bucket").agg(F.min(F.struct("id", "f")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hits = C.cut(entered.join(C.grown(tables.select("bucket", F.col("hub.id").alias("hub"), F.col("hub.f").alias("hub_f"))), "bucket"), "hits")
    star = hits.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "f", F.col("hub_f").alias("other_f"))
    star = C.cut(across(candidates(star), components(alike), "shared"), "star")
    best = star.groupBy("a").agg(F.max_by("b", F.struct("shared", F.negate("b"))).alias("b"))
    first = C.cut(similar(best, texts), "first")
    links = alike.unionAll(first)
    links = links.unionAll(C.cut(similar(across(star.select("a", "b"), components(links)), texts), "more"))
    own = hits.join(C.grown(components(links).withColumnRenamed("id", "gid")), F.col("id") == F.col("gid"), "left").select("bucket", "id", "f", F.coalesce("root", "id").alias("root"))
    own = C.cut(own, "grouped")
    mixed = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    left = C.cut(own.join(C.grown(mixed), "bucket"), "mixed")
    other = left.select("bucket", F.col("id").alias("b"), F.col("f").alias("other_f"), F.col("root").alias("other_root"))
    met = left.withColumnRenamed("id", "a").join(C.grown(other), "bucket").where("root <> other_root and a < b").select("a", "b", "f", "other_f")
    links = links.unionAll(C.cut(similar(candidates(met).select("a", "b"), texts), "rest"))
    roots = components(links).withColumnRenamed("id", "rid")
    named = C.cut(nodes.join(C.grown(roots), F.col("id") == F.col("rid"), "left").select("same", F.coalesce("root", "id").alias("component")), "named")
    C.sweep(spark, since, named)
    return marked.select("id", "same").join(C.grown(named), "same").select(F.col("id").alias(key), "component")
