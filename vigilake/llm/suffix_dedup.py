"""Removal of repeated substrings by a sampled suffix array.

A byte goes if a string of LENGTH = 100 bytes that covers it also starts earlier: in a document with a smaller id, or at a
smaller offset of the same document. Matches never cross documents and are judged on the input.

Every window of LENGTH bytes picks an anchor, its least K-gram by hash (the leftmost of equal ones), so equal windows pick
the same anchor at the same offset, and only anchored suffixes are shuffled, one for about forty bytes:

1. An anchor's windows form one span. Spans of the same content are equal as a whole, so all but the first repeat.
2. Anchors with a K-gram and span of their own are done. Where one K-gram stands in different spans, the suffixes of these
   spans from the anchor on are sorted inside the K-gram's bucket, by their bytes, and so are the parts before it, read
   backwards. Neighbours in these orders tell how many bytes a span shares with any other on either side, and only windows
   that lie in what is shared on both sides are looked at. The first window of each class stays.
   K-grams with more than CROWD spans have their windows dealt out by content instead and compared byte for byte.
3. K-grams that a sample of documents shows in many different spans are hot: each of their windows is a span with a bucket
   of its own, by its whole content, so a line that a third of all documents share is dealt over many tasks.

Repeats inside one slice of documents are settled there, so a passage copied everywhere sends one row a slice. The list of
hot K-grams only moves work; results do not depend on it.

Null text counts as empty, and texts under LENGTH bytes stay whole. Rows that repeat an id and its text get equal results
(equal starts are not earlier); ids are expected not to name different texts. A row with a null id takes no part and stays
whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

LENGTH, K = 100, 24
REACH = LENGTH - K + 1
#: Documents with hash(id) mod SAMPLE = 0 are looked at for hot K-grams: in HOT_SHARE of their number of spans, HOT_LEAST at least.
SAMPLE, HOT_SHARE, HOT_LEAST = 128, 0.005, 8
#: Spans of one K-gram that are sorted together; those of a K-gram with more are dealt out by the content of each window.
CROWD = 20_000
BLOCK = 8 << 20
POSITION = np.uint64((1 << 24) - 1)
#: The highest 0 to 8 bytes of a number, and the least numbers of 2 to 8 bytes.
HIGH = ~np.concatenate([~np.uint64(0) >> np.arange(0, 64, 8, dtype=np.uint64), [np.uint64(0)]])
BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
A, B, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number (of len(data) - 7 positions)."""
    return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))


def anchors(data: np.ndarray, off: np.ndarray):
    """row, k-gram hash, span hash, anchor, first and last window start (in data) of every span of the rows."""
    out = []
    for r in range(0, len(data), BLOCK):
        part = data[r : r + BLOCK + LENGTH - 1]
        if len(part) < LENGTH:
            break
        w = words_at(part)
        g = w[: len(part) - K + 1] * A + w[8 : len(part) - K + 9] * B + w[16 : len(part) - K + 17] * D
        g = C.mix(g)
        key = g & ~POSITION | np.arange(len(g), dtype=np.uint64)
        n = len(g) - REACH + 1
        pad = -len(key) % REACH
        m = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, REACH)
        pre = np.minimum.accumulate(m, axis=1).ravel()
        suf = np.ascontiguousarray(np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1]).ravel()
        pick = (np.minimum(suf[:n], pre[REACH - 1 : REACH - 1 + n]) & POSITION).astype(np.int64)
        # windows that end in their own row
        room = np.zeros(n + 1, np.int64)
        lo, hi = np.clip(off[:-1] - r, 0, n), np.clip(off[1:] - LENGTH + 1 - r, 0, n)
        ok = hi > lo
        np.add.at(room, lo[ok], 1)
        np.add.at(room, hi[ok], -1)
        at = np.flatnonzero(np.cumsum(room)[:-1] > 0)
        if not len(at):
            continue
        a = pick[at]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        lo, hi, a = at[first], at[np.concatenate([first[1:] - 1, [len(at) - 1]])], a[first]
        h = C.prefix_hash(part)
        sh = C.mix(C.span_hash(h, lo, hi + LENGTH) + (((a - lo) << 8 | (hi - lo)).astype(np.uint64) * A))
        out.append((C.row_of(off, lo + r), g[a], sh, a + r, lo + r, hi + r))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*out))


def split_hot(found, data: np.ndarray, hot: np.ndarray):
    """Spans with hot k-grams as one span a window, in a bucket of the window's content."""
    row, kh, sh, a, lo, hi = found
    if not len(hot) or not len(kh):
        return found
    at = np.minimum(np.searchsorted(hot, kh), len(hot) - 1)
    is_hot = hot[at] == kh
    if not is_hot.any():
        return found
    many = (hi - lo + 1)[is_hot]
    start = np.repeat(lo[is_hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    r, anchor = np.repeat(row[is_hot], many), np.repeat(a[is_hot], many)
    wh = C.mix(C.span_hash(C.prefix_hash(data), start, start + LENGTH))
    other = C.mix(wh + np.repeat(kh[is_hot], many))
    keep = ~is_hot
    return tuple(np.concatenate([x[keep], y]) for x, y in zip(found, (r, other, wh, anchor, start, start)))


def spans(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """id, kh, sh, at, lo, hi; sh is null where windows lo to hi already repeat in their slice. Offsets are from the row's start."""
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(hot))

    def kernel(part, data, off):
        row, kh, sh, a, lo, hi = split_hot(anchors(data, off), data, shared.value)
        base = off[row]
        ids, a, lo, hi = np.asarray(part.column(0)).astype(np.int64)[row], a - base, lo - base, hi - base
        order = np.lexsort([lo, ids, kh, sh])
        ids, kh, sh, a, lo, hi = (x[order] for x in (ids, kh, sh, a, lo, hi))
        head = np.concatenate([[True], (sh[1:] != sh[:-1]) | (kh[1:] != kh[:-1])]) if len(ids) else np.zeros(0, bool)
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(ids) else np.zeros(0, np.int64)
        again = ~head & ~((ids == ids[first]) & (lo == lo[first]))
        # repeats that follow each other are one row, dealt out by a hash of their place
        who, a_lo, a_hi = ids[again], lo[again], hi[again]
        o = np.lexsort([a_lo, who])
        who, a_lo, a_hi = who[o], a_lo[o], a_hi[o]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (a_lo[1:] > a_hi[:-1] + 1)]) if len(who) else np.zeros(0, bool)
        f = np.flatnonzero(new)
        end = np.concatenate([f[1:] - 1, [len(who) - 1]]) if len(f) else f
        place = C.mix(who[f].astype(np.uint64) * A + a_lo[f].astype(np.uint64))
        kept, none = ~again, np.zeros(len(f), np.int64)
        both = lambda x, y, t: np.concatenate([x[kept], y]).astype(t)
        return {
            "id": both(ids, who[f], np.int64), "kh": both(kh.view(np.int64), place.view(np.int64), np.int64),
            "sh": pa.array(both(sh.view(np.int64), none, np.int64), mask=np.arange(kept.sum() + len(f)) >= kept.sum()),
            "at": both(a, none, np.int32), "lo": both(lo, a_lo[f], np.int32), "hi": both(hi, a_hi[end], np.int32),
        }

    return C.map_texts(rows, "id long, kh long, sh long, at int, lo int, hi int", kernel, limit=2 << 20)


def hot_grams(rows: DataFrame) -> np.ndarray:
    """K-grams in many different spans of the sampled documents; at most one for HOT_SHARE of a document's spans."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)

    def kernel(part, data, off):
        _, kh, sh, _, _, _ = anchors(data, off)
        pair = np.unique(np.stack([kh, sh], 1), axis=0) if len(kh) else np.zeros((0, 2), np.uint64)
        return {"kh": pair[:, 0].copy().view(np.int64), "sh": pair[:, 1].copy().view(np.int64)}

    least = max(HOT_LEAST, int(HOT_SHARE * sample.count()))
    got = C.map_texts(sample, "kh long, sh long", kernel, limit=2 << 20).distinct().groupBy("kh").count().where(F.col("count") >= least).select("kh")
    return np.array([r.kh for r in got.collect()], np.int64).view(np.uint64)


def _groups(batches, key: int):
    """Record batches that hold whole groups of a sorted column."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(key))
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def resolve(found: DataFrame) -> DataFrame:
    """id, lo, hi of repeating spans (kh null) and of spans to be compared with others of their k-gram (kh set; at too)."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ours = found.repartition(n, "kh").sortWithinPartitions("kh", "sh", "id", "lo")

    def run(batches):
        # rows stream past: what is kept of a K-gram is its last content's first row, and its only span while it has but one
        last = None
        for t in batches:
            done = np.asarray(t.column("sh").is_null())
            if done.any():
                yield _spans_out(*(np.asarray(t.column(c))[done] for c in ("id", "kh", "at", "lo", "hi")), np.ones(int(done.sum()), bool))
            t = t.filter(pa.array(~done))
            if not t.num_rows:
                continue
            ids, kh, sh, at, lo, hi = (np.asarray(t.column(c)) for c in ("id", "kh", "sh", "at", "lo", "hi"))
            new_k = np.concatenate([[last is None or kh[0] != last["kh"]], kh[1:] != kh[:-1]])
            new_s = new_k | np.concatenate([[last is None or sh[0] != last["sh"]], sh[1:] != sh[:-1]])
            place = np.maximum.accumulate(np.where(new_s, np.arange(len(ids)), -1))
            old = place < 0
            first_id, first_lo = (np.where(old, last[c] if last else 0, x[place]) for c, x in (("id", ids), ("lo", lo)))
            again = ~new_s & ~((ids == first_id) & (lo == first_lo))
            part = np.cumsum(new_k)
            kinds = np.bincount(part, new_s, int(part[-1]) + 1).astype(np.int64)
            if not new_k[0]:
                kinds[0] += last["kinds"]
                if kinds[0] > 1 and last["only"]:
                    yield _spans_out(*(np.array([x]) for x in last["only"]), np.zeros(1, bool))
            keep = again | new_s & (kinds[part] > 1)
            yield _spans_out(ids[keep], kh[keep], at[keep], lo[keep], hi[keep], again[keep])
            only = None
            if kinds[-1] == 1:
                mine = np.flatnonzero(new_s & (part == part[-1]))
                only = tuple(x[mine[0]] for x in (ids, kh, at, lo, hi)) if len(mine) else last["only"]
            last = {"kh": kh[-1], "sh": sh[-1], "id": first_id[-1], "lo": first_lo[-1], "kinds": min(int(kinds[-1]), 2), "only": only}

    return ours.mapInArrow(run, "id long, kh long, at int, lo int, hi int")


def _spans_out(ids, kh, at, lo, hi, again) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kh, mask=again), pa.array(at), pa.array(lo), pa.array(hi)], ["id", "kh", "at", "lo", "hi"])


class Suffixes:
    """Suffixes of a buffer, up to LENGTH bytes, in the order of their bytes, read eight at a time. Bytes from size on count as zero."""

    def __init__(self, data: np.ndarray):
        self.words = words_at(np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])).byteswap()

    def keys(self, start: np.ndarray, size) -> list[np.ndarray]:
        left = np.broadcast_to(np.minimum(size, LENGTH), start.shape)
        return [self.words[start + k] & HIGH[np.clip(left - k, 0, 8)] for k in range(0, LENGTH, 8)]

    def sort(self, start: np.ndarray, bucket: np.ndarray, size=LENGTH) -> np.ndarray:
        """Order of suffixes start within their buckets; equal ones stay in order."""
        return np.lexsort([*self.keys(start, size)[::-1], bucket])

    def ranked(self, start: np.ndarray, bucket: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
        """That order, and the length of the common extension of each suffix and the one before it in order (-1: another bucket)."""
        keys = self.keys(start, size)
        order = np.lexsort([*keys[::-1], bucket])
        common = np.full(len(order), -1, np.int64)
        live = np.flatnonzero(bucket[order[1:]] == bucket[order[:-1]]) + 1
        common[live] = LENGTH
        for k, key in enumerate(keys):
            apart = key[order[live]] ^ key[order[live - 1]]
            no = np.flatnonzero(apart)
            common[live[no]] = 8 * k + 7 - np.searchsorted(BYTES, apart[no], "right")
            live = live[apart == 0]
        return order, common


def repeats(data: np.ndarray, off: np.ndarray, group: np.ndarray, before: np.ndarray, ids: np.ndarray, at: np.ndarray):
    """row, distance of the anchor from the window's start, whether the window repeats: of windows whose bytes other spans of the
    group may have too. Rows are spans in order of group and precedence, with their anchor behind `before` bytes.

    Two windows with their anchor at a distance d are equal if the spans share d bytes before the anchor and LENGTH - d from it on.
    So the spans' suffixes from the anchor on are sorted, and their parts before it, read backwards; where neighbours share fewer
    bytes, a new class begins.
    """
    n, depths = len(group), np.arange(REACH)

    def ranks(suffixes: Suffixes, start, size, depth):
        order, common = suffixes.ranked(start, group, size)
        shared, place = np.empty(n, np.int64), np.empty(n, np.int64)
        shared[order], place[order] = np.maximum(common, np.append(common[1:], -1)), np.arange(n)
        return np.minimum(shared, size), np.cumsum(common[:, None] < depth, axis=0, dtype=np.int32), place

    behind, *right = ranks(Suffixes(data), off[:-1] + before, np.diff(off) - before, LENGTH - depths)
    most, *left = ranks(Suffixes(data[::-1]), len(data) - off[:-1] - before, before, depths)
    least = np.maximum(LENGTH - behind, 0)
    many = np.maximum(most - least + 1, 0)
    row = np.repeat(np.arange(n), many)
    d = least[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = d
    for number, place in (right, left):
        key = key * (n + 1) + number[place[row], d]
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    first = first[same]
    start = at[row] - d
    return row, d, (first != np.arange(len(row))) & ~((ids[row] == ids[row][first]) & (start == start[first]))


def compare(contexts: DataFrame) -> DataFrame:
    """id, pack of windows that repeat, from contexts(kh, id, lo, at, text): one row a span."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ours = contexts.repartition(n, "kh").sortWithinPartitions("kh", "id", "lo")

    def run(batches):
        for t in _groups(batches, 0):
            kh, ids, lo, at = (np.asarray(t.column(c)) for c in ("kh", "id", "lo", "at"))
            data, off = C.utf8(t.column("text"))
            row, nth, again = repeats(data, off, np.cumsum(np.concatenate([[True], kh[1:] != kh[:-1]])), at - lo, ids, at)
            who, where = ids[row][again], (at[row] - nth)[again]
            o = np.lexsort([where, who])
            who, where = who[o], where[o]
            head = np.concatenate([[True], (who[1:] != who[:-1]) | (where[1:] > where[:-1] + 1)]) if len(who) else np.zeros(0, bool)
            f = np.flatnonzero(head)
            end = np.concatenate([f[1:] - 1, [len(who) - 1]]) if len(f) else f
            yield pa.RecordBatch.from_arrays([pa.array(who[f]), pa.array(where[f].astype(np.int64) << 32 | where[end].astype(np.int64))], ["id", "pack"])

    return ours.mapInArrow(run, "id long, pack long")


def settle(windows: DataFrame) -> DataFrame:
    """id, pack of windows that repeat, from windows(kh, id, lo, text) where equal texts have one kh. Rows stream past the first one of
    their text; every text is compared byte for byte, and other texts under one kh are told apart."""
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        bucket, firsts = None, {}
        for t in batches:
            kh, ids, lo = (np.asarray(t.column(c)).astype(np.int64) for c in ("kh", "id", "lo"))
            text = C.utf8(t.column("text"))[0].reshape(-1, LENGTH)
            again = np.zeros(len(kh), bool)

            def repeats(i: int, seen: dict) -> bool:
                own = (int(ids[i]), int(lo[i]))
                return seen.setdefault(text[i].tobytes(), own) != own

            # the bucket that the last batch ended in goes on row by row
            lead = int(np.searchsorted(kh != bucket, True)) if bucket is not None else 0
            for i in range(lead):
                again[i] = repeats(i, firsts)
            if lead < len(kh):
                rest = np.arange(lead, len(kh))
                head = np.concatenate([[True], kh[lead + 1 :] != kh[lead:-1]])
                place = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))]
                same = (text[rest] == text[place]).all(axis=1)
                again[rest] = same & ~((ids[rest] == ids[place]) & (lo[rest] == lo[place]))
                others: dict[int, dict] = {}
                for i, p in zip(rest[~same].tolist(), place[~same].tolist()):
                    again[i] = repeats(i, others.setdefault(p, {text[p].tobytes(): (int(ids[p]), int(lo[p]))}))
                end = int(place[-1])
                bucket, firsts = int(kh[-1]), others.get(end, {text[end].tobytes(): (int(ids[end]), int(lo[end]))})
            yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(lo[again] << 32 | lo[again])], ["id", "pack"])

    return windows.repartition(n, "kh").sortWithinPartitions("kh", "id", "lo").mapInArrow(run, "id long, pack long")


def each_window(contexts: DataFrame) -> DataFrame:
    """kh, id, lo, text of every window of spans, in a bucket of its own content."""

    def kernel(part, data, off):
        many = np.diff(off) - LENGTH + 1
        row = np.repeat(np.arange(part.num_rows), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = off[row] + nth
        kh = C.mix(C.span_hash(C.prefix_hash(data), start, start + LENGTH))
        body = data[start[:, None] + np.arange(LENGTH)].ravel()
        text = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1) * LENGTH).astype(np.int32)), pa.py_buffer(body)])
        ids, lo = (np.asarray(part.column(c)).astype(np.int64) for c in ("id", "lo"))
        return {"kh": kh.view(np.int64), "id": ids[row], "lo": lo[row] + nth, "text": text}

    return C.map_texts(contexts, "kh long, id long, lo long, text binary", kernel, limit=1 << 20)


def _contexts(joined: DataFrame) -> DataFrame:
    def kernel(part, data, off):
        lists = part.column(2)
        flat, size = lists.flatten(), np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
        kh, at, lo, hi = (np.asarray(flat.field(c)) for c in ("kh", "at", "lo", "hi"))
        row = np.repeat(np.arange(part.num_rows), size)
        a = off[row] + lo
        width = hi.astype(np.int64) - lo + LENGTH
        cut = np.concatenate([[0], np.cumsum(width)])
        body = data[np.arange(cut[-1]) + np.repeat(a - cut[:-1], width)]
        text = pa.BinaryArray.from_buffers(pa.binary(), len(kh), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(body)])
        return {"kh": kh, "id": np.asarray(part.column(0))[row], "lo": lo, "at": at, "text": text}

    return C.map_texts(joined, "kh long, id long, lo int, at int, text binary", kernel, limit=2 << 20)


def removals(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] = ()) -> DataFrame:
    """id, text, packs (first and last window start, packed, of each repeat; null where nothing repeats) and carried columns of rows with an id."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    found = C.cut(resolve(spans(rows, hot_grams(rows))), "spans")
    open_ = found.where("kh is not null")
    contexts = lambda of: _contexts(rows.join(of.groupBy("id").agg(F.collect_list(F.struct("kh", "at", "lo", "hi")).alias("open")), "id").select("id", "text", "open"))
    crowd = C.cut(open_.groupBy("kh").count().where(F.col("count") > CROWD).select("kh"), "crowd")
    if crowd.isEmpty():
        more = compare(contexts(open_))
    else:
        more = compare(contexts(open_.join(crowd, "kh", "left_anti"))).unionAll(settle(each_window(contexts(open_.join(crowd, "kh", "left_semi")))))
    pack = (F.col("lo").cast("long") * F.lit(1 << 32) + F.col("hi")).alias("pack")
    packs = found.where("kh is null").select("id", pack).unionAll(more).groupBy("id").agg(F.collect_list("pack").alias("packs"))
    if carry:
        rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), *(F.col(c).alias(f"_{c}") for c in carry)).where("id is not null")
    return rows.join(packs, "id", "left").select("id", "text", "packs", *(f"_{c}" for c in carry))


def removed_runs(packs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of removed bytes."""
    if not len(packs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = packs >> 32, np.minimum((packs & 0xFFFFFFFF) + LENGTH, size)
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    f = np.flatnonzero(new)
    return lo[f], hi[np.concatenate([f[1:] - 1, [len(lo) - 1]])]


def _each(part, off):
    lists = part.column(2)
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
    flat, at = np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)])
    for i in range(part.num_rows):
        yield int(off[i]), int(off[i + 1]), removed_runs(flat[at[i] : at[i + 1]], int(off[i + 1] - off[i]))


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""

    def kernel(part, data, off):
        raw, removed, count, sha = data.tobytes(), [], [], []
        for a, z, (lo, hi) in _each(part, off):
            h, at = hashlib.sha256(), a
            for i, j in zip((lo + a).tolist(), (hi + a).tolist()):
                h.update(raw[at:i])
                at = j
            h.update(raw[at:z])
            removed.append(int((hi - lo).sum()))
            count.append(len(lo))
            sha.append(h.hexdigest())
        return {"id": part.column(0), "n_bytes": np.diff(off), "n_removed": removed, "n_spans": count, "kept_sha256": sha}

    got = C.map_texts(removals(docs, key=key, text=text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", kernel, limit=2 << 20)
    none = docs.where(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"),
    )
    return got.unionAll(none).withColumnRenamed("id", key)


def kept(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] = ()) -> DataFrame:
    """key, text without its removed bytes, carried columns; a character that a run covers in part stays. Rows with an id only."""
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def kernel(part, data, off):
        raw, out = data.tobytes(), []
        for a, z, (lo, hi) in _each(part, off):
            body, at, left = raw[a:z], 0, []
            for i, j in zip(lo.tolist(), hi.tolist()):
                while i < j and body[i] & 0xC0 == 0x80:
                    i += 1
                while j > i and j < len(body) and body[j] & 0xC0 == 0x80:
                    j -= 1
                left.append(body[at:i])
                at = j
            out.append((b"".join(left) + body[at:]).decode("utf-8", "replace"))
        return {"id": part.column(0), "text": out} | {c: part.column(f"_{c}") for c in carry}

    return C.map_texts(removals(docs, key=key, text=text, carry=carry), f"id long, text string{kinds}", kernel, limit=2 << 20).withColumnRenamed("id", key)
