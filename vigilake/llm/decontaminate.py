"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case words parted by one space. Every benchmark item is a needle, or overlapping needles of
NEEDLE bytes if it is longer. A needle of m bytes that occurs with at most k edits shares m + 1 - q (k + 1) q-grams with
the place, all within 2 k + 1 diagonals. So shared q-grams are counted first by stretches of text, then for each needle
in overlapping diagonal bands; bands that reach the bound are verified by banded alignment.

Items lie in blocks of about BLOCK_BYTES in the shared folder. Documents are read once: a worker takes a batch of them
through all blocks and holds the needles of one block at a time, so memory does not grow with the benchmark, and a document
gets one row whatever the size of blocks.

Null and empty texts contain nothing; null, empty or sign-only items match nothing, and items under SHORT bytes must match
exactly between word bounds. Items without an id count as one item whose id is null. A needle gives every place in a row
that does not overlap a better one. Repeated document rows get a row each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C
from vigilake.llm.language_crf import lowered

Q, RATE, NEEDLE, SHORT = 8, 0.1, 100, 24
BLOCK_BYTES, TABLE_BITS = 4 << 20, 22
HASH = np.uint64(0x9E3779B97F4A7C15)


def plain(data: np.ndarray, off: np.ndarray):
    """Rows as words with one space around each, their offsets, and each byte's place in data."""
    low = lowered(data)
    word = C.KIND[low] == 1
    first = np.zeros(len(low), bool)
    first[off[:-1][off[:-1] < len(low)]] = True
    keep = word.copy()
    keep[1:] |= word[:-1] & ~first[1:]
    at = np.flatnonzero(keep)
    out = np.where(word[at], low[at], 32).astype(np.uint8)
    # one space before the first word of a row and one behind the last
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = kept[off[1:]] - kept[off[:-1]]
    full = size > 0
    new = np.concatenate([[0], np.cumsum(size + 2 * full)])
    pos = np.arange(len(at)) + np.repeat(new[:-1] - np.concatenate([[0], np.cumsum(size)])[:-1] + full, size)
    text, place = np.full(new[-1], 32, np.uint8), np.zeros(new[-1], np.int64)
    text[pos], place[pos] = out, at
    place[new[:-1][full]] = off[:-1][full]
    place[new[1:][full] - 1] = off[1:][full] - 1
    return text, new, place


def grams(text: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes at each position as a number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", text.tobytes(), strides=(1,)).copy()


class Needles:
    """Needles of one block with their q-gram table."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item, self.text = [], []
        for ident, raw in items:
            body = plain(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
            if len(body.strip()) == 0:
                continue
            step = NEEDLE // 2
            cuts = [body] if len(body) <= NEEDLE + step else [body[i : i + NEEDLE] for i in (*range(0, len(body) - NEEDLE, step), len(body) - NEEDLE)]
            self.item += [ident] * len(cuts)
            self.text += cuts
        self.size = np.array([len(t) for t in self.text], np.int64)
        edits = np.minimum((self.size * RATE).astype(np.int64), (self.size - 1) // Q - 1)
        self.edits = np.where(self.size < SHORT, 0, np.maximum(edits, 0))
        self.bound = np.maximum(self.size + 1 - Q * (self.edits + 1), 1)
        flat, off = np.frombuffer(b"".join(self.text), np.uint8), np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        g = grams(flat)
        who = C.row_of(off, np.arange(len(g)))
        inside = np.arange(len(g)) + Q <= off[who + 1] if len(g) else np.zeros(0, bool)
        self.tiny = [i for i, t in enumerate(self.text) if len(t) < Q]
        order = np.argsort(g[inside], kind="stable")
        self.gram = g[inside][order]
        self.needle, self.offset = who[inside][order], (np.arange(len(g)) - off[who])[inside][order]
        self.keys, self.first = np.unique(self.gram, return_index=True)
        self.last = np.concatenate([self.first[1:], [len(self.gram)]])
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys * HASH >> np.uint64(64 - TABLE_BITS)] = True
        big = self.size >= Q
        self.reach = int((self.size + self.edits)[big].max()) if big.any() else 0
        self.least = int(self.bound[big].min()) if big.any() else 1

    def find(self, text: np.ndarray, off: np.ndarray):
        """needle, row, start, end (of text), edits of verified places."""
        g = grams(text)
        hit = self.table[g * HASH >> np.uint64(64 - TABLE_BITS)]
        at = np.flatnonzero(hit)
        if self.least > 1 and len(at):
            # a place shares at least this many q-grams within its reach, so a hit without so many neighbours is dropped
            k = self.least - 1
            near = at[k:] - at[:-k] <= self.reach if len(at) > k else np.zeros(0, bool)
            good = np.zeros(len(at) + 1, np.int64)
            idx = np.flatnonzero(near)
            np.add.at(good, idx, 1)
            np.add.at(good, idx + k + 1, -1)
            at = at[np.cumsum(good)[:-1] > 0] if len(at) > k else at[:0]
        if not len(at):
            return _none()
        key = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[key] == g[at]
        at, key = at[same], key[same]
        row = C.row_of(off, at)
        inside = at + Q <= off[row + 1]
        at, key, row = at[inside], key[inside], row[inside]
        if not len(at):  # what the table let through was no q-gram of a needle
            return _none()
        times = self.last[key] - self.first[key]
        post = np.repeat(self.first[key] - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum())
        needle, diagonal, row = self.needle[post], np.repeat(at, times) - self.offset[post], np.repeat(row, times)
        # hits by needle, row and strip of 2 k + 1 diagonals; two neighbouring strips are a band, and any 2 k + 1 diagonals
        # lie in one of these overlapping bands
        step = (2 * self.edits + 1)[needle]
        strip = np.floor_divide(diagonal, step)
        base = int(strip.min()) - 1
        wide, rows = int(strip.max()) - base + 2, len(off) - 1
        key = np.sort((needle * rows + row) * wide + (strip - base))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([begin, [len(key)]]))
        key = key[begin]
        after = np.concatenate([np.where(key[1:] == key[:-1] + 1, count[1:], 0), [0]])
        before = np.concatenate([[True], key[:-1] != key[1:] - 1])
        # a strip with the one behind it, and with the one before it where that one has no hit
        own = self.bound[key // wide // rows]
        band = np.concatenate([key[count + after >= own], key[before & (count >= own)] - 1])
        code = np.stack([band // wide // rows, band // wide % rows, band % wide + base], 1)
        return self._verify(code, text, off)

    def _verify(self, code, text, off):
        found = [_none()]
        for k in np.unique(self.edits[code[:, 0]]):
            some = code[self.edits[code[:, 0]] == k]
            for i in range(0, len(some), 2048):
                found.append(self._align(some[i : i + 2048], int(k), text, off))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _align(self, code, k, text, off):
        """Edit distance of needles to their bands: any start and any end within the band is free."""
        needle, row, band = code.T
        m, longest = self.size[needle], int(self.size[needle].max())
        width, start = 4 * k + 2, band * (2 * k + 1)
        pattern = np.zeros((len(code), longest), np.uint8)
        for i, x in enumerate(needle):
            pattern[i, : m[i]] = np.frombuffer(self.text[x], np.uint8)
        at = start[:, None] + np.arange(width + longest)
        inside = (at >= off[row][:, None]) & (at < off[row + 1][:, None])
        body = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0)
        # most bands fail, and their distance alone says so; where a match began is worked out for the others
        done, _, _ = _banded(pattern, m, body, inside, width, False)
        good = np.flatnonzero(done <= k)
        done, end, began = _banded(pattern[good], m[good], body[good], inside[good], width, True)
        needle, row, start = needle[good], row[good], start[good]
        return needle, row, np.maximum(start + began, off[row]), np.minimum(start + end, off[row + 1]), done


def _banded(pattern, m, body, inside, width, trace):
    """Distance of each pattern to its body within a band, the end, and the begin if trace; places outside cost a lot."""
    n, longest = pattern.shape
    if not n:
        return (np.zeros(0, np.int64),) * 3
    far = np.int16(4 * longest)
    cell = np.arange(width, dtype=np.int16)
    # the first cell behind a row may end an empty prefix, so a cell is open if its place or the one before it is inside
    open_ = inside.copy()
    open_[:, 1:] |= inside[:, :-1]
    cost = np.where(open_[:, :width], np.int16(0), far)
    origin = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)) if trace else None
    done, end, began = np.full(n, int(far)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    wall = np.full((n, 1), far, np.int16)
    for i in range(longest):
        ok = inside[:, i : i + width]
        diag = np.where(ok, cost + (body[:, i : i + width] != pattern[:, i : i + 1]), far)
        # a needle byte without a text byte comes from one diagonal up
        up = np.concatenate([cost[:, 1:], wall], 1) + np.int16(1)
        new = np.minimum(diag, up) - cell
        # text bytes without needle bytes: the best cell to the left plus the distance
        lead = np.minimum.accumulate(new, axis=1)
        if trace:
            origin = np.where(up < diag, np.concatenate([origin[:, 1:], origin[:, -1:]], 1), origin)
            origin = np.take_along_axis(origin, np.maximum.accumulate(np.where(new == lead, cell, 0), axis=1).astype(np.int64), 1)
        cost = lead + cell
        last = m == i + 1
        if last.any():
            r = np.flatnonzero(last)
            c = cost[r].argmin(1)
            done[r], end[r] = cost[r, c], c + i + 1
            if trace:
                began[r] = origin[r, c]
    return done, end, began


def _none():
    return tuple(np.zeros(0, np.int64) for _ in range(5))


def places(index: Needles, data: np.ndarray, off: np.ndarray):
    """item, row, start and end byte in data, edits of every verified place, less those that overlap a better one of their needle."""
    text, new, place = plain(data, off)
    if not len(text):
        return _none()
    needle, row, start, end, edits = index.find(text, new)
    if index.tiny:  # needles shorter than a q-gram: searched for as they are
        raw, more = text.tobytes(), []
        for x in index.tiny:
            at = raw.find(index.text[x])
            while at >= 0:
                r = int(C.row_of(new, np.array([at]))[0])
                if at + len(index.text[x]) <= new[r + 1]:
                    more.append((x, r, at, at + len(index.text[x]), 0))
                at = raw.find(index.text[x], at + 1)
        if more:
            needle, row, start, end, edits = (np.concatenate([a, b]) for a, b in zip((needle, row, start, end, edits), np.array(more).T))
    order = np.lexsort([start, edits, row, needle])
    needle, row, start, end, edits = (x[order] for x in (needle, row, start, end, edits))
    one = _apart(needle, row, start, end)
    return np.array(index.item, np.int64)[needle[one]] if one.any() else np.zeros(0, np.int64), row[one], place[start[one]], place[np.maximum(end[one] - 1, start[one])] + 1, edits[one]


def _apart(needle, row, start, end) -> np.ndarray:
    """Places of a needle in a row that do not overlap a better one; rows are in order, the best place first."""
    keep = np.concatenate([[True], (needle[1:] != needle[:-1]) | (row[1:] != row[:-1])]) if len(needle) else np.zeros(0, bool)
    taken: list[tuple[int, int]] = []
    for i, (head, a, z) in enumerate(zip(keep.tolist(), start.tolist(), end.tolist())):
        if head:
            taken = [(a, z)]
        elif all(z <= x or a >= y for x, y in taken):
            taken.append((a, z))
            keep[i] = True
    return keep


BLOCK_SCHEMA = pa.schema([("item", pa.int64()), ("text", pa.binary())])


def blocks(benchmark: DataFrame, item: str, text: str) -> list[str]:
    """Files of the shared folder that hold the distinct items in blocks of about BLOCK_BYTES each; tasks write them, the driver
    gets their names. An item longer than a block is one of its own."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    folder = C.fresh(spark, "needles")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context, held, size, count = TaskContext.get(), [], 0, 0

        def put():
            # a task that runs again writes files of its own, and only the names of the one that counts come back
            path = f"{base}/block-{context.partitionId()}-{context.taskAttemptId()}-{count}"
            with fs.open_output_stream(path) as out, pa.ipc.new_stream(out, BLOCK_SCHEMA) as w:
                w.write_batch(pa.RecordBatch.from_pylist([{"item": i, "text": t} for i, t in held], BLOCK_SCHEMA))
            return pa.RecordBatch.from_pydict({"path": [path]})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode()
                if held and size + len(raw) > BLOCK_BYTES:
                    yield put()
                    held, size, count = [], 0, count + 1
                held.append((i, raw))
                size += len(raw)
        if held:
            yield put()

    dealt = rows.repartition(-(-size // BLOCK_BYTES), "item", "text").sortWithinPartitions("item", "text")
    return sorted(f"{folder}/{r.path.rsplit('/', 1)[-1]}" for r in dealt.mapInArrow(run, "path string").collect())


def scan(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, contaminated, n_items, items (sorted ids, null last), spans (item, start byte, end byte, edits) of every row of docs."""
    paths = blocks(benchmark, item, item_text)

    def run(batches):
        for whole in batches:
            data, off = C.utf8(whole.column(1))
            found = _found(paths, data, off)
            item, row, start, end, edits = (np.concatenate(x) for x in zip(*found)) if found else _none()
            none = item == NO_ITEM
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(len(off))).astype(np.int32)
            fields = [pa.array(item[order], mask=none[order]), *(pa.array(x[order]) for x in (start - off[row], end - off[row], edits))]
            spans = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, ["item", "start", "end", "edits"]))
            yield pa.RecordBatch.from_arrays([whole.column(0), spans], ["id", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "id long, spans array<struct<item:long,start:long,end:long,edits:long>>")
    return out.select(
        F.col("id").alias(key), (F.size("spans") > 0).alias("contaminated"), F.size(F.array_distinct("spans.item")).alias("n_items"),
        F.array_sort(F.array_distinct("spans.item")).alias("items"), F.array_sort("spans").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of docs, all columns, that hold no place of any item."""
    paths = blocks(benchmark, item, item_text)

    def run(batches):
        for whole in batches:
            data, off = C.utf8(whole.column(whole.schema.get_field_index(text)))
            free = np.ones(whole.num_rows, bool)
            for _, row, *_ in _found(paths, data, off):
                free[row] = False
            yield whole.filter(pa.array(free))

    return docs.mapInArrow(run, docs.schema)


#: Stands for the id of an item without one.
NO_ITEM = -(1 << 63)
_INDEXES: dict[str, Needles] = {}


def _index(path: str) -> Needles:
    """The needles of a block; a worker keeps one block."""
    if path not in _INDEXES:
        _INDEXES.clear()
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as r:
            t = r.read_all()
        items = zip(t.column("item").to_pylist(), t.column("text").to_pylist())
        _INDEXES[path] = Needles([(NO_ITEM if i is None else i, raw) for i, raw in items])
    return _INDEXES[path]


def _found(paths: list[str], data: np.ndarray, off: np.ndarray) -> list[tuple]:
    """Places of the items of all blocks in a batch: blocks outside, so that each is read once a batch."""
    found = []
    for path in paths:
        index = _index(path)
        for i, j in C.slices(off, 2 << 20):
            item, row, start, end, edits = places(index, data[off[i] : off[j]], off[i : j + 1] - off[i])
            if len(row):
                found.append((item, row + i, start + off[i], end + off[i], edits))
    return found
