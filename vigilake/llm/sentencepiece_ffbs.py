"""SentencePiece encoding by forward filtering and backward sampling, and its lossless decoding.

The lattice of a text has its byte positions as nodes and vocabulary pieces as edges; a character without a piece of its
own is spelled with byte pieces. A segmentation's weight is the product of its pieces' probabilities to the power ALPHA,
where a piece of a merge vocabulary gets a probability by Zipf's law over its rank. Forward filtering sums the weights of
all paths to each node, and backward sampling draws one path, exactly in proportion to its weight.

No piece runs across the start of a run of spaces or a line end, so the lattice falls into segments that are filtered once
for each distinct segment of a slice. Draws come from a counter-based generator over seed, row key, segment and step: a row
gets the same segmentation in any partitioning. Decoding concatenates pieces and drops the leading space that encoding
adds; U+2581 in a text goes by bytes, so every text comes back as it was.

Null and empty texts have no ids and decode to the empty text. A null key counts as 0 in the seed. Rows with the same key
and text get the same ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

ALPHA, SEED, TABLE_BITS, DRAW = 0.5, 1, 20, 40
SPACE, LINE = 32, 10


class Pieces:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        self.raw: list[bytes] = []
        own, score = [], np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        for i, t in enumerate(text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.raw.append(bytes([int(t[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(t.replace("▁", " ").encode())
                own.append(i)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])]).astype(np.int64)
        self.words = C.words_at(self.flat)
        self.logp = -alpha * np.log(rank + 10.0)
        self.logp[self.byte[self.byte >= 0]] = -alpha * np.log(n + 10.0)
        ids = np.array(own)
        h = C.prefix_hash(self.flat)
        key = C.mix(C.span_hash(h, self.off[ids], self.off[ids + 1]))
        order = np.argsort(key)
        self.key, self.ident = key[order], ids[order].astype(np.int32)
        self.longest = int((self.off[ids + 1] - self.off[ids]).max())
        # keys are in order, so those of a slot (their top bits) stand together
        slot = (self.key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(slot).max())
        self.key = np.concatenate([self.key, np.full(self.crowd, self.key[-1] + np.uint64(1))])

    def edges(self, data: np.ndarray, seg: np.ndarray):
        """start, end, piece of every edge over the segments data[seg[i]:seg[i + 1]]."""
        n = len(data)
        last = np.repeat(seg[1:], np.diff(seg))
        h = C.prefix_hash(data)
        _, inv = C.powers(n + 1)
        found = []
        words = C.words_at(data)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        size = np.ones(n, np.int64)
        size[data >= 0xC0], size[data >= 0xE0], size[data >= 0xF0] = 2, 3, 4
        single = np.zeros(n, bool)
        for k in range(1, self.longest + 1):
            at = at[at + k <= last[at]]
            if not len(at):
                break
            code = C.mix((h[at + k] - h[at]) * inv[at])
            slot = self.table[(code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            some = np.flatnonzero(slot >= 0)
            slot, code, where = slot[some], code[some], at[some]
            for j in range(self.crowd):
                same = np.flatnonzero(self.key[slot + j] == code)
                ident = self.ident[slot[same] + j]
                sure = C.same_words(words, where[same], self.words, self.off[ident], k) & (self.off[ident + 1] - self.off[ident] == k)
                s, ident = where[same][sure], ident[sure]
                found.append((s, s + k, ident))
                single[s[size[s] == k]] = True
        # characters without a piece of their own: an edge for each byte
        bare = lead & ~single
        owner = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        b = np.flatnonzero(bare[owner])
        found.append((b, b + 1, self.byte[data[b]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def filtered(p: Pieces, data: np.ndarray, seg: np.ndarray):
    """Edges by end node: their start, piece and cumulative chance, and where each node's edges begin."""
    start, end, piece = p.edges(data, seg)
    owner = np.repeat(np.arange(len(seg) - 1), np.diff(seg))[start]
    # a segment's nodes are its positions and one end node of its own: segment i is shifted by i
    nodes = len(data) + len(seg) - 1
    order = np.argsort((end - seg[owner]) << 40 | (end + owner), kind="stable")
    owner, start, end, piece = owner[order], start[order], end[order], piece[order]
    s, e, step, w = start + owner, end + owner, end - seg[owner], p.logp[piece]
    total = np.full(nodes, -np.inf)
    total[seg[:-1] + np.arange(len(seg) - 1)] = 0.0
    group = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    width = np.diff(np.concatenate([group, [len(e)]]))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(step[group])) + 1, [len(group)]])
    chance = np.empty(len(s))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        a = int(group[i])
        z = a + int(width[i:j].sum())
        first, many = group[i:j] - a, width[i:j]
        v = total[s[a:z]] + w[a:z]
        top = np.maximum.reduceat(v, first)
        x = np.exp(v - np.repeat(top, many))
        mass = np.add.reduceat(x, first)
        total[e[group[i:j]]] = top + np.log(mass)
        chance[a:z] = x / np.repeat(mass, many)
    # whole numbers, so that sums do not depend on what else is in the slice
    run = np.concatenate([[0], np.cumsum(np.rint(chance * (1 << DRAW)).astype(np.int64))])
    chance = run[1:] - np.repeat(run[group], width)
    # the last edge of a node takes what rounding leaves
    chance[group + width - 1] = 1 << (DRAW + 1)
    begin = np.zeros(nodes, np.int64)
    begin[e[group]] = group
    return s, piece, chance, begin


def encode(p: Pieces, keys: np.ndarray, data: np.ndarray, off: np.ndarray, seed: int = SEED):
    """ids of all rows in one array, and the offsets of rows in it."""
    n = len(off) - 1
    size = np.diff(off)
    full = size > 0
    new = np.concatenate([[0], np.cumsum(size + full)])
    text = np.full(new[-1], SPACE, np.uint8)
    text[np.arange(len(data)) + np.repeat(new[:-1] + full - off[:-1], size)] = data
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    edge = np.zeros(len(text) + 1, bool)
    edge[1:-1] = (text[1:] == SPACE) & (text[:-1] != SPACE) | (text[1:] == LINE) | (text[:-1] == LINE)
    edge[new] = True
    b = np.flatnonzero(edge)
    begin, end = b[:-1], b[1:]
    rep, kind = C.distinct_spans(text, begin, end)
    length = (end - begin)[rep]
    seg = np.concatenate([[0], np.cumsum(length)])
    flat = text[np.arange(seg[-1]) + np.repeat(begin[rep] - seg[:-1], length)]
    s, piece, chance, first = filtered(p, flat, seg)
    row = C.row_of(new, begin)
    nth = np.arange(len(begin)) - np.searchsorted(row, np.arange(n))[row]
    key = C.mix(C.mix(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))[row] + nth.astype(np.uint64))
    home = seg[:-1] + np.arange(len(rep))
    live, node, stop = np.arange(len(begin)), home[kind] + length[kind], home[kind]
    drawn, step = [], 0
    while len(live):
        u = (C.mix(key[live] + np.uint64((step + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> np.uint64(64 - DRAW)).astype(np.int64)
        e = first[node]
        on = np.flatnonzero(chance[e] <= u)
        while len(on):
            e[on] += 1
            on = on[chance[e[on]] <= u[on]]
        drawn.append((live, piece[e]))
        node = s[e]
        more = node > stop
        live, node, stop = live[more], node[more], stop[more]
        step += 1
    count = np.zeros(len(begin), np.int64)
    for who, _ in drawn:
        count[who] += 1
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], np.int32)
    for k, (who, got) in enumerate(drawn):
        out[at[who + 1] - 1 - k] = got
    return out, at[np.searchsorted(row, np.arange(n + 1))]


def decode(p: Pieces, ids: np.ndarray, off: np.ndarray):
    """Bytes of all rows in one array, and the offsets of rows in it."""
    size = p.off[ids + 1] - p.off[ids]
    run = np.concatenate([[0], np.cumsum(size)])
    data = p.flat[np.arange(run[-1]) + np.repeat(p.off[ids] - run[:-1], size)]
    at = run[off]
    keep = np.ones(len(data), bool)
    keep[at[:-1][np.diff(at) > 0]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


#: Bytes of text that sample() segments at once, next to what other stages have left in an executor; ids do not depend on it.
SAMPLED = 2 << 20
_PIECES: dict = {}


def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


def _keys(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64)


def sample(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """key, ids: one sampled segmentation of every whole text."""

    def kernel(part, data, off):
        ids, at = encode(pieces(model, alpha), _keys(part.column(0)), data, off, seed)
        return {"id": part.column(0), "ids": pa.ListArray.from_arrays(at.astype(np.int32), ids)}

    return C.map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id long, ids array<int>", kernel, limit=SAMPLED).withColumnRenamed("id", key)


def restore(encoded: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: what the ids stand for."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            lists = b.column(1)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
            data, at = decode(p, flat, np.concatenate([[0], np.cumsum(size)]))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())], ["id", "text"])

    return encoded.select(F.col(key).cast("long").alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", key)


def digests(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_ids, ids_crc32 (of 32-bit little-endian ids), decoded_sha256 and whether the decoded bytes equal the text's."""

    def kernel(part, data, off):
        p = pieces(model)
        ids, at = encode(p, _keys(part.column(0)), data, off)
        back, pos = decode(p, ids, at)
        raw, own = back.tobytes(), data.tobytes()
        spans = list(zip(pos[:-1].tolist(), pos[1:].tolist(), off[:-1].tolist(), off[1:].tolist()))
        code = ids.astype("<u4").tobytes()
        return {
            "id": part.column(0), "n_ids": np.diff(at), "ids_crc32": [zlib.crc32(code[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
            "decoded_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b, _, _ in spans], "lossless": [raw[a:b] == own[c:d] for a, b, c, d in spans],
        }

    schema = "id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    return C.map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), schema, kernel).withColumnRenamed("id", key)
