"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard file holds records in ascending key order. A record is

    length  u64 | masked crc of the length  u32 | payload | masked crc of the payload  u32

and a payload is the key (flag u8, i64) followed by the ids (u16 where the vocabulary allows it, else u32). The
checksum is CRC-32 rotated right by 15 bits plus a constant, so that a checksum of framed data differs from the
stored one. Beside shard-N.rec lies shard-N.idx: for each record its byte offset and token count (two u64), so a
reader can fetch any record of any shard by one seek.

Null text counts as empty (it gets the end id alone). A null key sorts first and comes back as null. Repeated keys
keep one record a row, ordered by text. An empty table gives one empty result. Other columns are ignored.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

#: Most entries that a worker keeps of words it has encoded.
WORDS = 900_000
HEAD_BYTES, KEY_BYTES = 12, 9


def key_bytes(key: int | None) -> bytes:
    return struct.pack("<?q", key is None, key or 0)


def key_of(payload: bytes) -> int | None:
    null, key = struct.unpack_from("<?q", payload)
    return None if null else key


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(buf, at: int) -> tuple[bytes, int]:
    """The payload at a byte offset and the offset behind it; raises on any damage."""
    if len(buf) - at < HEAD_BYTES:
        raise ValueError(f"record at {at} is cut short")
    size, crc = struct.unpack_from("<QI", buf, at)
    if masked(bytes(buf[at : at + 8])) != crc:
        raise ValueError(f"length of the record at {at} is damaged")
    payload = bytes(buf[at + 12 : at + 12 + size])
    if len(payload) < size or masked(payload) != int.from_bytes(buf[at + 12 + size : at + 16 + size], "little"):
        raise ValueError(f"record at {at} is damaged")
    return payload, at + 16 + size


#: 0 parts units and gives no id; no token runs between 1 (ASCII letters and digits) and 2 (ASCII signs but the apostrophe).
UNIT = np.full(256, 3, np.uint8)
UNIT[33:127] = 2
UNIT[48:58] = UNIT[65:91] = UNIT[97:123] = 1
UNIT[39] = 3
UNIT[[10, 32]] = 0


#: The normalizer and the split for which UNIT holds; any other tokenizer gets whole texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_into_units(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, ignores case and never joins a letter and a sign."""
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0].get("pattern") == {"Regex": SPLIT} and before[0].get("invert") is True and before[0].get("behavior") == "Removed"
    plain = all(b.get("type") == "ByteLevel" and not b.get("use_regex", True) and not b.get("add_prefix_space", True) for b in before[1:])
    return (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and split and plain and not (spec.get("model") or {}).get("dropout")


class Encoder:
    """Ids of texts, as the library gives them for each whole text.

    Where the tokenizer file says that texts fall into units which no token crosses (parts_into_units), each distinct unit is
    encoded once a slice, and WORDS of them are kept; units are told apart byte by byte. Rows that hold the name of one of the
    vocabulary's added tokens, and all rows under any other tokenizer file, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.units = parts_into_units(json.loads(self.tok.to_str()))
        self.known: dict[bytes, bytes] = {}
        # in lower case, as an added token may be looked up in normalised text
        self.added = [C.LOWER[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in self.tok.get_added_tokens_decoder().values()]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in one array, and the offsets of rows in it."""
        n, rows = len(data), len(off) - 1
        if not n:
            return np.zeros(0, self.width), np.zeros(rows + 1, np.int64)
        if not self.units:
            each = [self._whole(data[off[k] : off[k + 1]]) for k in range(rows)]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        low = C.LOWER[data]
        kind = UNIT[low]
        edge = np.ones(n + 1, bool)
        product = kind[1:] * kind[:-1]
        edge[1:n] = (product == 0) | (product == 2)
        edge[off] = True
        b = np.flatnonzero(edge)
        own = kind[b[:-1]] > 0
        s, e = b[:-1][own], b[1:][own]
        rep, inverse = C.distinct_spans(low, s, e)
        raw = low.tobytes()
        units = [raw[i:j] for i, j in zip(s[rep].tolist(), e[rep].tolist())]
        new = [w for w in units if w not in self.known]
        if len(self.known) + len(new) > WORDS:
            self.known, new = {}, units
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for w, got in zip(some, self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.known[w] = array.array("H" if self.width == "<u2" else "I", got.ids).tobytes()
        codes = [self.known[w] for w in units]
        flat = np.frombuffer(b"".join(codes), self.width)
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // flat.itemsize
        start = np.concatenate([[0], np.cumsum(size)])
        many = size[inverse]
        run = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.arange(run[-1]) + np.repeat(start[inverse] - run[:-1], many)]
        cut = run[np.searchsorted(s, off)]
        whole = sorted({C.row_of(off, m.start()) for t in self.added for m in re.finditer(re.escape(t), raw)})
        if not whole:
            return ids, cut
        each = np.split(ids, cut[1:-1])
        for k in whole:
            each[k] = self._whole(data[off[k] : off[k + 1]])
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def _whole(self, text: np.ndarray) -> np.ndarray:
        return np.array(self.tok.encode(text.tobytes().decode(), add_special_tokens=False).ids, self.width)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _put(fs, path: str, own: str, write) -> None:
    """Write under a name of this attempt's own, then move into place: a repeated task replaces whole files."""
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, path)


def write(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encode texts, append end_id to each and write shards in ascending key order; one dict a shard, in order."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches):
        enc, context = encoder(vocabulary), TaskContext.get()
        shard = context.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, own = f"{base}/shard-{shard:06d}", f"{base}/.attempt-{context.taskAttemptId()}-{shard:06d}"
        tokens, at, index = 0, 0, []
        end = np.array([end_id], enc.width).tobytes()
        item = len(end)
        with fs.open_output_stream(f"{own}.rec") as out:
            for whole in batches:
                data, off = C.utf8(whole.column(1))
                for i, j in C.slices(off):
                    ids, cut = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    raw, cut = ids.tobytes(), (cut * item).tolist()
                    for k, a, z in zip(whole.column(0)[i:j].to_pylist(), cut[:-1], cut[1:]):
                        body = raw[a:z]
                        rec = frame(key_bytes(k) + body + end)
                        out.write(rec)
                        index.append((at, len(body) // item + 1))
                        at += len(rec)
                        tokens += len(body) // item + 1
        fs.move(f"{own}.rec", f"{name}.rec")
        _put(fs, f"{name}.idx", f"{own}.idx", lambda out: out.write(np.array(index, "<u8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{name}.rec"], "records": [len(index)], "tokens": [tokens], "bytes": [at], "item": [item]})

    done = rows.mapInArrow(run, "shard long, path string, records long, tokens long, bytes long, item long").collect()
    found, start = [], 0
    for r in sorted(done, key=lambda r: r.shard):
        found.append({**r.asDict(), "start": start})
        start += r.tokens
    return found


def read(spark, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files alone; checksums are verified."""
    plan = spark.createDataFrame([(s["path"], s["start"], s["item"]) for s in shards] or [("", 0, 2)], "path string, start long, item int").where("path <> ''")

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start, item in zip(*(c.to_pylist() for c in b.columns)):
                out = []
                with fs.open_input_stream(path) as f:
                    while head := f.read(HEAD_BYTES):
                        size = int.from_bytes(head[:8], "little")
                        payload, _ = unframe(head + (f.read(size + 4) if masked(head[:8]) == int.from_bytes(head[8:], "little") else b""), 0)
                        ids = np.frombuffer(payload, f"<u{item}", offset=KEY_BYTES)
                        out.append((key_of(payload), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    return plan.repartition(max(1, len(shards)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(folder: str, shard: dict, record: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard through its index: its key and ids."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(shard["path"].replace(".rec", ".idx")) as f:
        at = int.from_bytes(f.read_at(8, 16 * record), "little")
    with fs.open_input_file(shard["path"]) as f:
        size = int.from_bytes(f.read_at(8, at), "little")
        payload, _ = unframe(f.read_at(size + 16, at), 0)
    return key_of(payload), np.frombuffer(payload, f"<u{shard['item']}", offset=KEY_BYTES).astype(np.uint32)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
