"""Shared plumbing of the training-data operators.

Python kernels receive Arrow batches and cut them into slices of a few MB, so a worker holds one slice
of work at a time whatever the batch size or the length of a text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI; one is set only where the session has none."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="vigilake-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to if "://" in set_to or set_to.startswith("file:") else f"file://{set_to}"


#: Folders that fresh() has named and sweep() has not deleted, in order.
_MADE: list[str] = []


def fresh(spark: SparkSession, what: str) -> str:
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def mark() -> int:
    """A point in time for sweep()."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the folders named after the mark, but for the one that keep reads: a stage's intermediate tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    kept = {path(f).getParent().toUri().getPath() for f in keep.inputFiles()}
    left = []
    for folder in _MADE[since:]:
        at = path(folder)
        if at.toUri().getPath() in kept:
            left.append(folder)
        else:
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[since:] = left


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path, schema = fresh(spark, what), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    if what != SMALL:
        # shuffle files of what has been written go once the driver's JVM has dropped its plan, which it may not do for hours by itself
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, never to be broadcast: Spark sizes what follows an explode, or is read from well
    packed files, far below its rows, and would gather and hash them on the driver."""
    return df.hint("merge")


#: The name of tables that are written once a round.
SMALL = "links"


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (a longer row stands alone) and 4096 rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + 4096)
        yield i, j
        i = j


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run meanwhile sends Arrow batches of about size bytes at most, where the session has no setting of its own. A batch is held
    by the JVM, in vectors that double as they grow, and by the worker together with the next one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    ours = spark.conf.get(name, None) is None
    if ours:
        spark.conf.set(name, size)
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(name)


def map_texts(df: DataFrame, schema: str, kernel: Callable, *, text: str = "text", limit: int = SLICE_BYTES, more: tuple[str, ...] = ()) -> DataFrame:
    """Run kernel(batch, data, off) -> RecordBatch | dict over slices of df; data and off are the text's bytes. The bytes of the
    columns in more count to a slice's limit too."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            data, off = utf8(whole.column(whole.schema.get_field_index(text)))
            for i, j in slices(sum((utf8(whole.column(whole.schema.get_field_index(c)))[1] for c in more), off), limit):
                part = whole.slice(i, j - i)
                got = kernel(part, data[off[i] : off[j]], off[i : j + 1] - off[i])
                for out in got if isinstance(got, list) else [got]:
                    yield pa.RecordBatch.from_arrays([out[k] if isinstance(out[k], pa.Array) else pa.array(out[k]) for k in names], names)

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, test: Callable, *, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Rows of df, all columns, for which test(data, off) of their slice is true."""

    def run(batches):
        for whole in batches:
            data, off = utf8(whole.column(whole.schema.get_field_index(text)))
            for i, j in slices(off, limit):
                yield whole.slice(i, j - i).filter(pa.array(test(data[off[i] : off[j]], off[i : j + 1] - off[i])))

    return df.mapInArrow(run, df.schema)


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n: the folds of the learned operators."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    global _POW, _INV
    if len(_POW) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("_POW", _BASE), ("_INV", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)
    return _POW, _INV


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes, n + 1 of them: H[j] - H[i] times the inverse power of i is the hash of data[i:j]."""
    pw, _ = powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * pw[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return (h[end] - h[start]) * inv[start]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", data.tobytes() + bytes(8), strides=(1,))


_LOW = np.concatenate([(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), [~np.uint64(0)]])


def same_words(wx: np.ndarray, start: np.ndarray, wy: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Whether size bytes from start and from other on are equal, by words_at() of both sides."""
    out = np.ones(len(start), bool)
    for at in range(0, size, 8):
        out &= (wx[start + at] ^ wy[np.minimum(other + at, len(wy) - 1)]) & _LOW[min(size - at, 8)] == 0
    return out


def same_bytes(x: np.ndarray, start: np.ndarray, y: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[start:start + size] and y[other:other + size] are equal, for each row: eight bytes a step."""
    wx = words_at(x)
    wy = wx if y is x else words_at(y)
    out = np.ones(len(start), bool)
    long_ = size > 256
    for i in np.flatnonzero(long_).tolist():
        out[i] = np.array_equal(x[start[i] : start[i] + size[i]], y[other[i] : other[i] + size[i]])
    live, at = np.flatnonzero(~long_ & (size > 0)), 0
    while len(live):
        left = _LOW[np.minimum(size[live] - at, 8)]
        out[live] &= (wx[start[live] + at] ^ wy[other[live] + at]) & left == 0
        at += 8
        live = live[size[live] > at]
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First span of each distinct content, and each span's number among these: by hash, then byte for byte."""
    h = mix(span_hash(prefix_hash(data), start, end) + (end - start).astype(np.uint64))
    _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    size, first = end - start, rep[inverse]
    alike = size == size[first]
    bad = np.flatnonzero(~alike | ~same_bytes(data, start, data, start[first], np.where(alike, size, 0)))
    if len(bad):  # other contents under one hash get numbers of their own
        raw, seen, more = data.tobytes(), {}, []
        for i in bad.tolist():
            key = raw[start[i] : end[i]]
            if key not in seen:
                seen[key] = len(rep) + len(more)
                more.append(i)
            inverse[i] = seen[key]
        rep = np.concatenate([rep, more])
    return rep, inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and bytes of non-ASCII characters, 2 the rest.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def runs(kind: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one kind other than 0, which never cross a row's bounds."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[off] = True
    b = np.flatnonzero(edge)
    keep = kind[b[:-1]] != 0
    return b[:-1][keep], b[1:][keep]


def row_of(off: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, pos, "right") - 1
