"""Word shingles of texts: exact hashes of their bytes, vectorised hashes for candidate search, and which are common."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

SEED, SHINGLE = 42, 5
MIXER = 0x9E3779B97F4A7C15
WHITE = np.where(C.KIND == 0, 0, 1).astype(np.uint8)
#: One of so many texts is looked at for common shingles, and most of these that are told apart.
SAMPLE, COMMON = 16, 200_000


def hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each k-word shingle, repeats included; fewer words: of the whole sequence; no word: none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    joined, dig = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return [dig(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    return [dig(joined[a:b], SEED) for a, b in zip((end - size).tolist(), end[k - 1 :].tolist())]


def shingles(data: np.ndarray, off: np.ndarray):
    """Hashes of shingles, offsets of rows in them, and starts, ends and offsets of words."""
    low = C.LOWER[data]
    s, e = C.runs(WHITE[low], off)
    at = np.searchsorted(s, off)
    h = C.mix(C.span_hash(C.prefix_hash(low), s, e))
    n = np.maximum(np.diff(at) - SHINGLE + 1, 0)
    new = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(new[-1]) + np.repeat(at[:-1] - new[:-1], n)
    x = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        x = x * np.uint64(MIXER) + h[first + k]
    return C.mix(x), new, s, e, at


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted shingles of each row; a row of fewer than SHINGLE words has one."""
    v, at, s, e, words = shingles(data, off)
    out = [np.unique(v[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    for r in np.flatnonzero((np.diff(at) == 0) & (np.diff(words) > 0)).tolist():
        out[r] = np.array(hashes(data[off[r] : off[r + 1]].tobytes(), SHINGLE), np.uint64)
    return out


def common_shingles(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a sample of the texts, and their counts. They only set the order of prefixes."""
    some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "text")
    each = C.map_texts(some, "h long", lambda part, data, off: {"h": np.concatenate(shingle_sets(data, off)).view(np.int64)}, limit=1 << 20)
    found = each.groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rarest_first(s: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Shingles in the order that all texts share: by their count in the sample, then by hash."""
    if not len(common):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, count[at], 0), kind="stable")]
