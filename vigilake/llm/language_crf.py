"""Language identification with a linear-chain conditional random field over words.

A word's emission scores add learned weights of its byte trigrams (bounded by the word's ends), of affixes of two and
four bytes, and of its entry in a lexicon of words seen in training. Learned transitions carry context, and
forward-backward gives each word's label distribution, so a text that switches language is labelled word by word. A
text's prediction is the label with the highest mean over its words, and the score is that mean.

The fit uses a bounded sample: about PER_LABEL texts of each label, the ones with the smallest hash of their id. Half of
its sequences join pieces of texts in different languages, which is where transitions between labels are learned from.
Prediction reads every whole text. A text that is null or has no letter is "und" with score 0, and so is every text
if nothing can be learned from. Repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

PER_LABEL = 400
BITS = 16
PIECE, PIECES = 16, 3
TRIGRAM, AFFIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals to small letters, in UTF-8."""
    low = C.LOWER[data]
    if len(low) > 1:
        big = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][big] += 0x20
    return low


def words(data: np.ndarray, off: np.ndarray):
    """Lower-case bytes, starts, ends and rows of words with a letter."""
    low = lowered(data)
    s, e = C.runs(np.where(C.KIND[low] == 1, 1, 0), off)
    letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) | (low >= 128))])
    keep = letter[e] > letter[s]
    s, e = s[keep], e[keep]
    return low, s, e, C.row_of(off, s)


class Features:
    """Buckets of one slice's words: trigrams by byte, affixes and lexicon entry by word."""

    def __init__(self, low, s, e, lexicon):
        size = e - s
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - s, size)
        b = low[at].astype(np.uint64)
        left, right = np.concatenate([[0], b[:-1]]).astype(np.uint64), np.concatenate([b[1:], [0]]).astype(np.uint64)
        left[first[:-1]] = 0
        right[first[1:] - 1] = 0
        self.first = first[:-1]
        self.tri = ((left << np.uint64(16) | b << np.uint64(8) | right) * TRIGRAM >> np.uint64(64 - BITS)).astype(np.int32)
        h = C.prefix_hash(low)
        bucket = lambda a, z, k: (C.mix(C.span_hash(h, a, z) + np.uint64(k * int(AFFIX) & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int32)
        self.affix = [bucket(s, np.minimum(s + k, e), k) for k in (2, 4)] + [bucket(np.maximum(e - k, s), e, k + 8) for k in (2, 4)]
        self.hash = C.mix(C.span_hash(h, s, e))
        self.lex = None if lexicon is None else _entry(lexicon, self.hash)

    def scores(self, m: dict) -> np.ndarray:
        out = np.add.reduceat(m["tri"][self.tri], self.first, axis=0) if len(self.first) else np.zeros((0, m["tri"].shape[1]), np.float32)
        for x in self.affix:
            out += m["affix"][x]
        return out + m["lex"][self.lex]


def _entry(lexicon: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in the lexicon; its last row is for unknown words."""
    if not len(lexicon):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return np.where(lexicon[at] == h, at, len(lexicon))


def forward_backward(score: np.ndarray, row: np.ndarray, n: int, trans: np.ndarray, pairs: bool = False):
    """Marginals of each word; row says which sequence it is in, in order. All sequences advance together."""
    length = np.bincount(row, minlength=n)
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    step = np.arange(len(row)) - start[row]
    count = np.bincount(step) if len(step) else np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum(count)])
    place = base[step] + rank[row]
    e = np.empty_like(score)
    e[place] = np.exp(score - score.max(1, keepdims=True))
    a = np.exp(trans).astype(score.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    bounds = list(zip(base[:-1].tolist(), base[1:].tolist()))
    for t, (i, j) in enumerate(bounds):
        x = e[i:j] if not t else (alpha[bounds[t - 1][0] : bounds[t - 1][0] + j - i] @ a) * e[i:j]
        alpha[i:j] = x / x.sum(1, keepdims=True)
    for t in range(len(bounds) - 2, -1, -1):
        i, (k, m) = bounds[t][0], bounds[t + 1]
        x = (e[k:m] * beta[k:m]) @ a.T
        beta[i : i + m - k] = x / x.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    moves = np.zeros_like(a, np.float64)
    if pairs:
        for t in range(1, len(bounds)):
            (i, j), p = bounds[t], bounds[t - 1][0]
            x = alpha[p : p + j - i, :, None] * a[None] * (e[i:j] * beta[i:j])[:, None, :]
            moves += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return post[place], moves


#: Most training sequences of a fit, drawn at random from those of the sample.
SEQUENCES = 6000


def fit(texts: list[bytes], langs: list[str], *, sequences: int = SEQUENCES, rounds: int = 40, rate: float = 0.25, seed: int = 3) -> dict | None:
    """Adam steps on the likelihood of sequences of PIECES pieces of PIECE words, sequences of them at most. Of equally likely labels the first by name wins."""
    names = sorted(set(langs))
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low, s, e, row = words(data, off)
    if not names or not len(s):
        return None
    label = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    ends = np.concatenate([np.flatnonzero(np.diff(row)) + 1, [len(row)]])
    pieces = [(i, min(i + PIECE, z)) for a, z in zip(np.concatenate([[0], ends[:-1]]), ends) for i in range(a, z, PIECE)]
    plain = [pieces[i : i + PIECES] for i in range(0, len(pieces), PIECES)]
    mixed = [pieces[i] for i in rng.permutation(len(pieces))]
    mixed = [mixed[i : i + PIECES] for i in range(0, len(mixed), PIECES)]
    chosen = [mixed[i] if rng.random() < 0.5 else plain[i] for i in rng.permutation(len(plain))[:sequences]]
    idx = np.concatenate([np.arange(a, z) for seq in chosen for a, z in seq])
    seq = np.repeat(np.arange(len(chosen)), [sum(z - a for a, z in c) for c in chosen])
    y = label[row[idx]]
    f = Features(low, s[idx], e[idx], None)
    kinds, times = np.unique(f.hash, return_counts=True)
    lexicon = kinds[times >= 3]
    f.lex = _entry(lexicon, f.hash)
    n, k = len(idx), len(names)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([f.first, [len(f.tri)]])))
    m = {"tri": np.zeros((1 << BITS, k), np.float32), "affix": np.zeros((1 << BITS, k), np.float32), "lex": np.zeros((len(lexicon) + 1, k), np.float32), "trans": np.zeros((k, k))}
    same = seq[1:] == seq[:-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    gold = np.eye(k, dtype=np.float32)[y]
    state = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in m.items()}
    spread = lambda at, g, size: np.stack([np.bincount(at, g[:, c], size) for c in range(k)], 1)
    for t in range(1, rounds + 1):
        post, moves = forward_backward(f.scores(m), seq, len(chosen), m["trans"], True)
        g = post - gold
        grads = {"tri": spread(f.tri, g[owner], 1 << BITS), "affix": sum(spread(x, g, 1 << BITS) for x in f.affix), "lex": spread(f.lex, g, len(lexicon) + 1), "trans": moves - seen}
        for name, d in grads.items():
            d = d + 1e-2 * m[name]
            u, v = state[name]
            u += 0.1 * (d - u)
            v += 0.01 * (d * d - v)
            m[name] -= (rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3)).astype(m[name].dtype)
    return m | {"lexicon": lexicon, "names": names}


def predict(m: dict, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Label and score of each row."""
    n = len(off) - 1
    low, s, e, row = words(data, off)
    if m is None or not len(s):
        return ["und"] * n, np.zeros(n)
    f = Features(low, s, e, m["lexicon"])
    post, _ = forward_backward(f.scores(m), row, n, m["trans"])
    total = np.stack([np.bincount(row, post[:, c], n) for c in range(post.shape[1])], 1)
    size = np.bincount(row, minlength=n)
    mean = total / np.maximum(size, 1)[:, None]
    best = mean.argmax(1)
    # bytes above 127 may be signs: rows without an ASCII letter are looked at as text
    ascii_letters = np.bincount(row, np.maximum.reduceat((low >= 97) & (low <= 122), s)[: len(s)], n) if len(s) else np.zeros(n)
    names = []
    for i in range(n):
        none = not size[i] or not ascii_letters[i] and not any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
        names.append("und" if none else m["names"][best[i]])
    return names, np.where([x == "und" for x in names], 0.0, np.clip(mean[np.arange(n), best], 0, 1))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 1, per_label: int = PER_LABEL) -> dict | None:
    """Fit on about per_label texts of each label, from rows whose crc32(id) mod 3 is not fold."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (C.crc_mod("id", 3) != fold))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(counts.items()) for x in (k, min(1.0, per_label / v)))), F.col("lang"))
    place = (F.shiftrightunsigned(F.xxhash64("id"), 11)) / F.lit(float(1 << 53))
    got = rows.where(place < share).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit([(x or "").encode() for x in got["text"].to_pylist()], got["lang"].to_pylist())


def label(docs: DataFrame, model: dict | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(part, data, off):
        names, score = predict(shared.value, data, off)
        return {"id": part.column(0), "lang_pred": names, "score": score.astype(np.float64)}

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return C.map_texts(rows, "id long, lang_pred string, score double", kernel, limit=1 << 20).withColumnRenamed("id", key)
