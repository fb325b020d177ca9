"""Quality classifier: a support vector machine on Naive Bayes features.

N-gram indicators (words and word pairs, hashed to a fixed table) are scaled by the log ratio of their smoothed
counts in the two classes, rows are brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent. A logistic curve fitted on rows held out of that fit turns margins into scores.

The fit uses a bounded sample of labelled rows: SAMPLE of them with the smallest hash of their id. Scoring reads every
whole text. Null and empty texts score by the bias. Rows with a null label or id are not learned from. With no
labelled row the score is 0.5 everywhere, with one class only its smoothed share. Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

BITS = 18
SAMPLE = 8000
THRESHOLD = 0.7


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct n-gram of each row, in order of row."""
    low = C.LOWER[data]
    s, e = C.runs(C.KIND[low], off)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a run of one sign counts the same at any length
    e = np.where(C.KIND[low[s]] == 2, np.minimum(e, s + 1), e)
    h = C.mix(C.span_hash(C.prefix_hash(low), s, e))
    row = C.row_of(off, s)
    same = row[1:] == row[:-1]
    pair = C.mix(h[:-1] * np.uint64(3) + h[1:])[same]
    bucket = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    after = row[1:][same]
    pairs, times = np.unique(after << BITS | bucket(pair), return_counts=True)
    # indicators of repetition: a word after itself, pairs by how often they recur, and the share of distinct pairs
    n = len(off) - 1
    echo = (h[1:] == h[:-1])[same]
    often = pairs[times > 1] >> BITS
    level = np.log2(times[times > 1]).astype(np.uint64)
    total, kinds = np.bincount(after, minlength=n), np.bincount(pairs >> BITS, minlength=n)
    long = np.flatnonzero(total >= 8)
    share = (10 * kinds[long] // total[long]).astype(np.uint64)
    marks = [(after[echo], np.full(echo.sum(), 1, np.uint64)), (often, level + np.uint64(100)), (long, share + np.uint64(200)), (long, share + np.uint64(300)), (long, share + np.uint64(400))]
    key = np.concatenate([row << BITS | bucket(h), pairs, *(r << BITS | bucket(C.mix(m * np.uint64(0x9E3779B97F4A7C15))) for r, m in marks)])
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(rows: list[np.ndarray], y: np.ndarray, *, c: float = 1.0, epochs: int = 8, seed: int = 1) -> dict:
    """weights (table of 2^BITS), bias, and the slope and offset of the score's logistic curve."""
    n = len(rows)
    if not n or y.min() == y.max():
        share = 0.5 if not n else (y.sum() + 1) / (n + 2)
        return {"w": np.zeros(1 << BITS, np.float32), "bias": 0.0, "slope": 1.0, "offset": float(np.log(share / (1 - share)))}
    order = np.random.default_rng(seed).permutation(n)
    held, own = order[: n // 4], order[n // 4 :]
    if len({*y[own]}) < 2:
        held, own = order, order
    count = np.ones((2, 1 << BITS))
    for i in own:
        count[y[i], rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    w, bias, sign = np.zeros(1 << BITS), 0.0, np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, c * len(own) / (2 * max(1, (y[own] == 1).sum())), c * len(own) / (2 * max(1, (y[own] == 0).sum())))
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(own):
            r, v = rows[i], x[i]
            grad = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - grad / (v @ v + 1.0), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
    z = np.array([w[rows[i]] @ x[i] + bias for i in held])
    slope, offset = _logistic(z, y[held])
    return {"w": w * ratio, "ratio2": ratio * ratio, "bias": bias, "slope": slope, "offset": offset}


def _logistic(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Newton steps for slope and offset, towards smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * z + b)))
        d, g = p * (1 - p) + 1e-9, p - t
        h = np.array([[d @ (z * z) + 1e-3, d @ z], [d @ z, d.sum()]])
        da, db = np.linalg.solve(h, [g @ z + 1e-3 * a, g.sum()])
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return max(a, 0.0), b


def scores(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    row, bucket = features(data, off)
    z = np.bincount(row, model["w"][bucket], n)
    if "ratio2" in model:
        z = z / np.maximum(np.sqrt(np.bincount(row, model["ratio2"][bucket], n)), 1e-9)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (z + model["bias"]) + model["offset"], -50, 50)))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on at most sample labelled rows. The sample's ids are the only broadcast: their number is the bound."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(C.crc_mod("id", 4) != 2).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")

    def kernel(part, data, off):
        row, bucket = features(data, off)
        at = np.searchsorted(row, np.arange(len(off)))
        return {"id": part.column(0), "y": part.column(2), "f": [bucket[a:b].astype(np.int32) for a, b in zip(at[:-1], at[1:])]}

    got = C.map_texts(rows, "id long, y int, f array<int>", kernel).toArrow().sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
    return fit([np.asarray(x) for x in got["f"].to_numpy(zero_copy_only=False)], got["y"].to_numpy())


def score(docs: DataFrame, model: dict, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in model.items()})

    def kernel(part, data, off):
        return {"id": part.column(0), "score": scores(shared.value, data, off)}

    return C.map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id long, score double", kernel).withColumnRenamed("id", key)


def keep(docs: DataFrame, model: dict, *, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose text scores least or more."""
    shared = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in model.items()})
    return C.filter_texts(docs, lambda data, off: scores(shared.value, data, off) >= least, text=text)
