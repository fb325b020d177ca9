"""FLAC columns: texts stored losslessly as mono 8-bit FLAC, decoded to PCM blocks with sample offsets.

Frames of a slice are coded together: prediction runs over a matrix of frames, and Rice codes of all frames are read in
lockstep, one sample of every frame a step. Streams hold a seek table with one point a frame, so any block of samples
can be decoded alone. Every frame's header (CRC-8) and body (CRC-16) is verified, and whole streams against their MD5.

encode() writes constant, verbatim, fixed and linear-predictor subframes with one Rice partition; decode() also reads
several partitions, both parameter sizes and escaped partitions. Streams of other channels or sample sizes are refused.

Null text counts as empty; a payload is never empty, as spaces fill it up to a positive multiple of UNIT. Repeated rows
are coded each, a null id stays null, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import common as C

UNIT, BLOCK, ORDER, PRECISION = 192, 1152, 4, 12


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        out.append(x)
    return np.array(out, np.uint16)


CRC8, CRC16 = _table(0x07, 8).tolist(), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = CRC8[x ^ b]
    return x


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for many spans at once; zeros before a span leave the register at its start value."""
    x = np.zeros(len(start), np.uint16)
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, longest = (end - size.max())[order], int(size.max())
    begin = np.searchsorted(-size[order], -np.arange(longest, 0, -1), "right")
    y = x[order]
    for t in range(longest):
        k = begin[t]
        v = y[:k]
        y[:k] = (v << np.uint16(8)) ^ CRC16[(v >> np.uint16(8)) ^ data[at[:k] + t]]
    x[order] = y
    return x


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE << (6 - len(tail))) & 0xFF | n, *tail[::-1]])


def _predict(x: np.ndarray, n: np.ndarray):
    """Quantised coefficients and shifts of linear predictors for frames in rows of x."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - j], f[:, j:]) for j in range(ORDER + 1)], 1).astype(np.float64)
    lag = np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER))
    m = r[:, lag] + np.eye(ORDER) * (1e-9 * r[:, :1, None] + 1e-6)
    c = np.linalg.solve(m, r[:, 1:, None])[:, :, 0]
    top = np.maximum(np.abs(c).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(top)).astype(np.int64), 0, 15)
    q = np.clip(np.rint(c * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int64)
    return q, shift


#: Frames that are coded or decoded together: what a worker holds beside a text and its stream does not grow with the text.
GROUP = 1024


def encode(rows: list[bytes]) -> list[bytes]:
    """One FLAC stream for each row of unsigned bytes; sample = byte - 128. Long rows are coded piece by piece."""
    step, pieces = GROUP * BLOCK, []
    for i, r in enumerate(rows):
        pieces += [(i, a) for a in range(0, len(r), step)]
    frames: list[list] = [[] for _ in rows]
    sizes: list[list] = [[] for _ in rows]
    at = 0
    while at < len(pieces):
        some, held = [], 0
        while at < len(pieces) and (not some or held < step):
            some.append(pieces[at])
            held += min(step, len(rows[pieces[at][0]]) - pieces[at][1])
            at += 1
        for (i, _), (body, size) in zip(some, _code([rows[i][a : a + step] for i, a in some], [a // BLOCK for _, a in some])):
            frames[i].append(body)
            sizes[i].append(size)
    out = []
    for r, body, size in zip(rows, frames, sizes):
        size = np.concatenate(size)
        pcm = (np.frombuffer(r, np.uint8) ^ np.uint8(0x80)).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(size.min()).to_bytes(3, "big") + int(size.max()).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(r)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points = np.zeros(len(size), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"] = np.arange(len(size)) * BLOCK, np.cumsum(size) - size
        points["n"] = np.minimum(BLOCK, len(r) - np.arange(len(size)) * BLOCK)
        seek = points.tobytes()
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, *body]))
    return out


def _code(rows: list[bytes], begin: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """The frames of each row and their sizes; begin has the number of each row's first frame."""
    size = np.array([len(r) for r in rows], np.int64)
    flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.int32) - 128
    base = np.concatenate([[0], np.cumsum(size)])
    per = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(rows)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = base[owner] + number * BLOCK
    number = number + np.array(begin, np.int64)[owner]
    n = np.minimum(BLOCK, base[owner + 1] - start)
    inside = np.arange(BLOCK) < n[:, None]
    x = np.zeros((len(n), BLOCK), np.int32)
    x[inside] = flat
    q, shift = _predict(x, n)
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, j + 1 :] += q[:, j : j + 1].astype(np.int32) * x[:, : BLOCK - j - 1]
    # kinds of subframe: fixed of order 0 and 1, then linear prediction
    tries = [(0, x), (1, np.diff(x, axis=1, prepend=0)), (ORDER, x - (guess >> shift[:, None].astype(np.int32)))]
    best = np.full(len(n), np.iinfo(np.int64).max)
    kind, rice, code = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros_like(x)
    for i, (order, e) in enumerate(tries):
        u = (e << 1) ^ (e >> 31)
        u[~inside] = 0
        u[:, :order] = 0
        m, over = n - order, 8 * order + (9 + ORDER * PRECISION if i == 2 else 0)
        near = np.floor(np.log2(np.maximum(u.sum(1) / np.maximum(m, 1) * 0.69, 1))).astype(np.int32)
        for k in (near, near + 1):
            bits = m * (k + 1) + (u >> k[:, None]).sum(1) + over
            better = (bits < best) & (m > 0)
            best, kind, rice = np.where(better, bits, best), np.where(better, i, kind), np.where(better, k, rice)
        code[kind == i] = u[kind == i]
    flatline = ((x == x[:, :1]) | ~inside).all(1)
    kind = np.where(flatline, 3, np.where(best + 10 >= 8 * n, 4, kind))
    order = np.array([0, 1, ORDER, 0, 0])[kind]

    heads, bodies = [], []
    for f in range(len(n)):
        m, whole = int(n[f]), int(n[f]) == BLOCK
        h = bytes([0xFF, 0xF8, 0x34 if whole else 0x74, 0x02]) + _number(int(number[f])) + (b"" if whole else struct.pack(">H", m - 1))
        heads.append(h + bytes([crc8(h)]))
        k, v, b = kind[f], 0, 0
        put = [((0b001000, 0b001001, 0b100000 | (ORDER - 1), 0, 1)[k] << 1, 8)]
        put += [(int(s) & 0xFF, 8) for s in x[f, : 1 if k == 3 else order[f]]]
        if k == 2:
            put += [(PRECISION - 1, 4), (int(shift[f]), 5), *((int(c) & ((1 << PRECISION) - 1), PRECISION) for c in q[f])]
        if k < 3:
            put += [(0, 6), (int(rice[f]), 4)]
        for value, bits in put:
            v, b = v << bits | value, b + bits
        bodies.append((v, b))
    coded = (kind < 3)[:, None] & inside & (np.arange(BLOCK) >= order[:, None])
    fr, col = np.nonzero(coded)
    u, k = code[fr, col], rice[fr]
    width = (u >> k) + 1 + k
    pre = np.array([8 * len(h) + b for h, (_, b) in zip(heads, bodies)])
    data_bits = np.bincount(fr, width, len(n)).astype(np.int64) + np.where(kind == 4, 8 * n, 0)
    total = (pre + data_bits + 7) // 8 + 2
    at = np.concatenate([[0], np.cumsum(total)])
    bit = np.zeros(8 * int(at[-1]), np.uint8)
    for f, (h, (v, b)) in enumerate(zip(heads, bodies)):
        pad = -b % 8
        raw = np.frombuffer(h + (v << pad).to_bytes((b + pad) // 8, "big"), np.uint8)
        p = 8 * int(at[f])
        bit[p : p + pre[f]] = np.unpackbits(raw)[: pre[f]]
        if kind[f] == 4:
            bit[p + pre[f] : p + pre[f] + 8 * n[f]] = np.unpackbits((x[f, : n[f]] & 0xFF).astype(np.uint8))
    run = np.cumsum(width) - width
    first = np.searchsorted(fr, np.arange(len(n)))
    lead = np.concatenate([run, [0]])[first]
    p = 8 * at[fr] + pre[fr] + run - lead[fr] + (u >> k)
    bit[p] = 1
    for j in range(int(k.max()) if len(k) else 0):
        some = np.flatnonzero(k > j)
        bit[p[some] + k[some] - j] = u[some] >> j & 1
    out = np.packbits(bit)
    crc = crc16(out, at[:-1], at[1:] - 2)
    out[at[1:] - 2], out[at[1:] - 1] = crc >> np.uint16(8), crc & np.uint16(255)

    raw, first = out.tobytes(), np.concatenate([[0], np.cumsum(per)])
    return [(raw[at[a] : at[z]], total[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist())]


def _layout(s: bytes) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
    """Start of the frames, number of samples, MD5, and each frame's byte and sample offsets."""
    if s[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    p, last, info, seek = 4, False, b"", b""
    while not last:
        last, kind, size = bool(s[p] & 0x80), s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
        body = s[p + 4 : p + 4 + size]
        info, seek = (body if kind == 0 else info), (body if kind == 3 else seek)
        p += 4 + size
    word = int.from_bytes(info[10:18], "big")
    if word >> 41 & 7 or (word >> 36 & 31) != 7:
        raise ValueError("only mono streams of 8 bits are read")
    points = np.frombuffer(seek, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
    if len(points) and points["n"].astype(np.int64).sum() == word & ((1 << 36) - 1):
        return p, word & ((1 << 36) - 1), info[18:34], points["offset"].astype(np.int64) + p, points["sample"].astype(np.int64)
    found, at = [], p  # without a point for each frame: frames start where a header checks out
    while (at := s.find(b"\xff\xf8", at)) >= 0:
        try:
            found.append((at, _head(s, at)[2]))
        except (ValueError, IndexError):
            pass
        at += 1
    step = int.from_bytes(info[0:2], "big")
    return p, word & ((1 << 36) - 1), info[18:34], np.array([a for a, _ in found], np.int64), np.array([k * step for _, k in found], np.int64)


def _head(s: bytes, at: int) -> tuple[int, int, int]:
    """Bytes of a frame header, block size and frame number."""
    if s[at] != 0xFF or s[at + 1] != 0xF8:
        raise ValueError(f"no frame at {at}")
    code, lead, p = s[at + 2] >> 4, s[at + 4], at + 5
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for _ in range(more):
        number = number << 6 | s[p] & 0x3F
        p += 1
    if code == 6:
        n, p = s[p] + 1, p + 1
    elif code == 7:
        n, p = (s[p] << 8 | s[p + 1]) + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(s[at + 2] & 15, 0)
    if crc8(s[at:p]) != s[p]:
        raise ValueError(f"header of the frame at {at} is damaged")
    return p + 1 - at, n, number


def decode(streams: list[bytes], only: list[tuple[int, int]] | None = None) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks (sample offset, samples as unsigned bytes). only: (stream, block) pairs to decode, checked by frame alone."""
    plans = [_layout(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    raw = b"".join(streams)
    data = np.frombuffer(raw + bytes(16), np.uint8)
    window = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    frames = []
    for i, (_, _, _, offs, samples) in enumerate(plans):
        ends = [*offs[1:].tolist(), len(streams[i])]
        for b, (a, z, first) in enumerate(zip(offs.tolist(), ends, samples.tolist())):
            if only is None or (i, b) in only:
                frames.append((i, b, int(base[i]) + a, int(base[i]) + z, first))
    out: list[list] = [[] for _ in streams]
    for k in range(0, len(frames), GROUP):
        some = frames[k : k + GROUP]
        for (i, _, _, _, first), block in zip(some, _blocks(some, raw, data, window)):
            out[i].append((first, block))
    for i, (_, total, md5, _, _) in enumerate(plans):
        if only is None:
            pcm = np.concatenate([b for _, b in out[i]]) if out[i] else np.zeros(0, np.uint8)
            if len(pcm) != total or hashlib.md5((pcm ^ np.uint8(0x80)).tobytes()).digest() != md5:
                raise ValueError("a stream's samples do not match its MD5")
    return out


def _blocks(frames: list[tuple], raw: bytes, data: np.ndarray, window: np.ndarray) -> list[np.ndarray]:
    """Samples of frames (stream, block, start, end, first sample), after a look at their checksums."""
    start, end = np.array([f[2] for f in frames]), np.array([f[3] for f in frames])
    crc = crc16(data, start, end - 2)
    if (crc != (data[end - 2].astype(np.uint16) << np.uint16(8) | data[end - 1])).any():
        raise ValueError("a frame's checksum does not match")
    n_frames = len(frames)
    n, order, pos = np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64), np.zeros(n_frames, np.int64)
    part, wide, shift = np.ones(n_frames, np.int64), np.full(n_frames, 4, np.int64), np.zeros(n_frames, np.int64)
    coded, coef, warm = np.zeros(n_frames, bool), np.zeros((n_frames, 32), np.int64), []
    for f, (_, _, a, z, _) in enumerate(frames):
        h, m, _ = _head(raw, a)
        n[f] = m
        v, left = int.from_bytes(raw[a + h : min(z, a + h + 128)], "big"), 8 * (min(z, a + h + 128) - a - h)
        used = 0

        def take(bits, signed=False):
            nonlocal used
            used += bits
            x = v >> (left - used) & ((1 << bits) - 1)
            return x - (1 << bits) if signed and x >> (bits - 1) else x

        kind = take(8) >> 1
        if kind == 0:
            warm.append(np.full(m, take(8, True)))
            continue
        if kind == 1:
            warm.append(np.frombuffer(raw, np.int8, m, a + h + 1))
            continue
        if 8 <= kind <= 12:
            o = kind - 8
            coef[f, :o] = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[o]
            warm.append(np.array([take(8, True) for _ in range(o)], np.int64))
        elif kind >= 32:
            o = kind - 31
            warm.append(np.array([take(8, True) for _ in range(o)], np.int64))
            bits = take(4) + 1
            shift[f] = take(5)
            coef[f, :o] = [take(bits, True) for _ in range(o)]
        else:
            raise ValueError("a reserved kind of subframe")
        order[f], coded[f] = o, True
        wide[f] = (4, 5)[take(2)]
        part[f] = m >> take(4)
        pos[f] = 8 * (a + h) + used
    x = np.zeros((int(n.max()), n_frames), np.int64)
    for f, w in enumerate(warm):
        x[: len(w), f] = w
    todo = np.flatnonzero(coded)
    todo = todo[np.argsort(-n[todo], kind="stable")]
    _residuals(x, window, todo, n, order, pos, part, wide, coef, shift)
    return [((x[: n[f], f] + 128) & 0xFF).astype(np.uint8) for f in range(n_frames)]


def _peek(window, pos, bits):
    """The next bits (under 57, over 0) at each bit position."""
    w = window[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
    return (w >> (64 - bits).astype(np.uint64)).astype(np.int64)


def _residuals(x, window, todo, n, order, pos, part, wide, coef, shift) -> None:
    """Rice codes and prediction for frames todo (longest first), a sample of each a step, into columns of x."""
    if not len(todo):
        return
    n, order, p, part, wide, coef, shift = n[todo], order[todo], pos[todo].copy(), part[todo], wide[todo], coef[todo], shift[todo]
    top, y = int(order.max()), np.ascontiguousarray(x[:, todo])
    k, esc = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
    split = bool((part < n).any())
    active = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    for t in range(int(n[0])):
        m = int(active[t])
        who = slice(0, m) if t >= top else np.flatnonzero(order[:m] <= t)
        new = np.arange(m)[who][(order[who] == t) | (t % part[who] == 0)] if split or t <= top else ()
        if len(new):
            k[new] = _peek(window, p[new], wide[new])
            p[new] += wide[new]
            raw = new[k[new] == (1 << wide[new]) - 1]
            esc[new] = 0
            if len(raw):
                esc[raw] = _peek(window, p[raw], np.full(len(raw), 5)) + 1
                p[raw] += 5
        at, kk = p[who], k[who]
        w = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        quot = zeros.copy()
        far = np.flatnonzero(zeros >= 50)
        while len(far):  # a long run of zeros: look on from where it stands
            v = window[(at[far] + quot[far]) >> 3].astype(np.uint64) << ((at[far] + quot[far]) & 7).astype(np.uint64)
            z = 53 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
            quot[far] += z
            far = far[z >= 50]
        at = at + quot + 1
        w = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        u = quot << kk | ((w >> np.uint64(1)) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        e = (u >> 1) ^ -(u & 1)
        at = at + kk
        if (odd := esc[who] > 0).any():
            bits = esc[who][odd] - 1
            v = np.where(bits > 0, _peek(window, p[who][odd], np.maximum(bits, 1)), 0)
            e[odd] = np.where(v >> np.maximum(bits - 1, 0) & (bits > 0), v - (1 << bits), v)
            at[odd] = p[who][odd] + bits
        p[who] = at
        guess = 0
        for j in range(min(top, t)):
            guess = guess + coef[who, j] * y[t - 1 - j, who]
        y[t, who] = e + (guess >> shift[who])
    x[:, todo] = y


def payload(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) if len(text) < UNIT else -len(text) % UNIT)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, crossings of the mean and distinct levels of decoded samples."""
    count, level = np.bincount(samples, minlength=256), np.arange(256) - 128
    mean = float((count * level).sum()) / len(samples)
    dev = float((count * (level - mean) ** 2).sum() / len(samples)) ** 0.5
    side = samples > np.uint8(min(max(int(np.floor(mean)) + 128, 0), 255))
    return f"mean={mean:.4f};dev={dev:.4f};cross={int((side[1:] != side[:-1]).sum())};levels={int((count > 0).sum())}"


def media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, flac: the size and the stored form of every whole text."""

    def kernel(part, data, off):
        raw = data.tobytes()
        return {"id": part.column(0), "n_bytes": np.diff(off), "flac": encode([payload(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])}

    return C.map_texts(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id long, n_bytes long, flac binary", kernel, limit=1 << 20).withColumnRenamed("id", key)


def pcm_blocks(stored: DataFrame, *, key: str = "doc_id", column: str = "flac") -> DataFrame:
    """key, block, sample_offset, pcm (signed 8-bit): one row a frame of each stream. A null stream has no rows."""

    def kernel(part, data, off):
        raw = data.tobytes()
        full = [i for i in range(part.num_rows) if off[i + 1] > off[i]]
        rows = [(part["id"][i].as_py(), b, first, (x ^ np.uint8(0x80)).tobytes()) for i, found in zip(full, decode([raw[off[i] : off[i + 1]] for i in full])) for b, (first, x) in enumerate(found)]
        return {name: [r[c] for r in rows] for c, name in enumerate(("id", "block", "sample_offset", "pcm"))}

    return C.map_texts(stored.select(F.col(key).cast("long").alias("id"), F.col(column).alias("flac")), "id long, block long, sample_offset long, pcm binary", kernel, text="flac", limit=1 << 20).withColumnRenamed("id", key)


def digests(stored: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key and what describes the decoded samples and the stored form of each row of a stored media() table."""

    def kernel(part, data, off):
        raw, at = data.tobytes(), off.tolist()
        streams = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
        back = [np.concatenate([x for _, x in found]) for found in decode(streams)]
        return {
            "id": part.column(0), "n_bytes": part.column(1), "payload_bytes": [len(b) for b in back], "payload_sha256": [hashlib.sha256(b.tobytes()).hexdigest() for b in back],
            "tail_crc32": [zlib.crc32(b[-16:].tobytes()) for b in back], "media_bytes": [len(s) for s in streams],
            "media_sha256": [hashlib.sha256(s).hexdigest() for s in streams], "feature": [feature(b) for b in back],
        }

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = stored.select(F.col(key).cast("long").alias("id"), "n_bytes", "flac")
    return C.map_texts(rows, schema, kernel, text="flac", limit=1 << 20).withColumnRenamed("id", key)
