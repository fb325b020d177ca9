"""Every operator against a brute-force version or an exact round trip, on a small table with the awkward cases in it."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from vigilake.llm import common as C
from vigilake.llm import compact_windows, decontaminate, flac, language_crf, license_scan, linking, quality_nbsvm, sentencepiece_ffbs, shingles, simhash, suffix_dedup, token_records

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, segs string"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(n))


LINE = prose(99, 70)
TEXTS = {
    1: prose(1, 200), 2: None, 3: "", 4: "   \n\t ", 5: prose(1, 200), 6: prose(2, 100) + "\n" + LINE + "\n" + prose(3, 90), 7: LINE + " " + prose(4, 120),
    8: "été Ça ß 日本語 😀 ▁ \x00 don't a,b;c", 9: "word " * 300, 10: prose(5, 3000), 11: prose(1, 200).replace(" ", " x ", 1), 12: "Released under the MIT License.", 13: "---",
}


@pytest.fixture(scope="module")
def docs(spark):
    """Columns id, fp and segs clash with names that operators use inside."""
    rows = [(k, v, "en", "s", 0, 7, 7, "x") for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Repeated rows and a null id on top."""
    more = spark.createDataFrame([(1, TEXTS[1], None, None, None, 0, 0, None), (None, TEXTS[1], None, None, None, 0, 0, None), (None, None, None, None, None, 0, 0, None)], SCHEMA)
    return docs.unionAll(more)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def raw(k):
    return (TEXTS[k] or "").encode()


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(200, 240)]
    want = groups({x for p in links if p[0] != p[1] for x in p}, links)
    assert dict(linking.components(spark.createDataFrame(links, "a long, b long")).collect()) == want
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentencepiece_is_lossless_and_reproducible(docs, odd, empty):
    ids = {r.doc_id: r.ids for r in sentencepiece_ffbs.sample(docs, PIECES).collect()}
    assert {r.doc_id: r.text for r in sentencepiece_ffbs.restore(sentencepiece_ffbs.sample(docs, PIECES), PIECES).collect()} == {k: v or "" for k, v in TEXTS.items()}
    assert {r.doc_id: r.ids for r in sentencepiece_ffbs.sample(docs.coalesce(1), PIECES).collect()} == ids
    assert ids[2] == ids[3] == [] and ids[1] != ids[5]
    got = sentencepiece_ffbs.digests(odd, PIECES).collect()
    assert len(got) == odd.count() and all(r.lossless for r in got)
    assert sentencepiece_ffbs.digests(empty, PIECES).count() == 0


def test_sentencepiece_samples_in_proportion():
    p, n, word = sentencepiece_ffbs.pieces(PIECES), 20000, b"tokens"
    own = {r: i for i, r in enumerate(p.raw) if i >= 259 and r}

    def paths(s):
        return [((), 0.0)] if not s else [((own[s[:k]], *q), p.logp[own[s[:k]]] + v) for k in range(1, len(s) + 1) if s[:k] in own for q, v in paths(s[k:])]

    all_ = paths(b" " + word)
    total = sum(math.exp(v) for _, v in all_)
    ids, at = sentencepiece_ffbs.encode(p, np.arange(n), np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word))
    seen = collections.Counter(tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n))
    assert max(abs(seen[q] / n - math.exp(v) / total) for q, v in all_) < 0.02 and sum(seen.values()) == sum(seen[q] for q, _ in all_)


def test_decontamination(spark, docs, odd, empty):
    item, rng = prose(50, 60), np.random.default_rng(1)
    words = item.split()
    for i in rng.choice(len(words), 3, replace=False):
        words[i] = "qqq"
    bench = spark.createDataFrame([(0, item), (1, "tiny"), (2, None), (3, ""), (4, prose(51, 30))], "item_id long, text string")
    more = spark.createDataFrame([(100, prose(60, 50) + " " + item.upper() + "! " + prose(61, 20)), (101, prose(62, 40) + ", " + " ".join(words)), (102, "a tiny thing"), (103, "tinyish"), (104, prose(63, 400))], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.scan(more, bench).collect()}
    assert got == {100: [0], 101: [0], 102: [1], 103: [], 104: []}
    assert {r.doc_id for r in decontaminate.clean(more, bench).collect()} == {103, 104}
    assert not any(r.contaminated for r in decontaminate.scan(odd, bench).collect()) and decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_equals_brute_force():
    def least(needle, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(needle, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng, hits = np.random.default_rng(4), 0
    for _ in range(40):
        needle = prose(int(rng.integers(1 << 30)), 9)[:60].encode()
        body = bytearray(needle)
        for _ in range(rng.integers(0, 12)):
            k = int(rng.integers(len(body)))
            body[k : k + int(rng.integers(2))] = bytes([97 + int(rng.integers(20))]) * int(rng.integers(2))
        text = (prose(int(rng.integers(1 << 30)), 20) + " ").encode() + bytes(body) + b" " + prose(5, 10).encode()
        index = decontaminate.Needles([(0, needle)])
        got = len(decontaminate.places(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]) > 0
        plain = lambda x: decontaminate.plain(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].tobytes()
        assert got == (least(plain(needle), plain(text)) <= index.edits[0])
        hits += got
    assert 5 < hits < 40


def test_token_records(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(WORDS), 0
    folder = f"file://{tmp_path}/a"
    shards = token_records.write(docs, folder, WORDS, shards=3)
    got = {r.doc_id: r for r in token_records.read(spark, folder, shards).collect()}
    for k in sorted(TEXTS):
        ids = [*tok.encode(TEXTS[k] or "", add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    full = next(s for s in shards if s["records"])
    key, ids = token_records.read_at(folder, full, full["records"] - 1)
    assert len(ids) == got[key].n_tokens
    path = full["path"]
    body = bytearray(open(path, "rb").read())
    body[20] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(bytes(body), 0)
    again = f"file://{tmp_path}/b"
    assert token_records.read(spark, again, token_records.write(odd, again, WORDS)).count() == odd.count()
    assert token_records.read(spark, again, token_records.write(empty, f"file://{tmp_path}/c", WORDS)).count() == 0


def test_simhash(docs, odd, empty):
    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = {k: fingerprint(v or "") for k, v in TEXTS.items()}
    want = groups(f, [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    assert {k: r.fp % 2**64 for k, r in got.items()} == f and {k: r.component for k, r in got.items()} == want
    assert simhash.groups(odd).count() == odd.count() and simhash.groups(empty).count() == 0


def test_multi_index_hashing_finds_every_pair(spark):
    rng, ids = np.random.default_rng(5), []
    for c in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        ids += [c] + [c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(25)]
    f = dict(enumerate(ids))
    want = groups(f, [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2])
    nodes = spark.createDataFrame([(k, v - 2**64 if v >= 2**63 else v) for k, v in f.items()], "id long, f long")
    nodes = nodes.selectExpr("id", "f", "array(f & 4294967295, shiftrightunsigned(f, 32)) AS segs")
    got = dict(linking.components(linking.link_buckets(C.cut(simhash.meet(nodes, 32)), simhash.within(2))).collect())
    assert {k: got.get(k, k) for k in f} == want


def test_near_copies(docs, odd):
    s = {k: simhash.shingle_set(v) for k, v in TEXTS.items()}
    want = groups(s, [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    assert dict(simhash.near_copies(docs).select("doc_id", "component").collect()) == want
    assert want[11] == 1 and simhash.near_copies(odd).count() == len(TEXTS) + 1


def test_compact_windows_of_one_text():
    v = C.mix(np.random.default_rng(1).integers(0, 400, 900, dtype=np.uint64))
    row, c, lo, hi, token = compact_windows.windows(v, np.array([0, 300, 310, 900]))
    got = set(zip(row.tolist(), c.tolist(), lo.tolist(), hi.tolist()))
    want = set()
    for r, (a, z) in enumerate(((0, 300), (300, 310), (310, 900))):
        w = [(int(x) & ~int(compact_windows.PLACE), i) for i, x in enumerate(v[a:z])]
        for i in range(z - a):
            p = q = i
            while p and w[p - 1] > w[i]:
                p -= 1
            while q + 1 < z - a and w[q + 1] > w[i]:
                q += 1
            if q - p + 1 >= compact_windows.LEAST:
                want.add((r, i, p, q))
    assert got == want


def test_passages(docs, odd, empty):
    got = {r.doc_id: r for r in compact_windows.classes(docs).collect()}
    assert {k: r.class_id for k, r in got.items()} == {k: {5: 1, 11: 1, 7: 6}.get(k, k) for k in TEXTS}
    assert got[10].n_links == 0 and got[7].n_links == 1 and got[7].passages[0].start <= 2 and got[7].passages[0].end >= 68
    assert compact_windows.classes(odd).count() == odd.count() and compact_windows.classes(empty).count() == 0


def test_flac(docs, odd, empty):
    got = {r.doc_id: r for r in flac.digests(C.cut(flac.media(docs))).collect()}
    for k in TEXTS:
        body = flac.payload(raw(k))
        assert len(body) % 192 == 0 and len(body) > 0 and body.rstrip(b" ") == raw(k).rstrip(b" ")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw(k)), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]))
    blocks = collections.defaultdict(dict)
    for r in flac.pcm_blocks(flac.media(docs)).collect():
        blocks[r.doc_id][r.sample_offset] = bytes(b ^ 0x80 for b in r.pcm)
    assert {k: b"".join(v[o] for o in sorted(v)) for k, v in blocks.items()} == {k: flac.payload(raw(k)) for k in TEXTS}
    assert flac.digests(flac.media(odd)).count() == odd.count() and flac.digests(flac.media(empty)).count() == 0
    stream = flac.encode([flac.payload(raw(10))])[0]
    first, part = flac.decode([stream], only=[(0, 2)])[0][0]
    assert first == 2 * flac.BLOCK and part.tobytes() == flac.payload(raw(10))[first : first + flac.BLOCK]
    bad = bytearray(stream)
    bad[-50] ^= 8
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])


def test_flac_noise_and_missing_seek_table():
    rng = np.random.default_rng(2)
    rows = [flac.payload(x) for x in (b"", bytes(range(256)) * 9, rng.integers(0, 256, 4000, dtype=np.uint8).tobytes(), b"a" * 3000 + b"\xff" * 9 + b"\0" * 2000)]
    streams = flac.encode(rows)
    bare = []
    for s in streams:
        size = int.from_bytes(s[43:46], "big")
        bare.append(s[:4] + b"\x80" + s[5:42] + s[46 + size :])
    for some in (streams, bare):
        assert [b"".join(x.tobytes() for _, x in found) for found in flac.decode(some)] == rows


def removed(texts, n=100):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(b[i : i + n])
        edges = np.diff(np.concatenate([[0], gone, [0]]).astype(int))
        out[k] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, odd, empty):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    assert got == removed(TEXTS)
    assert suffix_dedup.digests(odd).count() == odd.count() and suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_in_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 2)
    line = prose(7, 12)[:70]
    texts = {k: prose(k, 30) + line + prose(k % 5, 40) + line * (k % 3) for k in range(40)}
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == removed(texts)


def test_suffix_sort_is_the_order_of_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    start = np.sort(rng.choice(2800, 700, replace=False))
    bucket = np.sort(rng.integers(0, 5, 700))
    order = suffix_dedup.Suffixes(data).sort(start, bucket)
    text = data.tobytes()
    want = sorted(range(700), key=lambda i: (bucket[i], text[start[i] : start[i] + 100], i))
    assert order.tolist() == want


def test_license_scan(docs, odd, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs, {license_scan.digest_py("Copyright 2020 X\nUse this Licence, freely!"): "Own"}).collect()}
    assert got[12].license == "MIT" and got[12].notices == "MIT" and got[1].license is None and got[1].notices == ""
    more = docs.sparkSession.createDataFrame([(1, "use this LICENSE -- freely"), (2, "first\nReleased under the MIT Licence\nlast")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(more, {license_scan.digest_py("Copyright 2020 X\nUse this Licence, freely!"): "Own"}).collect()}
    assert got == {1: ("Own", "Own"), 2: (None, "MIT")}
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


WORDS_OF = {"aa": "la le lo lu".split(), "bb": "ka ke ko ku".split()}


def test_language(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS_OF[lang], 30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    train = spark.createDataFrame(rows + [(900, "la la", None), (None, "la", "zz")], "doc_id long, text string, lang string")
    model = language_crf.train(train)
    assert model["names"] == ["aa", "bb"]
    test = spark.createDataFrame([(1, "la lo la"), (2, "ke KU ka"), (3, None), (4, "12 —"), (5, "la " * 20 + "ka " * 90)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.label(test, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "bb"} and all(0 <= v[1] <= 1 for v in got.values()) and got[5][1] < 0.95
    assert language_crf.train(empty) is None and language_crf.label(docs, None).where("lang_pred <> 'und'").count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    score, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    post, _ = language_crf.forward_backward(score, np.zeros(5, int), 1, trans)
    want = np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        w = math.exp(sum(score[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        for i, k in enumerate(y):
            want[i, k] += w
    assert np.allclose(post, want / want.sum(1, keepdims=True))


def test_quality(spark, docs, odd, empty):
    rows = [(i, prose(i, 40) if i % 4 else "spam!! " * 20) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(200)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_nbsvm.train(train, labels)
    got = {r.doc_id: r.score for r in quality_nbsvm.score(train, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 4) for i in range(200))
    assert quality_nbsvm.score(odd, model).where("score is null or score < 0 or score > 1").count() == 0 and quality_nbsvm.score(empty, model).count() == 0
    assert quality_nbsvm.keep(train, model).columns == train.columns and quality_nbsvm.keep(train, model).count() == 150
    none = quality_nbsvm.train(docs, labels.limit(0))
    assert {r.score for r in quality_nbsvm.score(docs, none).collect()} == {0.5}


def test_passages_of_shuffled_texts():
    """Rotated and repetitive token sequences: shifts fall into clusters, and every passage found is similar enough."""
    rng, found = np.random.default_rng(0), 0
    for _ in range(400):
        y = rng.integers(0, int(rng.integers(20, 400)), int(rng.integers(46, 300))).astype(np.uint64)
        a = int(rng.integers(len(y)))
        x = np.concatenate([y[a:], rng.integers(0, 400, int(rng.integers(60))).astype(np.uint64), y[:a]])
        for i, j, k, m, sim in compact_windows.match(x, y):
            s, t = set(x[i:j].tolist()), set(y[k:m].tolist())
            assert j - i >= compact_windows.LEAST and len(s & t) / len(s | t) == sim >= compact_windows.SIMILARITY
            found += 1
    assert found > 100


def test_passages_with_an_insertion_in_either_order():
    """Jaccard decides on passages of different lengths, whichever side they are looked up from."""
    a, b, c = np.arange(27, dtype=np.uint64), np.arange(100, 104, dtype=np.uint64), np.arange(27, 50, dtype=np.uint64)
    for gone, new in ((4, 7), (2, 9)):
        short = np.concatenate([a[: 27 - gone], b[:gone], c])
        long_ = np.concatenate([a[: 27 - gone], np.arange(200, 200 + new, dtype=np.uint64), c])
        for x, y in ((short, long_), (long_, short)):
            found = compact_windows.match(x, y)
            assert len(found) == 1 and found[0][4] == (50 - gone) / (50 + new) >= compact_windows.SIMILARITY


def accepted(texts):
    """All pairs of texts that have a verified passage, by brute force."""
    tokens = {}
    for k, t in texts.items():
        raw = (t or "").encode()
        tokens[k] = shingles.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    owners = collections.defaultdict(list)
    for k, v in tokens.items():
        for x in set(v.tolist()):
            owners[x].append(k)
    shared = collections.Counter((a, b) for o in owners.values() for i, a in enumerate(o) for b in o[i + 1 :])
    least = compact_windows.SIMILARITY * compact_windows.LEAST
    return [(a, b) for (a, b), n in shared.items() if n >= least and (compact_windows.match(tokens[a], tokens[b]) or compact_windows.match(tokens[b], tokens[a]))]


def linked(spark, texts):
    return {r.doc_id: r.class_id for r in compact_windows.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}


def test_passages_around_a_template(spark):
    """Pairs share 52 words around 40 words that all texts share: the template must neither link the rest nor hide the pairs."""
    template, texts = prose(900, 40), {}
    for k in range(50):
        body = prose(910 + k, 6) + " " + template + " " + prose(1110 + k, 6)
        for side in (0, 1):
            texts[2 * ((k * 37) % 50) + side] = prose(2000 + 2 * k + side, 30) + " " + body + " " + prose(3000 + 2 * k + side, 30)
    got = linked(spark, texts)
    assert got == groups(texts, accepted(texts)) and sum(k != v for k, v in got.items()) == 50


def test_passages_of_star_shaped_families(spark):
    """Copies with one word changed each are near their original and not always near each other; ids are shuffled."""
    rng, texts = np.random.default_rng(6), {}
    ids = rng.permutation(20 * 21).tolist()
    for f in range(20):
        words = prose(5000 + f, 60).split()
        for c in range(21):
            own = list(words)
            if c:
                own[int(rng.integers(60))] = f"changed{c}"
            k = ids.pop()
            texts[k] = prose(6000 + k, 40) + " " + " ".join(own) + " " + prose(7000 + k, 25)
    assert linked(spark, texts) == groups(texts, accepted(texts))


def test_passages_do_not_depend_on_slices(spark, monkeypatch):
    texts = {k: prose(8000 + k, 30) + " " + LINE + " " + prose(8100 + k, 30) for k in range(12)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [sorted(map(tuple, compact_windows.classes(d).select("doc_id", "class_id").collect())) for d in (frame.coalesce(1), frame.repartition(12))]
    assert got[0] == got[1] == [(k, 0) for k in range(12)]


def test_token_records_with_added_tokens():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(WORDS), token_records.Encoder(WORDS)
    texts = ["a <|endoftext|> b", "", "Plain text.", "x<|startoftext|>Y<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "|> last"]
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, at = enc.encode(np.frombuffer("".join(texts).encode(), np.uint8), off)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[: at[1]].tolist() == [320, 49407, 321]


def test_near_copies_with_a_tail_cut_off_or_text_appended(spark):
    """Isolated pairs at the least similarity: none may be missed."""
    rng, texts = np.random.default_rng(8), {}
    for k in range(60):
        words = prose(1000 + k, int(rng.integers(80, 400))).split()
        n = len(words)
        other = words[: n - int(n * rng.uniform(0.14, 0.2))] if k % 2 else words + prose(2000 + k, int(n * rng.uniform(0.14, 0.25))).split()
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join(other)}
    s = {k: simhash.shingle_set(v) for k, v in texts.items()}
    want = groups(s, [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    assert sum(k != v for k, v in want.items()) > 40
    assert dict(simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", "component").collect()) == want


def test_decontamination_does_not_depend_on_blocks(spark, docs, monkeypatch):
    """One row a document for any BLOCK_BYTES; items without an id, repeated items and repeated places."""
    items = [(k, prose(300 + k, 40)) for k in range(30)] + [(None, prose(400, 40)), (7, prose(401, 40)), (7, prose(401, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {k: prose(500 + k, 30) + " " + items[k][1] + " " + prose(600 + k, 30) for k in range(20)}
    texts |= {50: items[3][1] + " " + prose(700, 50) + " " + items[3][1], 51: items[30][1], 52: items[1][1] + " " + items[31][1], 53: None, 54: prose(701, 80)}
    more = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen = []
    for size in (150, 900, 4 << 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        seen.append(sorted(map(str, decontaminate.scan(more, bench).collect())))
        assert {r.doc_id for r in decontaminate.clean(more, bench).collect()} == {53, 54}
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(texts)
    got = {r.doc_id: r for r in decontaminate.scan(more, bench).collect()}
    assert all(got[k]["items"] == [k] for k in range(20)) and got[51]["items"] == [None] and got[52]["items"] == [1, 7] and not got[54].contaminated
    first, last = len(items[3][1]), len(texts[50])
    assert got[50]["items"] == [3] and min(s.start for s in got[50].spans) < 5 and max(s.end for s in got[50].spans) > last - 5 and any(s.start > first for s in got[50].spans)


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


def test_texts_that_collide_under_polynomial_hashes():
    from tokenizers import Tokenizer

    texts = [thue_morse(1024) + " " + thue_morse(1024, True), "x " + thue_morse(1024, True), thue_morse(2048) + " " + thue_morse(2048, True)]
    off, data = np.cumsum([0, *map(len, texts)]), np.frombuffer("".join(texts).encode(), np.uint8)
    tok = Tokenizer.from_file(WORDS)
    ids, at = token_records.Encoder(WORDS).encode(data, off)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    p = sentencepiece_ffbs.pieces(PIECES)
    assert sentencepiece_ffbs.decode(p, *sentencepiece_ffbs.encode(p, np.arange(3), data, off))[0].tobytes() == data.tobytes()
    h = C.prefix_hash(data)
    assert C.span_hash(h, np.array([0]), np.array([1024])) == C.span_hash(h, np.array([1025]), np.array([2049]))


def test_token_records_of_another_tokenizer_file():
    """Units hold for one kind of file only; any other one encodes whole texts."""
    enc = token_records.Encoder(WORDS)
    assert enc.units and not token_records.parts_into_units({}) and not token_records.parts_into_units({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}})
    texts = ["It's 'a' b-C", "", "ÇA K-x"]
    off, data = np.cumsum([0, *(len(t.encode()) for t in texts)]), np.frombuffer("".join(texts).encode(), np.uint8)
    ids, at = enc.encode(data, off)
    enc.units = False
    ids2, at2 = enc.encode(data, off)
    assert ids.tolist() == ids2.tolist() and at.tolist() == at2.tolist()


BSD_3 = """Copyright (c) 2019, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
   products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_licenses_as_whole_texts(spark):
    """Another wrapping, case or owner is the same licence; a changed clause or a missing one is not."""
    import os

    one = " ".join(BSD_3.split("\n\n", 1)[1].split())
    texts = {1: BSD_3, 2: one, 3: "(c) 2001 A\n\n" + one.upper(), 4: BSD_3.replace("binary form must", "binary form need not"), 5: BSD_3 + "\nOne more rule.", 6: BSD_3.replace("this\n   list", "this list")}
    terms = "(a) You must give a copy; and\n(b) You must mark changes; and\n(c) You must retain all notices."
    own = {license_scan.digest_py(terms): "Terms"}
    texts |= {7: terms, 8: terms.replace("retain", "remove"), 9: "Copyright 2020 B\n" + terms}
    want = {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "BSD-3-Clause", 4: None, 5: None, 6: "BSD-3-Clause", 7: "Terms", 8: None, 9: "Terms"}
    for k, (name, path) in enumerate((("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("Apache-2.0", "Apache-2.0")), 20):
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            texts[k], want[k] = " ".join(open(f"/usr/share/common-licenses/{path}").read().split(" ")).replace("\n\n", "\n \n"), name
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(docs, own).collect()} == want


def plain_flac(stream: bytes) -> bytes:
    """Another decoder, bit by bit from the format's description: one stream of 8-bit mono samples as unsigned bytes."""
    bits, at = "".join(f"{b:08b}" for b in stream), 0

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    assert take(32) == int.from_bytes(b"fLaC", "big")
    last = 0
    while not last:
        last, kind, size = take(1), take(7), take(24)
        at += 8 * size
    out = []
    while at < len(bits):
        assert take(14) == 0b11111111111110 and take(2) == 0
        code, rate, _, _, _ = take(4), take(4), take(4), take(3), take(1)
        lead = take(8)
        at += 8 * (0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length())
        n = {6: lambda: take(8) + 1, 7: lambda: take(16) + 1}.get(code, lambda: 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8))()
        take(8)
        take(1)
        kind = take(6)
        take(1)
        if kind == 0:
            x = [signed(8)] * n
        elif kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            coef, shift = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)][order] if kind < 32 else (), 0
            if kind >= 32:
                wide, shift = take(4) + 1, take(5)
                coef = [signed(wide) for _ in range(order)]
            wide, parts = 4 + take(2), 1 << take(4)
            for p in range(parts):
                k = take(wide)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    q = bits.index("1", at) - at
                    at += q + 1
                    u = q << k | take(k)
                    guess = sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift
                    x.append((u >> 1 ^ -(u & 1)) + guess)
        at += -at % 8 + 16
        out += x
    return bytes(v + 128 for v in out)


def test_flac_by_another_decoder(monkeypatch):
    rng = np.random.default_rng(7)
    rows = [flac.payload(x) for x in (b"", raw(10), raw(8), rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), bytes(range(256)) * 6, b"a" * 4000)]
    whole = flac.encode(rows)
    assert [plain_flac(s) for s in whole] == rows
    monkeypatch.setattr(flac, "GROUP", 2)  # pieces of a long text give the same stream
    assert flac.encode(rows) == whole and [b"".join(x.tobytes() for _, x in found) for found in flac.decode(whole)] == rows


@pytest.mark.parametrize("crowd", [0, 3, 20_000])
def test_suffix_dedup_in_crowds_and_small_batches(spark, monkeypatch, crowd):
    """One K-gram in many different spans: sorted together or dealt out by content, in batches that cut groups anywhere."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    line = prose(7, 12)[:60]
    texts = {k: prose(k, 30) + line + prose(k % 5, 40) + (" " + line) * (k % 3) for k in range(40)} | {90: None, 91: "", 92: prose(3, 30) + line + prose(3, 40)}
    rows = [(k, t) for k, t in texts.items()] + [(92, texts[92])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (size, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(frame).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert got == removed(texts)


def test_windows_that_share_a_hash_are_told_apart(spark):
    a, b = b"x" * 100, b"y" * 100
    rows = [(1, 1, 0, a), (1, 2, 0, b), (1, 3, 0, a), (1, 3, 5, b), (1, 3, 5, b), (2, 4, 0, b), (3, 1, 7, a), (3, 9, 7, a)]
    for n in ("1", "3", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got = suffix_dedup.settle(spark.createDataFrame(rows, "kh long, id long, lo long, text binary")).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.id, r.pack >> 32) for r in got) == [(3, 0), (3, 5), (3, 5), (9, 7)]


def test_decontamination_where_only_the_table_hits():
    """Texts whose q-grams share a slot of the table with needles, and none of whose q-grams is a needle's."""
    index = decontaminate.Needles([(k, prose(9000 + k, 3).encode()[:20]) for k in range(300)])
    hits = 0
    for k in range(60):
        text = np.frombuffer(prose(k, 400).encode(), np.uint8)
        body, off, _ = decontaminate.plain(text, np.array([0, len(text)]))
        hits += bool(index.table[decontaminate.grams(body) * decontaminate.HASH >> np.uint64(64 - decontaminate.TABLE_BITS)].any())
        assert len(decontaminate.places(index, text, np.array([0, len(text)]))[0]) == 0
    assert hits > 3


def test_components_with_hubs(spark):
    """Stars, chains of stars and repeated links."""
    links = [(0, i) for i in range(1, 40)] + [(39, i) for i in range(40, 80)] + [(200 - i, 201 - i) for i in range(30)] + [(90, i) for i in range(60, 100)] + [(300, 300), (301, 302), (302, 301)]
    want = groups({x for p in links if p[0] != p[1] for x in p}, [p for p in links if p[0] != p[1]])
    assert dict(linking.components(spark.createDataFrame(links + [(None, 5)], "a long, b long")).collect()) == want


def test_texts_over_one_slice(spark, monkeypatch):
    """A text of several MB stands alone in its slice; neighbours and results are as for any other text."""
    long_ = prose(77, 60_000) * 8 + " the end"
    texts = {1: prose(1, 50), 2: long_, 3: None, 4: prose(78, 70), 5: long_[:1000]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert len(long_) > C.SLICE_BYTES // 2
    sha = {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in texts.items()}
    assert {r.doc_id: (r.decoded_sha256, r.lossless) for r in sentencepiece_ffbs.digests(docs, PIECES).collect()} == {k: (v, True) for k, v in sha.items()}
    got = {r.doc_id: r for r in flac.digests(C.cut(flac.media(docs))).collect()}
    assert all(got[k].payload_sha256 == hashlib.sha256(flac.payload((t or "").encode())).hexdigest() for k, t in texts.items())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digests(docs).collect()}[5] == 1000
    bench = spark.createDataFrame([(0, long_[-200:]), (1, prose(78, 70))], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.scan(docs, bench).collect()} == {1: [], 2: [0], 3: [], 4: [1], 5: []}
    assert {r.doc_id for r in simhash.near_copies(docs).where("component <> doc_id").collect()} == set()


def test_few_links_need_few_jobs(spark, monkeypatch):
    """The driver keeps plans, code and task records of every job: a long chain took dozens, in rounds."""
    rng = np.random.default_rng(4)
    chain = rng.permutation(3000).tolist()
    links = list(zip(chain[:-1], chain[1:])) + [(5000, 5000 + k) for k in range(1, 400)] + [(7001, 7000), (7000, 7001), (None, 3), (9, 9)]
    frame = C.cut(spark.createDataFrame(links, "a long, b long"))
    want = {k: 0 for k in range(3000)} | {5000 + k: 5000 for k in range(400)} | {7000: 7000, 7001: 7000}
    spark.sparkContext.setJobGroup("few links", "")
    got = dict(linking.components(frame).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setJobGroup("other", "")
    monkeypatch.setattr(linking, "LOCAL", 0, raising=False)
    assert got == want == dict(linking.components(frame).collect()) and jobs <= 8


def test_texts_meet_once_in_a_token(spark, monkeypatch):
    """Pairs that share nothing but a template with others meet these in its tokens, not once more for each signature in it."""
    template, texts = prose(900, 40), {}
    for k in range(50):
        body = prose(910 + k, 6) + " " + template + " " + prose(1110 + k, 6)
        texts |= {2 * k + side: prose(2000 + 2 * k + side, 30) + " " + body + " " + prose(3000 + 2 * k + side, 30) for side in (0, 1)}
    seen, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, what="cut": (seen.append(out := cut(df, what)), out)[1] if what == "hubs" else cut(df, what))
    monkeypatch.setattr(C, "sweep", lambda *_: None)
    compact_windows.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    most = seen[0].groupBy("id").count().agg({"count": "max"}).first()[0]
    assert 0 < most <= len(template.split()) - shingles.SHINGLE + 1


def test_windows_are_compared_only_where_spans_share_enough():
    """Spans of one K-gram: windows equal those of a dictionary, and of spans that share little but the K-gram none is looked at."""
    rng = np.random.default_rng(8)
    gram = b"k" * suffix_dedup.K
    pool = [bytes(rng.integers(97, 99, 76, dtype=np.uint8)) for _ in range(6)]
    for sides in (lambda: (pool[rng.integers(6)], pool[rng.integers(6)]), lambda: (bytes(rng.integers(0, 256, 76, dtype=np.uint8)),) * 2):
        rows = []
        for i in range(300):
            (x, y), before, behind = sides(), int(rng.integers(0, 77)), int(rng.integers(0, 77))
            if before + behind >= 76:
                rows.append((i // 100, i // 3, before, x[76 - before :] + gram + y[:behind]))
        group, ids, before, text = zip(*rows)
        data, off = np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])
        row, d, again = suffix_dedup.repeats(data, off, *map(np.array, (group, before, ids)), np.array(before) + 1000 * np.arange(len(ids)))
        seen, want = set(), set()
        for r, t in enumerate(text):
            for w in range(len(t) - 99):
                own = (group[r], before[r] - w, t[w : w + 100])
                want |= {(r, before[r] - w)} if own in seen else set()
                seen.add(own)
        assert set(zip(row[again].tolist(), d[again].tolist())) == want
        assert want if len(set(text[0][:3])) < 3 else len(row) == 0


def test_only_texts_of_pairs_are_sent(spark, monkeypatch):
    """Texts that no pair names stay where they are, and many pairs are verified in several passes with the same result."""
    texts = {k: prose(8500 + k, 30) + " " + LINE + " " + prose(8600 + k, 30) for k in range(12)} | {k: prose(8700 + k, 90) for k in range(20, 60)}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a)], "a long, b long")
    seen, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, what="cut": (seen.append((what, out := cut(df, what))), out)[1])
    got = []
    for most in (1000, 10):
        monkeypatch.setattr(compact_windows, "PAIRS", most, raising=False)
        got.append(sorted(map(tuple, compact_windows.verify_whole(pairs, rows).collect())))
    assert got[0] == got[1] and len({x[:2] for x in got[0]}) == 66
    assert [df.count() for what, df in seen if what == "texts"] == [12, 12]
    assert [what for what, _ in seen].count("passages") == 1 + 2


def test_sampling_holds_little_at_once(spark):
    """What is held while 6 MB of text are segmented."""
    import tracemalloc

    import pyarrow as pa

    class Frame:
        select = withColumnRenamed = lambda self, *_: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rng, words = np.random.default_rng(12), prose(12, 20_000).split()
    texts = [" ".join(words[i] for i in rng.integers(0, 20_000, 5_000)) for _ in range(200)]
    frame = sentencepiece_ffbs.sample(Frame(), PIECES)
    batch = [pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})]
    sentencepiece_ffbs.pieces(PIECES)
    tracemalloc.start()
    assert sum(b.num_rows for b in frame.run(batch)) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20


def test_pairs_hold_little_at_once(spark, monkeypatch):
    """What is held while one short text is compared with 9 MB of long ones, and how much a batch of pairs may hold."""
    import tracemalloc

    import pyarrow as pa

    words = prose(13, 5_000).split()
    texts = {k: LINE + " " + " ".join(words[i] for i in np.random.default_rng(k).integers(0, 5_000, 5_000)) for k in range(1, 300)} | {0: LINE}
    name, seen, sizes, real, cut = "spark.sql.execution.arrow.maxBytesPerBatch", [], [], C.map_texts, C.cut
    monkeypatch.setattr(C, "map_texts", lambda df, schema, kernel, **more: (seen.append((schema, kernel, more)), real(df, schema, kernel, **more))[1])
    monkeypatch.setattr(C, "cut", lambda df, what="cut": (sizes.append(spark.conf.get(name, None)) if what == "passages" else None, cut(df, what))[1])
    rows = spark.createDataFrame([(0, LINE), (1, LINE)], "id long, text string")
    found = compact_windows.verify_whole(spark.createDataFrame([(1, 0)], "a long, b long"), rows)
    assert found.count() == 1 and sizes == [str(compact_windows.BATCH)] and spark.conf.get(name, None) is None

    class Frame:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    (schema, kernel, more), ids = seen[-1], sorted(texts)[1:]
    frame = real(Frame(), schema, kernel, **more)
    batch = pa.record_batch({"a": pa.array(ids), "b": pa.array([0] * len(ids)), "part": pa.array([texts[k] for k in ids]), "text": pa.array([LINE] * len(ids))})
    C.powers(1 << 19)
    tracemalloc.start()
    got = sum(b.num_rows for b in frame.run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(ids) and peak < 100 << 20


def test_batches_of_pairs_are_small(spark):
    """The bytes of Arrow batches that workers get, with and without a bound, and that a session's own setting stays."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 2000, 1, 1).selectExpr("repeat('abcdefghij', 300) as text")
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.nbytes])}) for b in batches), "n long")
    most = lambda: max(r.n for r in sizes.select("n").collect())
    with C.batches_of(spark, 1 << 20):
        small = most()
    assert small < 2 << 20 < 5 << 20 < most()
    spark.conf.set(name, "3m")
    with C.batches_of(spark, 1 << 20):
        own = spark.conf.get(name)
    assert own == spark.conf.get(name) == "3m"
    spark.conf.unset(name)


def test_shifts_equal_those_of_a_search():
    """The occurrence whose shift is next to that of the token before, also where most tokens repeat."""
    rng = np.random.default_rng(14)
    for k in range(300):
        x, y = (rng.integers(0, (3, 30, 300)[k % 3], n).astype(np.uint64) for n in rng.integers(20, 120, 2))
        order = np.argsort(y, kind="stable")
        at, ends = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
        h = np.flatnonzero(ends > at)
        if not len(h):
            continue
        one = [i for i in h.tolist() if ends[i] - at[i] == 1]
        last, want = int(order[at[one[0]]]) - one[0] if one else None, []
        for i in h.tolist():
            places = [int(p) - i for p in order[at[i] : ends[i]]]
            last = places[0] if last is None else min(places, key=lambda p: abs(p - last))
            want.append(last)
        assert compact_windows._shifts(h, order, at, ends).tolist() == want


def test_joins_of_fingerprints_broadcast_nothing(spark, monkeypatch):
    """What follows an explode was sized by its source: hundreds of thousands of buckets went through the driver."""
    plans, cut = [], C.cut

    def seen(df, what="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, what)

    monkeypatch.setattr(C, "cut", seen)
    docs = spark.createDataFrame([(i, f"word{i // 3} of the text {i // 3 * 7} and some more") for i in range(60)], "doc_id long, text string")
    out = simhash.groups(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len({r.component for r in out.collect()}) <= 20
    assert not [p for p in plans if "Broadcast" in p]
