"""The pipeline keeps clean documents, its decisions take effect, and every stage equals a brute-force version on awkward rows."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import sentencepiece_ffbs, simhash
from vigilake.llm import common as C

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert docs.where(F.size("ids") == 0).count() == 0


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of labels and of a benchmark for the rows below."""
    at = tmp_path_factory.mktemp("tables")
    items = [(0, prose(900, 30)), (1, None), (None, prose(901, 30)), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(100, 160)] + [(None, 1, 0), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows():
    good = {k: prose(k, 60) if k % 5 else "buy now!!! " * 30 for k in range(100, 160)}
    passage = prose(950, 40)
    base = prose(1, 120)
    texts = good | {
        1: base, 2: base, 3: base + " tail", 4: None, 5: "", 6: "   ", 7: prose(7, 30) + " " + passage + " " + prose(8, 30), 8: prose(9, 30) + " " + passage + " " + prose(10, 30),
        9: prose(11, 20) + " " + prose(900, 30).upper() + " " + prose(12, 20), 10: prose(13, 20) + " " + prose(901, 30), 11: prose(14, 4000), 12: "one two",
    }
    out = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    return out + [(1, base, "en", "s", 0), (None, base, None, None, None), (None, None, None, None, None), (13, prose(15, 50), None, None, None)]


def jaccard_groups(texts):
    sets = {k: simhash.shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def without_repeats(texts, n=100):
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(b[i : i + n])
        out[k] = bytes(c for c, g in zip(b, gone) if not g).decode()
    return out


def clashing(spark, data):
    """The rows with columns on top whose names stages use inside."""
    return spark.createDataFrame([(*r, 7, 7, "x", 1) for r in data], SCHEMA + ", id long, fp long, root string, packs long").repartition(3)


def test_quality_stage(spark, folder):
    data = rows()
    got = corpus_pipeline.quality(spark, clashing(spark, data), folder)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == corpus_pipeline.COLUMNS and all((ids.count(k) == 1) == bool(k % 5) for k in range(100, 160))


def test_near_copies_stage(spark, folder):
    data = rows()
    got = corpus_pipeline.near_copies(spark, clashing(spark, data), folder).collect()
    groups = jaccard_groups({r[0]: r[1] for r in data if r[0] is not None})
    want = sorted(r[0] for r in data if r[0] is not None and groups[r[0]] == r[0])
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want and sum(r.doc_id is None for r in got) == 2


def test_repeats_stage(spark, folder):
    data = rows()
    got = [r for r in corpus_pipeline.repeats(spark, clashing(spark, data), folder).collect()]
    want = {k: t for k, t in without_repeats({r[0]: r[1] for r in data if r[0] is not None}).items() if t}
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == want and sum(r.doc_id is None for r in got) == 2
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id is not None)


def test_decontaminated_stage(spark, folder):
    data = rows()
    got = corpus_pipeline.decontaminated(spark, clashing(spark, data), folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in data if r[0] not in (9, 10))


def test_token_stage(spark, folder):
    import public_tokenizers

    data = rows()
    got = corpus_pipeline.token_ids(spark, clashing(spark, data), folder)
    back = sentencepiece_ffbs.restore(got, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in data)


def test_stages_on_an_empty_table(spark, folder):
    docs = clashing(spark, rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_keeps_only_its_result(spark, folder, monkeypatch):
    """Stages in a row, on the awkward rows, and the intermediate tables are gone."""
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    made = C.mark()
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert {1, 7, 8, 11, 13} <= ids and not ids & {2, 3, 9, 10, 100, 105} and len(C._MADE) - made <= 1


def test_near_copies_by_fingerprint(spark, folder):
    """Fingerprints of at most RADIUS different bits are near copies, even where sets of shingles, which know no repeats, are unlike."""
    texts = {1: "buy " * 400 + prose(70, 7), 2: "buy " * 400 + prose(71, 7), 3: prose(72, 80), 4: None}
    fp = {r.doc_id: r.fp for r in simhash.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert ((fp[1] ^ fp[2]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS and len(set(jaccard_groups(texts).values())) == 4
    data = [(k, t, "en", "s", 0) for k, t in texts.items()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, clashing(spark, data), folder).collect()) == [1, 3, 4]
