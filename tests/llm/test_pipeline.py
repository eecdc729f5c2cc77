import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rangeflow.llm import decontaminate, neardup, packing, quality
from tests.llm.test_quality import brute as quality_brute
from tests.llm.test_secrets import redacted

SF = "/root/testdata/sf0.001"


def sets(text, k):
    words = text.lower().split() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text).replace("\x1c", "").split(" ")
    words = [w for line in text.translate({i: i + 32 for i in range(65, 91)}).split("\n") for w in line.replace("\t", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def first_of_groups(rows, k=5, percent=80):
    own = {i: sets(t, k) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b]:
                both = len(own[a] & own[b])
                if 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: t for i, t in rows.items() if find(i) == i}


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]

    rows = {i: t for i, t in rows.items() if quality_brute(t, quality.QualityRules())["kept"]}
    rows = first_of_groups(rows)
    windows = set().union(*[decontaminate.item_windows(t, 8) for _, t in items])
    lengths = {len(w) for w in windows}
    clean = {}
    for i, t in rows.items():
        words = t.encode().translate(decontaminate.NORMAL).split()
        if not any(tuple(words[j : j + n]) in windows for n in lengths for j in range(len(words) - n + 1)):
            clean[i] = t
    assert len(clean) < len(rows)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    expected = []
    for i, t in clean.items():
        ids = tokenizer.encode(redacted(t), add_special_tokens=False).ids + [1]
        expected += [(i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids)) for a, n in packing.pieces(len(ids), 2048)]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == sorted(expected)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=lambda f: f.__name__)
def test_stages_keep_columns_and_take_odd_rows(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long"
    letters = np.random.default_rng(5).choice(list("aeiounrstlé"), (40000, 6))
    long = " ".join(map("".join, letters))
    rows = [(1, None, None, None, None, None, None), (None, "a " * 30, "en", "s", 60, True, 1), (2, "", "en", "s", 0, False, 2), (3, long, "en", "s", len(long), True, 3), (3, long, "en", "s", len(long), True, 3)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    kept = out.collect()
    assert any(r.doc_id == 3 and r.text == long and r.n_words == 3 for r in kept)
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0


def test_packing_takes_odd_rows(spark):
    schema = "doc_id long, text string, length string, start long, ids_crc32 string"
    docs = spark.createDataFrame([(1, None, "x", 1, None), (None, "a b", None, 2, "y"), (2, "", "x", 3, "z"), (3, "w " * 5000, "x", 4, ""), (3, "w " * 5000, "x", 4, "")], schema)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert got.where("doc_id = 1 or doc_id = 2").select("length", "doc_tokens").distinct().collect() == [(1, 1)]
    assert got.where("doc_id is null").agg({"length": "sum"}).first()[0] == 3 and got.where("doc_id = 3").agg({"length": "sum"}).first()[0] == 2 * got.where("doc_id = 3").first().doc_tokens
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_need_no_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: True, 2: False, 3: True}
