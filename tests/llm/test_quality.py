import base64
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from rangeflow.llm import quality


def brute(text, rules):
    text = text or ""
    raw = text.encode("utf-8")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = {}
    for i in range(len(words) - 4):
        spans.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {j for at in spans.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
    press = zstandard.ZstdCompressor(level=rules.level, write_content_size=False, write_checksum=False)
    low, high = 0, float("inf")
    for least, lo, hi in rules.bands:
        if len(raw) >= least:
            low, high = lo, hi
    good = not raw or low <= len(raw) / len(press.compress(raw)) <= high
    n = rules.chunk_bytes
    chunks = [raw[i : i + n] for i in range(0, len(raw), n)]
    ratios = [n / len(press.compress(c)) for c in chunks if len(c) == n]
    if len(ratios) > 1:
        good &= sum(not rules.chunk_low <= r <= rules.chunk_high for r in ratios) <= rules.bad_chunk_share * len(ratios)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": failed,
        "kept": not failed and good,
    }


TEXTS = [
    None,
    "",
    "one",
    "a b c d e " * 8,
    "ein zwei drei\nein zwei drei\n \n \n\x0b\nvier fünf # <sechs> ein zwei drei vier fünf sechs sieben",
    "x y   z \x1c q " + " ".join(map(str, range(100))),
    base64.b64encode(os.urandom(6000)).decode() + " a b c d e f g h i j",
    " ".join(f"word{i * 7919 % 1000}" for i in range(3000)),
    "\n".join(f"line {i % 3}" for i in range(50)),
    "abcdefghij" * 4000 + " a b c d e f g h i j k",
    "é" * 100000,
    " ".join("ab"[bin(i).count("1") % 2] for i in range(64)) + " " + " ".join("ba"[bin(i).count("1") % 2] for i in range(64)),
    "".join("ab"[bin(i).count("1") % 2] for i in range(1024)) + " b c d e f " + "".join("ba"[bin(i).count("1") % 2] for i in range(1024)) + " b c d e g h i j",
]


def test_counts_and_verdicts_match_brute_force(spark):
    rules = quality.QualityRules()
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], False), (4, TEXTS[4], True), (4, TEXTS[4], True)], "doc_id long, text string, kept boolean")
    for r in quality.quality_rules(docs, rules).collect():
        expected = brute(TEXTS[4 if r.doc_id is None else r.doc_id], rules)
        assert {k: r[k] for k in expected} == expected, r.doc_id


def test_real_texts_match_brute_force(spark):
    rules = quality.QualityRules()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_rules(docs, rules).collect():
        expected = brute(texts[r.doc_id], rules)
        assert {k: r[k] for k in expected} == expected, r.doc_id


@pytest.mark.parametrize("i, why", [(6, "incompressible"), (9, "repetitive"), (2, "few words"), (3, "repeated windows")])
def test_reasons(spark, i, why):
    docs = spark.createDataFrame([(i, TEXTS[i])], "doc_id long, text string")
    assert quality.quality_rules(docs).first().reason == why


def test_good_labels_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = quality.quality_rules(docs).join(labels, "doc_id")
    assert both.where("quality = 1 and not base_failed and not kept").count() == 0
    assert both.where("quality = 0 and kept").count() <= 0.5 * both.where("quality = 0").count()


def judged(sf):
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet").merge(pd.read_parquet(f"/root/testdata/{sf}/labels.parquet"), on="doc_id")
    found = quality.judge(pa.array(docs.text, pa.string()), quality.QualityRules())
    docs = docs.assign(size=[len((t or "").encode()) for t in docs.text], **{k: found[k] for k in ("base_failed", "kept", "ratio")})
    return docs[~docs.base_failed]


def test_limits_are_those_fitted_on_clean_labels():
    clean = judged("sf0.1").query("quality == 1")
    fitted = quality.fitted_bands(clean["size"].to_numpy(float), clean.ratio.to_numpy(float))
    assert [b for b in quality.BANDS if 32 <= b[0] < 32768] == fitted
    press = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    p = quality.QualityRules()
    ratios = [p.chunk_bytes / len(press.compress(t.encode()[i : i + p.chunk_bytes])) for t in clean.text for i in range(0, len(t.encode()) - p.chunk_bytes + 1, p.chunk_bytes)]
    assert p.chunk_low <= min(ratios) < p.chunk_low + 0.02 and p.chunk_high - 0.02 < max(ratios) <= p.chunk_high


def test_ratios_reject_junk_that_the_base_rule_keeps():
    for sf, lost in (("sf0.1", 0.002), ("sf0.01", 0.0)):  # sf0.01 has no part in the fit
        rows = judged(sf)
        assert (~rows[rows.quality == 1].kept).mean() <= lost
        junk = rows[rows.quality == 0]
        assert (~junk.kept).mean() > 0.6
        assert (~junk[junk["size"] >= 4096].kept).all()


def test_chunks_cover_the_end_of_a_text():
    p = quality.QualityRules()
    for n in (0, 1, 1023, 1024, 1025, 2047, 2048, 2049, 8191):
        starts = quality._chunk_starts(n, p.chunk_bytes)
        assert set().union(*(range(a, a + p.chunk_bytes) for a in starts)) == (set(range(n)) if n > p.chunk_bytes else set())
    clean = next(t for t in judged("sf0.01").query("quality == 1 and size > 4000").text if t.isascii())
    noise = base64.b64encode(np.random.default_rng(3).bytes(600)).decode()
    texts = [clean[:2047], clean[:1847] + noise[:200]]  # shorter than two chunks, and in the limits as a whole
    found = quality.judge(pa.array(texts), p)
    assert found["reason"] == [None, "chunks"]
    assert found["n_chunks"] == [2, 2] and found["n_bad_chunks"] == [0, 1]
