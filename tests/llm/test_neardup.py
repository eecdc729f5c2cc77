import random

import numpy as np
import pyarrow as pa
import pytest

from rangeflow.llm import neardup
from rangeflow.llm.components import components
from rangeflow.llm.neardup import NearDupParams, keep_first, most_bits, near_duplicates, sketch
from rangeflow.llm.oracle import near_duplicates as oracle
from rangeflow.llm.wordhash import Words, buffers
from tests.llm.test_pipeline import sets

SCHEMA = "doc_id long, text string, key long, sketch string"


def brute(rows, p):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, sets(t or "", p.shingle)) for i, t in rows]
    for a, x in own:
        for b, y in own:
            if a is not None and b is not None and a != b and x and y:
                both = len(x & y)
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in own), key=repr)


@pytest.mark.parametrize("p", [NearDupParams(), NearDupParams(shingle=3, percent=85, block=16)])
def test_against_brute_force(spark, p):
    rng = random.Random(p.percent)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(500))
    rows = [(None, None), (None, "same same"), (1, ""), (2, "one"), (3, "ONE"), (4, "two words"), (5, "two  WORDS "), (6, "\t\n")]
    base = [word() for _ in range(300)]
    for i in range(60):  # a chain and a crowd around one text, at all similarities
        text = list(base)
        for _ in range(rng.randrange(0, 60)):
            text[rng.randrange(len(text))] = word()
        rows.append((100 + i, " ".join(text)))
    for i in range(40):
        rows.append((300 + i, " ".join(word() for _ in range(rng.randrange(0, 80)))))
    rows += [(i + 1000, t) for i, t in rows[10:20]] + [rows[12], (rows[12][0], rows[13][1]), (5000, " ".join(word() for _ in range(20000)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs, p).collect()), key=repr) == brute(rows, p)


def thue_morse(n, zero, one):
    return "".join((zero, one)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("p", [NearDupParams(), NearDupParams(shingle=3, percent=85)])
def test_words_that_cancel_out_in_polynomials_differ(spark, p):
    rows = [(i, thue_morse(n, *x)) for i, (n, x) in enumerate((n, x) for n in (64, 1024, 4096) for x in ("ab", "ba"))]
    rows += [(10, thue_morse(32, "x ", "y ")), (11, thue_morse(32, "y ", "x ")), (12, "a\0"), (13, "a"), (14, "A")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(docs, p).collect()), key=repr) == brute(rows, p)


def test_short_words_have_names_of_their_own():
    words = [f"{i:x}" for i in range(200000)] + ["a\0", "a", "aaaaaaaa", "aaaaaaaa\0", "aaaaaaaab", "é", "z" * 15, "z" * 16, "z" * 17]
    data, offsets = buffers(pa.array([" ".join(words)]))
    names = Words(data, offsets).names()
    assert len(set(zip(*(x.tolist() for x in names), strict=True))) == len(set(words))


def test_large_buckets_of_texts_below_the_threshold_meet_by_rare_shingles(spark, monkeypatch):
    """Texts with a common part of 88 percent of their words: bands meet, no two are linked, and a few pairs are."""
    p, rng = NearDupParams(block=64), random.Random(9)
    common = [f"c{i}" for i in range(176)]
    rows = [(i, " ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(24)])) for i in range(1500)]
    for i in range(0, 60, 2):  # pairs that are linked, with each other only
        words = rows[i][1].split()
        rows.append((5000 + i, " ".join([*words[:-2], "v1", "v2"])))
    rows = [(i, t) for i, t in rows]
    copies, inner = [], neardup._dealt

    def counted(left, p):
        out = inner(left, p)
        copies.append(out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(neardup, "_dealt", counted)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, NearDupParams(percent=90, block=64)).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert max(copies) <= 21  # 0.1 n + 1 shingles, not bands times blocks


def test_rows_that_repeat_stay_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x"), (None, "x"), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert sorted((tuple(r)[:2] for r in keep_first(docs).collect()), key=repr) == sorted([rows[0], (None, "x"), (None, "x"), (3, None), (4, "")], key=repr)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 100), (300, 299), (300, 299)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 200: 100, 299: 299, 300: 299}


def test_parameters_lose_few():
    for p in (NearDupParams(), NearDupParams(shingle=3, percent=85)):
        assert (1 - (p.percent / 100) ** p.rows) ** p.bands <= p.miss
    assert "percent" not in oracle()


@pytest.mark.parametrize("percent, unions", [(85, (60, 100, 200, 300, 500, 1000, 4000)), (80, (60, 100, 200, 300, 500, 1000, 4000))])
def test_sketches_lose_no_pairs_at_the_threshold(percent, unions):
    p, rng = NearDupParams(percent=percent), np.random.default_rng(percent)
    for union in unions:
        lost, common, trials = 0, union * percent // 100, 4000 if union <= 1000 else 500
        for _ in range(trials):
            both = rng.integers(0, 1 << 64, union, dtype=np.uint64)
            half = common + (union - common) // 2
            a, b = np.sort(both[:half]), np.sort(np.concatenate((both[:common], both[half:])))
            (bins_a, x), (bins_b, y) = sketch(a, p), sketch(b, p)
            lost += np.bitwise_count((x ^ y).view(np.uint64)).sum() > most_bits(bins_a, bins_b, len(a), len(b), p)
        assert lost == 0, union
