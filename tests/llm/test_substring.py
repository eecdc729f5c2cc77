import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rangeflow.llm.substring import COVERS, SubstringParams, remove_repeats

SCHEMA = "doc_id long, text string, block int, high binary"


def brute(rows, k):
    """rows: (doc_id, text) in any order; those of one id count in the order of their texts' hashes."""
    place = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, place(r[1])))
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone.update(range(i, i + k))
            seen.add(window)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, p):
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA)
    return sorted(map(tuple, remove_repeats(docs, p).collect()), key=repr)


def test_covers_hold():
    for period, cover in COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


@pytest.mark.parametrize("p", [SubstringParams(), SubstringParams(window=8, period=7), SubstringParams(window=3, period=3)])
def test_against_brute_force(spark, p):
    rng = random.Random(p.window)
    passage = [f"p{i}é" for i in range(3 * p.window)]
    rows = [(None, None), (None, " ".join(passage)), (0, ""), (1, "short text"), (7, " ".join("a" for _ in range(50)))]
    for i in range(2, 40):
        words = [rng.choice("abcd") + str(rng.randrange(30)) for _ in range(rng.randrange(0, 90))]
        at = rng.randrange(len(words) + 1)
        start = rng.randrange(len(passage))
        words[at:at] = passage[start : start + rng.randrange(2 * p.window)]
        rows.append((i * 3, rng.choice(" \n\t").join(words) + " "))
    rows += [(200, rows[8][1]), (201, rows[8][1]), (201, rows[8][1]), (6, rows[9][1]), (5000, " ".join(f"v{i % 977}" for i in range(30000)))]
    assert got(spark, rows, p) == brute(rows, p.window)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 9)), st.text(alphabet="ab \n", max_size=40)), max_size=12))
def test_small_alphabets(spark, rows):
    p = SubstringParams(window=4, period=3)
    assert got(spark, rows, p) == brute(rows, 4)


def thue_morse(n, zero, one):
    return "".join((zero, one)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [20, 1024, 4096])
def test_words_that_cancel_out_in_polynomials_differ(spark, size):
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {thue_morse(size, 'a', 'b')}"), (2, f"{same} {thue_morse(size, 'b', 'a')}"), (3, f"{same} a\0"), (4, f"{same} a")]
    rows += [(5, thue_morse(32, "x ", "y ")), (6, thue_morse(32, "y ", "x "))]
    assert got(spark, rows, SubstringParams()) == brute(rows, 20)


def test_rows_without_an_id_meet_in_many_blocks(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None if i % 3 else 7, f"{rng.random()} {passage} {rng.random()}") for i in range(60)]
    assert got(spark, rows, SubstringParams(block_bytes=200, bucket_bytes=1000)) == brute(rows, 20)


def test_empty_table_and_text(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y")], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in remove_repeats(docs, SubstringParams(window=3, period=3), with_text=True).collect()}
    assert kept == {1: "a b c d e", 2: "x y"}
