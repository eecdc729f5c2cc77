"""Decontamination, packing, sharding, archives, urls and languages."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rangeflow.llm import decontaminate, language, packing, sharding, urls, warc
from rangeflow.llm.queries import op8_language_id, page_document, tokenizer_files

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# --- decontamination --------------------------------------------------------


def brute_hits(text, items, k=8):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        n = min(k, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1) if own else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item_id)
    ids = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (10, "Short ITEM"), (3, ""), (None, "nameless window of words"), (1, "Der Übermut der Ämter über alle Maßen hinaus, sagt man")]
DOCS = [
    (1, "x THE quick-brown fox: jumps over the lazy DOG! y"),
    (2, "short\x00item, short item short"),
    (3, "nameless window of words"),
    (4, None),
    (5, ""),
    (6, "quick brown fox jumps over the lazy dog again der übermut der Ämter über alle maßen hinaus; short item " + "z " * 40000),
    (6, "Übermut der Ämter über alle Maßen hinaus sagt man der"),
    (None, "the quick brown fox jumps over the lazy"),
    (7, "the quick brown fox jumps over the"),
]


def test_hits_match_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    for most in (1 << 20, 40):  # by the automaton, and by joins of windows
        got = decontaminate.decontaminate(docs, items, automaton_bytes=most).collect()
        assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(((d[0], *brute_hits(d[1], ITEMS)) for d in DOCS), key=repr)
    spans = {r.doc_id: r.hit_spans for r in got if r.doc_id in (1, 7)}
    assert [DOCS[0][1][s.start : s.end] for s in spans[1]] == ["THE quick-brown fox: jumps over the lazy DOG"]
    assert spans[7] == []
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items, window=3, automaton_bytes=0).where("doc_id = 2").collect()} == {4}
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


# --- packing ----------------------------------------------------------------


def test_pieces_are_binary():
    for n in (1, 2, 3, 1000, 2047, 2048, 2049, 7000):
        found = packing.pieces(n, 2048)
        assert [a for a, _ in found] == [sum(s for _, s in found[:i]) for i in range(len(found))]
        assert sum(s for _, s in found) == n and all(s & (s - 1) == 0 and s <= 2048 for _, s in found)
        assert len(found) == n // 2048 + bin(n % 2048).count("1")


def test_packing_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "Hello, world's <|endoftext|> text ünïcode 日本 𝒳"), (3, "Hello"), (None, "a  b \n\n c   "), (4, "word " * 30000), (5, "x" * 20000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, **tokenizer_files(), with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket == len(r.ids) for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    expected = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    whole = Counter()
    open_docs = {}
    for r in sorted(got, key=lambda r: r.sequence_id >> 39):
        key = (r.doc_id, r.doc_tokens)
        open_docs.setdefault(key, {})[r.start] = r.ids
    for (d, n), parts in open_docs.items():
        flat = tuple(i for a in sorted(parts) for i in parts[a])
        assert len(flat) == n
        whole[(d, flat)] += 1
    assert whole == expected
    assert packing.pack(docs.limit(0), **tokenizer_files()).count() == 0


def test_quick_encoder_gives_the_same_ids(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["\u0085 \u00a0\u2003x\u200b", "don't we'll I'M 3½ ²³ ١٢", "\x00\x1f\x7f", "e\u0301\u0301", "🏽👨‍👩‍👧 🇩🇪", "\r\n \t\n", " " * 500 + "a"]
    files = tokenizer_files()
    quick, plain = packing.Encoder(**{"path": files["tokenizer"], "ranks": files["ranks"], "pattern": files["pattern"]}), packing.Encoder(files["tokenizer"])
    assert quick.quick is not None and plain.quick is None
    assert quick(texts) == plain(texts)


def test_repeated_rows_give_pieces_of_their_own(spark):
    docs = spark.createDataFrame([(1, "some words here")] * 3, "doc_id long, text string")
    got = packing.pack(docs, **tokenizer_files())
    assert got.count() == got.select("sequence_id").distinct().count() == 3 * len(packing.pieces(4, 2048))


def test_other_rank_files_are_refused(tmp_path):
    files = tokenizer_files()
    lines = open(files["ranks"], "rb").read().splitlines()
    (tmp_path / "fewer").write_bytes(b"\n".join(lines[:-1]))
    encoder = lambda ranks, pattern: packing.Encoder(files["tokenizer"], str(ranks), pattern)
    assert encoder(files["ranks"], files["pattern"]).quick is not None
    assert encoder(tmp_path / "fewer", files["pattern"]).quick is None
    assert encoder(files["ranks"], r"\S+|\s+").quick is None


# --- sharding ---------------------------------------------------------------


def test_shards(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else f"text {i % 13} é" * (i % 5)) for i in range(1003)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    p = sharding.ShardParams(bucket_bytes=3000)
    got = sharding.shard(docs, p).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.text, r["size"], r.text_crc32) for r in got) == Counter((d, t, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    again = sharding.shard(docs, p).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.shard(docs.limit(0), p).count() == 0
    plan = sharding.shard(docs, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shard_order_is_fixed_by_the_seed(spark, tmp_path):
    long = "z" * 3_000_000
    rows = [(i, f"text {i}" if i else long) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs, found = spark.read.parquet(str(tmp_path / "d")), set()
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for values in (("4", "true", "true"), ("13", "true", "false"), ("2", "false", "true")):
        for k, v in zip(keys, values, strict=True):
            spark.conf.set(k, v)
        found.add(tuple((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs).select("doc_id", "shard", "slot").orderBy("doc_id").collect()))
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)
    assert len(found) == 1


def test_shard_order_is_mixed(spark):
    docs = spark.range(20000).select("id", "id").toDF("doc_id", "text").selectExpr("doc_id", "cast(text as string) text")
    order = [r.doc_id for r in sharding.shard(docs).orderBy("slot", "shard").collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.03
    halves = Counter(d < 10000 for d in order[:10000])
    assert 4700 < halves[True] < 5300


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "concat('t', id) text")
    sharding.write_shards(docs, str(tmp_path / "s"), sharding.ShardParams(shards=4))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and back.groupBy("shard").count().where("count = 125").count() == 4


# --- archives ---------------------------------------------------------------


def page_rows():
    same = "<html>same é</html>"
    return [(1, "http://a/ b\n", same), (2, None, same), (9, "http://ü.org/", same), (3, "http://x", None), (4, "http://x", ""), (5, "u", "WARC/1.0\r\nWARC-Type: x\r\n\r\nfoo\r\n\r\n"), (None, "n", "alone"), (None, "n", same), (6, "u", "x" * 300000), (7, "u", "once"), (7, "u", "once"), (-8, "u", "neg")]


def brute_pages(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        equal = [j for j, _, other in rows if (other or "").encode() == raw and j is not None]
        top = max(equal, default=None) if len(raw) >= least else None
        group = sum((other or "").encode() == raw for _, _, other in rows)
        revisit = top is not None and i != top and group > 1
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id long, url string, html string, original string")
    got = warc.round_trip(pages, warc.WarcParams(least_bytes=least)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute_pages(page_rows(), least)
    assert {r.url for r in got} >= {"http://a/%20b%0A", "urn:none", "http://%C3%BC.org/"}
    assert warc.round_trip(pages.limit(0)).count() == 0


BODY = b"HTTP/1.0 200 OK\r\nContent-Type: x\r\n\r\n\n\nbody \xff\n"


def test_arc_versions_convert_alike():
    records = [warc.ArcRecord(v, "http://a.b/c", "1.2.3.4", "19990102030405", "text/html", BODY) for v in (1, 2)]
    images = [warc.arc_file([r, r], v) for v, r in zip((1, 2), records, strict=True)]
    assert images[0] != images[1]
    read = [list(warc.read_arc([x])) for x in images]
    assert read[0] == list(warc.read_arc([bytes([b]) for b in images[0]]))  # whatever the pieces
    assert [len(x) for x in read] == [2, 2] and {r.body for x in read for r in x} == {BODY}
    one = warc.to_warc(read[0][0], warc.record_id(5))
    assert one == warc.to_warc(read[1][0], warc.record_id(5))
    fields, block = next(warc.read_warc([one]))
    assert fields["WARC-Date"] == "1999-01-02T03:04:05Z" and fields["WARC-Type"] == "response" and block == BODY and fields["WARC-IP-Address"] == "1.2.3.4"
    assert fields["WARC-Payload-Digest"] == "sha1:" + warc.sha1_base32(b"\n\nbody \xff\n") and warc.numbered(fields["WARC-Record-ID"]) == 5
    for bad in (images[0][:-10], b"x" + images[0], images[0].replace(b"1 0 rangeflow", b"9 0 rangeflow"), images[0] + b"no length\n"):
        with pytest.raises(ValueError):
            list(warc.read_arc([bad]))


def test_archives_of_arc_files(spark, tmp_path):
    records = [warc.ArcRecord(1, f"http://a.b/{i}", "1.2.3.4", "19990102", "text/html", BODY + b"%d" % i) for i in range(50)]
    records += [warc.ArcRecord(1, "dns:a.b", "-", "1999", "text/dns", b"a.b. 1 IN A 1.2.3.4\n"), warc.ArcRecord(1, "http://a.b/e", "1.2.3.4", "19990102", "no-type", b"")]
    (tmp_path / "in").mkdir()
    for name, version, pack in (("one.arc", 1, bytes), ("two.arc.gz", 2, gzip.compress)):
        (tmp_path / "in" / name).write_bytes(pack(warc.arc_file(records, version)))
    members = b"".join(gzip.compress(x) for x in (warc.arc_file([], 1), b"http://m/ 1.2.3.4 19990102030405 text/html 7\nHTTP/1\n\n"))
    (tmp_path / "in" / "three.arc.gz").write_bytes(members)
    warc.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"), warc.WarcParams(file_bytes=2000))
    found = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert len(found) == 105 == len({r.record_id for r in found}) and all(r.page_id is None for r in found)
    assert Counter(r.record_type for r in found) == {"response": 101, "resource": 4}
    assert {r.date for r in found if r.url == "dns:a.b"} == {"1999-01-01T00:00:00Z"}
    by_url = {r.url: r.payload_digest for r in found}
    assert by_url["http://a.b/7"] == warc.sha1_base32(b"\n\nbody \xff\n7") and by_url["dns:a.b"] == warc.sha1_base32(b"a.b. 1 IN A 1.2.3.4\n")
    files = [x.read_bytes() for x in (tmp_path / "out").glob("part-*")]
    assert len(files) > 10
    for data in files:  # each begins with its description, and each record is a member of its own
        kinds = [f["WARC-Type"] for f, _ in warc.read_warc([gzip.decompress(data)])]
        assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == 1 and data.count(b"\x1f\x8b\x08") >= len(kinds)


@pytest.mark.parametrize("n", [None, 0, 1, -1, 2**62, -(2**63), 2**63 - 1])
def test_record_ids_hold_numbers(n):
    assert warc.numbered(warc.record_id(n)) == n


# --- urls -------------------------------------------------------------------


def test_urls_split_and_rules(spark):
    rows = [(1, None), (2, "no host"), (3, "HTTP://Www.Example.ORG/es/1?x#y"), (4, "http://example.org/en/12"), (5, "http://org/"), (6, "x://a.com/fr/"), (7, "x://a.com/de"), (8, "x://b.com?/fr/"), (9, "x://b.com/a://c/d"), (10, "http://notorg/"), (11, "http://é.Com/de/É\n#"), (None, "http://example.org")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, none).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/12", "example.org/en/1", "block"),
        5: ("org", "/", "org/", "allow"), 6: ("a.com", "/fr/", "com/fr/", "allow"), 7: ("a.com", "/de", None, "allow"), 8: ("b.com", "", None, "allow"), 9: ("b.com", "/a://c/d", None, "allow"),
        10: ("notorg", "/", None, "allow"), 11: ("é.com", "/de/É\n", "com/de/", "block"), None: ("example.org", "", None, "allow"),
    }
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_templates_reject_bad_branches(spark):
    rows, marks = [], []
    for i in range(400):
        kind = ("spam", "news", "blog")[i % 3]
        rows.append((i, f"http://h.net/{kind}/{i}.html"))
        if i % 2:
            marks.append((i, kind == "spam" and i % 10 != 1))
    rows += [(1000 + i, f"http://h.net/spam/other-{i}") for i in range(3)] + [(2000, "http://other.net/spam/1")]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*marks, (1, None), (3, True)], "page_id long, bad boolean")).collect()
    verdict = {r.page_id: r.verdict for r in found}
    assert all(verdict[i] == ("block" if i % 3 == 0 else "allow") for i in range(400))
    assert verdict[2000] == "allow"
    templates = {r.template for r in found if r.host == "h.net" and r.page_id < 400}
    assert len(templates) < 4  # alike branches share one


def test_bad_sections_of_a_branched_host_are_rejected(spark):
    rows = [(i, f"http://hot.net/section{chr(97 + i % 26)}{chr(97 + i % 31)}/{i}.html") for i in range(26 * 31 * 4)]  # 806 even sections
    rows = [(i, u.replace("/section", "/s") if i % 26 else f"http://hot.net/spam/{i}.html") for i, u in rows]  # 4 percent
    marks = [(i, i % 26 == 0) for i in range(len(rows)) if i % 2 == 0]
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad boolean")).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == {i for i in range(len(rows)) if i % 26 == 0}


def verdicts(spark, rows, marks):
    found = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad boolean")).collect()
    return {r.page_id: (r.verdict, r.template) for r in found}


def test_deep_branches_have_verdicts_of_their_own(spark):
    rows = [(i, f"http://h.net/a/b/c/{'spam' if i % 2 else 'news'}/d/e/{i}") for i in range(200)]
    rows += [(500 + i, f"http://h.net/a/b/c/spam/d/e/{i}/" + "x/" * 3000) for i in range(3)]  # very long, without labels
    got = verdicts(spark, rows, [(i, i % 2 == 1) for i in range(200)])
    assert {got[i][0] for i in range(1, 200, 2)} == {"block"} and {got[i][0] for i in range(0, 200, 2)} == {"allow"}


def test_inner_branches_merge_where_they_behave_alike(spark):
    kinds = [(s, k) for s in ("en", "de", "fr", "mixed") for k in ("spam", "news")] * 40
    rows = [(i, f"http://h.net/{s}/{k}/{i}") for i, (s, k) in enumerate(kinds)]
    bad = [(k == "spam") != (s == "mixed") for s, k in kinds]  # one section is the other way round
    got = verdicts(spark, rows, list(enumerate(bad)))
    assert all((got[i][0] == "block") == b for i, b in enumerate(bad))
    templates = {s: {got[i][1] for i, (x, _) in enumerate(kinds) if x == s} for s, _ in kinds}
    assert templates["en"] == templates["de"] == templates["fr"] and not templates["en"] & templates["mixed"]


# --- languages --------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.LanguageParams(sample_rows=75)
    seen = language.sampled(docs, p)[1].select("doc_id")
    assert 200 < seen.count() < 400
    languages, logs = language.fit(docs, p)
    evidence = language.page_evidence(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), page_document())
    found = language.identify(docs, evidence, languages, logs, p).join(docs.select("doc_id", "lang"), "doc_id").join(seen, "doc_id", "left_anti")
    total, right = found.count(), found.where("language = lang").count()
    assert total > 500 and right / total > 0.98


def test_odd_rows_and_evidence(spark):
    docs = [(i, "the and of that with for this " * 5, "en", "s") for i in range(50)] + [(100 + i, "der die das und nicht mit ist " * 5, "de", "s") for i in range(50)]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, source string, scores double")
    languages, logs = language.fit(frame, language.LanguageParams())
    assert languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None, None, None, 1.0), (2, "", None, "s", 1.0), (None, "und nicht mit", None, None, 1.0), (3, "ab", None, "t", 1.0), (3, "ab", None, "t", 1.0)], frame.schema)
    told = spark.createDataFrame([(1, "a.b.de", None), (2, None, "de"), (3, "x.com", "qq")], "doc_id long, host string, declared string")
    got = sorted(((r.doc_id, r.language) for r in language.identify(odd, told, languages, logs).collect()), key=repr)
    assert len(got) == 5 and dict(got)[1] == "de" and dict(got)[2] == "de" and dict(got)[None] == "de"
    assert language.identify(odd.limit(0), told, languages, logs).count() == 0
    assert all(r.language is None for r in language.identify(odd, told, [], logs[:0]).collect())


def test_very_long_texts(spark):
    long = "the and of that with for this " * 200000
    frame = spark.createDataFrame([(1, long, "en", "s"), (2, "der die das und nicht", "de", "s")], "doc_id long, text string, lang string, source string")
    languages, logs = language.fit(frame, language.LanguageParams())
    none = spark.createDataFrame([], "doc_id long, host string, declared string")
    assert {r.doc_id: r.language for r in language.identify(frame, none, languages, logs).collect()} == {1: "en", 2: "de"}
    assert {r.doc_id: r["size"] for r in sharding.shard(frame).collect()} == {1: len(long) + 16, 2: 21 + 16}


def test_every_page_of_a_document_counts(spark):
    pages = spark.createDataFrame([(1, "http://a.com/5", "<html lang='de'>"), (2, "http://b.com/5", "<html lang=DE>"), (3, "http://c.com/5", "<html>"), (4, "http://c.com/x", "")], "page_id long, url string, html string")
    found = language.page_evidence(pages, page_document()).collect()
    assert sorted(map(tuple, found), key=repr) == [(5, "a.com", "de"), (5, "b.com", "de"), (5, "c.com", None)]
    docs = [(i, "the and of that with for this " * 5, "en", "s") for i in range(60)] + [(100 + i, "der die das und nicht mit ist " * 5, "de", "s") for i in range(20)]
    docs += [(5000, "", None, "s"), (5001, "", None, "s"), (5001, "", None, "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    languages, logs = language.fit(frame, language.LanguageParams())
    # German documents are shown by a.net and then by b.net; 5000 by a.net only; the last page of 5001 declares nothing
    told = [(100 + i, h, None) for i in range(20) for h in ("a.net", "b.net")] + [(5000, "a.net", None), (5001, "x.org", "de"), (5001, "y.org", "de"), (5001, "z.org", None)]
    got = language.identify(frame, spark.createDataFrame(told, "doc_id long, host string, declared string"), languages, logs).collect()
    assert len(got) == len(docs)
    assert all(r.language == ("en" if r.doc_id < 60 else "de") for r in got)
    assert {r.declared for r in got if r.doc_id == 5001} == {"de"}


def brute_languages(docs, evidence, languages, logs, p):
    """The fusion as loops over documents, pages and hosts."""
    n = len(languages)

    def soft(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    def score(text):
        raw = (text or "").encode().lower()
        found, _ = language._cells(pa.array([raw.decode()]), p.cells)
        sums = logs.astype(np.float32)[:, found].astype(float).sum(axis=1) * p.temper
        return sums - sums.max()

    pages = [[e for e in evidence if e[0] == d[0] and d[0] is not None] for d in docs]
    texts = [score(d[1]) for d in docs]
    by_text = [soft(x) for x in texts]
    known = lambda e: languages.index(e[2]) if e[2] in languages else n
    seen = np.zeros((n + 1, n))
    for own, mine in zip(pages, by_text, strict=True):
        for e in own:
            if e[2] is not None:
                seen[known(e)] += mine
    table = np.zeros((n + 1, n))
    for d in range(n + 1):
        for i in range(n):
            start = p.declared_weight * (0.9 if d == i else 0.1 / n)
            table[d, i] = np.log((seen[d, i] + start) / (seen[:, i].sum() + p.declared_weight))
    local = []
    for own, x in zip(pages, texts, strict=True):
        x, telling = np.array(x, float), [e for e in own if e[2] is not None]
        for e in telling:
            x += table[known(e)] / len(telling)
        for e in own:
            lang = language.SUFFIX_LANGUAGE.get((e[1] or "").split(".")[-1])
            if lang in languages:
                x[languages.index(lang)] += np.log(p.suffix_odds) / len(own)
        local.append(x)
    soft_local = [soft(x) for x in local]
    overall = (sum(soft_local) + p.prior_weight / n) / (len(docs) + p.prior_weight)
    elsewhere = lambda d: "none" if d[3] is None else "source:" + d[3]
    sites = [[e[1] if e[1] is not None else elsewhere(d) for e in own] or [elsewhere(d)] for d, own in zip(docs, pages, strict=True)]
    hosted = [[e[1] is not None for e in own] or [False] for own in pages]
    domain = lambda s, real: ".".join(s.split(".")[-2:]) if real and "." in s else s
    suffix = lambda s, real: s.split(".")[-1] if real else ""
    count = {}
    for own, real, x in zip(sites, hosted, soft_local, strict=True):
        for s, r in zip(own, real, strict=True):
            for key in (("site", s, domain(s, r), suffix(s, r)), ("domain", domain(s, r)), ("suffix", suffix(s, r))):
                c, total = count.get(key, (np.zeros(n), 0))
                count[key] = c + x, total + 1
    out = []
    for d, own, real, x, mine in zip(docs, sites, hosted, local, soft_local, strict=True):
        x = x.copy()
        for s, r in zip(own, real, strict=True):
            times = sum(y == s and z == r for y, z in zip(own, real, strict=True))
            above = overall
            for key in (("suffix", suffix(s, r)), ("domain", domain(s, r))):
                c, total = count[key]
                above = (c + p.prior_weight * above) / (total + p.prior_weight)
            c, total = count["site", s, domain(s, r), suffix(s, r)]
            x += np.log(np.maximum((c - mine * times + p.prior_weight * above) / (total - times + p.prior_weight), 1e-12)) / len(own)
        end = soft(x)
        out.append((d[0], languages[int(end.argmax())], round(float(end.max()), 4)))
    return sorted(out, key=repr)


def test_fusion_matches_brute_force(spark):
    """Six languages, one of them with a single row; documents on several hosts, on one, on none."""
    rng, words = np.random.default_rng(4), {x: [f"{x}{i}{x[::-1]}" for i in range(30)] for x in ("en", "de", "fr", "es", "qq", "rare")}
    docs = []
    for i in range(120):
        lang = ("en", "de", "fr", "es", "qq")[i % 5] if i else "rare"
        mixed = words[lang] + words["en" if i % 4 == 0 else lang]
        docs.append((i, " ".join(rng.choice(mixed, rng.integers(0, 12))) if i % 11 else None, lang, f"s{i % 3}" if i % 7 else None))
    docs[0] = (0, " ".join(words["rare"]), "rare", "s0")
    docs += [(None, "de1ed de2ed", None, "s1"), (5, docs[5][1], None, "s2")]
    hosts = ["a.b.de", "b.de", "x.com", "y.x.com", "single", "z.fr", None]
    evidence = [(int(d), hosts[rng.integers(7)], (None, "de", "en", "zz", "fr")[rng.integers(5)]) for d in rng.integers(0, 90, 150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    p = language.LanguageParams(cells=1 << 10)
    languages, logs = language.fit(frame, p)
    assert languages == ["de", "en", "es", "fr", "qq", "rare"]
    got = language.identify(frame, spark.createDataFrame(evidence, "doc_id long, host string, declared string"), languages, logs, p).collect()
    assert sorted(((r.doc_id, r.language, round(r.probability, 4)) for r in got), key=repr) == brute_languages(docs, evidence, languages, logs, p)


def test_every_labelled_language_is_told_apart(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 90 % 26)}{i % 90}w{j}" for j in range(20)), f"l{i % 90}", "s") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = language.LanguageParams(sample_rows=3)
    languages, logs = language.fit(frame, p)
    assert len(languages) == 90
    none = spark.createDataFrame([], "doc_id long, host string, declared string")
    assert language.identify(frame, none, languages, logs, p).join(frame.select("doc_id", "lang"), "doc_id").where("language = lang").count() > 890
    with pytest.raises(ValueError, match="labels"):
        language.fit(frame, language.LanguageParams(most_languages=50))


def test_registered_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    assert op8_language_id(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_gzip_members_and_small_pieces():
    raw = bytes(range(256)) * 5000
    for data in (gzip.compress(raw), gzip.compress(raw) + gzip.compress(b"more") + gzip.compress(b"") + bytes(200), raw):
        whole = raw + (b"more" if data.startswith(b"\x1f\x8b") and data.count(b"\x1f\x8b\x08") > 1 and len(data) > len(gzip.compress(raw)) else b"")
        assert b"".join(warc._inflated(data, step=100, most=1000)) == whole
