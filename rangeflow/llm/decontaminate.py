"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of benchmark words become patterns over normalised text: its words in
lower case, each a number of a few digits (all words that no item has are one). Each
document is normalised once and scanned once; the automaton reports where matches end,
which maps back to word numbers and to code points of the original text.

An automaton holds a state for each digit of a window, so its size is checked: a
benchmark of more bytes than ``AUTOMATON_BYTES`` stays distributed. Then each
document's windows are looked up in a bitmap of bounded size, and those found
there join the benchmark's windows by their 128-bit names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut, disguised
from .wordhash import U64, Words, buffers, trim, window_names

#: Bytes to bytes: A-Z in lower case, separators (ASCII but 0-9 and a-z) to a space.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Which bytes of a raw text separate words.
SEPARATES = np.array([NORMAL[b] == 0x20 for b in range(256)])
#: The same for normalised bytes.
NORMAL_BYTES, SPACE_ONLY = np.frombuffer(NORMAL, np.uint8), np.arange(256) == 0x20

#: Bytes of benchmark text that an automaton takes: a window starts at each word, and its words have two or three
#: digits with a state of about 60 bytes each, so some 200 bytes a byte.
AUTOMATON_BYTES = 1 << 20
#: Digits of word numbers; the first of a word is of another kind, so matches begin where words do. Nodes search
#: their branches one by one, so a digit has few values.
LEADS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "~"
#: Bits of the bitmap that stands in for a larger benchmark, at most (the driver makes it of so many / 64 rows).
FILTER_BITS = 1 << 26


def item_windows(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The windows of an item; one of fewer words, but not none, is one window."""
    found = (text or "").encode("utf-8").translate(NORMAL).split()
    n = max(1, len(found) - k + 1) if found else 0
    return {tuple(found[i : i + k]) for i in range(n)}


class Matcher:
    """The automaton over numbered words; patterns carry their number of words and the items that have them."""

    def __init__(self, items: list[tuple], k: int):
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            for window in item_windows(text, k):
                owners.setdefault(window, set()).add(item_id)
        words = sorted({w for window in owners for w in window})
        self.numbers = dict(zip(words, self._numbers(len(words)), strict=True))
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word("".join([self.numbers[w] for w in window]), (len(window), tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    @staticmethod
    def _numbers(n: int) -> list[str]:
        size = 1
        while len(LEADS) * len(DIGITS) ** (size - 1) < n:
            size += 1
        return ["".join(x) for x in itertools.islice(itertools.product(LEADS, *[DIGITS] * (size - 1)), n)]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, tuple]]]:
        """Number of words, and the matches as (first word, end word, items)."""
        found = text.translate(NORMAL).split()
        if not found or not len(self.automaton):
            return len(found), []
        parts = list(map(self.numbers.get, found, itertools.repeat(UNKNOWN)))
        matches = list(self.automaton.iter("".join(parts)))
        if not matches:
            return len(found), []
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        lasts = np.searchsorted(ends, [at + 1 for at, _ in matches]) + 1
        return len(found), [(int(last) - n, int(last), ids) for last, (_, (n, ids)) in zip(lasts, matches, strict=True)]


ADDED = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "hit_spans array<struct<`start`:long,`end`:long>>"
)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words in order, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _spans(doc: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as code points of the original text (worked out only where there are any)."""
    if not runs:
        return []
    data = np.frombuffer(doc, np.uint8)
    words = Words(data, np.array([0, len(data)]), SEPARATES)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(points[words.starts[a]]), "end": int(points[words.ends[b - 1]])} for a, b in runs]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, automaton_bytes: int = AUTOMATON_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Which words of each document lie in benchmark windows.

    ``hit_spans`` are code points of the original text, merged and in order.
    Null or empty texts have no words and are never hit; an item with a null
    text has no windows, one with a null id marks words but is not counted;
    repeated items with one id count once; an empty benchmark hits nothing; repeated
    rows each get a row, an empty table gives none.
    Other columns are ignored, those named in ``carry`` returned unchanged.
    One pass over the documents, without a shuffle, if the benchmark has at most
    ``automaton_bytes`` of text (only then does it leave the executors).
    """
    asked = benchmark.select("item_id", "text").where(F.octet_length("text") > 0)
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    added = StructType.fromDDL(ADDED)
    schema = StructType([*docs.select("doc_id", *carry).schema.fields, *added.fields])
    names = ["doc_id", *carry]
    wanted = ["doc_id", *[c for c in carry if c != "text"], "text"]
    if size > automaton_bytes:
        return _joined(docs.select(*wanted), asked, window, least_items, names, schema)
    items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(items.value, window)
            words, runs, ids = [], [], []
            for _, doc in _texts(batch):
                n, found = matcher.scan(doc)
                words.append(n)
                runs.append([x[:2] for x in found])
                ids.append(set().union(*[x[2] for x in found]))
            yield _verdicts(batch, words, runs, ids, least_items, names, added)
        del matcher
        trim()

    return docs.select(*wanted).mapInArrow(run, schema)


def _verdicts(batch: pa.RecordBatch, words: list[int], runs: list[list], items: list[set], least: int, names: list[str], added: StructType) -> pa.RecordBatch:
    runs = [_merged(x) for x in runs]
    ids = [sorted(str(x) for x in own if x is not None) for own in items]
    made = {
        "n_words": words,
        "n_hit": [sum(b - a for a, b in x) for x in runs],
        "n_items": [len(x) for x in ids],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids],
        "contaminated": [len(x) >= least for x in ids],
        "hit_spans": [_spans(doc, runs[i]) for i, doc in _texts(batch)],
    }
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span)
    cols = [batch.column(c) for c in names] + [pa.array(made[c], k) for c, k in zip(added.names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[*names, *added.names])


def _named(column: pa.Array) -> tuple[Words, tuple[np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    w = Words(NORMAL_BYTES[data], offsets, SPACE_ONLY)
    return w, w.names()


def _joined(docs: DataFrame, asked: DataFrame, k: int, least: int, names: list[str], schema: StructType) -> DataFrame:
    """The same for a benchmark of any size: windows meet by name.

    Texts go by (doc_id, digest), as equal rows have equal results. A window's items are
    listed once, before any document meets them.
    """
    spark = docs.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, found = _named(batch.column("text"))
            item, n, high, low = [], [], [], []
            for size in range(1, k + 1):  # of an item with fewer words there is one window
                x, y = window_names(found, size)
                use = w.window_starts(size)[: len(x)]
                row = w.row_of_word()[: len(x)]
                at = np.flatnonzero(use & ((w.counts[row] == size) | (size == k)))
                item.append(row[at])
                n.append(np.full(len(at), size))
                high.append(x[at])
                low.append(y[at])
            cols = [batch.column("item_id").take(pa.array(np.concatenate(item)))]
            cols += [pa.array(np.concatenate(x).astype(np.int64)) for x in (n, high, low)]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "n", "high", "low"])
        trim()

    key = ["n", "high", "low"]
    windows = asked.mapInArrow(own, f"item_id {kind}, n long, high long, low long").groupBy(*key).agg(F.collect_set("item_id").alias("items"))
    windows = cut(windows, "windows")
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ``k``
    bits = min(FILTER_BITS, 1 << max(16, (16 * windows.count()).bit_length()))
    place = F.col("high").bitwiseAND(F.lit(bits - 1))
    marks = windows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(high & 63 as int))")).alias("mark")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[marks.column("word").to_numpy()] = marks.column("mark").to_numpy()
    model = spark.sparkContext.broadcast(bitmap.view(U64))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = model.value
        for batch in batches:
            for i, (_, doc) in enumerate(_texts(batch)):
                w, found = _named(pa.array([doc.decode("utf-8")]))
                for size in sizes:
                    x, y = window_names(found, size)
                    at = np.flatnonzero(marked[(x & U64(bits - 1)) >> U64(6)] >> (x & U64(63)) & U64(1))
                    if len(at):
                        where = [batch.column(c).take(pa.array([i] * len(at))) for c in ("doc_id", "digest")]
                        cols = [*where, pa.array(np.full(len(at), size)), pa.array(at), pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "n", "first", "high", "low"])
        trim()

    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    spots = docs.select("doc_id", "text", digest.alias("digest")).mapInArrow(seen, f"doc_id {id_kind}, digest string, n long, first long, high long, low long")
    met = cut(spots.distinct().join(windows, key), "met")
    of = [F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")]
    runs = met.groupBy(*of).agg(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("last"))).alias("_runs"))
    items = met.select(*of, F.explode_outer("items").alias("item")).groupBy("_doc", "_digest").agg(F.collect_set("item").alias("_items"))
    same = lambda a, b: a["_doc"].eqNullSafe(b["_doc"]) & (a["_digest"] == b["_digest"])
    hits = cut(runs.join(items, same(runs, items)).select(runs["_doc"], runs["_digest"], "_runs", "_items"), "hits")
    rows = docs.withColumn("_key", digest)
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_doc"]) & (rows["_key"] == hits["_digest"]), "left").drop("_doc", "_digest", "_key")
    added = StructType.fromDDL(ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [len(doc.translate(NORMAL).split()) for _, doc in _texts(batch)]
            found = [[(r["first"], r["last"]) for r in x or ()] for x in batch.column("_runs").to_pylist()]
            yield _verdicts(batch, words, found, [set(x or ()) for x in batch.column("_items").to_pylist()], least, names, added)
        trim()

    return rows.mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Row numbers and UTF-8 texts of a batch."""
    data, offsets = buffers(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, data[offsets[i] : offsets[i + 1]].tobytes()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns, whatever their names.

    Null and empty texts stay, null ids and repeated rows are rows like others, an empty table gives none.
    """
    rows, carry, back = disguised(docs)
    return decontaminate(rows, benchmark, carry=carry, **options).where(~F.col("contaminated")).select(*back)
