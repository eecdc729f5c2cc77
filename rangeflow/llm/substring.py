"""Substring deduplication with difference-cover anchors.

A *window* is ``window`` consecutive words; every window that also starts
earlier in the corpus is removed, and with it all words it covers.

Comparing all windows would shuffle a name for every word. Instead each
document hashes short *anchors* only where its word number modulo a period lies in
a difference cover: any two numbers have a common shift, below the period, that
takes both into the cover. So two equal windows always share an anchor at the
same offset, and where no anchor repeats no window does. Repeated anchors
extend to the full windows around them, which get 128-bit names; the first
holder of each name keeps it.

Documents are dealt into blocks of bounded bytes by their id and text. A block sends each
name once, in packed arrays for a bucket of names, and hears back which of them others have:
the traffic of a name is one entry for each block, however often it occurs, and no
group of occurrences meets in a task. The three passes over the blocks read
one and the same shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import shuffle_partitions
from .wordhash import U64, Words, buffers, covered, slices, window_names

#: Difference covers: every residue modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

NO_ID = np.iinfo(np.int64).max
#: A block is told of its own windows, among which 80 bits of a name are enough.
SHORT = U64(0xFFFF)
#: ``first`` of an anchor says whether its block has it twice; of a window it numbers the
#: block's ``ids``, which holds the first document of each name (id, and place among equal ids).
_NAMES = "bucket int, block int, high binary, low binary, first binary, ids binary"


@dataclass(frozen=True)
class SubstringParams:
    window: int = 20
    period: int = 13
    #: Blocks for each shuffle partition: even loads need a few, and larger inputs more.
    blocks_per_partition: int = 8
    block_bytes: int = 32 << 20
    #: Shuffle partitions for each bucket of names. Every block sends a row to
    #: every bucket, so buckets are as few as their memory allows: one for this much text.
    partitions_per_bucket: int = 3
    bucket_bytes: int = 128 << 20

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


class _Block:
    """The words of one slice of a block, with anchors and window names."""

    def __init__(self, column: pa.Array, p: SubstringParams):
        self.data, self.offsets = buffers(column)
        self.words, self.p = Words(self.data, self.offsets), p
        self.valid = self.words.window_starts(p.window)
        self.halves = self.words.names()
        self._names = None

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and word numbers of the anchors in rows that have a window."""
        w, p = self.words, self.p
        n = len(w.starts) - p.anchor + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        place = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)
        in_cover = np.zeros(p.period, bool)
        in_cover[list(COVERS[p.period])] = True
        long_row = np.repeat(w.counts >= p.window, w.counts)
        at = np.flatnonzero((in_cover[place % p.period] & long_row & w.window_starts(p.anchor))[:n])
        return window_names(self.halves[:1], p.anchor)[0][at], at

    def around(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at the given words."""
        marks = np.zeros(len(self.words.starts), bool)
        marks[at] = True
        total = np.concatenate(([0], np.cumsum(marks)))
        here = np.arange(len(marks))
        return np.flatnonzero(self.valid & (total[np.minimum(here + self.p.period, len(marks))] > total[here]))

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows at ``starts``."""
        if not len(starts):
            return np.zeros(0, U64), np.zeros(0, U64)
        if self._names is None:
            self._names = window_names(self.halves, self.p.window)
        return self._names[0][starts], self._names[1][starts]


def _ordered(block: pa.Table) -> pa.Table:
    """Rows by id, null ids last, then by place: the order in which windows count as earlier."""
    keys = ("doc_id", "place", "text")
    return block.select(list(keys)).combine_chunks().sort_by([(c, "ascending") for c in keys])


def _parts(table: pa.Table, p: SubstringParams):
    """Slices of the ordered block: numbers of their first rows, and their words."""
    column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    for a, b in slices(column):
        yield a, _Block(column.slice(a, b - a), p)


def _places(table: pa.Table) -> np.ndarray:
    """(id, place) of each row; the least is the earliest."""
    return np.stack([table.column(c).fill_null(NO_ID).to_numpy() for c in ("doc_id", "place")], axis=1)


def _unpack(table: pa.Table, name: str, kind=U64) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _send(block: int, high: np.ndarray, low: np.ndarray | None, first: np.ndarray, buckets: int, places: np.ndarray | None = None) -> pa.Table:
    """Names, sorted, as one row for each bucket."""
    bucket = ((high >> U64(33)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    firsts, ids = [first[g].tobytes() for g in groups], [None] * len(groups)
    if low is not None:
        firsts, ids = zip(*[_numbered(first[g], places) for g in groups], strict=True) if groups else ([], [])
    return pa.table(
        {
            "bucket": pa.array([bucket[g[0]] for g in groups], pa.int32()),
            "block": pa.array([block] * len(groups), pa.int32()),
            "high": pa.array([high[g].tobytes() for g in groups], pa.binary()),
            "low": pa.array([low[g].tobytes() if low is not None else None for g in groups], pa.binary()),
            "first": pa.array(firsts, pa.binary()),
            "ids": pa.array(ids, pa.binary()),
        }
    )


def _numbered(rows: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes]:
    """Rows as short numbers of the distinct ones, and the places of these."""
    distinct, at = np.unique(rows, return_inverse=True)
    return at.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32).tobytes(), places[distinct].tobytes()


def _firsts(table: pa.Table) -> np.ndarray:
    """The places of what :func:`_numbered` was given, of all rows."""
    out = [np.zeros((0, 2), np.int64)]
    for number, ids in zip(table.column("first"), table.column("ids"), strict=True):
        distinct = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, 2)
        out.append(distinct[np.frombuffer(number.as_buffer(), np.uint16 if len(distinct) <= 1 << 16 else np.uint32)])
    return np.concatenate(out)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _first_of_each(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where each pair occurs first, in the order of pairs."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order[new]


def _pair_member(high: np.ndarray, low: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Which pairs are among the sorted pairs (highs, lows)."""
    found = np.zeros(len(high), bool)
    left = np.flatnonzero(_member(high, highs))
    at = np.searchsorted(highs, high[left])
    while len(left):
        found[left[lows[at] == low[left]]] = True
        at += 1  # the next pair may have the same first half
        more = at < len(highs)
        more[more] = highs[at[more]] == high[left[more]]
        left, at = left[more], at[more]
    return found


def remove_repeats(docs: DataFrame, p: SubstringParams = SubstringParams(), with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs``.

    docs has ``doc_id`` (integers) and ``text``; other columns are ignored. A
    null text has no words. Rows that share a doc_id, or have none, are
    ordered among themselves by Spark's ``xxhash64`` of the text, then by the text (rows without
    an id come last), so that no id keeps its rows together; of
    repeated rows the first keeps its words. Texts shorter than a window are
    returned whole. An empty table gives no rows. The size of the texts is
    summed first, so that blocks and buckets hold bounded bytes at any size.
    """
    if p.period not in COVERS or p.window < p.period:
        raise ValueError("no difference cover for this period, or the window is too short")
    partitions = shuffle_partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = max(partitions * p.blocks_per_partition, -(-total // p.block_bytes))
    buckets = max(8, partitions // p.partitions_per_bucket, -(-total // p.bucket_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.xxhash64("text"))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "place"), F.lit(n_blocks)).cast("int")).groupBy("block")

    def anchors(group: pa.Table) -> pa.Table:
        found = [b.anchors()[0] for _, b in _parts(_ordered(group), p)]
        names, count = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
        return _send(group.column("block")[0].as_py(), names, None, count > 1, buckets)

    def repeated(group: pa.Table) -> pa.Table:
        """For each block: which of its anchors occur twice or more in all."""
        blocks, own = [], []
        for x in group.column("high"):
            own.append(np.frombuffer(x.as_buffer(), U64))
        every, twice = np.concatenate(own), _unpack(group, "first", bool)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        again = np.zeros(len(every), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again |= twice
        names, at = [], 0
        for x, b in zip(own, group.column("block").to_pylist(), strict=True):
            if (hit := again[at : at + len(x)]).any():
                blocks.append(b)
                names.append(x[hit].tobytes())
            at += len(x)
        return pa.table({"block": pa.array(blocks, pa.int32()), "high": pa.array(names, pa.binary())})

    def extend(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _send(0, np.zeros(0, U64), None, np.zeros(0, np.int64), buckets)
        again, table = np.sort(_unpack(reply, "high")), _ordered(group)
        high, low, first = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for row, b in _parts(table, p) if len(again) else ():
            names, at = b.anchors()
            starts = b.around(at[_member(names, again)])
            h, w = b.names(starts)
            high.append(h)
            low.append(w)
            first.append(row + b.words.row_of_word()[starts])
        high, low = np.concatenate(high), np.concatenate(low)
        at = _first_of_each(high, low)  # rows are in order: the first is the earliest
        return _send(group.column("block")[0].as_py(), high[at], low[at], np.concatenate(first)[at], buckets, _places(table))

    def later(group: pa.Table) -> pa.Table:
        """For each block: which of its windows start earlier in another block."""
        own = [np.frombuffer(x.as_buffer(), U64) for x in group.column("high")]
        high, low, first = np.concatenate(own), _unpack(group, "low"), _firsts(group)
        order = np.lexsort((first[:, 1], first[:, 0], low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        lost = np.zeros(len(high), bool)
        lost[order[1:][same]] = True
        blocks, highs, lows, at = [], [], [], 0
        for x, b in zip(own, group.column("block").to_pylist(), strict=True):
            if (hit := lost[at : at + len(x)]).any():
                blocks.append(b)
                highs.append(x[hit].tobytes())
                lows.append((low[at : at + len(x)][hit] & SHORT).astype(np.uint16).tobytes())
            at += len(x)
        return pa.table({"block": pa.array(blocks, pa.int32()), "high": pa.array(highs, pa.binary()), "low": pa.array(lows, pa.binary())})

    def judge(group: pa.Table, reply: pa.Table) -> pa.Table:
        table = _ordered(group) if group.num_rows else group.select(["doc_id", "text"])
        highs, lows = _unpack(reply, "high"), _unpack(reply, "low", np.uint16)
        order = np.lexsort((lows, highs))
        highs, lows = highs[order], lows[order]
        parts = list(_parts(table, p)) if group.num_rows else []
        anchors_of = [b.anchors() for _, b in parts]
        names, count = np.unique(np.concatenate([x[0] for x in anchors_of]) if parts else np.zeros(0, U64), return_counts=True)
        twice, seen = names[count > 1], []
        gone = [np.zeros(len(b.words.starts), bool) for _, b in parts]
        for i, ((_, b), (own, at)) in enumerate(zip(parts, anchors_of, strict=True)):
            starts = np.flatnonzero(b.valid) if len(highs) else np.zeros(0, np.int64)
            high, low = b.names(starts)
            gone[i][starts[_pair_member(high, (low & SHORT).astype(np.uint16), highs, lows)]] = True
            starts = b.around(at[_member(own, twice)])
            high, low = b.names(starts)
            seen.append((high, low, np.full(len(starts), i), starts))
        if seen:  # windows found before in this very block
            high, low, part, starts = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((np.arange(len(high)), low, high))
            same = order[1:][(high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])]
            for i in range(len(parts)):
                gone[i][starts[same[part[same] == i]]] = True
        n_words, n_removed, digests, texts = [], [], [], []
        for (_, b), flags in zip(parts, gone, strict=True):
            away, w, raw = covered(flags, p.window), b.words, b.data.tobytes()
            total = np.concatenate(([0], np.cumsum(away)))
            for row in range(len(w.counts)):
                x, y = w.first[row], w.first[row + 1]
                kept = raw[b.offsets[row] : b.offsets[row + 1]].split()
                if total[y] > total[x]:
                    kept = [word for word, off in zip(kept, away[x:y].tolist(), strict=True) if not off]
                flat = b" ".join(kept)
                n_words.append(int(y - x))
                n_removed.append(int(total[y] - total[x]))
                digests.append(hashlib.sha256(flat).hexdigest())
                if with_text:
                    texts.append(flat.decode("utf-8"))
        cols = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    again = dealt.applyInArrow(anchors, _NAMES).groupBy("bucket").applyInArrow(repeated, "block int, high binary")
    named = dealt.cogroup(again.groupBy("block")).applyInArrow(extend, _NAMES)
    lost = named.groupBy("bucket").applyInArrow(later, "block int, high binary, low binary")
    return dealt.cogroup(lost.groupBy("block")).applyInArrow(judge, StructType.fromDDL(out))
