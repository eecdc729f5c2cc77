"""Near-duplicates: banded MinHash, odd-sketch filter, exact confirmation.

1. One pass makes a record for each document: size and digest of its shingle
   set, MinHash bands, and an odd sketch. The sketch folds MinHash samples (the
   smallest hash of each of many bins of one permutation) into a bitmap in
   which a bit is the parity of the samples that fall on it; the population
   count of two sketches' XOR says how many samples differ.
2. Equal sets collapse to their smallest document.
3. Of each band bucket only pairs with its smallest member, the head, count:
   first each document with the smallest of its heads, then with heads that
   are not in its component yet. Pairs that the sketches place far below the
   threshold are dropped; the rest are confirmed on full sets of shingles, as words.
4. Where a bucket still has members of different components, bounded blocks of
   members meet in memory: pairs across components that sketches don't rule
   out are confirmed there, and only links leave the task. Members of buckets
   larger than a block are first keyed anew, by the rarest shingles of each: linked
   sets share one of these, and texts that share a common part only do not.
5. Components of the confirmed links give the classes.

Links are lost only by chance: a pair at the threshold shares no band with
probability ``miss``, or has sketches beyond a tail bound of exp(-sigmas^2 / 2).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, composed
from .shared import arrow_batches, cut, mark, release, small
from .wordhash import U64, Words, buffers, mix, slices, trim, window_names

_LONG = pa.list_(pa.int64())


@dataclass(frozen=True)
class NearDupParams:
    """Two sets are linked if 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    rows: int = 4
    miss: float = 1e-9
    #: Samples (bins of one permutation) and bits of an odd sketch.
    bins: int = 1024
    sketch_bits: int = 2048
    sigmas: float = 5.5
    seed: int = 20240229
    #: Members of a bucket that meet in memory at once.
    block: int = 1024
    #: Cells in which the frequency of shingles is counted (any order of shingles is right, a good one is quick).
    cells: int = 1 << 20

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))


class _NumPy:
    """The functions that :func:`most_bits` needs, for arrays; for columns it is pyspark's module."""

    exp, sqrt, least, greatest = (staticmethod(x) for x in (np.exp, np.sqrt, np.minimum, np.maximum))
    lit = staticmethod(lambda x: x)


def most_bits(bins_a, bins_b, n_a, n_b, p: NearDupParams, f=_NumPy):
    """XOR count that a linked pair exceeds only beyond ``sigmas`` deviations, if at all.

    At the threshold t, sets of n_a and n_b elements have (n_a + n_b) / (1 + t)
    elements together; these fill u bins, of which a share t agrees. The rest of
    the samples differ, and each turns a random bit. The number of agreeing bins
    varies as a sample of u of these elements does, and with u itself; it comes in
    steps of two samples, so few steps have a long tail, which Bernstein's
    inequality allows for. No linked pair has more than two differing samples for
    each element that only one set has, and for small sets that limit is the lower one.
    """
    k, n, t = p.bins, p.sketch_bits, p.percent / 100
    union = (n_a + n_b) / (1 + t)
    empty = f.exp(union * math.log1p(-1 / k))
    u = k * (1 - empty)
    differ = f.greatest(bins_a + bins_b - 2 * t * u, f.lit(0.0))
    filled = k * empty * (1 - (1 + union / k) * empty)  # variance of the number of filled bins
    sampled = 4 * t * (1 - t) * u * (1 - u / (union + 1)) + 4 * t * t * filled
    fade = f.exp(differ * (-2 / n))
    spread = sampled * fade * fade + n / 4 * (1 - fade * fade) - differ * fade * fade
    tail = p.sigmas * p.sigmas / 3
    likely = n / 2 * (1 - fade) + tail + f.sqrt(tail * tail + p.sigmas * p.sigmas * (spread + 1))
    return f.least(likely, 2 * (1 - t) * union + 0.5)


def sketch(own: np.ndarray, p: NearDupParams) -> tuple[int, np.ndarray]:
    """Filled bins and odd sketch of a sorted set."""
    least = own[np.unique(own & U64(p.bins - 1), return_index=True)[1]]  # of each bin, as ``own`` is sorted
    parity = np.bincount((mix(least) % U64(p.sketch_bits)).astype(np.int64), minlength=p.sketch_bits) & 1
    return len(least), np.packbits(parity.astype(bool), bitorder="little").view("<i8")


def _shingles(column: pa.Array, k: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Shingle names of a batch in row order (two halves), and where each row's begin."""
    data, offsets = buffers(column)
    w = Words(data, offsets)
    n = len(w.starts)
    names = w.names(lower=True)
    value = np.zeros((2, n), U64)
    use = w.window_starts(k)
    full = window_names(names, k)
    value[:, : len(full[0])] = full
    for size in range(1, k):  # fewer words than a shingle: the whole sequence is one
        at = w.first[:-1][w.counts == size]
        if len(at):
            value[:, at] = np.stack(window_names(names, size))[:, at] ^ U64(size)
            use[at] = True
    begin = np.concatenate(([0], np.cumsum(use)))[w.first]
    return (value[0, use], value[1, use]), begin


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names of a row, sorted."""
    order = np.argsort(high)
    x, y = high[order], low[order]
    same = x[1:] == x[:-1]
    if (y[1:][same] != y[:-1][same]).any():  # different names with equal first halves
        order = np.lexsort((low, high))
        x, y = high[order], low[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    new = np.concatenate(([True], ~same))
    return x[new], y[new]


def word_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words; one of fewer words, but not none, is one shingle."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII space as in SPACE
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def _records(column: pa.Array, p: NearDupParams) -> list[pa.Array]:
    (found, low), begin = _shingles(column, p.shingle)
    rows, k = len(column), p.rows * p.bands
    counts, digests, bins, sketches = np.zeros(rows, np.int64), [None] * rows, np.zeros(rows, np.int64), [None] * rows
    for i in range(rows):
        if begin[i] < begin[i + 1]:
            own = _distinct(found[begin[i] : begin[i + 1]], low[begin[i] : begin[i + 1]])
            counts[i] = len(own[0])
            digests[i] = hashlib.blake2b(own[0].tobytes() + own[1].tobytes(), digest_size=16).digest()
            bins[i], sketches[i] = sketch(own[0], p)
    full = np.flatnonzero(counts)
    keys = np.zeros((len(full), p.bands), U64)
    rng = np.random.default_rng(p.seed)
    factors = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U64(2) + U64(1)
    shifts = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    if len(full):
        at, buffer = begin[:-1][full], np.empty_like(found)
        for i in range(k):
            np.multiply(found, factors[i], out=buffer)
            buffer += shifts[i]
            least = mix(np.minimum.reduceat(buffer, at) + U64(i))
            keys[:, i // p.rows] = mix(keys[:, i // p.rows] * factors[0] + least)
    bands = [None] * rows
    for j, i in enumerate(full):
        bands[i] = keys[j].astype(np.int64)
    return [pa.array(counts), pa.array(digests, pa.binary()), pa.array(bands, _LONG), pa.array(bins), pa.array(sketches, _LONG)]


def signatures(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, bins, sketch) of each row; no words, no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                cols = [batch.column("doc_id").slice(a, b - a), *_records(batch.column("text").slice(a, b - a), p)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "bands", "bins", "sketch"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, bins long, sketch array<long>"
    )


def _possible(p: NearDupParams):
    """By size (intersection / union is at most smaller / larger), and by sketch."""
    sizes = 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")
    differing = F.col("sketch_a")[0].bitwiseXOR(F.col("sketch_b")[0])
    bits = F.bit_count(differing)
    for i in range(1, p.sketch_bits // 64):
        bits = bits + F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i]))
    return sizes & (bits <= most_bits(F.col("bins_a"), F.col("bins_b"), F.col("n_a"), F.col("n_b"), p, F))


def _filtered(pairs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs that sizes and sketches don't rule out."""
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    return cut(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").where(_possible(p)).select("a", "b")


class _Graph:
    """Confirmed links and the components they make, growing pass by pass."""

    def __init__(self, docs: DataFrame, p: NearDupParams):
        self.docs, self.p = docs, p
        spark = docs.sparkSession
        self.links = self.tested = spark.createDataFrame([], "a long, b long")
        self.texts = spark.createDataFrame([], "doc_id long, text string")
        self.found = spark.createDataFrame([], "v long, component long")

    def fetch(self, ids: DataFrame, name: str) -> None:
        """Makes sure that ``texts`` has these documents."""
        more = cut(ids.join(self.texts, "doc_id", "left_anti"), f"{name}-ids")
        if more.limit(1).count():
            found = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(more, "doc_id")
            self.texts = self.texts.union(cut(found.where("text is not null").select("doc_id", "text"), f"{name}-texts"))

    def confirm(self, pairs: DataFrame, name: str) -> None:
        """Checks pairs on their full sets."""
        pairs = cut(pairs, name)
        if pairs.limit(1).count():
            self.fetch(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), name)
            self.tested = self.tested.union(pairs)
            self.add(_confirmed(pairs, self.texts, self.p), name)

    def add(self, links: DataFrame, name: str) -> None:
        new = cut(links, f"{name}-links")
        if not new.limit(1).count():
            return
        self.links = self.links.union(new)
        # only what the new links join of the components so far
        ends = self.label(self.label(new, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        fresh = new.select(F.col("a").alias("v")).union(new.select("b")).distinct().join(self.found.select("v"), "v", "left_anti")
        self.found = composed(self.found.union(fresh.select("v", F.col("v").alias("component"))), components(ends))

    def label(self, rows: DataFrame, of: str, name: str) -> DataFrame:
        """``rows`` with the component of column ``of`` as ``name``."""
        found = self.found.select(F.col("v").alias(of), F.col("component").alias("_component"))
        return rows.join(found, of, "left").withColumn(name, F.coalesce("_component", of)).drop("_component")


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, raw = word_shingles(a.as_buffer().to_pybytes(), p.shingle), b.as_buffer().to_pybytes()
                if raw != last:  # rows come in the order of b
                    last, y = raw, word_shingles(raw, p.shingle)
                keep.append(_linked(len(x & y), len(x), len(y), p))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def _rekeyed(wide: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, doc_id): the rarest shingles of each of these documents, so many that linked ones share one.

    Linked sets have at least the share ``percent`` of each in common, so one of the
    first n - ceil(percent * n) + 1 shingles of both, in any order that is the same for all. Rare
    ones come first: a text brings about (1 - percent) of its shingles, and those
    that nobody else has meet nobody.
    """
    spark = wide.sparkSession
    rows = texts.join(wide.select("doc_id").distinct(), "doc_id").select("doc_id", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.cells, np.int64)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                total += np.bincount((_shingles(batch.column("text").slice(a, b - a), p.shingle)[0][0] % U64(p.cells)).astype(np.int64), minlength=p.cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])
        trim()

    often = np.zeros(p.cells, np.int64)
    sums = rows.select("text").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()  # at most ``cells`` rows
    model = spark.sparkContext.broadcast(often)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = model.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                (found, _), begin = _shingles(batch.column("text").slice(a, b - a), p.shingle)
                ids, keys = [], [np.zeros(0, U64)]
                for i in range(b - a):
                    own = np.unique(found[begin[i] : begin[i + 1]])
                    n = len(own) - -(-p.percent * len(own) // 100) + 1 if len(own) else 0
                    keys.append(own[np.argsort(frequency[(own % U64(p.cells)).astype(np.int64)], kind="stable")[:n]])
                    ids.append(n)
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), ids)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), ids], names=["key", "doc_id"])
        trim()

    return rows.mapInArrow(rarest, "key long, doc_id long").distinct()


def _dealt(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """Members of buckets, in pairs of blocks (key, low, high) of bounded size.

    A bucket of more than ``block`` members is dealt into blocks by id, and each
    pair of blocks is a group of its own: no task holds more of a bucket.
    """
    n = F.ceil(F.col("size") / p.block).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), n).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})


def _mixed(members: DataFrame) -> DataFrame:
    """Members (key, doc_id, component) of keys that have several components, with the ``size`` of each key."""
    keys = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x < y")
    return members.join(cut(keys.select("key", "size"), "mixed"), "key")


class _Members:
    """A pair of blocks of one bucket in memory."""

    def __init__(self, group: pa.Table, p: NearDupParams):
        self.p = p
        self.ids, self.comp, self.size, self.bins, self.mine = (group.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "bins", "mine"))
        self.comp = self.comp.copy()  # links found here join components here
        self.flat = np.stack(group.column("sketch").to_numpy()).view(U64)
        self.bands = np.stack(group.column("bands").to_numpy()).reshape(group.num_rows, -1)  # before this key's own
        self.two = group.column("low")[0].as_py() != group.column("high")[0].as_py()

    def partners(self, i: int) -> np.ndarray:
        """Members before i in other components that sizes and sketches don't rule out, if this is their first common band."""
        p, size = self.p, self.size
        ok = (self.comp[:i] != self.comp[i]) & (100 * np.minimum(size[:i], size[i]) >= p.percent * np.maximum(size[:i], size[i]))
        if self.two:
            ok &= self.mine[:i] != self.mine[i]
        at = np.flatnonzero(ok)
        bits = np.bitwise_count(self.flat[at] ^ self.flat[i]).sum(axis=1)
        at = at[bits <= most_bits(self.bins[at], self.bins[i], size[at], size[i], p)]
        return at[~(self.bands[at] == self.bands[i]).any(axis=1)]


def _in_play(dealt: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, low, high, doc_id) of members that have a possible partner in another component."""

    def run(group: pa.Table) -> pa.Table:
        found = _Members(group, p)
        use = np.zeros(group.num_rows, bool)
        for i in range(group.num_rows):
            at = found.partners(i)
            use[at] = True
            use[i] |= len(at) > 0
        return group.select(["key", "low", "high", "doc_id"]).filter(pa.array(use))

    return dealt.groupBy("key", "low", "high").applyInArrow(run, "key long, low int, high int, doc_id long")


def _across(dealt: DataFrame, p: NearDupParams) -> DataFrame:
    """Links across components of a bucket, confirmed on the texts that the members bring.

    Pairs never leave the task; once a link has joined two components, they need no other.
    """

    def run(group: pa.Table) -> pa.Table:
        found = _Members(group, p)
        texts = group.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        (names, _), begin = _shingles(texts, p.shingle)
        sets = [np.unique(names[begin[i] : begin[i + 1]]) for i in range(group.num_rows)]
        a, b = [], []
        for i in range(group.num_rows):
            at, words = found.partners(i), None
            while len(at):
                both = np.concatenate((sets[i], sets[at[0]]))
                both.sort()
                linked = _linked(int((both[1:] == both[:-1]).sum()), len(sets[i]), len(sets[at[0]]), p)
                if linked:  # by hashes: now by words
                    words = words or word_shingles(texts[i].as_buffer().to_pybytes(), p.shingle)
                    other = word_shingles(texts[at[0]].as_buffer().to_pybytes(), p.shingle)
                    linked = _linked(len(words & other), len(words), len(other), p)
                if linked:
                    a.append(found.ids[i])
                    b.append(found.ids[at[0]])
                    found.comp[found.comp == found.comp[at[0]]] = found.comp[i]
                    at = at[found.comp[at] != found.comp[i]]
                else:
                    at = at[1:]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _linked(common: int, n_a: int, n_b: int, p: NearDupParams) -> bool:
    return 100 * common >= p.percent * (n_a + n_b - common)


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    docs has ``doc_id`` (integers) and ``text``; other columns are ignored.
    Null or empty texts, or texts without words, have an empty set and are
    linked with nothing. Rows that share a doc_id count as one document with
    the links of all of them, and each is returned. Rows with a null doc_id are not
    compared and are kept with a null component. An empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession):
        return _classes(docs, p)


def _classes(docs: DataFrame, p: NearDupParams) -> DataFrame:
    start = mark()
    sig = cut(signatures(docs, p), "signatures")
    written = mark()
    named = sig.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    equal = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    nodes = sig.join(cut(equal, "equal"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "bands", "bins", "sketch")
    first = F.col("rep") == F.col("doc_id")
    nodes = cut(nodes.select("doc_id", "n_shingles", "rep", F.when(first, F.col("bands")).alias("bands"), "bins", F.when(first, F.col("sketch")).alias("sketch")), "nodes")
    release(written - 1, keep=mark() - written)  # the signatures are in the nodes now
    own = nodes.where("bands is not null")
    rows = own.select("doc_id", F.explode("bands").alias("key"))
    heads = cut(rows.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head"), "heads")
    shared = cut(rows.join(heads, "key"), "shared")  # rows of bands that nobody else has are gone
    twins = nodes.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    graph = _Graph(docs, p)

    # each document with the smallest head of its buckets, then with heads of other components
    stars = cut(shared.where(F.col("doc_id") != F.col("head")).select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct(), "all-stars")
    graph.confirm(_filtered(stars.groupBy("a").agg(F.min("b").alias("b")), own, p), "smallest")
    apart = graph.label(graph.label(stars, "a", "x"), "b", "y").where("x <> y").select("a", "b")
    graph.confirm(_filtered(apart.join(graph.tested, ["a", "b"], "left_anti"), own, p), "stars")

    # a doc_id of several texts has several band lists, and is a member by each of its keys
    members = graph.label(shared.select("key", "doc_id").distinct(), "doc_id", "component")
    left = cut(_mixed(cut(members, "members")), "mixed-members")
    wide = left.where(F.col("size") > p.block)
    left = left.where(F.col("size") <= p.block).withColumn("anew", F.lit(False))
    if wide.limit(1).count():
        graph.fetch(wide.select("doc_id").distinct(), "wide")
        again = graph.label(_rekeyed(wide, graph.texts, p), "doc_id", "component")
        left = left.union(_mixed(cut(again, "anew")).withColumn("anew", F.lit(True)).select(left.columns))
    left = left.join(own.select("doc_id", "n_shingles", "bins", "bands", "sketch"), "doc_id")
    place = F.array_position("bands", F.col("key")).cast("int")
    left = left.where(F.col("anew") | (place > 0))
    left = left.withColumn("bands", F.when(F.col("anew"), F.array().cast("array<bigint>")).otherwise(F.slice("bands", 1, F.greatest(place - 1, F.lit(0)))))  # those before the key's own
    left = cut(left, "left")  # with sketches, for both passes below
    play = cut(_in_play(_dealt(left, p), p), "play")
    if play.limit(1).count():
        graph.fetch(play.select("doc_id").distinct(), "across")
        brought = _dealt(left, p).join(play.distinct(), ["key", "low", "high", "doc_id"]).join(graph.texts, "doc_id")
        graph.add(_across(brought, p), "across")

    same = nodes.groupBy("doc_id").agg(F.min("rep").alias("lowest"), F.max("rep").alias("highest")).where("lowest < highest")
    if same.limit(1).count():  # rows that share a doc_id but not a set: the whole graph anew
        out = nodes.join(components(graph.links.union(twins)).withColumnRenamed("v", "doc_id"), "doc_id", "left")
    else:
        out = nodes.join(graph.found.withColumnRenamed("v", "rep"), "rep", "left")
    out = cut(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "classes")
    release(start, keep=1)
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_first(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with their own columns.

    One document a group stays. Of rows that share its doc_id and text one stays;
    rows with another text under that doc_id are part of it and stay. Rows without a doc_id
    are not compared and all stay. Null texts, empty texts and texts without words are
    groups of their own; other columns may have any name; an empty table gives no rows.
    """
    found = near_duplicates(docs, p).where("doc_id is not null")
    # texts meet the ids that go, which are fewer than those that stay
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    twice = cut(found.where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"), "twice")
    out = docs.join(small(gone), docs["doc_id"] == gone["_id"], "left_anti")
    if twice.limit(1).count():
        again = out.join(twice, out["doc_id"] == twice["_id"], "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(twice, out["doc_id"] == twice["_id"], "left_anti").union(again)
    return out
