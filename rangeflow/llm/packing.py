"""Sequence packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are the powers of two in
n (the longest, ``max_tokens``, as often as it fits). Pieces of equal length
share a bucket and each is a sequence of its own: no sequence crosses
documents, and none is padded, as every length is a power of two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .wordhash import slices, trim

#: Texts of up to so many bytes are encoded at a time.
STEP_BYTES = 1 << 20
#: What split patterns differ on: contractions, letters beside digits and signs, runs of space, other scripts, marks.
PROBE = "Don't we'll I'M THEY'VE 12345x3.14 a_b--c?! #tag\t\tif (x):\r\n\r\n    return  y  \u00a0\u2003z e\u0301\u0301 \u0939\u093f \u65e5\u672c\u8a9e\u3067\u3059 \U0001f3fd\u200d antidisestablishmentarianism <|endoftext|> "


class Encoder:
    """Ids of a ``tokenizers`` file, by the quicker of two equal encoders.

    The file is read with ``tokenizers``. If the rank file holds the same
    vocabulary, no entry more or less but the added tokens, and both encode a probe alike
    (it tells other split patterns and merges apart), the merges run in ``tiktoken`` (same
    ids, several times the speed); otherwise ``tokenizers`` encodes.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.quick = None
        if ranks and pattern:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            letters = _byte_letters()
            named = {"".join(letters[b] for b in token): rank for token, rank in table.items()}
            added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            if named == {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in added}:
                quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
                if quick.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
                    self.quick, self.tokenizer = quick, None  # one vocabulary in memory is enough

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.quick is not None:
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def _byte_letters() -> list[str]:
    """Byte-level BPE files write printable bytes as themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


def pieces(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens, longest first."""
    out, at = [], 0
    while at < n:
        size = min(max_tokens, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, max_tokens: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row a piece: its document, place, sequence and bucket (log2 of its length).

    ``max_tokens`` is a power of two. The paths name files that every executor
    has (a tokenizer is part of the installation). A null or empty text is
    ``end_id`` alone: one piece of length 1. Null ids stay null, repeated rows
    give pieces of their own, an empty table gives none; other columns are
    ignored. Without a shuffle: sequence ids are unique longs, and equal the
    bucket modulo 64, so a writer can deal buckets into files. ``with_ids``
    adds the token ids of each piece.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int"
    schema += ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or Encoder(tokenizer, ranks, pattern)
            for a, b in slices(batch.column("text"), STEP_BYTES):
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, found in enumerate(encode(texts)):
                    found.append(end_id)
                    flat = np.array(found, "<u4")
                    raw = flat.tobytes()
                    for at, size in pieces(len(found), max_tokens):
                        row.append(a + i)
                        start.append(at)
                        length.append(size)
                        total.append(len(found))
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        if with_ids:
                            ids.append(flat[at : at + size].astype(np.int32))
                cols = [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                    pa.array([n.bit_length() - 1 for n in length], pa.int32()),
                ]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del encode
        trim()

    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    return found.withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 64 + F.col("bucket"), "offset": F.lit(0).cast("long")}
    )
