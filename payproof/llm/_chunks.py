"""Chunks and buckets: how tasks that hold texts look up sums that other tasks hold.

Documents are dealt into chunks of bounded size by a hash.  A chunk writes its words as numbers, reduces what it wants to know to
distinct 64-bit keys, and sends each bucket one packed message with the keys that fall there.  A bucket adds the
messages of all chunks up and answers each in the order of its keys.  Spark groups and shuffles messages and answers by
bucket and chunk; the shuffle of the texts by chunk is the same in every step, so it is made once and reused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced

MESSAGE = "chunk long, bucket long, kind int, payload binary"
ARROW_MESSAGE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])


def deal(docs: DataFrame, chunk_mb: float, bucket_mb: float, *more: str, spread: bool = False) -> tuple[DataFrame, int, int, int]:
    """(chunk, doc_id, text, more boolean columns), the numbers of chunks and buckets, and the bytes of all texts.

    Texts are compressed before they are shuffled.  ``spread``: repeated rows are dealt by the partition they come from, too.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, b = max(1, round(total / chunk_mb / 1e6)), max(1, round(total / bucket_mb / 1e6))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    chunk = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text, *[F.spark_partition_id()] * spread), F.lit(n))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for x in sliced(batches):
            packed = pa.array([small.compress(t.encode("utf-8", "surrogatepass")) for t in x.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns[:2], packed, *x.columns[3:]], names=x.schema.names)

    rows = docs.select(chunk.alias("chunk"), doc_id.alias("doc_id"), text.alias("text"), *more)
    return rows.mapInArrow(compress, ", ".join(["chunk long, doc_id long, text binary", *[f"{c} boolean" for c in more]])), n, b, total


@dataclass
class Words:
    """The words of a chunk's texts: numbers in one row, where each text begins and ends, and each number's word and hash.

    The hash is that of Spark's ``xxhash64`` on the word.
    """

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    words: list[bytes]
    hashes: np.ndarray


def read_words(texts: list[bytes], lower: bool, closing: bytes | None = None) -> Words:
    """``closing``: a word put after each text."""
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    number = index.__getitem__
    parts, ends = [], []
    open_ = zstandard.ZstdDecompressor().decompress
    for t in texts:
        raw = open_(t)
        toks = (raw.lower() if lower else raw).split()
        if closing is not None:
            toks.append(closing)
        parts.append(np.fromiter(map(number, toks), np.int32, len(toks)))
        ends.append(len(toks))
    end = np.cumsum(ends, dtype=np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in index], np.uint64)
    return Words(np.concatenate([*parts, np.empty(0, np.int32)]), end - np.array(ends, np.int64), end, list(index), hashes)


def in_order(t: pa.Table) -> pa.Table:
    """The rows of a chunk in an order of their own: shuffled rows arrive in any order, and each step must number the
    same words alike."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: numbers without sign in the smallest type that holds them, bytes of one weight together,
    compressed."""
    out = [len(arrays).to_bytes(1, "big")]
    for a in arrays:
        if a.dtype.kind == "u" or a.dtype == bool:
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "big") + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "big")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def rows(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(ARROW_MESSAGE)], schema=ARROW_MESSAGE)


def by_bucket(bucket: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """Slices of equal values of a sorted array of bucket numbers."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    return [(b, slice(edges[b], edges[b + 1])) for b in range(n) if edges[b + 1] > edges[b]]
