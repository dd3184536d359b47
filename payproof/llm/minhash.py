"""Near-duplicates by shared shingles: MinHash bands find candidates, the exact Jaccard similarity of their sets decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import apart, materialize, sliced
from ._graph import components


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the distinct word shingles of the lower-cased text; a shorter text is one shingle."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(toks)] if toks and len(toks) <= shingle else [b" ".join(g) for g in zip(*(toks[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def least_hashes(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each factor and shift, the least number that they make of the hashes."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(out, (factors[:, None] * hashes[None, at : at + 512] + shifts[:, None]).min(1), out=out)
    return out


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """(doc_id, h, keys, sketch) for every row of docs (doc_id, h, text): a key per band of ``rows`` least hashes, and a byte
    of each hash.  Texts without a word have neither."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys, sketch = [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, shingle)
                least = least_hashes(s, factors, shifts) if len(s) else None
                raw = None if least is None else least.tobytes()
                keys.append(None if raw is None else np.array([xxhash.xxh64_intdigest(raw[8 * rows * i : 8 * rows * (i + 1)], i) for i in range(bands)], np.uint64).astype(np.int64))
                sketch.append(None if least is None else (least >> np.uint64(8)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "h", "keys", "sketch"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, keys array<long>, sketch binary")


def best_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those links (u, v) of a forest over nodes 0..n-1 that, at each weight, connects what links of so much or more do."""
    label, us, vs = np.arange(n), [], []
    for w in np.unique(weight)[::-1]:
        a, b = u[weight == w], v[weight == w]
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            high, pick = np.unique(high, return_index=True)
            us.append(a[pick])
            vs.append(b[pick])
            root = np.arange(n)
            root[high] = low[pick]
            while (root != root[root]).any():
                root = root[root]
            label = root[label]
    return (np.concatenate(us), np.concatenate(vs)) if us else (u[:0], v[:0])


def candidates(values: DataFrame, similarity: float, cell: int = 512, few: int = 32) -> DataFrame:
    """Distinct pairs (a, b) of texts of values (h, keys, sketch) that share a band and may be similar enough.

    Sketches that agree in fewer places than ``similarity`` less 4.5 standard deviations are not.  Texts under one key are
    compared in cells as in ``simhash.links``.  A cell of up to ``few`` texts gives all its pairs; a larger one gives a forest
    of its most similar pairs, which connects the same texts.
    """
    keyed = values.select(F.posexplode("keys").alias("band", "k"), "h")
    sizes = keyed.groupBy("band", "k").agg(F.count("*").alias("n")).where("n > 1")
    slots = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("h"), slots)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), slots - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    dealt = materialize(keyed.join(sizes, ["band", "k"]).select("k", "h", F.explode(cells).alias("c")).select("k", "c.x", "c.y", "h"))
    dealt = dealt.join(values.select("h", "sketch"), "h").select("k", "x", "y", "h", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hs, sketches = None, [], []
        for b in batches:
            for k, x, y, h, s in zip(*[c.to_pylist() for c in b.columns]):
                if (k, x, y) != key:
                    yield from close(hs, sketches)
                    key, hs, sketches = (k, x, y), [], []
                hs.append(h)
                sketches.append(s)
        yield from close(hs, sketches)

    def close(hs: list[int], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = len(hs)
        if n < 2:
            return
        h, s = np.array(hs, np.int64), np.frombuffer(b"".join(sketches), np.uint8).reshape(n, -1)
        width = s.shape[1]
        least = similarity * width - 4.5 * np.sqrt(width * similarity * (1 - similarity))
        us, vs, ws = [], [], []
        for step in range(1, n):
            same = np.count_nonzero(s[step:] == s[:-step], axis=1)
            i = np.flatnonzero(same >= least)
            us.append(i)
            vs.append(i + step)
            ws.append(same[i])
        u, v, w = np.concatenate(us), np.concatenate(vs), np.concatenate(ws)
        if n > few:
            u, v = best_forest(u, v, w, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(h[u], h[v])), pa.array(np.maximum(h[u], h[v]))], names=["a", "b"])

    return dealt.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of texts (h) of docs (h, text) whose sets of shingles have a Jaccard similarity of ``similarity``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    return alike(materialize(docs.select("h", "text").join(nodes, "h", "left_semi").dropDuplicates(["h"])), pairs, shingle, similarity)


def alike(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """As ``similar``, of texts (h, text) with one row for each h in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(4096)(lambda t: shingles(t, shingle))  # sets of short texts, which recur in many pairs
        for b in sliced(batches, 200):
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = (kept(t) if len(t or "") < 10_000 else shingles(t, shingle) for t in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (texts.select(F.col("h").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


@apart("doc_id", "text")
def near_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 6) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest (doc_id, text hash), null ids last.

    Texts are linked when the Jaccard similarity of their sets of ``shingle``-word shingles, exactly, is ``similarity`` or more.
    Of pairs at s, a share 1 - (1 - s ** rows) ** bands meets in a band and is compared: 0.997 at 0.8, more above.  Texts
    without a word are similar to nothing and stay; of rows that agree on doc_id and text one stays; all columns stay.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    signed = materialize(signatures(keyed, shingle, bands, rows))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    values = materialize(signed.where("keys is not null").groupBy("h").agg(F.min(place).alias("first"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    pairs = materialize(candidates(values, similarity))
    found = components(similar(keyed, pairs, shingle, similarity))
    rooted = values.select("h", "first").join(found.withColumnRenamed("node", "h"), "h", "left")
    keep = rooted.groupBy(F.coalesce("root", "h")).agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    keep = keep.unionByName(signed.where("keys is null").select("doc_id", "h").distinct()).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return docs.join(keep, same).drop("_id").dropDuplicates(["doc_id", "_h"]).drop("_h")
