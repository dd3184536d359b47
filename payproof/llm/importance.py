"""Importance resampling towards a target: hashed n-gram counts, log-ratio weights, a Gumbel top-k draw."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

#: Words of lower-cased UTF-8: digits, letters and whatever is beyond ASCII.  A text's separator is never part of a word.
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SENTINEL = b"\x00"


@dataclass(frozen=True)
class Features:
    """Runs of ``shortest`` to ``longest`` words, each in the bucket that its CRC-32 has modulo ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket and the text number of every n-gram of a batch, and the number of words of each text.

        The texts are joined with a sentinel that no word holds, so one pass of the pattern finds the words of all of
        them; a word belongs to the last text that starts at or before it, and runs whose ends belong to two texts are
        masked.  A run's CRC goes on from that of the run without its last word.
        """
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        found, at = [], []
        for m in WORD_BYTES.finditer(SENTINEL.join(texts).lower()):
            found.append(m.group())
            at.append(m.start())
        text = np.searchsorted(starts, np.array(at, np.int64), "right") - 1
        crc = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
        spaced = [b" " + w for w in found] if self.longest > 1 else []
        buckets, owners = [], []
        for n in range(1, self.longest + 1):
            if n > 1:
                crc = np.fromiter(map(zlib.crc32, spaced[n - 1 :], crc[:-1].tolist()), np.uint32, max(0, len(found) - n + 1))
            if n >= self.shortest:
                inside = text[: len(crc)] == text[n - 1 :]
                buckets.append(crc[inside].astype(np.int64) % self.buckets)
                owners.append(text[: len(crc)][inside])
        return np.concatenate(buckets), np.concatenate(owners), np.bincount(text, minlength=len(texts))


def joined(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``most`` bytes of text (a longer text stands alone), and their texts; null is empty."""
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) + 1)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right")))
            yield b.slice(at, end - at), [t or b"" for t in texts.slice(at, end - at).to_pylist()]
            at = end


def bucket_counts(docs: DataFrame, kind: Features) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket.  Each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kind.buckets, np.int64)
        for _, texts in joined(batches):
            total += np.bincount(kind.of(texts)[0], minlength=kind.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, kind: Features) -> np.ndarray:
    """Per bucket 1,000 times the log of its share in the target over its share in the documents, one added to each count.

    The driver gets ``kind.buckets`` rows at most."""
    s, t = np.zeros(kind.buckets), np.zeros(kind.buckets)
    both = bucket_counts(docs, kind).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, kind).withColumn("side", F.lit(1)))
    for r in both.collect():
        (t if r["side"] else s)[r["bucket"]] = r["n"]
    big_s, big_t = s.sum() + kind.buckets, t.sum() + kind.buckets
    return np.array([math.floor(1000 * math.log((b + 1) * big_s / ((a + 1) * big_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """1,000 times a Gumbel number that depends on the seed and the id alone, rounded down; a null id is an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, kind: Features, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: the mean gain of its n-grams, and that plus noise."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kinds = "doc_id long, n_words long, n_features long, weight long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in joined(batches):
            buckets, owner, n_words = kind.of(texts)
            n = np.bincount(owner, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, sent.value[buckets])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + np.array([noise(seed, i) for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))], names=[c.split()[0] for c in kinds.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def resample(docs: DataFrame, target: DataFrame, kind: Features = Features(), percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank.

    The draw takes ``percent`` of the documents of ``least_words`` words or more, the highest scores first; equal scores
    go by the smaller doc_id (null last), equal ids by weight and size, so that only wholly equal rows are interchangeable.  Rank is
    null for the others.  Null and empty texts have no features and weigh 0; very long texts are read whole; repeated rows
    count and rank each; other columns are ignored; an empty target counts as no words; no rows give no rows.

    Scores are whole numbers within about 110,000 of each other whatever the input, so a table of that many counts says
    where each score's ranks begin, and rows are sorted only among those of one score.  Noise spreads copies over scores.
    """
    rows = materialize(scored(docs, gains(docs, target, kind), kind, seed))
    may = F.col("n_words") >= least_words
    per_score = rows.where(may).groupBy("score").agg(F.count("*").alias("n"))
    above = W.orderBy(F.desc("score"))
    starts = per_score.select("score", (F.sum("n").over(above.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("all"))
    starts = starts.where(F.expr(f"before < {percent} * all div 100"))
    own = W.partitionBy("score", "may").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words")
    placed = rows.withColumn("may", may).join(F.broadcast(starts), "score", "left").withColumn("place", F.col("before") + F.row_number().over(own))
    drawn = F.when(F.col("may") & F.expr(f"place <= {percent} * all div 100"), F.col("place"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", drawn.cast("long").alias("rank"))
