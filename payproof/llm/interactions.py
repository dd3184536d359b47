"""Filter interaction audit: what each filter removes in every order, from sums of wide packed counters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import words

FILTERS = "ABCDE"
#: The counters of a step, in the order of their fields.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field: sums of up to 2**64 - 1 documents stay inside it, more than a long can count.
WIDTH = 64


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


@cache
def packed(filters: str, mask: int) -> tuple[int, int, int]:
    """Three big integers for a document with these failures (bit k: the k-th filter fails): what it adds to every field of
    every step of every order, what it adds if it is good, and what if it is toxic."""
    n, everywhere, good, toxic = len(COUNTERS), 0, 0, 0
    for i, order in enumerate(orders(filters)):
        gone = False
        for step, name in enumerate(order):
            at = WIDTH * n * (i * len(filters) + step)
            bit = 1 << filters.index(name)
            fails = bool(mask & bit)
            held = {"kept": not gone and not fails, "removed": fails and not gone, "redundant": fails and gone, "unique_fails": mask == bit}
            for k, c in enumerate(COUNTERS):
                if held.get(c):
                    everywhere |= 1 << (at + WIDTH * k)
            if held["removed"]:
                good |= 1 << (at + WIDTH * COUNTERS.index("good_lost"))
                toxic |= 1 << (at + WIDTH * COUNTERS.index("toxic_lost"))
            gone = gone or fails
    return everywhere, good, toxic


def unpacked(filters: str, total: int) -> Iterator[tuple[str, int, list[int]]]:
    """(order, step, counters) of a sum of packed integers: fields never reach into each other, as none exceeds WIDTH bits."""
    n, size = len(COUNTERS), WIDTH // 8
    data = total.to_bytes(size * n * len(filters) * len(orders(filters)), "little")
    fields = [int.from_bytes(data[i : i + size], "little") for i in range(0, len(data), size)]
    for i, order in enumerate(orders(filters)):
        for step in range(len(filters)):
            at = n * (i * len(filters) + step)
            yield order, step + 1, fields[at : at + n]


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row: the failures of A to D as bits, the text's SHA-256, the language."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words(text).alias("w"))
    n = F.size("w")
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    fails = [n < 100, 100 * F.size(F.array_distinct("w")) < 80 * n, 100 * capitals > 10 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    bits: Column = F.lit(0)
    for k, f in enumerate(fails):
        bits = bits + F.when(f, 1 << k).otherwise(0)
    return d.select("doc_id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), bits.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail which filters.

    Filter E fails where a smaller doc_id has the identical text.  A group of copies shrinks to a row per (part, mask,
    label) before its rows meet, so its size does not matter; nothing is joined on a text.
    """
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(flags, F.col("doc_id") == F.col("id"), "left")
    key = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    has_id = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("numbered"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    later = F.col("numbered") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")))
    split = groups.withColumn("least", least).withColumn("later", later).select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step, with counts of documents.

    Parts are the values of ``lang``; null counts as the empty text.  A null text is empty; a null doc_id is smaller than
    none, so it never fails E and makes no other fail it; repeated rows count each, and rows of one doc_id do not make each
    other fail E.  A document is good or toxic if any of its labels says so.  Very long texts are read whole; other
    columns are ignored; no documents give no rows.

    Documents meet as counts per part and mask, at most 32 rows a part; each count multiplies its mask's packed integer, and one
    sum per part holds all orders.
    """
    kinds = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def unpack(rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for mask, n, good, toxic in zip(*(rows[c].tolist() for c in ("mask", "n", "good", "toxic")), strict=True):
            every, if_good, if_toxic = packed(FILTERS, mask)
            total += n * every + good * if_good + toxic * if_toxic
        steps = list(unpacked(FILTERS, total))
        shapley = dict.fromkeys(FILTERS, 0)
        for order, step, counts in steps:
            shapley[order[step - 1]] += counts[COUNTERS.index("removed")]
        return pd.DataFrame([(rows["part"].iloc[0], order, step, *counts, shapley[order[step - 1]]) for order, step, counts in steps], columns=[c.split()[0] for c in kinds.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(unpack, kinds)
