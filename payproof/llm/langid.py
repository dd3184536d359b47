"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import sliced

LETTER = re.compile(r"[^\W\d_]")
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Table:
    """Log frequencies of entries (words, or n-grams) by language, only where an entry was seen in a language.

    Entry ``index[x]`` has the cells ``starts[i]`` to ``starts[i + 1]``; a cell is a language's number and how far its log
    frequency lies above that of an unseen entry of the same kind.
    """

    index: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    above: np.ndarray

    def __iter__(self) -> Iterator[str]:
        return iter(self.index)

    def sums(self, at: np.ndarray, langs: int) -> np.ndarray:
        """Per language, the sum of ``above`` over the entries ``at``, which may repeat."""
        n = self.starts[at + 1] - self.starts[at]
        cells = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.lang[cells], self.above[cells], langs)


@dataclass
class Model:
    """Words and n-grams, and per kind (0 words, k n-grams of k) the log frequency of an unseen entry in each language."""

    langs: list[str]
    words: Table
    grams: Table
    unseen: np.ndarray
    longest: int


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(TRIM) for x in text.lower().split()) if w]


def sample(docs: DataFrame, per_lang: int, most_langs: int) -> DataFrame:
    """At most about ``per_lang`` documents of each language, chosen by a hash of id and text; texts stay where they are."""
    counts = docs.where("lang is not null").groupBy("lang").count().limit(most_langs + 1).collect()
    if len(counts) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "text"), F.lit(1 << 20))
    below = F.lit(0)
    for r in counts:
        below = F.when(F.col("lang") == r["lang"], math.ceil(per_lang * (1 << 20) / r["count"])).otherwise(below)
    return docs.where(F.col("text").isNotNull() & (place < below)).select("lang", "text")


def fit(docs: DataFrame, per_lang: int = 1500, keep: int | None = None, longest: int = 4, most_langs: int = 300, most_bytes: int = 1 << 30) -> Model:
    """Learn from a bounded sample of labelled rows: about ``per_lang`` documents of a language, chosen by hash, each
    read whole.

    Spark counts words and n-grams per language, and all of them make the model; given ``keep``, so many of each kind and
    language, the most frequent.  The bound is on rows: ``per_lang`` times the number of languages, itself at most
    ``most_langs`` (more is an error).  The model has a cell for each entry and language that were seen together,
    and these take at most about ``most_bytes``, whatever the texts hold: where there are more, those counted least go, as many
    counts as it takes.
    Rows with a null text or lang are left out; without a labelled row the model has no language.
    """
    picked = sample(docs, per_lang, most_langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(tokens(text))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, w, n in zip(*[c.to_pylist() for c in b.columns]):
                c, p = seen.setdefault(lang, Counter()), f"^{w}$"
                for k in range(1, longest + 1):
                    for i in range(len(p) - k + 1):
                        c[p[i : i + k]] += n
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    kind = "lang string, gram string, n long"
    words = picked.mapInArrow(count, kind).groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    grams = words.mapInArrow(cut, kind).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("k", F.length("gram"))
    counted = every = words.withColumn("k", F.lit(0)).unionByName(grams).persist()
    totals = {(r["lang"], r["k"]): (r["n"], r["v"]) for r in counted.groupBy("lang", "k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if keep is not None:
        rank = F.row_number().over(W.partitionBy("lang", "k").orderBy(F.desc("n"), "gram"))
        counted = counted.withColumn("rank", rank).where(F.col("rank") <= keep)
    counted = counted.where(F.col("n") >= least_count(counted, most_bytes))
    number = F.array_position(F.array(*[F.lit(x) for x in langs]).cast("array<string>"), F.col("lang")) - 1
    top = counted.select(number.cast("int").alias("lang"), "k", "gram", "n").toArrow()
    every.unpersist()
    words.unpersist()
    size = np.array([[totals.get((x, k), (1, 1))[0] for x in langs] for k in range(longest + 1)], float).reshape(longest + 1, len(langs))
    most = [max([v for (_, kk), (_, v) in totals.items() if kk == k], default=1) for k in range(longest + 1)]
    total = size + 0.5 * (np.array(most)[:, None] + 1)
    is_word = pc.equal(top.column("k"), 0)
    return Model(langs, cells(top.filter(is_word)), cells(top.filter(pc.invert(is_word))), np.log(0.5 / total), longest)


def least_count(counted: DataFrame, most_bytes: int) -> int:
    """The least count of which all rows that have as much or more fit into ``most_bytes``: 150 bytes and the entry's own for
    each.  One row per different count leaves Spark."""
    size = F.sum(150 + F.octet_length("gram"))
    if (counted.agg(size).first()[0] or 0) <= most_bytes:
        return 1
    upto = 0
    for r in counted.groupBy("n").agg(size.alias("bytes")).orderBy(F.desc("n")).toLocalIterator():
        upto += r["bytes"]
        if upto > most_bytes:
            return r["n"] + 1
    return 1


def cells(rows: pa.Table) -> Table:
    """The table of entries (lang, k, gram, n); 0.5 is added to each count."""
    entries = rows.column("gram").combine_chunks().dictionary_encode() if rows.num_rows else None
    at = entries.indices.to_numpy() if rows.num_rows else np.zeros(0, int)
    index = {g: i for i, g in enumerate(entries.dictionary.to_pylist())} if rows.num_rows else {}
    order = np.argsort(at, kind="stable")
    above = np.log(rows.column("n").to_numpy() * 2.0 + 1)
    return Table(index, np.searchsorted(at[order], np.arange(len(index) + 1)), rows.column("lang").to_numpy()[order].astype(np.int32), above[order].astype(np.float32))


class Scorer:
    """The model inside a task, with the scores of unseen words kept, up to ``cache`` numbers of them."""

    def __init__(self, model: Model, cache: int = 4_000_000):
        self.model, self.langs = model, len(model.langs)
        self.most, self.kept = max(1, cache // max(1, self.langs)), {}

    def backed_off(self, word: str) -> np.ndarray:
        """The mean over the word's n-grams of the greatest length of which any is known; no evidence if none is."""
        p, grams = f"^{word}$", self.model.grams
        for k in range(min(self.model.longest, len(p)), 0, -1):
            known = [g for g in (grams.index.get(p[i : i + k]) for i in range(len(p) - k + 1)) if g is not None]
            if known:
                return self.model.unseen[k] + grams.sums(np.array(known), self.langs) / len(known)
        return np.zeros(self.langs)

    def mean(self, toks: list[str]) -> np.ndarray:
        total, words = np.zeros(self.langs), self.model.words
        for start in range(0, len(toks), 4096):
            part = toks[start : start + 4096]
            at = list(map(words.index.get, part))
            if None in at:
                for x, n in Counter(x for x, i in zip(part, at) if i is None).items():
                    if x not in self.kept:
                        if len(self.kept) >= self.most:
                            self.kept.clear()
                        self.kept[x] = self.backed_off(x)
                    total += n * self.kept[x]
                at = [i for i in at if i is not None]
            if at:
                total += len(at) * self.model.unseen[0] + words.sums(np.array(at), self.langs)
        return total / len(toks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the languages' likelihoods, each the geometric mean over words raised to
        the root of their number.  ``und`` and 0 without a letter or a learned language."""
        if not text or not self.model.langs or not LETTER.search(text):
            return "und", 0.0
        toks = tokens(text)
        logs = self.mean(toks) * math.sqrt(len(toks))
        p = np.exp(logs - logs.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: Model, cache: int = 4_000_000) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name; very
    long texts are read whole; repeated rows get equal results; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scoring(docs, model, 1, cache), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, cache: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose language is ``und``; all columns stay, names that clash with ours too."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    scored = plain.mapInArrow(scoring(docs, model, docs.columns.index("text"), cache, every=True), f"{kinds}, lang_pred string, score double")
    return scored.where("lang_pred <> 'und'").select(names).toDF(*docs.columns)


def scoring(docs: DataFrame, model: Model, text: int, cache: int, every: bool = False):
    """A mapInArrow function: the first column, or all, then lang_pred and score from column number ``text``."""
    plain = lambda t: tuple(vars(t).values())  # noqa: E731 (executors unpickle no class of ours from a broadcast)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, plain(model.words), plain(model.grams), model.unseen, model.longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, grams, unseen, longest = sent.value
        scorer = Scorer(Model(langs, Table(*words), Table(*grams), unseen, longest), cache)
        for b in sliced(batches):
            out = [scorer.predict(t) for t in b.column(text).to_pylist()]
            n = b.num_columns if every else 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*b.schema.names[:n], "lang_pred", "score"])

    return run
