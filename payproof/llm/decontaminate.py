"""Benchmark decontamination: CGK walks turn edit distance into Hamming distance, sampled places find candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import apart, materialize, sliced

#: A walk takes this many steps per word of an item.
STRETCH = 1.5
NOT_WORD = r"[^\p{L}\p{N}]+"


class Index:
    """A block of benchmark items as word ids, with the keys of their walks.

    An item of n words is matched by text within e = floor(n * (1 - similarity)) word edits, one of fewer than ``least``
    words only by the same words.  e edits leave a run of
    (n - e) // (e + 1) words untouched, so a window can only match if it shares such a run with the item: those windows,
    found by looking up every run of the text, are the candidates for the walks.  Each of ``walks`` random walks is
    sampled at ``sample`` places.  Items are classed by the doubling of their length: as many walks are taken as copies of each
    class's items with e random edits need for a share ``recall`` of them to have a candidate that agrees with their item in
    all places of one walk.  Items of a class that ``most_walks`` are too few for, or of over ``most_walked`` words, are
    ``direct``: all their candidates are verified exactly.  Given ``walks`` and ``direct``, those are used.
    """

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float = 0.8, recall: float = 0.99, sample: int = 2, most_walks: int = 48, seed: int = 11, walks: int | None = None, least: int = 8, direct: np.ndarray | None = None, most_walked: int = 512):
        rng = np.random.default_rng(seed)
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.seqs = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in toks]) for _, toks in items]
        self.n = np.array([len(s) for s in self.seqs], np.int64)
        self.edits = np.where(self.n < least, 0, np.floor(self.n * (1 - similarity) + 1e-9)).astype(np.int64)
        self.begin, self.flat = np.cumsum(self.n) - self.n, np.concatenate([*self.seqs, np.empty(0, np.int64)])
        self.kind = np.frexp(self.n)[1]
        self.direct = self.n > most_walked if direct is None else direct
        self.steps = int(STRETCH * self.n[~self.direct].max(initial=1))
        self.runs = [self.run_table(g) for g in sorted({self.gram(n, e) for n, e in zip(self.n, self.edits)})]
        self.bits = rng.integers(0, 2, (self.steps, most_walks, 1024), dtype=np.int8).astype(bool)
        self.places = rng.random((most_walks, sample))
        self.walks = walks or most_walks
        self.bits, self.places = self.bits[:, : self.walks], self.places[: self.walks]
        self.own = np.zeros((len(self.n), self.walks), np.int64)
        walked = np.flatnonzero(~self.direct)
        for at in self.classes(walked):
            x = walked[at]
            rows, inside = self.cut(self.flat, self.begin[x], self.begin[x] + self.n[x], int(self.n[x].max()))
            self.own[x] = self.keys(rows, inside, self.n[x])
        self.recall = 1.0
        if items and walks is None:
            need, reached = [1], [1.0]
            for c in np.unique(self.kind[~self.direct]):
                members = np.flatnonzero((self.kind == c) & ~self.direct)
                met = np.logical_or.accumulate(self.agreeing(members[rng.integers(0, len(members), 400)], rng), axis=1).mean(0)
                enough = int(np.searchsorted(met, recall))
                if enough < most_walks:
                    need.append(enough + 1)
                    reached.append(float(met[enough]))
                else:
                    self.direct = self.direct | (self.kind == c)
            self.walks, self.recall = max(need), min(reached)
            self.bits, self.places, self.own = self.bits[:, : self.walks], self.places[: self.walks], self.own[:, : self.walks]

    def classes(self, items: np.ndarray, together: int | None = None) -> Iterator[np.ndarray]:
        """Places of a list of items, those of one doubling of length at a time, 4,096 at most and ``together`` words of
        windows if given (but 16 items): what an item costs is bounded by its own length, not by the longest of its block."""
        for c in np.unique(self.kind[items]):
            at = np.flatnonzero(self.kind[items] == c)
            step = len(at) if together is None else max(16, min(4096, together >> int(c)))
            for k in range(0, len(at), step):
                yield at[k : k + step]

    def agreeing(self, pick: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """For an edited copy of each picked item and each walk, whether a candidate window agrees with the item."""
        out = np.zeros((len(pick), self.walks), bool)
        for r, x in enumerate(pick):
            copy = np.array(self.edited(self.seqs[x], int(self.edits[x]), rng), np.int64)
            item, start = self.candidates(copy)
            start = start[item == x]
            if len(start):
                n = np.full(len(start), self.n[x])
                rows, inside = self.cut(copy, np.maximum(0, start), np.minimum(len(copy), start + n), int(self.n[x]))
                out[r] = (self.keys(rows, inside, n) == self.own[x]).any(0)
        return out

    @staticmethod
    def gram(n: int, e: int) -> int:
        return int(min(4, max(1, (n - e) // (e + 1))))

    @staticmethod
    def edited(s: np.ndarray, e: int, rng: np.random.Generator) -> list[int]:
        t = list(s)
        for kind, where in zip(rng.integers(0, 3, e), rng.random(e)):
            at = int(where * len(t))
            t[at : at + (kind != 2)] = [] if kind == 1 else [0]
        return t

    def run_table(self, g: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of g words of the items that are looked up by g words: sorted codes, where each begins, items, offsets."""
        code, item, offset = [], [], []
        for x, s in enumerate(self.seqs):
            if self.gram(self.n[x], self.edits[x]) == g:
                c, _ = self.codes(s, g)
                code.append(c)
                item.append(np.full(len(c), x))
                offset.append(np.arange(len(c)))
        code, item, offset = (np.concatenate(v) for v in (code, item, offset))
        order = np.argsort(code, kind="stable")
        values, start = np.unique(code[order], return_index=True)
        return g, values, np.append(start, len(code)), item[order], offset[order]

    def codes(self, ids: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each run of g words, and whether all its words are known to the items."""
        out = np.zeros(max(0, len(ids) - g + 1), np.uint64)
        known = np.ones(len(out), bool)
        for k in range(g):
            part = ids[k : k + len(out)]
            out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            known &= part > 0
        return out, known

    def keys(self, rows: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each row and walk, a number for the words that the walk puts out at its sampled places.

        At step j a walk puts out the word under its pointer, which moves on if that word's bit for j is set; past the
        end it puts out 0.  Places are shares of the steps for an item of n words.
        """
        walks = np.arange(self.walks)
        at = np.zeros((len(rows), self.walks), np.int64)
        when = (self.places[None] * np.floor(STRETCH * n)[:, None, None]).astype(np.int64)
        out = np.zeros(at.shape, np.int64)
        every, last = np.arange(len(rows))[:, None], lengths[:, None]
        for j in range(min(self.steps, int(STRETCH * n.max(initial=1)))):
            inside = at < last
            w = np.where(inside, rows[every, np.minimum(at, rows.shape[1] - 1)], 0)
            for k in range(when.shape[2]):
                out += np.where(when[:, :, k] == j, (w + 1) * (len(self.vocabulary) + 2) ** k, 0)
            at += inside & self.bits[j][walks, w % self.bits.shape[2]]
        return out

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and window starts for the runs that a text shares with the items."""
        items, starts = [], []
        for g, values, first, item, offset in self.runs:
            code, known = self.codes(ids, g)
            at = np.flatnonzero(known)
            if not len(at) or not len(values):
                continue
            place = np.minimum(np.searchsorted(values, code[at]), len(values) - 1)
            hit = values[place] == code[at]
            at, place = at[hit], place[hit]
            count = first[place + 1] - first[place]
            entry = np.repeat(first[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            items.append(item[entry])
            starts.append(np.repeat(at, count) - offset[entry])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack((np.concatenate(items), np.concatenate(starts)), axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def matches(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which candidates match, with the place after their last word and their edits.

        A candidate is an item and a window start inside the text flat[begin:end]; windows are as wide as the longest item given,
        so items come in ``classes`` of like length.  Those that agree with their item in a walk,
        and all of direct items, are verified by the exact edit distance between the item and the best stretch of the window and e words around it.
        """
        n, e = self.n[item], self.edits[item]
        longest = int(n.max(initial=1))
        held = self.direct[item]
        walked = np.flatnonzero(~held)
        if len(walked):
            left, right = np.maximum(begin, start)[walked], np.minimum(end, start + n)[walked]
            rows, inside = self.cut(flat, left, right, int(n[walked].max()))
            held[walked] = (self.keys(rows, inside, n[walked]) == self.own[item[walked]]).any(1)
        met = np.flatnonzero(held)
        item, n, e = item[met], n[met], e[met]
        left = np.maximum(begin[met], start[met] - e)
        wide = longest + 2 * int(e.max(initial=0))
        rows, inside = self.cut(flat, left, np.minimum(end[met], start[met] + n + e), wide)
        wanted, _ = self.cut(self.flat, self.begin[item], self.begin[item] + n, longest)
        cost = np.zeros((len(met), wide + 1), np.int64)
        ids = np.arange(wide + 1)
        best, where = np.full(len(met), 1 << 30), np.zeros(len(met), np.int64)
        past = ids[None] > inside[:, None]
        for i in range(1, longest + 1):
            new = np.empty_like(cost)
            new[:, 0] = i
            new[:, 1:] = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + (rows != wanted[:, i - 1][:, None]))
            cost = np.minimum.accumulate(new - ids, axis=1) + ids
            done = np.flatnonzero(n == i)
            if len(done):
                final = np.where(past[done], 1 << 30, cost[done])
                where[done] = final.argmin(1)
                best[done] = final.min(1)
        good = best <= e
        return met[good], (left + where)[good], best[good]

    @staticmethod
    def cut(flat: np.ndarray, left: np.ndarray, right: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        at = left[:, None] + np.arange(wide)
        inside = at < right[:, None]
        return np.where(inside, flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else 0, 0), np.maximum(0, right - left)


def find_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 8, recall: float = 0.99, block: int = 2000, at_once: int = 4096) -> DataFrame:
    """(doc_id, h, item_id, last_word, edits): matches of benchmark items in documents; h hashes the text.

    Words are lower-cased runs of letters and digits.  Items of fewer than ``least`` words are matched only by
    exactly their words; items without a word and null texts are left out.  Items are taken ``block`` at a time, all of which is sent to the
    tasks; a benchmark of any size is so many passes over the documents.
    """
    spark = docs.sparkSession
    words = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD), "")
    items = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("words")).where(F.size("words") > 0))
    blocks = max(1, -(-items.count() // block))
    schema = "doc_id long, h long, item_id long, last_word long, edits long"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()
        if part:
            known = [(r["item_id"], list(r["words"])) for r in sorted(part, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["words"]))]
            own = Index(known, similarity, recall, least=least)
            sent = spark.sparkContext.broadcast((known, own.walks, own.direct))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                index = Index(sent.value[0], similarity, recall, walks=sent.value[1], least=least, direct=sent.value[2])
                get = index.vocabulary.get
                for b in sliced(batches, 1000):
                    seqs = [np.fromiter((get(w, 0) for w in ws.split()), np.int64) for ws in b.column(2).to_pylist()]
                    ends = np.cumsum([len(s) for s in seqs])
                    flat = np.concatenate([*seqs, np.empty(0, np.int64)])
                    queue: list[list[np.ndarray]] = []
                    out: list[list[np.ndarray]] = []

                    def close() -> None:
                        row, item, start = (np.concatenate(v) for v in zip(*queue))
                        queue.clear()
                        for a in index.classes(item, 2_000_000):
                            r, x, s = row[a], item[a], start[a]
                            begin = ends[r] - np.array([len(seqs[i]) for i in r])
                            good, last, edits = index.matches(flat, begin, ends[r], x, begin + s)
                            out.append([r[good], np.array(index.ids, object)[x[good]], last - begin[good], edits])

                    waiting = 0
                    for i, s in enumerate(seqs):
                        item, start = index.candidates(s)
                        if len(item):
                            queue.append([np.full(len(item), i), item, start])
                            waiting += len(item)
                            if waiting >= at_once:
                                close()
                                waiting = 0
                    if queue:
                        close()
                    if out:
                        row, item, last, edits = (np.concatenate(v) for v in zip(*out))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(item.tolist(), pa.int64()), pa.array(last.astype(np.int64)), pa.array(edits.astype(np.int64))], names=["doc_id", "h", "item_id", "last_word", "edits"])

            text = F.regexp_replace(F.lower("text"), NOT_WORD, " ")
            found = found.unionByName(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), text.alias("text")).mapInArrow(run, schema))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, h, contaminated, n_items, items) for every document: the items found, least edits first per item.

    Rows that agree on doc_id and text are one document.  Null and empty texts are clean; without items all is clean; extra
    columns are ignored.
    """
    found = find_matches(docs, benchmark, **options).groupBy("doc_id", "h", "item_id").agg(F.min(F.struct("edits", "last_word")).alias("best"))
    by_doc = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("item_id", "best.edits", "best.last_word"))).alias("items"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    met = by_doc.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "items")
    joined = every.join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "h", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<struct<item_id: long, edits: long, last_word: long>>")).alias("items"))


@apart("doc_id", "text")
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found; all columns stay."""
    met = find_matches(docs, benchmark, **options).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return docs.join(met, same, "left_anti")
