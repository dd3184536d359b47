"""Katz backoff: Good-Turing discounted counts, exactly normalised backoff weights, count tables spread over buckets.

p(w | v) = d(c(v, w)) / c(v)                 if v w was seen in training
         = alpha(v) * p(w)                   if v was seen, v w was not
         = p(w)                              if v was never seen
p(w)     = d(c(w)) / N, or the mass that discounts set free if w was never seen (all such words are one event)

Counts up to ``K`` are discounted, greater ones trusted; alpha(v) is what the discounts after v set free over the mass of the
words not seen after v, so each distribution sums to 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._chunks import MESSAGE, Words, by_bucket, deal, in_order, pack, read_words, rows, unpack
from ._common import materialize, release, words

K = 5
END = b""
START = np.uint64(1 << 62)
ASK, STATE, UNI, BI, HOT, WORDS, PAIRS = range(7)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A context with over one in HOT_SHARE of the bytes as occurrences is spread over this many buckets.
HOT_SHARE, SPREAD = 8000, 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def discounts(n: np.ndarray) -> np.ndarray:
    """d_1..d_K from the numbers of events seen once, twice, ... K + 1 times.

    Good-Turing in Katz's form, from the numbers as they are if that gives ratios in (0, 1), else from their
    least-squares line in logarithms; half a count is taken from each where neither does.
    """
    r = np.arange(1, K + 1)
    n = np.asarray(n[: K + 1], float)
    if (n > 0).all():
        x = np.log(np.arange(1, K + 2))
        slope, level = np.polyfit(x, np.log(n), 1)
        for m in (n, np.exp(level + slope * x)):
            a = (K + 1) * m[K] / m[0]
            d = ((r + 1) * m[1:] / m[:K] / r - a) / (1 - a) if a < 1 else np.zeros(K)
            if ((d > 0) & (d < 1)).all():
                return d
    return 1 - 0.5 / r


@dataclass
class Totals:
    """What all tasks share: a few numbers, and the sums of at most HOT_SHARE contexts."""

    n: int
    v: int
    uni: np.ndarray
    bi: np.ndarray
    hot: dict[int, np.ndarray]

    def __post_init__(self):
        self.d_uni, self.d_bi = discounts(self.uni), discounts(self.bi)
        free = float((np.arange(1, K + 1) * self.uni[:K] * (1 - self.d_uni)).sum())
        self.scale = 1 / (self.n + (0 if free > 0 else 1))
        self.unknown = (free if free > 0 else 1) * self.scale

    def word(self, c: np.ndarray) -> np.ndarray:
        """p(w) of words with counts c."""
        return np.where(c > 0, discounted(c, self.d_uni) * self.scale, self.unknown)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.concatenate(([0.0], d, [1.0]))[np.minimum(c, K + 1).astype(np.int64)]


def seen_once(c: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, ... K + 1."""
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].astype(np.int64)


def words_of(t: pa.Table) -> tuple[Words, np.ndarray]:
    """The words of a chunk, and which tokens are of training documents."""
    t = in_order(t)
    w = read_words(t.column("text").to_pylist(), True, END)
    return w, np.repeat(np.array(t.column("train").to_pylist(), bool), w.end - w.begin)


def pairs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (context, word) of a chunk, and each token's pair.  The context of a first token is number
    len(words)."""
    before = np.empty(len(w.ids), np.int64)
    before[1:] = w.ids[:-1]
    before[w.begin] = len(w.words)
    key, place = np.unique(before * (len(w.words) + 1) + w.ids, return_inverse=True)
    return key // (len(w.words) + 1), key % (len(w.words) + 1), place


def ask_words(key: tuple, t: pa.Table, buckets: int) -> pa.Table:
    w, train = words_of(t)
    c = np.bincount(w.ids[train], minlength=len(w.words)).astype(np.uint64)
    return rows([(key[0].as_py(), b, ASK, pack(w.hashes[i], c[i])) for b, i in word_places(w, buckets)])


def word_places(w: Words, buckets: int) -> list[tuple[int, np.ndarray]]:
    return in_buckets((w.hashes >> np.uint64(32)) % np.uint64(buckets), buckets)


def count_words(key: tuple, told: pa.Table, buckets: int) -> pa.Table:
    """Adds up the words of one bucket; answers each message with the words' counts and numbers."""
    bucket = key[0].as_py()
    asked = sorted(zip(told.column("chunk").to_pylist(), told.column("payload").to_pylist()))
    parts = [unpack(p) for _, p in asked]
    words, place = np.unique(np.concatenate([p[0] for p in parts]).astype(np.uint64), return_inverse=True)
    c = np.zeros(len(words), np.uint64)
    np.add.at(c, place, np.concatenate([p[1].astype(np.uint64) for p in parts]))
    number = np.empty(len(words), np.uint64)
    number[np.lexsort((words, -c.astype(np.int64)))] = np.arange(len(words), dtype=np.uint64)
    number = number * np.uint64(buckets) + np.uint64(bucket)
    known = c > 0
    out, at = [(-1, bucket, UNI, pack(np.array([c.sum(), known.sum(), *seen_once(c)], np.uint64))), (-1, bucket, WORDS, pack(words[known], c[known], number[known]))], 0
    for (chunk, _), p in zip(asked, parts):
        i = place[at : at + len(p[0])]
        out.append((chunk, bucket, ASK, pack(c[i], number[i])))
        at += len(p[0])
    return rows(out)


def ask_pairs(key: tuple, t: pa.Table, told: pa.Table, buckets: int, hot: float) -> pa.Table:
    chunk = key[0].as_py()
    if chunk < 0:
        return told
    w, train = words_of(t)
    c, number = np.zeros(len(w.words), np.uint64), np.zeros(len(w.words) + 1, np.uint64)
    said = dict(zip(told.column("bucket").to_pylist(), told.column("payload").to_pylist()))
    for b, i in word_places(w, buckets):
        c[i], number[i] = unpack(said[b])
    number[-1] = START
    out = []
    for b, v, x, n, is_hot, _ in dealt_pairs(w, train, c, number, buckets, hot):
        own, place = np.unique(x, return_inverse=True)
        out.append((chunk, b, ASK, pack(*runs(number[v]), number[own], c[own], place.astype(np.uint64), n, np.unique(number[v[is_hot]]))))
    return rows([*out, (chunk, chunk % buckets, STATE, pack(c, number))])


def dealt_pairs(w: Words, train: np.ndarray, c: np.ndarray, number: np.ndarray, buckets: int, hot: float):
    """Per bucket: contexts, words, training counts, whether the context is hot, and the pairs' places in the chunk.

    Only pairs whose context may have been seen in training are asked about.  All pairs of a context go to one bucket, those of a
    hot context to SPREAD buckets.
    """
    v, x, place = pairs(w)
    n = np.bincount(place[train], minlength=len(v)).astype(np.uint64)
    known = np.append(c, 1)[v] > 0
    v, x, n = v[known], x[known], n[known]
    is_hot = (v == len(w.words)) | (np.append(c, 0)[v] > hot)
    bucket = mixed(number[v] + np.where(is_hot, mixed(number[x]) % np.uint64(SPREAD) * MIX, np.uint64(0))) % np.uint64(buckets)
    at = np.flatnonzero(known)
    for b, i in in_buckets(bucket, buckets):
        yield b, v[i], x[i], n[i], is_hot[i], at[i]


def in_buckets(bucket: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The places of each bucket's entries, in their order."""
    bucket = bucket.astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    return [(b, order[part]) for b, part in by_bucket(bucket[order], buckets)]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list in which equal ones are neighbours, once each, with their numbers."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.append(first, len(x))).astype(np.uint64)


TABLE = f"{MESSAGE}, context long, words array<long>, counts array<long>, sums array<long>"


def table_rows(bucket: int, kind: int, context: np.ndarray, held: np.ndarray, *lists: np.ndarray) -> pa.Table:
    """Rows of the count tables: a context and lists with so many entries as it holds; the last has any length."""
    n = len(held)
    edges = pa.array(np.concatenate(([0], np.cumsum(held))), pa.int32())
    made = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int64))) for x in lists[:2]]
    wide = np.arange(n + 1) * (len(lists[2]) // max(1, n))
    made.append(pa.ListArray.from_arrays(pa.array(wide, pa.int32()), pa.array(lists[2].astype(np.int64))))
    same = [pa.array(np.full(n, -1), pa.int64()), pa.array(np.full(n, bucket), pa.int64()), pa.array(np.full(n, kind), pa.int32()), pa.nulls(n, pa.binary())]
    return pa.Table.from_arrays([*same, pa.array(context.astype(np.int64)), *made], names=TABLE_NAMES)


def messages(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
    t = rows(found)
    for name in TABLE_NAMES[4:]:
        t = t.append_column(name, pa.nulls(t.num_rows, pa.int64() if name == "context" else pa.list_(pa.int64())))
    return t


TABLE_NAMES = [c.split()[0] for c in TABLE.split(", ")]


def count_pairs(key: tuple, told: pa.Table) -> pa.Table:
    """Adds up the pairs of one bucket; answers each message with its pairs' counts and its contexts' sums.

    Rows of kind PAIRS are the bucket's count table: the words after each context and how often; those of kind WORDS the
    hashes, counts and numbers of words.
    """
    bucket = key[0].as_py()
    every = sorted(zip(told.column("chunk").to_pylist(), told.column("kind").to_pylist(), told.column("payload").to_pylist()))
    out = [(c, bucket, k, p) for c, k, p in every if k not in (ASK, WORDS)]
    asked = [(c, unpack(p)) for c, k, p in every if k == ASK]
    held = [unpack(p) for _, k, p in every if k == WORDS]
    made = [table_rows(bucket, WORDS, np.zeros(1), np.array([len(p[0])]), *p) for p in held]
    if not asked:
        return pa.concat_tables([messages(out), *made])
    v = np.concatenate([np.repeat(p[0].astype(np.uint64), p[1].astype(np.int64)) for _, p in asked])
    x, c = (np.concatenate([p[i].astype(np.uint64)[p[4]] for _, p in asked]) for i in (2, 3))
    n = np.concatenate([p[5].astype(np.uint64) for _, p in asked])
    order = np.lexsort((x, v))
    v, x, c = v[order], x[order], c[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(n[order], first)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    contexts, member = np.unique(v[first], return_inverse=True)
    sums = context_sums(member, len(contexts), count, c[first])
    out.append((-1, bucket, BI, pack(seen_once(count).astype(np.uint64))))
    seen = count > 0
    learned = np.unique(member[seen])
    made.append(table_rows(bucket, PAIRS, contexts[learned], np.bincount(member[seen], minlength=len(contexts))[learned], x[first][seen], count[seen], sums[:, learned].T.ravel()))
    hot = np.unique(np.concatenate([p[6].astype(np.uint64) for _, p in asked]))
    if len(hot):
        i = np.searchsorted(contexts, hot)
        out.append((-1, bucket, HOT, pack(hot, *sums[:, i])))
    at = 0
    for chunk, p in asked:
        i = np.searchsorted(contexts, p[0].astype(np.uint64))
        out.append((chunk, bucket, ASK, pack(count[place[at : at + len(p[4])]], *sums[:, i])))
        at += len(p[4])
    return pa.concat_tables([messages(out), *made])


def context_sums(member: np.ndarray, n: int, count: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per context: how many words follow it 1..K times; how many words seen after it have counts 1..K; the sum of greater ones."""
    seen = count > 0
    out = [np.bincount(member[count == r], minlength=n) for r in range(1, K + 1)]
    out += [np.bincount(member[seen & (c == r)], minlength=n) for r in range(1, K + 1)]
    big = np.zeros(n, np.uint64)
    np.add.at(big, member[seen & (c > K)], c[seen & (c > K)])
    return np.stack([*[o.astype(np.uint64) for o in out], big])


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(key: tuple, t: pa.Table, told: pa.Table, buckets: int, hot: float, totals: Totals) -> pa.Table:
    """The scores of a chunk's documents, token by token: the pair if it was seen, else the weight of its context and
    the word."""
    t = in_order(t)
    w, train = words_of(t)
    kinds, raw = told.column("kind").to_pylist(), told.column("payload").to_pylist()
    c, number = next(unpack(p) for k, p in zip(kinds, raw) if k == STATE)
    c, number = c.astype(np.int64), number.astype(np.uint64)
    said = {b: p for b, k, p in zip(told.column("bucket").to_pylist(), kinds, raw) if k == ASK}
    v, x, place = pairs(w)
    ends = int(c[w.words.index(END)]) if END in w.words else 0
    context = np.append(c, ends)
    count = np.zeros(len(v), np.int64)
    sums = np.zeros((2 * K + 1, len(w.words) + 1), np.int64)
    for b, vv, _, _, _, at in dealt_pairs(w, train, c.astype(np.uint64), number, buckets, hot):
        got = unpack(said[b])
        count[at] = got[0]
        own = vv[np.flatnonzero(np.append(True, vv[1:] != vv[:-1]))]
        sums[:, own] = np.stack(got[1:])
    for i in np.flatnonzero((np.arange(len(context)) == len(w.words)) | (context > hot)):
        if int(number[i]) in totals.hot:
            sums[:, i] = totals.hot[int(number[i])]
    r = np.arange(1, K + 1)
    held = np.maximum(context, 1)
    free = ((1 - totals.d_bi) * r) @ sums[:K] / held
    full = free <= 0
    free = np.where(full, 1 / (held + 1), free)
    shrink = np.where(full, held / (held + 1), 1.0)
    seen_mass = ((totals.d_uni * r) @ sums[K : 2 * K] + sums[2 * K]) * totals.scale
    alpha = np.where(context > 0, free / np.maximum(1 - seen_mass, 1e-300), 1.0)
    word = totals.word(c)
    p = np.where(count > 0, shrink[v] * discounted(count, totals.d_bi) / held[v], alpha[v] * word[x])
    each = np.log10(p)[place]
    base = np.log10((c + 0.5) / (totals.n + 0.5 * (totals.v + 1)))[w.ids]
    total = lambda a: np.add.reduceat(a, w.begin)  # noqa: E731  every text has a closing token
    n = len(w.end)
    return pa.Table.from_arrays([t.column("doc_id").combine_chunks(), pa.array(w.end - w.begin, pa.int64()), pa.array(total((c > 0)[w.ids].astype(np.int64)), pa.int64()), pa.array(np.full(n, totals.n), pa.int64()), pa.array(total(base)), pa.array(total(each))], names=[x.split()[0] for x in SCORES.split(", ")])


@dataclass
class Model:
    """A trained model: its count tables in the shared folder and the sums that all tasks share."""

    tables: DataFrame
    totals: Totals

    def words(self) -> DataFrame:
        """(h, number, n): hash, number and training count of each word."""
        kept = self.tables.where(F.col("kind") == WORDS)
        return kept.select(F.explode(F.arrays_zip("words", "counts", "sums")).alias("w")).select(F.col("w.words").alias("h"), F.col("w.sums").alias("number"), F.col("w.counts").alias("n"))

    def pairs(self) -> DataFrame:
        """(context, word, n): how often a word follows a context, by their numbers."""
        kept = self.tables.where(F.col("kind") == PAIRS)
        return kept.select("context", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("context", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))

    def contexts(self) -> DataFrame:
        """(context, shrink, alpha): what pairs of a context are multiplied by, and what words not seen after it are."""
        t, r = self.totals, range(1, K + 1)
        kept = self.tables.where(F.col("kind") == PAIRS)
        every = kept.groupBy("context").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("held"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * K + 1)])
        weigh = lambda w, at: sum((F.lit(float(x)) * F.col(f"s{at + i}") for i, x in enumerate(w)), F.lit(0.0))
        free = weigh([(1 - d) * k for k, d in zip(r, t.d_bi)], 0) / F.col("held")
        mass = (weigh([d * k for k, d in zip(r, t.d_uni)], K) + F.col(f"s{2 * K}")) * t.scale
        full = free <= 0
        return every.select("context", (F.when(full, F.col("held") / (F.col("held") + 1)).otherwise(1.0) / F.col("held")).alias("shrink"), (F.when(full, 1 / (F.col("held") + 1)).otherwise(free) / F.greatest(1 - mass, F.lit(1e-300))).alias("alpha"))


def score_new(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, score) for rows that need not be of the training table, from the model's tables by joins.

    Texts are read as in ``score``; every row is scored, repeated ones too.
    """
    t = model.totals
    disc = lambda c, d: F.when(c > K, c.cast("double")).otherwise(F.element_at(F.array(*[F.lit(float(k * x)) for k, x in enumerate(d, 1)]), F.least(c, F.lit(K)).cast("int")))
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashes = F.transform(F.concat(words(lower), F.array(F.lit(""))), lambda w: F.xxhash64(w))
    rows_ = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), hashes.alias("hs")))
    known = model.words()
    toks = rows_.select("row", "doc_id", F.posexplode("hs").alias("at", "h"), "hs").select("row", "doc_id", "h", F.when(F.col("at") > 0, F.get("hs", F.col("at") - 1)).alias("before"))
    toks = toks.join(known.select("h", F.col("number").alias("word"), F.col("n").alias("c")), "h", "left")
    toks = toks.join(known.select(F.col("h").alias("before"), F.col("number").alias("context")), "before", "left")
    toks = toks.withColumn("context", F.when(F.col("before").isNull(), F.lit(int(START))).otherwise(F.col("context")))
    toks = toks.join(model.pairs(), ["context", "word"], "left").join(model.contexts(), "context", "left")
    alone = F.when(F.col("c") > 0, disc(F.col("c"), t.d_uni) * t.scale).otherwise(F.lit(t.unknown))
    p = F.when(F.col("n") > 0, F.col("shrink") * disc(F.col("n"), t.d_bi)).otherwise(F.coalesce("alpha", F.lit(1.0)) * alone)
    return toks.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_tokens"), F.count("c").alias("n_known"), F.sum(F.log10(p)).alias("score")).drop("row")


def score(docs: DataFrame, train: Column, chunk_mb: float = 8, bucket_mb: float = 20) -> DataFrame:
    """The scores of ``train_and_score``."""
    return train_and_score(docs, train, chunk_mb, bucket_mb)[0]


def train_and_score(docs: DataFrame, train: Column, chunk_mb: float = 8, bucket_mb: float = 20) -> tuple[DataFrame, Model]:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``, and the model.

    The model learns from all whole texts of the rows where ``train`` holds.  Tokens are the words of the text in lower case
    (A-Z), then one end.  score is the model's log10 probability of the text, base_score that of an add-half unigram model;
    n_known counts tokens seen in training, train_tokens all of training.  A null text is an empty one: its end alone.
    Repeated rows count and are scored each; extra columns are ignored; without training rows every word is the unknown
    event, of probability 1; no rows give no rows.

    1. Chunks send their distinct words to buckets, which add up the counts and number the words.
    2. Chunks send their distinct pairs with training counts to buckets by context (those of very frequent contexts to
       several), which add up pairs and contexts.  Their count tables, which score other documents too, and their answers
       to the chunks are written to the shared folder.
    3. The driver adds up the buckets' counts of counts and hot contexts; chunks score their texts.
    """
    sized, _, buckets, total = deal(docs.withColumn("train", F.coalesce(train, F.lit(False))), chunk_mb, bucket_mb, "train")
    hot = total / HOT_SHARE
    both = sized.groupBy("chunk")
    counted = both.applyInArrow(lambda key, t: ask_words(key, t, buckets), MESSAGE).groupBy("bucket").applyInArrow(lambda key, t: count_words(key, t, buckets), MESSAGE)
    asked = both.cogroup(counted.groupBy("chunk")).applyInArrow(lambda key, t, told: ask_pairs(key, t, told, buckets, hot), MESSAGE)
    tables = materialize(asked.groupBy("bucket").applyInArrow(count_pairs, TABLE), compression="zstd")
    del counted, asked
    release(docs.sparkSession)
    totals = add_up([(r["kind"], r["payload"]) for r in tables.where("chunk < 0 and payload is not null").select("kind", "payload").collect()])
    told = tables.where("chunk >= 0").select(*[c.split()[0] for c in MESSAGE.split(", ")])
    scored = both.cogroup(told.groupBy("chunk")).applyInArrow(lambda key, t, told: score_texts(key, t, told, buckets, hot, totals), SCORES)
    return scored, Model(tables, totals)


def add_up(stats: list[tuple[int, bytes]]) -> Totals:
    uni, bi, hot = np.zeros(K + 3, np.int64), np.zeros(K + 1, np.int64), {}
    for kind, raw in stats:
        got = unpack(bytes(raw))
        if kind == UNI:
            uni += got[0].astype(np.int64)
        elif kind == BI:
            bi += got[0].astype(np.int64)
        else:
            for g, s in zip(got[0].tolist(), np.stack(got[1:]).T.astype(np.int64)):
                hot[g] = hot.get(g, 0) + s
    return Totals(int(uni[0]), int(uni[1]), uni[2:], bi, hot)


def in_training(doc_id: int | None, folds: int = 5, held: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held
