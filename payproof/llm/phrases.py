"""Removal of repeated passages: recurring phrases, Aho-Corasick automata, then exact windows."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._chunks import MESSAGE, Words, by_bucket, deal, in_order, pack, read_words, rows, unpack

BASE = np.uint64(0x9E3779B97F4A7C15)
ASK, STATE = 0, 1
NO_ID = -(1 << 63)


def run_hash(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        out = out * BASE + h[starts + k]
    return out ^ (out >> np.uint64(29))


def starts_of(w: Words, n: int) -> np.ndarray:
    """Where runs of n words inside one text begin."""
    room = np.maximum(0, w.end - w.begin - n + 1)
    return np.repeat(w.begin - np.cumsum(room) + room, room) + np.arange(room.sum())


def slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least or greatest of each n neighbours, at the first of them."""
    op, k = (np.minimum if least else np.maximum), 1
    while 2 * k <= n:
        x, k = op(x[: len(x) - k], x[k:]), 2 * k
    return op(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(w: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases that winnowing picks: the least hash of each window's phrases.

    Two windows with the same words pick the same phrases, so a recurring window holds a recurring anchor.
    """
    at, keys = [], []
    span = window - phrase + 1
    h = w.hashes[w.ids] if len(w.ids) else np.empty(0, np.uint64)
    starts = starts_of(w, phrase)
    hashed = run_hash(h, starts, phrase)
    size = np.maximum(0, w.end - w.begin - phrase + 1)
    first = np.cumsum(size) - size
    for f, n in zip(first[size >= span], size[size >= span]):
        x = hashed[f : f + n]
        low = slide(x, span, True)
        wide = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
        picked = np.flatnonzero(slide(wide, span, False)[:n] == x)
        at.append(starts[f + picked])
        keys.append(x[picked])
    return np.concatenate([*at, np.empty(0, np.int64)]), np.concatenate([*keys, np.empty(0, np.uint64)])


@dataclass
class Keys:
    """Distinct keys, each of two 64-bit hashes: the least document of each, whether it has others, and the place of every
    input in them."""

    key: np.ndarray
    check: np.ndarray
    least: np.ndarray
    several: np.ndarray
    place: np.ndarray


def distinct_keys(keys: np.ndarray, check: np.ndarray, docs: np.ndarray) -> Keys:
    order = np.lexsort((docs, check, keys))
    k, c, d = keys[order], check[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(k))[1:] - 1
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return Keys(k[first], c[first], d[first], d[last] != d[first], place)


def owner(w: Words, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(w.end, at, "right")]


def places(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The places of the keys of each bucket."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return [(b, order[part]) for b, part in by_bucket(bucket[order], buckets)]


def ask(chunk: int, buckets: int, k: Keys) -> list[tuple[int, int, int, bytes]]:
    """Messages with keys and their least documents, one for each bucket."""
    out = []
    for b, i in places(k.key, buckets):
        held, place = np.unique(k.least[i], return_inverse=True)
        out.append((chunk, b, ASK, pack(k.key[i], held, place.astype(np.uint64), k.several[i], k.check[i])))
    return out


def answer(key: tuple, told: pa.Table, repeated: bool) -> pa.Table:
    """Per message, a bit for each key.  ``repeated``: it is in two documents; else: it is in a smaller one than the
    chunk's own least."""
    chunk, bucket, kind, raw = (told.column(c).to_pylist() for c in ("chunk", "bucket", "kind", "payload"))
    out = [x for x in zip(chunk, bucket, kind, raw) if x[2] == STATE]
    asked = sorted(x for x in zip(chunk, bucket, kind, raw) if x[2] == ASK)
    if asked:
        parts = [unpack(x[3]) for x in asked]
        keys = np.concatenate([p[0].astype(np.uint64) for p in parts])
        docs = np.concatenate([p[1][p[2]] for p in parts])
        more = np.concatenate([p[3].astype(bool) for p in parts])
        k = distinct_keys(keys, np.concatenate([p[4].astype(np.uint64) for p in parts]), docs)
        if repeated:
            np.logical_or.at(k.several, k.place[more], True)
            said = k.several[k.place]
        else:
            said = k.least[k.place] < docs
        at = 0
        for x, p in zip(asked, parts):
            n = len(p[0])
            out.append((x[0], x[1], ASK, np.packbits(said[at : at + n]).tobytes()))
            at += n
    return rows(out)


def heard(keys: np.ndarray, buckets: int, told: pa.Table) -> np.ndarray:
    """The answers' bits, in the order of ``keys``."""
    said = np.zeros(len(keys), bool)
    bits = dict(zip(told.column("bucket").to_pylist(), told.column("payload").to_pylist()))
    for b, i in places(keys, buckets):
        said[i] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(i)).astype(bool)
    return said


def spelled(ids: np.ndarray, digits: int) -> str:
    """Each word number as ``digits`` characters, 64 values each: an automaton whose nodes have few children is fast."""
    out = np.empty((len(ids), digits), np.uint8)
    for k in range(digits):
        out[:, digits - 1 - k] = (ids >> (6 * k)) % 64 + 48
    return out.tobytes().decode("latin-1")


def recurring(w: Words, found: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows that hold one of the phrases that begin at ``found``, each of which may occur anywhere.

    The phrases are compiled to an automaton over spelled word numbers, and every text of the chunk is streamed through it.
    """
    if not len(found):
        return np.empty(0, np.int64)
    digits = max(1, -(-int(len(w.words)).bit_length() // 6))
    whole, size = spelled(w.ids, digits), phrase * digits
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for f in found.tolist():
        auto.add_word(whole[f * digits : f * digits + size])
    auto.make_automaton()
    hit = np.zeros(len(w.ids) + 1, np.int32)
    for b, e in zip(w.begin.tolist(), w.end.tolist()):
        if e - b >= window:
            ends = np.array([x for x, _ in auto.iter(whole[b * digits : e * digits])], np.int64) + 1
            first = ends[ends % digits == 0] // digits + b - phrase
            np.add.at(hit, np.maximum(b, first - (window - phrase)), 1)
            np.add.at(hit, first + 1, -1)
    starts = starts_of(w, window)
    return starts[np.cumsum(hit)[starts] > 0]


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 16, chunk_mb: float = 8, bucket_mb: float = 24) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text) for every row of ``docs``.

    Words covered by a window of ``window`` consecutive words that also begins in a document of smaller doc_id are
    removed.  ``spans`` holds the first word and length of each removed run; ``text`` joins the words that stay by a space.
    Windows are those of the whole input text.  Null texts have no words; a null doc_id is smaller than all; rows of one
    doc_id never remove each other's words, so repeated rows are alike; extra columns are ignored; no rows give no rows.
    Windows are told apart by 128 bits: two hashes of their words' two hashes.

    1. Chunks winnow anchors, phrases of ``phrase`` words, and buckets tell which recur in several documents.
    2. Each chunk compiles its recurring phrases to an automaton, streams all of its texts through it and takes the
       windows that hold a phrase; buckets tell, for each such window, if it begins in a smaller document.
    3. Chunks remove what the windows cover.
    """
    dealt, _, buckets, _ = deal(docs, chunk_mb, bucket_mb, spread=True)

    def phrases(w: Words, ids: np.ndarray) -> tuple[np.ndarray, Keys]:
        at, keys = anchors(w, window, phrase)
        return at, distinct_keys(keys, np.zeros(len(keys), np.uint64), owner(w, ids, at))

    def windows(w: Words, ids: np.ndarray, starts: np.ndarray) -> Keys:
        other = np.array([xxhash.xxh64_intdigest(x, 7) for x in w.words], np.uint64)
        return distinct_keys(run_hash(w.hashes[w.ids], starts, window), run_hash(other[w.ids], starts, window), owner(w, ids, starts))

    def texts(t: pa.Table) -> tuple[Words, np.ndarray]:
        t = in_order(t)
        ids = np.array([NO_ID if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)
        return read_words(t.column("text").to_pylist(), False), ids

    def first(key: tuple, t: pa.Table) -> pa.Table:
        w, ids = texts(t)
        return rows(ask(key[0].as_py(), buckets, phrases(w, ids)[1]))

    def second(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        w, ids = texts(t)
        chunk = key[0].as_py()
        at, k = phrases(w, ids)
        one = np.empty(len(k.key), np.int64)
        one[k.place] = at
        starts = recurring(w, one[heard(k.key, buckets, told)], window, phrase)
        held = np.zeros(len(w.ids), bool)
        held[starts] = True
        return rows([*ask(chunk, buckets, windows(w, ids, starts)), (chunk, chunk % buckets, STATE, np.packbits(held).tobytes())])

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), ("text", pa.string())])

    def third(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        w, ids = texts(t)
        state = told.filter(pa.compute.equal(told.column("kind"), STATE))
        bits = told.filter(pa.compute.equal(told.column("kind"), ASK))
        held = np.unpackbits(np.frombuffer(state.column("payload")[0].as_py(), np.uint8), count=len(w.ids)).astype(bool)
        starts = np.flatnonzero(held)
        gone = np.zeros(len(w.ids) + 1, np.int32)
        if len(starts):
            k = windows(w, ids, starts)
            drop = starts[heard(k.key, buckets, bits)[k.place] | (owner(w, ids, starts) > k.least[k.place])]
            np.add.at(gone, drop, 1)
            np.add.at(gone, drop + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        out = []
        for i, (b, e) in enumerate(zip(w.begin, w.end)):
            part = covered[b:e]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], part.astype(np.int8), [0]))))
            kept = w.ids[b:e][~part]
            out.append((None if ids[i] == NO_ID else int(ids[i]), int(e - b), int(part.sum()), [{"first": int(x), "words": int(y - x)} for x, y in zip(edge[::2], edge[1::2])], b" ".join([w.words[j] for j in kept.tolist()]).decode("utf-8", "surrogatepass")))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    both = dealt.groupBy("chunk")
    known = both.applyInArrow(first, MESSAGE).groupBy("bucket").applyInArrow(lambda key, t: answer(key, t, True), MESSAGE)
    judged = both.cogroup(known.groupBy("chunk")).applyInArrow(second, MESSAGE).groupBy("bucket").applyInArrow(lambda key, t: answer(key, t, False), MESSAGE)
    return both.cogroup(judged.groupBy("chunk")).applyInArrow(third, "doc_id long, n_words long, n_removed long, spans array<struct<first: long, words: long>>, text string")
