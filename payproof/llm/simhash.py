"""SimHash near-duplicates: pigeonhole blocks, Hamming checks, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import apart, materialize, sliced
from ._graph import components, spanning
from .minhash import alike, shingles

BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles of the lower-cased text; zero without a word."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    if len(toks) <= shingle:
        grams = [b" ".join(toks)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(toks, toks[1:], toks[2:])]
    else:
        grams = [b" ".join(g) for g in zip(*(toks[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 65536):
        part = grams[at : at + 65536]
        raw = np.frombuffer(b"".join([digest(g, 42) for g in part]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): id, hash of the text and fingerprint, a signed long, of every row.  Null and wordless texts have
    fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps)], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """One key for each way to choose ``blocks - distance`` of the blocks: fingerprints that differ in at most
    ``distance`` bits leave so many blocks alike, so they share one of these keys."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), *[part[j] for j in c]) for i, c in enumerate(combinations(range(blocks), blocks - distance))])


def links(fps: DataFrame, distance: int = 3, blocks: int = 5, cell: int = 2048) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints that chains of pairs within ``distance`` bits connect.

    ``fps`` has distinct values ``fp``.  The fingerprints under one key are compared in cells of at most about
    ``2 * cell`` values: a key with more is dealt into slots, and each pair of slots is a cell of its own.  From each cell come
    only the links of a spanning forest, never all pairs.
    """
    keyed = fps.select(F.explode(block_keys(F.col("fp"), distance, blocks)).alias("k"), "fp")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    slots = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("fp"), slots)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), slots - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    dealt = keyed.join(sizes, "k").select("k", "fp", F.explode(cells).alias("c")).select("k", "c.x", "c.y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(4)]
        for b in batches:
            cols = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            yield from close([c[:cut] for c in cols])
        yield from close(held)

    def close(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, x, y, fp = cols
        n, us, vs = len(k), [], []
        ids, step = np.arange(n), 1
        while step < n:
            i = ids[ids < n - step]
            i = i[(k[i] == k[i + step]) & (x[i] == x[i + step]) & (y[i] == y[i + step])]
            if not len(i):
                break
            near = i[np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= distance]
            us.append(near)
            vs.append(near + step)
            ids, step = i, step + 1
        if us and sum(map(len, us)):
            a, b = spanning(np.concatenate(us), np.concatenate(vs), n)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id
    reachable over links.  Null ids never are the smallest, unless a component has no other (its id is then null).
    Repeated rows get the same class; empty tables give no rows.  Rows of one fingerprint are counted as one value, so
    groups of copies of any size add one value.
    """
    fp, rooted = rooted_fingerprints(docs, shingle, distance, blocks)
    ids = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    return fp.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def rooted_fingerprints(docs: DataFrame, shingle: int, distance: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, and (fp, root, first) of every fingerprint: the root of its component and its first row,
    by id, nulls last, then by text hash."""
    fp = materialize(with_fingerprint(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    values = materialize(fp.groupBy("fp").agg(F.min(place).alias("first")))
    found = components(links(values.select("fp"), distance, blocks))
    return fp, values.join(found, values["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


@apart("doc_id", "text")
def simhash_first(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest (doc_id, text hash), null ids last.

    A component is found as in ``simhash_components``; of repeated rows one stays; all columns stay.
    """
    _, rooted = rooted_fingerprints(docs, shingle, distance, blocks)
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_h"))
    return docs.join(keep, same).drop("_id").dropDuplicates(["doc_id", "_h"]).drop("_h")


#: Longs of fingerprints that travel with a key, for the Hamming check.
CHECKED = 4


def fingerprints(hashes: np.ndarray, many: int) -> np.ndarray:
    """``many`` independent fingerprints of a set of 64-bit hashes: majority bits of the hashes, mixed anew for each."""
    ones = np.zeros(many * BITS, np.int64)
    steps = np.arange(1, many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 8192):
        z = hashes[at : at + 8192, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def bits_apart(similarity: float) -> float:
    """The share of bits in which fingerprints of equally large sets of that Jaccard similarity differ; of sets of unlike
    sizes they differ in fewer."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(n: int, similarity: float, recall: float, cell: int) -> tuple[int, int]:
    """(blocks, fingerprints): blocks short enough for ``recall`` and long enough that few of n unlike texts share one."""
    blocks = next((b for b in (6, 5, 4) if n <= cell * 2 ** (BITS / b)), 3)
    missed = (1 - (1 - bits_apart(similarity)) ** (BITS / blocks)) ** blocks
    return blocks, max(CHECKED, math.ceil(math.log(1 - recall) / math.log(missed)))


def most_apart(similarity: float) -> float:
    """Bits of CHECKED fingerprints in which sets of that similarity differ at most, up to 4.5 standard deviations."""
    width, p = CHECKED * BITS, bits_apart(similarity)
    return width * p + 4.5 * math.sqrt(width * p * (1 - p))


def close_pairs(fps: list[np.ndarray], most: float) -> tuple[np.ndarray, np.ndarray]:
    """All (u, v), u < v, of rows whose fingerprints differ in ``most`` bits or fewer."""
    fps = [f.view(np.uint64) for f in fps]
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(fps[0]), 128):
        d = sum(np.bitwise_count(f[at : at + 128, None] ^ f[None, at:]).astype(np.int16) for f in fps)
        u, v = np.nonzero(d <= most)
        us.append(u[u < v] + at)
        vs.append(v[u < v] + at)
    return np.concatenate(us), np.concatenate(vs)


def cells_of(slots: Column) -> Column:
    """The cells of a text whose key is dealt into ``slots``: its own slot with each, so that any two texts meet in one."""
    own = F.pmod(F.xxhash64("h"), slots)
    return F.transform(F.sequence(F.lit(0).cast("long"), slots - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))


def near_pairs(values: DataFrame, similarity: float, blocks: int, many: int, cell: int) -> DataFrame:
    """(a, b, dense): pairs of texts of values (h, fps) that have a block of a fingerprint in common and differ in few enough
    bits.

    Each of the ``many`` fingerprints is cut into ``blocks`` blocks: those that differ in fewer bits than there are blocks have
    one alike.  A key with more than ``cell`` texts is dealt into slots, and each pair of slots is a cell of its own.  A cell in
    which the pairs are more than its texts is dense: it gives links that connect the same texts, not its pairs.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("f", lo).bitwiseAND((1 << (hi - lo)) - 1).bitwiseOR(F.shiftleft((F.col("i") * blocks + j).cast("long"), 40)) for j, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    own = ["h", *[f"f{i}" for i in range(CHECKED)]]
    each = values.select("h", *[F.col("fps")[i].alias(f"f{i}") for i in range(CHECKED)], F.posexplode("fps").alias("i", "f"))
    keyed = each.select(F.explode(F.array(*block)).alias("k"), *own)
    none = values.sparkSession.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(1).cast("long").alias("n"))  # no text's key: the plan is the same for tables without hot keys
    hot = materialize(keyed.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > cell).unionByName(none))
    cells = cells_of(F.ceil(F.coalesce("n", F.lit(1)) / cell))
    dealt = keyed.join(hot, "k", "left").select("k", *own, F.explode(cells).alias("c")).select("k", "c.x", "c.y", *own)
    most = most_apart(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(3 + len(own))]
        for b in batches:
            cols = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns)]
            starts = np.flatnonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])])) if len(cols[0]) else []
            yield from closed(cols[3:], starts)
            held = [c[starts[-1] :] for c in cols] if len(starts) else cols
        yield from closed(held[3:], [0, len(held[0])])

    def closed(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            h, *fps = [c[lo:hi] for c in cols]
            u, v = close_pairs(fps, most) if hi - lo > 1 else ([], [])
            if len(u):
                if dense := len(u) > hi - lo:
                    u, v = spanning(u, v, hi - lo)
                found.append((np.minimum(h[u], h[v]), np.maximum(h[u], h[v]), np.full(len(u), dense)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "dense"])

    return dealt.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "h").mapInArrow(run, "a long, b long, dense boolean").distinct()


def group_links(members: DataFrame, shingle: int, similarity: float, cell: int) -> DataFrame:
    """Links (a, b) that connect what all pairs of texts of one group with a Jaccard similarity of ``similarity`` connect.

    ``members`` (g, h, fps, text) has each text in one group.  Their sets of shingles meet in cells of at most about
    ``2 * cell`` texts and a million hashes, where the pairs that differ in few enough bits are compared exactly.  From
    each cell come only the links of a spanning forest, so that no row is made of a pair.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t, shingle).view(np.int64) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["g", "h", "fps", "hashes"])

    sets = materialize(members.select("g", "h", "fps", "text").mapInArrow(cut, "g long, h long, fps array<long>, hashes array<long>"))
    slots = F.ceil(F.greatest(F.count("*") / cell, F.sum(F.size("hashes")) / (1 << 19)))
    hot = materialize(sets.groupBy("g").agg(slots.alias("slots")).where("slots > 1"))
    checked = [F.col("fps")[i].alias(f"f{i}") for i in range(CHECKED)]
    dealt = sets.join(hot, "g", "left").select("g", "h", *checked, "hashes", F.explode(cells_of(F.coalesce("slots", F.lit(1)))).alias("c")).select("*", "c.x", "c.y").drop("c")
    most = most_apart(similarity)

    def run(t: pa.Table) -> pa.Table:
        h, n = t["h"].to_numpy(), t.num_rows
        u, v = close_pairs([t[f"f{i}"].to_numpy() for i in range(CHECKED)], most)
        size = pc.list_value_length(t["hashes"]).to_numpy().astype(np.int64)
        _, at, many = np.unique(pc.list_flatten(t["hashes"]).to_numpy(), return_inverse=True, return_counts=True)
        shared = many[at] > 1  # a hash of one text is in no intersection
        row, at = np.repeat(np.arange(n), size)[shared], (np.cumsum(many > 1) - 1)[at[shared]]
        bits = np.zeros((n, np.count_nonzero(many > 1) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        step = max(1, (1 << 20) // bits.shape[1])
        both = [np.bitwise_count(bits[u[i : i + step]] & bits[v[i : i + step]]).sum(1, dtype=np.int64) for i in range(0, len(u), step)]
        both = np.concatenate([np.empty(0, np.int64), *both])
        good = both + 1e-9 >= similarity * (size[u] + size[v] - both)
        a, b = spanning(u[good], v[good], n)
        return pa.table({"a": h[a], "b": h[b]})

    return dealt.groupBy("g", "x", "y").applyInArrow(run, "a long, b long")


@apart("doc_id", "text")
def near_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.997, cell: int = 512) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest (doc_id, text hash), null ids last.

    Texts are linked when the Jaccard similarity of their sets of ``shingle``-word shingles, exactly, is ``similarity`` or more.
    Several SimHash fingerprints of those sets, each cut into blocks, say which pairs are compared: a share of ``recall``
    or more of those at ``similarity`` by formula, more above.  Pairs of sparse cells are compared one by one; texts that links
    of dense cells connect are a group, of which all pairs are compared inside the tasks, so no link is lost.  Texts
    without a word are similar to nothing and stay; of rows that agree on doc_id and text one stays; all columns stay; no rows
    give no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    blocks, many = plan(keyed.count(), similarity, recall, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = (shingles(t, shingle) for t in b.column(2).to_pylist())
            fps = [fingerprints(s, many) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "h", "fps"])

    signed = materialize(keyed.mapInArrow(run, "doc_id long, h long, fps array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    values = materialize(signed.where("fps is not null").groupBy("h").agg(F.min(place).alias("first"), F.first("fps").alias("fps")))

    def texts(nodes: DataFrame) -> DataFrame:
        chosen = values.join(nodes, "h", "left_semi").select(F.col("first.doc_id").alias("_id"), F.col("h").alias("_h"))
        return keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("h", "text").dropDuplicates(["h"])

    pairs = materialize(near_pairs(values, similarity, blocks, many, cell))
    sparse, dense = (pairs.where(F.col("dense") == d).select("a", "b") for d in (False, True))
    linked = alike(materialize(texts(sparse.select(F.explode(F.array("a", "b")).alias("h")).distinct())), sparse, shingle, similarity)
    if dense.head(1):
        groups = components(dense).select(F.explode(F.array("node", "root")).alias("h"), F.col("root").alias("g")).distinct()  # roots have no rows of their own
        linked = linked.unionByName(group_links(texts(groups).join(groups, "h").join(values.select("h", "fps"), "h"), shingle, similarity, cell))
    found = components(linked)
    rooted = values.select("h", "first").join(found.withColumnRenamed("node", "h"), "h", "left")
    keep = rooted.groupBy(F.coalesce("root", "h")).agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    keep = keep.unionByName(signed.where("fps is null").select("doc_id", "h").distinct()).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_h"))
    return docs.join(keep, same).drop("_id").dropDuplicates(["doc_id", "_h"]).drop("_h")
