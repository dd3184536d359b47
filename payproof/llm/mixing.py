"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, apart, materialize

SLICES = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def target_words(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), cap: int = 2) -> dict[str | None, Fraction]:
    """Words wanted of each source: ``share`` of all sizes by weight; no more than ``cap`` times a source's size, what
    is above goes to the others by weight.  Weights repeat over the sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] > cap * sizes[s] * total}
        if not above:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: Fraction(cap * sizes[s]) for s in above}
        rest -= sum(out[s] for s in above)
        open_ -= above
    return out


def route(supply: dict[str, tuple[int, list[str | None]]], quota: dict[str | None, int], repeats: int = 2) -> dict[str, dict[str | None, int]]:
    """Words each pattern gives each of its sources: as many in all as quotas and supplies allow, at the least cost.

    A pattern's words cost 0 in their first use, 1 in their second, and so on.  The costs sit on the arcs out of the
    flow's origin alone, so cheapest paths first means: fill the first uses, then the second, rerouting on the way.
    """
    flow = {p: dict.fromkeys(members, 0) for p, (_, members) in supply.items()}
    given, got = dict.fromkeys(supply, 0), dict.fromkeys(quota, 0)
    holders: dict[str | None, list[str]] = {s: [] for s in quota}
    for p, (_, members) in supply.items():
        for s in members:
            holders[s].append(p)
    for use in range(1, repeats + 1):
        room = {p: use * n for p, (n, _) in supply.items()}
        while True:
            came: dict[tuple, tuple | None] = {("p", p): None for p in supply if given[p] < room[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = at = queue.popleft()
                if kind == "p":
                    after = [("s", s) for s in flow[x]]
                elif got[x] < quota[x]:
                    end = at
                    break
                else:
                    after = [("p", p) for p in holders[x] if flow[p][x] > 0]
                for y in after:
                    if y not in came:
                        came[y] = at
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(room[path[0][1]] - given[path[0][1]], quota[end[1]] - got[end[1]], *[flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"], room[path[0][1]])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            given[path[0][1]] += amount
            got[end[1]] += amount
    return flow


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), repeats: int = 2, seed: int = 17, most_patterns: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Select documents, some of them more than once, so that each source's words come near its target.

    ``docs`` has doc_id, text and ``sources``, an array of the sources that a document belongs to (null: the one source
    null; empty: none, so it is never taken).  Returns

    * the selection, a row per row of ``docs``: h (its place in the order), doc_id, sources, size, copies, taken
      (copies times size) and ``given_to``, the source that each copy counts for;
    * the targets: source, source_size (all words of its documents), target.

    Documents with one set of sources form a pattern.  Patterns and their words are all that reaches the driver, at
    most ``most_patterns`` of them (more is an error).  Within a pattern, documents stand in an order seeded by ``seed``;
    prefixes of that order are taken, found from sums over 4096 slices and a running sum inside a slice, so no
    pattern, however large, is sorted in one task.  Null and wordless texts have size 0 and are never taken; repeated rows
    are separate documents; reruns give the same rows; no rows give no rows.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.coalesce("sources", F.array(F.lit(None).cast("string")))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("sources"), word_count(F.col("text")).alias("size"), selection_hash(seed, F.col("doc_id").cast("long"), F.col("text")).alias("h"))
    sized = materialize(sized.withColumn("pattern", F.to_json("sources")).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int")))
    slices = materialize(sized.groupBy("pattern", "sources", "slice").agg(F.sum("size").alias("words")))
    patterns = slices.groupBy("pattern", "sources").agg(F.sum("words").alias("n")).limit(most_patterns + 1).collect()
    if len(patterns) > most_patterns:
        raise ValueError(f"over {most_patterns} patterns of sources")
    sizes: dict[str | None, int] = {}
    for r in patterns:
        for s in r["sources"]:
            sizes[s] = sizes.get(s, 0) + r["n"]
    wanted = target_words(sizes, weights, share, repeats)
    flow = route({r["pattern"]: (r["n"], list(r["sources"])) for r in patterns}, {s: round(t) for s, t in wanted.items()}, repeats)
    plan = []
    for r in patterns:
        upto, ends = 0, []
        for s, n in sorted(flow[r["pattern"]].items(), key=lambda x: (x[0] is None, x[0] or "")):
            upto += n
            ends.append((upto, s))
        plan.append((r["pattern"], r["n"], upto, ends))
    routed = spark.createDataFrame(plan, "pattern string, supply long, upto long, ends array<struct<upto: long, source: string>>")
    before = slices.withColumn("before", F.sum("words").over(W.partitionBy("pattern").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.sum("size").over(W.partitionBy("pattern", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = sized.withColumn("inside", inside).join(before.select("pattern", "slice", "before"), ["pattern", "slice"]).join(routed, "pattern")
    middle = F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0)) + F.col("size") / 2
    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda u: middle + u * F.col("supply")), lambda at: (at <= F.col("upto")) & (F.col("size") > 0))
    given = F.transform(uses, lambda at: F.get(F.filter("ends", lambda e: e["upto"] >= at), F.lit(0))["source"])
    chosen = placed.select("h", "doc_id", "sources", "size", F.size(uses).alias("copies"), (F.size(uses) * F.col("size")).cast("long").alias("taken"), given.alias("given_to"))
    targets = spark.createDataFrame([(s, sizes[s], float(t)) for s, t in wanted.items()], "source string, source_size long, target double")
    return chosen, targets


def mix_by_source(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, h): the mix of documents that have one ``source`` each."""
    chosen, targets = mix(docs.select("doc_id", "text", F.array("source").alias("sources")), **options)
    one = chosen.withColumn("source", F.get("sources", F.lit(0)))
    return one.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("doc_id", "size", "source_size", "target", "taken", "copies", "source", "h")


@apart("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """All rows and columns of ``docs``, each with the words that the mix takes of it and how often: ``size``, ``source_size``,
    ``target``, ``taken`` and ``copies`` (columns of these names give way).  Repeated rows share out their copies."""
    made = ["size", "source_size", "target", "taken", "copies"]
    id_ = F.col("doc_id").cast("long")
    number = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.lit(0)))
    mixed = mix_by_source(docs, seed=seed, **options).select(F.col("h").alias("_h"), F.col("source").alias("_s"), *made)
    mixed = mixed.withColumn("_n", number("_h", "_s"))
    own = docs.drop(*made).withColumn("_h", selection_hash(seed, id_, F.col("text"))).withColumn("_n", number("_h", "source"))
    same = (own["_h"] == mixed["_h"]) & own["source"].eqNullSafe(F.col("_s")) & (own["_n"] == mixed["_n"])
    return own.join(mixed, same).select(*[own[c] for c in docs.columns if c not in made], *made)


def selection_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """What the order of documents in a pattern is seeded by."""
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(-1)), F.xxhash64(F.coalesce(text, F.lit(""))))
