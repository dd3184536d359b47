"""Quality rules: decision lists learned by sequential covering, applied as one conditional Spark expression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import GAP, materialize

#: What conditions test: ratios, so that they mean the same for short and long texts.
RATIOS = ("word_length", "symbols", "repeats", "dup_lines", "capitals", "distinct", "ends", "words_a_line", "n_words")


def features(docs: DataFrame) -> DataFrame:
    """One row of counts and ratios per row of ``docs`` (doc_id, text), by built-in functions only.

    A null text has no words.  ``n_repeat_words`` counts the words inside 5-word windows that occur twice or more in the
    text: windows are compared as 64-bit hashes, sorted next to each other, so a text of n words costs n log n.
    """
    text = F.coalesce("text", F.lit(""))
    w = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), w.alias("w"), lines.alias("lines"))
    count = lambda keep: F.length(F.regexp_replace("t", f"[^{keep}]+", ""))
    window = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)])
    h = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), window))
    d = d.select("doc_id", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), count(r"#*$%&|<>").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"), count(r"\p{Lu}").alias("n_upper"), F.regexp_count("t", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).alias("n_ends"), F.size(F.array_distinct("w")).alias("n_distinct"), h.alias("h"))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    again = F.filter("s", lambda e, k: (e["x"] == F.get(F.col("s"), k - 1)["x"]) | (e["x"] == F.get(F.col("s"), k + 1)["x"]))
    d = d.withColumn("p", F.sort_array(F.transform(again, lambda e: e["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratios = {"word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "capitals": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), "distinct": F.col("n_distinct") / n, "ends": F.col("n_ends") / n, "words_a_line": n / F.greatest(F.col("n_lines"), F.lit(1))}
    long_ = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("doc_id", *long_, *[F.round(r, 6).alias(f"r_{k}") for k, r in ratios.items()], F.col("n_words").cast("double").alias("r_n_words"))


@dataclass
class DecisionList:
    """Ordered conjunctions of (feature, above, threshold); the first that holds rejects, none keeps."""

    rules: list[list[tuple[str, bool, float]]] = field(default_factory=list)

    def sql(self) -> str:
        if not self.rules:
            return "true"
        whens = [" AND ".join(f"r_{f} {'>' if above else '<='} {t!r}D" for f, above, t in rule) for rule in self.rules]
        return "CASE " + " ".join(f"WHEN {w} THEN false" for w in whens) + " ELSE true END"

    def keeps(self) -> Column:
        return F.expr(self.sql())


def learn(labelled: DataFrame, most_rows: int = 200_000, edges: int = 40, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 5, share: float = 0.01, z: float = 1.28, bound: float = 0.75) -> DecisionList:
    """Sequential covering over ``labelled`` (the columns of ``features`` and a boolean ``bad``).

    A rule grows on half of the rows, by the condition with the best information gain each time, and is pruned on a
    quarter to the prefix of conditions with the best share of bad rows less good ones.  It is kept if of what it covers in the
    last quarter, rows of its own, at least ``precision`` is bad and the lower bound of that share (Wilson's, at ``z``) is
    ``bound`` or more, which takes five bad rows.  Rows it covers leave; learning stops when no such rule covers ``share`` of the
    growing half's bad rows, or ``least`` of them.  The driver sees only counts per feature, quantile bin and label.  Above ``most_rows`` labelled rows, a
    part chosen by hash is used: the documented bound of the sample.
    """
    n = labelled.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < math.ceil(min(1.0, most_rows / max(1, n)) * (1 << 20))
    rows = labelled.where(part & F.col("bad").isNotNull())
    at = [i / (edges + 1) for i in range(1, edges + 1)]
    found = rows.agg(*[F.percentile_approx(f"r_{f}", at, 10_000).alias(f) for f in RATIOS]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in RATIOS}

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda e: e < F.col(f"r_{f}"))) if cuts[f] else F.lit(0)

    rows = materialize(rows.select(F.array(*[bin_of(f) for f in RATIOS]).alias("bins"), "bad", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).alias("part")))
    grow, prune, accept = F.col("part") < 2, F.col("part") == 2, F.col("part") == 3

    def test(condition: tuple[int, bool, int]) -> Column:
        f, above, j = condition
        return F.col("bins")[f] >= j if above else F.col("bins")[f] < j

    def every(conditions: list) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & test(c)
        return out

    bad = rows.where(grow & F.col("bad")).count()
    left, rules, least = F.lit(True), [], max(least, math.ceil(share * bad))
    for _ in range(most_rules):
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < most_conditions:
            seen = rows.where(left & every(rule) & grow).select(F.posexplode("bins").alias("f", "b"), "bad").groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("q")).collect()
            best = condition_of({(r["f"], r["b"]): (r["p"], r["q"]) for r in seen}, [len(cuts[f]) for f in RATIOS], least)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        held = rows.where(left & prune).agg(*[F.count_if(every(rule[:k]) & F.col("bad")).alias(f"p{k}") for k in range(1, len(rule) + 1)], *[F.count_if(every(rule[:k]) & ~F.col("bad")).alias(f"q{k}") for k in range(1, len(rule) + 1)]).first()
        k = max(range(1, len(rule) + 1), key=lambda k: ((held[f"p{k}"] - held[f"q{k}"]) / max(1, held[f"p{k}"] + held[f"q{k}"]), held[f"p{k}"]))
        p, q = rows.where(left & accept & every(rule[:k])).agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        if p < precision * (p + q) or lower_bound(p, p + q, z) < bound:
            break
        rules.append([(RATIOS[f], above, float(cuts[RATIOS[f]][j - 1])) for f, above, j in rule[:k]])
        left = left & ~every(rule[:k])
    return DecisionList(rules)


def lower_bound(hits: int, n: int, z: float) -> float:
    """Wilson's lower bound of a share."""
    if not n:
        return 0.0
    p, zz = hits / n, z * z / n
    return (p + zz / 2 - z * math.sqrt((p * (1 - p) + zz / 4) / n)) / (1 + zz)


def condition_of(seen: dict[tuple[int, int], tuple[int, int]], cuts: list[int], least: int) -> tuple[int, bool, int] | None:
    """The condition with the greatest gain: covered bad rows times the growth of the log of their share."""
    best, top = None, 1e-9
    for f, n in enumerate(cuts):
        p0 = sum(v[0] for (g, _), v in seen.items() if g == f)
        q0 = sum(v[1] for (g, _), v in seen.items() if g == f)
        if not p0 or not q0:
            continue
        below_p = below_q = 0
        for j in range(1, n + 1):
            p, q = seen.get((f, j - 1), (0, 0))
            below_p, below_q = below_p + p, below_q + q
            for above, p, q in ((False, below_p, below_q), (True, p0 - below_p, q0 - below_q)):
                if p >= least and q < q0:
                    gain = p * (math.log(p / (p + q)) - math.log(p0 / (p0 + q0)))
                    if gain > top:
                        best, top = (f, above, j), gain
    return best


def judge(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """The features of every row of ``docs`` with base_failed and kept, and the rules learned from ``labels``.

    ``labels`` has doc_id and quality (1 good, 0 bad; null: not used); a document with several labels counts with each.
    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.  kept is false for those, else
    what the first rule that holds says; rules are learned from labelled documents that pass the base.  Null and empty texts fail; repeated rows get equal results; extra columns are
    ignored; without labels there are no rules and only base_failed decides; no rows give no rows.
    """
    rows = materialize(features(docs))
    good = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("bad"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = learn(rows.where(~failed).join(good, "doc_id"), **options)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.keeps()), rules
