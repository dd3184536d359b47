"""Evaluation: precision and recall, calibration, retrieval, multisets, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digits_only, plain_words

#: Fields whose values are compared by their digits alone.
MONEY_FIELDS = ("total",)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1")]


def confusion(cases: DataFrame) -> DataFrame:
    """(rule_id, tp, fp, fn) from cases (case_id, expected, fired): arrays of controls."""
    marks = cases.select(F.explode(F.array_union("expected", "fired")).alias("rule_id"), "expected", "fired")
    want, got = F.array_contains("expected", F.col("rule_id")), F.array_contains("fired", F.col("rule_id"))
    return marks.groupBy("rule_id").agg(F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"))


def per_rule(cases: DataFrame) -> DataFrame:
    c = confusion(cases)
    return c.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def micro(cases: DataFrame) -> DataFrame:
    """Totals over all controls, and the share of cases that match exactly."""
    total = confusion(cases).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    exact = cases.agg(F.avg((F.sort_array("expected") == F.sort_array("fired")).cast("double")).alias("exact"))
    return total.crossJoin(exact).select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round("exact", 4).alias("exact_match"))


def detection(cases: DataFrame, scored: list[str]) -> DataFrame:
    """Of the cases that expect a scored control: how many are caught whole; cases whose kind no control covers; noise.

    ``cases`` has kind, expected, fired.
    """
    own = F.array(*[F.lit(s) for s in scored])
    want = F.array_intersect("expected", own)
    caught = F.size(F.array_except(want, "fired")) == 0
    noise = F.size(F.array_except("fired", "expected")) > 0
    return cases.agg(F.count_if(F.size(want) > 0).alias("expected_cases"), F.count_if((F.size(want) > 0) & caught).alias("caught"), F.count_if((F.col("kind") != "none") & (F.size(want) == 0)).alias("uncovered"), F.count_if((F.col("kind") == "none") & noise).alias("noisy_clean"), F.sum(F.size("fired")).alias("fired"))


def calibration(outcomes: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n, accuracy, mean_confidence, gap) from (confidence, correct) over bins of equal width."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    b = outcomes.where("confidence is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    return b.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def expected_calibration_error(outcomes: DataFrame, bins: int = 5) -> DataFrame:
    return calibration(outcomes, bins).agg(ratio(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"))


def retrieval(samples: DataFrame) -> DataFrame:
    """hit@1, hit@k, mean reciprocal rank from (expected, retrieved): a control and a ranked array."""
    place = F.array_position("retrieved", F.col("expected"))
    return samples.agg(F.count("*").alias("n"), F.avg((place == 1).cast("double")).alias("hit_at_1"), F.avg((place > 0).cast("double")).alias("hit_at_k"), F.avg(F.when(place > 0, 1 / place).otherwise(0.0)).alias("mrr"))


def never_retrieved(samples: DataFrame) -> DataFrame:
    """Expected controls that no ranked list holds."""
    return samples.groupBy("expected").agg(F.max(F.array_contains("retrieved", F.col("expected"))).alias("found")).where(~F.col("found")).select("expected")


def multiset_score(predicted: DataFrame, golden: DataFrame, on: list[str]) -> DataFrame:
    """tp, fp, fn of two bags of rows: a name counts as often as both hold it."""
    a = predicted.groupBy(*on).agg(F.count("*").alias("p"))
    b = golden.groupBy(*on).agg(F.count("*").alias("g"))
    both = a.join(b, on, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    c = both.agg(F.sum(F.least("p", "g")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    return c.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def fresh_findings(injected: DataFrame, results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, kind, fresh): what each injected document (id, kind, orig_id, replaces) raises that the document it was made from
    did not, or that names that document.  ``replaces`` may be absent: the document that it stands for instead of joining it."""
    had = baseline.select(F.col("id").alias("made_from"), F.col("findings.rule_id").alias("before"))
    made = injected.withColumn("made_from", F.coalesce("orig_id", "replaces") if "replaces" in injected.columns else F.col("orig_id"))
    rows = made.join(results.select("id", "findings"), "id").join(had, "made_from", "left")
    before = F.coalesce("before", F.array().cast("array<string>"))
    new = lambda f: ~F.array_contains(before, f["rule_id"]) | F.coalesce(F.array_contains(f["related"], F.col("orig_id")), F.lit(False))
    return rows.select("id", "kind", F.filter("findings", new).alias("fresh"))


def injected_detection(injected: DataFrame, results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, n, automatic, assisted): how many injected documents raise something new of high severity, or anything new."""
    high = F.exists("fresh", lambda f: f["severity"] == "high")
    return fresh_findings(injected, results, baseline).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(high).alias("automatic"), F.count_if(F.size("fresh") > 0).alias("assisted"))


def injected_rules(injected: DataFrame, results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(kind, rule_id, n): which controls the injected documents raise anew."""
    return fresh_findings(injected, results, baseline).select("kind", F.explode("fresh.rule_id").alias("rule_id")).groupBy("kind", "rule_id").agg(F.count("*").alias("n"))


def false_alarms(results: DataFrame, adjusted: DataFrame, rule: str = "P-007") -> DataFrame:
    """One row about clean documents: how many raise ``rule``, and how many of those are not in ``adjusted`` (id)."""
    marked = results.select("id", F.array_contains("findings.rule_id", rule).alias("fires")).join(adjusted.select("id", F.lit(True).alias("adjusted")).distinct(), "id", "left")
    plain = F.col("adjusted").isNull()
    return marked.agg(F.count("*").alias("documents"), F.count_if(~plain).alias("adjusted"), F.count_if("fires").alias("fired"), F.count_if(F.col("fires") & plain).alias("fired_unadjusted"), F.count_if(plain).alias("unadjusted"))


def medians(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, median) of the values that are not null: the middle one, or the mean of the two in the middle.

    Equal values are counted before rows meet, so a group is as long as it has different values.  Those pass through one task,
    ordered by a window, which spills."""
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ordered = W.partitionBy("by").orderBy("v")
    placed = counted.select("by", "v", "c", F.sum("c").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    total = counted.groupBy("by").agg(F.sum("c").alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda at: (F.col("upto") - F.col("c") < at) & (at <= F.col("upto"))
    one = placed.join(total.withColumnRenamed("by", "_by"), F.col("by").eqNullSafe(F.col("_by"))).where(holds(low) | holds(high))
    return one.groupBy("by").agg(F.max("n").alias("n"), ((F.min("v") + F.max("v")) / 2).alias("median")).withColumnRenamed("by", by)


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal and a percent sign, ``n/a`` of nothing."""
    return F.when(whole != 0, F.concat(F.format_string("%.1f", F.lit(100.0) * part / F.nullif(whole, F.lit(0))), F.lit("%"))).otherwise("n/a")


def comparable(field: Column, value: Column) -> Column:
    """A read value as it is compared: digits of money, lower-case words of the rest; null if nothing is left."""
    return F.nullif(F.when(field.isin(*MONEY_FIELDS), digits_only(value)).otherwise(plain_words(value)), F.lit(""))


def scalar_scores(values: DataFrame) -> DataFrame:
    """``values`` (field, predicted, golden, ...) with tp, fp, fn: a wrong value counts as both false and missed."""
    p, g = comparable(F.col("field"), F.col("predicted")), comparable(F.col("field"), F.col("golden"))
    same = F.coalesce(p == g, F.lit(False))
    return values.withColumns({"tp": same.cast("int"), "fp": (p.isNotNull() & ~same).cast("int"), "fn": (g.isNotNull() & ~same).cast("int")})


def field_report(values: DataFrame) -> DataFrame:
    """(field, documents, tp, fp, fn, precision, recall, f1, support, scored) per field, and over all as field null.

    Values without a label (golden null) are not scored; a field that no document labels is listed as not scored.
    """
    counted = F.col("golden").isNotNull()
    one = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c)
    rows = scalar_scores(values).rollup("field").agg(F.count_if(counted).alias("documents"), *[one(c) for c in ("tp", "fp", "fn")], F.grouping("field").alias("all"))
    kept = rows.where("all = 1 or field is not null")
    return kept.select("field", "documents", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"), (F.col("documents") > 0).alias("scored"))


def trajectories(routes: DataFrame) -> DataFrame:
    """scenarios, successes, success_rate from (expected, visited): arrays of steps that must be equal."""
    good = F.count_if(F.col("expected") == F.col("visited"))
    return routes.agg(F.count("*").alias("scenarios"), good.alias("successes"), ratio(good, F.count("*")).alias("success_rate"))


def expected_route(cases: DataFrame) -> DataFrame:
    """The steps a document takes, from booleans intake_accepted, page_loaded, signature_enabled, check_citations.

    A file rejected at intake goes to the controls at once, one whose page cannot be loaded a step later.
    """
    read = F.col("intake_accepted") & F.col("page_loaded")
    steps = F.array(F.lit("triage"), F.when(F.col("intake_accepted"), F.lit("load_image")), F.when(read, F.lit("read_fields")), F.when(read & F.col("signature_enabled"), F.lit("detect_signature")), F.when(read, F.lit("history")), F.lit("evaluate"), F.when(F.col("check_citations"), F.lit("check_citations")))
    return cases.withColumn("route", F.array_compact(steps))


def citations(checks: DataFrame) -> DataFrame:
    """Of checked findings (ran, supported): faithfulness, null if none ran."""
    return checks.agg(F.count_if("ran").alias("ran"), F.count_if(F.col("ran") & ~F.col("supported")).alias("unsupported"), F.try_divide(F.count_if(F.col("ran") & F.col("supported")), F.count_if("ran")).alias("faithfulness"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost; calls of models without a price are counted apart."""
    return calls.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0).cast("decimal(18,6)")).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` (model, input_tokens, output_tokens, ...) with cost_usd to a millionth, half to even; null for a model
    without a price, for an unknown cost is not none.  ``prices`` has model, input_price, output_price per million tokens."""
    tokens = lambda c: F.col(c).cast("decimal(12,0)")
    cost = (tokens("input_tokens") * F.col("input_price") + tokens("output_tokens") * F.col("output_price")).cast("decimal(28,4)") * F.lit("0.000001").cast("decimal(7,6)")
    return calls.join(prices, "model", "left").withColumn("cost_usd", F.bround(cost, 6).cast("decimal(18,6)")).drop("input_price", "output_price")
