"""Controls that look at one document alone, as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ROUND_DEFAULT, ROUND_RULES, ROUNDING_UNITS, Config
from ..functions.text import money_text as say
from ..functions.text import vendor_key
from ..policies import MESSAGES, POLICIES, SEVERITIES

WIDE = "decimal(38,8)"
SEVERITY = {p[0]: p[2] for p in POLICIES}
EVIDENCE = "map<string,string>"


def evidence(**values: Column | str | None) -> Column:
    """A map of texts; null values stay as null."""
    parts = [x for k, v in values.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string"))]
    return F.create_map(*parts).cast(EVIDENCE)


def worded(which: str, **values: Column | str) -> Column:
    """A finding's wording with its values filled in."""
    parts = [F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(re.split(r"\{(\w+)\}", MESSAGES[which]))]
    return F.concat(*[(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in parts])


def finding(rule: str, summary: Column, proof: Column, related: Column | None = None, severity: Column | None = None, *, message: Column) -> Column:
    """``message`` is for people and may quote the document; ``summary`` never does."""
    return F.struct(F.lit(rule).alias("rule_id"), (F.lit(SEVERITY[rule]) if severity is None else severity).alias("severity"), summary.alias("summary"), proof.alias("evidence"), (F.array().cast("array<bigint>") if related is None else related).alias("related"), message.alias("message"))


#: The fields of a finding.
PARTS = ("rule_id", "severity", "summary", "evidence", "related", "message")


def narrowed(found: Column, parts: tuple[str, ...]) -> Column:
    """A finding with some of its fields: Spark does not compute the others."""
    return found if parts == PARTS else F.struct(*[found[p].alias(p) for p in parts])


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def resolved(item: Column) -> Column:
    """A line's amount, else quantity times price, else the price."""
    return F.coalesce(item["amount"].cast(WIDE), (item["quantity"] * item["unit_price"]).cast(WIDE), item["unit_price"].cast(WIDE))


def line_item_total(items: Column) -> Column:
    """The sum of the lines that have an amount; null if none has."""
    known = F.filter(F.transform(items, resolved), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(WIDE), lambda a, x: (a + x).cast(WIDE)))


def by_currency(values: dict[str, Column], other: Column) -> Column:
    """A CASE over the trimmed upper-case currency."""
    code = F.upper(F.trim(F.col("currency")))
    out = F.when(F.lit(False), other)
    for c, v in values.items():
        out = out.when(code == c, v)
    return out.otherwise(other)


def money(x) -> Column:
    return F.lit(x).cast("decimal(18,4)")


def percent(x: Column | float) -> Column:
    return F.concat(F.bround((x if isinstance(x, Column) else F.lit(x)) * 100, 0).cast("int").cast("string"), F.lit("%"))


def cat(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def intake_rejected(c: Config) -> tuple[Column, Column]:
    fires = F.coalesce(F.col("ingestion_status"), F.lit("accepted")) != "accepted"
    return fires, finding("P-014", F.lit("file rejected at intake, never read"), evidence(filename=F.col("source.file"), reject_reason=F.col("reject_reason")), message=worded("P-014", reason=F.coalesce("reject_reason", F.lit("unspecified reason"))))


def low_confidence(c: Config) -> tuple[Column, Column]:
    conf = F.coalesce("confidence", F.lit(1.0))
    return conf < c.min_confidence, finding("P-013", cat("read confidence ", percent(conf), " < ", percent(c.min_confidence)), evidence(confidence=F.round(conf, 4), threshold=F.lit(c.min_confidence)), message=worded("P-013", confidence=percent(conf), least=percent(c.min_confidence)))


def unsubstantiated(c: Config) -> tuple[Column, Column]:
    total, limit = F.col("total"), money(c.receipt_required_above)
    bare = (total > limit) & F.col("vendor").isNull() & F.col("date").isNull()
    summary = F.when(total.isNull(), "no amount readable").otherwise(cat("amount ", say(total), " > ", say(limit), " with no supplier and no date"))
    return total.isNull() | bare, finding("P-001", summary, evidence(total=say(total), threshold=F.when(total.isNotNull(), say(limit))), message=F.when(total.isNull(), worded("P-001")).otherwise(worded("P-001 bare", total=say(total), limit=say(limit))))


def missing_vendor(c: Config) -> tuple[Column, Column]:
    return F.col("vendor").isNull(), finding("P-003", F.lit("no supplier name"), evidence(vendor=None), message=worded("P-003"))


def missing_date(c: Config) -> tuple[Column, Column]:
    return F.col("date").isNull(), finding("P-004", F.lit("no transaction date"), evidence(date=None), message=worded("P-004"))


def stale(c: Config) -> tuple[Column, Column]:
    age = F.date_diff("today", "date")
    return F.lit(c.stale_check_enabled) & (age > c.stale_after_days) & (age >= 0), finding("P-005", cat(age.cast("string"), f" days old > {c.stale_after_days}-day window"), evidence(date=F.col("date"), age_days=age, window_days=F.lit(c.stale_after_days)), message=worded("P-005", age=age, window=str(c.stale_after_days)))


def future(c: Config) -> tuple[Column, Column]:
    date, today = F.col("date"), F.col("today")
    return date > today, finding("P-006", cat("dated ", date.cast("string"), " after audit date ", today.cast("string")), evidence(date=date, audited_on=today), message=worded("P-006", date=date))


def prepared(docs: DataFrame, c: Config) -> DataFrame:
    """``docs`` with what the arithmetic control compares, each computed once per row."""
    unit = by_currency({k: money(v) for k, v in ROUNDING_UNITS.items()}, money(0))
    sub, tax, total = (F.col(x).cast(WIDE) for x in ("subtotal", "tax", "total"))
    d = docs.withColumns({"_tol": F.greatest(money(c.total_tolerance), unit).cast(WIDE), "_lines": line_item_total(F.col("line_items"))})
    d = d.withColumns({"_base": F.coalesce(sub, "_lines"), "_gap": F.abs(sub - F.col("_lines")).cast(WIDE)})
    expected, uplift = (F.col("_base") + tax).cast(WIDE), F.lit(1 + c.max_uplift_ratio).cast("decimal(9,4)")
    return d.withColumns({"_expected": expected, "_diff": F.abs(total - expected).cast(WIDE), "_ceiling": ((F.col("_base") * uplift).cast(WIDE) + F.col("_tol")).cast(WIDE)})


def arithmetic(c: Config) -> tuple[Column, Column]:
    """Lines against subtotal, then base plus tax against total, or without tax base and total within what tax and service explain."""
    tol, lines, base, gap, expected, diff, ceiling = (F.col(x) for x in ("_tol", "_lines", "_base", "_gap", "_expected", "_diff", "_ceiling"))
    sub, tax, total = F.col("subtotal"), F.col("tax"), F.col("total")
    label = F.when(sub.isNotNull(), "subtotal").otherwise("line items")
    cases = [
        (gap > tol, cat("lines ", say(lines), " != subtotal ", say(sub), " (diff ", say(gap), ")"), evidence(line_item_total=say(lines), subtotal=say(sub), difference=say(gap)), worded("P-007 lines", lines=say(lines), subtotal=say(sub), difference=say(gap))),
        (diff > tol, cat(label, " ", say(base), " + tax ", say(tax), " = ", say(expected), " != total ", say(total), " (diff ", say(diff), ")"), evidence(base=say(base), base_label=label, tax=say(tax), expected_total=say(expected), total=say(total), difference=say(diff)), worded("P-007 total", label=label, base=say(base), tax=say(tax), expected=say(expected), total=say(total), difference=say(diff))),
        (tax.isNull() & (base > total + tol), cat(label, " ", say(base), " > total ", say(total)), evidence(line_item_total=say(lines), subtotal=say(sub), total=say(total)), F.when(sub.isNull(), worded("P-007 rows", base=say(base), total=say(total))).otherwise(worded("P-007 subtotal", base=say(base), total=say(total)))),
        (tax.isNull() & (total > ceiling), cat("total ", say(total), " > max explainable ", say(ceiling), " from ", label, " ", say(base)), evidence(base=say(base), base_label=label, total=say(total), max_explainable=say(ceiling)), worded("P-007 uplift", total=say(total), label=label, base=say(base))),
    ]
    fires, summary, proof, message = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast(EVIDENCE), F.lit(None).cast("string")
    for when, text, why, told in reversed(cases):
        when = F.coalesce(when, F.lit(False))
        fires, summary, proof, message = when | fires, F.when(when, text).otherwise(summary), F.when(when, why).otherwise(proof), F.when(when, told).otherwise(message)
    return fires, finding("P-007", summary, proof, message=message)


def unsigned(c: Config) -> tuple[Column, Column]:
    total, limit = F.col("total"), money(c.signature_required_above)
    return (F.col("signature_present") == F.lit(False)) & (total > limit), finding("P-008", cat("unsigned, amount ", say(total), " > ", say(limit)), evidence(total=say(total), threshold=say(limit)), message=worded("P-008", total=say(total), limit=say(limit)))


def over_limit(c: Config) -> tuple[Column, Column]:
    total, limit = F.col("total"), money(c.approval_limit)
    return F.lit(c.approval_limit_enabled) & (total > limit), finding("P-009", cat("amount ", say(total), " > approval limit ", say(limit)), evidence(total=say(total), limit=say(limit)), message=worded("P-009", total=say(total), limit=say(limit)))


def round_amount(c: Config) -> tuple[Column, Column]:
    total = F.col("total")
    floor = money(c.round_floor) if c.round_floor is not None else by_currency({k: money(v[0]) for k, v in ROUND_RULES.items()}, money(ROUND_DEFAULT[0]))
    step = money(c.round_step) if c.round_step is not None else by_currency({k: money(v[1]) for k, v in ROUND_RULES.items()}, money(ROUND_DEFAULT[1]))
    fires = (total >= floor) & (step != 0) & (F.when(step != 0, total % step) == 0)
    return fires, finding("P-010", cat("amount ", say(total), " is a multiple of ", say(step)), evidence(total=say(total), step=say(step), currency=F.col("currency")), message=worded("P-010", total=say(total)))


def unapproved(c: Config) -> tuple[Column, Column]:
    keys = sorted({_key(v) for v in c.approved_vendors})
    fires = F.col("vendor").isNotNull() & ~vendor_key(F.col("vendor")).isin(keys) if keys else F.lit(False)
    return fires, finding("P-012", F.lit("supplier not on approved list"), evidence(vendor=F.col("vendor")), message=worded("P-012", vendor=F.col("vendor")))


def _key(name: str) -> str:
    """``vendor_key`` of a name on the list."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in name.lower()).split())


Rule = Callable[[Config], tuple[Column, Column]]
RULES: dict[str, Rule] = {"P-013": low_confidence, "P-001": unsubstantiated, "P-003": missing_vendor, "P-004": missing_date, "P-005": stale, "P-006": future, "P-007": arithmetic, "P-008": unsigned, "P-009": over_limit, "P-010": round_amount, "P-012": unapproved}


def with_findings(docs: DataFrame, config: Config, name: str = "findings", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``docs`` with all findings of the row-local controls as ``name``; a rejected file has its rejection alone."""
    rejected, rejection = intake_rejected(config)
    found = F.array_compact(F.array(*[F.when(F.coalesce(fires, F.lit(False)), narrowed(f, parts)) for fires, f in (r(config) for r in RULES.values())]))
    return prepared(docs, config).withColumn(name, F.when(rejected, F.array(narrowed(rejection, parts))).otherwise(found)).select(*docs.columns, name)
