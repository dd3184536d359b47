"""Known anomalies planted among documents, to see what the controls catch.

Each kind takes one document of ``every`` and derives its change from the document's id, so that the same input gives the
same plants on any cluster.  Documents without supplier, date or amount are never taken.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DOCUMENT, MONEY, columns

#: What the controls are made to catch, and what they are not.
DESIGNED = ("exact_duplicate", "duplicate_shifted_date", "duplicate_vendor_variant", "split_below_limit", "future_dated", "round_fabricated", "altered_receipt_total")
UNDESIGNED = ("inflated_single_line", "partial_rebill", "ghost_vendor")
KINDS = DESIGNED + UNDESIGNED
#: Names that no supplier list has.
GHOST_FIRST = ("Apex", "Northgate", "Meridian", "Crescent", "Halcyon", "Brightwater")
GHOST_LAST = ("Consulting", "Services", "Solutions", "Advisory")
#: Each kind has its own range of ids from here on; parts of a split are a third of a range apart.
FIRST_ID, RANGE = 10**12, 3 * 10**11


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def share(low: str, high: str, k: Column, salt: int) -> Column:
    """A factor between ``low`` and ``high`` in a thousand steps, by id."""
    lo, hi = (F.lit(x).cast("decimal(6,4)") for x in (low, high))
    step = F.pmod(k * 137 + salt, F.lit(1000)).cast("decimal(4,0)") * F.lit("0.001").cast("decimal(4,3)")
    return (lo + (hi - lo) * step).cast("decimal(9,6)")


def scaled(by: Column, places: int = 2) -> Column:
    return F.round((F.col("total") * by).cast("decimal(28,8)"), places).cast(MONEY)


def vendor_variant(vendor: Column, k: Column) -> Column:
    """Another spelling: the legal form written out or cut, two letters swapped, or marks changed; by id."""
    at = (F.pmod(k, F.greatest(F.length(vendor) - 3, F.lit(1))) + 2).cast("int")
    swapped = F.concat(F.substring(vendor, F.lit(1), at - 1), F.substring(vendor, at + 1, F.lit(1)), F.substring(vendor, at, F.lit(1)), F.substring(vendor, at + 2, F.length(vendor)))
    marked = F.concat(F.regexp_replace(F.regexp_replace(vendor, "^([^ ]*) ", "$1  "), "[,.]", ""), F.lit("."))
    form = F.when(vendor.contains("Limited"), F.replace(vendor, F.lit("Limited"), F.lit("Ltd"))).when(vendor.contains("Ltd"), F.replace(vendor, F.lit("Ltd"), F.lit("Limited")))
    choices = F.array_compact(F.array(form, F.when(F.length(vendor) > 6, swapped), F.when(F.length(vendor) > 6, marked)))
    return F.when(F.size(choices) > 0, F.get(choices, F.pmod(k, F.greatest(F.size(choices), F.lit(1))).cast("int"))).otherwise(F.concat(vendor, F.lit(" Ltd")))


def fabricated(**new: Column) -> dict[str, Column]:
    """A document of its own: supplier, date, amount and currency, nothing else of the one it borrows from."""
    none = {c: F.lit(None).cast(columns(DOCUMENT)[c]) for c in ("subtotal", "tax", "line_items", "signature_present", "invoice_number")}
    return none | {"confidence": F.lit(1.0)} | new


def _changes(kind: str, k: Column, today: Column, limit: Column) -> dict[str, Column]:
    if kind == "exact_duplicate":
        return {}
    if kind == "duplicate_shifted_date":
        return {"date": F.date_add("date", (1 + k % 5).cast("int"))}
    if kind == "duplicate_vendor_variant":
        return {"vendor": vendor_variant(F.col("vendor"), k), "total": (F.col("total") + scaled(share("0", "0.003", k, 1))).cast(MONEY)}
    if kind == "split_below_limit":
        amount = F.round(limit * share("0.905", "0.995", k + F.col("_part") * 7, 2), 2).cast(MONEY)
        return fabricated(total=amount, date=F.date_add("date", (F.col("_part") * (k % 4)).cast("int")))
    if kind == "future_dated":
        return {"date": F.date_add(today, (5 + k % 56).cast("int"))}
    if kind == "round_fabricated":
        return fabricated(total=(pick((30, 35, 40, 45, 48, 50, 60, 75, 80, 90), k) * 1000).cast(MONEY))
    if kind == "altered_receipt_total":
        return {"total": scaled(share("1.01", "1.15", k, 3), 0)}
    if kind == "inflated_single_line":
        return {"total": scaled(share("1.03", "1.12", k, 4))}
    if kind == "partial_rebill":
        return {"total": scaled(share("0.4", "0.6", k, 5)), "date": F.least(F.date_add("date", (3 + k % 38).cast("int")), today)}
    if kind == "ghost_vendor":
        name = F.concat(pick(GHOST_FIRST, k), F.lit(" "), pick(GHOST_LAST, k + 1), F.lit(" "), (10 + k % 90).cast("string"), F.lit(" Ltd"))
        return fabricated(vendor=name, total=scaled(share("0.8", "1.2", k, 6)))
    raise ValueError(f"unknown kind {kind}")


def inject(docs: DataFrame, kinds: Sequence[str], today: dt.date, limit: str = "10000", every: int = 20) -> DataFrame:
    """Documents of the given kinds of anomaly in one pass, with ``kind``, ``orig_id`` (null for fabricated ones) and
    ``replaces``.

    For each kind one document of ``every`` is changed.  ``altered_receipt_total`` takes documents with subtotal and tax, and
    only those that the column ``clean`` allows, where ``docs`` has one.  An ``inflated_single_line`` stands for its original
    instead of joining it.
    """
    known = F.col("vendor").isNotNull() & F.col("date").isNotNull() & (F.col("total") != 0)
    whole = F.col("subtotal").isNotNull() & (F.col("tax") != 0) & (F.col("clean") if "clean" in docs.columns else F.lit(True))
    turn = lambda k: F.pmod(F.col("id") + KINDS.index(k), F.lit(every)) == 0
    own = F.array_compact(F.array(*[F.when(turn(k) & (whole if k == "altered_receipt_total" else F.lit(True)), F.lit(k)) for k in kinds]))
    taken = docs.where(known).withColumn("_k", F.pmod(F.col("id"), F.lit(RANGE // 3))).withColumn("kind", F.explode(own))
    parts = F.when(F.col("kind") != "split_below_limit", 1).when(F.col("_k") % 2 == 0, 2).otherwise(3)
    taken = taken.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    new = FIRST_ID + (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1) * RANGE + F.col("_part") * (RANGE // 3) + F.col("_k")
    made = F.col("kind").isin("split_below_limit", "round_fabricated", "ghost_vendor", "inflated_single_line")
    tags = {"orig_id": F.when(~made, F.col("id")), "replaces": F.when(F.col("kind") == "inflated_single_line", F.col("id"))}
    source = F.struct(F.concat(F.lit("seeded:"), "kind").alias("file"), (new - FIRST_ID).alias("row"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("url"))
    values = {c: F.col(c) for c in columns(DOCUMENT)} | {"source": source, "input_idx": new, "id": new}
    for k in kinds:
        for c, v in _changes(k, F.col("_k"), F.lit(today), F.lit(limit).cast(MONEY)).items():
            values[c] = F.when(F.col("kind") == k, v).otherwise(values[c])
    return taken.select(*[values[c].cast(t).alias(c) for c, t in columns(DOCUMENT).items()], "kind", *[v.cast("bigint").alias(c) for c, v in tags.items()])


def planted(docs: DataFrame, injected: DataFrame) -> DataFrame:
    """The documents without those that are replaced, and the injected ones."""
    gone = injected.where("replaces is not null").select(F.col("replaces").alias("id"))
    return docs.join(gone, "id", "left_anti").select(docs.columns).unionByName(injected.select(*docs.columns))


def untouched(results: DataFrame, adjusted: DataFrame, rule: str = "P-007") -> DataFrame:
    """(id) of documents that neither raise ``rule`` nor are in ``adjusted`` (id): those whose totals may be altered."""
    return results.where(~F.array_contains("findings.rule_id", rule)).select("id").join(adjusted, "id", "left_anti")
