"""Labelled and published datasets brought to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import lenient_date
from ..functions.money import lenient_money, receipt_money
from ..functions.text import vendor_key
from ..schema import MONEY
from .json_blocks import before

#: Which control each labelled kind of fraud is the job of; kinds without one are a gap in coverage.
FRAUD_RULES = {"none": (), "altered_total": ("P-007",), "round_number_amount": ("P-010",), "duplicate_invoice": ("P-002",), "split_invoice": ("P-011",), "ghost_vendor": ("P-012",)}
SYNTHETIC_FROM = 900_000


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a labelled invoice list, with the controls each should raise."""
    raw = spark.read.option("header", True).csv(path)
    kinds = F.create_map(*[x for k, v in FRAUD_RULES.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]).cast("array<string>"))])
    expected = F.coalesce(F.try_element_at(kinds, F.col("fraud_type")), F.array().cast("array<string>"))
    money = lambda c: F.col(c).try_cast(MONEY)
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    return raw.select("invoice_id", F.nullif(F.trim("vendor_name"), F.lit("")).alias("vendor"), day("invoice_date").alias("date"), F.coalesce(day("submitted_date"), day("invoice_date")).alias("today"), F.upper("currency").alias("currency"), money("subtotal").alias("subtotal"), money("tax_amount").alias("tax"), money("total_amount").alias("total"), F.col("ocr_confidence").try_cast("double").alias("confidence"), F.coalesce("fraud_type", F.lit("none")).alias("fraud_type"), expected.alias("expected"))


def approved_vendors(rows: DataFrame) -> DataFrame:
    """Suppliers with at least one row that is not a ghost: what ghosts alone use is taken away."""
    return rows.where("fraud_type <> 'ghost_vendor' and vendor is not null").select("vendor").distinct()


def counterparts(rows: DataFrame) -> DataFrame:
    """Priors that duplicates and splits imply where the list has only one side: ids from 900 000 on, values by row number."""
    numbered = rows.where("fraud_type in ('duplicate_invoice', 'split_invoice')").withColumn("n", F.regexp_extract("invoice_id", "([0-9]+)$", 1).cast("long"))
    part = F.lit(45000).cast(MONEY) + (F.lit(5000) * (F.pmod(F.col("n") * 137, F.lit(1000)) / 1000)).cast(MONEY)
    total = F.when(F.col("fraud_type") == "split_invoice", part).otherwise(F.col("total"))
    return numbered.select((SYNTHETIC_FROM + F.col("n")).alias("document_id"), "vendor", total.cast(MONEY).alias("total"), "date", F.lit(None).cast("string").alias("invoice_number"))


def labelled_ledger(rows: DataFrame) -> DataFrame:
    """The ledger that a labelled list is audited against: its own rows by their number, and the counterparts that its labels imply.

    Rows without a supplier or a date are no priors, and labels of rows without an amount imply none."""
    own = rows.select(F.regexp_extract("invoice_id", "([0-9]+)$", 1).cast("long").alias("document_id"), "vendor", "total", "date", F.lit(None).cast("string").alias("invoice_number"))
    return own.unionByName(counterparts(rows.where("total is not null"))).where("vendor is not null and date is not null")


def case_history(cases: DataFrame, ledger: DataFrame, lookback_days: int = 180) -> DataFrame:
    """(case_id, prior) of cases (case_id, document_id, vendor, today): the ledger's rows of the same supplier, since the lookback,
    without the case's own document."""
    c = cases.select("case_id", F.col("document_id").alias("_own"), vendor_key(F.col("vendor")).alias("_k"), F.date_sub("today", lookback_days).alias("_since"), F.col("vendor").alias("_v")).where("_v <> ''").drop("_v")
    p = ledger.select(vendor_key(F.col("vendor")).alias("_k"), F.col("date").alias("_d"), F.struct(*ledger.columns).alias("prior"))
    return c.join(p, "_k").where((F.col("_d") >= F.col("_since")) & ~F.col("prior.document_id").eqNullSafe(F.col("_own"))).select("case_id", "prior")


def case_totals(cases: DataFrame, ledger: DataFrame, lookback_days: int = 180) -> DataFrame:
    """(case_id, priors, amount, implied) of the cases that ``case_history`` gives priors: how many, their sum, and how many of them
    labels imply.  A supplier's ledger is added up by date, so cases meet sums and no priors but their own document."""
    c = cases.where("vendor <> ''").select("case_id", F.col("document_id").alias("_own"), vendor_key(F.col("vendor")).alias("_k"), F.date_sub("today", lookback_days).alias("_d")).where(F.col("_d").isNotNull())
    p = ledger.where("date is not null").select(vendor_key(F.col("vendor")).alias("_k"), F.col("date").alias("_d"), "document_id", "total").where(F.col("_k").isNotNull())
    wide = "decimal(38,4)"
    sums = lambda: (F.count("*").alias("n"), F.sum(F.col("total").cast(wide)).cast(wide).alias("s"), F.count_if(F.col("document_id") > SYNTHETIC_FROM).alias("i"))
    days = p.groupBy("_k", "_d").agg(*sums()).unionByName(c.select("_k", "_d").distinct().withColumns({"n": F.lit(0).cast("long"), "s": F.lit(None).cast(wide), "i": F.lit(0).cast("long")}))
    since = W.partitionBy("_k").orderBy(F.desc("_d")).rangeBetween(W.unboundedPreceding, W.currentRow)
    later = days.select("_k", "_d", *[F.sum(x).over(since).alias(x) for x in ("n", "s", "i")]).distinct()
    own = p.withColumnRenamed("_d", "_at").withColumn("_id", F.col("document_id"))
    mine = c.join(own, (c["_k"] == own["_k"]) & c["_own"].eqNullSafe(own["_id"]) & (own["_at"] >= c["_d"])).select("case_id", c["_own"], c["_k"], c["_d"], "document_id", "total").groupBy("case_id", "_own", "_k", "_d").agg(*sums())
    less = mine.select("case_id", F.col("_own").alias("_o"), F.col("_k").alias("_mk"), F.col("_d").alias("_md"), F.col("n").alias("mn"), F.col("s").alias("ms"), F.col("i").alias("mi"))
    all_of = c.groupBy("case_id", "_own", "_k", "_d").agg(F.count("*").alias("times")).join(later, ["_k", "_d"])
    less = less.withColumnRenamed("case_id", "_c")
    at = F.col("case_id").eqNullSafe(F.col("_c")) & F.col("_own").eqNullSafe(F.col("_o")) & (F.col("_k") == F.col("_mk")) & (F.col("_d") == F.col("_md"))
    none = lambda x: F.coalesce(x, F.lit(0))
    left = all_of.join(less, at, "left").select("case_id", (F.col("n") * F.col("times") - none("mn")).alias("n"), (none("s") * F.col("times") - none("ms")).alias("s"), (F.col("i") * F.col("times") - none("mi")).alias("i"))
    return left.groupBy("case_id").agg(F.sum("n").alias("priors"), F.sum("s").cast("decimal(28,4)").alias("amount"), F.sum("i").alias("implied")).where("priors > 0")


def scored_rules(rows: DataFrame) -> list[str]:
    """The controls that some label of the list expects, sorted: the ones that it can score.  At most as many as there are controls."""
    return sorted(r["r"] for r in rows.select(F.explode("expected").alias("r")).distinct().collect())


def group_spending(rows: DataFrame, key: str, amount: str, supplier: str, date: str) -> DataFrame:
    """One document per transaction of a spending list: amounts of its rows added, supplier and date of its first row.

    ``rows`` has ``input_idx``; the first row is the one with the least.
    """
    first = lambda c: F.min_by(F.trim(F.col(c)), F.col("input_idx"))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first(supplier).alias("vendor"), lenient_date(first(date)).alias("date"), F.sum(lenient_money(F.col(amount))).cast(MONEY).alias("total")).withColumnRenamed(key, "transaction")


def headed(rows: DataFrame, names: tuple[str, ...], word: str = "supplier", within: int = 10) -> DataFrame:
    """The rows under each sheet's header, with a column for each of ``names``, null where the sheet lacks it.

    ``rows`` are (sheet, row, cells) without a marked header: it is the first of the first ``within`` rows in which a cell
    holds ``word``, in any case.  Of equal headers the last counts.  Sheets without a header have no rows.
    """
    said = F.lower(F.array_join("cells", " "))
    heads = rows.where((F.col("row") <= within) & F.contains(said, F.lit(word))).groupBy("sheet").agg(F.min(F.struct("row", "cells")).alias("h"))
    keys = F.reverse(F.transform("h.cells", lambda c: F.lower(F.trim(c))))
    place = {n: F.array_position(keys, n) for n in names}
    at = {n: F.when(p > 0, (F.size("h.cells") - p + 1).cast("int")) for n, p in place.items()}
    return rows.join(heads, "sheet").where(F.col("row") > F.col("h.row")).select("sheet", "row", *[F.try_element_at("cells", v).alias(n) for n, v in at.items()])


def spending(rows: DataFrame) -> DataFrame:
    """(id, vendor, date, total, currency, sheet, row) of spending sheets (sheet, row, cells), by date and id.

    Amounts of a transaction are added up over all sheets; rows without an amount or a supplier do not count.  Supplier, date
    and place are those of its first row.  A transaction that has no number is its row alone, and its id is ten million and the
    number of transactions that began before it.
    """
    d = headed(rows, ("supplier", "amount", "date", "transaction number")).withColumn("total", lenient_money(F.col("amount")))
    d = d.where(F.col("total").isNotNull() & (F.trim("supplier") != ""))
    number = F.substring_index(F.trim("transaction number"), ".", 1)
    known = F.coalesce(number.rlike("^[0-9]+$"), F.lit(False))
    d = d.withColumn("key", F.when(known, number).otherwise(F.concat_ws(":", "sheet", F.col("row").cast("string"))))
    first = F.min(F.struct("sheet", "row", F.trim("supplier").alias("vendor"), F.substring(F.coalesce("date", F.lit("")), 1, 10).alias("date"))).alias("first")
    docs = d.groupBy("key").agg(first, F.bool_or(known).alias("known"), F.sum("total").cast(MONEY).alias("total"))
    docs = docs.select("key", "known", "first.*", "total", F.col("first.sheet").alias("f"), F.floor(F.col("first.row") / 100_000).alias("b"), F.col("first.row").alias("m"))
    made = F.when(F.col("known"), F.col("key").try_cast("bigint")).otherwise(F.col("n") + 10_000_000)
    return before(docs, F.lit(1), "n").select(made.alias("id"), "vendor", "date", "total", F.lit("GBP").alias("currency"), "sheet", "row").orderBy("date", "id")


def flatten_awards(pages: DataFrame) -> DataFrame:
    """Awards of paged API answers (page, results): null and zero amounts go."""
    r = pages.select("page", F.posexplode("results").alias("at", "r"))
    amount = F.col("r.amount").cast("string").try_cast(MONEY)
    return r.select("page", "at", F.col("r.recipient").alias("vendor"), F.try_to_date(F.col("r.date"), "yyyy-MM-dd").alias("date"), amount.alias("total")).where("total is not null and total <> 0")


def first_or_self(json: Column, path: str) -> Column:
    """A value of a JSON object, or the first where it is a list."""
    v = F.get_json_object(json, path)
    return F.coalesce(F.when(v.startswith("["), F.get_json_object(json, path + "[0]")), F.when(~v.startswith("["), v))


def receipts(rows: DataFrame) -> DataFrame:
    """Documents of labelled receipts (id, json): a menu of one is a list of one; tax includes service; ``adjusted`` where a
    discount or the like changes the sum."""
    j = F.col("json")
    menu = F.get_json_object(j, "$.menu")
    items = F.from_json(F.when(menu.startswith("["), menu).otherwise(F.concat(F.lit("["), menu, F.lit("]"))), "array<struct<nm: string, cnt: string, unitprice: string, price: string>>")
    lines = F.transform(F.filter(items, lambda x: x["price"].isNotNull()), lambda x: F.struct(F.coalesce(x["nm"], F.lit("Item")).alias("name"), F.lit(None).cast(MONEY).alias("quantity"), F.lit(None).cast(MONEY).alias("unit_price"), receipt_money(x["price"]).alias("amount")))
    tax, service = receipt_money(first_or_self(j, "$.sub_total.tax_price")), receipt_money(first_or_self(j, "$.sub_total.service_price"))
    both = F.when(tax.isNotNull() | service.isNotNull(), F.coalesce(tax, F.lit(0)) + F.coalesce(service, F.lit(0)))
    adjusted = F.greatest(*[F.get_json_object(j, f"$.sub_total.{k}").isNotNull().cast("int") for k in ("discount_price", "othersvc_price", "etc")]) > 0
    return rows.select("id", receipt_money(first_or_self(j, "$.total.total_price")).alias("total"), receipt_money(first_or_self(j, "$.sub_total.subtotal_price")).alias("subtotal"), both.cast(MONEY).alias("tax"), lines.alias("line_items"), adjusted.alias("adjusted"))


def key_values(rows: DataFrame) -> DataFrame:
    """Fields of labelled key-value pairs (id, json), by any of their usual names."""
    pick = lambda *names: F.coalesce(*[F.get_json_object("json", f"$.{n}") for n in names])
    return rows.select("id", pick("company", "vendor", "supplier").alias("vendor"), pick("date", "invoice_date").alias("date"), receipt_money(pick("total", "amount", "total_amount")).alias("total"), vendor_key(pick("company", "vendor", "supplier")).alias("vendor_key"))
