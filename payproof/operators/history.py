"""Controls that compare a document with the other documents and a ledger.

Every function takes ``docs`` and ``priors`` from ``keyed`` and gives rows (id, finding) for the documents on which it fires.
The history of a document is never built: each control joins on what must be equal, and what the history admits is a
condition on top (see ``admitted``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.similarity import jaro_winkler, may_match, signature
from .rows import cat, evidence, finding, money, say, worded
from .runs import counted, runs_of

LEDGER_FROM = 1 << 50
#: Priors from here on are no documents of the batch.
ELSEWHERE = 1 << 40


def with_keys(rows: DataFrame, *more: str | Column) -> DataFrame:
    """What the controls read of a document: id, place, amount, date, supplier key, parts of the invoice number."""
    key = F.col("_number")
    rows = rows.withColumns({"_name": T.vendor_key(F.col("vendor")), "_number": T.invoice_key(F.col("invoice_number"))})
    return rows.select("id", "input_idx", "total", "date", F.col("_name").alias("key"), key.alias("ikey"), T.invoice_prefix(key).alias("prefix"), T.invoice_serial(key).alias("serial"), *more)


def keyed(documents: DataFrame, ledger: DataFrame | None, config: Config, today) -> tuple[DataFrame, DataFrame]:
    """Documents with their keys and anchor date, and all priors: the documents, then the ledger, in order.

    Five controls read these narrow rows several times each, so they are kept (``docs.unpersist()`` lets them go); lost parts are
    computed again.
    """
    docs = with_keys(documents, F.col("vendor").isNotNull().alias("named"), F.coalesce("today", "date", F.lit(today).cast("date")).alias("anchor")).persist()
    priors = docs.drop("named", "anchor")
    if ledger is not None:
        rows = ledger.withColumnRenamed("document_id", "id").withColumn("input_idx", F.lit(LEDGER_FROM) + F.col("id"))
        priors = priors.unionByName(with_keys(rows))
    return docs, priors


def as_prior(priors: DataFrame) -> DataFrame:
    return priors.select(*[F.col(c).alias(f"p_{c}") for c in priors.columns])


def tolerance(total: Column, config: Config) -> Column:
    """How far an amount may be off to be admitted by amount."""
    wide = (config.near_dup_amount_ratio * Decimal("1.1")).quantize(Decimal("0.000001"))
    return F.abs(total) * F.lit(wide).cast("decimal(12,6)") + F.lit(Decimal("0.01"))


Prior = Callable[[str], Column]


def joined_prior(c: str) -> Column:
    """A prior's column in a row of ``as_prior``."""
    return F.col(f"p_{c}")


def member(m: Column) -> Prior:
    """A prior as an element of a list."""
    return lambda c: m[c]


def by_supplier(config: Config, p: Prior = joined_prior) -> Column:
    """Admitted by supplier: dated no earlier than the lookback before the anchor."""
    return F.coalesce(p("date") >= F.date_sub("anchor", config.lookback_days), F.lit(False))


def by_amount(config: Config, p: Prior = joined_prior) -> Column:
    return F.coalesce(F.abs(p("total") - F.col("total")) <= tolerance(F.col("total"), config), F.lit(False))


def admitted(config: Config, p: Prior = joined_prior) -> Column:
    return by_supplier(config, p) | by_amount(config, p)


def other(p: Prior = joined_prior) -> Column:
    return (p("input_idx") != F.col("input_idx")) & (p("id") != F.col("id"))


def in_order(late: Column, p: Prior, *more: Column) -> Column:
    """A struct that sorts priors in history order: by supplier in input order, then by amount."""
    return F.struct(late.alias("late"), F.when(late, p("total")).alias("amount"), p("input_idx").alias("idx"), p("id").alias("id"), *more)


def members(config: Config, found: Column) -> Column:
    """Of a list of one supplier's priors (id, input_idx, total, date) those that a document's history admits, in its order."""
    mine = F.filter(found, lambda m: other(member(m)) & admitted(config, member(m)))
    return F.array_sort(F.transform(mine, lambda m: in_order(~by_supplier(config, member(m)), member(m), m["total"].alias("total"))))


def listed() -> Column:
    return F.struct("id", "input_idx", "total", "date")


def ids(found: Column) -> Column:
    return F.transform(found, lambda x: x["id"])


def id_text(found: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(ids(found).cast("array<string>"), ","), F.lit("]"))


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join with a group's row per key: their hash as one more key gives the groups an exchange of their own, so
    that Spark may split a key that many rows of ``left`` share."""
    tagged = lambda d: d.withColumn("_tag", F.xxhash64(*on))
    return tagged(left).join(tagged(right), [*on, "_tag"]).drop("_tag")


def duplicates(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """P-002: same supplier, amount and date as another document; the first such is named.

    Per group only its first document and the first with another id matter.  Ranks are cut to two before rows meet, so
    a group of any size sends two rows from each task.
    """
    same = ["key", "total", "date"]
    held = priors.where("key <> '' and total is not null and date is not null").groupBy(*same, "id").agg(F.min("input_idx").alias("idx"))
    place = F.row_number().over(W.partitionBy(*same).orderBy("idx", "id"))
    two = held.withColumn("place", place).where("place <= 2")
    pair = two.groupBy(*same).agg(F.min_by("id", "place").alias("one"), F.max_by("id", "place").alias("two"), F.count("*").alias("n")).where("n = 2").drop("n")
    hit = meet(docs.where("key <> ''"), pair, same).withColumn("match", F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.col("two")))
    said = cat("same supplier, amount ", say(F.col("total")), " and date ", F.col("date").cast("string"), " as #", F.col("match").cast("string"))
    return hit.select("id", finding("P-002", said, evidence(matched_document_id=F.col("match"), total=say(F.col("total")), date=F.col("date")), F.array("match"), message=worded("P-002", match=F.col("match"), total=say(F.col("total")), date=F.col("date"))).alias("finding"))


def blocks(day: Column, reach: int, size: int) -> Column:
    """The blocks of ``size`` days within ``reach`` days of a day: one or two where size is over twice the reach."""
    return F.sequence(F.floor((day - reach) / size), F.floor((day + reach) / size))


def near_limit_frame(docs: DataFrame, config: Config) -> DataFrame:
    """(id, docs, amount): documents and amounts of a supplier near the limit around each document, by a frame of days, without a
    join.  Where every date is within the lookback this is what P-011 compares."""
    limit = money(config.approval_limit)
    near = docs.where((F.col("key") != "") & F.col("date").isNotNull() & F.col("total").between(F.lit(config.approval_limit * config.split_proximity).cast("decimal(18,6)"), limit)).withColumn("day", F.unix_date("date"))
    frame = W.partitionBy("key").orderBy("day").rangeBetween(-config.split_window_days, config.split_window_days)
    return near.select("id", F.count("*").over(frame).alias("docs"), F.sum("total").over(frame).alias("amount"))


def splitting(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """P-011: documents of one supplier just below the limit within the window.

    A frame of days collects each document's siblings, without a join.  Frames run inside blocks of days, so that one supplier's
    documents spread over time; a prior stands in each block that its window reaches.
    """
    window, limit = config.split_window_days, money(config.approval_limit)
    floor = F.lit(config.approval_limit * config.split_proximity).cast("decimal(18,6)")
    day = F.unix_date("date")
    size = 4 * window + 2
    band = lambda d: d.where((F.col("total") >= floor) & (F.col("total") <= limit) & (F.col("key") != "") & F.col("date").isNotNull())
    kept = ["id", "input_idx", "key", "total", "date"]
    own = band(docs).select(*kept, "anchor", F.floor(day / size).alias("block"), F.lit(None).cast("struct<id: bigint, input_idx: bigint, total: decimal(18,4), date: date>").alias("prior"))
    past = band(priors).select(*kept, F.lit(None).cast("date").alias("anchor"), F.explode(blocks(day, window, size)).alias("block"), listed().alias("prior"))
    frame = W.partitionBy("key", "block").orderBy(day).rangeBetween(-window, window)
    near = own.unionByName(past).withColumn("near", F.collect_list("prior").over(frame)).where("prior is null")
    hit = near.withColumn("found", members(config, F.col("near"))).where(F.size("found") > 0)
    rest = F.aggregate("found", F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x["total"]).cast("decimal(28,4)"))
    combined, n = (F.col("total") + rest), (F.size("found") + 1).cast("string")
    said = cat(n, f" docs within {window} days just under limit ", say(limit), ", combined ", say(combined))
    return hit.select("id", finding("P-011", said, evidence(combined_total=say(combined), limit=say(limit), related_document_ids=id_text(F.col("found")), window_days=F.lit(window)), ids(F.col("found")), message=worded("P-011", n=n, window=str(window), limit=say(limit), combined=say(combined))).alias("finding"))


def amount_cells(total: Column, ratio: Decimal, reach: bool) -> Column:
    """Cells (kind, cell) of a grid of amounts: that of an amount, or with ``reach`` all that amounts within tolerance of it lie
    in, mostly one or two.

    Amounts of 0.01 / ratio and more lie on a logarithmic grid by sign, smaller ones on a grid of 0.02; those near the border
    lie on both.  At ratios of a half and more all amounts are one cell.
    """
    if ratio >= Decimal("0.5"):
        return F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("cell")))
    border, width, off = float(Decimal("0.01") / ratio) if ratio else float("inf"), max(4 * float(ratio), 0.01), 1.1 * float(ratio)
    size, value, slack = F.abs(total).cast("double"), total.cast("double"), 1e-9
    sign = F.when(total < 0, -1).otherwise(1)
    log = F.log(F.greatest(size, F.lit(1e-9))) / math.log1p(width)
    less, more = (-math.log1p(-off) / math.log1p(width) + slack, 0.011 / 0.02 + slack) if reach else (0.0, 0.0)
    cells = lambda kind, at, by: F.transform(F.sequence(F.floor(at - by), F.floor(at + by)), lambda c: F.struct(kind.alias("kind"), c.alias("cell")))
    none = F.array().cast("array<struct<kind: int, cell: bigint>>")
    return F.concat(F.when(size >= 0.95 * border, cells(sign, log, less)).otherwise(none), F.when(size < 1.1 * border, cells(F.lit(0), value / 0.02, more)).otherwise(none))


#: Rows of a cell that one task compares with so many others; fuller cells are cut into slots.
CELL_ROWS = 4000


def near_pairs(docs: DataFrame, priors: DataFrame, config: Config, cell_rows: int = CELL_ROWS, names: DataFrame | None = None) -> DataFrame:
    """Pairs close in amount and date with unlike or differing details whose names may be alike.

    Priors lie in one cell of amounts and one block of days, documents in all that their tolerance and window reach, so a
    pair meets once per kind of cell; where both amounts lie on both grids, only the logarithmic one counts.  Cells of more than
    ``cell_rows`` priors are cut into slots and each pair of slots is a join key of its own.  The table of those cells is
    broadcast: the grid of amounts and the calendar bound it (about 3,200 cells of amounts for every 24 days), not the documents.
    Inside the join only whole numbers are compared.  Most unlike names are told apart by signatures there; with ``names`` from
    ``alike_names``, pairs are looked up in that table instead and carry their similarity.
    """
    days, ratio = config.near_dup_window_days, config.near_dup_amount_ratio
    size, least = 3 * (days + 1), config.near_dup_vendor_similarity
    low, high = reached(F.col("total"), ratio)
    sig = ["sig"] if names is None else []
    usable = lambda d: d.where("key <> '' and total is not null and date is not null").withColumns({"grids": F.size(amount_cells(F.col("total"), ratio, False)), "cents": (F.col("total") * 10_000).cast("long"), "low": low, "high": high, "at": F.unix_date("date")} | {c: signature(F.col("key")) for c in sig})
    placed = lambda d, reach: d.select("*", F.explode(amount_cells(F.col("total"), ratio, reach)).alias("c")).select("*", "c.kind", "c.cell", F.explode(blocks(F.unix_date("date"), days if reach else 0, size)).alias("day")).drop("c")
    cell = ["kind", "cell", "day"]
    kept = ["id", "input_idx", "key", "total", "date", *sig, "grids", "cents", "low", "high", "at", *cell]
    right, left = placed(usable(priors), False).select(*kept), placed(usable(docs).where("total <> 0"), True).select(*kept, "anchor")
    crowded = right.groupBy(*cell).agg(F.ceil(F.count("*") / cell_rows).alias("slots")).where("slots > 1")
    if names is not None:
        number = F.broadcast(names.where("key = p_key").select("key", F.col("a").alias("name")))
        left, right = left.join(number, "key"), right.join(number, "key")

    def dealt(d: DataFrame, own: str, rest: str) -> DataFrame:
        slots = F.coalesce("slots", F.lit(1))
        return d.join(F.broadcast(crowded), cell, "left").withColumns({own: F.pmod(F.xxhash64("id", "input_idx"), slots), rest: F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))}).drop("slots")

    left, right = dealt(left, "mine", "theirs"), as_prior(dealt(right, "theirs", "mine"))
    keys = [*cell, "mine", "theirs"]
    same = reduce(and_, [F.col(k) == F.col(f"p_{k}") for k in keys])
    twice = (F.col("kind") == 0) & (F.col("grids") == 2) & (F.col("p_grids") == 2)
    near = F.col("p_cents").between(F.col("low"), F.col("high")) | F.col("cents").between(F.col("p_low"), F.col("p_high"))
    close = (F.abs(F.col("p_at") - F.col("at")) <= days) & near & ~((F.col("p_cents") == F.col("cents")) & (F.col("p_at") == F.col("at")) & (F.col("p_key") == F.col("key"))) & other() & ~twice
    if ratio > Decimal(1) / 11:
        close = close & admitted(config)
    out = ["id", "input_idx", "key", "total", "date", "anchor", "p_id", "p_input_idx", "p_key", "p_total", "p_date"]
    if names is None:
        alike = may_match(F.col("key"), F.col("sig"), F.col("p_key"), F.col("p_sig"), least)
        return left.join(right, same).where(close & ((F.col("key") == F.col("p_key")) | alike)).select(*out)
    known = F.broadcast(names.select(name_pair(F.col("a"), F.col("b")).alias("pair"), "sim"))
    return left.join(right, same).where(close).withColumn("pair", name_pair(F.col("name"), F.col("p_name"))).join(known, "pair").select(*out, "sim")


def reached(total: Column, ratio: Decimal) -> tuple[Column, Column]:
    """The least and greatest amount, in ten-thousandths, within the ratio of an amount, or within 0.01."""
    off = F.greatest(F.abs(total) * F.lit(ratio).cast("decimal(12,6)"), F.lit(Decimal("0.01")))
    return F.ceil((total - off) * 10_000).cast("long"), F.floor((total + off) * 10_000).cast("long")


#: Different names up to which all are compared with all beforehand, documents a name from which that pays, and pairs of alike
#: names that are broadcast at most.
NAMES, PER_NAME, NAME_PAIRS = 4096, 1000, 2_000_000


def name_pair(a: Column, b: Column) -> Column:
    return a.cast("long") * NAMES + b


def alike_names(docs: DataFrame, priors: DataFrame, config: Config, per_name: int = PER_NAME) -> DataFrame | None:
    """(a, b, key, p_key, sim) of all pairs of names that are alike enough, each with itself too, where few names stand for many
    documents; None where that does not hold, and pairs of documents are to be compared.  It is counted at once."""
    used = docs.select("key").unionByName(priors.select("key")).where("key <> ''").groupBy("key").count()
    held = used.agg(F.count("*").alias("names"), F.sum("count").alias("rows")).first()
    if not 0 < held["names"] <= min(NAMES, held["rows"] / 2 / per_name):
        return None
    left = used.select("key", F.row_number().over(W.orderBy("key")).alias("a"), signature(F.col("key")).alias("sig"))  # NAMES rows at most
    right = left.select(F.col("key").alias("p_key"), F.col("a").alias("b"), F.col("sig").alias("p_sig"))
    least = config.near_dup_vendor_similarity
    pairs = left.repartition(64).join(F.broadcast(right), F.col("a") < F.col("b")).where(may_match(F.col("key"), F.col("sig"), F.col("p_key"), F.col("p_sig"), least))
    found = pairs.select("a", "b", "key", "p_key", jaro_winkler("key", "p_key").alias("sim")).where(F.col("sim") >= least)
    itself = left.select("a", F.col("a").alias("b"), "key", F.col("key").alias("p_key"), F.lit(1.0).alias("sim"))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("p_key").alias("key"), F.col("key").alias("p_key"), "sim")).unionByName(itself).persist()
    if both.count() <= NAME_PAIRS:
        return both
    both.unpersist()
    return None


def close_pairs(pairs: DataFrame, config: Config) -> DataFrame:
    """Pairs within the window of days and the tolerance of amounts that are no exact duplicates."""
    ratio = config.near_dup_amount_ratio
    big = F.greatest(F.abs("total"), F.abs("p_total"))
    off = F.greatest(big * F.lit(ratio).cast("decimal(12,6)"), F.lit(Decimal("0.01")))
    exact = (F.col("p_key") == F.col("key")) & (F.col("p_total") == F.col("total")) & (F.col("p_date") == F.col("date"))
    close = other() & ~exact & (F.col("total") != 0) & (F.abs(F.date_diff("p_date", "date")) <= config.near_dup_window_days) & (F.abs(F.col("p_total") - F.col("total")) <= off)
    if ratio > Decimal(1) / 11:
        close = close & admitted(config)
    return pairs.where(close)


def near_hits(docs: DataFrame, priors: DataFrame, config: Config, per_name: int = PER_NAME) -> DataFrame:
    """The pairs whose names are alike enough, with the similarity.

    Where few names stand for many documents, names are compared with each other first.  Elsewhere pairs of the same two names lie
    next to each other, so names are compared once; Spark may split what many pairs share.
    """
    names = alike_names(docs, priors, config, per_name)
    if names is not None:
        return near_pairs(docs, priors, config, names=names)
    pairs = near_pairs(docs, priors, config).withColumns({"a": F.least("key", "p_key"), "b": F.greatest("key", "p_key")})
    named = pairs.hint("rebalance", "a", "b").sortWithinPartitions("a", "b").withColumn("sim", jaro_winkler("a", "b"))
    return named.where(F.col("sim") >= config.near_dup_vendor_similarity).drop("a", "b")


def near_duplicates(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """P-016: nearly the same supplier, amount and date; held if the same supplier bills the same amount again."""
    return near_findings(near_hits(docs, priors, config), config)


def near_findings(hits: DataFrame, config: Config) -> DataFrame:
    more = [F.col("sim"), F.col("p_total").alias("p_total"), F.col("p_date").alias("p_date")]
    late = ~(by_supplier(config) & (F.col("p_key") == F.col("key")))
    hit = hits.groupBy("id", "total", "date").agg(F.array_sort(F.collect_list(in_order(late, joined_prior, *more))).alias("found"))
    first = F.element_at("found", 1)
    again = F.exists("found", lambda x: (x["sim"] >= 1.0) & (x["p_total"] == F.col("total")))
    said = cat("near-duplicate of #", first["id"].cast("string"), " (amount ", say(first["p_total"]), " vs ", say(F.col("total")), ", ", first["p_date"].cast("string"), " vs ", F.col("date").cast("string"), ", name sim ", T.share_text(first["sim"]), ")")
    proof = evidence(matched_document_ids=id_text(F.col("found")), amount_tolerance_ratio=F.lit(str(config.near_dup_amount_ratio)), window_days=F.lit(config.near_dup_window_days), best_similarity=F.round(first["sim"], 2))
    others = F.when(F.size("found") > 1, worded("P-016 more", others=F.size("found") - 1)).otherwise("")
    told = worded("P-016", first=first["id"], more=others, amount=say(first["p_total"]), total=say(F.col("total")), then=first["p_date"], date=F.col("date"), similarity=T.share_text(first["sim"]))
    return hit.select("id", finding("P-016", said, proof, ids(F.col("found")), F.when(again, "high").otherwise("medium"), message=told).alias("finding"))


def reused_numbers(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """P-017: the supplier's invoice number is on another document.  The documents of a number are listed once, and each
    document picks from that list; no pairs are made."""
    usable = lambda d: d.where("key <> '' and ikey is not null")
    lists = usable(priors).groupBy("key", "ikey").agg(F.collect_list(listed()).alias("all")).where(F.size("all") > 1)
    hit = meet(usable(docs), lists, ["key", "ikey"]).withColumn("found", members(config, F.col("all"))).where(F.size("found") > 0)
    said = cat("invoice number reused on ", T.id_list(ids(F.col("found"))))
    return hit.select("id", finding("P-017", said, evidence(invoice_number_key=F.col("ikey"), matched_document_ids=id_text(F.col("found"))), ids(F.col("found")), message=worded("P-017", number=F.col("ikey"), ids=T.id_list(ids(F.col("found"))))).alias("finding"))


#: Serial numbers that one window sorts at most.
SERIAL_BLOCK = 4096
#: Documents by numbers of their run that one task looks up for a group.
RUN_PLACES = 4_000_000


def consecutive(priors: DataFrame, least: int) -> DataFrame:
    """(key, prefix, serial, run, n, start, end, oldest, mixed) of every number in a run of ``least`` or more.

    Runs are found inside blocks of serial numbers; only those that touch a block's border are put together over blocks, two rows a
    block at most.  ``oldest``: the least over the run of each number's latest date; mixed: with priors from elsewhere.
    """
    unknown = F.lit("0001-01-01").cast("date")
    numbers = priors.where("key <> '' and serial is not null").groupBy("key", "prefix", "serial").agg(F.coalesce(F.max("date"), unknown).alias("latest"), F.max("input_idx").alias("idx"), F.count("*").alias("rows"))
    numbers = numbers.withColumn("block", F.floor(F.col("serial") / SERIAL_BLOCK))
    within = W.partitionBy("key", "prefix", "block")
    numbers = numbers.withColumn("island", F.col("serial") - F.row_number().over(within.orderBy("serial")))
    islands = numbers.groupBy("key", "prefix", "block", "island").agg(F.min("serial").alias("first"), F.max("serial").alias("last"), F.count("*").alias("size"), F.sum("rows").alias("rows"), F.min("latest").alias("oldest"), F.max("idx").alias("idx"))
    edge = (F.pmod("first", F.lit(SERIAL_BLOCK)) == 0) | (F.pmod("last", F.lit(SERIAL_BLOCK)) == SERIAL_BLOCK - 1)
    order = W.partitionBy("key", "prefix").orderBy("first")
    over = islands.where(edge).withColumn("before", F.lag("last").over(order))
    over = over.withColumn("run", F.max(F.when(F.coalesce(F.col("before") + 1 < F.col("first"), F.lit(True)), F.col("first"))).over(order)).drop("before")
    whole = W.partitionBy("key", "prefix", "run")
    over = over.withColumns({"n": F.sum("size").over(whole), "members": F.sum("rows").over(whole), "start": F.min("first").over(whole), "end": F.max("last").over(whole), "old": F.min("oldest").over(whole), "late": F.max("idx").over(whole)})
    inner = islands.where(~edge).withColumns({"run": F.col("first"), "n": F.col("size"), "members": F.col("rows"), "start": F.col("first"), "end": F.col("last"), "old": F.col("oldest"), "late": F.col("idx")})
    runs = over.unionByName(inner).where(F.col("n") >= least).select("key", "prefix", "block", "island", "run", "n", "members", "start", "end", F.col("old").alias("oldest"), (F.col("late") >= ELSEWHERE).alias("mixed"))
    return numbers.select("key", "prefix", "serial", "block", "island").join(runs, ["key", "prefix", "block", "island"]).drop("block", "island")


def looked_up(d: DataFrame, config: Config | None = None) -> DataFrame:
    """Rows as ``runs.runs_of`` takes them: priors by day and amount or, with ``config``, documents by what their history admits.
    What is unknown lies outside of every range."""
    unscaled = lambda x: (x * 10_000).cast("long")
    total, never = F.col("total").cast("decimal(18,4)"), (1 << 31) - 1
    group = F.concat_ws("|", "key", "prefix", "run", "slot").alias("grp")
    own = [group, F.lit(config is not None).alias("doc"), "serial", "id", "input_idx"]
    if config is None:
        none = [F.lit(never).alias("since"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")]
        return d.select(*own, F.coalesce(F.unix_date("date"), F.lit(-never)).alias("day"), F.coalesce(unscaled(total), F.lit(-(1 << 63))).alias("cents"), *none)
    off = tolerance(total, config)
    low, high = F.coalesce(F.ceil((total - off) * 10_000).cast("long"), F.lit(1)), F.coalesce(F.floor((total + off) * 10_000).cast("long"), F.lit(0))
    return d.select(*own, F.lit(-never).alias("day"), F.lit(0).cast("long").alias("cents"), F.coalesce(F.unix_date(F.date_sub("anchor", config.lookback_days)), F.lit(never)).alias("since"), low.alias("low"), high.alias("high"))


def admitted_counts(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """(id, by_supplier, by_amount, admitted): how many of its supplier's priors each document's history admits, by date, by amount
    and by either, for documents whose supplier has another one.  Counts are looked up in sorted priors, no pairs are made."""
    whole = lambda d: d.where("key <> ''").withColumns({c: F.lit(0).cast("long") for c in ("serial", "run", "slot")} | {"prefix": F.lit("")})
    rows = looked_up(whole(docs), config).unionByName(looked_up(whole(priors)))
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(counted, "id long, by_supplier long, by_amount long, admitted long")


def sequential_lists(docs: DataFrame, priors: DataFrame, config: Config, only: Column | None = None, lists: bool = True) -> DataFrame:
    """(id, run_length, first, last, related): the run of consecutive numbers around each document's own number, by what its
    history admits.  A document looks up one prior per number of its run, by date and by amount, whatever the number of priors
    (see ``runs``).  A run's priors are sent once for each of the tasks that its documents need.  Without ``lists`` related is empty."""
    least = max(2, config.sequential_min_run)
    found = consecutive(priors, least)
    left = docs.where("key <> ''").join(found, ["key", "prefix", "serial"])
    left = left if only is None else left.where(only)
    left = left.withColumn("slot", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") * F.col("n") / RUN_PLACES)))
    slots = left.select("key", "prefix", "run", "slot").distinct()
    past = priors.where("key <> '' and serial is not null").join(found.select("key", "prefix", "serial", "run").join(slots, ["key", "prefix", "run"]), ["key", "prefix", "serial"])
    rows = looked_up(left, config).unionByName(looked_up(past))
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(runs_of(least, lists), "id long, run_length long, first long, last long, related array<long>")


def sequential_bounds(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """(id, run_length, first, last) without lists: a document whose history reaches back to the whole run takes the run's own
    bounds, so a run of n numbers costs n rows; only other documents read their run's members."""
    runs = consecutive(priors, max(2, config.sequential_min_run))
    whole = (F.date_sub("anchor", config.lookback_days) <= F.col("oldest")) & ~F.col("mixed")
    left = docs.where("key <> ''").join(runs, ["key", "prefix", "serial"])
    known = left.where(F.coalesce(whole, F.lit(False))).select("id", F.col("n").alias("run_length"), F.col("start").alias("first"), F.col("end").alias("last"))
    return known.unionByName(sequential_lists(docs, priors, config, ~F.coalesce(whole, F.lit(False)), lists=False).drop("related"))


def sequential_runs(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """``sequential_lists`` of every document: the related ids are part of a finding, n of them for each of a run of n."""
    return sequential_lists(docs, priors, config)


def sequential_numbers(docs: DataFrame, priors: DataFrame, config: Config, lists: bool = True) -> DataFrame:
    """P-018: consecutive invoice numbers from one supplier.  Without ``lists`` evidence and related ids are not filled in."""
    said = cat(F.col("run_length").cast("string"), " consecutive invoice numbers ", F.col("first").cast("string"), "..", F.col("last").cast("string"))
    proof = evidence(run_length=F.col("run_length"), first=F.col("first"), last=F.col("last"), related_document_ids=F.concat(F.lit("["), F.array_join(F.col("related").cast("array<string>"), ","), F.lit("]")))
    return sequential_lists(docs, priors, config, lists=lists).select("id", finding("P-018", said, proof, F.col("related"), message=worded("P-018", n=F.col("run_length"), first=F.col("first"), last=F.col("last"))).alias("finding"))


HistoryRule = Callable[[DataFrame, DataFrame, Config], DataFrame]
RULES: dict[str, HistoryRule] = {"P-002": duplicates, "P-011": splitting, "P-016": near_duplicates, "P-017": reused_numbers, "P-018": sequential_numbers}


def unapproved_in(documents: DataFrame, approved: DataFrame) -> DataFrame:
    """P-012 against a table of approved suppliers (vendor): an anti join on their keys."""
    keys = approved.select(T.vendor_key(F.col("vendor")).alias("_k")).distinct()
    named = documents.where("vendor is not null").select("id", "vendor", T.vendor_key(F.col("vendor")).alias("key"))
    return named.join(keys, F.col("key") == F.col("_k"), "left_anti").select("id", finding("P-012", F.lit("supplier not on approved list"), evidence(vendor=F.col("vendor")), message=worded("P-012", vendor=F.col("vendor"))).alias("finding"))
