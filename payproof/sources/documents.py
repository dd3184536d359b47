"""Readers of documents: JSON in three shapes, CSV with mapped headers, Parquet; and what they reject."""

from __future__ import annotations

import csv
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import HEADER_ALIASES, Config, Profile
from ..functions.dates import lenient_date, strict_date
from ..functions.money import lenient_money, strict_money
from ..functions.text import clean_text
from ..schema import DOCUMENT, MAX_LINE_ITEMS, MAX_TEXT, PRIOR, columns
from . import json_blocks

#: Keys that a document, its parts and a request may have.
FIELD_KEYS = ("vendor", "date", "total", "subtotal", "tax", "line_items", "signature_present", "confidence", "invoice_number", "currency")
DOCUMENT_KEYS = (*FIELD_KEYS, "id", "document_id", "today", "source", "fields")
REQUEST_KEYS = (*DOCUMENT_KEYS, "history", "config", "filename", "ingestion_status", "reject_reason")
TEXT_ITEM = "struct<name: string, quantity: string, unit_price: string, amount: string>"
TEXT_PRIOR = "struct<document_id: string, vendor: string, total: string, date: string, invoice_number: string>"
TEXT_SOURCE = "struct<file: string, row: bigint, sha256: string, url: string>"
RAW = f"vendor string, date string, total string, subtotal string, tax string, line_items array<{TEXT_ITEM}>, signature_present boolean, confidence double, invoice_number string, currency string"
RAW_DOCUMENT = f"struct<{', '.join(f'{k}: {v}' for k, v in columns(RAW).items())}, id: bigint, document_id: bigint, today: string, source: {TEXT_SOURCE}, history: array<{TEXT_PRIOR}>, filename: string, ingestion_status: string, reject_reason: string>"


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object that are not allowed, in order of the alphabet."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed])))


def numbered(df: DataFrame) -> DataFrame:
    """``input_idx`` from 1 by file and place in it, counted block by block, so that no task sees all rows."""
    blocks = df.withColumn("_f", F.col("_metadata.file_path")).withColumn("_b", F.col("_metadata.file_block_start")).withColumn("_m", F.monotonically_increasing_id())
    sums = blocks.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return blocks.join(F.broadcast(before), ["_f", "_b"]).withColumn("input_idx", F.col("_before") + F.col("_m") - F.col("_first") + 1).drop("_f", "_b", "_m", "_n", "_first", "_before")


def repeated_ids(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids..., n): ids that occur more than once."""
    return rows.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(docs: DataFrame) -> DataFrame:
    """The documents, or an error that names an id that occurs twice."""
    twice = repeated_ids(docs, "id").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate document id {twice[0]['id']}")
    return docs


def parse_json(objects: DataFrame, label: str, keys: tuple[str, ...] = DOCUMENT_KEYS) -> DataFrame:
    """Documents from rows (input_idx, json), each with ``reject_reason`` where the object breaks a rule: unknown keys, an
    amount, date or confidence that does not read strictly, too long a text or list.  Rejected objects keep what could be
    read and have ingestion_status rejected.  A ``fields`` object is merged with the keys around it."""
    merged = F.get_json_object("json", "$.fields")
    own, inner = F.from_json("json", RAW_DOCUMENT), F.from_json(merged, RAW_DOCUMENT)
    d = objects.withColumns({"o": own, "i": inner, "bad": F.concat(F.coalesce(unknown_keys(F.col("json"), keys), F.array(F.lit("not an object"))), F.coalesce(unknown_keys(merged, FIELD_KEYS), F.array().cast("array<string>")))})
    pick = {k: F.coalesce(F.col(f"i.{k}"), F.col(f"o.{k}")) for k in FIELD_KEYS}
    d = d.select("input_idx", "bad", "json", "o", *[v.alias(k) for k, v in pick.items()])
    amounts = {k: strict_money(F.col(k)) for k in ("total", "subtotal", "tax")}
    items = F.transform("line_items", lambda x: F.struct(F.coalesce(clean_text(x["name"]), F.lit("Item")).alias("name"), *[strict_money(x[c]).alias(c) for c in ("quantity", "unit_price", "amount")]))
    wrong_item = F.exists("line_items", lambda x: F.greatest(*[(x[c].isNotNull() & strict_money(x[c]).isNull()).cast("int") for c in ("quantity", "unit_price", "amount")]) > 0)
    checks = [(F.size("bad") > 0, F.concat(F.lit("unknown keys: "), F.array_join("bad", ", "))), *[(F.col(k).isNotNull() & v.isNull(), F.lit(f"{k} is not a plain decimal")) for k, v in amounts.items()], (F.col("date").isNotNull() & strict_date(F.col("date")).isNull(), F.lit("date is not YYYY-MM-DD")), (~F.coalesce(F.col("confidence"), F.lit(1.0)).between(0.0, 1.0), F.lit("confidence is not within 0 and 1")), (F.greatest(*[F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("vendor", "invoice_number", "currency")]) > MAX_TEXT, F.lit(f"text over {MAX_TEXT} characters")), (F.size("line_items") > MAX_LINE_ITEMS, F.lit(f"over {MAX_LINE_ITEMS} line items")), (wrong_item, F.lit("line item amount is not a plain decimal"))]
    reason = F.coalesce(*[F.when(F.coalesce(w, F.lit(False)), r) for w, r in checks], F.col("o.reject_reason"))
    history = F.transform("o.history", lambda p: F.struct(F.coalesce(p["document_id"].try_cast("bigint"), F.lit(1).cast("bigint")).alias("document_id"), clean_text(p["vendor"]).alias("vendor"), strict_money(p["total"]).alias("total"), strict_date(p["date"]).alias("date"), clean_text(p["invoice_number"]).alias("invoice_number"))).cast(f"array<{PRIOR}>")
    source = F.struct(F.coalesce("o.source.file", "o.filename", F.lit(label)).alias("file"), F.coalesce("o.source.row", "input_idx").alias("row"), F.col("o.source.sha256").alias("sha256"), F.col("o.source.url").alias("url"))
    made = {"id": F.coalesce("o.id", "o.document_id", "input_idx"), "input_idx": F.col("input_idx"), "vendor": clean_text(F.col("vendor")), "date": strict_date(F.col("date")), **amounts, "line_items": items, "signature_present": F.col("signature_present"), "confidence": F.coalesce("confidence", F.lit(1.0)), "invoice_number": clean_text(F.col("invoice_number")), "currency": clean_text(F.col("currency")), "today": strict_date(F.col("o.today")), "ingestion_status": F.when(reason.isNotNull(), "rejected").otherwise(F.coalesce("o.ingestion_status", F.lit("accepted"))), "reject_reason": reason, "source": source}
    return d.select(*[made[c].cast(t).alias(c) for c, t in columns(DOCUMENT).items()], history.alias("history"))


#: Bytes of a file that a row may hold; larger ones are read in blocks.
WHOLE = 1 << 26


def read_json(spark: SparkSession, path: str, profile: Profile = Profile(), whole: int = WHOLE) -> tuple[DataFrame, DataFrame | None, Config, str | None]:
    """Documents with ``history``, ledger, config and audit date of a JSON file.

    An array is a batch; an object with ``documents`` is a batch with its own config, history and today, which come before
    the profile's; any other object is one request, where the profile's config comes first.  A file of one object per
    line (.jsonl, .ndjson) is a batch that is read in parallel.  Of an array or batch of over ``whole`` bytes, or in a folder whose
    files in order are one text, elements are found in blocks by many tasks (``json_blocks``).
    """
    label = path.rstrip("/").rsplit("/", 1)[-1]
    if path.endswith((".jsonl", ".ndjson")):
        lines = numbered(spark.read.text(path).where("trim(value) <> ''").select("value", "_metadata")).select("input_idx", F.col("value").alias("json"))
        return parse_json(lines, label), None, profile.config, profile.today
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").limit(2).collect()]
    if len(sizes) > 1 or sizes and sizes[0] > whole:
        found = read_json_blocks(spark, path, label, profile)
        if found is not None:
            return found
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    shape = text.select(F.ltrim("json").startswith("[").alias("batch"), F.get_json_object("json", "$.documents").alias("documents"), F.get_json_object("json", "$.config").alias("config"), F.get_json_object("json", "$.today").alias("today"), F.get_json_object("json", "$.history").alias("history")).first()
    array = F.col("json") if shape["batch"] else F.get_json_object("json", "$.documents") if shape["documents"] else F.concat(F.lit("["), F.col("json"), F.lit("]"))
    single = not shape["batch"] and not shape["documents"]
    objects = text.select(F.posexplode(F.from_json(array, "array<string>")).alias("at", "json")).select((F.col("at") + 1).cast("long").alias("input_idx"), "json")
    own = json.loads(shape["config"]) if shape["config"] else None
    config = Config.of(own) if own and (not single or profile.config == Config()) else profile.config
    ledger = None
    if shape["documents"] and shape["history"]:
        ledger = priors(text.select(F.explode(F.from_json(F.get_json_object("json", "$.history"), f"array<{TEXT_PRIOR}>")).alias("p")))
    docs = parse_json(objects, label, REQUEST_KEYS if single else DOCUMENT_KEYS)
    return (docs if single else require_unique(docs)), ledger, config, shape["today"] or profile.today


def priors(rows: DataFrame) -> DataFrame:
    """Ledger rows from a column p of texts."""
    return rows.select(F.coalesce(F.col("p.document_id").try_cast("bigint"), F.lit(1)).alias("document_id"), clean_text(F.col("p.vendor")).alias("vendor"), strict_money(F.col("p.total")).alias("total"), strict_date(F.col("p.date")).alias("date"), clean_text(F.col("p.invoice_number")).alias("invoice_number"))


def read_json_blocks(spark: SparkSession, path: str, label: str, profile: Profile) -> tuple[DataFrame, DataFrame | None, Config, str | None] | None:
    """What ``read_json`` returns for a batch, read in blocks; nothing for a single request."""
    first = spark.read.option("lineSep", "}").text(path).orderBy("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    batch = first["c"] == "["
    found = json_blocks.parts(json_blocks.pieces(spark, path), batch)
    around = {} if batch else json_blocks.around(found)
    if not batch and "documents" not in around:
        return None
    config = Config.of(around["config"]) if around.get("config") else profile.config
    history = json_blocks.elements(found, "history").select(F.from_json("json", TEXT_PRIOR).alias("p"))
    docs = parse_json(json_blocks.elements(found, "documents"), label, DOCUMENT_KEYS)
    return require_unique(docs), priors(history) if "history" in around else None, config, around.get("today") or profile.today


def header_key(name: str) -> str:
    """Trimmed, without a byte order mark, ASCII lower case, runs of space as one."""
    return " ".join("".join(c.lower() if c.isascii() else c for c in (name or "").strip().lstrip("﻿")).split())


def map_headers(headers: list[str], profile: Profile) -> dict[str, int]:
    """The place of each field's column: the profile's names first, else the usual ones; of equal headers the last."""
    place = {header_key(h): i for i, h in enumerate(headers)}
    out = {}
    for f, usual in HEADER_ALIASES.items():
        hit = next((place[header_key(n)] for n in profile.columns.get(f, usual) if header_key(n) in place), None)
        if hit is not None:
            out[f] = hit
    if "total" not in out:
        raise ValueError(f"no amount column found (headers: {' | '.join(map(header_key, headers))})")
    return out


def file_hash(spark: SparkSession, path: str, whole: int = WHOLE) -> str | None:
    """The sha256 of the one file at ``path``, null for a folder of several.

    A file of up to ``whole`` bytes is hashed as it is.  The lines of a larger one go, sorted by their places, through one
    incremental digest: no task holds more than a line, though one task sees all, as a digest has an order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").limit(2).collect()
    if len(files) != 1:
        return None
    if files[0]["length"] <= whole:
        return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    length = files[0]["length"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size, state = 0, 0, hashlib.sha256()
        for b in batches:
            for line in b.column(2).to_pylist():
                state.update(b"\n" + line if n else line)
                size += len(line) + (n > 0)
                n += 1
        if size < length:
            state.update(b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["h"])

    return lines.repartition(1).sortWithinPartitions("block", "place").mapInArrow(digest, "h string").first()["h"]


#: A quoted field with its quotes, and a quote that opens a field.
QUOTED, OPENED = r'(^|,)[ \t]*"(?:[^"]|"")*+"(?=[ \t]*(?:,|$))', r'(^|,)[ \t]*"'


def running(frame: W, out: str, into: str) -> tuple[Column, Column]:
    """Whether text is inside quotes after all rows of a frame, if it was not before (first column) or was (second).

    Each row has ``out`` and ``into``, the same for itself, and ``_flips`` so far.  Rows either fix the state, flip it or leave it, so the last that fixed
    it and the flips since say all: a scan without an order of evaluation.
    """
    fixed = F.col(out) == F.col(into)
    last = F.last(F.when(fixed, F.struct(F.col(out).alias("v"), F.col("_flips").alias("n"))), ignorenulls=True).over(frame)
    odd = lambda n: n % 2 == 1
    since = lambda start: F.when(last.isNotNull(), last["v"] != odd(F.col("_flips") - last["n"])).otherwise(F.lit(start) != odd(F.col("_flips")))
    return since(False), since(True)


def scanned(rows: DataFrame, part: list[str], order: list[str], out: str, into: str, names: tuple[str, str]) -> DataFrame:
    """``rows`` with ``running`` states as two more columns."""
    frame = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_flips", F.sum((F.col(out) & ~F.col(into)).cast("long")).over(frame))
    a, b = running(frame, out, into)
    return rows.withColumns({names[0]: a, names[1]: b}).drop("_flips")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(input_idx, record) of CSV text from 1: lines, and those that a quoted line break joins, as one text.

    Files are read in blocks by many tasks.  Each line says whether it ends inside quotes for either state it may begin
    in; scans inside a block, and over one row per block, fix the states.  Only lines of records that are broken are shuffled.  Blank
    lines between records do not count.  Text that is not UTF-8 is read as ISO-8859-1.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
    if raw.where(~F.is_valid_utf8("value")).limit(1).count():
        raw = raw.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    rest = lambda text: F.regexp_replace(text, QUOTED, "$1")
    closed = F.regexp_extract("value", r'^(?:[^"]|"")*+"(?!")([^"].*|)$', 1)
    ends = F.col("value").rlike(r'^(?:[^"]|"")*+"(?!")')
    lines = raw.withColumns({"out": rest(F.col("value")).rlike(OPENED), "into": F.when(ends, rest(closed).rlike(OPENED)).otherwise(True)})
    lines = scanned(lines, ["f", "b"], ["m"], "out", "into", ("end_out", "end_in"))
    whole = scanned(lines.groupBy("f", "b").agg(F.max_by("end_out", "m").alias("out"), F.max_by("end_in", "m").alias("into")), ["f"], ["b"], "out", "into", ("a", "z"))
    begins = whole.select("f", "b", F.coalesce(F.lag("a").over(W.partitionBy("f").orderBy("b")), F.lit(False)).alias("begin"))
    own = W.partitionBy("f", "b").orderBy("m")
    lines = lines.join(F.broadcast(begins), ["f", "b"]).withColumn("end", F.when(F.col("begin"), F.col("end_in")).otherwise(F.col("end_out")))
    lines = lines.withColumn("start", F.coalesce(F.lag("end").over(own), F.col("begin"))).where(F.col("start") | (F.trim("value") != ""))
    lines = lines.withColumn("nth", F.sum((~F.col("start")).cast("long")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    counts = lines.groupBy("f", "b").agg(F.max("nth").alias("n"))
    before = counts.select("f", "b", F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    lines = lines.join(F.broadcast(before), ["f", "b"]).withColumn("input_idx", F.col("before") + F.col("nth"))
    single = lines.where(~F.col("start") & ~F.col("end")).select("input_idx", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("f", "b", "m", "value")))
    joined = lines.where(F.col("start") | F.col("end")).groupBy("input_idx").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(joined)


def read_csv(spark: SparkSession, path: str, profile: Profile = Profile(), sha256: str | None = None) -> DataFrame:
    """Documents of a CSV file.  Amounts and dates are read leniently, blank rows are skipped, texts are cut to 512
    characters; ids that are missing or not unique make the whole file count from 1.  Files that are not UTF-8 are read as
    ISO-8859-1.  Line breaks inside quotes do not keep a file from being split.  ``sha256`` is that of the file unless given; a
    folder of several files has none."""
    sha256 = sha256 or file_hash(spark, path)
    records = csv_records(spark, path)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    first = records.where("input_idx = 1").select("record").first()
    if first is None:
        raise ValueError("no header row")
    head = next(csv.reader(first["record"].splitlines(keepends=True)))
    names = [f"_c{i}" for i in range(len(head))]
    parsed = F.from_csv("record", ", ".join(f"{n} string" for n in names), options)
    rows = records.select("input_idx", parsed.alias("r")).select("input_idx", "r.*")
    at = map_headers(head, profile)
    get = lambda f: F.nullif(F.trim(F.col(names[at[f]])), F.lit("")) if f in at else F.lit(None).cast("string")
    body = rows.where("input_idx > 1").where(F.trim(F.concat_ws("", *names)) != "")
    cap = lambda f: F.substring(F.regexp_replace(get(f), r"\p{Cc}", ""), 1, MAX_TEXT)
    conf = get("confidence").try_cast("double")
    label = path.rstrip("/").rsplit("/", 1)[-1]
    order = body.withColumn("line", F.col("input_idx"))
    counted = order.withColumn("input_idx", F.col("line") - 1)
    made = {"id": F.coalesce(get("id").try_cast("bigint"), F.col("input_idx")), "input_idx": F.col("input_idx"), "vendor": cap("vendor"), "date": lenient_date(get("date"), profile.date_formats), "total": lenient_money(get("total")), "subtotal": lenient_money(get("subtotal")), "tax": lenient_money(get("tax")), "line_items": F.array(), "confidence": F.when(conf.between(0.0, 1.0), conf).otherwise(1.0), "invoice_number": cap("invoice_number"), "currency": F.coalesce(cap("currency"), F.lit(profile.currency)), "today": lenient_date(get("today"), profile.date_formats), "ingestion_status": F.lit("accepted"), "source": F.struct(F.lit(label).alias("file"), F.col("line").alias("row"), F.lit(sha256).alias("sha256"), F.lit(None).cast("string").alias("url"))}
    docs = counted.select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns(DOCUMENT).items()])
    if repeated_ids(docs, "id").limit(1).count():
        docs = docs.withColumn("id", F.col("input_idx"))
    return docs


def read(spark: SparkSession, path: str, profile: Profile = Profile()) -> DataFrame:
    """Documents by the file's suffix: csv, parquet, anything else JSON."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, profile)
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_json(spark, path, profile)[0]
