"""Elements of large JSON lists, found in blocks of the text by many tasks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_path

STRING = r'"(?:[^"\\]|\\.)*+"'
#: Text at one depth: neither brackets nor quotes, strings, and lists of such text.
FLAT = rf'(?:[^"\[\]{{}}]++|{STRING})'
LEVEL = rf"(?:{FLAT}|\[{FLAT}*+\])"
#: The end of the list that a piece begins in, and the first list or object under a key that a piece leaves open.
CLOSES = rf"(?s)^({LEVEL}*+)(\].*)$"
OPENS = rf'(?s)^([\]{{\s]*{LEVEL}*"((?:[^"\\]|\\.)*+)"\s*:\s*([\[{{]))(.*)$'


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder once, for plans that read them several times."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows`` (f, b, m, ...) with the sum of ``value`` over all rows before each: by blocks, then by one row per block."""
    rows = rows.withColumn("_v", value.cast("long"))
    sums = rows.groupBy("f", "b").agg(F.sum("_v").alias("_s"))
    begun = sums.select("f", "b", F.coalesce(F.sum("_s").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    own = F.coalesce(F.sum("_v").over(W.partitionBy("f", "b").orderBy("m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(begun), ["f", "b"]).withColumn(out, F.col("_s") + own).drop("_v", "_s")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(f, b, m, value, depth, inside): the text of a file, or of a folder's files in order, cut after each closing brace.

    ``depth`` counts the brackets that are open where a piece begins, ``inside`` says that it begins inside a string.  A piece
    flips that state if it has an odd number of quotes, whatever the state is, so a sum over all pieces before gives it; then
    brackets outside strings are counted the same way.
    """
    meta = F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.col("_metadata.file_size").alias("size")
    raw = spark.read.option("lineSep", "}").text(path).select(*meta, "value")
    ends = raw.groupBy("f").agg(F.max(F.struct("b", "m")).alias("last"), (F.sum(F.octet_length("value") + 1) > F.max("size")).alias("cut"))
    cut = F.col("cut") & (F.struct("b", "m") == F.col("last"))
    text = raw.join(F.broadcast(ends), "f").select("f", "b", "m", F.when(cut, F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value"))
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', ""))
    text = before(text, quotes % 2, "quotes").withColumn("inside", F.col("quotes") % 2 == 1)
    begun = F.when(F.col("inside"), F.regexp_replace("value", r'(?s)^(?:[^"\\]|\\.)*+("|$)', "")).otherwise(F.col("value"))
    bare = F.regexp_replace(begun, rf'(?s){STRING}|"(?:[^"\\]|\\.)*+$', "")
    count = lambda kinds: F.length(F.regexp_replace(bare, rf"[^{kinds}]", ""))
    text = written(text.select("f", "b", "m", "value", "inside", (count(r"\[{") - count(r"\]}")).alias("more")), "braces")
    return before(text, F.col("more"), "depth").select("f", "b", "m", "value", "depth", "inside")


def parts(text: DataFrame, batch: bool) -> DataFrame:
    """Pieces with what they hold of lists: ``key`` and ``rest`` for the list that a piece ends in, ``ended`` and ``end`` for one
    that it ends, and ``frame``, the text around lists.

    The list of a ``batch`` is the whole text, under the key of documents; otherwise lists are values of the one object."""
    base = 1 if batch else 2
    outer = ~F.col("inside")
    if batch:
        opens = outer & (F.col("depth") == 0) & F.col("value").rlike(r"^\s*\[")
        named, kind, head, tail = F.lit("documents"), F.lit("["), F.lit("["), F.regexp_replace("rest", r"^\s*\[", "")
    else:
        opens = outer & (F.col("depth") <= 2) & (F.col("ended") | (F.col("depth") < 2)) & F.col("rest").rlike(OPENS)
        head, named, kind, tail = (F.regexp_extract("rest", OPENS, k) for k in (1, 2, 3, 4))
    closes = outer & (F.col("depth") == base) & F.col("value").rlike(CLOSES)
    d = text.withColumns({"ended": closes, "end": F.when(closes, F.regexp_extract("value", CLOSES, 1)), "rest": F.when(closes, F.regexp_extract("value", CLOSES, 2)).otherwise(F.col("value"))})
    d = d.withColumn("opened", opens)
    said = F.when(F.col("opened"), F.struct(named.alias("key"), (kind == "[").alias("list"))).when(F.col("ended"), F.struct(F.lit("").alias("key"), F.lit(False).alias("list")))
    d = d.withColumns({"said": said, "head": F.when(F.col("opened"), head), "tail": F.when(F.col("opened"), tail)})
    own = W.partitionBy("f", "b").orderBy("m")
    blocks = d.groupBy("f", "b").agg(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("m"))).alias("s"))
    begun = blocks.select("f", "b", F.last("s", True).over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)).alias("begun"))
    d = d.join(F.broadcast(begun), ["f", "b"])
    here = F.coalesce(F.last("said", True).over(own.rowsBetween(W.unboundedPreceding, 0)), F.col("begun"))
    past = F.coalesce(F.last("said", True).over(own.rowsBetween(W.unboundedPreceding, -1)), F.col("begun"))
    d = d.withColumns({"here": here, "past": past})
    listed = F.coalesce(F.col("here.list"), F.lit(False))
    frame = F.when(F.col("opened") & listed, F.col("head")).when(listed, F.lit("")).otherwise(F.col("rest"))
    return d.select("f", "b", "m", "depth", "inside", F.col("past.key").alias("ended"), F.when(F.col("ended"), F.col("end")).alias("end"), F.when(listed, F.col("here.key")).alias("key"), F.when(listed, F.coalesce("tail", "rest")).alias("rest"), frame.alias("frame"), ((F.col("depth") <= base) & ~F.col("inside")).alias("starts"))


def around(found: DataFrame) -> dict:
    """The object around the lists, whose lists are empty: settings, which are small."""
    rows = found.where("frame <> ''").select("f", "b", "m", "frame").collect()
    return json.loads("".join(r["frame"] for r in sorted(rows, key=lambda r: (r["f"], r["b"], r["m"]))).lstrip("﻿"))


def elements(found: DataFrame, key: str) -> DataFrame:
    """(input_idx, json) of the list under ``key``, from 1.  Text that is no JSON raises an error."""
    both = F.array(F.struct(F.col("ended").alias("k"), F.col("end").alias("t")), F.struct(F.col("key").alias("k"), F.col("rest").alias("t")))
    numbered = before(found, F.col("starts"), "unit").withColumn("unit", F.col("unit") + F.col("starts").cast("long"))
    texts = numbered.select("f", "b", "m", "unit", F.posexplode(both).alias("side", "p")).where((F.col("p.k") == key) & F.col("p.t").isNotNull())
    units = texts.groupBy("unit").agg(F.min(F.struct("f", "b", "m")).alias("at"), F.array_sort(F.collect_list(F.struct("f", "b", "m", "side", "p.t"))).alias("ts"))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("ts", lambda x: x["t"]), ""), r"^\s*,", ""), r",\s*$", "")
    units = units.select("at.*", text.alias("text")).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    read = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
    units = units.select("f", "b", "m", F.coalesce(read, F.raise_error(F.concat(F.lit("not JSON: "), F.substring("text", 1, 100))).cast("array<string>")).alias("list"))
    counted = before(written(units, "elements"), F.size("list"), "n")
    return counted.select("n", F.posexplode("list").alias("at", "json")).select((F.col("n") + F.col("at") + 1).alias("input_idx"), "json")
