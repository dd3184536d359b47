"""Files before they are read: kinds by their first bytes, intake decisions, checks against a manifest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import fault

#: Kind and the hex of the first bytes.
MAGIC = (("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"))
MAX_BYTES = 25 * 1024 * 1024
SUFFIXES = "*.{pdf,png,jpg,jpeg,gif,tif,tiff,bmp,webp,PDF,PNG,JPG,JPEG,GIF,TIF,TIFF,BMP,WEBP}"


def sniff(content: Column) -> Column:
    """The kind of a file by its content; null if it is none that is supported."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for kind, start in MAGIC:
        out = out.when(head.startswith(start), kind)
    return out


def files(spark: SparkSession, path: str, recursive: bool = False, pattern: str = SUFFIXES) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)


def first_files(spark: SparkSession, path: str, limit: int, recursive: bool = False, pattern: str = SUFFIXES) -> DataFrame:
    """The first ``limit`` files of a folder by path.  Their paths are chosen without reading contents, and only they are read."""
    found = files(spark, path, recursive, pattern)
    chosen = found.select("path").orderBy("path").limit(limit)
    return found.join(F.broadcast(chosen) if limit <= 100_000 else chosen, "path", "left_semi").orderBy("path")


def triage(found: DataFrame, *more: str) -> DataFrame:
    """(path, length, kind, ingestion_status, reject_reason, sha256) by size and first bytes, and the columns ``more``.

    Spark's file scans skip files of no bytes, so ``files`` never lists one; rows from elsewhere may be empty.
    """
    kind = sniff(F.col("content"))
    locked = (kind == "pdf") & F.contains(F.col("content"), F.lit(b"/Encrypt"))
    reason = F.when(F.col("length") == 0, "empty file").when(F.col("length") > MAX_BYTES, "file too large").when(kind.isNull(), "unsupported format").when(locked, "password protected")
    return found.select("path", "length", kind.alias("kind"), F.when(reason.isNull(), "accepted").otherwise("rejected").alias("ingestion_status"), reason.alias("reject_reason"), F.sha2("content", 256).alias("sha256"), *more)


def inspected(found: DataFrame) -> DataFrame:
    """``triage`` and a look inside what it accepts: broken and blank images, pages without anything to read.

    Images are blank if the standard deviation of their grey values is under 3.  Pixels of PNG and BMP are read; JPEG, GIF, TIFF
    and WebP are checked for their structure and end alone.  Contents of what was already rejected are not sent to Python.
    Contents go there in Arrow batches: for folders of large files lower ``spark.sql.execution.arrow.maxRecordsPerBatch``, as a
    batch takes up to that many times 25 MB.
    """

    @F.pandas_udf("string")
    def look(kind: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([fault(k, c) if c is not None else None for k, c in zip(kind, content)], dtype=object)

    first = triage(found, "content")
    passed = F.col("ingestion_status") == "accepted"
    seen = first.withColumn("fault", look("kind", F.when(passed, F.col("content")))).drop("content")
    reason = F.coalesce("reject_reason", "fault")
    return seen.select("path", "length", "kind", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("ingestion_status"), reason.alias("reject_reason"), "sha256")


def verify_manifest(spark: SparkSession, root: str, manifest: str = "MANIFEST.json") -> DataFrame:
    """(path, expected, found, status): every listed file must be there with its hash; paths that leave the folder are refused."""
    listed = spark.read.text(f"{root}/{manifest}", wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "array<struct<path: string, sha256: string>>")).alias("f")).select("f.path", F.lower("f.sha256").alias("expected"))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + base + "/", "").alias("_p"), F.sha2("content", 256).alias("found"))
    joined = listed.join(there, F.col("path") == F.col("_p"), "left")
    leaves = F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").startswith("/")
    return joined.select("path", "expected", "found", F.when(leaves, "refused").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("expected"), "changed").otherwise("ok").alias("status"))
