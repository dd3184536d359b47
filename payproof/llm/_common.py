"""Helpers shared by the corpus operators: tables, words, and tables written to the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \v \f \r.  ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new temporary one only where that is unset and
    driver and executors are one process."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it back: work is done once and lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/payproof-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._payproof_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``materialize`` that nothing reads any more."""
    path = getattr(df, "_payproof_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced, before the next job writes its own.

    Spark's cleaner deletes what the JVM has collected; plans that hold other plans take a second round.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: Python objects are made of few rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def apart(*needed: str) -> Callable:
    """For functions that return their input's columns and perhaps more: columns other than ``needed`` go through under names
    that nothing inside uses and come back under their own.  Where an added column has the name of one, the added one stays."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            held = {c if c in needed else f"_held{i}": c for i, c in enumerate(docs.columns)}
            out = f(docs.toDF(*held), *args, **options)
            added = [c for c in out.columns if c not in held]
            return out.select(*[F.col(h).alias(c) for h, c in held.items() if c not in added], *added)

        return run

    return around


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
