"""Files that driver and executors both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a temporary folder only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return f"{at}/payproof-{uuid.uuid4().hex}/{name}"


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV list in many files: the headers are the first file, all rows follow."""
    head = rows.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns)).coalesce(1)
    text = rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    head.union(text).write.option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"))).write.text(path)


def write_json_lists(lists: list[tuple[str, DataFrame]], end: str, path: str) -> None:
    """One JSON text in many files: for each list the text before it and its rows, which have an ``id``; then the end.

    The row of the greatest id comes last, as it takes no comma."""
    spark = lists[0][1].sparkSession
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    out = None
    for head, rows in lists:
        made = rows.select("id", F.to_json(F.struct("*")).alias("value"))
        last = made.orderBy(F.desc("id")).first()
        body = made.where(F.col("id") != last["id"]).select(F.concat("value", F.lit(",")).alias("value"))
        part = line(head).union(body).union(line(last["value"]))
        out = part if out is None else out.union(part)
    out.union(line(end)).write.text(path)
