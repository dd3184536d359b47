"""The audit ledger: append-only tables of Parquet files, or a database over JDBC."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vendor_key
from ..policies import policies
from ..schema import PARTITIONS, TABLES, columns

#: Parts that suppliers are dealt into by a hash of their keys.  A ledger keeps the number it was begun with.
BUCKETS = 16


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def bucket_of(vendor: Column) -> Column:
    return F.pmod(F.xxhash64(vendor_key(vendor)), F.lit(BUCKETS)).cast("int")


class Ledger:
    """Tables under one folder.  Rows carry the attempt that wrote them, and an attempt counts once ``commits`` holds a file of its
    batch's name with its number, written last and never overwritten: of attempts at one batch, by retries or by two drivers at
    once, one counts.  What a lost driver left behind is never read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, rows: DataFrame, attempt: str) -> None:
        """Each attempt writes a folder of its own, a partition, so that writers at one time do not meet."""
        parts = PARTITIONS.get(table, ())
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns(TABLES[table]).items() if c != "attempt"])
        (rows.repartition(*parts).sortWithinPartitions(*parts, "date") if parts else rows).write.mode("append").partitionBy(*parts).parquet(f"{self.path}/{table}/attempt={attempt}")

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[table])
        try:
            return reader.json(f"{self.path}/{table}") if table == "commits" else reader.parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], TABLES[table])
            raise

    def attempts(self) -> DataFrame:
        """The attempts that count: committed, and not replaced by a compaction."""
        commits = self.read("commits")
        return commits.select("attempt").join(commits.select(F.explode("replaces").alias("attempt")), "attempt", "left_anti")

    def committed(self, table: str) -> DataFrame:
        """The rows of attempts that count.  Spark broadcasts the attempts while they are few."""
        return self.read(table).join(self.attempts(), "attempt", "left_semi")

    def holds(self, batch: str) -> bool:
        fs, path = self.commit_file(batch)
        return fs.exists(path)

    def commit_file(self, batch: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{quote(batch, safe='')}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commit(self, batch: str, attempt: str, at: dt.datetime, replaces: list[str] | None = None) -> bool:
        """Create the batch's commit file; False if another attempt has.  The file system's create-unless-there decides; where
        a store lacks that, a file still holds one attempt, so readers agree on one."""
        fs, path = self.commit_file(batch)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):
                return False
            raise e
        try:
            out.write(bytearray(json.dumps({"attempt": attempt, "batch": batch, "at": at.isoformat(), "replaces": replaces or []}).encode() + b"\n"))
        finally:
            out.close()
        return self.read("commits").where((F.col("batch") == batch) & (F.col("attempt") == attempt)).count() == 1

    def record(self, documents: DataFrame, results: DataFrame, at: dt.datetime, batch: str | None = None, steps: DataFrame | None = None) -> str:
        """Documents, extractions, runs, findings and ``steps`` (document_id, step_index, tool, ...) of one batch, with the
        controls' texts as they were.  Rejected files have no extraction.  A batch that is held already is not written again."""
        batch, number = batch or uuid.uuid4().hex, uuid.uuid4().hex
        if self.holds(batch):
            return batch
        run = F.concat_ws("-", F.lit(batch), F.col("id").cast("string"))
        stamp = F.lit(at).cast("timestamp")
        docs = documents.withColumn("document_id", F.col("id"))
        self.append("documents", docs.select("document_id", F.col("source.file").alias("filename"), "ingestion_status", "reject_reason", F.col("source.sha256").alias("sha256"), stamp.alias("created_at")), number)
        self.append("extractions", docs.where("ingestion_status = 'accepted'").withColumns({"line_items": F.to_json("line_items"), "month": month_of(F.col("date")), "year": F.year("date"), "bucket": bucket_of(F.col("vendor"))}), number)
        found = results.select(run.alias("run_id"), F.col("id").alias("document_id"), F.explode("findings").alias("f")).select("run_id", "document_id", "f.rule_id", "f.severity", "f.summary", F.to_json("f.evidence").alias("evidence"), "f.related")
        texts = policies(self.spark).select(F.col("policy_id").alias("rule_id"), F.col("title").alias("policy_title"), F.col("text").alias("policy_text"))
        self.append("findings", found.join(F.broadcast(texts), "rule_id", "left"), number)
        self.append("audit_runs", results.select(run.alias("run_id"), F.col("id").alias("document_id"), "verdict", "worst_severity", "not_evaluated", stamp.alias("started_at"), stamp.alias("finished_at")), number)
        if steps is not None:
            self.append("trace_steps", steps.withColumn("run_id", F.concat_ws("-", F.lit(batch), F.col("document_id").cast("string"))), number)
        self.commit(batch, number, at)
        return batch

    def review(self, decisions: DataFrame, batch: str | None = None, at: dt.datetime | None = None) -> None:
        """Append decisions (run_id, decision_id, reviewer, decision, note, decided_at) with overrides_verdict.  They count as a
        batch does: given its name again, a retry adds nothing."""
        batch, number = f"review-{batch or uuid.uuid4().hex}", uuid.uuid4().hex
        if self.holds(batch):
            return
        runs = self.committed("audit_runs").select("run_id", "verdict")
        overrides = F.coalesce((F.col("decision") == "approved") & (F.col("verdict") == "blocked"), F.lit(False))
        self.append("review_decisions", decisions.join(runs, "run_id", "left").withColumn("overrides_verdict", overrides), number)
        self.commit(batch, number, at or dt.datetime.now())

    def compact(self, at: dt.datetime) -> str:
        """Write the rows that count again in fewer files, as one attempt that replaces theirs once it is committed.  Readers
        see the old rows or the new ones; the old files stay for readers that have begun."""
        number = uuid.uuid4().hex
        old = [r["attempt"] for r in self.attempts().collect()]
        for table in TABLES:
            if table != "commits":
                rows = self.read(table).where(F.col("attempt").isin(old))
                self.append(table, rows if table in PARTITIONS else rows.hint("rebalance"), number)
        self.commit(f"compact-{number}", number, at, old)
        return number

    def runs(self) -> DataFrame:
        """A row per run with its findings, steps and decisions as arrays, worst finding first, steps and decisions in order."""
        rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
        lists = {
            "findings": self.committed("findings").select("run_id", F.struct(rank.alias("place"), "rule_id", "severity", "summary", "evidence", "policy_title", "policy_text", "related").alias("x")),
            "steps": self.committed("trace_steps").select("run_id", F.struct("step_index", "tool", "ok", "error", "duration_ms", "note").alias("x")),
            "reviews": self.committed("review_decisions").select("run_id", F.struct("decided_at", "decision_id", "reviewer", "decision", "note", "overrides_verdict").alias("x")),
        }
        out = self.committed("audit_runs").drop("attempt")
        for name, rows in lists.items():
            out = out.join(rows.groupBy("run_id").agg(F.sort_array(F.collect_list("x")).alias(name)), "run_id", "left")
        return out

    def history(self, cutoff: dt.date | None, exclude: int | None = None) -> DataFrame:
        """Past documents with a supplier and a date, from ``cutoff`` on if that is given: filters that reach the scan."""
        rows = self.committed("extractions").where(F.col("vendor").isNotNull() & F.col("date").isNotNull())
        if cutoff is not None:
            rows = rows.where((F.col("year") >= cutoff.year) & (F.col("date") >= F.lit(cutoff)))
        if exclude is not None:
            rows = rows.where(F.col("document_id") != exclude)
        return rows.select("document_id", "vendor", "total", "date", "invoice_number")

    def history_of(self, documents: DataFrame, days: int) -> DataFrame:
        """What controls may compare ``documents`` with: past documents of their suppliers, and those of any supplier in
        the months that ``days`` around their dates reach.  Partitions that hold neither are not read, and inside a year's files the
        months are found by their statistics.  The lists that go to the scan have 16 buckets and the documents' months at most; ids of
        the documents themselves are left out."""
        dated = documents.select("id", vendor_key(F.col("vendor")).alias("name"), bucket_of(F.col("vendor")).alias("bucket"), F.array(month_of(F.date_sub("date", days)), month_of(F.date_add("date", days))).alias("months")).where("name <> ''")
        got = dated.agg(F.collect_set("bucket").alias("b"), F.array_distinct(F.flatten(F.collect_set("months"))).alias("m")).first()
        buckets, months = got["b"], [m for m in got["m"] if m]
        timely = F.col("year").isin(sorted({int(m[:4]) for m in months})) & F.col("month").isin(months)
        rows = self.committed("extractions").where(F.col("vendor").isNotNull() & F.col("date").isNotNull() & (F.col("bucket").isin(buckets) | timely))
        mine = rows.where(F.col("bucket").isin(buckets)).withColumn("name", vendor_key(F.col("vendor"))).join(dated.select("name").distinct(), "name", "left_semi").drop("name")
        near = rows.where(timely).withColumn("name", vendor_key(F.col("vendor"))).join(dated.select("name").distinct(), "name", "left_anti").drop("name")
        past = mine.unionByName(near).select("document_id", "vendor", "total", "date", "invoice_number")
        return past.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def read_jdbc(spark: SparkSession, url: str, cutoff: dt.date, table: str = "extractions", **options: str) -> DataFrame:
    """The same history from a database; the filters are pushed down."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    number = F.col("invoice_number") if "invoice_number" in rows.columns else F.lit(None).cast("string")
    return rows.where(F.col("vendor").isNotNull() & F.col("date").isNotNull() & (F.col("date") >= F.lit(cutoff))).select("document_id", "vendor", F.col("total").cast("decimal(18,4)").alias("total"), "date", number.alias("invoice_number"))
