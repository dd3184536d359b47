"""Auditing a stream of documents: each micro-batch against the ledger and itself, then into the ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.audit import audit_batch
from ..sources.ledger import Ledger


def audit_micro_batch(batch: DataFrame, batch_id: int, ledger: Ledger, config: Config, today: dt.date) -> None:
    """One micro-batch.  Its name is its number, and a number that the ledger holds already is not audited again, so a
    restart after a lost driver repeats nothing."""
    name = f"batch{batch_id:09d}"
    if ledger.holds(name) or batch.isEmpty():
        return
    docs = batch.persist()
    report = audit_batch(docs, ledger.history_of(docs, config.near_dup_window_days), config, today)
    ledger.record(docs, report.results, dt.datetime.now(), name)
    report.release()
    docs.unpersist()


def audit_stream(documents: DataFrame, ledger: Ledger, checkpoint: str, config: Config = Config(), today: dt.date | None = None, **trigger) -> StreamingQuery:
    """Start auditing a streaming DataFrame of documents.  Late documents need no watermark: the ledger is the state, and
    each document is compared by its own date."""
    day = today or dt.date.today()
    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: audit_micro_batch(b, n, ledger, config, day))
    return (writer.trigger(**trigger) if trigger else writer).start()
