"""Documents from short dictionaries."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from payproof.schema import DOCUMENT, PRIOR, columns

TODAY = dt.date(2026, 6, 30)
D = Decimal


def schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def docs(spark, *rows, history=False):
    """Each row: any of the document's fields; the id counts up unless given.  Clean values unless given."""
    ddl = DOCUMENT + (f", history array<{PRIOR}>" if history else "")
    names = list(columns(ddl))
    made = []
    for i, r in enumerate(rows, 1):
        base = {"id": i, "input_idx": i, "vendor": f"Vendor {i}", "date": dt.date(2026, 6, 20), "total": D("100.37"), "confidence": 1.0, "today": TODAY, "ingestion_status": "accepted"} | r
        items = base.get("line_items")
        if items is not None:
            base["line_items"] = [{"name": "Item", "quantity": None, "unit_price": None, "amount": None} | x for x in items]
        made.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(made, schema(spark, ddl))


def fired(results):
    return {r["id"]: [f["rule_id"] for f in r["findings"]] for r in results.collect()}


__all__ = ["D", "F", "T", "TODAY", "docs", "fired", "schema"]
