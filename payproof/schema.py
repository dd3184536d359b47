"""Types of documents, histories, findings and the audit ledger."""

from __future__ import annotations

MONEY = "decimal(18,4)"
#: Limits of what is read; more is an error or a reject, never cut off (CSV text aside).
MAX_TEXT = 512
MAX_LINE_ITEMS = 1000
MAX_MONEY_TEXT = 40

LINE_ITEM = f"struct<name: string, quantity: {MONEY}, unit_price: {MONEY}, amount: {MONEY}>"
SOURCE = "struct<file: string, row: bigint, sha256: string, url: string>"
PRIOR = f"struct<document_id: bigint, vendor: string, total: {MONEY}, date: date, invoice_number: string>"
DOCUMENT = f"id bigint, input_idx bigint, vendor string, date date, total {MONEY}, subtotal {MONEY}, tax {MONEY}, line_items array<{LINE_ITEM}>, signature_present boolean, confidence double, invoice_number string, currency string, today date, ingestion_status string, reject_reason string, source {SOURCE}"
LEDGER = f"document_id bigint, vendor string, total {MONEY}, date date, invoice_number string"
FINDING = "struct<rule_id: string, severity: string, summary: string, evidence: map<string,string>, related: array<bigint>, message: string>"

#: The audit ledger: append-only tables, and what those that are read by ranges are partitioned by.
PARTITIONS = {"extractions": ("year", "bucket")}
TABLES = {
    "documents": "document_id bigint, filename string, ingestion_status string, reject_reason string, sha256 string, created_at timestamp, attempt string",
    "extractions": f"document_id bigint, vendor string, date date, total {MONEY}, subtotal {MONEY}, tax {MONEY}, line_items string, signature_present boolean, confidence double, invoice_number string, currency string, attempt string, month string, year int, bucket int",
    "audit_runs": "run_id string, document_id bigint, verdict string, worst_severity string, fields string, config string, not_evaluated array<string>, started_at timestamp, finished_at timestamp, attempt string",
    "findings": "run_id string, document_id bigint, rule_id string, policy_title string, policy_text string, severity string, summary string, evidence string, related array<bigint>, attempt string",
    "trace_steps": "run_id string, step_index int, tool string, args string, result string, ok boolean, error string, duration_ms double, note string, attempt string",
    "review_decisions": "run_id string, decision_id bigint, reviewer string, decision string, note string, overrides_verdict boolean, decided_at timestamp, attempt string",
    "commits": "attempt string, batch string, at timestamp, replaces array<string>",
}


def columns(ddl: str) -> dict[str, str]:
    """Names and types of a flat list of columns."""
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return {x.split()[0]: x.strip().split(" ", 1)[1] for x in map(str.strip, [*out, part])}
