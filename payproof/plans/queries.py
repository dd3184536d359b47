"""The registered queries of the audit engine and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import history, population, reports
from ..operators.rows import RULES, intake_rejected, prepared, with_findings
from ..policies import MESSAGES, POLICIES
from . import model
from .audit import BatchReport, audit_batch, audit_requests
from .model import DOCUMENTS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Config()
TODAY = "2001-12-31"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def docs_sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([DOCUMENTS_SQL.strip(), *ctes]) + "\n" + body


def day():
    import datetime as dt

    return dt.date.fromisoformat(TODAY)


def report(spark: SparkSession, sf_dir: str, *more: str) -> BatchReport:
    """The audit with each finding's control and severity, and what else of it a query reads."""
    return audit_batch(model.documents(spark, sf_dir), None, CONFIG, day(), ("rule_id", "severity", *more))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, priors = history.keyed(model.documents(spark, sf_dir), None, CONFIG, day())
    return docs.where("named"), priors


# --- row-local controls ---------------------------------------------------------------------------------------------

M = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
TOTAL = M.format("total")
LINES = "subtotal"
TOL = "greatest(0.05, CASE currency WHEN 'IDR' THEN 100 WHEN 'VND' THEN 100 WHEN 'KRW' THEN 10 WHEN 'JPY' THEN 1 ELSE 0 END)"
FLOOR = "CASE currency WHEN 'JPY' THEN 50000 WHEN 'KRW' THEN 50000 WHEN 'INR' THEN 50000 WHEN 'IDR' THEN 5000000 WHEN 'VND' THEN 5000000 ELSE 500 END"
STEP = "CASE currency WHEN 'JPY' THEN 10000 WHEN 'KRW' THEN 10000 WHEN 'INR' THEN 1000 WHEN 'IDR' THEN 100000 WHEN 'VND' THEN 100000 ELSE 100 END"
#: Control, name, condition, summary.
ROW_SQL = [
    ("P-001", "unsubstantiated", "total IS NULL OR (total > 75 AND vendor IS NULL AND date IS NULL)", f"CASE WHEN total IS NULL THEN 'no amount readable' ELSE 'amount ' || {TOTAL} || ' > 75.00 with no supplier and no date' END"),
    ("P-003", "missing_vendor", "vendor IS NULL", "'no supplier name'"),
    ("P-004", "missing_date", "date IS NULL", "'no transaction date'"),
    ("P-005", "stale", "today - date > 90", "(today - date) || ' days old > 90-day window'"),
    ("P-006", "future", "date > today", "'dated ' || date || ' after audit date ' || today"),
    ("P-007", "arithmetic", f"(tax IS NOT NULL AND abs(total - (subtotal + tax)) > {TOL}) OR (tax IS NULL AND (subtotal > total + {TOL} OR total > subtotal * 1.35 + {TOL}))", f"CASE WHEN tax IS NOT NULL THEN 'subtotal ' || {M.format('subtotal')} || ' + tax ' || {M.format('tax')} || ' = ' || {M.format('subtotal + tax')} || ' != total ' || {TOTAL} || ' (diff ' || {M.format('abs(total - (subtotal + tax))')} || ')' WHEN subtotal > total + {TOL} THEN 'subtotal ' || {M.format('subtotal')} || ' > total ' || {TOTAL} ELSE 'total ' || {TOTAL} || ' > max explainable ' || regexp_replace(CAST(CAST(subtotal * 1.35 + {TOL} AS DECIMAL(18,6)) AS VARCHAR), '(\\.\\d\\d)(\\d*?)0+$', '\\1\\2') || ' from subtotal ' || {M.format('subtotal')} END"),
    ("P-008", "unsigned", "signature_present = false AND total > 2500", f"'unsigned, amount ' || {TOTAL} || ' > 2500.00'"),
    ("P-009", "over_limit", "total > 10000", f"'amount ' || {TOTAL} || ' > approval limit 10000.00'"),
    ("P-010", "round_amount", f"total >= {FLOOR} AND total % {STEP} = 0", f"'amount ' || {TOTAL} || ' is a multiple of ' || {STEP} || '.00'"),
    ("P-013", "low_confidence", "confidence < 0.6", "'read confidence ' || CAST(round(confidence * 100) AS INTEGER) || '% < 60%'"),
]
SEVERITY = {p[0]: p[2] for p in POLICIES}


def _row_query(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fires, found = intake_rejected(CONFIG) if rule == "P-014" else RULES[rule](CONFIG)
        docs = model.documents(spark, sf_dir)
        docs = (prepared(docs, CONFIG) if rule == "P-007" else docs).where("ingestion_status = 'accepted'" if rule != "P-014" else "true")
        return docs.where(fires).select("id", found.alias("f")).select("id", "f.severity", "f.summary")

    return run


for _rule, _name, _when, _text in ROW_SQL:
    query(docs_sql(f"SELECT id, '{SEVERITY[_rule]}' AS severity, {_text} AS summary FROM keyed WHERE ingestion_status = 'accepted' AND ({_when})"), f"{_rule.lower().replace('-', '')}_{_name}")(_row_query(_rule))

query(docs_sql("SELECT id, 'high' AS severity, 'file rejected at intake, never read' AS summary FROM keyed WHERE ingestion_status <> 'accepted'"), "p014_intake_rejected")(_row_query("P-014"))

APPROVED_SQL = """approved AS (
  SELECT DISTINCT trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS key FROM (
    SELECT n_name || ' ' || c_mktsegment || ' ' || (['Alder','Birch','Cedar','Delta','Ember','Falcon','Granite','Harbor','Indigo','Juniper','Krypton','Lumen'])[c_custkey % 12 + 1] || CASE WHEN c_custkey % 2 = 0 THEN ' Ltd' ELSE ' Limited' END AS v
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0))"""


def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on the list: four customers of five."""
    c = F.col("c_custkey")
    named = F.concat("n_name", F.lit(" "), "c_mktsegment", F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in model.WORDS]), (c % 12 + 1).cast("int")), F.when(c % 2 == 0, " Ltd").otherwise(" Limited"))
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(c % 5 != 0).select(named.alias("vendor"))


@query(docs_sql("SELECT id, vendor FROM keyed WHERE vendor IS NOT NULL AND key NOT IN (SELECT key FROM approved)", APPROVED_SQL))
def p012_unapproved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unapproved_in(model.documents(spark, sf_dir), approved(spark, sf_dir)).select("id", F.element_at("finding.evidence", "vendor").alias("vendor"))


# --- controls that compare documents ----------------------------------------------------------------------------------

ADMIT = "(p.date >= d.anchor - 180 OR abs(p.total - d.total) <= abs(d.total) * 0.0055 + 0.01)"
LATE = "NOT coalesce(p.key = d.key AND p.date >= d.anchor - 180, false)"
ORDER = f"ORDER BY {LATE}, CASE WHEN {LATE} THEN p.total END, p.id"
PAIR = "FROM keyed d JOIN keyed p ON d.id <> p.id"
DUPLICATE_SQL = "dup AS (SELECT d.id, min(p.id) AS match FROM keyed d JOIN keyed p ON d.id <> p.id AND d.key = p.key AND d.total = p.total AND d.date = p.date WHERE d.key <> '' GROUP BY d.id)"
SPLIT_SQL = f"""split AS (SELECT d.id, count(*) + 1 AS n, any_value(d.total) + sum(p.total) AS combined, string_agg(CAST(p.id AS VARCHAR), ',' {ORDER}) AS related
  {PAIR} AND d.key = p.key WHERE d.key <> '' AND d.total BETWEEN 9000 AND 10000 AND p.total BETWEEN 9000 AND 10000 AND abs(p.date - d.date) <= 14 AND {ADMIT} GROUP BY d.id)"""
NEAR_SQL = f"""cand AS MATERIALIZED (SELECT d.id, d.key, d.total, d.date, p.id AS pid, p.key AS pkey, p.total AS ptotal, p.date AS pdate, {LATE} AS late
  {PAIR} AND p.date BETWEEN d.date - 7 AND d.date + 7 AND abs(p.total - d.total) <= greatest(greatest(abs(d.total), abs(p.total)) * 0.005, 0.01)
  WHERE d.key <> '' AND p.key <> '' AND d.total <> 0 AND NOT (p.key = d.key AND p.total = d.total AND p.date = d.date)
), names AS (SELECT DISTINCT least(key, pkey) AS a, greatest(key, pkey) AS b FROM cand WHERE key <> pkey
), walk AS (
  SELECT a, b, 0 AS i, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS r, repeat('0', length(b)) AS mask, '' AS ma FROM names
  UNION ALL
  SELECT a, b, i + 1, r, CASE WHEN j IS NULL THEN mask ELSE substr(mask, 1, j - 1) || '1' || substr(mask, j + 1) END, CASE WHEN j IS NULL THEN ma ELSE ma || substr(a, i + 1, 1) END
  FROM (SELECT *, list_filter(range(greatest(1, i + 1 - r), least(i + 1 + r, length(b)) + 1), lambda p: substr(b, p, 1) = substr(a, i + 1, 1) AND substr(mask, p, 1) = '0')[1] AS j FROM walk WHERE i < length(a))
), jaro AS (
  SELECT a, b, m, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - list_count(list_filter(range(1, m + 1), lambda x: substr(ma, x, 1) <> substr(mb, x, 1))) / 2.0) / m) / 3 END AS j,
    list_count(list_filter(range(1, 5), lambda k: length(a) >= k AND length(b) >= k AND substr(a, 1, k) = substr(b, 1, k))) AS same
  FROM (SELECT a, b, ma, length(ma) AS m, list_aggregate(list_transform(list_filter(range(1, length(b) + 1), lambda p: substr(mask, p, 1) = '1'), lambda p: substr(b, p, 1)), 'string_agg', '') AS mb FROM walk WHERE i = length(a))
), alike AS (SELECT a, b, j + same * 0.1 * (1 - j) AS sim FROM jaro
), hits AS (
  SELECT cand.*, CASE WHEN key = pkey THEN 1.0 ELSE sim END AS sim FROM cand LEFT JOIN alike ON a = least(key, pkey) AND b = greatest(key, pkey) AND key <> pkey
  WHERE key = pkey OR sim >= 0.92
), near AS (
  SELECT id, CASE WHEN bool_or(sim >= 1 AND ptotal = total) THEN 'high' ELSE 'medium' END AS severity, count(*) AS n, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY late, CASE WHEN late THEN ptotal END, pid) AS related,
    round(first(sim ORDER BY late, CASE WHEN late THEN ptotal END, pid), 2) AS best_similarity
  FROM hits GROUP BY id)"""
REUSED_SQL = f"reused AS (SELECT d.id, any_value(d.ikey) AS invoice_key, string_agg(CAST(p.id AS VARCHAR), ',' {ORDER}) AS related {PAIR} AND d.key = p.key AND d.ikey = p.ikey WHERE d.key <> '' AND {ADMIT} GROUP BY d.id)"
RUNS_SQL = f"""serials AS (SELECT *, CAST(nullif(regexp_extract(ikey, '([0-9]+)$', 1), '') AS BIGINT) AS serial, regexp_replace(ikey, '[0-9]+$', '') AS prefix FROM keyed WHERE regexp_matches(ikey, '[0-9]+$')
), seen AS (
  SELECT d.id, d.serial AS own, p.serial, min(p.id) AS pid FROM serials d JOIN serials p ON d.id <> p.id AND d.key = p.key AND d.prefix = p.prefix AND p.serial <> d.serial WHERE d.key <> '' AND {ADMIT} GROUP BY ALL
  UNION ALL SELECT id, serial, serial, NULL FROM serials WHERE key <> ''
), islands AS (SELECT *, serial - row_number() OVER (PARTITION BY id ORDER BY serial) AS island FROM seen
), seq AS (SELECT id, count(*) AS run_length, min(serial) AS first, max(serial) AS last, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS related
  FROM islands GROUP BY id, own, island HAVING count(*) >= 3 AND own BETWEEN min(serial) AND max(serial))"""


def joined(found: str) -> F.Column:
    return F.array_join(F.col(found).cast("array<string>"), ",").alias("related")


@query(docs_sql("SELECT * FROM dup", DUPLICATE_SQL))
def p002_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates(*sides(spark, sf_dir), CONFIG).select("id", F.get("finding.related", F.lit(0)).alias("match"))


@query(docs_sql("SELECT id, n, combined, related FROM split", SPLIT_SQL))
def p011_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.splitting(*sides(spark, sf_dir), CONFIG)
    return f.select("id", (F.size("finding.related") + 1).cast("long").alias("n"), F.element_at("finding.evidence", "combined_total").cast("decimal(18,2)").alias("combined"), joined("finding.related"))


@query(docs_sql("SELECT id, severity, related, best_similarity FROM near", NEAR_SQL))
def p016_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.near_duplicates(*sides(spark, sf_dir), CONFIG)
    return f.select("id", "finding.severity", joined("finding.related"), F.element_at("finding.evidence", "best_similarity").cast("double").alias("best_similarity"))


@query(docs_sql("SELECT id, pid, ptotal FROM cand WHERE key = pkey", NEAR_SQL.split("), names AS")[0] + ")"))
def near_dup_same_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.near_pairs(*sides(spark, sf_dir), CONFIG).where("key = p_key").select("id", F.col("p_id").alias("pid"), F.col("p_total").alias("ptotal"))


@query(docs_sql("SELECT id, pid, round(sim, 6) AS sim FROM hits WHERE key <> pkey", NEAR_SQL))
def near_dup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.near_hits(*sides(spark, sf_dir), CONFIG).where("key <> p_key").select("id", F.col("p_id").alias("pid"), F.round("sim", 6).alias("sim"))


@query(docs_sql("SELECT id, invoice_key, related FROM reused", REUSED_SQL))
def p017_reused_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = history.reused_numbers(*sides(spark, sf_dir), CONFIG)
    return f.select("id", F.element_at("finding.evidence", "invoice_number_key").alias("invoice_key"), joined("finding.related"))


@query(docs_sql("SELECT * FROM seq", RUNS_SQL))
def p018_sequential_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sequential_runs(*sides(spark, sf_dir), CONFIG).select("id", "run_length", "first", "last", joined("related"))


@query(docs_sql("SELECT id, count(*) FILTER (sup) AS by_supplier, count(*) FILTER (amt) AS by_amount, count(*) FILTER (sup OR amt) AS admitted FROM (SELECT d.id, p.date >= d.anchor - 180 AS sup, abs(p.total - d.total) <= abs(d.total) * 0.0055 + 0.01 AS amt " + PAIR + " AND d.key = p.key WHERE d.key <> '') GROUP BY id"))
def history_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its supplier's documents each document's history admits, by either path and by both."""
    return history.admitted_counts(*sides(spark, sf_dir), CONFIG)


@query(docs_sql("SELECT id, count(*) OVER w AS docs, sum(total) OVER w AS amount FROM keyed WHERE key <> '' AND date IS NOT NULL AND total BETWEEN 9000 AND 10000 WINDOW w AS (PARTITION BY key ORDER BY date RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 14 DAY FOLLOWING)"))
def split_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and amounts near the limit around each document: a frame of days, without a join."""
    return history.near_limit_frame(sides(spark, sf_dir)[0], CONFIG)


# --- the population ---------------------------------------------------------------------------------------------------


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as a population of amounts."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("input_idx"), F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(18,4)").alias("total"))


DIGIT_SQL = """pop AS (SELECT o_orderkey AS id, abs(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders WHERE abs(CAST(o_totalprice AS DECIMAL(18,2))) >= 10
), dig AS (SELECT *, CAST(regexp_extract(CAST(total AS VARCHAR), '[1-9]', 0) AS INTEGER) AS digit FROM pop
), rows AS (SELECT d AS digit, (SELECT count(*) FROM dig WHERE dig.digit = d) AS n, (SELECT count(*) FROM dig) AS total FROM range(1, 10) t(d)
), stat AS (SELECT digit, n, n / total AS observed, log10(1 + 1.0 / digit) AS expected, greatest(abs(n / total - log10(1 + 1.0 / digit)) - 0.5 / total, 0) / sqrt(log10(1 + 1.0 / digit) * (1 - log10(1 + 1.0 / digit)) / total) AS z FROM rows)"""


@query(f"WITH {DIGIT_SQL} SELECT CAST(digit AS INTEGER) AS digit, n, round(observed, 4) AS observed, round(expected, 4) AS expected, round(z, 2) AS z FROM stat")
def benford_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.digits(payments(spark, sf_dir), CONFIG).select("digit", "n", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"), F.round("z", 2).alias("z"))


@query(f"WITH {DIGIT_SQL}, one AS (SELECT (SELECT count(*) FROM pop) AS tested, (SELECT max(total) / min(total) FROM pop) AS span, sum(abs(observed - expected)) / 9 AS mad, max_by(digit, round(z, 2) * 100 + digit) FILTER (round(observed, 4) > round(expected, 4) AND round(z, 2) > 1.96) AS worst FROM stat) SELECT tested, CASE WHEN tested >= 300 AND span >= 100 THEN round(mad, 4) END AS mad, CASE WHEN tested < 300 OR span < 100 THEN 'not_evaluated' WHEN mad <= 0.006 THEN 'close' WHEN mad <= 0.012 THEN 'acceptable' WHEN mad <= 0.015 THEN 'marginal' ELSE 'nonconformity' END AS conformity, CASE WHEN tested >= 300 AND span >= 100 AND mad > 0.015 THEN worst END AS worst_digit FROM one")
def p015_benford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.benford(payments(spark, sf_dir), CONFIG).select("tested", F.round("mad", 4).alias("mad"), "conformity", "worst_digit")


# --- verdicts and reports -------------------------------------------------------------------------------------------------

FOUND_SQL = "found AS (" + " UNION ALL ".join([f"SELECT id, '{r}' AS rule_id, '{SEVERITY[r]}' AS severity FROM keyed WHERE ingestion_status = 'accepted' AND ({w})" for r, _, w, _ in ROW_SQL] + ["SELECT id, 'P-014', 'high' FROM keyed WHERE ingestion_status <> 'accepted'"] + [f"SELECT id, '{r}', {s} FROM {t} WHERE id NOT IN (SELECT id FROM keyed WHERE ingestion_status <> 'accepted' OR vendor IS NULL)" for r, s, t in (("P-002", "'high'", "dup"), ("P-011", "'high'", "split"), ("P-016", "severity", "near"), ("P-017", "'high'", "reused"), ("P-018", "'low'", "seq"))]) + """
), results AS (
  SELECT keyed.id, CASE WHEN bool_or(severity = 'high') THEN 'blocked' WHEN bool_or(severity IN ('medium', 'low')) THEN 'review' ELSE 'pass' END AS verdict,
    CASE WHEN bool_or(severity = 'high') THEN 'high' WHEN bool_or(severity = 'medium') THEN 'medium' WHEN bool_or(severity = 'low') THEN 'low' END AS worst_severity,
    coalesce(string_agg(rule_id, ' ' ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule_id), '') AS controls
  FROM keyed LEFT JOIN found ON keyed.id = found.id GROUP BY keyed.id)"""
HISTORY_SQL = (DUPLICATE_SQL, SPLIT_SQL, NEAR_SQL, REUSED_SQL, RUNS_SQL, FOUND_SQL)


def all_sql(body: str, *more: str) -> str:
    return docs_sql(body, *HISTORY_SQL, *more)


def worded_sql(which: str, **values: str) -> str:
    """A wording as SQL text."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[which])
    return " || ".join(["'" + x.replace("'", "''") + "'" if i % 2 == 0 else f"CAST({values[x]} AS VARCHAR)" for i, x in enumerate(parts) if x])


SUB = M.format("subtotal")
TAXED = M.format("subtotal + tax")
DIFFERS = M.format("abs(total - (subtotal + tax))")
ROW_MESSAGES = {
    "P-001": f"CASE WHEN total IS NULL THEN {worded_sql('P-001')} ELSE {worded_sql('P-001 bare', total=TOTAL, limit="'75.00'")} END",
    "P-003": worded_sql("P-003"),
    "P-004": worded_sql("P-004"),
    "P-005": worded_sql("P-005", age="today - date", window="90"),
    "P-006": worded_sql("P-006", date="date"),
    "P-007": f"CASE WHEN tax IS NOT NULL THEN {worded_sql('P-007 total', label="'subtotal'", base=SUB, tax=M.format('tax'), expected=TAXED, total=TOTAL, difference=DIFFERS)} WHEN subtotal > total + {TOL} THEN {worded_sql('P-007 subtotal', base=SUB, total=TOTAL)} ELSE {worded_sql('P-007 uplift', total=TOTAL, label="'subtotal'", base=SUB)} END",
    "P-008": worded_sql("P-008", total=TOTAL, limit="'2500.00'"),
    "P-009": worded_sql("P-009", total=TOTAL, limit="'10000.00'"),
    "P-010": worded_sql("P-010", total=TOTAL),
    "P-013": worded_sql("P-013", confidence="CAST(round(confidence * 100) AS INTEGER) || '%'", least="'60%'"),
}
IDS = "array_to_string(list_transform(list_slice(string_split(related, ','), 1, 5), lambda x: '#' || x), ', ') || CASE WHEN len(string_split(related, ',')) > 5 THEN ' (+' || (len(string_split(related, ',')) - 5) || ' more)' ELSE '' END"
FIRST = "ORDER BY late, CASE WHEN late THEN ptotal END, pid"
TOLD_SQL = f"""nearest AS (SELECT id, first(pid {FIRST}) AS pid, first(ptotal {FIRST}) AS ptotal, first(pdate {FIRST}) AS pdate, first(sim {FIRST}) AS sim, count(*) AS n FROM hits GROUP BY id
), histories AS (
  SELECT id, 'P-002' AS rule_id, {worded_sql('P-002', match='match', total=TOTAL, date='date')} AS message FROM dup JOIN keyed USING (id)
  UNION ALL SELECT id, 'P-011', {worded_sql('P-011', n='n', window='14', limit="'10000.00'", combined=M.format('combined'))} FROM split
  UNION ALL SELECT id, 'P-016', {worded_sql('P-016', first='pid', more="CASE WHEN n > 1 THEN " + worded_sql('P-016 more', others='n - 1') + " ELSE '' END", amount=M.format('ptotal'), total=TOTAL, then='pdate', date='date', similarity="format('{:.2f}', sim)")} FROM nearest JOIN keyed USING (id)
  UNION ALL SELECT id, 'P-017', {worded_sql('P-017', number='invoice_key', ids=IDS)} FROM reused
  UNION ALL SELECT id, 'P-018', {worded_sql('P-018', n='run_length', first='first', last='last')} FROM seq)"""


@query(all_sql(" UNION ALL ".join([f"SELECT id, '{r}' AS rule_id, {m} AS message FROM keyed WHERE ingestion_status = 'accepted' AND ({next(w for x, _, w, _ in ROW_SQL if x == r)})" for r, m in ROW_MESSAGES.items()] + [f"SELECT id, 'P-014', {worded_sql('P-014', reason="'blank page'")} FROM keyed WHERE ingestion_status <> 'accepted'", "SELECT id, rule_id, message FROM histories WHERE id NOT IN (SELECT id FROM keyed WHERE ingestion_status <> 'accepted' OR vendor IS NULL)"]), TOLD_SQL))
def finding_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the whole audit in words."""
    return report(spark, sf_dir, "message").findings().select("id", "rule_id", "message")


@query(docs_sql(f"SELECT id, {worded_sql('P-012', vendor='vendor')} AS message FROM keyed WHERE vendor IS NOT NULL AND key NOT IN (SELECT key FROM approved)", APPROVED_SQL))
def p012_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unapproved_in(model.documents(spark, sf_dir), approved(spark, sf_dir)).select("id", "finding.message")


@query(all_sql("SELECT id, verdict, worst_severity, controls FROM results"))
def verdict_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).results.select("id", "verdict", "worst_severity", F.array_join("findings.rule_id", " ").alias("controls"))


@query(all_sql("SELECT id, rule_id FROM found WHERE id % 5 <> 0 AND rule_id IN ('P-002', 'P-011', 'P-016', 'P-017', 'P-018')"))
def ledger_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the history controls find where four documents of five are audited against a ledger of the fifth: the same as
    if all were one batch."""
    docs = model.documents(spark, sf_dir)
    past = docs.where("id % 5 = 0").select(F.col("id").alias("document_id"), "vendor", "total", "date", "invoice_number")
    found = audit_batch(docs.where("id % 5 <> 0"), past, CONFIG, day(), ("rule_id", "severity")).findings()
    return found.where(F.col("rule_id").isin(*history.RULES)).select("id", "rule_id")


@query(docs_sql("SELECT d.id, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS related FROM keyed d JOIN ledger_hits p ON d.id = p.of GROUP BY 1", NEAR_SQL, "ledger_hits AS (SELECT id AS of, pid AS id FROM hits WHERE id % 5 <> 0 AND pid % 5 = 0 AND id NOT IN (SELECT id FROM keyed WHERE ingestion_status <> 'accepted'))"))
def request_ledger_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-016 of single requests against a ledger that may spell suppliers otherwise."""
    docs = model.documents(spark, sf_dir)
    past = docs.where("id % 5 = 0").select(F.col("id").alias("document_id"), "vendor", "total", "date", "invoice_number")
    none = F.lit(None).cast("array<struct<document_id: bigint, vendor: string, total: decimal(18,4), date: date, invoice_number: string>>")
    found = audit_requests(docs.where("id % 5 <> 0").withColumn("history", none), past, CONFIG, day()).select("id", F.explode("findings").alias("f")).where("f.rule_id = 'P-016'")
    return found.select("id", F.array_join(F.sort_array("f.related").cast("array<string>"), ",").alias("related"))


@query(all_sql("SELECT count(*) AS documents, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'blocked') AS blocked FROM results"))
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).summary()


@query(all_sql("SELECT rule_id, count(*) AS n FROM found GROUP BY 1"))
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).by_rule().where("scope = 'document'").select("rule_id", "n")


@query(all_sql("SELECT id, verdict, controls FROM results WHERE verdict <> 'pass' ORDER BY id LIMIT 40"))
def flagged_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flagged(report(spark, sf_dir).results, 40)


@query(all_sql("SELECT results.id, verdict, controls, coalesce(CASE WHEN regexp_matches(vendor, '^[=+\\-@\\t\\r]') THEN '''' || vendor ELSE vendor END, '') AS vendor, CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) AS total, CAST(date AS VARCHAR) AS date FROM results JOIN keyed ON results.id = keyed.id"))
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.export(report(spark, sf_dir).results).select("id", "verdict", "controls", "vendor", "total", "date")


@query(all_sql("SELECT found.id, rule_id, title, category FROM found JOIN (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', '{p[3]}')" for p in POLICIES).replace("Benford's", "Benford''s") + ") p(policy_id, title, category) ON rule_id = policy_id"))
def policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_policy(report(spark, sf_dir).findings()).select("id", "rule_id", "title", "category")


RELATED_SQL = """rel AS (
  SELECT id, match AS rid FROM dup UNION SELECT id, CAST(unnest(string_split(related, ',')) AS BIGINT) FROM split UNION SELECT id, CAST(unnest(string_split(related, ',')) AS BIGINT) FROM near
  UNION SELECT id, CAST(unnest(string_split(related, ',')) AS BIGINT) FROM reused UNION SELECT id, CAST(unnest(string_split(related, ',')) AS BIGINT) FROM seq
), placed AS (SELECT id, rid, row_number() OVER (PARTITION BY id ORDER BY rid) AS place FROM rel WHERE id NOT IN (SELECT id FROM keyed WHERE ingestion_status <> 'accepted' OR vendor IS NULL))"""


@query(all_sql("SELECT placed.id, rid AS related_id, verdict FROM placed JOIN results ON rid = results.id WHERE place <= 50", RELATED_SQL))
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report(spark, sf_dir, "related")
    return reports.related_documents(r.findings(), r.results)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions from the event stream: run numbers below the number of orders."""
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))))  # one row
    kind = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("needs_info")
    return e.select((F.col("event_id") % F.col("n")).cast("string").alias("run_id"), F.col("event_id").alias("decision_id"), F.col("user_id").cast("string").alias("reviewer"), kind.alias("decision"), F.col("ts").alias("decided_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit runs by the row-local controls alone."""
    docs = with_findings(model.documents(spark, sf_dir), CONFIG).persist()
    from .audit import verdict

    return docs.select(F.col("id").cast("string").alias("run_id"), "id", verdict(F.col("findings")).alias("verdict"), "findings")


REVIEWS_SQL = "reviews AS (SELECT CAST(event_id % (SELECT count(*) FROM orders) AS VARCHAR) AS run_id, event_id AS decision_id, CAST(user_id AS VARCHAR) AS reviewer, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'needs_info' END AS decision, ts AS decided_at FROM events), latest AS (SELECT run_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id FROM reviews GROUP BY 1), last AS (SELECT r.* FROM reviews r JOIN latest USING (run_id, decision_id))"
RUNS_TABLE_SQL = "rowfound AS (" + " UNION ALL ".join([f"SELECT id, '{r}' AS rule_id, '{SEVERITY[r]}' AS severity FROM keyed WHERE ingestion_status = 'accepted' AND ({w})" for r, _, w, _ in ROW_SQL] + ["SELECT id, 'P-014', 'high' FROM keyed WHERE ingestion_status <> 'accepted'"]) + "), runs AS (SELECT CAST(keyed.id AS VARCHAR) AS run_id, keyed.id, CASE WHEN bool_or(severity = 'high') THEN 'blocked' WHEN bool_or(severity IN ('medium', 'low')) THEN 'review' ELSE 'pass' END AS verdict FROM keyed LEFT JOIN rowfound ON keyed.id = rowfound.id GROUP BY keyed.id)"


@query(f"WITH {REVIEWS_SQL} SELECT run_id, decision_id, reviewer, decision FROM last")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_reviews(reviews(spark, sf_dir)).select("run_id", "decision_id", "reviewer", "decision")


@query(docs_sql("SELECT count(*) AS reviewer_overrides FROM last JOIN runs USING (run_id) WHERE decision = 'approved' AND verdict = 'blocked'", REVIEWS_SQL, RUNS_TABLE_SQL))
def reviewer_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return reports.period_summary(r, r.select("id", F.explode("findings").alias("f")).select("id", "f.rule_id"), reviews(spark, sf_dir))[2]


@query(docs_sql("SELECT place, v.verdict, (SELECT count(*) FROM runs WHERE runs.verdict = v.verdict) AS n FROM (VALUES (1, 'pass'), (2, 'review'), (3, 'blocked')) v(place, verdict)", RUNS_TABLE_SQL))
def period_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return reports.period_summary(r, r.select("id", F.explode("findings").alias("f")).select("id", "f.rule_id"), reviews(spark, sf_dir))[0]


@query(docs_sql("SELECT runs.id, verdict, reviewer, decision FROM runs LEFT JOIN last USING (run_id) WHERE verdict <> 'pass'", REVIEWS_SQL, RUNS_TABLE_SQL))
def exception_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_findings(model.documents(spark, sf_dir), CONFIG).persist()
    from .audit import verdict, worst

    res = docs.withColumn("verdict", verdict(F.col("findings"))).withColumn("worst_severity", worst(F.col("findings")))
    return reports.exceptions(res, reviews(spark, sf_dir), held_only=True).select("id", "verdict", "reviewer", "decision")


@query(docs_sql("SELECT id, verdict FROM runs ORDER BY id DESC LIMIT 50", RUNS_TABLE_SQL))
def queue_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.queue(runs(spark, sf_dir), 50).select("id", "verdict")


def queries() -> dict[str, Query]:
    from . import function_queries, source_queries  # noqa: F401  add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
