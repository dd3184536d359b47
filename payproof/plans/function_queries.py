"""Queries over single functions, search and metrics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import lenient_date, receipt_date, strict_date
from ..functions.money import lenient_money, receipt_money, strict_money
from ..operators import metrics, search
from ..operators.rows import line_item_total, with_findings
from ..policies import POLICIES, policies
from ..sources.corpora import group_spending
from ..sources.documents import repeated_ids, unknown_keys
from . import model
from .audit import audit_requests
from .model import table
from .queries import CONFIG, RUNS_TABLE_SQL, day, docs_sql, query


@query(docs_sql("SELECT DISTINCT vendor, key FROM keyed WHERE vendor IS NOT NULL"))
def vendor_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(spark, sf_dir).where("vendor is not null").select("vendor").distinct().withColumn("key", T.vendor_key(F.col("vendor")))


@query(docs_sql("SELECT id, ikey, CASE WHEN length(regexp_extract(ikey, '([0-9]+)$', 1)) BETWEEN 1 AND 18 THEN regexp_replace(ikey, '[0-9]+$', '') END AS prefix, CAST(TRY_CAST(nullif(regexp_extract(ikey, '([0-9]+)$', 1), '') AS BIGINT) AS VARCHAR) AS serial FROM keyed WHERE ikey IS NOT NULL"))
def invoice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.invoice_key(F.col("invoice_number"))
    return model.documents(spark, sf_dir).where(k.isNotNull()).select("id", k.alias("ikey"), T.invoice_prefix(k).alias("prefix"), T.invoice_serial(k).cast("string").alias("serial"))


@query("SELECT o_orderkey AS id, CAST(nullif(regexp_extract(CAST(abs(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR), '[1-9]', 0), '') AS INTEGER) AS digit FROM orders")
def first_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.first_digit(F.col("o_totalprice").cast("decimal(18,2)")).alias("digit"))


@query("SELECT l_orderkey AS id, sum(CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS DECIMAL(18,4)) * CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) END)::DECIMAL(38,4) AS total FROM lineitem WHERE l_linenumber % 5 <> 4 GROUP BY 1")
def line_items_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders from nested lines: with an amount, with quantity and price, or with neither."""
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(12,2)").cast("decimal(18,4)")
    usable = n % 5 != 4
    item = F.struct(F.lit("Item").alias("name"), F.when(usable, F.col("l_quantity").cast("decimal(18,4)")).alias("quantity"), F.when(usable, price).alias("unit_price"), F.when((n % 3 != 0) & usable, price).alias("amount"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("line_items"))
    return lists.select("id", line_item_total(F.col("line_items")).cast("decimal(38,4)").alias("total")).where("total is not null")


AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written in many ways."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    whole, part = p.cast("bigint"), F.substring_index(p.cast("string"), ".", -1)
    comma = F.format_number(p, 2)
    dots = F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), part)
    forms = [p.cast("string"), F.concat(F.lit("£"), comma), F.concat(F.lit("("), comma, F.lit(")")), dots, F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.concat(F.lit(" "), p.cast("string"), F.lit(" ")), F.lit("n/a"), F.concat(F.lit("-"), p.cast("string"))]
    out = F.when(F.lit(False), "")
    for i, form in enumerate(forms):
        out = out.when(k % 8 == i, form)
    return table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"), p.alias("p"))


MONEY_SQL = "m AS (SELECT o_orderkey AS id, o_orderkey % 8 AS form, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS whole, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 100 AS part FROM orders)"


@query(f"WITH {MONEY_SQL} SELECT id, CAST(CASE WHEN form IN (0, 5) THEN p WHEN form = 7 THEN -p WHEN form = 4 AND whole < 1000000 THEN CASE WHEN whole < 1000 THEN whole ELSE whole // 1000 + (whole % 1000) / 1000.0 END END AS DECIMAL(18,4)) AS amount FROM m")
def strict_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(spark, sf_dir).select("id", strict_money(F.col("text")).alias("amount"))


@query(f"WITH {MONEY_SQL} SELECT id, CAST(CASE WHEN form IN (0, 1, 5) THEN p WHEN form IN (2, 7) THEN -p WHEN form = 3 AND whole < 1000 THEN whole * 100 + part WHEN form = 3 AND whole < 1000000 THEN ((whole * 100 + part + 5) // 10) / 10000.0 WHEN form = 4 AND whole < 1000 THEN whole WHEN form = 4 AND whole < 1000000 THEN whole // 1000 + (whole % 1000) / 1000.0 END AS DECIMAL(18,4)) AS amount FROM m")
def lenient_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(spark, sf_dir).select("id", lenient_money(F.col("text")).alias("amount"))


@query(f"WITH {MONEY_SQL} SELECT id, CAST(CASE WHEN form IN (0, 1, 2, 3, 5) THEN p WHEN form = 4 THEN whole WHEN form = 7 THEN -p END AS DECIMAL(18,4)) AS amount FROM m")
def receipt_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(spark, sf_dir).select("id", receipt_money(F.col("text")).alias("amount"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    patterns = ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "yyyy-MM-dd 00:00:00", "d MMM yyyy", "MM/dd/yyyy", "MMMM d, yyyy")
    out = F.when(F.lit(False), "")
    for i, p in enumerate(patterns):
        out = out.when(k % 9 == i, F.date_format(d, p))
    return table(spark, sf_dir, "orders").select(k.alias("id"), out.alias("text"))


DATES_SQL = "d AS (SELECT o_orderkey AS id, o_orderkey % 9 AS form, CAST(o_orderdate AS DATE) AS day FROM orders)"
SWAP = "make_date(year(day), day(day), month(day))"


@query(f"WITH {DATES_SQL} SELECT id, CASE WHEN form = 0 THEN day END AS date FROM d")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates(spark, sf_dir).select("id", strict_date(F.col("text")).alias("date"))


@query(f"WITH {DATES_SQL} SELECT id, CASE WHEN form < 7 THEN day WHEN form = 7 AND day(day) <= 12 THEN {SWAP} END AS date FROM d")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates(spark, sf_dir).select("id", lenient_date(F.col("text")).alias("date"))


@query(f"WITH {DATES_SQL} SELECT id, CASE WHEN form IN (1, 2) AND day(day) <= 12 THEN {SWAP} WHEN form IN (4, 5) THEN NULL ELSE day END AS date FROM d")
def receipt_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates(spark, sf_dir).select("id", receipt_date(F.col("text")).alias("date"))


@query("SELECT event_id AS id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS safe FROM (SELECT event_id, (['=', '+', '-', '@', '', 'x'])[event_id % 6 + 1] || event_type AS t FROM events)")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(*[F.lit(m) for m in ("=", "+", "-", "@", "", "x")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.csv_safe(F.concat(marks, "event_type")).alias("safe"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'note' WHEN o_orderkey % 3 = 1 THEN 'note,o_custkey' ELSE '' END AS unknown FROM orders")
def unknown_keys_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    json = F.to_json(F.struct(k.alias("id"), F.col("o_totalprice").cast("string").alias("total"), F.when(k % 3 == 1, F.col("o_custkey")).alias("o_custkey"), F.when(k % 3 != 2, F.lit("x")).alias("note")))
    return o.select(k.alias("id"), F.array_join(unknown_keys(json, ("id", "total")), ",").alias("unknown"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS transaction, 'Supplier ' || arg_min(l_suppkey, l_linenumber * 100000000 + l_suppkey) AS vendor, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) + round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)) AS DECIMAL(18,4)) AS total FROM lineitem GROUP BY l_orderkey")
def net_vat_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spending list with net and tax rows, one document per transaction."""
    price, place = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_linenumber") * 100_000_000 + F.col("l_suppkey")
    row = lambda amount: F.struct(amount.cast("string").alias("amount"))
    both = F.explode(F.array(row(price), row(F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), place.alias("input_idx"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("supplier"), F.col("l_shipdate").cast("date").cast("string").alias("date"), both.alias("x")).select("*", "x.amount")
    return group_spending(rows, "key", "amount", "supplier", "date").select("transaction", "vendor", "total")


@query(docs_sql("SELECT DISTINCT vendor FROM keyed WHERE vendor IS NOT NULL AND id % 7 <> 3"))
def approved_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a document that is not of the ghost kind."""
    from ..sources.corpora import approved_vendors as of

    kinds = model.documents(spark, sf_dir).withColumn("fraud_type", F.when(F.col("id") % 7 == 3, "ghost_vendor").otherwise("none"))
    return of(kinds)


@query(docs_sql("SELECT id, CASE WHEN id % 2 = 0 AND ingestion_status = 'accepted' THEN 'P-002 P-011 P-016 P-017 P-018' ELSE '' END AS not_evaluated FROM keyed"))
def not_evaluated_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with no history (even ids) or an empty one: only the first are not evaluated."""
    empty = F.array().cast("array<struct<document_id: bigint, vendor: string, total: decimal(18,4), date: date, invoice_number: string>>")
    asked = model.documents(spark, sf_dir).withColumn("history", F.when(F.col("id") % 2 == 1, empty))
    return audit_requests(asked, None, CONFIG, day()).select("id", F.array_join("not_evaluated", " ").alias("not_evaluated"))


# --- search ---------------------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TERMS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + STOP + "))"
QUOTED = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in p) + ")" for p in POLICIES)
SEARCH_SQL = f"""pol(id, title, severity, category, body, tags) AS (VALUES {QUOTED}
), asked AS (SELECT event_type AS qid, event_type || ' ' || (SELECT string_agg(n_name, ' ' ORDER BY n_name) FROM nation WHERE n_nationkey < 3) || ' duplicate invoice amount' AS q FROM events GROUP BY 1
  UNION ALL SELECT 'doc' || id, summary FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'no supplier name' WHEN id % 4 = 1 THEN 'unsigned, amount above limit' WHEN id % 4 = 2 THEN 'dated after audit date, future' ELSE 'amount is a round multiple' END AS summary FROM keyed)
), pterm AS (SELECT id AS doc, unnest(list_concat(list_concat({TERMS.format('title')}, {TERMS.format('title')}), list_concat({TERMS.format('title')}, {TERMS.format('tags')}), list_concat({TERMS.format('tags')}, {TERMS.format('tags')}), list_concat({TERMS.format('category')}, {TERMS.format('category')}), {TERMS.format('body')})) AS term FROM pol
), df AS (SELECT term, count(DISTINCT doc) AS df FROM pterm GROUP BY 1
), ptf AS (SELECT doc, term, (1 + ln(count(*))) * (ln(19.0 / (any_value(df.df) + 1)) + 1) AS w FROM pterm JOIN df USING (term) GROUP BY doc, term
), pvec AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM ptf
), qterm AS (SELECT qid, unnest({TERMS.format('q')}) AS term FROM asked
), qtf AS (SELECT qid, qterm.term, (1 + ln(count(*))) * (ln(19.0 / (coalesce(any_value(df.df), 0) + 1)) + 1) AS w FROM qterm LEFT JOIN df ON qterm.term = df.term GROUP BY qid, qterm.term
), qvec AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qtf
), scored AS (SELECT qid, doc, sum(q.w * p.w) AS score FROM qvec q JOIN pvec p USING (term) GROUP BY ALL HAVING sum(q.w * p.w) > 0.01
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS place FROM scored)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to the controls: one per kind of event, and remarks on documents."""
    names = table(spark, sf_dir, "nation").where("n_nationkey < 3").agg(F.array_join(F.sort_array(F.collect_list("n_name")), " ").alias("names"))
    events = table(spark, sf_dir, "events").select("event_type").distinct().crossJoin(F.broadcast(names))  # one row
    first = events.select(F.col("event_type").alias("query_id"), F.concat("event_type", F.lit(" "), "names", F.lit(" duplicate invoice amount")).alias("query"))
    d = model.documents(spark, sf_dir)
    k = F.col("id") % 4
    remark = F.when(k == 0, "no supplier name").when(k == 1, "unsigned, amount above limit").when(k == 2, "dated after audit date, future").otherwise("amount is a round multiple")
    return first.unionByName(d.select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("query_id"), remark.alias("query")))


@query(docs_sql("SELECT qid AS query_id, doc AS policy_id, round(score, 6) AS score, place FROM ranked WHERE place <= 3", SEARCH_SQL))
def policy_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(asked(spark, sf_dir), policies(spark)).select("query_id", "policy_id", F.round("score", 6).alias("score"), "place")


EXPECT = "CASE {} % 4 WHEN 0 THEN 'P-003' WHEN 1 THEN 'P-008' WHEN 2 THEN 'P-006' ELSE 'P-010' END"


@query(docs_sql(f"SELECT count(*) AS n, avg(CAST(place = 1 AS INTEGER)) AS hit_at_1, avg(CAST(place IS NOT NULL AND place <= 3 AS INTEGER)) AS hit_at_k, avg(CASE WHEN place <= 3 THEN 1.0 / place ELSE 0 END) AS mrr FROM (SELECT DISTINCT qid FROM ranked WHERE qid LIKE 'doc%') a LEFT JOIN ranked r ON a.qid = r.qid AND r.doc = {EXPECT.format('CAST(substr(a.qid, 4) AS BIGINT)')}", SEARCH_SQL))
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and reciprocal rank of the search over remarks, each about one control."""
    hits = search.search(asked(spark, sf_dir).where("query_id like 'doc%'"), policies(spark))
    lists = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "policy_id"))), lambda x: x["policy_id"]).alias("retrieved"))
    k = F.substring("query_id", 4, 20).cast("bigint") % 4
    return metrics.retrieval(lists.withColumn("expected", F.when(k == 0, "P-003").when(k == 1, "P-008").when(k == 2, "P-006").otherwise("P-010")))


# --- metrics ----------------------------------------------------------------------------------------------------------------

EXPECTED_SQL = "want AS (SELECT id, unnest(list_filter([CASE WHEN id % 50 = 1 THEN 'P-007' END, CASE WHEN id % 40 = 2 THEN 'P-010' END, CASE WHEN id % 97 = 3 THEN 'P-003' END, CASE WHEN id % 89 = 5 THEN 'P-004' END], lambda x: x IS NOT NULL)) AS rule_id FROM keyed), marks AS (SELECT coalesce(w.rule_id, f.rule_id) AS rule_id, w.rule_id IS NOT NULL AS want, f.rule_id IS NOT NULL AS got FROM want w FULL JOIN rowfound f ON w.id = f.id AND w.rule_id = f.rule_id), conf AS (SELECT rule_id, count(*) FILTER (want AND got) AS tp, count(*) FILTER (got AND NOT want) AS fp, count(*) FILTER (want AND NOT got) AS fn FROM marks GROUP BY 1)"
PRF_SQL = "round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the controls that their making should raise, and those that row-local controls raise."""
    k = F.col("id")
    want = F.array_compact(F.array(F.when(k % 50 == 1, "P-007"), F.when(k % 40 == 2, "P-010"), F.when(k % 97 == 3, "P-003"), F.when(k % 89 == 5, "P-004")))
    kind = F.when(k % 50 == 1, "altered_total").when(k % 40 == 2, "round_number_amount").when(k % 97 == 3, "no_vendor").when(k % 60 == 7, "mismatched_po").otherwise("none")
    return with_findings(model.documents(spark, sf_dir), CONFIG).select("id", kind.alias("kind"), want.alias("expected"), F.col("findings.rule_id").alias("fired"))


@query(docs_sql(f"SELECT *, {PRF_SQL} FROM conf", RUNS_TABLE_SQL, EXPECTED_SQL))
def prf_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_rule(cases(spark, sf_dir))


@query(docs_sql(f"SELECT tp, fp, fn, {PRF_SQL}, (SELECT round(avg(CAST(a.r IS NOT DISTINCT FROM b.r AS INTEGER)), 4) FROM (SELECT keyed.id, list_sort(list(rule_id) FILTER (rule_id IS NOT NULL)) AS r FROM keyed LEFT JOIN want USING (id) GROUP BY 1) a JOIN (SELECT keyed.id, list_sort(list(rule_id) FILTER (rule_id IS NOT NULL)) AS r FROM keyed LEFT JOIN rowfound USING (id) GROUP BY 1) b USING (id)) AS exact_match FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM conf)", RUNS_TABLE_SQL, EXPECTED_SQL))
def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro(cases(spark, sf_dir))


KIND_SQL = "CASE WHEN id % 50 = 1 THEN 'altered_total' WHEN id % 40 = 2 THEN 'round_number_amount' WHEN id % 97 = 3 THEN 'no_vendor' WHEN id % 60 = 7 THEN 'mismatched_po' ELSE 'none' END"


@query(docs_sql(f"""SELECT count(*) FILTER (len(w) > 0) AS expected_cases, count(*) FILTER (len(w) > 0 AND list_has_all(f, w)) AS caught, count(*) FILTER (kind <> 'none' AND len(w) = 0) AS uncovered,
  count(*) FILTER (kind = 'none' AND NOT list_has_all(e, f)) AS noisy_clean, sum(len(f))::BIGINT AS fired FROM (
  SELECT keyed.id, {KIND_SQL} AS kind, coalesce((SELECT list(rule_id) FROM want WHERE want.id = keyed.id), []) AS e, coalesce((SELECT list(rule_id) FROM want WHERE want.id = keyed.id AND rule_id IN ('P-007', 'P-010')), []) AS w, coalesce((SELECT list(rule_id) FROM rowfound WHERE rowfound.id = keyed.id), []) AS f FROM keyed)""", RUNS_TABLE_SQL, EXPECTED_SQL))
def detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases caught, kinds without a control, and noise on clean documents."""
    return metrics.detection(cases(spark, sf_dir), ["P-007", "P-010"])


CAL_SQL = "bins AS (SELECT CAST(least(floor(confidence * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(CAST(total > 1000 AS INTEGER)) AS accuracy, avg(confidence) AS mean_confidence FROM keyed WHERE total IS NOT NULL GROUP BY 1)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.documents(spark, sf_dir).where("total is not null").select("confidence", (F.col("total") > 1000).alias("correct"))


@query(docs_sql("SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence, round(abs(accuracy - mean_confidence), 6) AS gap FROM bins", CAL_SQL))
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(outcomes(spark, sf_dir)).select("bin", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_confidence", "gap")])


@query(docs_sql("SELECT round(sum(abs(accuracy - mean_confidence) * n) / sum(n), 6) AS ece FROM bins", CAL_SQL))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(outcomes(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query(f"SELECT tp, fp, fn, {PRF_SQL} FROM (SELECT sum(least(p, g))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM (SELECT coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM (SELECT c_nationkey AS k, count(*) AS p FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS g FROM supplier GROUP BY 1) b USING (k)))")
def multiset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multiset_score(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("SELECT event_id AS id, array_to_string(list_filter(['triage', CASE WHEN a THEN 'load_image' END, CASE WHEN a AND p THEN 'read_fields' END, CASE WHEN a AND p AND s THEN 'detect_signature' END, CASE WHEN a AND p THEN 'history' END, 'evaluate', CASE WHEN c THEN 'check_citations' END], lambda x: x IS NOT NULL), '>') AS route FROM (SELECT event_id, event_type <> 'error' AS a, event_id % 3 > 0 AS p, event_id % 2 = 0 AS s, event_id % 5 = 0 AS c FROM events)")
def expected_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    flags = table(spark, sf_dir, "events").select(k.alias("id"), (F.col("event_type") != "error").alias("intake_accepted"), (k % 3 > 0).alias("page_loaded"), (k % 2 == 0).alias("signature_enabled"), (k % 5 == 0).alias("check_citations"))
    return metrics.expected_route(flags).select("id", F.array_join("route", ">").alias("route"))


@query("SELECT count(*) AS calls, sum(event_id % 900)::BIGINT AS input_tokens, sum(event_id % 70)::BIGINT AS output_tokens, sum(CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 100 AS DECIMAL(18,6)) / 1000 END)::DECIMAL(18,6) AS cost_usd, count(*) FILTER (event_id % 4 = 0) AS unpriced_calls FROM events")
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    calls = table(spark, sf_dir, "events").select((k % 900).alias("input_tokens"), (k % 70).alias("output_tokens"), F.when(k % 4 > 0, (k % 100).cast("decimal(18,6)") / 1000).cast("decimal(18,6)").alias("cost_usd"))
    return metrics.usage(calls).withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)"))


@query("SELECT count(*) FILTER (q) AS ran, count(*) FILTER (q AND NOT t) AS unsupported, round(count(*) FILTER (q AND t) / count(*) FILTER (q), 6) AS faithfulness FROM (SELECT event_id % 3 > 0 AS q, event_type <> 'error' AS t FROM events)")
def citation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3 > 0).alias("ran"), (F.col("event_type") != "error").alias("supported"))
    return metrics.citations(e).withColumn("faithfulness", F.round("faithfulness", 6))
