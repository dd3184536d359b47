"""Each control at its boundaries, and the whole audit."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from payproof.config import Config
from payproof.functions.similarity import jaro_winkler, may_match, signature, similarity
from payproof.operators import history, population, reports
from payproof.plans.audit import audit_batch, audit_requests

from .helpers import D, TODAY, docs, fired, schema

DAY = dt.date(2026, 6, 20)
BOUNDS = [
    ("P-001", {"total": None}, {"total": D("75.00"), "vendor": None, "date": None}),
    ("P-001", {"total": D("75.01"), "vendor": None, "date": None}, {"total": D("500.01"), "vendor": None}),
    ("P-003", {"vendor": None}, {"vendor": "---"}),
    ("P-004", {"date": None}, {}),
    ("P-005", {"date": TODAY - dt.timedelta(91)}, {"date": TODAY - dt.timedelta(90)}),
    ("P-006", {"date": TODAY + dt.timedelta(1)}, {"date": TODAY}),
    ("P-007", {"subtotal": D("100"), "tax": D("12"), "total": D("117")}, {"subtotal": D("100"), "tax": D("12"), "total": D("112.05")}),
    ("P-007", {"line_items": [{"amount": D("20")}], "total": D("60")}, {"subtotal": D("100"), "total": D("117")}),
    ("P-007", {"line_items": [{"amount": D("50")}], "total": D("40")}, {"line_items": [{"quantity": D("3")}], "total": D("40")}),
    ("P-007", {"line_items": [{"quantity": D("2"), "unit_price": D("10")}, {"unit_price": D("5")}], "subtotal": D("30"), "total": None}, {"line_items": [{"quantity": D("2"), "unit_price": D("10")}, {"unit_price": D("5")}], "subtotal": D("25"), "total": D("25")}),
    ("P-007", {"currency": "usd", "subtotal": D("1000"), "tax": D("0"), "total": D("1060")}, {"currency": " idr ", "subtotal": D("1000"), "tax": D("0"), "total": D("1060")}),
    ("P-008", {"signature_present": False, "total": D("2500.01")}, {"signature_present": False, "total": D("2500.00")}),
    ("P-008", {"signature_present": False, "total": D("9000.01")}, {"signature_present": None, "total": D("9000.01")}),
    ("P-009", {"total": D("10000.01")}, {"total": D("10000.00")}),
    ("P-010", {"total": D("500.00")}, {"total": D("400.00")}),
    ("P-010", {"total": D("1500")}, {"total": D("1500"), "currency": "jpy"}),
    ("P-013", {"confidence": 0.59}, {"confidence": 0.6}),
]


def test_row_controls_at_their_bounds(spark):
    rows = list(itertools.chain.from_iterable(({**yes, "id": 2 * i}, {**no, "id": 2 * i + 1}) for i, (_, yes, no) in enumerate(BOUNDS)))
    for r in rows:
        r.setdefault("vendor", f"Only {chr(65 + r['id'] // 26)}{chr(65 + r['id'] % 26)}")
    got = fired(audit_batch(docs(spark, *rows), None, Config(), TODAY).results)
    for i, (rule, yes, no) in enumerate(BOUNDS):
        assert rule in got[2 * i], (rule, yes)
        assert rule not in got[2 * i + 1], (rule, no)


def test_switches_and_lists(spark):
    d = docs(spark, {"total": D("20000"), "date": dt.date(2020, 1, 1), "vendor": "Acme, Ltd."}, {"vendor": "Other"})
    c = Config(approval_limit_enabled=False, stale_check_enabled=False, approved_vendors=("ACME LTD",), round_floor=D("1"), round_step=D("0"))
    got = fired(audit_batch(d, None, c, TODAY).results)
    assert got == {1: [], 2: ["P-012"]}
    assert [r["id"] for r in history.unapproved_in(d, spark.createDataFrame([("acme ltd",)], "vendor string")).collect()] == [2]


def test_rejected_files_have_one_finding(spark):
    r = audit_batch(docs(spark, {"ingestion_status": "rejected", "reject_reason": "blank", "total": None}), None, Config(), TODAY).results.first()
    assert [f["rule_id"] for f in r["findings"]] == ["P-014"] and r["verdict"] == "blocked" and r["findings"][0]["evidence"]["reject_reason"] == "blank"


def test_history_controls(spark):
    rows = [
        {"id": 10, "vendor": "Dup Co", "total": D("321.17"), "date": DAY},
        {"id": 11, "vendor": "DUP  co.", "total": D("321.17"), "date": DAY},
        {"id": 12, "vendor": "Dup Co", "total": D("321.17"), "date": DAY},
        {"id": 20, "vendor": "Split", "total": D("9000"), "date": DAY},
        {"id": 21, "vendor": "Split", "total": D("10000"), "date": DAY - dt.timedelta(14)},
        {"id": 22, "vendor": "Split", "total": D("9500"), "date": DAY - dt.timedelta(15)},
        {"id": 30, "vendor": "Northwind Traders", "total": D("412.73"), "date": DAY, "invoice_number": "NW-0042"},
        {"id": 31, "vendor": "Northwind Tradres", "total": D("412.80"), "date": DAY - dt.timedelta(7), "invoice_number": "x"},
        {"id": 32, "vendor": "northwind traders", "total": D("50.11"), "date": DAY - dt.timedelta(60), "invoice_number": "nw 0042"},
        {"id": 33, "vendor": "Northwind Traders", "total": D("7.13"), "date": DAY - dt.timedelta(400), "invoice_number": "NW0042"},
        {"id": 40, "vendor": "Seq", "invoice_number": "SC-101", "total": D("11.31")},
        {"id": 41, "vendor": "Seq", "invoice_number": "SC-102", "total": D("22.47")},
        {"id": 42, "vendor": "Seq", "invoice_number": "SC-103", "total": D("33.59")},
        {"id": 43, "vendor": "Seq", "invoice_number": "SC-105", "total": D("44.73")},
        {"id": 50, "vendor": "Same Again", "total": D("64.21"), "date": DAY},
        {"id": 51, "vendor": "Same Again", "total": D("64.21"), "date": DAY + dt.timedelta(3)},
    ]
    ledger = spark.createDataFrame([(10, "Dup co", D("321.17"), DAY, None), (900, "Seq", D("55.0"), DAY, "SC-104")], "document_id long, vendor string, total decimal(18,4), date date, invoice_number string")
    for book, run in ((None, 3), (ledger, 5)):
        found = {(r["id"], f["rule_id"]): f for r in audit_batch(docs(spark, *rows), book, Config(), TODAY).results.collect() for f in r["findings"]}
        assert found[10, "P-002"]["related"] == [11] and found[11, "P-002"]["related"] == [10] and found[12, "P-002"]["related"] == [10]
        assert found[20, "P-011"]["related"] == [21] and found[20, "P-011"]["evidence"]["combined_total"] == "19000.00"
        assert found[21, "P-011"]["related"] == [20, 22]
        assert found[30, "P-016"]["severity"] == "medium" and found[30, "P-016"]["related"] == [31]
        assert found[50, "P-016"]["severity"] == "high"
        assert found[30, "P-017"]["related"] == [32] and (33, "P-017") in found
        seq = found[40, "P-018"]
        assert int(seq["evidence"]["run_length"]) == run and seq["severity"] == "low"
        if not book:
            assert seq["related"] == [41, 42] and (43, "P-018") not in found


def brute_near(rows, c):
    out = set()
    for a, b in itertools.permutations(rows, 2):
        if a["total"] and abs((a["date"] - b["date"]).days) <= 7 and a["vendor"] == b["vendor"]:
            tol = max(max(abs(a["total"]), abs(b["total"])) * c.near_dup_amount_ratio, D("0.01"))
            if abs(a["total"] - b["total"]) <= tol and (a["total"], a["date"]) != (b["total"], b["date"]):
                out.add((a["id"], b["id"]))
    return out


def test_band_join_misses_nothing(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        t = rng.choice([D("0.01"), D("0.02"), D("1.95"), D("2.00"), D("2.01"), D("100"), D("-100"), D("99999.99")]) * (1 + D(rng.randint(-60, 60)) / 10000)
        rows.append({"id": i, "input_idx": i, "vendor": "V", "total": t.quantize(D("0.01")), "date": DAY + dt.timedelta(rng.randint(0, 12))})
    d, p = history.keyed(docs(spark, *rows), None, Config(), TODAY)
    got = {(r["id"], r["p_id"]) for r in history.near_pairs(d, p, Config()).collect()}
    assert got == brute_near(rows, Config()) and len(got) > 1000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_cells_are_cut_into_slots(spark):
    """Thousands of equal round amounts in one week: the same pairs whatever the slots, and unlike names stop inside the join."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(3000)]
    names += [n[:5] + n[6] + n[5] + n[7:] for n in names[:200]]
    d = spark.createDataFrame([(i, n, DAY + dt.timedelta(i % 5)) for i, n in enumerate(names)], "id long, vendor string, date date").select("id", F.col("id").alias("input_idx"), "vendor", F.lit("5000").cast("decimal(18,4)").alias("total"), "date", F.lit(TODAY).alias("today"), F.lit(None).cast("string").alias("invoice_number"))
    kept, priors = history.keyed(d, None, Config(), TODAY)
    cut = {(r["id"], r["p_id"]) for r in history.near_pairs(kept, priors, Config(), cell_rows=100).select("id", "p_id").collect()}
    whole = {(r["id"], r["p_id"]) for r in history.near_pairs(kept, priors, Config(), cell_rows=10**6).select("id", "p_id").collect()}
    assert cut == whole and len(cut) < 0.02 * len(names) ** 2
    assert {(i, 3000 + i) for i in range(200) if 0.92 <= similarity(names[i], names[3000 + i]) < 1} <= cut
    kept.unpersist()


def numbered(spark, rows):
    made = [(i, i, "Run Co", DAY - dt.timedelta(age), D(total), f"N-{n}", TODAY) for i, (n, age, total) in enumerate(rows)]
    d = spark.createDataFrame(made, schema(spark, "id long, input_idx long, vendor string, date date, total decimal(18,4), invoice_number string, today date"))
    return history.keyed(d, None, Config(), TODAY)


def test_runs_of_many_numbers(spark):
    n = 100_000
    d = spark.range(n).select("id", F.col("id").alias("input_idx"), F.lit("Run Co").alias("vendor"), F.lit(DAY).alias("date"), (F.col("id") * 7 + 3).cast("decimal(18,4)").alias("total"), F.concat(F.lit("N-"), (F.col("id") + 1000).cast("string")).alias("invoice_number"), F.lit(TODAY).alias("today"))
    kept, priors = history.keyed(d, None, Config(), TODAY)
    found = history.sequential_bounds(kept, priors, Config())
    assert found.agg(F.count("*"), F.min("run_length"), F.max("run_length"), F.min("first"), F.max("last")).first() == (n, n, n, 1000, 1000 + n - 1)
    kept.unpersist()


def test_runs_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([4090, 8190, 50]) + rng.randrange(14), rng.choice([5, 100, 300]), rng.choice(["20.11", "20.12", "977.41", "1234.56"])) for _ in range(90)]
    kept, priors = numbered(spark, rows)
    want = {}
    for i, (n, age, total) in enumerate(rows):
        anchor = TODAY - dt.timedelta(180)
        seen = {}
        for j, (m, old, amount) in enumerate(rows):
            close = abs(D(amount) - D(total)) <= abs(D(total)) * D("0.0055") + D("0.01")
            if j != i and (DAY - dt.timedelta(old) >= anchor or close):
                seen[m] = min(j, seen.get(m, j))
        lo = hi = n
        while lo - 1 in seen:
            lo -= 1
        while hi + 1 in seen:
            hi += 1
        if hi - lo + 1 >= 3:
            want[i] = (hi - lo + 1, lo, hi, sorted(seen[x] for x in range(lo, hi + 1) if x != n))
    lists = history.sequential_runs(kept, priors, Config())
    assert {r["id"]: (r["run_length"], r["first"], r["last"], r["related"]) for r in lists.collect()} == want and len(want) > 20
    bounds = history.sequential_bounds(kept, priors, Config())
    assert {r["id"]: (r["run_length"], r["first"], r["last"]) for r in bounds.collect()} == {k: v[:3] for k, v in want.items()}
    kept.unpersist()


def test_runs_of_many_documents_a_number(spark):
    """12,000 documents of a supplier over 40 numbers: a lookup per document and number, not a comparison per two documents."""
    n = 12_000
    k = F.col("id")
    d = spark.range(n).select("id", k.alias("input_idx"), F.lit("Run Co").alias("vendor"), F.date_sub(F.lit(DAY), (k % 400).cast("int")).alias("date"), (k % 977 + 100).cast("decimal(18,4)").alias("total"), F.concat(F.lit("N-"), (k % 40 + 50).cast("string")).alias("invoice_number"), F.lit(TODAY).alias("today"))
    kept, priors = history.keyed(d, None, Config(), TODAY)
    kept.count()
    began = time.time()
    found = history.sequential_runs(kept, priors, Config()).select("id", "run_length", F.element_at("related", 1).alias("one"), F.size("related").alias("n")).collect()
    assert time.time() - began < 40
    assert len(found) == n and {(r["run_length"], r["n"]) for r in found} == {(40, 39)} and max(r["one"] for r in found) == 1
    kept.unpersist()


def test_runs_leave_out_the_own_id_under_another_number(spark):
    """A ledger that holds a document's id under the next number, once alone and once beside another prior."""
    kept, _ = numbered(spark, [(n, 10, "50") for n in (1, 2, 4)])
    past = spark.createDataFrame([(1, "Run Co", D("50"), DAY, "N-3"), (0, "Run Co", D("50"), DAY, "N-3"), (2, "Run Co", D("50"), DAY, "N-5")], schema(spark, "document_id long, vendor string, total decimal(18,4), date date, invoice_number string"))
    docs_ = kept.select("id", "input_idx", F.lit("Run Co").alias("vendor"), "date", "total", F.concat(F.lit("N-"), F.col("serial").cast("string")).alias("invoice_number"), F.lit(TODAY).alias("today"))
    kept, priors = history.keyed(docs_, past, Config(), TODAY)
    got = {r["id"]: (r["first"], r["last"], r["related"]) for r in history.sequential_runs(kept, priors, Config()).collect()}
    assert got == {0: (1, 5, [1, 1, 2, 2]), 1: (1, 5, [0, 0, 2, 2]), 2: (1, 4, [0, 0, 1])}
    kept.unpersist()


def test_findings_with_the_fields_that_are_read(spark):
    """Verdicts, controls and related documents by narrow findings are those of whole ones, and no wording or evidence is made."""
    rows = [{"vendor": "Run Co", "total": D("9500"), "invoice_number": f"N-{i % 9}", "confidence": 0.5 + i / 20} for i in range(12)] + [{"ingestion_status": "rejected", "reject_reason": "blank"}]
    d = docs(spark, *rows)
    whole = audit_batch(d, None, Config(), TODAY)
    brief = audit_batch(d, None, Config(), TODAY, ("rule_id", "severity"))
    related = audit_batch(d, None, Config(), TODAY, ("rule_id", "severity", "related"))
    told = lambda r: {x["id"]: (x["verdict"], x["worst_severity"], [(f["rule_id"], f["severity"]) for f in x["findings"]]) for x in r.results.collect()}
    assert told(whole) == told(brief) == told(related) and {"P-002", "P-011", "P-017", "P-018", "P-014"} <= {c for v in told(brief).values() for c, _ in v[2]}
    links = lambda r, most: sorted(map(tuple, reports.related_documents(r.findings(), r.results, most).collect()))
    assert links(whole, 50) == links(related, 50) and len(links(whole, 50)) == 12 * 11 and links(whole, 3) == [x for x in links(whole, 50) if x[1] in [i for i in range(1, 13) if i != x[0]][:3]]
    assert reports.export(whole.results).collect() == reports.export(brief.results).collect()
    assert brief.summary().collect() == whole.summary().collect() and "consecutive invoice" in plan_of(whole.results) and "consecutive invoice" not in plan_of(brief.results)


def test_few_names_are_compared_once(spark):
    """30 names over 3,000 documents: by names beforehand and by pairs of documents the same hits, those of all pairs."""
    rng = random.Random(11)
    names = [f"{a} {b}" for a in ("Northwind", "Nortwhind", "Northwood", "Fabrikam", "Fabrikan", "Contoso") for b in ("Trading Ltd", "Trading Limited", "Services", "Logistics", "Supplies")]
    rows = [(i, rng.choice(names), DAY + dt.timedelta(rng.randint(0, 60)), (D(rng.choice([1, 2, 40, 90_000, -700])) * (1 + D(rng.randint(-80, 80)) / 10000)).quantize(D("0.0001"))) for i in range(3000)]
    d = spark.createDataFrame([(i, i, v, t, x, None, TODAY) for i, v, t, x in rows], schema(spark, "id long, input_idx long, vendor string, date date, total decimal(18,4), invoice_number string, today date"))
    kept, priors = history.keyed(d, None, Config(), TODAY)
    assert history.alike_names(kept, priors, Config(), 101) is None
    hits = lambda per: sorted((r["id"], r["p_id"], round(r["sim"], 9)) for r in history.near_hits(kept, priors, Config(), per).select("id", "p_id", "sim").collect())
    got = hits(100)
    assert "jaro_winkler" not in plan_of(history.near_pairs(kept, priors, Config(), names=history.alike_names(kept, priors, Config(), 100))).split("InMemoryTableScan")[0]
    assert got == hits(10**6) and len(got) > 3000
    keys = [v.lower() for _, v, _, _ in rows]
    sims = {(a, b): similarity(a, b) for a in set(keys) for b in set(keys)}
    off = lambda x, y: max(max(abs(x), abs(y)) * Config().near_dup_amount_ratio, D("0.01"))
    want = [(i, j) for (i, _, t, x), (j, _, u, y) in itertools.permutations(rows, 2) if abs((t - u).days) <= 7 and abs(x - y) <= off(x, y) and (keys[i], x, t) != (keys[j], y, u) and sims[keys[i], keys[j]] >= 0.92]
    assert [x[:2] for x in got] == sorted(want)
    kept.unpersist()


def test_history_sizes_match_brute_force_without_pairs(spark):
    rng = random.Random(4)
    rows = [(i, f"Shop {'ABCDE'[min(i % 7, 4)]}" if i else "Alone", DAY - dt.timedelta(rng.choice([1, 100, 175, 190, 400])), rng.choice([D("100"), D("100.4"), D("101"), D("-5"), D("0.01")])) for i in range(150)]
    past = [(3, rows[3][1], D("100"), DAY, None), (900, "Shop A", None, DAY, None), (901, "Shop A", D("100.5"), None, None)]
    d = spark.createDataFrame([(i, i, v, t, x, None, TODAY) for i, v, t, x in rows], schema(spark, "id long, input_idx long, vendor string, date date, total decimal(18,4), invoice_number string, today date"))
    led = spark.createDataFrame(past, schema(spark, "document_id long, vendor string, total decimal(18,4), date date, invoice_number string"))
    kept, priors = history.keyed(d, led, Config(), TODAY)
    found = history.admitted_counts(kept, priors, Config())
    want = {}
    for i, v, _, x in rows:
        mine = [(t is not None and t >= TODAY - dt.timedelta(180), y is not None and abs(y - x) <= abs(x) * D("0.0055") + D("0.01")) for j, w, t, y in [*rows, *((j, w, t, y) for j, w, y, t, _ in past)] if j != i and w == v]
        if mine:
            want[i] = (sum(a for a, _ in mine), sum(b for _, b in mine), sum(a or b for a, b in mine))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want and 0 not in want and len(want) == 149
    assert "Join" not in plan_of(found)
    kept.unpersist()


def test_hot_groups_make_no_pairs(spark):
    """A supplier's 600 equal documents: two minima for P-002, one list for P-017, no pair rows."""
    d = spark.range(600).select("id", F.col("id").alias("input_idx"), F.lit("One").alias("vendor"), F.lit(DAY).alias("date"), F.lit("9500").cast("decimal(18,4)").alias("total"), F.lit("A-1").alias("invoice_number"), F.lit(TODAY).alias("today"))
    kept, priors = history.keyed(d, None, Config(), TODAY)
    assert {r["match"] for r in history.duplicates(kept, priors, Config()).select(F.get("finding.related", F.lit(0)).alias("match")).distinct().collect()} == {0, 1}
    for rule in (history.reused_numbers, history.splitting):
        found = rule(kept, priors, Config())
        assert found.select(F.size("finding.related").alias("n")).distinct().collect() == [(599,)]
        assert plan_of(found).count("SortMergeJoin") + plan_of(found).count("BroadcastHashJoin") <= (rule is history.reused_numbers)
    kept.unpersist()


def test_verdicts_and_order(spark):
    d = docs(spark, {}, {"total": D("500")}, {"total": D("20000"), "date": None, "confidence": 0.1})
    r = {x["id"]: x for x in audit_batch(d, None, Config(), TODAY).results.collect()}
    assert [r[i]["verdict"] for i in (1, 2, 3)] == ["pass", "review", "blocked"]
    assert [f["rule_id"] for f in r[3]["findings"]] == ["P-009", "P-004", "P-013", "P-010"]
    assert r[1]["worst_severity"] is None and r[2]["worst_severity"] == "low"


def test_requests_with_and_without_history(spark):
    prior = (7, "Acme", D("100.37"), DAY, "A-1")
    same = {"vendor": "ACME", "date": DAY, "invoice_number": "a1"}
    d = docs(spark, {**same, "history": [prior]}, {**same, "history": []}, {**same, "history": None}, {"vendor": "Acne", "date": DAY, "history": [prior]}, history=True)
    got = {r["id"]: r for r in audit_requests(d, None, Config(), TODAY).collect()}
    assert [f["rule_id"] for f in got[1]["findings"]] == ["P-002", "P-017"]
    assert got[2]["not_evaluated"] == [] and got[2]["findings"] == []
    assert got[3]["not_evaluated"] == ["P-002", "P-011", "P-016", "P-017", "P-018"]
    assert [f["rule_id"] for f in got[4]["findings"]] == [] or got[4]["findings"][0]["rule_id"] == "P-016"


def test_requests_find_misspelt_suppliers_in_the_ledger(spark):
    d = docs(spark, {"id": 10, "vendor": "Northwind Traders", "total": D("412.73"), "date": dt.date(2026, 6, 20)}, {"id": 11, "vendor": "Elsewhere"}, history=True)
    past = spark.createDataFrame([(1, "Northwind Tradres", D("412.80"), dt.date(2026, 6, 14), None), (2, "Northwind Traders", D("412.73"), dt.date(2026, 6, 20), None)], schema(spark, "document_id long, vendor string, total decimal(18,4), date date, invoice_number string"))
    single = {r["id"]: {f["rule_id"]: f["related"] for f in r["findings"]} for r in audit_requests(d, past, Config(), TODAY).collect()}
    batch = {r["id"]: {f["rule_id"]: f["related"] for f in r["findings"]} for r in audit_batch(d.drop("history"), past, Config(), TODAY).results.collect()}
    assert single[10]["P-016"] == batch[10]["P-016"] == [1] and single[10]["P-002"] == [2] and "P-016" not in single[11]


def test_similarity_of_many_pairs_at_once(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    names += [n[:2] + n[3:] for n in names] + [n[:1] + n[1:3][::-1] + n[3:] for n in names if len(n) > 6]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(3000)] + [(n, n[:1] + n[1:3][::-1] + n[3:]) for n in names] + [("x" * 400, "x" * 399 + "y"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", jaro_winkler("a", "b").alias("s"), may_match(F.col("a"), signature(F.col("a")), F.col("b"), signature(F.col("b")), 0.92).alias("may")).collect()
    for a, b, s, may in got:
        want = None if a is None or b is None else similarity(a, b)
        assert s == want or abs(s - want) < 1e-12
        assert may or want is None or want < 0.92


def test_benford(spark):
    series = [D(str(round(10 * 1.01**i, 2))) for i in range(1000)]
    close = population.benford(docs(spark, *[{"total": t} for t in series]), Config()).first()
    assert close["conformity"] in ("close", "acceptable") and close["tested"] == 1000 and close["worst_digit"] is None
    odd = docs(spark, *[{"total": D(7000 + i) if i % 2 else D(20 + i % 9)} for i in range(400)])
    bad = population.benford(odd, Config()).first()
    assert bad["conformity"] == "nonconformity" and bad["worst_digit"] in (7, 2)
    assert population.worst_documents(odd, Config()).count() > 100
    floor = population.benford(docs(spark, {"total": D("30000")}), Config(benford_floor=D("25000"))).first()
    assert floor["conformity"] == "not_evaluated" and floor["tested_from"] == "100000" and "needs at least 300" in floor["skipped"]
    assert population.benford(docs(spark), Config()).first()["tested"] == 0


def test_empty_batch_and_reports(spark):
    empty = audit_batch(docs(spark), None, Config(), TODAY)
    assert empty.summary().first().asDict() == {"documents": 0, "pass": 0, "review": 0, "blocked": 0}
    rep = audit_batch(docs(spark, {"vendor": "=HYPERLINK(1)<b>", "total": D("500")}, {"total": None}), None, Config(), TODAY)
    text = reports.compact_batch(rep, 1)
    assert text.startswith("2 docs: 0 pass, 1 review, 1 blocked") and "+1 more flagged" in text and "P-010x1" in text
    page = reports.html_report(rep, "<x>")
    assert "<script" not in page and "&lt;b&gt;" in page and page.index('id="doc-2"') < page.index('id="doc-1"') and "Not evaluated: 1 amounts" in page and '<b class="blocked">1</b>' in page
    twin = audit_batch(docs(spark, {"id": 1, "vendor": "V"}, {"id": 2, "vendor": "V"}), None, Config(), TODAY)
    linked = reports.html_report(twin, "x")
    assert '<a href="#doc-2">#2</a>' in linked and '<a href="#doc-1">#1</a>' in linked and "<blockquote>" in linked and "P-002" in linked
    assert reports.export(rep.results).where("id = 1").first()["vendor"].startswith("'=")
    assert reports.compact(rep.results).where("id = 2").first()["text"] == "BLOCKED findings=1\nP-001 high: no amount readable"


@pytest.mark.parametrize("bad", [{"nope": 1}, {"approval_limit": "1", "x": 2}])
def test_unknown_config_keys(bad):
    with pytest.raises(ValueError):
        Config.of(bad)
