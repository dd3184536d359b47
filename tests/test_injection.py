"""Planted anomalies, retries of the ledger, and measures on cases worked out by hand."""

import datetime as dt

from payproof.config import Config
from payproof.operators import injection, metrics
from payproof.operators.rows import with_findings
from payproof.plans.audit import audit_batch
from payproof.sources.ledger import Ledger

from .helpers import D, TODAY, docs


def some(spark, n=40):
    return docs(spark, *[{"id": i, "vendor": f"Supplier {i} Limited", "total": D("1234.56") + i, "subtotal": D("1200") + i, "tax": D("34.56")} for i in range(1, n + 1)], {"id": 90, "vendor": None}, {"id": 91, "total": None}, {"id": 92, "date": None})


def test_each_kind_is_planted_once_and_reruns_agree(spark):
    made = injection.inject(some(spark), injection.KINDS, TODAY, every=4)
    rows = made.collect()
    kinds = {k: [r for r in rows if r["kind"] == k] for k in injection.KINDS}
    assert all(len(v) >= 10 for v in kinds.values()) and len({r["id"] for r in rows}) == len(rows)
    assert sorted(map(str, rows)) == sorted(map(str, injection.inject(some(spark), injection.KINDS, TODAY, every=4).collect()))
    source = {r["id"]: r for r in some(spark).collect()}
    assert not {90, 91, 92} & {r["orig_id"] or r["replaces"] for r in rows}
    assert all(r["vendor"] == source[r["orig_id"]]["vendor"] and r["total"] == source[r["orig_id"]]["total"] for r in kinds["exact_duplicate"])
    assert all(1 <= (r["date"] - source[r["orig_id"]]["date"]).days <= 5 for r in kinds["duplicate_shifted_date"])
    assert all(r["vendor"] != source[r["orig_id"]]["vendor"] for r in kinds["duplicate_vendor_variant"])
    assert all(D("9050") <= r["total"] <= D("9950") and r["subtotal"] is None and r["orig_id"] is None for r in kinds["split_below_limit"])
    assert all(r["date"] > TODAY for r in kinds["future_dated"]) and all(r["total"] % 1000 == 0 for r in kinds["round_fabricated"])
    assert all(r["total"] > source[r["replaces"]]["total"] and r["orig_id"] is None for r in kinds["inflated_single_line"])
    assert all(r["total"] == r["total"].to_integral_value() for r in kinds["altered_receipt_total"])
    assert {r["source"]["file"] for r in kinds["ghost_vendor"]} == {"seeded:ghost_vendor"}


def test_replaced_documents_leave_the_batch(spark):
    base = some(spark)
    made = injection.inject(base, ["inflated_single_line"], TODAY, every=4)
    ids = {r["id"] for r in injection.planted(base, made).select("id").collect()}
    gone = {r["replaces"] for r in made.collect()}
    assert gone and not gone & ids and len(ids) == base.count()
    none = injection.inject(base.limit(0), injection.KINDS, TODAY)
    assert none.count() == 0 and injection.planted(base, none).count() == base.count()


def test_what_is_new_is_counted(spark):
    base = some(spark)
    made = injection.inject(base, ["exact_duplicate", "future_dated"], TODAY, every=4)
    before, after = (audit_batch(d, None, Config(), TODAY).results for d in (base, injection.planted(base, made)))
    got = {r["kind"]: r for r in metrics.injected_detection(made, after, before).collect()}
    assert got["exact_duplicate"]["n"] == got["exact_duplicate"]["automatic"] == 10
    assert got["future_dated"]["automatic"] == 10
    rules = {(r["kind"], r["rule_id"]): r["n"] for r in metrics.injected_rules(made, after, before).collect()}
    assert rules["exact_duplicate", "P-002"] == 10 and rules["future_dated", "P-006"] == 10
    plain = with_findings(base, Config()).select("id", "findings")
    one = metrics.false_alarms(plain, base.where("id <= 3").select("id"), "P-003").first()
    assert (one["documents"], one["adjusted"], one["fired"], one["fired_unadjusted"]) == (43, 3, 1, 1)


def test_attempts_that_were_not_finished_do_not_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    d = docs(spark, {"id": 1})
    results = audit_batch(d, None, Config(), TODAY).results
    steps = spark.createDataFrame([(1, 1, "evaluate"), (1, 0, "triage")], "document_id long, step_index int, tool string")
    at = dt.datetime(2026, 6, 30)
    for lost in (True, False):
        if lost:  # the driver goes before the attempt is committed
            keep, ledger.commit = ledger.commit, lambda *_: False
            ledger.record(d, results, at, "b", steps)
            ledger.commit = keep
            assert ledger.read("extractions").count() == 1 and ledger.history(None).count() == 0 and not ledger.holds("b")
        else:
            ledger.record(d, results, at, "b", steps)
    assert ledger.read("extractions").count() == 2 and ledger.history(None).count() == 1 and ledger.holds("b")
    run = ledger.runs().collect()
    assert len(run) == 1 and [s["tool"] for s in run[0]["steps"]] == ["triage", "evaluate"] and run[0]["reviews"] is None


def test_measures(spark):
    v = [("vendor", "A-B", "a b"), ("vendor", "x", "a"), ("vendor", "", "a"), ("vendor", "x", None), ("total", "60.000", "60,000"), ("date", "x", None), ("total", "", "")]
    got = {r["field"]: r for r in metrics.field_report(spark.createDataFrame(v, "field string, predicted string, golden string")).collect()}
    assert (got["vendor"]["tp"], got["vendor"]["fp"], got["vendor"]["fn"], got["vendor"]["documents"]) == (1, 1, 2, 3)
    assert not got["date"]["scored"] and got["date"]["support"] == 0 and (got[None]["tp"], got["total"]["tp"]) == (2, 1)
    routes = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["b", "a"])], "expected array<string>, visited array<string>")
    assert metrics.trajectories(routes).first()["success_rate"] == 0.5 and metrics.trajectories(routes.limit(0)).first()["success_rate"] == 0.0
    prices = spark.createDataFrame([("m", D("0.50"), D("1.50"))], "model string, input_price decimal(12,4), output_price decimal(12,4)")
    calls = spark.createDataFrame([("m", 1, 0), ("m", 3, 0), ("m", 0, 1), ("new", 9, 9)], "model string, input_tokens long, output_tokens long")
    cost = sorted((str(r["cost_usd"]) for r in metrics.priced(calls, prices).collect()))
    assert cost == ["0.000000", "0.000002", "0.000002", "None"]
