import datetime as dt
import glob
import hashlib
import json
import statistics
import struct
import zlib
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from payproof.config import Config, Profile
from payproof.operators import metrics, reports, search
from payproof.plans.audit import audit_batch
from payproof.policies import POLICIES, explain, policies
from payproof.sources import corpora, documents, images, intake
from payproof.sources.ledger import Ledger
from payproof.streaming.ingest import audit_stream

from .helpers import TODAY, docs


def write(path, text, mode="w"):
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as f:
        f.write(text)
    return str(path)


def test_json_shapes_and_strictness(spark, tmp_path):
    batch = [{"vendor": "A\u0007cme", "total": "12.50", "date": "2026-01-02"}, {"id": 9, "fields": {"total": 3}, "today": "2026-02-01"}, {"total": "1,000"}, {"oops": 1}, {"total": 1, "confidence": 2}, {"line_items": [{"amount": "x"}]}]
    d, ledger, config, today = documents.read_json(spark, write(tmp_path / "b.json", json.dumps(batch)))
    rows = {r["input_idx"]: r for r in d.collect()}
    assert rows[1]["vendor"] == "Acme" and rows[1]["total"] == D("12.5") and rows[1]["id"] == 1 and rows[1]["source"]["file"] == "b.json"
    assert rows[2]["id"] == 9 and rows[2]["total"] == 3 and rows[2]["today"] == dt.date(2026, 2, 1) and rows[2]["confidence"] == 1.0
    assert "plain decimal" in rows[3]["reject_reason"] and "oops" in rows[4]["reject_reason"] and "confidence" in rows[5]["reject_reason"] and "line item" in rows[6]["reject_reason"]
    assert ledger is None and config == Config()
    whole = {"documents": batch[:2], "config": {"approval_limit": "5"}, "today": "2026-03-01", "history": [{"vendor": "Z", "total": "1", "date": "2026-01-01"}]}
    d, ledger, config, today = documents.read_json(spark, write(tmp_path / "w.json", json.dumps(whole)))
    assert d.count() == 2 and config.approval_limit == 5 and today == "2026-03-01" and ledger.first()["document_id"] == 1
    one, _, _, _ = documents.read_json(spark, write(tmp_path / "o.json", json.dumps({"total": "1", "history": [{"vendor": "Q", "document_id": "4"}], "ingestion_status": "rejected", "reject_reason": "blank"})))
    r = one.first()
    assert r["history"][0]["document_id"] == 4 and r["ingestion_status"] == "rejected"
    with pytest.raises(ValueError, match="duplicate"):
        documents.read_json(spark, write(tmp_path / "d.json", json.dumps([{"id": 1}, {"id": 1}])))
    lines = documents.read_json(spark, write(tmp_path / "l.jsonl", "\n".join(json.dumps(x) for x in batch)))[0]
    assert lines.count() == 6 and {r["id"] for r in lines.collect()} == {1, 9, 3, 4, 5, 6}


def test_csv_headers_and_fallbacks(spark, tmp_path):
    text = "﻿Supplier,Amount  Paid,Payment Date,Invoice No\nAcme,\"£1,200.50\",31/01/2024,A1\n,,,\nBob,(5),2024-02-01 00:00:00,\n"
    rows = documents.read_csv(spark, write(tmp_path / "p.csv", text)).orderBy("input_idx").collect()
    assert [(r["vendor"], r["total"], r["date"]) for r in rows] == [("Acme", D("1200.5"), dt.date(2024, 1, 31)), ("Bob", D(-5), dt.date(2024, 2, 1))]
    latin = documents.read_csv(spark, write(tmp_path / "l.csv", "id,vendor,total\n7,Café,3\n7,X,4\n".encode("latin-1"), "wb")).orderBy("input_idx").collect()
    assert [r["id"] for r in latin] == [1, 2] and latin[0]["vendor"] == "Café"
    own = Profile.of({"name": "x", "currency": "GBP", "columns": {"total": "Wert"}, "date_formats": ["%Y%m%d"], "config": {"benford_floor": "25000"}})
    r = documents.read_csv(spark, write(tmp_path / "o.csv", "Wert,date\n3,2024-01-31\n"), own).first()
    assert r["currency"] == "GBP" and r["total"] == 3
    with pytest.raises(ValueError, match="no amount"):
        documents.read_csv(spark, write(tmp_path / "n.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        Profile.of({"colums": {}})


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('ID,Supplier,Date,Amount\n7,"Acme\nWorks, ""North""",2026-01-02,10.50\n8,Plain,2026-01-03,11\n')
    got = {r["id"]: r for r in documents.read_csv(spark, str(path)).collect()}
    assert set(got) == {7, 8} and got[7]["vendor"] == 'AcmeWorks, "North"' and str(got[7]["total"]) == "10.5000"
    assert got[8]["source"]["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()


def test_csv_in_blocks_equals_one_reader(spark, tmp_path):
    """Quoted line breaks, doubled quotes, quotes inside plain fields and blank lines over many small blocks of two files."""
    import csv
    import random

    rng = random.Random(6)
    cell = lambda: rng.choice(["plain", "", 'say ""so""', "a,b", "two\nlines", "\n\n", '"', 'x\n"",\n', "é" * 20, 'end"'])
    want = []
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(2):
        rows = [[f"{k}.{i}", *(cell() for _ in range(3))] for i in range(400)]
        want += rows
        with open(folder / f"{k}.csv", "w", encoding="utf-8", newline="") as f:
            for r in rows:
                if rng.random() < 0.1:
                    f.write("\n")
                if rng.random() < 0.1:
                    r[1:] = ['5" pipe', "p", "q"]
                    f.write(",".join(r) + "\n")
                else:
                    csv.writer(f, lineterminator="\n").writerow(r)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        records = documents.csv_records(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = [r["record"] for r in records.orderBy("input_idx").collect()]
        numbers = [r["input_idx"] for r in records.orderBy("input_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert numbers == list(range(1, len(want) + 1))
    assert [next(csv.reader([x])) if "\n" not in x else next(csv.reader(x.splitlines(keepends=True))) for x in got] == want


def test_json_lists_in_blocks(spark, tmp_path):
    rows = [{"id": i + 1, "vendor": ["plain", 'a "}{][" b', "back\\", "é, {\n", None][i % 5], "total": f"{i}.50", "line_items": [{"name": "x}]", "amount": "1"}, {"name": "[", "amount": "2"}][: i % 3], "date": "2026-01-02"} for i in range(60)]
    history = [{"document_id": 900 + i, "vendor": "p}", "total": "3.25", "date": "2026-01-01", "invoice_number": f"N{i}"} for i in range(7)]
    config = {"approval_limit": "777.00"}
    bodies = [json.dumps(rows), json.dumps(rows, indent=1), json.dumps({"config": config, "documents": rows, "history": history, "today": "2026-02-03"}), json.dumps({"today": "2026-02-03", "history": history, "documents": rows, "config": config}, indent=2) + "\n", json.dumps({"documents": rows, "history": [], "note": {"documents": [{"a": 1}]}}, ensure_ascii=False)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i, body in enumerate(bodies):
        path = write(tmp_path / f"{i}.json", body)
        want = documents.read_json(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        try:
            got = documents.read_json(spark, path, whole=0)
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
            both = [sorted(map(str, d.collect())) for d in (got[0], want[0])]
            assert both[0] == both[1] and len(both[0]) == 60
            assert got[2:] == want[2:]
            assert sorted(map(str, got[1].collect() if got[1] else [])) == sorted(map(str, want[1].collect() if want[1] else []))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_hash_of_a_file_in_lines(spark, tmp_path):
    for i, body in enumerate((b"a\nb\r\n\xff\n\nlast", b"a\n", b"\n\n", b"\nx", b"x" * 3000 + b"\n" + b"y" * 10)):
        path = write(tmp_path / f"{i}.csv", body, "wb")
        assert documents.file_hash(spark, path, whole=0) == documents.file_hash(spark, path) == hashlib.sha256(body).hexdigest()
    assert documents.file_hash(spark, str(tmp_path)) is None


def test_ledger_reviews_and_stream(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read("audit_runs").count() == 0
    day = dt.date(2026, 6, 20)
    first = docs(spark, {"id": 1, "vendor": "Acme", "total": D("5.17"), "date": day}, {"id": 2, "ingestion_status": "rejected", "reject_reason": "blank"})
    batch = ledger.record(first, audit_batch(first, None, Config(), TODAY).results, dt.datetime(2026, 6, 30), "b1")
    assert ledger.read("extractions").count() == 1 and ledger.read("findings").where("policy_title is not null").count() == 1
    assert ledger.history(day).count() == 1 and ledger.history(day + dt.timedelta(1)).count() == 0 and ledger.history(day, exclude=1).count() == 0
    said = spark.createDataFrame([(f"{batch}-2", 1, "ann", "approved", None, dt.datetime(2026, 7, 1)), (f"{batch}-2", 2, "bob", "rejected", None, dt.datetime(2026, 7, 1)), (f"{batch}-1", 3, "bob", "approved", None, dt.datetime(2026, 7, 1))], "run_id string, decision_id long, reviewer string, decision string, note string, decided_at timestamp")
    ledger.review(said, "first")
    ledger.review(said, "first")
    reviews = ledger.committed("review_decisions")
    assert {r["decision_id"]: r["overrides_verdict"] for r in reviews.collect()} == {1: True, 2: False, 3: False}
    assert {r["run_id"]: r["reviewer"] for r in reports.latest_reviews(reviews).collect()} == {"b1-2": "bob", "b1-1": "bob"}
    inbox = tmp_path / "inbox"
    docs(spark, {"id": 5, "vendor": "acme", "total": D("5.17"), "date": day}).write.parquet(str(inbox / "a"))
    for _ in range(2):
        stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(str(inbox))
        audit_stream(stream, ledger, str(tmp_path / "cp"), Config(), TODAY, availableNow=True).awaitTermination()
    before = {t: ledger.committed(t).drop("attempt").count() for t in ("findings", "extractions", "audit_runs", "review_decisions")}
    ledger.compact(dt.datetime(2026, 7, 2))
    assert before == {t: ledger.committed(t).drop("attempt").count() for t in before} and ledger.attempts().count() == 1 and ledger.holds("b1")
    found = ledger.committed("findings").where("document_id = 5").collect()
    assert [f["rule_id"] for f in found] == ["P-002"] and found[0]["related"] == [1]


def test_one_of_two_racing_writers_counts(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = docs(spark, {"id": 1, "vendor": "Acme"}, {"id": 2, "vendor": "Bob"})
    kinds = "id long, verdict string, worst_severity string, not_evaluated array<string>, findings array<struct<rule_id: string, severity: string, summary: string, evidence: map<string,string>, related: array<bigint>>>"
    results = spark.createDataFrame([(1, "pass", None, [], []), (2, "pass", None, [], [])], kinds)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: ledger.record(rows, results, dt.datetime(2026, 6, 30), "same"), range(4)))
    assert ledger.read("commits").count() == 1 and ledger.committed("audit_runs").count() == 2 and ledger.committed("extractions").count() == 2
    assert not ledger.commit("same", "late", dt.datetime(2026, 6, 30)) and ledger.committed("audit_runs").count() == 2


def test_micro_batches_read_their_partitions_alone(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    past = docs(spark, *[{"id": 100 + i, "vendor": f"Supplier {i}", "date": dt.date(2020 + i % 6, 1 + i % 12, 10)} for i in range(60)])
    ledger.record(past, audit_batch(past, None, Config(), TODAY).results, dt.datetime(2026, 6, 30), "b1")
    new = docs(spark, {"id": 1, "vendor": "SUPPLIER 7", "date": dt.date(2022, 3, 28)}, {"id": 107, "vendor": None})
    rows = ledger.history_of(new, 7)
    assert {r["document_id"] for r in rows.collect()} == {i for i in range(100, 160) if (2020 + (i - 100) % 6, 1 + (i - 100) % 12) in ((2022, 3), (2022, 4))}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count("bucket#") > 2 and "(year#" in plan and "In(month, [2022-03,2022-04])" in plan


def test_intake_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"%PDF /Encrypt"), ("c.png", b""), ("d.png", b"\x89PNG\r\n\x1a\n.."), ("e.jpg", b"nope")):
        write(tmp_path / "in" / name, body, "wb")
    got = {r["path"].rsplit("/", 1)[1]: (r["ingestion_status"], r["reject_reason"], r["kind"]) for r in intake.triage(intake.files(spark, str(tmp_path / "in"))).collect()}
    assert got["a.pdf"] == ("accepted", None, "pdf") and got["b.pdf"][1] == "password protected" and "c.png" not in got and got["d.png"][2] == "png" and got["e.jpg"][1] == "unsupported format"
    sha = hashlib.sha256(b"%PDF-1.4 x").hexdigest()
    write(tmp_path / "in" / "MANIFEST.json", json.dumps({"files": [{"path": "a.pdf", "sha256": sha}, {"path": "b.pdf", "sha256": sha}, {"path": "gone", "sha256": sha}, {"path": "../x", "sha256": sha}]}))
    assert {r["path"]: r["status"] for r in intake.verify_manifest(spark, str(tmp_path / "in")).collect()} == {"a.pdf": "ok", "b.pdf": "changed", "gone": "missing", "../x": "refused"}


def png(lines, colour=0, depth=8, kind=0, palette=b""):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    width = len(lines[0]) // {0: 1, 2: 3, 3: 1}[colour] * (8 // depth)
    body = zlib.compress(b"".join(bytes([kind]) + bytes(x) for x in lines))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:5]) + chunk(b"IDAT", body[5:]) + chunk(b"IEND", b"")


def filtered(lines, kind):
    """Lines as a PNG filter of one byte a pixel stores them."""
    out = []
    for y, line in enumerate(lines):
        row = []
        for x, v in enumerate(line):
            a, b, c = (line[x - 1] if x else 0), (lines[y - 1][x] if y else 0), (lines[y - 1][x - 1] if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(row)
    return out


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 4), st.integers(0, 12), st.randoms(use_true_random=False))
def test_blank_pngs_by_all_their_pixels(width, height, kind, spread, rng):
    lines = [[100 + rng.randint(0, spread) for _ in range(width)] for _ in range(height)]
    want = "image is blank" if statistics.pstdev(v for x in lines for v in x) < 3 else None
    made = png(filtered(lines, kind), kind=kind)
    assert images.fault("png", made) == want
    assert images.fault("png", made[:-1]) == images.fault("png", made[:40] + bytes([made[40] ^ 1]) + made[41:]) == "corrupt image"


def test_images_and_pages_that_hold_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = b"%PDF-1.4\n1 0 obj <</Type /Pages>> 2 0 obj <</Type /Page>> "
    packed = zlib.compress(b"BT (Total 12.50) Tj ET")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02zz"
    bmp = lambda rows: b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 1, len(rows), 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(bytes(r) + b"\0" for r in rows)
    files = {
        "a.png": (png([[0, 90], [0, 90]]), None), "b.png": (png([[7, 8], [7, 9]]), "image is blank"), "c.png": (b"\x89PNG\r\n\x1a\n", "corrupt image"),
        "d.png": (png([[0, 1]], colour=3, palette=b"\0\0\0\xff\xff\xff"), None), "e.png": (png([[0, 0]], colour=3, palette=b"\0\0\0\xff\xff\xff"), "image is blank"),
        "f.png": (png([[0b10101010]], depth=1), None), "g.png": (png([[9, 9, 9, 9, 9, 9]], colour=2), "image is blank"),
        "h.jpg": (jpeg + b"\xff\xd9", None), "i.jpg": (jpeg, "corrupt image"), "j.bmp": (bmp([(0, 0, 0), (99, 99, 99)]), None), "k.bmp": (bmp([(9, 9, 9), (9, 9, 9)]), "image is blank"), "l.bmp": (bmp([(0, 0, 0), (99, 99, 99)])[:-5], "corrupt image"),
        "m.pdf": (page + b"(Invoice) Tj\n%%EOF", None), "n.pdf": (page + b"( ) Tj\n%%EOF", "pdf has no text or images"), "o.pdf": (b"%PDF-1.4\n%%EOF", "pdf has no pages"), "p.pdf": (page, "unreadable pdf"),
        "q.pdf": (page + b"stream\n" + packed + b"\nendstream\n%%EOF", None), "r.pdf": (page + b"[(a) 3 (b)] TJ /Encrypt %%EOF", "password protected"), "s.pdf": (page + b"<</Subtype /Image>>\n%%EOF", None), "t.gif": (b"plain", "unsupported format"),
    }
    for name, (content, _) in files.items():
        write(tmp_path / "in" / name, content, "wb")
    found = intake.files(spark, str(tmp_path / "in"))
    assert {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in intake.inspected(found).collect()} == {k: v for k, (_, v) in files.items()}
    first = intake.first_files(spark, str(tmp_path / "in"), 3)
    assert [r["path"][-5:] for r in first.select("path").collect()] == ["a.png", "b.png", "c.png"] and first.where("length = length(content)").count() == 3


def test_corpora(spark, tmp_path):
    head = "invoice_id,vendor_name,invoice_date,submitted_date,currency,subtotal,tax_amount,total_amount,ocr_confidence,fraud_type"
    path = write(tmp_path / "s.csv", head + "\nINV-1,A,2026-01-01,,inr,1,2,3,0.9,none\nINV-2,G,2026-01-01,2026-01-05,usd,x,2,3,0.9,ghost_vendor\nINV-3,A,2026-01-01,,usd,1,2,3,0.9,split_invoice\n")
    rows = corpora.read_labelled(spark, path)
    by = {r["invoice_id"]: r for r in rows.collect()}
    assert by["INV-1"]["expected"] == [] and by["INV-2"]["expected"] == ["P-012"] and by["INV-2"]["subtotal"] is None and by["INV-2"]["today"] == dt.date(2026, 1, 5)
    assert [r["vendor"] for r in corpora.approved_vendors(rows).collect()] == ["A"]
    assert corpora.counterparts(rows).first()["document_id"] == 900_003
    spend = spark.createDataFrame([(1, "t1", "£10", "Acme ", "01/02/2026"), (2, "t1", "2.50", "x", "02/02/2026"), (3, None, "9", "y", "")], "input_idx long, tx string, amt string, sup string, day string")
    g = corpora.group_spending(spend, "tx", "amt", "sup", "day").collect()
    assert [(r["transaction"], r["vendor"], r["total"], r["date"]) for r in g] == [("t1", "Acme", D("12.5"), dt.date(2026, 2, 1))]
    rec = spark.createDataFrame([(1, json.dumps({"menu": {"nm": "tea", "price": "1.000"}, "sub_total": {"tax_price": ["100"], "service_price": "50", "discount_price": "1"}, "total": {"total_price": "1.150"}}))], "id long, json string")
    r = corpora.receipts(rec).first()
    assert r["total"] == 1150 and r["tax"] == 150 and r["line_items"][0]["amount"] == 1000 and r["adjusted"]


def test_spending_sheets_find_their_headers(spark):
    sheets = {
        "a": [["Title"], [], ["Date", " SUPPLIER ", "Amount", "Transaction Number"], ["2026-01-05 00:00:00", " Acme ", "10.50", "77.0"], ["2026-01-04", "Other", "1.25", "77"], ["2026-01-03", "Bob", "n/a", "78"], ["2026-01-03", "  ", "4", "79"], ["2026-01-02", "Cy", "3", "x"]],
        "b": [["Supplier", "Amount", "Supplier"], ["old", "-2", "Dee"], ["short"], ["e", "5", "Eve"]],
        "c": [[f"{i}"] for i in range(12)] + [["supplier", "amount"], ["Late", "1"]],
        "d": [["supplier", "note"], ["No amounts", "1"]],
    }
    rows = spark.createDataFrame([(s, i + 1, r) for s, x in sheets.items() for i, r in enumerate(x)], "sheet string, row long, cells array<string>")
    got = [(r["id"], r["vendor"], r["date"], r["total"], r["sheet"], r["row"]) for r in corpora.spending(rows).collect()]
    assert got == [(10_000_002, "Dee", "", D("-2"), "b", 2), (10_000_003, "Eve", "", D("5"), "b", 4), (10_000_001, "Cy", "2026-01-02", D("3"), "a", 8), (77, "Acme", "2026-01-05", D("11.75"), "a", 4)]
    assert corpora.spending(rows.where("false")).count() == 0


def test_search_and_metrics(spark):
    assert policies(spark).count() == 18 == len({p[0] for p in POLICIES}) and explain(spark, "p-007").first()["title"] == "Arithmetic integrity"
    q = spark.createDataFrame([("a", "duplicate invoice"), ("b", "the of and"), ("c", "sequential numbering")], "query_id string, query string")
    got = {(r["query_id"], r["place"]): r["policy_id"] for r in search.search(q, policies(spark)).collect()}
    assert got["a", 1] == "P-002" and got["c", 1] == "P-018" and not any(k[0] == "b" for k in got)
    cases = spark.createDataFrame([(1, ["A"], ["A", "B"]), (2, ["A"], []), (3, [], [])], "case_id int, expected array<string>, fired array<string>")
    per = {r["rule_id"]: r for r in metrics.per_rule(cases).collect()}
    assert per["A"]["recall"] == 0.5 and per["B"]["precision"] == 0.0
    assert metrics.micro(cases).first()["exact_match"] == 0.3333
    bins = metrics.calibration(spark.createDataFrame([(1.0, True), (0.99, False), (0.1, False)], "confidence double, correct boolean")).orderBy("bin").collect()
    assert [r["bin"] for r in bins] == [0, 4] and bins[1]["accuracy"] == 0.5
    base = docs(spark, {"id": 1, "vendor": "V", "total": D("77.31")})
    both = docs(spark, {"id": 1, "vendor": "V", "total": D("77.31")}, {"id": 2, "vendor": "V", "total": D("77.31")})
    inj = spark.createDataFrame([(2, "copy", 1)], "id long, kind string, orig_id long")
    r = metrics.injected_detection(inj, audit_batch(both, None, Config(), TODAY).results, audit_batch(base, None, Config(), TODAY).results).first()
    assert (r["n"], r["automatic"], r["assisted"]) == (1, 1, 1)


def test_reports_written_by_executors(spark, tmp_path):
    rows = [{"total": D("60000.00") if i % 3 == 0 else D("100.37"), "vendor": f'<Ven"dor {i}>', "input_idx": 9 - i, "source": ("list.csv", i, None, None)} for i in range(8)]
    report = audit_batch(docs(spark, *rows), None, Config(), TODAY)
    joined = lambda at: "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{at}/part-*")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file
    reports.write_html_parts(report, "A & B", str(tmp_path / "page"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert joined("page").replace("\n", "") == reports.html_report(report, "A & B").replace("\n", "")
    assert len(glob.glob(f"{tmp_path}/page/part-*")) > 1
    reports.write_json(report, str(tmp_path / "json"), "list.csv", timing_ms={"audit": 1.5})
    got = json.loads(joined("json"))
    assert got["file"] == "list.csv" and got["timing_ms"] == {"audit": 1.5} and got["summary"]["documents"] == 8 and len(got["benford"]["digits"]) == 9
    results = {r["id"]: r for r in report.results.collect()}
    assert [d["id"] for d in got["documents"]] == [r["id"] for r in sorted(results.values(), key=lambda r: r["input_idx"])]
    for d in got["documents"]:
        r = results[d["id"]]
        assert (d["verdict"], d["vendor"], [f["rule_id"] for f in d["findings"]], d["source"]["row"]) == (r["verdict"], r["vendor"], [f["rule_id"] for f in r["findings"]], r["source"]["row"])
    reports.write_json(audit_batch(docs(spark).limit(0), None, Config(), TODAY), str(tmp_path / "none"))
    assert json.loads(joined("none"))["documents"] == []


def test_medians(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("b", 5.0), ("b", 9.0), (None, 4.0), ("c", None)]
    got = metrics.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert {(r["k"], r["n"], r["median"]) for r in got} == {("a", 3, 2.0), ("b", 4, 3.0), (None, 1, 4.0)}


def test_ledger_of_a_labelled_list(spark, tmp_path):
    head = "invoice_id,vendor_name,invoice_date,submitted_date,currency,subtotal,tax_amount,total_amount,ocr_confidence,fraud_type\n"
    body = "".join(f"INV-{i},{v},{d},,usd,,,{t},1,{k}\n" for i, v, d, t, k in [(1, "Acme Ltd", "2026-06-01", 10, "none"), (2, "ACME ltd.", "2026-06-02", 20, "duplicate_invoice"), (3, "Acme Ltd", "2026-06-03", "", "split_invoice"), (4, "", "2026-06-03", 5, "none"), (5, "Other", "", 5, "altered_total"), (6, "Acme Ltd", "2025-01-01", 7, "split_invoice")])
    rows = corpora.read_labelled(spark, write(tmp_path / "l.csv", head + body))
    ledger = corpora.labelled_ledger(rows)
    assert sorted(r["document_id"] for r in ledger.collect()) == [1, 2, 3, 6, 900_002, 900_006]
    assert corpora.scored_rules(rows) == ["P-002", "P-007", "P-011"]
    cases = spark.createDataFrame([(1, 2, "acme LTD", TODAY), (2, 9, "", TODAY), (3, 3, "Acme Ltd", dt.date(2025, 3, 1))], "case_id long, document_id long, vendor string, today date")
    found = {(r["case_id"], r["prior"]["document_id"]) for r in corpora.case_history(cases, ledger).collect()}
    assert found == {(1, 1), (1, 3), (1, 900_002), (3, 1), (3, 2), (3, 6), (3, 900_002), (3, 900_006)}


def test_case_totals_are_the_sums_of_case_histories(spark):
    """Cases with and without their own document in the ledger, unknown amounts, dates and ids, suppliers spelt alike, equal cases."""
    from pyspark.sql import functions as F

    money = "decimal(18,4)"
    made = spark.range(400).select("id", (F.col("id") * 37 % 11).alias("v"), (F.col("id") * 101 % 300).cast("int").alias("age"))
    vendor = F.when(F.col("v") == 10, None).when(F.col("v") % 2 == 0, F.concat(F.lit("Shop "), F.col("v").cast("string"))).otherwise(F.concat(F.lit("SHOP. "), (F.col("v") - 1).cast("string")))
    day = F.date_sub(F.lit("2026-06-30").cast("date"), F.col("age"))
    ledger = made.select(F.when(F.col("id") % 50 != 0, F.when(F.col("id") % 3 == 0, F.col("id") + 900_000).otherwise(F.col("id"))).alias("document_id"), vendor.alias("vendor"), F.when(F.col("id") % 7 != 0, F.col("id").cast(money)).alias("total"), F.when(F.col("id") % 31 != 0, day).alias("date"), F.lit(None).cast("string").alias("invoice_number"))
    cases = made.select(F.col("id").alias("case_id"), F.when(F.col("id") % 13 != 0, F.col("id")).alias("document_id"), vendor.alias("vendor"), F.when(F.col("id") % 17 != 0, day).alias("today"))
    cases = cases.unionByName(cases.where("case_id < 20"))
    found = corpora.case_history(cases, ledger).groupBy("case_id").agg(F.count("*"), F.coalesce(F.sum("prior.total"), F.lit(0)).cast("decimal(28,4)"), F.count_if(F.col("prior.document_id") > corpora.SYNTHETIC_FROM))
    totals = corpora.case_totals(cases, ledger)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, found.collect())) and found.count() > 200
