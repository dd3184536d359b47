import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payproof.functions import text as T
from payproof.functions.dates import lenient_date, receipt_date, strict_date
from payproof.functions.money import lenient_money, receipt_money, strict_money
from payproof.functions.similarity import jaro_winkler, similarity


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


JAN = dt.date(2024, 1, 31)
CASES = [
    (T.vendor_key, {"ACME Ltd.": "acme ltd", "  --Foo,,Bar  ": "foo bar", "Café": "caf", None: ""}),
    (T.invoice_key, {" inv/0042 ": "INV0042", "--": None, None: None}),
    (lambda c: T.invoice_serial(T.invoice_key(c)), {"INV-1043": 1043, "abc": None, "x" + "9" * 19: None}),
    (lambda c: T.invoice_prefix(T.invoice_key(c)), {"INV-1043": "INV", "abc": None, "7": ""}),
    (T.clean_text, {"Acme\x07\nLtd": "AcmeLtd", "\n": None}),
    (T.csv_safe, {"=HYPERLINK()": "'=HYPERLINK()", "plain": "plain", "-1": "'-1", "": ""}),
    (T.safe_token, {"a b/ü.csv": "a"[:1] + "b/.csv"}),
    (T.html_escape, {"<a & 'b'>": "&lt;a &amp; &#39;b&#39;&gt;"}),
    (strict_money, {"1425.50": D("1425.5"), "10": D(10), " 12.50 ": D("12.5"), "1e3": D(1000), "$1,000": None, "true": None, None: None, "1" * 41: None, "": None}),
    (lenient_money, {"£25,000.00": D(25000), "(1,200.50)": D("-1200.50"), " 300 ": D(300), "1.2.3": None, "n/a": None, "-3,000": D(-3000)}),
    (receipt_money, {"1.234,56": D("1234.56"), "1,234.56": D("1234.56"), "60.000": D(60000), "12,5": D("12.5"), "Rp 1.000.000": D(1000000), "$-7.25": D("-7.25"), ".500": D("0.5"), "abc": None, "-": None}),
    (strict_date, {"2024-01-31": JAN, "2024-1-31": None, "31/01/2024": None, "2024-02-31": None}),
    (lenient_date, {"31/01/2024": JAN, "2024-01-31 00:00:00": JAN, "2024-01-31T10:00": JAN, "31-Jan-2024": JAN, "31.1.2024": JAN, "31-Jan-24": JAN, "x": None}),
    (receipt_date, {"01/31/2024": JAN, "31/01/2024": JAN, "03/04/2026": dt.date(2026, 3, 4), "January 31st, 2024": JAN, "31 Jan 2024": JAN, "2024/01/31": JAN, "never": None}),
    (lambda c: receipt_date(c, dayfirst=True), {"03/04/2026": dt.date(2026, 4, 3), "01/31/2024": JAN}),
    (T.split_items, {"a, b and c;d\n": ["a", "b", "c", "d"]}),
    (T.search_terms, {"The Supplier, the supplier of A 12": ["supplier", "supplier", "12"]}),
]


@pytest.mark.parametrize("fn,table", CASES)
def test_tables(spark, fn, table):
    assert apply(spark, fn, list(table)) == list(table.values())


def test_similarity_of_names(spark):
    assert round(similarity("martha", "marhta"), 4) == 0.9611
    assert similarity("acme", "acme") == 1 and similarity("", "") == 1 and similarity("a", "") == 0
    assert similarity("acme ltd", "acme limited") > 0.85 and similarity("acme", "zeta") < 0.6
    df = spark.createDataFrame([("martha", "marhta"), (None, "x")], "a string, b string")
    assert [r[0] and round(r[0], 4) for r in df.select(jaro_winkler("a", "b")).collect()] == [0.9611, None]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_similarity_is_a_share(a, b):
    s = similarity(a, b)
    assert 0 <= s <= 1 and (s == 1) == (a == b) or a and b
    if s >= 0.92 and a and b:
        jaro = (0.92 - 0.4) / 0.6
        assert min(len(a), len(b)) >= max(len(a), len(b)) * (3 * jaro - 2) - 1e-9


def test_shares_round_by_their_binary_value(spark):
    from payproof.functions.text import share_text

    values = [0.0, 1.0, 0.975, 0.935, 0.925, 0.985, 0.9999, 0.004, 0.1, 0.92]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(share_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{v:.2f}" for v in values]
