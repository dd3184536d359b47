"""Keys and cleaned text, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_key(vendor: Column) -> Column:
    """Lower case; each run of anything but a-z and 0-9 is one space; trimmed; null gives an empty key."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(vendor, F.lit(""))), "[^a-z0-9]+", " "))


def invoice_key(number: Column) -> Column:
    """ASCII letters and digits in upper case; null if there are none.  Leading zeros count."""
    return F.nullif(F.upper(F.regexp_replace(number, "[^A-Za-z0-9]", "")), F.lit(""))


def invoice_prefix(key: Column) -> Column:
    """What comes before the last run of digits of an invoice key; null without one, or if it has over 18 digits."""
    return F.when(F.length(F.regexp_extract(key, "([0-9]+)$", 1)).between(1, 18), F.regexp_replace(key, "[0-9]+$", ""))


def invoice_serial(key: Column) -> Column:
    digits = F.regexp_extract(key, "([0-9]+)$", 1)
    return F.when(F.length(digits).between(1, 18), digits).try_cast("bigint")


def first_digit(amount: Column) -> Column:
    """The first digit from 1 to 9; null for zero."""
    return F.nullif(F.regexp_extract(F.abs(amount).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def clean_text(text: Column) -> Column:
    """Without control characters; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"\p{Cc}", ""), F.lit(""))


def csv_safe(text: Column) -> Column:
    """An apostrophe before text that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_token(text: Column) -> Column:
    """Letters, digits and ._-/ only, 80 of them at most."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._\-/]", ""), 1, 80)


def html_escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def money_text(amount: Column) -> Column:
    """An amount with two decimals, or more where it has more."""
    return F.regexp_replace(amount.cast("decimal(38,6)").cast("string"), r"(\.\d\d)(\d*?)0+$", "$1$2")


def share_text(share: Column) -> Column:
    """A share from 0 to 1 with two decimals, rounded by its exact binary value: 0.975 is a little less and gives 0.97."""
    exact = (share * float(1 << 53)).cast("long")
    hundredths = F.shiftright(exact * 200 + (1 << 53), 54)
    return F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)


def id_list(ids: Column) -> Column:
    """``#1, #2`` with five ids at most and how many more there are."""
    shown = F.array_join(F.transform(F.slice(ids, 1, 5), lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")
    return F.when(F.size(ids) > 5, F.concat(shown, F.lit(" (+"), (F.size(ids) - 5).cast("string"), F.lit(" more)"))).otherwise(shown)


def source_ref(source: Column) -> Column:
    """``file:row`` of where a document came from, as much of it as is known."""
    return F.concat(F.coalesce(source["file"], F.lit("")), F.when(source["row"].isNotNull(), F.concat(F.lit(":"), source["row"].cast("string"))).otherwise(""))


def plain_words(text: Column) -> Column:
    """Lower case, each run of anything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def split_items(text: Column) -> Column:
    """Items of a list written with commas, semicolons, line ends or the word and."""
    return F.filter(F.transform(F.split(text, r"[,;\n]|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


#: Words that carry no meaning for policy search.
STOPWORDS = "a an the and or of to in on for is are be been must not no any all that this it its as at by with from than then may can cannot".split()


def search_terms(text: Column) -> Column:
    """Words of two or more letters or digits that are not stop words, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
