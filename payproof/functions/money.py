"""Three ways to read an amount: strict, lenient, and as written on receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_MONEY_TEXT, MONEY


def strict_money(text: Column) -> Column:
    """A plain decimal, maybe in scientific notation, of 40 characters at most, spaces around it allowed; else null."""
    t = F.trim(text)
    plain = t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.length(t) <= MAX_MONEY_TEXT)
    return F.when(plain, t).try_cast(MONEY)


def lenient_money(text: Column) -> Column:
    """Digits, dots and minus signs of a published amount; parentheses make it negative; over one dot gives null."""
    t = F.trim(text)
    kept = F.regexp_replace(t, r"[^0-9.\-]", "")
    amount = F.when(F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit(""))) <= 1, kept).try_cast(MONEY)
    return F.when(t.startswith("(") & t.endswith(")"), -F.abs(amount)).otherwise(amount)


def receipt_money(text: Column) -> Column:
    """An amount as a receipt writes it, in either convention.

    With both separators the last one is the decimal point.  One separator alone groups thousands if it is repeated or
    three digits follow (60.000 is sixty thousand), else it is the decimal point.
    """
    t = F.trim(F.regexp_replace(text, r"[^0-9.,\-]", ""))
    negative = t.startswith("-")
    t = F.replace(t, F.lit("-"), F.lit(""))
    last_dot, last_comma = F.length(t) - F.locate(".", F.reverse(t)), F.length(t) - F.locate(",", F.reverse(t))
    both = t.contains(".") & t.contains(",")
    dot_last = both & (last_dot > last_comma)
    grouped = t.rlike(r"^[0-9]+[.,][0-9]{3}$") | t.rlike(r"[.,].*[.,]")
    none, dot = F.lit(""), F.lit(".")
    plain = F.when(dot_last, F.replace(t, F.lit(","), none)).when(both, F.replace(F.replace(t, dot, none), F.lit(","), dot)).when(grouped, F.regexp_replace(t, "[.,]", "")).otherwise(F.replace(t, F.lit(","), dot))
    amount = F.when(t.rlike("[0-9]"), plain).try_cast(MONEY)
    return F.when(negative, -amount).otherwise(amount)
