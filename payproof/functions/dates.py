"""Ways to read a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of published data, day first, in order.
LENIENT = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy")
#: Formats of receipts, month first, in order.
RECEIPT = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yy", "d/M/yy")
#: Pairs that change places when the day comes first.
SWAPPED = {"M/d/yyyy": "d/M/yyyy", "M-d-yyyy": "d-M-yyyy", "M/d/yy": "d/M/yy"}


def strict_date(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def first_of(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def lenient_date(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """A date in one of ``formats`` or the usual ones; a time after it is dropped."""
    t = F.regexp_replace(F.trim(text), r"[T ](?=.*:).*$", "")
    return first_of(t, (*formats, *LENIENT))


def receipt_date(text: Column, dayfirst: bool = False) -> Column:
    """A date as receipts write it: ordinals and commas allowed; 03/04/2026 is month first unless ``dayfirst``."""
    back = {v: k for k, v in SWAPPED.items()}
    order = tuple((SWAPPED | back).get(f, f) for f in RECEIPT) if dayfirst else RECEIPT
    t = F.regexp_replace(F.regexp_replace(F.trim(text), ",", " "), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    return first_of(F.trim(F.regexp_replace(t, r"\s+", " ")), order)
