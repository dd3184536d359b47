"""Thresholds of the controls, their defaults, and profiles that set them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from decimal import Decimal

D = Decimal


@dataclass(frozen=True)
class Config:
    """What a finance team sets.  The defaults are fixed values."""

    receipt_required_above: Decimal = D("75.00")
    signature_required_above: Decimal = D("2500.00")
    approval_limit: Decimal = D("10000.00")
    total_tolerance: Decimal = D("0.05")
    max_uplift_ratio: Decimal = D("0.35")
    stale_after_days: int = 90
    split_window_days: int = 14
    split_proximity: Decimal = D("0.90")
    min_confidence: float = 0.60
    approved_vendors: tuple[str, ...] = ()
    round_floor: Decimal | None = None
    round_step: Decimal | None = None
    approval_limit_enabled: bool = True
    stale_check_enabled: bool = True
    lookback_days: int = 180
    near_dup_window_days: int = 7
    near_dup_amount_ratio: Decimal = D("0.005")
    near_dup_vendor_similarity: float = 0.92
    benford_min_n: int = 300
    benford_floor: Decimal | None = None
    sequential_min_run: int = 3

    @classmethod
    def of(cls, values: dict) -> Config:
        """From JSON values; an unknown key is an error."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(values) - set(kinds)):
            raise ValueError(f"unknown config keys: {', '.join(unknown)}")
        made = {}
        for k, v in values.items():
            if "Decimal" in kinds[k]:
                v = None if v is None else D(str(v))
            elif k == "approved_vendors":
                v = tuple(v)
            made[k] = v
        return replace(cls(), **made)


#: Round amounts by currency, (floor, step); any other currency 500, 100.
ROUND_RULES = {
    "JPY": (D(50000), D(10000)),
    "KRW": (D(50000), D(10000)),
    "INR": (D(50000), D(1000)),
    "IDR": (D(5000000), D(100000)),
    "VND": (D(5000000), D(100000)),
}
ROUND_DEFAULT = (D(500), D(100))

#: The smallest amount that totals are rounded to in cash, by currency; any other currency 0.
ROUNDING_UNITS = {"IDR": D(100), "VND": D(100), "KRW": D(10), "JPY": D(1)}

#: Header spellings for columns that a profile does not name, in order of preference.
HEADER_ALIASES = {
    "id": ("id", "document_id"),
    "vendor": ("vendor", "vendor_name", "supplier", "supplier name", "payee", "merchant", "recipient_name"),
    "total": ("total", "total_amount", "amount", "amount paid", "value", "gross amount"),
    "date": ("date", "invoice_date", "payment date", "transaction date", "action_date"),
    "subtotal": ("subtotal", "net amount"),
    "tax": ("tax", "tax_amount", "vat"),
    "invoice_number": ("invoice_number", "invoice no", "invoice number"),
    "currency": ("currency",),
    "confidence": ("confidence", "ocr_confidence"),
    "today": ("audit_date", "submitted_date"),
}


@dataclass(frozen=True)
class Profile:
    """How to read a dataset: column names, date formats (Spark patterns), currency, audit date, thresholds."""

    name: str = ""
    currency: str | None = None
    today: str | None = None
    licence: str | None = None
    config: Config = field(default_factory=Config)
    columns: dict = field(default_factory=dict)
    date_formats: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: dict) -> Profile:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown profile keys: {', '.join(unknown)}")
        columns = {k: (v,) if isinstance(v, str) else tuple(v) for k, v in (values.get("columns") or {}).items() if v is not None}
        if unknown := sorted(set(columns) - set(HEADER_ALIASES)):
            raise ValueError(f"unknown profile columns: {', '.join(unknown)}")
        rest = {k: v for k, v in values.items() if k not in ("config", "columns", "date_formats")}
        return cls(config=Config.of(values.get("config") or {}), columns=columns, date_formats=tuple(spark_pattern(f) for f in values.get("date_formats") or ()), **rest)

    @classmethod
    def read(cls, spark, path: str) -> Profile:
        """A profile from a JSON file in any store that Spark reads."""
        return cls.of(json.loads(spark.read.text(path, wholetext=True).first()[0]))


#: Strftime codes and their Spark patterns.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s"}


def spark_pattern(form: str) -> str:
    """A date pattern for Spark from one with strftime codes; one without stays."""
    for code, pattern in STRFTIME.items():
        form = form.replace(code, pattern)
    return form
