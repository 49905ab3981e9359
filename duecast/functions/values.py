"""Coercion, ratios and text helpers on single columns.

Spark runs in ANSI mode, so text is always read with ``try_cast``: a bad value is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plain decimal and exponent notation. The JVM parser would also take "1d", "0x1p3" or "NaN".
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EXCEL_ORIGIN = "1899-12-30"
EXCEL_SERIAL_RANGE = (1, 80000)


def number(text: Column) -> Column:
    """Text to double, bad text to NULL."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def as_double(df: DataFrame, name: str) -> Column:
    """A column as finite double by one rule: text must be a plain number, NaN and infinities are NULL."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return finite(number(F.col(name)))
    value = F.col(name).try_cast("double")
    return finite(value) if kind in ("double", "float") else value


def blank(value: Column) -> Column:
    """True for NULL and for text of spaces only."""
    return F.coalesce(F.trim(value.cast("string")) == "", F.lit(True))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL when the denominator is 0 or missing."""
    return F.try_divide(top, bottom)


def percent_number(text: Column) -> Column:
    """``"1,234.5%"`` to 1234.5."""
    return number(F.translate(text, "%,", ""))


def first_digits(text: Column) -> Column:
    """First run of digits as a double, NULL when there is none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("double")


def months_from_years(text: Column) -> Column:
    """``"10+ years"`` to 120 months, kept within 0 to 600."""
    return F.least(F.coalesce(first_digits(text), F.lit(0.0)) * 12, F.lit(600.0))


def midpoint(low: Column, high: Column, default: float) -> Column:
    return F.coalesce((low + high) / 2, F.lit(default))


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def _written_date(text: Column, day_first: bool) -> Column:
    """Dates with slashes, dots or dashes, and with month names; a time of day behind them is ignored."""

    def read(value: Column, *layouts: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)).cast("date") for layout in layouts])

    mark = r"[/.\-]"
    year_first = F.regexp_replace(F.regexp_extract(text, rf"^(\d{{4}}{mark}\d{{1,2}}{mark}\d{{1,2}})(?:[ T].*)?$", 1), mark, "/")
    year_last = F.regexp_replace(F.regexp_extract(text, rf"^(\d{{1,2}}{mark}\d{{1,2}}{mark}\d{{4}})(?:[ T].*)?$", 1), mark, "/")
    named = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2}[ -][A-Za-z]{3,9}\.?,?[ -]\d{4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4})(?: .*)?$", 1), r"[.,\- ]+", " ")
    order = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    return (
        F.when(year_first != "", read(year_first, "yyyy/M/d"))
        .when(year_last != "", read(year_last, *order))
        .when(named != "", read(named, "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy"))
    )


def parse_date(text: Column, day_first: bool = False) -> Column:
    """Date text in the first layout that fits, else NULL.

    In order: compact ``yyyyMMdd`` (also with a trailing ``.0``), ISO, year first with other marks, day and
    month (month first unless ``day_first``, the other way where only that is a date), month names.
    """
    trimmed = F.trim(text)
    raw = F.when(F.endswith(trimmed, F.lit(".0")), F.substring(trimmed, F.lit(1), F.length(trimmed) - 2)).otherwise(trimmed)
    # Cheap tests come first, so that most cells never meet a regular expression.
    compact = F.when((F.length(raw) == 8) & raw.rlike(r"^\d{8}$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")).cast("date"))
    general = F.when((F.substring(raw, 5, 1) == "-") & raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), raw.try_cast("date"))
    rest = F.when((F.length(raw) >= 8) & ~raw.rlike(r"^\d+$"), _written_date(raw, day_first))
    return F.coalesce(compact, general, rest)


def parse_spreadsheet_date(text: Column, day_first: bool = False) -> Column:
    """As ``parse_date``, but a number from 1 to 80000 is a spreadsheet day serial."""
    low, high = EXCEL_SERIAL_RANGE
    value = number(text)
    serial = F.when(value.between(low, high), F.date_add(F.lit(EXCEL_ORIGIN).cast("date"), F.floor(value).cast("int")))
    return F.coalesce(serial, parse_date(text, day_first))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, not below 0."""
    return F.greatest(F.datediff(later, earlier), F.lit(0))


def calendar_parts(day: Column) -> dict[str, Column]:
    """Weekday counts from Monday = 0."""
    weekday = F.weekday(day)
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day_of_week": weekday,
        "day_of_year": F.dayofyear(day),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across columns; missing cells count as 0."""
    total = F.coalesce(columns[0].cast("double"), F.lit(0.0))
    for column in columns[1:]:
        total = total + F.coalesce(column.cast("double"), F.lit(0.0))
    return total


def row_count(conditions: Sequence[Column]) -> Column:
    """How many conditions hold; an unknown one does not."""
    total = F.lit(0)
    for condition in conditions:
        total = total + F.when(condition, 1).otherwise(0)
    return total


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the cells present, NULL when all are missing."""
    return ratio(row_sum(columns), row_count([c.isNotNull() for c in columns]).cast("double"))


def row_max(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns)


def tier(score: Column, review: float | Column, high: float | Column,
         labels: Sequence[str] = ("LOW_RISK", "MEDIUM_RISK", "HIGH_RISK")) -> Column:
    """Three risk tiers; a score equal to a bound belongs to the upper tier."""
    low_label, mid_label, high_label = labels
    return (
        F.when(score.isNull(), None).when(score < review, low_label).when(score < high, mid_label).otherwise(high_label)
    )


# The bounds used by each caller.
TIER_BOUNDS = {
    "behaviour": (0.50, 0.60),
    "loan": (0.25, 0.50),
    "run": (0.40, 0.70),
    "scoring": (0.35, 0.65),
}

# Names of forecast targets.
MODE_LABELS = {
    "revenue": "Revenue",
    "cash_inflow": "Cash inflow",
    "cash_outflow": "Cash outflow",
    "net_cashflow": "Net cashflow",
    "units_sold": "Demand",
}

# Reader-facing names of risk factors.
FACTOR_LABELS = {
    "total_open_amount": "Invoice amount",
    "business_code": "Business unit",
    "buisness_year": "Business year",
    "business_year": "Business year",
    "invoice_currency": "Invoice currency",
    "document type": "Document type",
    "cust_payment_terms": "Customer payment terms",
    "payment_window_days": "Payment window",
    "previous_late_ratio": "Previous late-payment rate",
    "average_previous_delay_days": "Average previous delay",
    "maximum_previous_delay_days": "Maximum previous delay",
    "previous_invoice_count": "Previous invoice count",
    "invoice_vs_customer_average": "Amount compared with customer average",
}


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    """A small constant table as a map literal."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def mode_label(target: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(target, F.lit("units_sold"))))
    return F.coalesce(lookup(key, MODE_LABELS), F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def factor_label(name: Column) -> Column:
    plain = F.initcap(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))
    return F.coalesce(lookup(F.lower(F.trim(name)), FACTOR_LABELS), plain)


def display_number(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 2), F.lit("Not available"))


def safe_id(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only, at most 80 characters."""
    return F.substring(F.regexp_replace(F.trim(text), "[^A-Za-z0-9_-]+", "_"), 1, 80)


def signature(columns: Sequence[Column]) -> Column:
    """All cells of a row as one text, missing cells as ``<NA>``."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<NA>")) for c in columns])


def row_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(signature(columns), 256)


def order_key(columns: Sequence[Column], seed: int) -> Column:
    """A repeatable pseudo-random 60-bit number per row, equal in every engine with md5."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
