"""Row filters, search and display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.functions.values import as_double, number, parse_date
from duecast.operators.sketches import EXACT, column_facts
from duecast.operators.skew import ROWS_PER_TASK, split_hot

# Keywords that make a column a good search field, best first.
SEARCH_KEYWORDS = [
    (("client_id", "customer_id", "customer", "client"), 100),
    (("id",), 80),
    (("name",), 70),
    (("code",), 60),
    (("number",), 50),
]


def keep_tiers(df: DataFrame, tiers: Sequence[str], column: str = "risk_tier") -> DataFrame:
    """Rows of the chosen tiers; choosing none keeps no row. [F1]"""
    return df.where(F.col(column).isin(list(tiers))) if tiers else df.limit(0)


def keep_tiers_and_scores(df: DataFrame, tiers: Sequence[str], low: float, high: float) -> DataFrame:
    """Chosen tiers with a score from low to high, both included. [F2]"""
    return keep_tiers(df, tiers).where(F.col("risk_score").between(low, high))


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive regular expression on the cell's text; a missing cell never matches."""
    return F.coalesce(column.cast("string").rlike(f"(?i){pattern}"), F.lit(False))


def search(df: DataFrame, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which any of the columns (default: all) matches. [F3, F4]"""
    found = F.lit(False)
    for name in columns or df.columns:
        found = found | matches(F.col(name), pattern)
    return df.where(found)


def keep_choices(df: DataFrame, **choices: Sequence[str]) -> DataFrame:
    """Filter by value lists; an empty list means no filter. [F5]"""
    for name, values in choices.items():
        if values and name in df.columns:
            df = df.where(F.col(name).cast("string").isin(list(values)))
    return df


def keep_anomalies(df: DataFrame) -> DataFrame:
    """[F6]"""
    return df.where("is_anomaly")


def known_outcomes(df: DataFrame, due: str | None, clear: str | None, target: str | None = None) -> DataFrame:
    """Rows with a usable outcome, as ``y``: both dates, or a target of 0 or 1. [F10]"""
    if due and clear:
        return df.where(F.col(due).isNotNull() & F.col(clear).isNotNull()).withColumn("y", (F.col(clear) > F.col(due)).cast("int"))
    if target is None:
        raise ValueError("Either two dates or a target column is needed.")
    value = as_double(df, target)
    return df.where(value.isin(0.0, 1.0)).withColumn("y", value.cast("int"))


def demand_problems(df: DataFrame, row_id: str, keep: str = "first", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``is_problem``: rows that cannot be used to train a demand model. [F8, W15]

    Of rows with the same date, store and product the first (or last) by ``row_id`` is kept: one window over
    the three keys, whose rows are few. A key with more rows than a task should hold is settled by a map-side
    combined minimum instead.
    """
    required = ["date", "store_id", "product_id", "units_sold"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        return df.withColumn("is_problem", F.lit(True))
    bad = F.lit(False)
    for name in required:
        bad = bad | F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True))
    day, units = parse_date(F.col("date").cast("string")), number(F.col("units_sold").cast("string"))
    bad = bad | day.isNull() | F.coalesce(units < 0, F.lit(True))
    if "inventory_level" in df.columns:
        bad = bad | F.coalesce(number(F.col("inventory_level").cast("string")) < 0, F.lit(True))
    keys = required[:3]
    plain, hot = split_hot(df, keys, rows_per_task)
    order = F.col(row_id).asc_nulls_last() if keep == "first" else F.col(row_id).desc_nulls_last()
    found = plain.withColumn("is_problem", bad | (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1))
    if hot is None:
        return found
    pick = F.min if keep == "first" else F.max
    kept = hot.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(pick(row_id).alias("_kept"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    crowded = hot.join(F.broadcast(kept), same).withColumn("is_problem", bad | ~F.col(row_id).eqNullSafe(F.col("_kept")))  # hot keys are few
    return found.unionByName(crowded.select(*found.columns))


def best_search_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Columns scored as search fields, best first, from one pass over the table. [F12]

    Distinct counts near a limit of the score are exact; ``approximate`` leaves all of them estimates.
    """
    kinds = dict(df.dtypes)
    # A missing cell counts with the length of the word "None".
    facts = column_facts(
        df, df.columns, total=lambda value: F.coalesce(F.length(value), F.lit(4)),
        limits=lambda f: (0.1 * f.rows, 0.9 * f.rows), exact_up_to=None if approximate else EXACT,
    )
    scored = []
    for position, name in enumerate(df.columns):
        points = next((p for words, p in SEARCH_KEYWORDS if any(w in name.lower() for w in words)), 0)
        f = facts[name]
        share, length = (f.distinct / f.rows, f.measures["total"] / f.rows) if f.rows else (0.0, 0.0)
        spread = 30 if 0.1 <= share <= 0.9 else 10 if share > 0.9 else 5
        if kinds[name] == "string":
            shape = 20 + (25 if 3 <= length <= 50 else 0)
        else:
            shape = 15 if kinds[name] in ("bigint", "double") else 0
        scored.append((name, points + spread + shape, position))
    return df.sparkSession.createDataFrame(scored, "column_name string, score int, position int").orderBy(F.desc("score"), "position")


def display_rows(df: DataFrame, order: Sequence, rows: int = 2000) -> DataFrame:
    """The first rows in an explicit order. [F13]"""
    return df.orderBy(*order).limit(rows)


def safe_sample(df: DataFrame, sensitive: Sequence[str], order: Sequence[str], rows: int = 5) -> DataFrame:
    """A few rows with sensitive columns masked and text cut to 80 characters. [X21]"""
    shown = [
        F.lit("[MASKED]").alias(c) if c in sensitive else F.substring(F.col(c).cast("string"), 1, 80).alias(c) for c in df.columns
    ]
    return df.orderBy(*order).limit(rows).select(*shown)
