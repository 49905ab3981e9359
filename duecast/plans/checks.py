"""Data quality: rule checks, row diagnostics, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.operators import quality
from duecast.operators.features import CREDIT_FEATURES, LOAN_NUMERIC, loan_layout
from duecast.plans import lens_sql as L
from duecast.plans.scalars import LOAN_SELECT
from duecast.sources import lenses

CREDIT_ALL = ["client_id", *CREDIT_FEATURES, "default_next_month"]


def _credit(spark, root):
    return lenses.credit_text(spark, root).select("source_row_number", *CREDIT_ALL)


def _plain(issues):
    return issues.select("level", "code", F.col("column").alias("column_name"), "count")


def _issue_sql(cte: str, table: str, checks: list[tuple[str, str, str, str]], having: str = "") -> str:
    """Issue rows from (level, code, column, count expression); zero counts are dropped."""
    parts = [f"SELECT '{lv}' AS level, '{code}' AS code, '{col}' AS column_name, {expr} AS count FROM {table}" for lv, code, col, expr in checks]
    return f"WITH {cte} SELECT level, code, column_name, CAST(count AS BIGINT) AS count FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


def _rule_checks(rules) -> list[tuple[str, str, str, str]]:
    out = []
    for r in rules:
        number = f"TRY_CAST({r.name} AS DOUBLE)"
        if r.required:
            out.append(("error", "missing_value", r.name, f"count(*) FILTER ({r.name} IS NULL)"))
        if r.kind in ("number", "integer"):
            out.append(("error", "invalid_number", r.name, f"count(*) FILTER ({r.name} IS NOT NULL AND {number} IS NULL)"))
            if r.minimum is not None:
                out.append(("error", "below_minimum", r.name, f"count(*) FILTER ({number} < {r.minimum})"))
            if r.maximum is not None:
                out.append(("error", "above_maximum", r.name, f"count(*) FILTER ({number} > {r.maximum})"))
            if r.accepted:
                out.append(("error", "invalid_category", r.name, f"count(*) FILTER ({number} NOT IN ({', '.join(map(str, r.accepted))}))"))
        elif r.kind == "date":
            out.append(("error", "invalid_date", r.name, f"count(*) FILTER ({r.name} IS NOT NULL AND TRY_CAST({r.name} AS DATE) IS NULL)"))
    return out


CREDIT_RULES = [*quality.CREDIT_RULES, quality.CREDIT_TARGET_RULE]
_CREDIT_REPEATS = f"(SELECT count(*) FROM credit_text) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CREDIT_ALL)} FROM credit_text))"
CREDIT_RULES_SQL = _issue_sql(L.CREDIT_TEXT, "credit_text", [*_rule_checks(CREDIT_RULES), ("warning", "duplicates", "", f"max({_CREDIT_REPEATS})")])

DEMAND_COLUMNS = ["date", "store_id", "product_id", "units_sold", "inventory_level"]
_DEMAND_RULES = [r for r in quality.DEMAND_RULES if r.name in DEMAND_COLUMNS]
_DUPLICATES = f"(SELECT count(*) FROM demand_text) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(DEMAND_COLUMNS)} FROM demand_text))"
DEMAND_RULES_SQL = _issue_sql(
    L.DEMAND_TEXT, "demand_text", [*_rule_checks(_DEMAND_RULES), ("warning", "duplicates", "", f"max({_DUPLICATES})")]
)


def demand_form(spark, root):
    """A daily file with display headers and without a category."""
    df = lenses.demand_text(spark, root).select(
        F.col("date").alias("Date"), F.col("store_id").alias("Store ID"), F.col("product_id").alias("Product ID "),
        F.col("units_sold").alias("Units Sold"), F.col("inventory_level").alias("Inventory Level"),
    )
    issues = quality.check_demand(df)
    return issues.select("level", "code", F.col("column").alias("column_name"), "count", "kind")


# "Product ID " keeps its trailing blank through the header map and is then only trimmed and lowered.
_FORM_CHECKS = [
    ("error", "missing_value", "inventory_level", "count(*) FILTER (inventory_level IS NULL)"),
    ("error", "invalid_date", "date", "count(*) FILTER (TRY_CAST(date AS DATE) IS NULL)"),
    ("error", "invalid_number", "units_sold", "count(*) FILTER (TRY_CAST(units_sold AS DOUBLE) IS NULL)"),
    ("warning", "duplicates", "", f"max({_DUPLICATES})"),
]
DEMAND_FORM_SQL = f"""SELECT *, 'daily_retail' AS kind FROM ({_issue_sql(L.DEMAND_TEXT, 'demand_text', _FORM_CHECKS)})
  UNION ALL SELECT 'error', 'missing_column', 'product_id', 0, 'daily_retail' UNION ALL SELECT 'error', 'missing_column', 'category', 0, 'daily_retail'"""

CREDIT_TABLE_SQL = f"""WITH {L.CREDIT_TEXT},
  f AS (SELECT count(*) FILTER (TRY_CAST(default_next_month AS DOUBLE) IS NULL OR TRY_CAST(default_next_month AS DOUBLE) NOT IN (0, 1)) AS bad,
               count(*) FILTER (TRY_CAST(AGE AS DOUBLE) < 18 OR TRY_CAST(AGE AS DOUBLE) > 110) AS age,
               count(*) FILTER (TRY_CAST(LIMIT_BAL AS DOUBLE) < 0) AS lim FROM credit_text)
  SELECT 'error' AS level, 'target_not_binary' AS code, 'default_next_month' AS column_name, bad AS count FROM f
  UNION ALL SELECT 'error', 'age_out_of_range', 'AGE', age FROM f UNION ALL SELECT 'error', 'negative_limit', 'LIMIT_BAL', lim FROM f"""

SERIES_SQL = f"""WITH {L.DEMAND_TEXT} SELECT 'error' AS level, 'invalid_date' AS code, 'date' AS column_name, count(*) AS count FROM demand_text
    WHERE TRY_CAST(date AS DATE) IS NULL
  UNION ALL SELECT 'error', 'duplicate_keys', '', (SELECT count(*) FROM demand_text) - (SELECT count(*) FROM (SELECT DISTINCT date, store_id, product_id FROM demand_text))
  UNION ALL SELECT 'error', 'negative_units', 'units_sold', count(*) FROM demand_text WHERE TRY_CAST(units_sold AS DOUBLE) < 0"""

LOAN_CHECK_SQL = f"""WITH {L.ACCEPTED_LOANS}, loans AS ({LOAN_SELECT} FROM accepted_loans WHERE loan_status <> 'Current')
  SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT 'error' AS level, 'incomplete_number' AS code, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS count FROM loans" for c in LOAN_NUMERIC
) + """ UNION ALL SELECT 'error', 'income_not_positive', 'Income', count(*) FILTER (Income <= 0) FROM loans
  UNION ALL SELECT 'error', 'score_out_of_range', 'CreditScore', count(*) FILTER (CreditScore NOT BETWEEN 300 AND 850) FROM loans) WHERE count > 0"""


def any_layout(spark, root):
    """Invoices stripped of their ids: repeated rows, a sparse column and flat numbers."""
    df = lenses.invoices(spark, root).select(
        "business_code", "document_type", F.when(F.col("row_id") % 3 == 0, F.col("clear_date")).alias("clear_date"),
        (F.col("row_id") % 3).cast("int").alias("group_number"), F.month("posting_date").alias("month"),
    )
    return _plain(quality.check_any(df, features=["group_number", "month"], training=True))


ANY_SQL = f"""WITH {L.INVOICES},
  d AS (SELECT business_code, document_type, CASE WHEN row_id % 3 = 0 THEN clear_date END AS clear_date, row_id % 3 AS g, month(posting_date) AS m FROM invoices)
  SELECT 'warning' AS level, 'duplicates' AS code, '' AS column_name, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS count
  UNION ALL SELECT 'warning', 'high_missing', 'clear_date', count(*) FROM d WHERE clear_date IS NULL
  UNION ALL SELECT 'warning', 'low_variance', 'group_number', count(DISTINCT g) FROM d
  UNION ALL SELECT 'warning', 'low_variance', 'month', count(DISTINCT m) FROM d"""

REPORT_SQL = f"""WITH {L.CREDIT_TEXT}, m AS (SELECT {' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in CREDIT_ALL)} AS missing FROM credit_text)
  SELECT count(*) AS rows, {len(CREDIT_ALL)}::BIGINT AS columns,
    (SELECT count(*) FROM credit_text) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(CREDIT_ALL)} FROM credit_text)) AS duplicate_rows,
    CAST(sum(missing) AS BIGINT) AS missing_cells, round(avg(missing) / {len(CREDIT_ALL)} * 100, 2) AS missing_percent FROM m"""


def diagnostics(spark, root):
    return quality.diagnose_credit(_credit(spark, root)).select(
        "source_row_number", "client_id", "validation_status", "issue_count", "issue_codes", "correction_status"
    )


def _diagnosis_codes() -> list[str]:
    n = lambda c: f"TRY_CAST({c} AS DOUBLE)"
    codes = [("MISSING_CLIENT_ID", "trim(client_id) = ''"), ("DUPLICATE_CLIENT_ID", "trim(client_id) <> '' AND same_id > 1")]
    for c in [*CREDIT_FEATURES, "default_next_month"]:
        codes.append(("MISSING_REQUIRED_VALUE", f"coalesce(trim({c}), '') = ''"))
        codes.append(("NON_NUMERIC_VALUE", f"coalesce(trim({c}), '') <> '' AND {n(c)} IS NULL"))
    codes.append(("TARGET_NOT_BINARY", f"{n('default_next_month')} NOT IN (0, 1)"))
    codes.append(("AGE_OUT_OF_RANGE", f"{n('AGE')} NOT BETWEEN 18 AND 110"))
    codes.append(("NEGATIVE_CREDIT_LIMIT", f"{n('LIMIT_BAL')} < 0"))
    codes += [("REPAYMENT_STATUS_OUT_OF_RANGE", f"{n(c)} NOT BETWEEN -2 AND 8") for c in L.PAY_STATUS]
    for c in L.BILLS:
        codes.append(("NEGATIVE_BILL_AMOUNT", f"{n(c)} < 0"))
        codes.append(("EXTREME_BILL_TO_LIMIT", f"{n('LIMIT_BAL')} > 0 AND abs({n(c)}) > 3 * {n('LIMIT_BAL')}"))
    codes += [("VERY_LARGE_PAYMENT", f"{n('LIMIT_BAL')} > 0 AND {n(c)} > 3 * {n('LIMIT_BAL')}") for c in L.PAYMENTS]
    codes.append(("CONFLICTING_DUPLICATE_FEATURES", "labels > 1"))
    codes.append(("REPEATED_CUSTOMER_BEHAVIOR", "same_behaviour >= 5"))
    return [f"CASE WHEN {condition} THEN '{code}' END" for code, condition in codes]


_SIGNATURE = " || '|' || ".join(f"coalesce({c}, '<NA>')" for c in CREDIT_FEATURES)
DIAGNOSED = f"""{L.CREDIT_TEXT},
  m AS (SELECT *, count(*) OVER (PARTITION BY trim(client_id)) AS same_id, {_SIGNATURE} AS sig FROM credit_text),
  b AS (SELECT sig, count(*) AS same_behaviour, count(DISTINCT default_next_month) AS labels FROM m GROUP BY sig),
  i AS (SELECT m.*, list_filter([{', '.join(_diagnosis_codes())}], lambda x: x IS NOT NULL) AS codes FROM m JOIN b USING (sig)),
  diagnosed AS (SELECT source_row_number, client_id,
    CASE WHEN len(list_filter(codes, lambda x: x NOT IN ('REPAYMENT_STATUS_OUT_OF_RANGE', 'NEGATIVE_BILL_AMOUNT', 'EXTREME_BILL_TO_LIMIT', 'VERY_LARGE_PAYMENT', 'REPEATED_CUSTOMER_BEHAVIOR'))) > 0
         THEN 'REJECTED' WHEN len(codes) > 0 THEN 'REVIEW' ELSE 'PASS' END AS validation_status,
    CAST(len(codes) AS INTEGER) AS issue_count, array_to_string(codes, ';') AS issue_codes,
    CASE WHEN len(codes) = 0 THEN 'VALID_AS_IS' ELSE '' END AS correction_status FROM i)"""


def coverage(spark, root):
    source = _credit(spark, root)
    return quality.check_coverage(source, quality.diagnose_credit(source))


COVERAGE_SQL = f"""WITH {DIAGNOSED} SELECT count(*) AS rows, count(DISTINCT source_row_number) AS distinct_rows,
  count(*) FILTER (validation_status = 'PASS') AS pass, count(*) FILTER (validation_status = 'REVIEW') AS review,
  count(*) FILTER (validation_status = 'REJECTED') AS rejected FROM diagnosed"""


def rejected(spark, root):
    return quality.route(quality.diagnose_credit(_credit(spark, root)))["REJECTED"].select("source_row_number", "AGE", "EDUCATION")


REJECTED_SQL = f"WITH {DIAGNOSED} SELECT source_row_number, AGE, EDUCATION FROM diagnosed JOIN credit_text USING (source_row_number) WHERE validation_status = 'REJECTED'"


def corrections(spark, root):
    """Bad ages are normalized, rows with an odd target excluded, all else left alone."""
    source = _credit(spark, root)
    age = quality.as_number(source, "AGE")
    odd = F.col("default_next_month") == "2"
    patch = source.select(
        "source_row_number", "client_id", F.lit("AGE").alias("field"),
        F.when(age.isNull() | (age > 110), "35").alias("corrected_value"),
        F.when(odd, "exclude_from_training").when(age.isNull(), "AUTO_CORRECTED").when(age > 110, " normalized ").otherwise("VALID_AS_IS")
        .alias("correction_status"),
    )
    fixed, _ = quality.apply_corrections(source, patch)
    return fixed.select("source_row_number", "client_id", "AGE", "EDUCATION")


CORRECTIONS_SQL = f"""WITH {L.CREDIT_TEXT} SELECT source_row_number, client_id,
  CASE WHEN coalesce(TRY_CAST(AGE AS DOUBLE), 999) > 110 THEN '35' ELSE AGE END AS AGE, EDUCATION FROM credit_text
  WHERE coalesce(default_next_month, '') <> '2'"""


def repeated_ids(spark, root):
    """How often each client id and behaviour occurs."""
    df = _credit(spark, root)
    marked = quality.add_repeats(df, F.col("client_id"), "same_id", conflict=F.col("EDUCATION"))
    return marked.select("source_row_number", "same_id", "conflict")


REPEATED_SQL = f"""WITH {L.CREDIT_TEXT},
  g AS (SELECT client_id, count(*) AS n, count(DISTINCT EDUCATION) > 1 AS c FROM credit_text GROUP BY client_id)
  SELECT source_row_number, CASE WHEN n > 1 THEN n END AS same_id, CASE WHEN n > 1 THEN c END AS conflict FROM credit_text JOIN g USING (client_id)"""

QUERIES = {
    "quality_credit_rules": lambda s, r: _plain(quality.check_rules(_credit(s, r).drop("source_row_number"), CREDIT_RULES, training=True)),
    "quality_demand_rules": lambda s, r: _plain(quality.check_rules(lenses.demand_text(s, r).select(*DEMAND_COLUMNS), quality.DEMAND_RULES)),
    "quality_demand_form": demand_form,
    "quality_credit_table": lambda s, r: _plain(quality.check_credit(_credit(s, r))),
    "quality_demand_series": lambda s, r: _plain(quality.check_demand_series(lenses.demand_text(s, r))),
    "quality_loans": lambda s, r: _plain(quality.check_loans(loan_layout(lenses.accepted_loans(s, r)))),
    "quality_any_layout": any_layout,
    "quality_report": lambda s, r: quality.quality_report(_credit(s, r).drop("source_row_number")),
    "quality_row_diagnostics": diagnostics,
    "quality_coverage": coverage,
    "quality_rejected_rows": rejected,
    "quality_corrections": corrections,
    "quality_repeated_keys": repeated_ids,
}
SQL = {
    "quality_credit_rules": CREDIT_RULES_SQL,
    "quality_demand_rules": DEMAND_RULES_SQL,
    "quality_demand_form": DEMAND_FORM_SQL,
    "quality_credit_table": CREDIT_TABLE_SQL,
    "quality_demand_series": SERIES_SQL,
    "quality_loans": LOAN_CHECK_SQL,
    "quality_any_layout": ANY_SQL,
    "quality_report": REPORT_SQL,
    "quality_row_diagnostics": f"WITH {DIAGNOSED} SELECT * FROM diagnosed",
    "quality_coverage": COVERAGE_SQL,
    "quality_rejected_rows": REJECTED_SQL,
    "quality_corrections": CORRECTIONS_SQL,
    "quality_repeated_keys": REPEATED_SQL,
}
