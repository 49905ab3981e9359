"""Column functions and row-level features."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.functions import values as v
from duecast.operators import features
from duecast.operators.filters import safe_sample
from duecast.operators.projection import interval
from duecast.plans import lens_sql as L
from duecast.sources import lenses
from duecast.sources.tables import read


def numbers(spark, root):
    df = lenses.credit_text(spark, root)
    return df.select("c_custkey", *[v.number(F.col(c)).alias(c) for c in ("AGE", "EDUCATION", "PAY_0", "BILL_AMT2")])


NUMBERS_SQL = f"WITH {L.CREDIT_TEXT} SELECT c_custkey, " + ", ".join(
    f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("AGE", "EDUCATION", "PAY_0", "BILL_AMT2")
) + " FROM credit_text"


def dates(spark, root):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    written = ["MM/dd/yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "yyyy.M.d", "dd-MMM-yyyy", "M/d/yyyy HH:mm", "MMMM d yyyy"]
    text = (
        F.when(key % 7 == 6, F.element_at(F.array(*[F.date_format("o_orderdate", w) for w in written]), (key % 8 + 1).cast("int")))
        .when(key % 7 == 0, F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".0")))
        .when(key % 7 == 1, F.date_format(day, "yyyyMMdd"))
        .when(key % 7 == 2, "20241341")
        .when(key % 7 == 3, "not a date")
        .when(key % 7 == 4, F.concat(F.lit(" "), day.cast("string")))
        .when(key % 7 == 5, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    )
    df = read(spark, root, "orders").select("o_orderkey", day.alias("day"), text.alias("text"))
    return df.select(
        "o_orderkey",
        v.parse_date(F.col("text")).alias("parsed"),
        v.parse_spreadsheet_date(F.col("text")).alias("parsed_with_serial"),
        v.days_between(F.lit("1998-06-30").cast("date"), F.col("day")).alias("age_days"),
    )


DATES_SQL = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 IN (0, 1, 4, 6) THEN CAST(o_orderdate AS DATE) END AS parsed,
  CASE WHEN o_orderkey % 7 IN (0, 1, 4, 5, 6) THEN CAST(o_orderdate AS DATE) END AS parsed_with_serial,
  CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30'), 0) AS INTEGER) AS age_days FROM orders"""


def calendar(spark, root):
    df = lenses.invoices(spark, root)
    return df.select("row_id", *[c.alias(n) for n, c in v.calendar_parts(F.col("posting_date")).items()])


CALENDAR_SQL = f"""WITH {L.INVOICES} SELECT row_id, CAST(year(posting_date) AS INTEGER) AS year, CAST(month(posting_date) AS INTEGER) AS month,
  CAST(isodow(posting_date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(posting_date) AS INTEGER) AS day_of_year,
  CASE WHEN isodow(posting_date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM invoices"""


def date_features(spark, root):
    df = lenses.invoices(spark, root).withColumn("validated", F.lit("x"))
    return features.add_date_features(df.select("row_id", "posting_date", "due_date", "clear_date", "validated"))


DATE_FEATURES_SQL = f"""WITH {L.INVOICES} SELECT row_id, 'x' AS validated, """ + ", ".join(
    f"CAST(year({c}) AS INTEGER) AS {c}_year, CAST(month({c}) AS INTEGER) AS {c}_month, CAST(isodow({c}) - 1 AS INTEGER) AS {c}_dayofweek"
    for c in ("posting_date", "due_date", "clear_date")
) + ", CAST(due_date - posting_date AS INTEGER) AS days_posting_to_due FROM invoices"


def credit_behaviour(spark, root):
    df = features.add_credit_behaviour(lenses.credit(spark, root))
    rounded = [F.round(c, 4).alias(c) for c in features.CREDIT_ENGINEERED if c != "delay_count"]
    return df.select("client_id", "delay_count", *rounded)


def _sum(columns):
    return " + ".join(f"coalesce({c}, 0)" for c in columns)


_BILLS_PRESENT = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in L.BILLS)
_ABS_BILLS = " + ".join(f"coalesce(abs({c}), 0)" for c in L.BILLS)
CREDIT_BEHAVIOUR_SQL = f"""WITH {L.CREDIT} SELECT client_id,
  round(BILL_AMT1 / nullif(abs(LIMIT_BAL), 0), 4) AS utilization_ratio_1,
  round(({_sum(L.BILLS)}) / nullif({_BILLS_PRESENT}, 0) / nullif(abs(LIMIT_BAL), 0), 4) AS utilization_ratio_mean,
  round(PAY_AMT1 / nullif(abs(BILL_AMT1), 0), 4) AS pay_ratio_1,
  round(({_sum(L.PAYMENTS)}) / nullif({_ABS_BILLS}, 0), 4) AS pay_ratio_mean,
  round(greatest({', '.join(L.PAY_STATUS)})::DOUBLE, 4) AS delay_months_max,
  CAST({' + '.join(f'CASE WHEN {c} > 0 THEN 1 ELSE 0 END' for c in L.PAY_STATUS)} AS INTEGER) AS delay_count,
  round(BILL_AMT1 - BILL_AMT6, 4) AS bill_trend, round({_sum(L.PAYMENTS)}, 4) AS payment_total, round({_sum(L.BILLS)}, 4) AS bill_total
  FROM credit"""


def money_fields(spark, root):
    df = features.add_money_fields(lenses.demand(spark, root))
    return df.select("date", "store_id", "product_id", F.round("gross_revenue", 4).alias("gross_revenue"), F.round("revenue", 4).alias("revenue"))


MONEY_SQL = f"""WITH {L.DEMAND} SELECT date, store_id, product_id, round(units_sold * price, 4) AS gross_revenue,
  round(units_sold * price - coalesce(discount_amount, 0), 4) AS revenue FROM demand"""


def cash_fields(spark, root):
    df = features.add_money_fields(lenses.cash(spark, root))
    return df.select("entity", "period", F.round("net_cashflow", 4).alias("net_cashflow"))


CASH_SQL = f"WITH {L.CASH} SELECT entity, period, round(cash_inflow - cash_outflow, 4) AS net_cashflow FROM cash"


def targets(spark, root):
    """The target chosen for the demand and for the cash view, with the number of usable values."""
    parts = []
    for name, df in (("demand", lenses.demand(spark, root)), ("cash", lenses.cash(spark, root))):
        target = features.choose_target(df)
        parts.append(features.add_money_fields(df).agg(F.lit(name).alias("source"), F.lit(target).alias("target"), F.count(target).alias("n")))
    return parts[0].unionByName(parts[1])


TARGETS_SQL = f"""WITH {L.DEMAND}, {L.CASH} SELECT 'demand' AS source, 'revenue' AS target, count(*) AS n FROM demand
  UNION ALL SELECT 'cash', 'net_cashflow', count(*) FROM cash"""


def defaults(spark, root):
    df = lenses.demand_text(spark, root).select("row_id", v.number(F.col("inventory_level")).alias("inventory_level"))
    return features.fill_demand_defaults(df)


DEFAULTS_SQL = f"""WITH {L.DEMAND_TEXT} SELECT row_id, coalesce(TRY_CAST(inventory_level AS DOUBLE), 0) AS inventory_level,
  'Unknown' AS category, 'Unknown' AS region, 'Unknown' AS weather_conditions, 0.0::DOUBLE AS promotions_holidays FROM demand_text"""


def tiers(spark, root):
    df = lenses.scores(spark, root)
    return df.select("row_id", *[v.tier(F.col("p"), *bounds).alias(f"tier_{name}") for name, bounds in v.TIER_BOUNDS.items()])


TIERS_SQL = f"WITH {L.SCORES} SELECT row_id, " + ", ".join(
    f"CASE WHEN p < {lo}::DOUBLE THEN 'LOW_RISK' WHEN p < {hi}::DOUBLE THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS tier_{n}"
    for n, lo, hi in (("behaviour", 0.5, 0.6), ("loan", 0.25, 0.5), ("run", 0.4, 0.7), ("scoring", 0.35, 0.65))
) + " FROM scores"


def labels(spark, root):
    key = F.col("o_orderkey")
    target = F.when(key % 4 == 0, "revenue").when(key % 4 == 1, " Net_Cashflow").when(key % 4 == 2, "gross_margin")
    factor = F.when(key % 3 == 0, "previous_late_ratio").when(key % 3 == 1, "Total_Open_Amount").otherwise("order_status")
    shown = F.when(key % 5 > 0, F.col("o_totalprice"))
    return read(spark, root, "orders").select(
        "o_orderkey", v.mode_label(target).alias("mode"), v.factor_label(factor).alias("factor"), v.display_number(shown).alias("shown")
    )


LABELS_SQL = """SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Net cashflow' WHEN 2 THEN 'Gross Margin' ELSE 'Demand' END AS mode,
  CASE o_orderkey % 3 WHEN 0 THEN 'Previous late-payment rate' WHEN 1 THEN 'Invoice amount' ELSE 'Order Status' END AS factor,
  CASE WHEN o_orderkey % 5 > 0 THEN format('{:,.2f}', o_totalprice) ELSE 'Not available' END AS shown FROM orders"""


def masked(spark, root):
    df = read(spark, root, "documents").select("doc_id", "text", "source")
    return safe_sample(df, sensitive=["source"], order=["doc_id"], rows=20)


MASKED_SQL = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, substring(text, 1, 80) AS text, '[MASKED]' AS source FROM documents ORDER BY documents.doc_id LIMIT 20"""


def signatures(spark, root):
    df = lenses.credit_text(spark, root)
    columns = [F.col(c) for c in features.CREDIT_FEATURES]
    return df.select("c_custkey", v.signature(columns).alias("signature"), v.row_hash(columns).alias("hash"))


_SIGNATURE = " || '|' || ".join(f"coalesce({c}, '<NA>')" for c in features.CREDIT_FEATURES)
SIGNATURES_SQL = f"WITH {L.CREDIT_TEXT} SELECT c_custkey, {_SIGNATURE} AS signature, sha256({_SIGNATURE}) AS hash FROM credit_text"


def safe_ids(spark, root):
    return read(spark, root, "pages").select("page_id", v.safe_id(F.col("url")).alias("tenant"))


SAFE_IDS_SQL = "SELECT page_id, substring(regexp_replace(trim(url), '[^A-Za-z0-9_-]+', '_', 'g'), 1, 80) AS tenant FROM pages"


def intervals(spark, root):
    forecast = F.col("forecast_value") - 40
    df = lenses.forecasts(spark, root).select("date", "store_id", "product_id", forecast.alias("f"), F.lit(12.5).alias("sd"))
    low, high = interval(F.col("f"), F.col("sd"))
    return df.select(
        "date", "store_id", "product_id", F.round(F.greatest("f", F.lit(0.0)), 2).alias("forecast"),
        F.round(low, 4).alias("forecast_lower"), F.round(high, 4).alias("forecast_upper"),
    )


INTERVALS_SQL = f"""WITH {L.FORECASTS} SELECT date, store_id, product_id, round(greatest(forecast_value - 40, 0), 2) AS forecast,
  round(greatest(forecast_value - 40 - 1.96::DOUBLE * 12.5::DOUBLE, 0), 4) AS forecast_lower,
  round(forecast_value - 40 + 1.96::DOUBLE * 12.5::DOUBLE, 4) AS forecast_upper FROM forecasts"""


def loan_rows(spark, root):
    return features.loan_layout(lenses.accepted_loans(spark, root))


LOAN_SELECT = """SELECT id AS LoanID, 40.0::DOUBLE AS Age, annual_inc::DOUBLE AS Income, replace(loan_amnt, ',', '')::DOUBLE AS LoanAmount,
  coalesce((fico_range_low::DOUBLE + fico_range_high::DOUBLE) / 2, 650) AS CreditScore,
  least(coalesce(TRY_CAST(regexp_extract(emp_length, '(\\d+)', 1) AS DOUBLE), 0) * 12, 600) AS MonthsEmployed,
  total_acc::DOUBLE AS NumCreditLines, replace(int_rate, '%', '')::DOUBLE AS InterestRate,
  TRY_CAST(regexp_extract(term, '(\\d+)', 1) AS DOUBLE) AS LoanTerm, dti::DOUBLE AS DTIRatio, 'Unknown' AS Education,
  'Unknown' AS EmploymentType, 'Unknown' AS MaritalStatus, CASE WHEN upper(home_ownership) = 'MORTGAGE' THEN 'Yes' ELSE 'No' END AS HasMortgage,
  'Unknown' AS HasDependents, purpose AS LoanPurpose, CASE WHEN application_type <> 'Individual' THEN 'Yes' ELSE 'No' END AS HasCoSigner,
  CASE WHEN loan_status = ' Charged Off ' THEN 1 ELSE 0 END AS "Default" """
LOANS_SQL = f"WITH {L.ACCEPTED_LOANS} {LOAN_SELECT} FROM accepted_loans WHERE loan_status <> 'Current'"

QUERIES = {
    "scalar_numbers": numbers,
    "scalar_dates": dates,
    "scalar_calendar": calendar,
    "scalar_date_features": date_features,
    "scalar_credit_behaviour": credit_behaviour,
    "scalar_money_fields": money_fields,
    "scalar_cash_fields": cash_fields,
    "scalar_target_choice": targets,
    "scalar_demand_defaults": defaults,
    "scalar_risk_tiers": tiers,
    "scalar_labels": labels,
    "scalar_masked_sample": masked,
    "scalar_row_signatures": signatures,
    "scalar_safe_ids": safe_ids,
    "scalar_intervals": intervals,
    "ingest_loan_layout": loan_rows,
}
SQL = {
    "scalar_numbers": NUMBERS_SQL,
    "scalar_dates": DATES_SQL,
    "scalar_calendar": CALENDAR_SQL,
    "scalar_date_features": DATE_FEATURES_SQL,
    "scalar_credit_behaviour": CREDIT_BEHAVIOUR_SQL,
    "scalar_money_fields": MONEY_SQL,
    "scalar_cash_fields": CASH_SQL,
    "scalar_target_choice": TARGETS_SQL,
    "scalar_demand_defaults": DEFAULTS_SQL,
    "scalar_risk_tiers": TIERS_SQL,
    "scalar_labels": LABELS_SQL,
    "scalar_masked_sample": MASKED_SQL,
    "scalar_row_signatures": SIGNATURES_SQL,
    "scalar_safe_ids": SAFE_IDS_SQL,
    "scalar_intervals": INTERVALS_SQL,
    "ingest_loan_layout": LOANS_SQL,
}
