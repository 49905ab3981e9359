"""Row-level feature builders: credit behaviour, dates, money, loan files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.functions.values import (
    as_double,
    finite, first_digits, midpoint, months_from_years, parse_date, percent_number, ratio, row_count, row_max, row_mean,
    row_sum, yes_no,
)

# The credit contract.
PAY_STATUS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAYMENTS = [f"PAY_AMT{i}" for i in range(1, 7)]
CREDIT_FEATURES = ["LIMIT_BAL", "AGE", "EDUCATION", "MARRIAGE", *PAY_STATUS, *BILLS, *PAYMENTS]
CREDIT_TARGET = "default_next_month"
CREDIT_ID = "client_id"
CREDIT_ENGINEERED = [
    "utilization_ratio_1", "utilization_ratio_mean", "pay_ratio_1", "pay_ratio_mean", "delay_months_max", "delay_count",
    "bill_trend", "payment_total", "bill_total",
]

# The loan contract.
LOAN_NUMERIC = [
    "Age", "Income", "LoanAmount", "CreditScore", "MonthsEmployed", "NumCreditLines", "InterestRate", "LoanTerm", "DTIRatio",
]
LOAN_CATEGORICAL = [
    "Education", "EmploymentType", "MaritalStatus", "HasMortgage", "HasDependents", "LoanPurpose", "HasCoSigner",
]
LOAN_GOOD = ["fully paid"]
LOAN_BAD = ["charged off", "default", "late (31-120 days)", "late (16-30 days)"]

# Money columns and forecast targets in order of preference.
MONEY_COLUMNS = ["units_sold", "price", "discount_amount", "refund_amount", "cash_inflow", "cash_outflow"]
TARGET_PREFERENCE = ["net_cashflow", "cash_inflow", "revenue", "net_revenue", "units_sold"]

# What optional demand columns are filled with.
DEMAND_DEFAULTS = {
    "category": "Unknown", "region": "Unknown", "weather_conditions": "Unknown", "inventory_level": 0.0, "promotions_holidays": 0.0,
}


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that exist, as doubles; bad cells become NULL. [X1]"""
    return df.withColumns({c: as_double(df, c) for c in columns if c in df.columns})


def add_credit_behaviour(df: DataFrame) -> DataFrame:
    """Nine ratios and totals over six monthly bills, payments and delays. [X12-X14]"""
    d = as_numbers(df, CREDIT_FEATURES)
    bills, payments, delays = ([F.col(c) for c in names] for names in (BILLS, PAYMENTS, PAY_STATUS))
    limit, last_bill = F.abs("LIMIT_BAL"), F.abs("BILL_AMT1")
    values = {
        "utilization_ratio_1": ratio(F.col("BILL_AMT1"), limit),
        "utilization_ratio_mean": ratio(row_mean(bills), limit),
        "pay_ratio_1": ratio(F.col("PAY_AMT1"), last_bill),
        "pay_ratio_mean": ratio(row_sum(payments), row_sum([F.abs(b) for b in bills])),
        "delay_months_max": row_max(delays),
        "delay_count": row_count([x > 0 for x in delays]),
        "bill_trend": F.col("BILL_AMT1") - F.col("BILL_AMT6"),
        "payment_total": row_sum(payments),
        "bill_total": row_sum(bills),
    }
    counts = {"delay_count": values.pop("delay_count")}
    return d.withColumns({**{n: finite(v) for n, v in values.items()}, **counts})


def add_date_features(df: DataFrame, minimum_share: float = 0.5) -> DataFrame:
    """Every column with ``date`` in its name and enough readable dates becomes year, month and weekday. [X10]"""
    named = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    dated = [c for c in df.columns if "date" in named[c]]
    parsed = {c: F.col(c) if dict(df.dtypes)[c] == "date" else parse_date(F.col(c).cast("string")) for c in df.columns}
    used: list[str] = []
    if dated:
        shares = df.agg(*[F.avg(parsed[c].isNotNull().cast("double")).alias(c) for c in dated]).first()
        used = [c for c in dated if (shares[c] or 0.0) >= minimum_share]
    made: dict[str, Column] = {}
    for c in used:
        base = named[c].replace(".", "_")
        made[f"{base}_year"] = F.year(parsed[c])
        made[f"{base}_month"] = F.month(parsed[c])
        made[f"{base}_dayofweek"] = F.weekday(parsed[c])
    by_name = {v: k for k, v in reversed(named.items())}
    posting = by_name.get("posting_date")
    due = by_name.get("due_in_date") or by_name.get("due_date")
    created = by_name.get("document_create_date")
    if posting and due:
        made["days_posting_to_due"] = F.datediff(parsed[due], parsed[posting])
    if posting and created:
        made["days_creation_to_posting"] = F.datediff(parsed[posting], parsed[created])
    return df.select(*[F.col(c) for c in df.columns if c not in used], *[v.alias(n) for n, v in made.items()])


def add_money_fields(df: DataFrame) -> DataFrame:
    """Revenue and net cash flow where their inputs exist; nothing is invented. [X15]"""
    d = as_numbers(df, MONEY_COLUMNS)
    if "revenue" not in d.columns and {"units_sold", "price"} <= set(d.columns):
        d = d.withColumn("gross_revenue", F.col("units_sold") * F.col("price"))
        net = F.col("gross_revenue")
        for reduction in ("discount_amount", "refund_amount"):
            if reduction in d.columns:
                net = net - F.coalesce(F.col(reduction), F.lit(0.0))
        d = d.withColumn("revenue", net)
    if {"cash_inflow", "cash_outflow"} <= set(d.columns):
        d = d.withColumn("net_cashflow", F.col("cash_inflow") - F.col("cash_outflow"))
    return d


def choose_target(df: DataFrame, requested: str | None = None, minimum: int = 30) -> str:
    """The requested target, else the first preferred one with enough numbers; one aggregate. [X16]"""
    d = add_money_fields(df)
    if requested and requested in d.columns:
        return requested
    present = [c for c in TARGET_PREFERENCE if c in d.columns]
    if present:
        counts = d.agg(*[F.count(as_double(d, c)).alias(c) for c in present]).first()
        for name in present:
            if counts[name] >= minimum:
                return name
    raise ValueError("Provide revenue, cash_inflow and cash_outflow, or units_sold with price.")


def fill_demand_defaults(df: DataFrame) -> DataFrame:
    """[X17]"""
    made = {}
    for name, value in DEMAND_DEFAULTS.items():
        made[name] = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumns(made)


def loan_layout(df: DataFrame, require_target: bool = True, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """An accepted-loan file in the loan contract; with a target, matured loans only. [S12, X5-X8, F7]

    ``carry`` adds columns computed from the source rows.
    """
    present = set(df.columns)
    if require_target and "loan_status" not in present:
        raise ValueError("This file has no loan_status, so it holds no repayment outcome.")

    def text(name: str, default: str | None = None) -> Column:
        if name not in present:
            return F.lit(default).cast("string")
        cell = F.col(name).cast("string")
        return cell if default is None else F.coalesce(cell, F.lit(default))

    lines = "total_acc" if "total_acc" in present else "open_acc"
    status = F.lower(F.trim(text("loan_status")))
    made = [
        text("id").alias("LoanID"),
        F.coalesce(percent_number(text("age")), F.lit(40.0)).alias("Age"),
        percent_number(text("annual_inc")).alias("Income"),
        percent_number(text("loan_amnt")).alias("LoanAmount"),
        midpoint(percent_number(text("fico_range_low")), percent_number(text("fico_range_high")), 650.0).alias("CreditScore"),
        months_from_years(text("emp_length")).alias("MonthsEmployed"),
        percent_number(text(lines)).alias("NumCreditLines"),
        percent_number(text("int_rate")).alias("InterestRate"),
        first_digits(text("term")).alias("LoanTerm"),
        percent_number(text("dti")).alias("DTIRatio"),
        F.lit("Unknown").alias("Education"),
        text("emp_title", "Unknown").alias("EmploymentType"),
        F.lit("Unknown").alias("MaritalStatus"),
        yes_no(F.coalesce(F.upper(text("home_ownership", "Unknown")) == "MORTGAGE", F.lit(False))).alias("HasMortgage"),
        F.lit("Unknown").alias("HasDependents"),
        text("purpose", "Unknown").alias("LoanPurpose"),
        yes_no(F.lower(text("application_type", "Individual")) != "individual").alias("HasCoSigner"),
    ]
    extra = [c.alias(n) for n, c in (carry or {}).items()]
    if not require_target:
        return df.select(*made, *extra)
    return df.where(status.isin(LOAN_GOOD + LOAN_BAD)).select(*made, status.isin(LOAN_BAD).cast("int").alias("Default"), *extra)
