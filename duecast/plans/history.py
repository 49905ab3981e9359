"""Customer payment history."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.functions.values import TIER_BOUNDS, tier
from duecast.operators import history
from duecast.operators.serving import drop_empty_rows, mark_latest_as_current, prepare_assessment, split_records
from duecast.plans.lens_sql import INVOICES
from duecast.sources import lenses

ROUNDED = [
    "previous_late_ratio", "recent_5_late_ratio", "previous_average_invoice_amount", "invoice_vs_customer_average",
    "average_previous_delay_days",
]


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ROUNDED})


def training(spark, root, allow_exact=True):
    df = history.add_training_history(lenses.invoices(spark, root), allow_exact=allow_exact)
    return _rounded(df.select("row_id", *history.HISTORY_FEATURES))


def _training_sql(comparison: str) -> str:
    return f"""WITH {INVOICES},
    prior AS (
      SELECT *, row_number() OVER w - 1 AS cnt, sum(total_open_amount) OVER w - total_open_amount AS amt,
             lag(posting_date) OVER w AS prev
      FROM invoices WINDOW w AS (PARTITION BY cust_number ORDER BY posting_date, row_id)),
    ev AS (
      SELECT cust_number, row_id, clear_date AS known, CASE WHEN clear_date > due_date THEN 1.0 ELSE 0.0 END AS late,
             greatest(date_diff('day', due_date, clear_date), 0) AS delay
      FROM invoices WHERE clear_date IS NOT NULL),
    ev2 AS (
      SELECT *, row_number() OVER w AS seq, sum(late) OVER w AS late_count, avg(delay) OVER w AS avg_delay,
             max(delay) OVER w AS max_delay,
             avg(late) OVER (PARTITION BY cust_number ORDER BY known, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent,
             sum(CASE WHEN late <> 1 THEN 1 ELSE 0 END) OVER w AS island
      FROM ev WINDOW w AS (PARTITION BY cust_number ORDER BY known, row_id ROWS UNBOUNDED PRECEDING)),
    ev3 AS (
      SELECT *, sum(late) OVER (PARTITION BY cust_number, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS streak FROM ev2),
    daily AS (SELECT * FROM ev3 QUALIFY row_number() OVER (PARTITION BY cust_number, known ORDER BY seq DESC) = 1),
    joined AS (
      SELECT p.*, e.* EXCLUDE (cust_number, row_id)
      FROM prior p ASOF LEFT JOIN daily e ON p.cust_number = e.cust_number AND p.posting_date {comparison} e.known)
    SELECT row_id, CASE WHEN cnt > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS customer_history_available,
      cnt::DOUBLE AS previous_invoice_count, coalesce(late_count, 0)::DOUBLE AS previous_late_invoice_count,
      round(coalesce(late_count / seq, 0)::DOUBLE, 6) AS previous_late_ratio,
      round(coalesce(recent, 0)::DOUBLE, 6) AS recent_5_late_ratio,
      round(coalesce(amt / nullif(cnt, 0), 0)::DOUBLE, 6) AS previous_average_invoice_amount,
      round(coalesce(total_open_amount / nullif(amt / nullif(cnt, 0), 0), 0)::DOUBLE, 6) AS invoice_vs_customer_average,
      round(coalesce(avg_delay, 0)::DOUBLE, 6) AS average_previous_delay_days,
      coalesce(max_delay, 0)::DOUBLE AS maximum_previous_delay_days,
      coalesce(greatest(date_diff('day', prev, posting_date), 0), 0)::DOUBLE AS days_since_previous_invoice,
      coalesce(streak, 0)::DOUBLE AS consecutive_previous_late_count
    FROM joined"""


def risk_by_segment(spark, root):
    """Flagship: history features, a rule score from them, tiers and the KPI per business unit."""
    df = history.add_training_history(lenses.invoices(spark, root))
    score = 0.7 * F.col("previous_late_ratio") + 0.3 * F.col("recent_5_late_ratio")
    scored = df.select("business_code", F.round(score, 6).alias("risk_score"))
    scored = scored.withColumn("risk_tier", tier(F.col("risk_score"), *TIER_BOUNDS["scoring"]))
    return scored.groupBy("business_code").agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("risk_tier") == "HIGH_RISK").alias("high_risk"),
        F.count_if(F.col("risk_tier") == "MEDIUM_RISK").alias("medium_risk"),
        F.count_if(F.col("risk_tier") == "LOW_RISK").alias("low_risk"),
        F.round(F.avg("risk_score"), 4).alias("average_risk"),
    )


RISK_SQL = f"""WITH t AS ({_training_sql('>=')}),
  s AS (SELECT o_orderpriority AS business_code, round(0.7::DOUBLE * previous_late_ratio + 0.3::DOUBLE * recent_5_late_ratio, 6) AS r
        FROM t JOIN orders ON o_orderkey = row_id)
  SELECT business_code, count(*) AS total_records, count(*) FILTER (r >= 0.65) AS high_risk,
         count(*) FILTER (r >= 0.35 AND r < 0.65) AS medium_risk, count(*) FILTER (r < 0.35) AS low_risk,
         round(avg(r), 4) AS average_risk FROM s GROUP BY 1"""


def simple(spark, root):
    df = lenses.invoices(spark, root)
    df = df.withColumn("is_late", F.when(F.col("clear_date").isNotNull(), (F.col("clear_date") > F.col("due_date")).cast("int")))
    out = history.add_simple_history(df)
    return out.select(
        "row_id", "previous_invoice_count", "previous_late_invoice_count", F.round("previous_late_ratio", 6).alias("previous_late_ratio"),
        F.round("previous_average_invoice_amount", 6).alias("previous_average_invoice_amount"),
        F.round("invoice_vs_customer_average", 6).alias("invoice_vs_customer_average"),
    )


SIMPLE_SQL = f"""WITH {INVOICES},
  s AS (SELECT *, count(*) OVER w AS cnt, coalesce(sum(CASE WHEN clear_date > due_date THEN 1 ELSE 0 END) OVER w, 0) AS lates,
               avg(total_open_amount) OVER w AS mean
        FROM invoices WINDOW w AS (PARTITION BY cust_number ORDER BY posting_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT row_id, cnt AS previous_invoice_count, lates::DOUBLE AS previous_late_invoice_count,
         round(coalesce(lates::DOUBLE / nullif(cnt, 0), 0), 6) AS previous_late_ratio,
         round(mean, 6) AS previous_average_invoice_amount, round(total_open_amount / nullif(mean, 0), 6) AS invoice_vs_customer_average
  FROM s"""


def reference_layout(spark, root):
    """Invoice history read from text columns with mixed date layouts."""
    df = lenses.invoices(spark, root)
    compact = F.concat(F.date_format("posting_date", "yyyyMMdd"), F.lit(".0"))
    posting = F.when(F.col("row_id") % 3 == 0, compact).when(F.col("row_id") % 50 == 1, "unknown")
    text = df.select(
        "row_id",
        F.when(F.col("row_id") % 41 > 0, F.concat(F.lit(" "), F.col("cust_number").cast("string"))).alias("customer_id"),
        posting.otherwise(F.col("posting_date").cast("string")).alias("invoice_date"),
        F.col("due_date").cast("string").alias("due_in_date"),
        F.col("clear_date").cast("string").alias("clearing_date"),
        F.col("total_open_amount").alias("invoice_amount"),
    )
    return history.reference_history(text)


REFERENCE_SQL = f"""WITH {INVOICES}
  SELECT row_id, CAST(cust_number AS VARCHAR) AS cust_number, posting_date, due_date, clear_date, total_open_amount AS amount,
         CASE WHEN clear_date > due_date THEN 1.0 ELSE 0.0 END::DOUBLE AS is_late,
         CAST(CASE WHEN clear_date IS NOT NULL THEN greatest(date_diff('day', due_date, clear_date), 0) END AS INTEGER) AS delay_days
  FROM invoices WHERE row_id % 41 > 0 AND NOT (row_id % 3 <> 0 AND row_id % 50 = 1)"""

def _record_types(spark, root):
    df = lenses.invoices(spark, root)
    return df.withColumn("record_type", F.when(F.col("document_type") == "O", " current").otherwise("History"))


def serving(spark, root):
    """Open invoices assessed against the closed ones."""
    enriched, _ = prepare_assessment(_record_types(spark, root), required=["total_open_amount", "business_code"])
    return _rounded(enriched.select("row_id", *history.HISTORY_FEATURES))


SERVING_SQL = f"""WITH {INVOICES},
  h AS (SELECT *, CASE WHEN clear_date > due_date THEN 1.0 ELSE 0.0 END AS late,
               greatest(date_diff('day', due_date, clear_date), 0) AS delay FROM invoices WHERE document_type <> 'O'),
  c AS (SELECT * FROM invoices WHERE document_type = 'O'),
  pairs AS (
    SELECT c.row_id AS cid, c.posting_date AS at, c.total_open_amount AS own, h.*, h.clear_date <= c.posting_date AS observed,
           row_number() OVER (PARTITION BY c.row_id, h.clear_date <= c.posting_date ORDER BY h.posting_date DESC, h.row_id DESC) AS back
    FROM c JOIN h ON c.cust_number = h.cust_number AND h.posting_date < c.posting_date),
  agg AS (
    SELECT cid, count(*) AS n, sum(late) FILTER (observed) AS lates, avg(late) FILTER (observed) AS ratio,
           avg(late) FILTER (observed AND back <= 5) AS recent, avg(total_open_amount) AS mean,
           avg(delay) FILTER (observed) AS mean_delay, max(delay) FILTER (observed) AS max_delay, max(posting_date) AS last,
           count(*) FILTER (observed) AS outcomes, min(back) FILTER (observed AND late = 0) AS first_punctual
    FROM pairs GROUP BY cid)
  SELECT row_id, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS customer_history_available,
    coalesce(n, 0)::DOUBLE AS previous_invoice_count, coalesce(lates, 0)::DOUBLE AS previous_late_invoice_count,
    round(coalesce(ratio, 0)::DOUBLE, 6) AS previous_late_ratio, round(coalesce(recent, 0)::DOUBLE, 6) AS recent_5_late_ratio,
    round(coalesce(mean, 0)::DOUBLE, 6) AS previous_average_invoice_amount,
    round(coalesce(total_open_amount / nullif(mean, 0), 1)::DOUBLE, 6) AS invoice_vs_customer_average,
    round(coalesce(mean_delay, 0)::DOUBLE, 6) AS average_previous_delay_days,
    coalesce(max_delay, 0)::DOUBLE AS maximum_previous_delay_days,
    coalesce(date_diff('day', last, posting_date), 0)::DOUBLE AS days_since_previous_invoice,
    coalesce(coalesce(first_punctual - 1, outcomes), 0)::DOUBLE AS consecutive_previous_late_count
  FROM c LEFT JOIN agg ON cid = row_id"""


def assessment_counts(spark, root):
    """Without a record type the last invoice of a customer is the current one."""
    _, stats = prepare_assessment(lenses.invoices(spark, root), ["business_code", "previous_late_ratio"], order=["posting_date", "row_id"])
    return stats


ASSESSMENT_SQL = """SELECT count(*) - count(DISTINCT o_custkey) AS history_rows, count(DISTINCT o_custkey) AS current_rows,
  count(DISTINCT o_custkey) AS customers, count(*) > count(DISTINCT o_custkey) AS history_used, true AS model_uses_history FROM orders"""


def latest_current(spark, root):
    df = mark_latest_as_current(lenses.invoices(spark, root), "cust_number", ["posting_date", "row_id"])
    return df.select("row_id", "cust_number", "record_type")


LATEST_SQL = """SELECT o_orderkey AS row_id, o_custkey AS cust_number,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'Current' ELSE 'History' END AS record_type
  FROM orders"""


def record_split(spark, root):
    """Blank rows dropped, then rows per record type."""
    df = _record_types(spark, root)
    emptied = [F.when(F.col("row_id") % 37 > 0, F.col(c).cast("string")).otherwise(F.lit("  ")).alias(c) for c in df.columns]
    past, current = split_records(drop_empty_rows(df.select(*emptied)))
    return past.agg(F.lit("History").alias("record_type"), F.count("*").alias("rows"), F.min("posting_date").alias("first_day")).unionByName(
        current.agg(F.lit("Current").alias("record_type"), F.count("*").alias("rows"), F.min("posting_date").alias("first_day"))
    )


RECORD_SQL = f"""WITH {INVOICES}
  SELECT CASE document_type WHEN 'O' THEN 'Current' ELSE 'History' END AS record_type, count(*) AS rows,
         CAST(min(posting_date) AS VARCHAR) AS first_day
  FROM invoices WHERE row_id % 37 > 0 GROUP BY 1"""

QUERIES = {
    "history_serving_features": serving,
    "history_assessment_counts": assessment_counts,
    "history_latest_current": latest_current,
    "history_record_split": record_split,
    "risk_by_segment": risk_by_segment,
    "history_training_features": training,
    "history_training_strict": lambda s, r: training(s, r, allow_exact=False),
    "history_simple": simple,
    "history_reference_layout": reference_layout,
}
SQL = {
    "history_serving_features": SERVING_SQL,
    "history_assessment_counts": ASSESSMENT_SQL,
    "history_latest_current": LATEST_SQL,
    "history_record_split": RECORD_SQL,
    "risk_by_segment": RISK_SQL,
    "history_training_features": _training_sql(">="),
    "history_training_strict": _training_sql(">"),
    "history_simple": SIMPLE_SQL,
    "history_reference_layout": REFERENCE_SQL,
}
