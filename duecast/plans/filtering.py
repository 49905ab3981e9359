"""Filters, search and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.functions.values import TIER_BOUNDS, tier
from duecast.operators import filters
from duecast.plans import lens_sql as L
from duecast.sources import lenses


def scored(spark, root):
    df = lenses.scores(spark, root)
    return df.select(
        "row_id", "client_id", "segment", F.col("p").alias("risk_score"), tier(F.col("p"), *TIER_BOUNDS["scoring"]).alias("risk_tier")
    )


SCORED = f"""{L.SCORES}, scored AS (SELECT row_id, client_id, segment, p AS risk_score,
  CASE WHEN p < 0.35::DOUBLE THEN 'LOW_RISK' WHEN p < 0.65::DOUBLE THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_tier FROM scores)"""


def flagged(spark, root):
    return lenses.forecasts(spark, root).withColumn("is_anomaly", F.abs(F.col("units_sold") - F.col("forecast_value")) > 20)


def outcomes(spark, root):
    return filters.known_outcomes(lenses.invoices(spark, root), "due_date", "clear_date").select("row_id", "y")


def binary_targets(spark, root):
    df = filters.known_outcomes(lenses.credit_text(spark, root), None, None, "default_next_month")
    return df.select("c_custkey", "y")


def problems(spark, root, keep="first"):
    df = filters.demand_problems(lenses.demand_text(spark, root).withColumn("row_id", F.struct("row_id", "amount")), "row_id", keep)
    return df.select("row_id.row_id", F.col("row_id.amount").alias("amount"), "is_problem")


def _problems_sql(direction: str) -> str:
    return f"""WITH {L.DEMAND_TEXT},
      n AS (SELECT *, dense_rank() OVER (PARTITION BY date, store_id, product_id ORDER BY row_id {direction}, amount {direction}) AS rn FROM demand_text)
      SELECT row_id, amount, rn > 1 OR trim(store_id) = '' OR TRY_CAST(date AS DATE) IS NULL
        OR coalesce(TRY_CAST(units_sold AS DOUBLE), -1) < 0 OR coalesce(TRY_CAST(inventory_level AS DOUBLE), -1) < 0 AS is_problem FROM n"""


def search_column(spark, root):
    df = scored(spark, root)
    return filters.best_search_column(df).select("column_name", "score")


SEARCH_COLUMN_SQL = f"""WITH {SCORED}, f AS (
    SELECT count(*) AS n, count(DISTINCT row_id) AS a, count(DISTINCT client_id) AS b, count(DISTINCT segment) AS c,
           count(DISTINCT risk_score) AS d, count(DISTINCT risk_tier) AS e, avg(length(segment)) AS lc, avg(length(risk_tier)) AS le FROM scored),
  s AS (SELECT unnest([
    {{'column_name': 'row_id', 'points': 80 + 15, 'share': a / n}}, {{'column_name': 'client_id', 'points': 100 + 15, 'share': b / n}},
    {{'column_name': 'segment', 'points': 20 + CASE WHEN lc BETWEEN 3 AND 50 THEN 25 ELSE 0 END, 'share': c / n}},
    {{'column_name': 'risk_score', 'points': 15, 'share': d / n}},
    {{'column_name': 'risk_tier', 'points': 20 + CASE WHEN le BETWEEN 3 AND 50 THEN 25 ELSE 0 END, 'share': e / n}}], recursive := true) FROM f)
  SELECT column_name, CAST(points + CASE WHEN share BETWEEN 0.1 AND 0.9 THEN 30 WHEN share > 0.9 THEN 10 ELSE 5 END AS INTEGER) AS score FROM s"""

QUERIES = {
    "filter_tiers": lambda s, r: filters.keep_tiers(scored(s, r), ["HIGH_RISK", "LOW_RISK"]),
    "filter_no_tier": lambda s, r: filters.keep_tiers(scored(s, r), []),
    "filter_tiers_and_scores": lambda s, r: filters.keep_tiers_and_scores(scored(s, r), ["MEDIUM_RISK"], 0.4, 0.5),
    "filter_search_column": lambda s, r: filters.search(scored(s, r), "urgent|^4", ["segment"]),
    "filter_search_all": lambda s, r: filters.search(scored(s, r), "medium"),
    "filter_choices": lambda s, r: filters.keep_choices(
        lenses.forecasts(s, r).select("date", "store_id", "product_id", "units_sold"), store_id=["ASIA", "EUROPE"], product_id=[]
    ),
    "filter_anomalies": lambda s, r: filters.keep_anomalies(flagged(s, r)).select("date", "store_id", "product_id"),
    "filter_known_outcomes": outcomes,
    "filter_binary_targets": binary_targets,
    "filter_demand_problems": problems,
    "filter_demand_problems_keep_last": lambda s, r: problems(s, r, "last"),
    "filter_best_search_column": search_column,
    "filter_display_rows": lambda s, r: filters.display_rows(scored(s, r), [F.desc("risk_score"), "row_id"]),
}
SQL = {
    "filter_tiers": f"WITH {SCORED} SELECT * FROM scored WHERE risk_tier IN ('HIGH_RISK', 'LOW_RISK')",
    "filter_no_tier": f"WITH {SCORED} SELECT * FROM scored WHERE 1 = 0",
    "filter_tiers_and_scores": f"WITH {SCORED} SELECT * FROM scored WHERE risk_tier = 'MEDIUM_RISK' AND risk_score >= 0.4::DOUBLE AND risk_score <= 0.5::DOUBLE",
    "filter_search_column": f"WITH {SCORED} SELECT * FROM scored WHERE regexp_matches(segment, '(?i)urgent|^4')",
    "filter_search_all": f"WITH {SCORED} SELECT * FROM scored WHERE lower(segment) LIKE '%medium%' OR lower(risk_tier) LIKE '%medium%'",
    "filter_choices": f"WITH {L.FORECASTS} SELECT date, store_id, product_id, units_sold FROM forecasts WHERE store_id IN ('ASIA', 'EUROPE')",
    "filter_anomalies": f"WITH {L.FORECASTS} SELECT date, store_id, product_id FROM forecasts WHERE abs(units_sold - forecast_value) > 20",
    "filter_known_outcomes": f"WITH {L.INVOICES} SELECT row_id, CASE WHEN clear_date > due_date THEN 1 ELSE 0 END AS y FROM invoices WHERE clear_date IS NOT NULL",
    "filter_binary_targets": f"WITH {L.CREDIT_TEXT} SELECT c_custkey, CAST(default_next_month AS INTEGER) AS y FROM credit_text WHERE default_next_month IN ('0', '1')",
    "filter_demand_problems": _problems_sql("ASC"),
    "filter_demand_problems_keep_last": _problems_sql("DESC"),
    "filter_best_search_column": SEARCH_COLUMN_SQL,
    "filter_display_rows": f"WITH {SCORED} SELECT * FROM scored ORDER BY risk_score DESC, row_id LIMIT 2000",
}
