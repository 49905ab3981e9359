"""Aggregations: model quality, risk figures, forecast summaries, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.operators import metrics, quantiles
from duecast.operators.combine import combine_assessments
from duecast.plans import lens_sql as L
from duecast.plans.filtering import SCORED, flagged, scored
from duecast.sources import lenses


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


CURVES = ["brier", "accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc", "prevalence", "roc_auc", "pr_auc"]


def classification(spark, root):
    # Brier is reported to four digits; the last of six can fall on a tie between two ways of summing.
    return _rounded(_rounded(metrics.classification(lenses.scores(spark, root), "y", "p"), 4, "brier"), 6, *CURVES[1:])


_AUC = """g AS (SELECT p, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM scores GROUP BY p),
  r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM g),
  auc AS (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc FROM r)"""
CLASSIFICATION_SQL = f"""WITH {L.SCORES}, {_AUC},
  c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn,
               count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, avg((p - y) * (p - y)) AS b FROM scores)
  SELECT tp, tn, fp, fn, round(b, 4) AS brier, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy,
    round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1,
    round(tn::DOUBLE / (tn + fp), 6) AS specificity, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 6) AS balanced_accuracy,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
    round((tp + fn)::DOUBLE / (tp + tn + fp + fn), 6) AS prevalence, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM c, auc"""


def regression(spark, root):
    df = metrics.regression(lenses.forecasts(spark, root), "units_sold", "forecast_value")
    return _rounded(df, 4, "mae", "mse", "rmse", "r2", "wape", "mape", "median_absolute_error")


REGRESSION_SQL = f"""WITH {L.FORECASTS}, e AS (SELECT units_sold AS y, units_sold - forecast_value AS e FROM forecasts)
  SELECT count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse,
    round(1 - avg(e * e) / var_pop(y), 4) AS r2, round(sum(abs(e)) / sum(abs(y)), 4) AS wape,
    round(avg(abs(e / y)) FILTER (y <> 0), 4) AS mape, round(median(abs(e)), 4) AS median_absolute_error FROM e"""


def threshold_sweep(spark, root):
    return _rounded(metrics.threshold_report(lenses.scores(spark, root), "y", "p"), 6, "precision", "recall", "f1")


_SWEEP = f"""{L.SCORES},
  t AS (SELECT 0.10::DOUBLE + 0.01::DOUBLE * i AS th FROM range(71) r(i)),
  c AS (SELECT th, count(*) FILTER (y = 1 AND p >= th) AS tp, count(*) FILTER (y = 0 AND p >= th) AS fp, count(*) FILTER (y = 1 AND p < th) AS fn
        FROM t, scores GROUP BY th),
  sweep AS (SELECT round(th, 2) AS threshold, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
    round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    fp AS false_positives, fn AS false_negatives, tp + fp AS reviews,
    round(fn * 10.0::DOUBLE + fp * 1.0::DOUBLE + (tp + fp) * 0.1::DOUBLE, 2) AS estimated_cost FROM c)"""

KPI_SQL = f"""WITH {SCORED} SELECT count(*) AS total_records, count(*) FILTER (risk_tier = 'HIGH_RISK') AS high_risk,
  count(*) FILTER (risk_tier = 'MEDIUM_RISK') AS medium_risk, count(*) FILTER (risk_tier = 'LOW_RISK') AS low_risk,
  round(avg(risk_score), 4) AS average_risk FROM scored"""


def assessments(spark, root):
    """Two scores per client: the mean over all orders, and over finished ones."""
    df = lenses.scores(spark, root)
    tier = lambda c: F.when(F.col(c) < 0.48, "LOW_RISK").when(F.col(c) < 0.52, "MEDIUM_RISK").otherwise("HIGH_RISK")
    first = df.where("status_code <> 'O'").groupBy("client_id").agg(F.round(F.avg("p"), 9).alias("behavior_probability"))
    second = df.where("status_code <> 'F'").groupBy("client_id").agg(F.round(F.avg("p"), 9).alias("loan_probability"))
    return combine_assessments(
        first.withColumn("behavior_tier", tier("behavior_probability")), second.withColumn("loan_tier", tier("loan_probability"))
    )


_TIER = "CASE WHEN {0} < 0.48::DOUBLE THEN 'LOW_RISK' WHEN {0} < 0.52::DOUBLE THEN 'MEDIUM_RISK' WHEN {0} IS NOT NULL THEN 'HIGH_RISK' END"
ASSESSED = f"""{L.SCORES},
  f AS (SELECT client_id, round(avg(p), 9) AS behavior_probability FROM scores WHERE status_code <> 'O' GROUP BY 1),
  l AS (SELECT client_id, round(avg(p), 9) AS loan_probability FROM scores WHERE status_code <> 'F' GROUP BY 1),
  j AS (SELECT coalesce(f.client_id, l.client_id) AS client_id, behavior_probability, {_TIER.format('behavior_probability')} AS behavior_tier,
               loan_probability, {_TIER.format('loan_probability')} AS loan_tier FROM f FULL JOIN l ON f.client_id = l.client_id),
  assessed AS (SELECT *,
    CASE WHEN behavior_tier = 'HIGH_RISK' OR loan_tier = 'HIGH_RISK' THEN 'MANUAL_REVIEW'
         WHEN behavior_tier = 'MEDIUM_RISK' AND loan_tier = 'MEDIUM_RISK' THEN 'MANUAL_REVIEW'
         WHEN behavior_tier = 'MEDIUM_RISK' OR loan_tier = 'MEDIUM_RISK' THEN 'REVIEW_RECOMMENDED' ELSE 'STANDARD_PROCESS' END AS final_status,
    CASE WHEN behavior_tier = 'HIGH_RISK' OR loan_tier = 'HIGH_RISK' THEN 'At least one internal model reports high risk.'
         WHEN behavior_tier = 'MEDIUM_RISK' AND loan_tier = 'MEDIUM_RISK' THEN 'Both internal models report medium risk.'
         WHEN behavior_tier = 'MEDIUM_RISK' OR loan_tier = 'MEDIUM_RISK' THEN 'At least one internal model reports medium risk.'
         ELSE 'All available internal models report low risk.' END AS decision_reason,
    concat_ws(' + ', CASE WHEN behavior_tier IS NOT NULL THEN 'Payment behavior' END, CASE WHEN loan_tier IS NOT NULL THEN 'Loan profile' END) AS models_used
    FROM j)"""

DECISIONS_SQL = f"""WITH {ASSESSED} SELECT count(*) AS total, count(*) FILTER (final_status = 'MANUAL_REVIEW') AS manual_review,
  count(*) FILTER (final_status = 'REVIEW_RECOMMENDED') AS review_recommended, count(*) FILTER (final_status = 'STANDARD_PROCESS') AS standard_process,
  format('{{:,}}', count(*)) || ' customers assessed' AS headline FROM assessed"""


def forecast_summary(spark, root):
    """Demand rolled up to days, summarised over the whole span."""
    daily = flagged(spark, root).groupBy("date").agg(
        F.sum("forecast_value").alias("forecast_value"), F.max("is_anomaly").alias("is_anomaly"),
        (F.sum("inventory_level") < F.sum("forecast_value")).alias("cash_shortfall_risk"),
    )
    return _rounded(metrics.forecast_summary(daily, "date"), 2, "forecast_total")


FORECAST_SUMMARY_SQL = f"""WITH {L.FORECASTS},
  d AS (SELECT date, sum(forecast_value) AS f, max(abs(units_sold - forecast_value)) > 20 AS a, sum(inventory_level) < sum(forecast_value) AS s
        FROM forecasts GROUP BY date)
  SELECT round(sum(f), 2) AS forecast_total, count(*) FILTER (a) AS anomalies, count(*) FILTER (s) AS cash_shortfall_periods,
         CASE WHEN max_by(f, date) < min_by(f, date) THEN 'decline' ELSE 'stable or improving trend' END AS trend FROM d"""


def horizon(spark, root):
    totals = metrics.horizon_totals(lenses.forecasts(spark, root))
    return _rounded(metrics.horizon_edges(totals), 4, "first_value", "last_value", "lowest_value")


HORIZON_SQL = f"""WITH {L.FORECASTS}, d AS (SELECT date, sum(forecast_value) AS f FROM forecasts GROUP BY date)
  SELECT round(min_by(f, date), 4) AS first_value, round(max_by(f, date), 4) AS last_value, max(date) AS last_date, round(min(f), 4) AS lowest_value,
         min_by(date, {{'f': f, 'd': date}}) AS lowest_date, count(*) AS periods FROM d"""

BALANCE_SQL = f"""WITH {L.SCORES} SELECT count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives,
  count(*) FILTER (y = 0)::DOUBLE / count(*) FILTER (y = 1) AS positive_weight FROM scores"""

NUMERIC = ["LIMIT_BAL", "AGE", "BILL_AMT1", "PAY_AMT1", "BILL_AMT6"]


def quantile_table(spark, root):
    """Quartiles, median and outlier bounds per column."""
    df = lenses.credit(spark, root)
    found = quantiles.exact_quantiles(df, {c: F.col(c) for c in NUMERIC}, [0.25, 0.5, 0.75])
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.lit(v).alias(n) for v, n in zip(found[c], ("q1", "median", "q3"))]) for c in NUMERIC]
    out = df.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*rows)))
    spread = F.col("q3") - F.col("q1")
    out = out.withColumns({"lower": F.col("q1") - 1.5 * spread, "upper": F.col("q3") + 1.5 * spread})
    return _rounded(out, 4, "q1", "median", "q3", "lower", "upper")


QUANTILES_SQL = f"WITH {L.CREDIT}, q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, quantile_cont({c}::DOUBLE, 0.25) AS q1, median({c}::DOUBLE) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM credit"
    for c in NUMERIC
) + """) SELECT column_name, rows, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(q1 - 1.5::DOUBLE * (q3 - q1), 4) AS lower, round(q3 + 1.5::DOUBLE * (q3 - q1), 4) AS upper FROM q"""

MODE_COLUMNS = ["EDUCATION", "MARRIAGE", "segment", "AGE", "PAY_0"]


def column_modes(spark, root):
    return quantiles.modes(lenses.credit(spark, root), MODE_COLUMNS)


MODES_SQL = f"WITH {L.CREDIT} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS mode, count(*) AS count FROM credit WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    for c in MODE_COLUMNS
)


def deviation(spark, root):
    df = lenses.forecasts(spark, root)
    return _rounded(metrics.residual_deviation(df, F.col("units_sold") - F.col("forecast_value")), 6, "deviation")


QUERIES = {
    "measure_classification": classification,
    "measure_regression": regression,
    "measure_threshold_sweep": threshold_sweep,
    "measure_cheapest_threshold": lambda s, r: _rounded(
        metrics.cheapest_threshold(metrics.threshold_report(lenses.scores(s, r), "y", "p")), 6, "precision", "recall", "f1"
    ),
    "measure_risk_kpi": lambda s, r: _rounded(metrics.risk_kpi(scored(s, r)), 4, "average_risk"),
    "measure_decisions": lambda s, r: metrics.decision_summary(assessments(s, r)),
    "measure_forecast_summary": forecast_summary,
    "measure_horizon": horizon,
    "measure_class_balance": lambda s, r: metrics.class_balance(lenses.scores(s, r), "y"),
    "measure_quantiles": quantile_table,
    "measure_modes": column_modes,
    "measure_residual_deviation": deviation,
    "join_assessments": assessments,
}
SQL = {
    "measure_classification": CLASSIFICATION_SQL,
    "measure_regression": REGRESSION_SQL,
    "measure_threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "measure_cheapest_threshold": f"WITH {_SWEEP} SELECT * FROM sweep ORDER BY estimated_cost, threshold LIMIT 1",
    "measure_risk_kpi": KPI_SQL,
    "measure_decisions": DECISIONS_SQL,
    "measure_forecast_summary": FORECAST_SUMMARY_SQL,
    "measure_horizon": HORIZON_SQL,
    "measure_class_balance": BALANCE_SQL,
    "measure_quantiles": QUANTILES_SQL,
    "measure_modes": MODES_SQL,
    "measure_residual_deviation": f"WITH {L.FORECASTS} SELECT round(stddev_samp(units_sold - forecast_value), 6) AS deviation FROM forecasts",
    "join_assessments": f"WITH {ASSESSED} SELECT * FROM assessed",
}
