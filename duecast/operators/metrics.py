"""Exact quality measures of classifiers and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.functions.values import ratio
from duecast.operators.quantiles import SMALL, exact_quantiles
from duecast.operators.skew import ROWS_PER_TASK, add_prior_sums
from duecast.session import materialize

# Cost of a missed case, a false alert and a review; thresholds from 0.10 to 0.80 by 0.01.
MISS_COST, FALSE_ALERT_COST, REVIEW_COST = 10.0, 1.0, 0.1
THRESHOLDS = [0.10 + 0.01 * i for i in range(71)]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _rates(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    total, recall, specificity = tp + tn + fp + fn, ratio(tp, tp + fn), ratio(tn, tn + fp)
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return [
        ratio(tp + tn, total).alias("accuracy"),
        _or_zero(ratio(tp, tp + fp)).alias("precision"),
        _or_zero(recall).alias("recall"),
        _or_zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        specificity.alias("specificity"),
        # With one class only, the rate of that class.
        F.coalesce((recall + specificity) / 2, recall, specificity).alias("balanced_accuracy"),
        _or_zero(ratio(tp * tn - fp * fn, spread)).alias("mcc"),
        ratio(tp + fn, total).alias("prevalence"),
    ]


def _score_groups(df: DataFrame, label: str, score: str, by: Sequence[str], rows_per_task: int) -> DataFrame:
    """One row per distinct score (and group): its classes and the classes from the top score down to it.

    Counting ``df`` reads no score: Catalyst drops what the count does not need. Only a table
    that may exceed one task is written out, so that scoring still runs once.
    """
    positive = F.col(label) == 1
    groups = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(positive).cast("double").alias("pos"), F.count_if(~positive).cast("double").alias("neg")
    )
    rows = df.count()
    if rows > rows_per_task:
        groups = materialize(groups, "scores")
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    return add_prior_sums(groups, list(by), [F.desc("score")], sums, rows_per_task, include_current=True, at_most=rows)


def _curve_sums() -> list[Column]:
    return [
        F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("losses"),
        F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("steps"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    ]


def _areas() -> list[Column]:
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return [
        F.when(both, 1 - F.col("losses") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.col("p")).alias("pr_auc"),
    ]


def ranking_quality(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """ROC-AUC with average ranks and average precision, NULL when only one class occurs. [A2, A3]

    A positive is beaten by the negatives above it and by half of those it ties with.
    """
    return _score_groups(df, label, score, by, rows_per_task).groupBy(*by).agg(*_curve_sums()).select(*by, *_areas())


def classification(df: DataFrame, label: str, score: str, threshold: float = 0.5, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All classification measures in one row, from one pass over the scores. [A1-A4]"""
    s, flagged = F.col("score"), F.col("score") >= threshold
    sums = _score_groups(df, label, score, (), rows_per_task).agg(
        *_curve_sums(),
        F.sum(F.when(flagged, F.col("pos")).otherwise(0.0)).alias("hits"),
        F.sum(F.when(flagged, F.col("neg")).otherwise(0.0)).alias("alarms"),
        F.sum(F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s).alias("squares"),
    )
    tp, fp = F.col("hits"), F.col("alarms")
    tn, fn = F.col("n") - fp, F.col("p") - tp
    counts = [c.cast("bigint").alias(n) for n, c in (("tp", tp), ("tn", tn), ("fp", fp), ("fn", fn))]
    return sums.select(*counts, ratio(F.col("squares"), F.col("p") + F.col("n")).alias("brier"), *_rates(tp, tn, fp, fn), *_areas())


def regression(df: DataFrame, actual: str, predicted: str, small: int = SMALL) -> DataFrame:
    """Error measures of a forecast in one row; a measure with a zero denominator is NULL. [A5]"""
    pairs = df.select(F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("f"))
    if df.count() <= small:
        rows, exact = pairs.where("y is not null and f is not null"), True
    else:  # several passes follow: compute the predictions once
        rows, exact = materialize(pairs.where("y is not null and f is not null"), "predictions"), False
    y = F.col("y")
    error = y - F.col("f")
    middle = F.percentile(F.abs(error), F.lit(0.5))
    if not exact:
        middle = F.max(F.lit(exact_quantiles(rows, {"e": F.abs(error)}, [0.5], small)["e"][0]))
    sums = rows.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sum(F.abs(error)).alias("_absolute"),
        F.sum(F.abs(y)).alias("_volume"),
        F.avg(F.when(y != 0, F.abs(error / F.when(y != 0, y)))).alias("mape"),
        F.var_pop(y).alias("_variance"),
        middle.alias("median_absolute_error"),
    )
    fit = F.when(F.col("_variance") > 0, 1 - F.col("mse") / F.col("_variance")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        "n", "mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("n") > 1, fit).alias("r2"),
        ratio(F.col("_absolute"), F.col("_volume")).alias("wape"), "mape",
        "median_absolute_error",
    )


def threshold_report(
    df: DataFrame, label: str, score: str, miss_cost: float = MISS_COST, false_alert_cost: float = FALSE_ALERT_COST,
    review_cost: float = REVIEW_COST,
) -> DataFrame:
    """Cost and quality at 71 thresholds. [A6]

    Each row is counted once, by the number of thresholds it passes; the 72 counts give all
    thresholds together.
    """
    p, last = F.col(score), len(THRESHOLDS) - 1
    bounds = F.array(*[F.lit(t) for t in THRESHOLDS], F.lit(float("inf")))
    guess = F.least(F.greatest(F.floor((p - THRESHOLDS[0]) / 0.01), F.lit(0)), F.lit(last)).cast("int")
    passed = (
        F.when(p >= F.element_at(bounds, guess + 2), guess + 2).when(p >= F.element_at(bounds, guess + 1), guess + 1).otherwise(guess)
    )
    positive = F.col(label) == 1
    counts = df.where(p.isNotNull()).groupBy(passed.alias("passed")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # At most 72 cells remain; each threshold sums the cells above it.
    cells = counts.agg(F.collect_list(F.struct("passed", "pos", "neg")).alias("cells"))
    rows = cells.select("cells", F.posexplode(F.array(*[F.lit(round(t, 2)) for t in THRESHOLDS])).alias("i", "threshold"))

    def total(name: str, above: Column) -> Column:
        kept = F.filter("cells", lambda c: c["passed"] > above)
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda so_far, c: so_far + c[name])

    sums = rows.select("threshold", total("pos", F.col("i")).alias("hits"), total("neg", F.col("i")).alias("alarms"), total("pos", F.lit(-1)).alias("p"))
    tp, fp, fn = F.col("hits").cast("double"), F.col("alarms").cast("double"), (F.col("p") - F.col("hits")).cast("double")
    return sums.select(
        "threshold",
        _or_zero(ratio(tp, tp + fp)).alias("precision"),
        _or_zero(ratio(tp, tp + fn)).alias("recall"),
        _or_zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.col("alarms").alias("false_positives"),
        (F.col("p") - F.col("hits")).alias("false_negatives"),
        (F.col("hits") + F.col("alarms")).alias("reviews"),
        F.round(fn * miss_cost + fp * false_alert_cost + (tp + fp) * review_cost, 2).alias("estimated_cost"),
    )


def cheapest_threshold(report: DataFrame) -> DataFrame:
    """The row of least cost; of equal ones the lowest threshold. [A6]"""
    return report.orderBy("estimated_cost", "threshold").limit(1)


def risk_kpi(df: DataFrame, tier: str = "risk_tier", score: str = "risk_score") -> DataFrame:
    """[A7]"""
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col(tier).startswith("HIGH")).alias("high_risk"),
        F.count_if(F.col(tier).startswith("MEDIUM")).alias("medium_risk"),
        F.count_if(F.col(tier).startswith("LOW")).alias("low_risk"),
        F.avg(score).alias("average_risk"),
    )


def decision_summary(df: DataFrame) -> DataFrame:
    """Decision counts with a headline, one row. [A8]"""
    counts = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("final_status") == s).alias(s.lower()) for s in ("MANUAL_REVIEW", "REVIEW_RECOMMENDED", "STANDARD_PROCESS")],
    )
    return counts.withColumn("headline", F.concat(F.format_number("total", 0), F.lit(" customers assessed")))


def observation_summary(df: DataFrame) -> DataFrame:
    """Observations, anomalies and stock risks of a flagged forecast with a headline, one row. [A8]"""
    counts = df.agg(F.count("*").alias("total"), F.count_if("is_anomaly").alias("anomalies"), F.count_if("stockout_risk").alias("stockout_risks"))
    return counts.withColumn("headline", F.concat(F.format_number("total", 0), F.lit(" forecast observations analyzed")))


def forecast_summary(df: DataFrame, order: str) -> DataFrame:
    """Total, trend from the first to the last period, and flag counts. [A9]"""
    edges = df.agg(
        F.sum("forecast_value").alias("forecast_total"),
        F.min_by("forecast_value", order).alias("_first"),
        F.max_by("forecast_value", order).alias("_last"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.count_if("cash_shortfall_risk").alias("cash_shortfall_periods"),
    )
    trend = F.when(F.col("_last") < F.col("_first"), "decline").otherwise("stable or improving trend")
    return edges.withColumn("trend", trend).drop("_first", "_last")


def horizon_totals(df: DataFrame) -> DataFrame:
    """Forecast per date. [A10]"""
    return df.groupBy("date").agg(F.sum("forecast_value").alias("forecast_value"))


def horizon_edges(totals: DataFrame) -> DataFrame:
    """First, last and lowest period of a horizon, one row. [A10]"""
    place = F.struct("forecast_value", "date")
    return totals.agg(
        F.min_by("forecast_value", "date").alias("first_value"),
        F.max_by("forecast_value", "date").alias("last_value"),
        F.max("date").alias("last_date"),
        F.min("forecast_value").alias("lowest_value"),
        F.min_by("date", place).alias("lowest_date"),
        F.count("*").alias("periods"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts and the weight that balances them. [A15]"""
    positive = F.col(label) == 1
    return df.agg(F.count_if(~positive).alias("negatives"), F.count_if(positive).alias("positives")).withColumn(
        "positive_weight", F.greatest("negatives", F.lit(1)) / F.greatest("positives", F.lit(1))
    )


def residual_deviation(df: DataFrame, residual: Column) -> DataFrame:
    """Sample standard deviation of the residuals, one row. [A22]"""
    return df.agg(F.stddev_samp(residual).alias("deviation"))
