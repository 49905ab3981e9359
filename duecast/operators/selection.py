"""Choosing among trained models from their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the composite classification score.
WEIGHTS = {
    "pr_auc": 0.18, "roc_auc": 0.14, "f1": 0.14, "recall": 0.14, "precision": 0.10, "balanced_accuracy": 0.12, "mcc": 0.12, "accuracy": 0.06,
}


def _figure(figures: str, name: str, default: float = 0.0) -> Column:
    value = F.try_element_at(F.col(figures), F.lit(name))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), default).otherwise(value)


def best_classifier(runs: DataFrame, figures: str = "validation") -> DataFrame:
    """The run with the highest PR-AUC, then F1. [M13]"""
    place = F.struct(F.coalesce(F.try_element_at(F.col(figures), F.lit("pr_auc")), F.lit(-1.0)), F.coalesce(F.try_element_at(F.col(figures), F.lit("f1")), F.lit(-1.0)))
    return runs.agg(F.max_by("algorithm", place).alias("algorithm"))


def best_forecaster(runs: DataFrame, figures: str = "validation") -> DataFrame:
    """The run with the least WAPE. [M13]"""
    place = F.coalesce(F.try_element_at(F.col(figures), F.lit("wape")), F.lit(1e99))
    return runs.agg(F.min_by("algorithm", F.struct(place, "algorithm")).alias("algorithm"))


def rank_classifiers(runs: DataFrame, figures: str = "validation", with_brier: bool = True) -> DataFrame:
    """Composite score with a penalty for failing either class, best first. [M14, T8]"""
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + weight * _figure(figures, name)
    if with_brier:
        brier = F.try_element_at(F.col(figures), F.lit("brier"))
        score = score + F.when(brier.isNotNull(), 0.06 * (1 - brier)).otherwise(0.0)
    floor = F.least(*[_figure(figures, n) for n in ("recall", "specificity", "precision")])
    score = score - 0.12 * F.greatest(F.lit(0.0), 0.55 - floor)
    return runs.withColumn("selection_score", score).orderBy(F.desc("selection_score"), F.desc(_figure(figures, "pr_auc", -1.0)))


def rank_forecasters(runs: DataFrame, figures: str = "validation") -> DataFrame:
    """Composite forecast score, best first. [M14]"""
    wape, rmse, mae, r2 = (_figure(figures, n, d) for n, d in (("wape", 1e9), ("rmse", 1e9), ("mae", 1e9), ("r2", -1.0)))
    score = -(0.55 * wape + 0.20 * (rmse / (F.abs(rmse) + 1)) + 0.15 * (mae / (F.abs(mae) + 1))) + 0.10 * r2
    return runs.withColumn("selection_score", score).orderBy(F.desc("selection_score"), F.desc("algorithm"))


# Statements of the rule-based assessment.
STATEMENTS = {
    "separation": "Good class separation on holdout data.",
    "recall": "Recall is limited, so some risky records may be missed.",
    "recall_action": "Consider threshold tuning and more representative positive-class examples.",
    "precision": "Precision is limited, increasing manual-review load.",
    "precision_action": "Review false positives and improve discriminating features.",
    "error_small": "Forecast error is relatively controlled on holdout data.",
    "error_large": "Forecast error is material on holdout data.",
    "error_action": "Review time coverage, product history, and additional demand drivers.",
    "duplicates_action": "Review duplicate training records.",
    "no_strength": "The pipeline completed with a separated holdout evaluation.",
    "no_weakness": "No critical weakness was triggered by configured rules.",
    "no_action": "Continue monitoring drift and holdout performance.",
}


def assess_models(runs: DataFrame, task: str, figures: str = "test", duplicates: Column | None = None) -> DataFrame:
    """Health, strengths, weaknesses and recommendations of each run. [M15]"""
    def says(condition: Column, name: str) -> Column:
        return F.when(condition, STATEMENTS[name])

    if task == "credit":
        auc, recall, precision = (_figure(figures, n) for n in ("roc_auc", "recall", "precision"))
        strong = [says(auc >= 0.8, "separation")]
        weak = [says(recall < 0.65, "recall"), says(precision < 0.6, "precision")]
        act = [says(recall < 0.65, "recall_action"), says(precision < 0.6, "precision_action")]
    else:
        wape = F.try_element_at(F.col(figures), F.lit("wape"))
        large = wape.isNull() | (wape > 0.3)
        strong, weak, act = [says(wape <= 0.2, "error_small")], [says(large, "error_large")], [says(large, "error_action")]
    act.append(says(duplicates if duplicates is not None else F.lit(False), "duplicates_action"))
    strengths, weaknesses, actions = (F.array_compact(F.array(*x)) for x in (strong, weak, act))
    balance = 2 * F.size(strengths) - 2 * F.size(weaknesses)
    health = F.when(balance >= 4, "Excellent").when(balance >= 1, "Good").when(balance >= -1, "Fair").otherwise("Weak")

    def usual(found: Column, name: str) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(STATEMENTS[name])))

    return runs.withColumns(
        {
            "health": health, "strengths": usual(strengths, "no_strength"), "weaknesses": usual(weaknesses, "no_weakness"),
            "recommendations": usual(actions, "no_action"),
        }
    )


# ---------------------------------------------------------------------------
# Model log [M28]
# ---------------------------------------------------------------------------

PLATFORM_OWNERS = ("__platform__", "admin_selected_company")


def champions(log: DataFrame) -> DataFrame:
    """Current champion per owner and task: the version promoted last. [M28]

    ``log`` is append-only with owner, task, version, status and event_ts.
    """
    promoted = log.where("status = 'CHAMPION'")
    return promoted.groupBy("owner", "task").agg(
        F.max_by("version", F.struct("event_ts", "version")).alias("version"), F.max("event_ts").alias("activated_at")
    )


def version_states(log: DataFrame) -> DataFrame:
    """Every version with its current status; a promotion archives the champion before it. [M28]"""
    last = log.groupBy("owner", "task", "version").agg(
        F.max_by("status", F.struct("event_ts", "status")).alias("logged"), F.min("event_ts").alias("created_at")
    )
    current = champions(log).select("owner", "task", F.col("version").alias("champion"))
    status = (
        F.when(F.col("version") == F.col("champion"), "CHAMPION").when(F.col("logged") == "CHAMPION", "ARCHIVED").otherwise(F.col("logged"))
    )
    return last.join(current, ["owner", "task"], "left").select("owner", "task", "version", status.alias("status"), "created_at")


def active_models(requests: DataFrame, log: DataFrame, owners: tuple[str, ...] = PLATFORM_OWNERS) -> DataFrame:
    """The champion for each requested (owner, task), else the platform owner's. [M28]"""
    current = champions(log).select("owner", "task", "version")
    own = requests.join(current, ["owner", "task"], "left").withColumnRenamed("version", "own_version")
    rank = F.array_position(F.array(*[F.lit(o) for o in owners]), F.col("owner"))
    # One row per task.
    platform = current.where(F.col("owner").isin(list(owners))).groupBy("task").agg(F.min_by("version", rank).alias("platform_version"))
    joined = own.join(platform, "task", "left")
    scope = F.when(F.col("own_version").isNotNull(), "own").when(F.col("platform_version").isNotNull(), "platform").otherwise("none")
    return joined.select("owner", "task", F.coalesce("own_version", "platform_version").alias("version"), scope.alias("scope"))


def version_numbers(log: DataFrame) -> DataFrame:
    """Versions of each owner and task, newest first, numbered. [M28]"""
    newest = Window.partitionBy("owner", "task").orderBy(F.desc("created_at"), F.desc("version"))
    return version_states(log).withColumn("position", F.row_number().over(newest))
