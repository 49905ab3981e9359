"""Scored rows: drivers, indicators, actions, company policy and decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.functions.values import TIER_BOUNDS, display_number, factor_label, lookup, tier
from duecast.operators.history import HISTORY_FEATURES
from duecast.operators.metrics import risk_kpi
from duecast.operators.profile import check_for_model, model_input, raw_features
from duecast.operators.serving import RECORD_TYPE, prepare_assessment

# Actions per tier and per flag.
TIER_ACTIONS = {
    "HIGH_RISK": ["Request manual credit review.", "Reduce exposure and tighten payment terms.", "Increase collection monitoring."],
    "MEDIUM_RISK": ["Send early reminders.", "Monitor repayment behavior monthly.", "Consider an early-payment incentive."],
    "LOW_RISK": ["Maintain standard controls.", "Consider normal commercial terms."],
}
STOCK_ACTION = "Review replenishment and safety-stock levels."
ANOMALY_ACTION = "Investigate the demand deviation, promotion, weather, pricing, and data quality."
NO_ACTION = "No exceptional action detected."
NO_DRIVER = "No strong individual driver identified. The score results from several weak combined factors."
DECISION_ACTIONS = {
    "MANUAL_REVIEW": "Prioritize high-risk records for accountable human review.",
    "REVIEW_RECOMMENDED": "Review medium-risk records and verify source data.",
    "STANDARD_PROCESS": "Continue the standard process with routine monitoring.",
    "OPERATIONAL_REVIEW": "Review stock exposure and confirm replenishment constraints.",
    "INVESTIGATE_VARIANCE": "Investigate the largest verified deviations.",
    "NORMAL_MONITORING": "Continue routine monitoring.",
}
MIN_IMPACT = 0.0005


def score_rows(df: DataFrame, probability: Column, bounds: tuple[float, float] = TIER_BOUNDS["scoring"]) -> DataFrame:
    """Risk score and tier. [M18, X18]"""
    return df.withColumn("risk_score", probability).withColumn("risk_tier", tier(F.col("risk_score"), *bounds))


def company_tiers(df: DataFrame) -> DataFrame:
    """Tier by each company's own bounds, as joined by ``with_company_profile``. [X18, J6]"""
    return df.withColumn("risk_tier", tier(F.col("risk_score"), F.col("review_threshold"), F.col("high_risk_threshold")))


def key_risk_factors(
    df: DataFrame, row_id: str, score: Callable[[DataFrame], DataFrame], baselines: Mapping[str, float | str], top_k: int = 3,
    min_impact: float = MIN_IMPACT,
) -> DataFrame:
    """Per row, the features whose replacement by a usual value moves the score most. [T4]

    ``score`` adds ``probability`` to a table with the features. All changed copies are scored
    in one pass; only effects of at least ``min_impact`` are brought together again.
    """
    features, kinds = list(baselines), dict(df.dtypes)
    scored = score(df).withColumnRenamed("probability", "_base")
    number = F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
    copies = scored.select(row_id, "_base", *features, number.alias("_changed"))
    swapped = copies.select(
        row_id, "_base", "_changed",
        F.element_at(F.array(*[F.col(f).cast("string") for f in features]), F.col("_changed") + 1).alias("_value"),
        *[F.when(F.col("_changed") == i, F.lit(baselines[f]).cast(kinds[f])).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)],
    )
    effects = score(swapped).withColumn("_impact", F.abs(F.col("_base") - F.col("probability"))).where(F.col("_impact") >= min_impact)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_changed") + 1)
    entry = F.struct((-F.col("_impact")).alias("order"), F.col("_changed"), name.alias("feature"), F.col("_value").alias("value"), F.col("_impact").alias("impact"))
    # A row has at most one entry per feature.
    top = effects.groupBy(row_id).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, top_k).alias("_top"))
    drivers = F.transform("_top", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact")))
    return df.select(row_id).join(top.select(row_id, drivers.alias("drivers")), row_id, "left").withColumn(
        "drivers", F.coalesce("drivers", F.array().cast("array<struct<feature:string,value:string,impact:double>>"))
    )


def drivers_in_row(
    df: DataFrame, output: Callable[[Mapping[str, Column]], Column], baselines: Mapping[str, float | str], top_k: int = 3, min_impact: float = MIN_IMPACT, name: str = "drivers",
) -> DataFrame:
    """``key_risk_factors`` inside each row: ``output`` gives the score where some inputs are the given expressions. [T4]

    No row is copied and nothing is shuffled; a compiled model's ``column`` is such an output.
    """
    kinds, entries = dict(df.dtypes), []
    base = output({})
    for position, (feature, usual) in enumerate(baselines.items()):
        impact = F.abs(F.col("_base") - output({feature: F.lit(usual).cast(kinds[feature])}))
        entries.append(F.struct(
            (-impact).alias("order"), F.lit(position).alias("position"), F.lit(feature).alias("feature"), F.col(f"`{feature}`").cast("string").alias("value"), impact.alias("impact"),
        ))
    strong = F.filter(F.col("_effects"), lambda e: e["impact"] >= min_impact)
    shown = F.transform(F.slice(F.array_sort(strong), 1, top_k), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["impact"].alias("impact")))
    return df.withColumn("_base", base).withColumn("_effects", F.array(*entries)).withColumn(name, shown).drop("_base", "_effects")


def scoring_report(df: DataFrame, output: Callable[[Mapping[str, Column]], Column], baselines: Mapping[str, float | str], bounds: tuple[float, float] = TIER_BOUNDS["scoring"], top_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows with score, tier, drivers as text and actions; the KPI row) of one scoring run. [M18, T4, A7, M25]"""
    rows = tier_actions(score_rows(drivers_in_row(df, output, baselines, top_k), output({}), bounds))
    rows = rows.withColumn("key_drivers", describe_drivers(F.col("drivers")))
    return rows, risk_kpi(rows)


def describe_drivers(drivers: Column) -> Column:
    """Drivers as numbered lines with readable names. [T4, X20]"""
    def line(entry: Column, position: Column) -> Column:
        percent = entry["impact"] * 100
        strength = F.when(percent < 0.1, "less than 0.1%").otherwise(F.concat(F.format_number(percent, 1), F.lit("%")))
        shown = F.coalesce(display_number(entry["value"].try_cast("double")), entry["value"], F.lit("Not available"))
        shown = F.when(entry["value"].try_cast("double").isNull() & entry["value"].isNotNull(), entry["value"]).otherwise(shown)
        return F.concat((position + 1).cast("string"), F.lit(". "), factor_label(entry["feature"]), F.lit(": "), shown, F.lit(" | Influence: "), strength)

    return F.when(F.size(drivers) == 0, NO_DRIVER).otherwise(F.array_join(F.transform(drivers, line), "\n"))


def unusual_indicators(df: DataFrame, medians: Mapping[str, float | None], top_k: int = 5) -> DataFrame:
    """Per row, the features farthest from the training median, relative to its size. [T5]"""
    entries = []
    for position, (name, middle) in enumerate(medians.items()):
        middle = 0.0 if middle is None else float(middle)
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        distance = F.abs(value - middle) / max(abs(middle), 1.0)
        side = F.when(value > middle, "Above training median").otherwise("At or below training median")
        entries.append(
            F.struct(
                (-distance).alias("order"), F.lit(position).alias("position"), F.lit(name).alias("feature"), value.alias("feature_value"),
                side.alias("relative_position"),
            )
        )
    ranked = F.slice(F.array_sort(F.array(*entries)), 1, top_k)
    kept = F.transform(
        ranked,
        lambda x: F.struct(x["feature"].alias("feature"), x["feature_value"].alias("feature_value"), x["relative_position"].alias("relative_position")),
    )
    return df.withColumn("unusual_indicators", kept)


def reason_codes(df: DataFrame, importance: Sequence[tuple[str, float]], reference: Mapping[str, float], top_k: int = 5) -> DataFrame:
    """The globally most important features with the row's own values. [T6]"""
    entries = [
        F.struct(
            F.lit(name).alias("feature"), F.col(name).cast("string").alias("value"), F.lit(reference.get(name)).cast("double").alias("reference"),
            F.lit(float(weight)).alias("importance"),
        )
        for name, weight in importance
        if name in df.columns
    ]
    return df.withColumn("reason_codes", F.array(*entries[:top_k]))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tier_actions(df: DataFrame) -> DataFrame:
    """Recommended actions by tier. [M25]"""
    pairs = [x for name, actions in TIER_ACTIONS.items() for x in (F.lit(name), _texts(actions))]
    return df.withColumn("recommended_actions", F.element_at(F.create_map(*pairs), F.col("risk_tier")))


def flag_actions(df: DataFrame, stock: str = "stockout_risk", anomaly: str = "is_anomaly") -> DataFrame:
    """Recommended actions by forecast flags. [M25]"""
    wanted = F.array_compact(
        F.array(F.when(F.col(stock).cast("boolean"), STOCK_ACTION), F.when(F.col(anomaly).cast("boolean"), ANOMALY_ACTION))
    )
    return df.withColumn("recommended_actions", F.when(F.size(wanted) > 0, wanted).otherwise(_texts([NO_ACTION])))


def apply_policy(df: DataFrame) -> DataFrame:
    """Company rules on the actions: forbidden ones go, own ones are added, approval sets the status. [M26]

    Expects ``recommended_actions`` and the columns of ``with_company_profile``.
    """
    terms = F.filter(F.transform("forbidden_actions", lambda t: F.lower(t)), lambda t: F.trim(t) != "")
    allowed = F.filter("recommended_actions", lambda a: ~F.exists(terms, lambda t: F.contains(F.lower(a), t)))
    own = F.filter(F.array_distinct("recommendation_rules"), lambda r: F.trim(r) != "")
    added = F.filter(own, lambda r: ~F.array_contains(allowed, r))
    status = F.when(F.col("require_human_approval"), "REQUIRES_HUMAN_REVIEW").otherwise("ADVISORY")
    return df.withColumns({"recommended_actions": F.concat(allowed, added), "policy_status": status})


def _decided(counts: DataFrame, status: Column) -> DataFrame:
    return counts.withColumn("decision_status", status).withColumn("priority_action", lookup(F.col("decision_status"), DECISION_ACTIONS))


def payment_decision(counts: DataFrame) -> DataFrame:
    """Status of a whole assessment from its tier counts. [M27]"""
    status = F.when(F.col("high_risk") > 0, "MANUAL_REVIEW").when(F.col("medium_risk") > 0, "REVIEW_RECOMMENDED")
    return _decided(counts, status.otherwise("STANDARD_PROCESS"))


def forecast_decision(counts: DataFrame) -> DataFrame:
    """Status of a whole forecast from its flag counts. [M27]"""
    status = F.when(F.col("stockout_risks") > 0, "OPERATIONAL_REVIEW").when(F.col("anomalies") > 0, "INVESTIGATE_VARIANCE")
    return _decided(counts, status.otherwise("NORMAL_MONITORING"))


def assess_payments(
    raw: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], keep: Sequence[str] = ("row_id",),
    bounds: tuple[float, float] = TIER_BOUNDS["scoring"], order: Sequence[str] = ("row_id",),
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, issues) of an upload. [M18]

    History features are added when the upload marks its records, or the model asks for them;
    then only current rows are scored. ``score`` adds ``probability`` to the model's inputs.
    """
    data = raw
    if RECORD_TYPE in raw.columns or set(features) & set(HISTORY_FEATURES):
        data, _ = prepare_assessment(raw, raw_features(raw.columns, features), order)
    issues = check_for_model(data, features)
    if not issues.where("level = 'error'").isEmpty():
        return data.limit(0).withColumns({"risk_score": F.lit(None).cast("double"), "risk_tier": F.lit(None).cast("string")}), issues
    scored = score(model_input(data, features, keep))
    return score_rows(scored, F.col("probability"), bounds).drop("probability"), issues


def case_queue(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Highest score first. [T7]"""
    return df.orderBy(F.desc(score))
