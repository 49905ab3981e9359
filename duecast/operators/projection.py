"""Forecast intervals, recursive projection and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.functions.values import as_double, mode_label
from duecast.operators.compiled import CompiledModel
from duecast.operators.demand import SERIES, add_short_features
from duecast.operators.metrics import horizon_edges, horizon_totals
from duecast.session import checkpointed

Z_95 = 1.96
LAGS = (1, 7, 14)
MAX_HORIZON = 365
STEPS_PER_CHECKPOINT = 10


def interval(forecast: Column, deviation: Column) -> tuple[Column, Column]:
    """Lower (not below 0) and upper bound around a forecast. [X26]"""
    return F.greatest(forecast - Z_95 * deviation, F.lit(0.0)), forecast + Z_95 * deviation


def flag_forecast(df: DataFrame, actual: str = "units_sold", forecast: str = "forecast_value", cover: float = 2.0, floor: float = 1e-9) -> DataFrame:
    """Residual, anomaly and stock-out flags. ``cover`` is 2 in scoring and 1 in stored runs. [M19, M20, A22]"""
    d = df.withColumn(forecast, F.greatest(F.col(forecast), F.lit(0.0))).withColumn("residual", F.col(actual) - F.col(forecast))
    scale = F.greatest(d.agg(F.stddev_samp("residual")).scalar(), F.lit(floor))
    d = d.withColumn("is_anomaly", F.abs("residual") > 2 * scale)
    stock = F.coalesce(F.col("inventory_level") < cover * F.col(forecast), F.lit(False)) if "inventory_level" in df.columns else F.lit(False)
    return d.withColumn("stockout_risk", stock)


def latest_state(history: DataFrame, value: str, frozen: Sequence[str] = (), keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per series: last date, the last 14 values in order, and the latest row's other columns."""
    recent = Window.partitionBy(*keys).orderBy(F.desc("date"))
    depth = max(LAGS)
    tail = history.where("date is not null").withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= depth)
    ordered = F.sort_array(F.collect_list(F.struct("date", F.coalesce(as_double(history, value), F.lit(0.0)).alias("v"))))
    return tail.groupBy(*keys).agg(
        F.max("date").alias("_last_date"), F.transform(ordered, lambda x: x["v"]).alias("_values"),
        *[F.max_by(c, "date").alias(c) for c in frozen],
    )


def _lag(values: Column, lag: int) -> Column:
    """The value ``lag`` steps back, the first one in a shorter series."""
    return F.when(F.size(values) >= lag, F.element_at(values, -lag)).otherwise(F.element_at(values, 1))


def _emit(state: DataFrame, horizon: int, deviation: float, target: str, keys: Sequence[str], frozen: Sequence[str]) -> DataFrame:
    steps = state.select(
        *keys, *frozen, "_last_date", F.posexplode(F.slice("_values", F.size("_values") - horizon + 1, F.lit(horizon))).alias("_pos", "forecast_value")
    )
    low, high = interval(F.col("forecast_value"), F.lit(deviation))
    return steps.select(
        F.date_add("_last_date", F.col("_pos") + 1).alias("date"), *keys, "forecast_value", low.alias("forecast_lower"), high.alias("forecast_upper"),
        F.lit(True).alias("is_future"), mode_label(F.lit(target)).alias("forecast_mode"), *frozen,
    )


def _check_horizon(horizon: int) -> None:
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"The horizon must be between 1 and {MAX_HORIZON} days.")


def project_linear(
    history: DataFrame, weights: Mapping[str, float], horizon: int = 30, value: str = "units_sold", deviation: float = 0.0,
    nonnegative: bool = True, frozen: Sequence[str] = (), keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Recursive projection of a linear model over lags and calendar parts, all series at once. [M21]

    ``weights`` may name intercept, lag_1, lag_7, lag_14, dow, month and any ``frozen`` column,
    which keeps the value of the series' latest row. The steps are a fold over each series'
    value list, so no shuffle or checkpoint is needed between them.
    """
    _check_horizon(horizon)
    state = latest_state(history, value, frozen, keys)

    def step(values: Column, number: Column) -> Column:
        day = F.date_add(F.col("_last_date"), number.cast("int"))
        parts = {"dow": F.weekday(day), "month": F.month(day), **{f"lag_{k}": _lag(values, k) for k in LAGS}}
        parts.update({c: F.col(c) for c in frozen if c not in parts})
        forecast = F.lit(float(weights.get("intercept", 0.0)))
        for name, column in parts.items():
            if name in weights:
                forecast = forecast + F.lit(float(weights[name])) * column
        return F.array_append(values, F.greatest(forecast, F.lit(0.0)) if nonnegative else forecast)

    folded = state.withColumn("_values", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_values"), step))
    return _emit(folded, horizon, deviation, value, keys, frozen)


def project_model(
    history: DataFrame, model, horizon: int = 30, value: str = "units_sold", deviation: float | None = None, nonnegative: bool = True,
    frozen: Sequence[str] = (), keys: Sequence[str] = SERIES, compiled: bool = True,
) -> DataFrame:
    """Recursive projection with a fitted Spark ML pipeline. [M21]

    Linear models and tree ensembles become one expression, and the steps a fold over each series' values: no shuffle or
    checkpoint between them. Other pipelines, or all with ``compiled`` off, score all series once per step, and the plan is cut
    with a reliable checkpoint every few steps. Without a ``deviation`` the interval is that of the model's residuals on the history.
    """
    _check_horizon(horizon)
    spread = residual_spread(history, model, value) if deviation is None else deviation
    state = latest_state(history, value, frozen, keys)
    columns = state.columns
    if compiled and CompiledModel.fits(model):
        expression = CompiledModel(model, history.sparkSession)

        def step(values: Column, number: Column) -> Column:
            day = F.date_add(F.col("_last_date"), number.cast("int"))
            forecast = expression.column({"dow": F.weekday(day), "month": F.month(day), **{f"lag_{k}": _lag(values, k) for k in LAGS}})
            return F.array_append(values, F.greatest(forecast, F.lit(0.0)) if nonnegative else forecast)

        folded = expression.with_slots(state).withColumn("_values", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_values"), step))
        return _emit(folded.select(*columns), horizon, spread, value, keys, frozen)
    for number in range(1, horizon + 1):
        day = F.date_add("_last_date", number)
        inputs = {"dow": F.weekday(day), "month": F.month(day), **{f"lag_{k}": _lag(F.col("_values"), k) for k in LAGS}}
        scored = model.transform(state.withColumns(inputs))
        forecast = F.greatest(F.col("prediction"), F.lit(0.0)) if nonnegative else F.col("prediction")
        state = scored.withColumn("_values", F.array_append("_values", forecast)).select(*columns)
        if number % STEPS_PER_CHECKPOINT == 0 and number < horizon:
            state = checkpointed(state)
    return _emit(state, horizon, spread, value, keys, frozen)


def residual_spread(history: DataFrame, model, value: str = "units_sold") -> float:
    """Sample deviation of actual minus predicted values over the rows of the history that have all lags; 0 for fewer than two. [M21, A22]"""
    featured = add_short_features(history, value).where(F.col(value).isNotNull() & F.col(f"lag_{max(LAGS)}").isNotNull())
    found = model.transform(featured).agg(F.stddev_samp(F.col(value) - F.col("prediction"))).first()[0]
    return float(found or 0.0)


# Alert texts.
ALERTS = {
    "Abnormal pattern": (
        "HIGH", "Actual performance differs materially from the model expectation.",
        "Review transactions, pricing, seasonality, and source-data quality.",
    ),
    "Stock exposure": (
        "HIGH", "Available inventory is below the configured forecast coverage level.",
        "Review replenishment constraints and safety-stock policy with an authorized manager.",
    ),
    "Projected decline": (
        "MEDIUM", "declines by more than 10% across the selected horizon.",
        "Review the main business drivers and prepare a manager-approved mitigation plan.",
    ),
    "Negative net cashflow": (
        "CRITICAL", "At least one projected period has negative net cashflow.",
        "Review collection timing and deferrable outflows with the accountable finance manager.",
    ),
}
ROW_ALERTS = {
    "FIN": ("HIGH", "Abnormal forecast deviation", "Review the underlying transactions, pricing, seasonality, and data quality."),
    "CASH": (
        "CRITICAL", "Projected cash balance is below the configured minimum",
        "Accelerate collections and review deferrable outflows with an authorized manager.",
    ),
}


def _alert(kind: str, period: Column, reason: Column | None = None) -> Column:
    severity, text, action = ALERTS[kind]
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(kind).alias("type"), period.alias("period"),
        (F.lit(text) if reason is None else reason).alias("reason"), F.lit(action).alias("recommended_action"), F.lit("OPEN").alias("status"),
    )


def forecast_alerts(frame: DataFrame, target: str | None = None) -> DataFrame:
    """Alerts for anomalies, stock, a falling horizon and negative cash, without repeats. [M22, A10, U3]"""
    period = F.coalesce(F.col("date").cast("date").cast("string"), F.lit("Unknown"))
    columns = frame.columns
    flags = [(f, kind) for f, kind in (("is_anomaly", "Abnormal pattern"), ("stockout_risk", "Stock exposure")) if f in columns]
    rows = [F.when(F.coalesce(F.col(f).cast("boolean"), F.lit(False)), _alert(kind, period)) for f, kind in flags]
    found = None
    if rows:
        found = frame.select(F.inline(F.array_compact(F.array(*rows))))
    if "is_future" in columns:
        future = frame.where("is_future")
        edges = horizon_edges(horizon_totals(future)).withColumn("rows", future.agg(F.count("*")).scalar())
        reason = F.concat(F.lit("Projected "), mode_label(F.lit(target)), F.lit(" " + ALERTS["Projected decline"][1]))
        falling = (F.col("periods") >= 1) & (F.col("first_value") > 0) & (F.col("last_value") < F.col("first_value") * 0.9)
        late = [F.when(falling, _alert("Projected decline", F.col("last_date").cast("string"), reason))]
        if target == "net_cashflow":
            late.append(F.when((F.col("rows") > 1) & (F.col("lowest_value") < 0), _alert("Negative net cashflow", F.col("lowest_date").cast("string"))))
        ahead = edges.select(F.inline(F.array_compact(F.array(*late))))
        found = ahead if found is None else found.unionByName(ahead)
    if found is None:
        raise ValueError("The frame has neither flags nor future rows.")
    return found.dropDuplicates()


def row_alerts(df: DataFrame, row_id: str, created_at: Column | None = None) -> DataFrame:
    """One alert per flagged row, named after the row. [M23]"""
    number = F.col(row_id).cast("string")

    def entry(prefix: str) -> Column:
        severity, reason, action = ROW_ALERTS[prefix]
        return F.struct(
            F.concat(F.lit(f"{prefix}-"), number).alias("alert_id"), F.lit(severity).alias("severity"),
            (created_at if created_at is not None else F.current_timestamp()).alias("created_at"), F.lit("OPEN").alias("status"),
            F.lit(reason).alias("reason"), F.lit(action).alias("recommended_action"), number.alias("record"),
        )

    flags = [("is_anomaly", "FIN"), ("cash_shortfall_risk", "CASH")]
    rows = [F.when(F.coalesce(F.col(f).cast("boolean"), F.lit(False)), entry(p)) for f, p in flags if f in df.columns]
    return df.select(F.inline(F.array_compact(F.array(*rows))))
