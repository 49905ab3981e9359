"""Demand series: features, reductions, splits, projection, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.operators import demand, filters, metrics, projection, scoring
from duecast.plans import lens_sql as L
from duecast.plans.filtering import _problems_sql
from duecast.session import scratch_path
from duecast.sources import lenses
from duecast.sources.tables import read

KEYS = ["date", "store_id", "product_id"]


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def short_features(spark, root):
    return demand.add_short_features(lenses.demand(spark, root).select(*KEYS, "units_sold"))


SHORT_SQL = f"""WITH {L.DEMAND} SELECT date, store_id, product_id, units_sold, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month,
  lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 7) OVER w AS lag_7, lag(units_sold, 14) OVER w AS lag_14
  FROM demand WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date)"""


def long_features(spark, root):
    df = demand.add_long_features(lenses.demand(spark, root).select(*KEYS, "units_sold", "inventory_level"))
    return _rounded(df, 6, *[f"roll_{m}_{w}" for m in ("mean", "std") for w in demand.ROLLING])


_ROLL = ", ".join(
    f"round(avg(units_sold) OVER (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS roll_mean_{w}, "
    f"round(stddev_samp(units_sold) OVER (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS roll_std_{w}"
    for w in demand.ROLLING
)
LONG_SQL = f"""WITH {L.DEMAND} SELECT date, store_id, product_id, units_sold, inventory_level, 'Unknown' AS category, 'Unknown' AS region,
  'Unknown' AS weather_conditions, 0.0::DOUBLE AS promotions_holidays, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  lag(units_sold, 1) OVER w AS lag_1, lag(units_sold, 7) OVER w AS lag_7, lag(units_sold, 14) OVER w AS lag_14, lag(units_sold, 30) OVER w AS lag_30, {_ROLL}
  FROM demand WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date)"""


def _cash_forecast(spark, root):
    return lenses.cash(spark, root).select(
        "entity", "period", (F.col("cash_inflow") - F.col("cash_outflow")).alias("actual"),
        (F.col("cash_inflow") * 0.75 - F.col("cash_outflow")).alias("forecast_value"),
    )


def cash_assessment(spark, root):
    df = demand.assess_cash(_cash_forecast(spark, root), "entity", "period", opening_cash=100.0, minimum_cash=20.0)
    return _rounded(df, 4, "actual", "forecast_value", "residual", "projected_closing_cash")


ASSESSED_CASH = f"""{L.CASH},
  cf AS (SELECT entity, period, cash_inflow - cash_outflow AS actual, cash_inflow * 0.75::DOUBLE - cash_outflow AS forecast_value FROM cash),
  assessed AS (SELECT *, actual - forecast_value AS residual, abs(actual - forecast_value) > 2 * (SELECT stddev_samp(actual - forecast_value) FROM cf) AS is_anomaly,
    100.0::DOUBLE + sum(forecast_value) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS projected_closing_cash FROM cf)"""
CASH_SQL = f"""WITH {ASSESSED_CASH} SELECT entity, period, round(actual, 4) AS actual, round(forecast_value, 4) AS forecast_value, round(residual, 4) AS residual,
  is_anomaly, round(projected_closing_cash, 4) AS projected_closing_cash, projected_closing_cash < 20 AS cash_shortfall_risk FROM assessed"""


def newest_rows(spark, root):
    df = lenses.demand(spark, root).select(*KEYS, "units_sold")
    return demand.keep_newest(df, keep=7000, row_id="date")


NEWEST_SQL = f"""WITH {L.DEMAND},
  g AS (SELECT store_id, product_id, count(*) AS n FROM demand GROUP BY ALL),
  q AS (SELECT *, least(n, greatest(1, CAST(round_even(7000.0::DOUBLE * n / (SELECT count(*) FROM demand), 0) AS BIGINT))) AS quota FROM g),
  a AS (SELECT *, least(quota, 7000 - (sum(quota) OVER (ORDER BY store_id DESC, product_id DESC) - quota)) AS allowed FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn FROM demand)
  SELECT date, r.store_id, r.product_id, units_sold FROM r JOIN a ON r.store_id = a.store_id AND r.product_id = a.product_id AND rn <= allowed"""


def sampled(spark, root):
    df = read(spark, root, "orders").select("o_orderkey", "o_custkey")
    return demand.sample_rows(df, 4000, ["o_orderkey"], 42, "o_orderkey")


def _hash(column: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5({column} || '|{seed}'), 1, 15)) AS BIGINT)"


SAMPLED_SQL = f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_hash('o_orderkey')}, o_orderkey LIMIT 4000"


def _text_rows(spark, root):
    df = lenses.demand_text(spark, root)
    # The source has repeated (order, line) numbers, so the row order is the pair (key, amount).
    return df.withColumn("row_order", F.struct("row_id", "amount")).drop("row_id")


def fitted(spark, root):
    """Problem rows removed and the rest sampled to half a megabyte."""
    df = filters.demand_problems(_text_rows(spark, root), "row_order")
    limit = 512 * 1024
    _, report = demand.fit_to_size(df, limit, ["date", "store_id", "product_id"], "row_order")
    facts = {**report, "within_limit": report["final_bytes"] <= limit, "all_counted": report["problem_rows_removed"] + report["random_rows_removed"] + report["final_rows"] == report["source_rows"]}
    return read(spark, root, "lineitem").agg(F.count("*").alias("rows"), *[F.lit(facts[n]).alias(n) for n in ("source_rows", "problem_rows_removed", "within_limit", "all_counted")])


FITTED_SQL = f"""SELECT count(*) AS rows, CAST(count(*) AS INTEGER) AS source_rows, CAST(count(*) FILTER (is_problem) AS INTEGER) AS problem_rows_removed,
  true AS within_limit, true AS all_counted FROM ({_problems_sql('ASC')})"""


def reduced(spark, root):
    """A third of the orders, as a share of the input's bytes."""
    df = read(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    return demand.reduce_files(df, source_bytes=94_000_000, target_bytes=30_000_000, ids=["o_orderkey"])


_SHARE = min(1.0, 30_000_000 * 0.94 / 94_000_000)
REDUCED_SQL = f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_hash('o_orderkey')} < {int(_SHARE * demand.HASH_RANGE)}"


def reduction(spark, root):
    before = read(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    return demand.reduction_report(before, reduced(spark, root), 42)


REDUCTION_SQL = f"""SELECT count(*) AS rows_read, CAST(9 * count(*) AS BIGINT) AS bytes_read, (SELECT count(*) FROM ({REDUCED_SQL})) AS rows_kept,
  CAST(9 * (SELECT count(*) FROM ({REDUCED_SQL})) AS BIGINT) AS bytes_kept, 42 AS seed, count(*) - (SELECT count(*) FROM ({REDUCED_SQL})) AS rows_removed FROM orders"""


def sorted_rows(spark, root):
    df = lenses.invoices(spark, root).select("row_id", "cust_number", "posting_date")
    return demand.stable_sort(df, ["cust_number", "posting_date"], "row_id")


def date_split(spark, root):
    df = demand.split_by_dates(lenses.demand(spark, root).select(*KEYS), "date")
    return df


DATE_SPLIT_SQL = f"""WITH {L.DEMAND}, d AS (SELECT list(DISTINCT date ORDER BY date) AS days FROM demand)
  SELECT date, store_id, product_id, CASE WHEN date < days[CAST(floor(len(days) * 0.7::DOUBLE) AS BIGINT) + 1] THEN 'train'
    WHEN date < days[CAST(floor(len(days) * 0.85::DOUBLE) AS BIGINT) + 1] THEN 'validation' ELSE 'test' END AS split FROM demand, d"""


def holdout(spark, root):
    df = demand.holdout_by_dates(lenses.demand(spark, root).select("date", "units_sold"), "date")
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


HOLDOUT_SQL = f"""WITH {L.DEMAND}, d AS (SELECT list(DISTINCT date ORDER BY date) AS days FROM demand)
  SELECT CASE WHEN date < days[CAST(floor(len(days) * (1 - 0.2::DOUBLE)) AS BIGINT) + 1] THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
         min(date) AS first_day, max(date) AS last_day FROM demand, d GROUP BY 1"""


def position_split(spark, root):
    df = lenses.invoices(spark, root).select("row_id", "posting_date")
    return demand.split_by_position(df, "posting_date", "row_id")


POSITION_SQL = f"""WITH {L.INVOICES}, r AS (SELECT row_id, posting_date, row_number() OVER (ORDER BY posting_date, row_id) - 1 AS i, count(*) OVER () AS n FROM invoices)
  SELECT row_id, posting_date, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r"""


def class_split(spark, root):
    df = lenses.scores(spark, root).select("row_id", "y")
    return demand.split_stratified(df, "y", ["row_id"])


CLASS_SQL = f"""WITH {L.SCORES}, r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash('row_id')}, row_id) AS i, count(*) OVER (PARTITION BY y) AS n FROM scores)
  SELECT row_id, y, CASE WHEN i <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM r"""

MEAN_OF_LAGS = {"lag_1": 1 / 3, "lag_7": 1 / 3, "lag_14": 1 / 3}


def projected(spark, root):
    df = lenses.demand(spark, root).select(*KEYS, "units_sold")
    out = projection.project_linear(df, {**MEAN_OF_LAGS, "intercept": 0.5, "dow": 0.25}, horizon=30, deviation=4.0)
    return _rounded(out, 6, "forecast_value", "forecast_lower", "forecast_upper")


PROJECTED = f"""{L.DEMAND},
  r AS (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn FROM demand),
  s AS (SELECT store_id, product_id, max(date) AS last_date, list(units_sold ORDER BY date) AS v FROM r WHERE rn <= 14 GROUP BY 1, 2),
  steps AS (
    SELECT store_id, product_id, last_date, v, 0 AS step FROM s
    UNION ALL
    SELECT store_id, product_id, last_date, list_append(v, greatest(0, 0.5::DOUBLE + 0.25::DOUBLE * (isodow(last_date + step + 1) - 1)
      + (1 / 3::DOUBLE) * v[-1] + (1 / 3::DOUBLE) * v[greatest(-7, -len(v))] + (1 / 3::DOUBLE) * v[greatest(-14, -len(v))])), step + 1
    FROM steps WHERE step < 30),
  projected AS (SELECT last_date + step AS date, store_id, product_id, v[-1] AS f FROM steps WHERE step > 0)"""
PROJECTED_SQL = f"""WITH RECURSIVE {PROJECTED} SELECT date, store_id, product_id, round(f, 6) AS forecast_value, round(greatest(f - 1.96::DOUBLE * 4, 0), 6) AS forecast_lower,
  round(f + 1.96::DOUBLE * 4, 6) AS forecast_upper, true AS is_future, 'Demand' AS forecast_mode FROM projected"""


def flagged_forecast(spark, root, cover=2.0):
    df = projection.flag_forecast(lenses.forecasts(spark, root), cover=cover)
    return _rounded(df.select(*KEYS, "forecast_value", "residual", "is_anomaly", "stockout_risk"), 4, "residual")


def _flag_sql(cover: int) -> str:
    return f"""WITH {L.FORECASTS} SELECT date, store_id, product_id, forecast_value, round(units_sold - forecast_value, 4) AS residual,
      abs(units_sold - forecast_value) > 2 * (SELECT stddev_samp(units_sold - forecast_value) FROM forecasts) AS is_anomaly,
      inventory_level < {cover} * forecast_value AS stockout_risk FROM forecasts"""


def _with_horizon(spark, root):
    """Flagged demand and a falling horizon that goes below zero, per day."""
    past = flagged_forecast(spark, root).select("date", "is_anomaly", "stockout_risk", "forecast_value", F.lit(False).alias("is_future"))
    # The latest day of each series lies ahead as a shrinking forecast.
    tail = lenses.demand(spark, root).groupBy("store_id", "product_id").agg(F.max("date").alias("last"), F.sum("units_sold").alias("s"))
    ahead = tail.select(
        F.col("last"), F.col("s"), F.posexplode(F.sequence(F.lit(1), F.lit(5))).alias("i", "step")
    ).select(
        F.date_add(F.lit("2002-01-01").cast("date"), F.col("step")).alias("date"), (F.col("s") * (4 - F.col("step"))).alias("forecast_value"),
        F.lit(True).alias("is_future"),
    )
    return past.unionByName(ahead, allowMissingColumns=True)


def alerts(spark, root):
    return projection.forecast_alerts(_with_horizon(spark, root), "net_cashflow").select("severity", "type", "period", "reason", "status")


ALERTS_SQL = f"""WITH f AS ({_flag_sql(2)})
  SELECT DISTINCT 'HIGH' AS severity, 'Abnormal pattern' AS type, CAST(date AS VARCHAR) AS period,
    'Actual performance differs materially from the model expectation.' AS reason, 'OPEN' AS status FROM f WHERE is_anomaly
  UNION ALL SELECT DISTINCT 'HIGH', 'Stock exposure', CAST(date AS VARCHAR), 'Available inventory is below the configured forecast coverage level.', 'OPEN' FROM f WHERE stockout_risk
  UNION ALL SELECT 'MEDIUM', 'Projected decline', '2002-01-06', 'Projected Net cashflow declines by more than 10% across the selected horizon.', 'OPEN' FROM lineitem HAVING sum(l_quantity) > 0
  UNION ALL SELECT 'CRITICAL', 'Negative net cashflow', '2002-01-06', 'At least one projected period has negative net cashflow.', 'OPEN' FROM lineitem HAVING sum(l_quantity) > 0"""


def newest_bytes(spark, root):
    """The newest rows of all series within two fifths of the table's bytes."""
    df = lenses.demand(spark, root).select(*KEYS, "units_sold")
    return demand.fit_series_to_size(df, demand.rows_for_bytes(df, 0)[1] * 2 // 5, row_id="date")


NEWEST_BYTES_SQL = f"""WITH {L.DEMAND},
  w AS (SELECT date, store_id, product_id, units_sold, 16 + octet_length(encode(store_id)) + octet_length(encode(product_id)) AS b,
          row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY store_id, product_id) AS n FROM demand),
  c AS (SELECT *, sum(b) OVER (ORDER BY CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE rn::DOUBLE / n END, store_id DESC, product_id DESC, date DESC) AS upto, sum(b) OVER () AS total FROM w)
  SELECT date, store_id, product_id, units_sold FROM c WHERE upto <= total * 2 // 5"""


def written_share(spark, root):
    """Order lines written within half of the bytes that all of them take."""
    df = read(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    path = scratch_path(spark, "reduced")
    df.write.parquet(f"{path}/all")
    target = demand.written_bytes(spark, f"{path}/all") // 2
    found = demand.write_reduced(df, path, target, ["l_orderkey", "l_linenumber"])
    kept = spark.read.parquet(found["folder"])
    facts = kept.agg(F.count("*").alias("kept"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys"))
    return facts.select(
        F.lit(demand.written_bytes(spark, found["folder"]) <= target).alias("fits"), (F.lit(found["bytes"]) >= 0.8 * target).alias("close"),
        ((F.col("kept") == found["rows"]) & (F.col("kept") == F.col("keys"))).alias("rows_agree"), F.lit(df.count()).alias("rows_read"),
    )


WRITTEN_SHARE_SQL = "SELECT true AS fits, true AS close, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS rows_agree, count(*) AS rows_read FROM lineitem"


def one_day_alerts(spark, root):
    """A horizon of one day with a row per store, whose total is negative: two rows are enough for the cash alert."""
    stores = lenses.demand(spark, root).groupBy("store_id").agg(F.sum("units_sold").alias("units"), F.max("date").alias("last"))
    ahead = stores.select(
        F.date_add("last", 1).alias("date"), F.when(F.col("store_id") == "ASIA", -5 * F.col("units")).otherwise(F.col("units")).alias("forecast_value"), F.lit(True).alias("is_future")
    )
    newest = ahead.agg(F.max("date")).scalar()
    return projection.forecast_alerts(ahead.withColumn("date", newest), "net_cashflow").select("severity", "type", "period", "reason", "status")


ONE_DAY_ALERTS_SQL = f"""WITH {L.DEMAND}, s AS (SELECT store_id, sum(units_sold) AS units, max(date) AS last FROM demand GROUP BY 1),
  t AS (SELECT max(last) + 1 AS day, count(*) AS n, sum(CASE WHEN store_id = 'ASIA' THEN -5 * units ELSE units END) AS total FROM s)
  SELECT 'CRITICAL' AS severity, 'Negative net cashflow' AS type, CAST(CAST(day AS DATE) AS VARCHAR) AS period, 'At least one projected period has negative net cashflow.' AS reason, 'OPEN' AS status
  FROM t WHERE n > 1 AND total < 0"""


def cash_alerts(spark, root):
    df = demand.assess_cash(_cash_forecast(spark, root), "entity", "period", opening_cash=100.0, minimum_cash=20.0)
    named = df.withColumn("row", F.concat_ws("/", F.col("entity").cast("string"), F.col("period").cast("string")))
    return projection.row_alerts(named, "row", F.col("period")).select("alert_id", "severity", "created_at", "status", "reason", "record")


CASH_ALERTS_SQL = f"""WITH {ASSESSED_CASH}, r AS (SELECT *, entity || '/' || period AS row FROM assessed)
  SELECT 'FIN-' || row AS alert_id, 'HIGH' AS severity, period AS created_at, 'OPEN' AS status, 'Abnormal forecast deviation' AS reason, row AS record FROM r WHERE is_anomaly
  UNION ALL SELECT 'CASH-' || row, 'CRITICAL', period, 'OPEN', 'Projected cash balance is below the configured minimum', row FROM r WHERE projected_closing_cash < 20"""


def forecast_status(spark, root):
    counts = flagged_forecast(spark, root).agg(F.count_if("is_anomaly").alias("anomalies"), F.count_if("stockout_risk").alias("stockout_risks"))
    return scoring.forecast_decision(counts)


STATUS_SQL = f"""SELECT count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (stockout_risk) AS stockout_risks, 'OPERATIONAL_REVIEW' AS decision_status,
  'Review stock exposure and confirm replenishment constraints.' AS priority_action FROM ({_flag_sql(2)})"""


def series_actions(spark, root):
    df = scoring.flag_actions(flagged_forecast(spark, root))
    return df.select(*KEYS, F.array_join("recommended_actions", " ").alias("actions"))


ACTIONS_SQL = f"""SELECT date, store_id, product_id, CASE WHEN stockout_risk OR is_anomaly THEN concat_ws(' ',
  CASE WHEN stockout_risk THEN 'Review replenishment and safety-stock levels.' END,
  CASE WHEN is_anomaly THEN 'Investigate the demand deviation, promotion, weather, pricing, and data quality.' END) ELSE 'No exceptional action detected.' END AS actions
  FROM ({_flag_sql(2)})"""

QUERIES = {
    "demand_short_features": short_features,
    "demand_long_features": long_features,
    "demand_cash_assessment": cash_assessment,
    "demand_newest_rows": newest_rows,
    "demand_sampled_rows": sampled,
    "demand_fit_to_size": fitted,
    "demand_reduced_share": reduced,
    "demand_written_share": written_share,
    "demand_newest_bytes": newest_bytes,
    "demand_reduction_report": reduction,
    "demand_stable_sort": sorted_rows,
    "split_dates": date_split,
    "split_holdout": holdout,
    "split_position": position_split,
    "split_classes": class_split,
    "forecast_projection": projected,
    "forecast_flags": flagged_forecast,
    "forecast_flags_single_cover": lambda s, r: flagged_forecast(s, r, cover=1.0),
    "forecast_alerts": alerts,
    "forecast_alerts_one_day": one_day_alerts,
    "forecast_row_alerts": cash_alerts,
    "forecast_observations": lambda s, r: metrics.observation_summary(flagged_forecast(s, r)),
    "forecast_decision": forecast_status,
    "forecast_actions": series_actions,
}
SQL = {
    "demand_short_features": SHORT_SQL,
    "demand_long_features": LONG_SQL,
    "demand_cash_assessment": CASH_SQL,
    "demand_newest_rows": NEWEST_SQL,
    "demand_sampled_rows": SAMPLED_SQL,
    "demand_fit_to_size": FITTED_SQL,
    "demand_reduced_share": REDUCED_SQL,
    "demand_written_share": WRITTEN_SHARE_SQL,
    "demand_newest_bytes": NEWEST_BYTES_SQL,
    "demand_reduction_report": REDUCTION_SQL,
    "demand_stable_sort": f"WITH {L.INVOICES} SELECT row_id, cust_number, posting_date FROM invoices ORDER BY cust_number, posting_date, row_id",
    "split_dates": DATE_SPLIT_SQL,
    "split_holdout": HOLDOUT_SQL,
    "split_position": POSITION_SQL,
    "split_classes": CLASS_SQL,
    "forecast_projection": PROJECTED_SQL,
    "forecast_flags": _flag_sql(2),
    "forecast_flags_single_cover": _flag_sql(1),
    "forecast_alerts": ALERTS_SQL,
    "forecast_alerts_one_day": ONE_DAY_ALERTS_SQL,
    "forecast_row_alerts": CASH_ALERTS_SQL,
    "forecast_observations": f"""SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (stockout_risk) AS stockout_risks,
      format('{{:,}}', count(*)) || ' forecast observations analyzed' AS headline FROM ({_flag_sql(2)})""",
    "forecast_decision": STATUS_SQL,
    "forecast_actions": ACTIONS_SQL,
}
