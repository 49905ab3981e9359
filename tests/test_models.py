"""Measures, series, projection, scoring and training on small fixtures."""

import math
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Observation
from pyspark.sql import functions as F

from duecast.operators import combine, compiled, demand, encoding, learn, metrics, projection, quantiles, scoring, selection
from duecast.operators.features import loan_layout
from duecast.plans import modelling
from duecast.sources import lenses


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    row = metrics.classification(df, "y", "p").first()
    assert row.roc_auc is None and row.pr_auc is None and row.specificity is None and row.balanced_accuracy == 0.5


def test_small_regression(spark):
    row = metrics.regression(spark.createDataFrame([(10.0, 11.0), (20.0, 18.0)], "y double, f double"), "y", "f").first()
    assert row.mae == 1.5 and row.median_absolute_error == 1.5
    flat = metrics.regression(spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "y double, f double"), "y", "f").first()
    assert flat.r2 == 1.0 and flat.wape is None and flat.mape is None


def test_measures_in_segments(spark, small):
    df = lenses.scores(spark, small)
    one, many = (metrics.classification(df, "y", "p", rows_per_task=n).first().asDict() for n in (10**9, 50))
    assert all(math.isclose(one[k], many[k]) for k in one)
    by = lambda n: {r.segment: round(r.pr_auc, 9) for r in metrics.ranking_quality(df, "y", "p", ["segment"], n).collect()}
    assert by(10**9) == by(50)


def test_quantiles_by_narrowing(spark, small):
    df = lenses.forecasts(spark, small)
    columns = {"a": F.col("units_sold"), "b": F.col("price"), "c": F.when(F.col("units_sold") > 30, F.col("inventory_level"))}
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    exact = quantiles.exact_quantiles(df, columns, shares)
    narrowed = quantiles.exact_quantiles(df, columns, shares, small=10, final=20)
    for name in columns:
        assert narrowed[name] == pytest.approx(exact[name])


def test_neighbouring_ranks_share_their_bracket(spark, monkeypatch):
    """F6, F8, F13: the two middle ranks of an even number of values take one guess and one list, not two."""
    made, guess = [], F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: (made.append(a), guess(*a))[1])
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("a"))
    assert quantiles.exact_medians(df, ["a"], small=10)["a"] == df.agg(F.median("a")).first()[0]
    assert not made
    assert quantiles.exact_quantiles(df, {"a": F.col("a")}, [0.5], small=10, final=500)["a"] == [df.agg(F.median("a")).first()[0]]
    assert len(made) == 1


def _series(spark, days=30, product="P"):
    return spark.range(days).select(
        F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("S").alias("store_id"), F.lit(product).alias("product_id"),
        (F.col("id") + 1).cast("double").alias("units_sold"),
    )


@pytest.mark.parametrize("rows", [3, 11, 40])
def test_long_series_in_overlapping_segments(spark, rows):
    """Segments far shorter than the reach of the features, and series that start inside a segment."""
    parts = [_series(spark, n, p) for n, p in ((100, "a"), (7, "b"), (45, "c"))]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("units_sold", F.col("units_sold") * F.col("units_sold") % 37)
    df = df.withColumn("date", F.col("date").cast("timestamp"))
    key = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    for add in (demand.add_short_features, demand.add_long_features):
        plain, cut = add(df), add(df, rows_per_task=rows)
        assert plain.columns == cut.columns
        for a, b in zip(key(plain), key(cut), strict=True):
            assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
            assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)])


def test_repeated_dates_of_a_series_are_refused(spark):
    df = _series(spark, 5)
    for frame in (df, df.withColumn("date", F.col("date").cast("timestamp"))):
        with pytest.raises(Exception, match="two rows of one date"):
            demand.add_short_features(frame.unionByName(frame.limit(1))).collect()


def test_projection_of_a_model_equals_the_fold(spark):
    """A pipeline fitted on lag_1 alone and the same weights in the fold agree over more than one checkpoint."""
    history = _series(spark).unionByName(_series(spark, 9, "short"))
    featured = demand.add_short_features(history).where("lag_1 is not null and product_id = 'P'")
    model = Pipeline(stages=[VectorAssembler(inputCols=["lag_1", "dow"], outputCol="features"), LinearRegression(labelCol="units_sold", regParam=0.1)]).fit(featured)
    fitted = model.stages[-1]
    weights = {"intercept": fitted.intercept, "lag_1": fitted.coefficients[0], "dow": fitted.coefficients[1]}
    order = ["product_id", "date"]
    stepwise, compiled = (projection.project_model(history, model, horizon=23, compiled=c) for c in (False, True))
    assert "Exchange" not in projection.project_model(history.limit(0), model, horizon=9).select("forecast_value")._jdf.queryExecution().optimizedPlan().toString()
    spread = projection.residual_spread(history, model)
    stepwise, compiled = (d.orderBy(*order).collect() for d in (stepwise, compiled))
    assert [r.forecast_value for r in compiled] == pytest.approx([r.forecast_value for r in stepwise])
    assert all(r.forecast_upper - r.forecast_value == pytest.approx(1.96 * spread) for r in compiled)
    folded = projection.project_linear(history, weights, horizon=23).orderBy(*order).collect()
    assert len(stepwise) == 46
    assert [r.forecast_value for r in stepwise] == pytest.approx([r.forecast_value for r in folded])
    assert [r.date for r in stepwise] == [r.date for r in folded]


@pytest.fixture(scope="module")
def labelled(spark):
    key = F.col("id")
    return spark.range(600).select(
        key.cast("string").alias("key"), F.when(key % 11 > 0, (key * 37 % 101).cast("double")).alias("a"), (key * 13 % 29).cast("double").alias("b"), F.when(key % 7 > 0, F.concat(F.lit("l"), key % 9)).alias("c"),
        (key % 4).cast("string").alias("d"), ((key * 37 % 101 + key * 13 % 29 + key % 9 * 5) > 75).cast("double").alias("y"), (key * 37 % 101 * 0.5 + key % 9 * 3 + key * 13 % 29).alias("amount"),
    )


@pytest.mark.parametrize("name", ["Logistic Regression", "Random Forest", "Gradient Boosting", "Ridge", "Forest of amounts", "Boosted amounts"])
def test_compiled_models_equal_their_pipelines(spark, labelled, name):
    small = {"numTrees": 6, "maxDepth": 5, "maxIter": 7, "minInstancesPerNode": 1}
    if name in learn.CLASSIFIERS:
        model = learn.fit_classifier(labelled, "y", ["a", "b"], ["c", "d"], name, small, min_frequency=60)
        output = learn.positive_probability(model.transform(labelled)).select("key", "probability")
    else:
        settings = {"Ridge": LinearRegression(labelCol="amount"), "Forest of amounts": RandomForestRegressor(labelCol="amount", numTrees=5, seed=1), "Boosted amounts": GBTRegressor(labelCol="amount", maxIter=5, seed=1)}
        model = Pipeline(stages=[*learn.preparation(labelled, ["a", "b"], ["c", "d"], min_frequency=60), settings[name]]).fit(labelled)
        output = model.transform(labelled).select("key", "prediction")
    expression = compiled.CompiledModel(model, spark)
    other = labelled.withColumn("c", F.when(F.col("key").cast("int") % 5 == 0, "unseen").otherwise(F.col("c")))
    if name == "Gradient Boosting":
        output = learn.positive_probability(model.transform(other)).select("key", "probability")
        labelled = other
    want = dict(map(tuple, output.collect()))
    slotted = expression.with_slots(labelled)
    got = dict(map(tuple, slotted.select("key", expression.column()).collect()))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    # The drivers of a row, inside the row and from copies of it.
    if name in learn.CLASSIFIERS:
        usual = {"a": 50.0, "b": 14.0, "c": "l3", "d": "1"}
        score = lambda d: learn.positive_probability(model.transform(d))
        copies = {r["key"]: r["drivers"] for r in scoring.key_risk_factors(labelled, "key", score, usual).collect()}
        inside = scoring.drivers_in_row(slotted, expression.output(usual), usual)
        assert "Exchange" not in "\n".join(l for l in inside._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" not in l)
        for r in inside.collect():
            assert [(d["feature"], d["value"]) for d in r["drivers"]] == [(d["feature"], d["value"]) for d in copies[r["key"]]]
            assert [d["impact"] for d in r["drivers"]] == pytest.approx([d["impact"] for d in copies[r["key"]]])


@pytest.mark.parametrize("name", ["Logistic Regression", "Random Forest"])
def test_models_score_in_a_session_that_observed_a_table(spark, labelled, name):
    """a training summary holds the session, which cannot be sent to tasks once it has an observation."""
    labelled.observe(Observation(f"rows of {name}"), F.count("*")).collect()
    model = learn.fit_classifier(labelled, "y", ["a", "b"], ["c"], name, {"maxIter": 5, "numTrees": 3, "maxDepth": 3})
    assert not model.stages[-1].hasSummary
    assert learn.positive_probability(model.transform(labelled)).where(F.col("probability").between(0, 1)).count() == 600


def test_algorithms_share_one_preparation(spark, small, monkeypatch):
    """rows are prepared once, whatever the number of algorithms, and the models are those trained alone."""
    fits, fit = [], learn.LevelEncoder._fit
    monkeypatch.setattr(learn.LevelEncoder, "_fit", lambda self, df: (fits.append(self), fit(self, df))[1])
    settings = {"maxIter": 3}
    learn.train_payment_models(lenses.invoices(spark, small), ["Logistic Regression", "Gradient Boosting"], features=["business_code"], overrides=settings, history=False)
    assert len(fits) == 1
    df = lenses.credit(spark, small)
    both = learn.train_credit_models(df, overrides=settings)
    assert len(fits) == 2 and list(both) == ["baseline", "boosted"]
    for kind, model in both.items():
        got, want = (dict(map(tuple, learn.score_credit_model(m, df).select("client_id", "probability").collect())) for m in (model, learn.train_credit_model(df, kind, settings)))
        assert got == pytest.approx(want)


def test_the_history_of_payments_is_computed_once(spark, small, monkeypatch):
    """every pass after the first reads written rows, not the windows behind them."""
    plans = []

    def look(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(learn, "screen_features", look)
    with pytest.raises(InterruptedError):
        learn.train_payment_models(lenses.invoices(spark, small), ["Gradient Boosting"], features=["total_open_amount"])
    assert len(plans) == 1 and "Window" not in plans[0] and "Join" not in plans[0]


def test_demand_models_share_stored_rows_and_are_fitted_together(spark, small, monkeypatch):
    """the daily rows are summed once, and no algorithm waits for another."""
    stored, together, fit, store = [], threading.Barrier(3), learn.fit_learner, learn.materialize
    monkeypatch.setattr(learn, "fit_learner", lambda *a: (together.wait(120), fit(*a))[1])
    monkeypatch.setattr(learn, "materialize", lambda df, label: (stored.append(label), store(df, label))[1])
    result = learn.train_demand_models(lenses.demand(spark, small), list(learn.REGRESSORS), overrides={"maxIter": 2, "numTrees": 2, "maxDepth": 2})
    assert stored[0] == "demand" and set(result.models) == set(learn.REGRESSORS)
    assert [r.algorithm for r in result.runs.collect()] == list(learn.REGRESSORS)


def test_training_vectors_come_in_even_parts(spark):
    """a table read in one part occupied one core in every pass of a learner."""
    rows = spark.range(200_000).coalesce(1).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    _, vectors = learn.prepare_vectors(rows, learn.preparation(rows, ["a"], []), ["y"])
    sizes = [r["count"] for r in vectors.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == min(8, spark.sparkContext.defaultParallelism) and sum(sizes) == 200_000 and max(sizes) < 1.1 * min(sizes)
    assert learn.dealt_evenly(rows, (1000, 10_000)).rdd.getNumPartitions() == 24  # a multiple of the cores beyond the second limit


def test_narrow_vectors_equal_wide_ones(spark, monkeypatch):
    """narrow vectors are made without a detour by text, with the same values."""
    df = spark.createDataFrame([("a", "x", 1.0)] * 8 + [("b", "y", 2.0)] * 6 + [("c", None, None)], "c string, d string, n double")
    model = Pipeline(stages=learn.preparation(df, ["n"], ["c", "d"], min_frequency=5)).fit(df)
    unseen = spark.createDataFrame([("a", "x", 1.0), ("c", "y", None), ("zzz", "zzz", 4.0), (None, None, 0.0), ("b", "x", -1.0)], "c string, d string, n double")
    vectors, usual = {}, encoding.DENSE_WIDTH
    for width in (usual, 0):
        monkeypatch.setattr(encoding, "DENSE_WIDTH", width)
        made = model.transform(unseen)
        vectors[width] = [r.features.toArray().tolist() for r in made.collect()]
        assert made.columns == [*unseen.columns, "features"]
        assert ("from_json" in made._jdf.queryExecution().optimizedPlan().toString()) == (width == 0)
    assert vectors[0] == vectors[usual]


def test_loans_are_parsed_once(spark, small, monkeypatch):
    """rows are scored as they were stored for training, and not read and parsed again."""
    learner, settings = learn.CLASSIFIERS["Gradient Boosting"]
    monkeypatch.setitem(learn.CLASSIFIERS, "Gradient Boosting", (learner, {**settings, "maxIter": 2}))
    for query in ("train_loan_default", "train_loan_default_scores"):
        result = modelling.QUERIES[query](spark, small)
        assert not [f for f in result.inputFiles() if small in f]
        assert result.count() == loan_layout(lenses.accepted_loans(spark, small)).count()


def test_a_level_replaced_by_another(spark, labelled):
    model = learn.fit_classifier(labelled, "y", ["a", "b"], ["c", "d"], "Logistic Regression", {"maxIter": 5}, min_frequency=10)
    expression = compiled.CompiledModel(model, spark)
    want = dict(map(tuple, learn.positive_probability(model.transform(labelled.withColumn("c", F.lit("l3")))).select("key", "probability").collect()))
    got = dict(map(tuple, expression.with_slots(labelled).select("key", expression.column(slots={"c": expression.slot_of("c", "l3")})).collect()))
    assert got == pytest.approx(want)


def test_projection_limits(spark):
    df = _series(spark, 3)
    out = projection.project_linear(df, {"lag_14": 1.0}, horizon=2, deviation=1.0).orderBy("date").collect()
    assert [r.forecast_value for r in out] == [1.0, 1.0] and out[0].forecast_lower == 0.0 and out[0].forecast_upper == pytest.approx(2.96)
    assert projection.project_linear(df, {"intercept": -5.0}, horizon=1, nonnegative=False).first().forecast_value == -5.0
    for horizon in (0, 366):
        with pytest.raises(ValueError):
            projection.project_linear(df, {}, horizon=horizon)


def test_alert_rules(spark):
    layout = "date date, forecast_value double, is_future boolean, is_anomaly boolean, stockout_risk boolean"
    rows = lambda *values: spark.createDataFrame([(None, v, True, False, False) for v in values], layout).withColumn(
        "date", F.date_add(F.lit("2026-01-01").cast("date"), (F.row_number().over(projection.Window.orderBy(F.monotonically_increasing_id()))).cast("int"))
    )
    assert [r.type for r in projection.forecast_alerts(rows(100.0, 80.0, 70.0), "units_sold").collect()] == ["Projected decline"]
    assert "Negative net cashflow" in [r.type for r in projection.forecast_alerts(rows(10.0, -2.0), "net_cashflow").collect()]
    assert projection.forecast_alerts(rows(10.0, 9.5), "units_sold").count() == 0


def test_split_with_undated_rows_and_one_date(spark):
    df = spark.range(100).withColumn("d", F.when(F.col("id") < 90, F.lit("2026-01-01").cast("date")))
    plain, hot = (demand.split_by_position(df, "d", "id", rows_per_task=n) for n in (10**9, 7))
    counts = {r.split: r["count"] for r in plain.groupBy("split").count().collect()}
    assert counts == {"train": 70, "validation": 15, "test": 15}
    assert {r.id: r.split for r in plain.collect()} == {r.id: r.split for r in hot.collect()}


def test_split_of_timestamps_counts_days(spark):
    df = spark.range(400).withColumn("d", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1800 * 7919 % 864_000))
    plain, hot = ({r.id: r.split for r in demand.split_by_position(df, "d", "id", rows_per_task=n).collect()} for n in (10**9, 7))
    ordered = [r.id for r in df.orderBy("d", "id").collect()]
    assert plain == hot == {i: "train" if k < 280 else "validation" if k < 340 else "test" for k, i in enumerate(ordered)}


@pytest.mark.parametrize("width", [2, 300])
def test_written_size_drives_the_share(spark, tmp_path, width):
    """Widths of rows far above and far below what a file takes."""
    df = spark.range(20_000).select("id", F.repeat(F.lit("x"), width).alias("same"), F.sha2(F.col("id").cast("string"), 256).alias("own")).coalesce(2)
    df.write.parquet(str(tmp_path / "all"))
    whole = demand.written_bytes(spark, str(tmp_path / "all"))
    found = demand.write_reduced(df, str(tmp_path / "less"), whole // 3, ["id"])
    assert 0.85 * (whole // 3) <= found["bytes"] <= whole // 3 and spark.read.parquet(found["folder"]).count() == found["rows"]
    assert demand.write_reduced(df, str(tmp_path / "full"), 2 * whole, ["id"])["rows"] == 20_000
    with pytest.raises(ValueError, match="No share"):
        demand.write_reduced(df, str(tmp_path / "none"), 10, ["id"], rounds=2)


@pytest.mark.parametrize(("rows", "bins"), [(10**9, 4096), (9, 4), (5, 1)])
def test_newest_rows_fill_the_byte_limit(spark, rows, bins):
    """Any number of bins and segments finds the same cut, less than one row below the limit."""
    df = _series(spark, 90, "a").unionByName(_series(spark, 8, "b")).unionByName(_series(spark, 1, "c")).withColumn("note", F.repeat(F.lit("x"), (F.col("units_sold") % 13).cast("int")))
    widths = {(r[0], r[1]): r[2] for r in df.select("product_id", "date", demand.row_bytes(df)).collect()}
    length = {p: sum(k[0] == p for k in widths) for p in "abc"}
    rank = {k: sum(o[0] == k[0] and o[1] >= k[1] for o in widths) for k in widths}
    order = sorted(widths, key=lambda k: (0 if rank[k] == 1 else rank[k] / length[k[0]], -ord(k[0]), -k[1].toordinal()))
    for limit in (0, 60, 700, 2000, 10**9):
        want, used = set(), 0
        for k in order:
            if used + widths[k] > limit:
                break
            want.add(k)
            used += widths[k]
        kept = demand.fit_series_to_size(df, limit, "date", rows, bins)
        assert kept.columns == df.columns and {(r["product_id"], r["date"]) for r in kept.collect()} == want


def test_sample_size_is_exact(spark):
    df = spark.range(5000)
    first, again = ({r.id for r in demand.sample_rows(df.repartition(n), 1234, ["id"], 7, "id").collect()} for n in (2, 5))
    assert len(first) == 1234 and first == again
    assert demand.sample_rows(df, 9000, ["id"], 7, "id").count() == 5000


def test_newest_rows_keep_every_series(spark):
    df = _series(spark, 60, "a").unionByName(_series(spark, 3, "b"))
    kept = {r.product_id: (r["count"], str(r["max"])) for r in demand.keep_newest(df, 20, "date").groupBy("product_id").agg(F.count("*").alias("count"), F.max("date").alias("max")).collect()}
    assert kept == {"a": (19, "2026-03-01"), "b": (1, "2026-01-03")}


def test_sizes_are_honoured(spark):
    df = _series(spark, 200, "a").unionByName(_series(spark, 50, "b")).withColumn("payload", F.repeat(F.lit("x"), 100)).withColumn("row_id", F.col("date"))
    width = df.agg(F.sum(demand.row_bytes(df))).first()[0] / 250
    kept = demand.fit_series_to_size(df, int(100 * width))
    assert kept.agg(F.sum(demand.row_bytes(kept))).first()[0] <= 100 * width
    assert kept.agg(F.max("date")).first()[0] == df.agg(F.max("date")).first()[0]
    flagged = df.withColumn("is_problem", F.col("product_id") == "b")
    fitted, report = demand.fit_to_size(flagged, int(80 * width), ["date", "product_id"], "row_id")
    assert report["problem_rows_removed"] == 50 and report["final_bytes"] <= 80 * width and fitted.count() == report["final_rows"] > 60
    with pytest.raises(ValueError):
        demand.reduce_files(df, 1000, 10, ["date"])


def test_joint_decisions(spark):
    a = spark.createDataFrame([("1", 0.5, "MEDIUM_RISK"), ("2", 0.1, "LOW_RISK")], "client_id string, behavior_probability double, behavior_tier string")
    b = spark.createDataFrame([("1", 0.4, "MEDIUM_RISK"), ("3", 0.4, "MEDIUM_RISK")], "client_id string, loan_probability double, loan_tier string")
    out = {r.client_id: (r.final_status, r.models_used) for r in combine.combine_assessments(a, b).collect()}
    assert out == {"1": ("MANUAL_REVIEW", "Payment behavior + Loan profile"), "2": ("STANDARD_PROCESS", "Payment behavior"), "3": ("REVIEW_RECOMMENDED", "Loan profile")}


def test_driver_lines(spark):
    df = spark.createDataFrame([("x", 1, 2.0)], "id string, previous_invoice_count int, other double")
    score = lambda d: d.withColumn("probability", 0.1 * F.col("previous_invoice_count") + 0.0001 * F.col("other"))
    found = scoring.key_risk_factors(df, "id", score, {"previous_invoice_count": 0.0, "other": 0.0})
    assert found.select(scoring.describe_drivers(F.col("drivers"))).first()[0] == "1. Previous invoice count: 1.00 | Influence: 10.0%"


def test_augmentation(spark, small):
    df = lenses.credit(spark, small).withColumn("default_next_month", (F.col("PAY_0") > 3).cast("int"))
    out, facts = learn.augment_minority(df, "c_custkey", target_ratio=0.9)
    again, _ = learn.augment_minority(df.repartition(7), "c_custkey", target_ratio=0.9)
    made = out.where("is_synthetic")
    assert made.count() == facts["synthetic_rows"] > 0
    assert made.select("client_id").distinct().count() == facts["synthetic_rows"]
    key = lambda d: sorted((r.client_id, r.BILL_AMT1) for r in d.where("is_synthetic").collect())
    assert key(out) == key(again)
    assert out.where("not is_synthetic").count() == df.count()
    with pytest.raises(ValueError):
        learn.augment_minority(df, "c_custkey", target_ratio=2)


def test_rare_levels_share_an_indicator(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 6 + [("c",)] + [(None,)], "c string").withColumn("n", F.lit(1.0))
    model = Pipeline(stages=learn.preparation(df, ["n"], ["c"], min_frequency=5)).fit(df)
    unseen = spark.createDataFrame([("a", 1.0), ("c", 1.0), ("zzz", 1.0), (None, 1.0)], "c string, n double")
    vectors = [list(r.features.toArray()[1:]) for r in model.transform(unseen).collect()]
    assert vectors == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [1, 0, 0]]


def test_unsupported_algorithm(spark, small):
    with pytest.raises(ValueError, match="no Spark ML counterpart"):
        learn.train_demand_models(lenses.demand(spark, small), ["XGBoost"])


def test_legacy_training_reports_three_parts(spark, small):
    result = learn.train_demand_models(lenses.demand(spark, small), ["Ridge", "Gradient Boosting"], overrides={"maxIter": 3}, with_train_figures=True)
    rows = result.runs.collect()
    assert all(set(r.train) == set(learn.ERRORS) and r.test["mae"] > 0 for r in rows) and result.best in result.models
    importance = learn.model_importance(result.models["Gradient Boosting"], lenses.demand(spark, small).transform(demand.add_short_features))
    assert learn.top_importance(importance, 3).count() == 3


@pytest.mark.parametrize(("query", "trainer", "table"), [("train_payment_risk_all", "train_payment_models", "CLASSIFIERS"), ("train_demand_all", "train_demand_models", "REGRESSORS")])
def test_every_algorithm_is_run_with_its_figures(spark, small, monkeypatch, query, trainer, table):
    made, train = {}, getattr(learn, trainer)

    def light(df, algorithms, **settings):
        made.update(settings)
        return train(df, algorithms, overrides={"maxIter": 2, "numTrees": 2, "maxDepth": 2}, **settings)

    monkeypatch.setattr(learn, trainer, light)
    rows = modelling.QUERIES[query](spark, small).collect()
    assert made == {}  # no settings or columns of its own
    assert sorted(r["algorithm"] for r in rows) == sorted(getattr(learn, table)) and sum(r["best"] for r in rows) == 1
    assert len({(r["train_rows"], r["validation_rows"], r["test_rows"]) for r in rows}) == 1 and all(r["train_rows"] > r["test_rows"] > 0 for r in rows)
    assert all(r[f"{part}_{n}"] is not None for r in rows for part in ("validation", "test") for n in (["pr_auc", "brier"] if table == "CLASSIFIERS" else ["mae", "wape"]))


def test_the_checked_payment_query_trains_every_algorithm_on_all_columns(spark, small, monkeypatch):
    """one of three algorithms was left out, and all columns but two."""
    seen, train = [], learn.train_payment_models

    def light(df, algorithms, **settings):
        seen.append((set(df.columns), settings, train(df, algorithms, overrides={"maxIter": 2, "numTrees": 2, "maxDepth": 2}, **settings)))
        return seen[-1][-1]

    monkeypatch.setattr(learn, "train_payment_models", light)
    rows = modelling.QUERIES["train_payment_risk"](spark, small).collect()
    assert sorted(r["algorithm"] for r in rows) == sorted(learn.CLASSIFIERS) and all(r["sound"] for r in rows)
    [(columns, settings, result)] = seen
    assert settings == {} and columns == set(lenses.invoices(spark, small).columns)
    assert {"document_type", "business_code", "previous_late_ratio"} <= set(result.features)


def test_acceptance_rule(spark):
    pairs = spark.createDataFrame(
        [({"pr_auc": 0.5, "roc_auc": 0.6, "brier": 0.2, "recall": 0.5}, {"pr_auc": 0.6, "roc_auc": 0.6, "brier": 0.2, "recall": r}) for r in (0.49, 0.4)],
        "before map<string,double>, after map<string,double>",
    )
    assert [r.recommended for r in learn.augmentation_decision(pairs).collect()] == ["augmented", "baseline"]


def test_promotion_archives_the_champion(spark):
    log = spark.createDataFrame(
        [("o", "credit", "v1", "CHAMPION", 1), ("o", "credit", "v2", "CHAMPION", 2), ("o", "credit", "v3", "REJECTED", 3), ("__platform__", "loan", "p", "CHAMPION", 1)],
        "owner string, task string, version string, status string, event_ts int",
    )
    states = {r.version: r.status for r in selection.version_states(log).collect()}
    assert states == {"v1": "ARCHIVED", "v2": "CHAMPION", "v3": "REJECTED", "p": "CHAMPION"}
    wanted = spark.createDataFrame([("o", "credit"), ("o", "loan"), ("o", "forecast")], "owner string, task string")
    assert {(r.task, r.version, r.scope) for r in selection.active_models(wanted, log).collect()} == {("credit", "v2", "own"), ("loan", "p", "platform"), ("forecast", None, "none")}
