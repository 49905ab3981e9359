"""Training and scoring with Spark ML pipelines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from duecast.functions.values import as_double, order_key
from duecast.operators import forest, metrics
from duecast.operators.demand import HASH_RANGE, LONG_LAGS, ROLLING, SHORT_LAGS, add_long_features, add_short_features, split_by_dates, split_by_position, split_stratified
from duecast.operators.encoding import LevelEncoder, LevelEncoderModel
from duecast.operators.features import (
    CREDIT_ENGINEERED, CREDIT_FEATURES, CREDIT_TARGET, LOAN_CATEGORICAL, LOAN_NUMERIC, PAY_STATUS, add_credit_behaviour,
)
from duecast.operators.filters import known_outcomes
from duecast.operators.history import CLEAR_NAMES, DUE_NAMES, HISTORY_FEATURES, POSTING_NAMES, add_training_history, find_column
from duecast.operators.sketches import column_facts
from duecast.operators.skew import add_prior_sums
from duecast.session import materialize, scratch_path

SEED = 42

# Names that are never model inputs.
LEAKING = [
    "clear_date", "clearing_date", "payment_date", "paid_date", "due_in_date", "due_date", "delay_days", "days_late", "is_late",
    "isopen", "is_open", "payment_status", "default_next_month", "dataset_source",
]
IDENTIFYING = ["invoice_id", "doc_id", "client_id", "customer_name", "name_customer", "cust_number"]

# Settings of the classifiers and regressors.
CLASSIFIERS = {
    "Logistic Regression": (LogisticRegression, {"maxIter": 600, "elasticNetParam": 0.0, "standardization": False}),
    "Random Forest": (RandomForestClassifier, {"numTrees": 140, "maxDepth": 18, "minInstancesPerNode": 2, "seed": SEED}),
    "Gradient Boosting": (GBTClassifier, {"maxIter": 120, "stepSize": 0.06, "maxDepth": 3, "seed": SEED}),
}
REGRESSORS = {
    "Ridge": (LinearRegression, {"standardization": False, "elasticNetParam": 0.0}),
    "Random Forest": (RandomForestRegressor, {"numTrees": 120, "maxDepth": 14, "minInstancesPerNode": 4, "featureSubsetStrategy": "all", "seed": SEED}),
    "Gradient Boosting": (GBTRegressor, {"maxIter": 120, "stepSize": 0.06, "maxDepth": 3, "seed": SEED}),
}
RIDGE_ALPHA = 1.0
LOGISTIC_C = 1.0
#: Classifiers whose rows are weighted so that both classes count the same.
BALANCED = ("Logistic Regression", "Random Forest")
#: Levels with an indicator of their own in the demand encoder; other encoders have no such limit.
DEMAND_LEVELS = 50


@dataclass
class Training:
    """Fitted models and one row of figures per model."""

    runs: DataFrame
    models: dict[str, PipelineModel]
    best: str
    features: list[str]
    removed: dict[str, str] = field(default_factory=dict)


def screen_features(df: DataFrame, requested: Sequence[str], target: str, row_id: str | None = None) -> tuple[list[str], dict[str, str]]:
    """(usable features, reason per removed column), from one pass over all columns. [M1]"""
    present = [c for c in requested if c in df.columns and c not in (target, row_id)]
    key = {c: c.strip().lower().replace(" ", "_") for c in present}
    removed = {c: "outcome/date leakage" for c in present if key[c] in [*LEAKING, target.lower()] or "date" in key[c]}
    removed.update({c: "identifier" for c in present if c not in removed and any(i in key[c] for i in IDENTIFYING)})
    rest = [c for c in present if c not in removed]
    if rest:
        facts = column_facts(df, rest)
        limit = min(500, max(50, int(max(f.rows for f in facts.values()) * 0.02)))
        for c in rest:
            n = facts[c].distinct
            if n <= 1:
                removed[c] = "constant"
            elif dict(df.dtypes)[c] == "string" and n > limit:
                removed[c] = "high-cardinality text"
    return [c for c in present if c not in removed], removed


def preparation(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_frequency: int = 5, max_levels: int | None = None, unknown_as_infrequent: bool = False,
    scale: bool = True,
) -> list:
    """Pipeline stages: medians and scaling for numbers, usual values and indicators for categories, from a table of levels. [M5]"""
    return [LevelEncoder(numeric, categorical, min_frequency, max_levels, unknown_as_infrequent, scale)]


def split_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns."""
    kinds = dict(df.dtypes)
    numeric = [c for c in features if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")]
    return numeric, [c for c in features if c not in numeric]


def add_class_weight(df: DataFrame, label: str) -> DataFrame:
    """``weight`` that gives both classes the same total. [A15]"""
    facts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n")).first()
    positive, rows = max(facts["p"], 1), facts["n"]
    negative = max(rows - facts["p"], 1)
    return df.withColumn("weight", F.when(F.col(label) == 1, rows / (2.0 * positive)).otherwise(rows / (2.0 * negative)))


def _estimator(table: Mapping, name: str, overrides: Mapping | None, **columns):
    if name not in table:
        raise ValueError(f"{name} has no Spark ML counterpart here; choose one of {', '.join(table)}.")
    cls, settings = table[name]
    allowed = {p.name for p in cls().params}
    merged = {**settings, **{k: v for k, v in (overrides or {}).items() if k in allowed}}
    return cls(**columns, **merged)


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("probability", vector_to_array("probability")[1])


#: Rows of one task of a learner: fewer than the first are not worth a task, more than the second are dealt to several.
FIT_ROWS = (25_000, 500_000)


def dealt_evenly(df: DataFrame, rows: tuple[int, int] = FIT_ROWS) -> DataFrame:
    """The rows in even parts, as many as all cores take at once or a multiple of it.

    Small tables are read back in a few uneven parts, and a learner that passes over them hundreds of times would leave most cores idle.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, df.count()
    parts = max(1, min(cores, math.ceil(size / rows[0])))
    return df.repartition(parts * max(1, math.ceil(size / (parts * rows[1]))))


def prepare_vectors(train: DataFrame, stages: Sequence, keep: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Fitted preparation, and the training vectors written once, in even parts: learners pass over them many times."""
    fitted = Pipeline(stages=list(stages)).fit(train)
    return fitted, materialize(fitted.transform(dealt_evenly(train)).select("features", *keep), "vectors")


def fit_learner(estimator, rows: DataFrame) -> Model:
    """A fitted learner without the summary of its training.

    Such a summary holds the session, which cannot be sent to tasks once an ``Observation`` was used in it. A stored model has none.
    A forest that is too deep for one pass a level is grown from rows dealt to its nodes.
    """
    if isinstance(estimator, RandomForestClassifier) and forest.outgrows_mllib(estimator, rows):
        return forest.fit(estimator, rows)
    model = estimator.fit(rows)
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(rows.sparkSession, "learner")
    model.write().save(path)
    return type(model).load(path)


def fit_classifier(
    train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], algorithm: str, overrides: Mapping | None = None,
    min_frequency: int = 5, balanced: bool | None = None,
) -> PipelineModel:
    """One classifier behind its preparation; classes are balanced for ``BALANCED`` algorithms unless stated. [M5, M6]

    Logistic regression has the penalty of one over twice the squared weights against the summed loss (C = 1);
    Spark divides the loss by the sum of row weights, so the penalty is divided by it too. The intercept bears none.
    """
    prepared = prepare_vectors(train, preparation(train, numeric, categorical, min_frequency), [label])
    return fit_prepared(*prepared, label, algorithm, overrides, balanced)


def fit_prepared(
    fitted: PipelineModel, vectors: DataFrame, label: str, algorithm: str, overrides: Mapping | None = None, balanced: bool | None = None
) -> PipelineModel:
    """``fit_classifier`` on vectors that are prepared already, so that several algorithms share them."""
    weighted = algorithm in BALANCED if balanced is None else balanced
    rows = add_class_weight(vectors, label) if weighted else vectors.withColumn("weight", F.lit(1.0))
    settings = dict(overrides or {})
    if algorithm == "Logistic Regression":
        settings.setdefault("regParam", 1.0 / (LOGISTIC_C * max(rows.agg(F.sum("weight")).first()[0] or 1.0, 1.0)))
    estimator = _estimator(CLASSIFIERS, algorithm, settings, featuresCol="features", labelCol=label, weightCol="weight")
    return PipelineModel(stages=[*fitted.stages, fit_learner(estimator, rows)])


MEASURES = ["accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc", "roc_auc", "pr_auc", "brier"]
ERRORS = ["mae", "mse", "rmse", "r2", "wape", "mape", "median_absolute_error"]


def _figures(row, names: Sequence[str]) -> dict[str, float | None]:
    return {n: None if row[n] is None else float(row[n]) for n in names}


def _run_table(spark, runs: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(
        list(runs),
        "algorithm string, train map<string,double>, validation map<string,double>, test map<string,double>, split map<string,bigint>, method string",
    )


def classification_figures(model: PipelineModel, df: DataFrame, label: str) -> dict[str, float | None]:
    scored = positive_probability(model.transform(df)).select(label, "probability")
    return _figures(metrics.classification(scored, label, "probability").first(), MEASURES)


def train_payment_models(
    df: DataFrame, algorithms: Sequence[str], target: str = "default_next_month", features: Sequence[str] | None = None, row_id: str = "row_id",
    overrides: Mapping | None = None, with_train_figures: bool = False, history: bool = True,
) -> Training:
    """History features, outcome, screening, split, fit and figures per algorithm. [M1-M3, M6, M12]

    Dated data is split in time order, other data by class. The best model has the highest
    validation PR-AUC, then F1.
    """
    requested = list(features or df.columns)
    if history and find_column(df, POSTING_NAMES):
        df = add_training_history(df, row_id)
        requested += [f for f in HISTORY_FEATURES if f not in requested]
    labelled = known_outcomes(df, find_column(df, DUE_NAMES), find_column(df, CLEAR_NAMES), target if target in df.columns else None)
    # Counts, screening and the split each pass over the rows; the windows of the history are computed once.
    labelled = materialize(labelled, "labelled")
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}  # two classes
    if sum(counts.values()) < 100 or len(counts) != 2 or min(counts.values()) < 20:
        raise ValueError("Training needs 100 labelled rows, two classes, and 20 rows of each.")
    usable, removed = screen_features(labelled, requested, target, row_id)
    usable = [c for c in usable if c != "y"]
    if not usable:
        raise ValueError("Screening left no column to train on.")
    posting, method = find_column(labelled, POSTING_NAMES), "stratified"
    if posting:
        facts = labelled.agg(F.avg(F.col(posting).isNotNull().cast("double")).alias("share"), F.count_distinct(posting).alias("days")).first()
        method = "chronological" if facts["share"] >= 0.7 and facts["days"] >= 10 else "stratified"
    parted = split_by_position(labelled, posting, row_id) if method == "chronological" else split_stratified(labelled, "y", [row_id])
    parted = parted.select(row_id, *usable, "y", "split")
    # Every fit and evaluation reads the split rows many times, so they are written once.
    parted = materialize(parted, "training")
    parts = {n: parted.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}
    sizes = {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()}
    numeric, categorical = split_kinds(parted, usable)
    runs, models = [], {}
    prepared = prepare_vectors(parts["train"], preparation(parts["train"], numeric, categorical), ["y"])
    for name in algorithms:
        models[name] = fit_prepared(*prepared, "y", name, overrides)
        figures = {n: classification_figures(models[name], p, "y") for n, p in parts.items() if n != "train" or with_train_figures}
        runs.append((name, figures.get("train"), figures["validation"], figures["test"], sizes, method))
    best = max(runs, key=lambda r: (r[2]["pr_auc"] if r[2]["pr_auc"] is not None else -1, r[2]["f1"] or -1))[0]
    return Training(_run_table(df.sparkSession, runs), models, best, usable, removed)


CREDIT_MODELS = {"baseline": "Logistic Regression", "boosted": "Gradient Boosting"}


def train_credit_models(df: DataFrame, kinds: Sequence[str] = tuple(CREDIT_MODELS), overrides: Mapping | None = None) -> dict[str, PipelineModel]:
    """Credit-behaviour classifiers over 22 raw and 9 derived features, all on the same prepared vectors. [M7]"""
    for kind in kinds:
        if kind not in CREDIT_MODELS:
            raise ValueError(f"Unknown kind of credit model {kind!r}; use baseline or boosted.")
    features = [*CREDIT_FEATURES, *CREDIT_ENGINEERED]
    labelled = add_credit_behaviour(df.where(F.col(CREDIT_TARGET).isNotNull())).withColumn("y", F.col(CREDIT_TARGET).cast("int"))
    # Medians, spreads and vectors each pass over the rows, so they are written once.
    train = materialize(labelled.select("y", *features), "credit")
    prepared = prepare_vectors(train, preparation(train, features, []), ["y"])
    return {kind: fit_prepared(*prepared, "y", CREDIT_MODELS[kind], overrides) for kind in kinds}


def train_credit_model(df: DataFrame, kind: str = "baseline", overrides: Mapping | None = None) -> PipelineModel:
    """One of ``train_credit_models``. [M7]"""
    return train_credit_models(df, [kind], overrides)[kind]


def score_credit_model(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``probability`` of default. [M7, M18]"""
    return positive_probability(model.transform(add_credit_behaviour(df))).select(*df.columns, "probability")


def train_loan_model(df: DataFrame, overrides: Mapping | None = None) -> PipelineModel:
    """Loan-default classifier on the loan contract. [M8]"""
    return _fit_loans(_stored_loans(df), overrides)


def score_trained_loans(df: DataFrame, overrides: Mapping | None = None) -> DataFrame:
    """``probability`` of default of the rows that train the loan classifier. [M8]"""
    rows = _stored_loans(df)
    return positive_probability(_fit_loans(rows, overrides).transform(rows)).select(*df.columns, "probability")


def _stored_loans(df: DataFrame) -> DataFrame:
    """Loan rows are parsed from text; several passes follow, so they are written once."""
    return materialize(df.withColumn("y", F.col("Default")), "loans")


def _fit_loans(rows: DataFrame, overrides: Mapping | None) -> PipelineModel:
    return fit_classifier(rows, "y", LOAN_NUMERIC, LOAN_CATEGORICAL, "Gradient Boosting", overrides, min_frequency=1, balanced=True)


#: Thresholds at which the models' decisions are judged.
CREDIT_THRESHOLD, LOAN_THRESHOLD = 0.50, 0.25


def evaluate_at(scored: DataFrame, label: str, threshold: float) -> DataFrame:
    """All measures of scored rows at a model's own threshold, one row. [M7, M8, A1-A4]"""
    return metrics.classification(scored.select(F.col(label).cast("int").alias(label), "probability"), label, "probability", threshold).withColumn("threshold", F.lit(threshold))


DEMAND_CATEGORIES = ("store_id", "product_id", "category", "region")
SHORT_INPUTS = ["dow", "month", *[f"lag_{k}" for k in SHORT_LAGS]]
LONG_INPUTS = ["day_of_week", "month", "day_of_year", "is_weekend", *[f"lag_{k}" for k in LONG_LAGS], *[f"roll_{m}_{w}" for w in ROLLING for m in ("mean", "std")]]


def train_demand_models(
    df: DataFrame, algorithms: Sequence[str], target: str = "units_sold", categorical: Sequence[str] | None = None,
    numeric: Sequence[str] = ("inventory_level", "price"), overrides: Mapping | None = None, with_train_figures: bool = False, long: bool = False,
) -> Training:
    """Demand regressors over lags and calendar parts, split by date; the best has the least validation WAPE. [M4, M9-M12]

    ``long`` takes the features up to 30 rows back with rolling means and deviations. ``categorical`` are by default the columns
    of ``DEMAND_CATEGORIES`` that the table has.
    """
    categorical = [c for c in DEMAND_CATEGORIES if c in df.columns] if categorical is None else list(categorical)
    # Daily rows are summed from far more lines; the list of days and the features both read them.
    df = materialize(df, "demand")
    featured = split_by_dates((add_long_features if long else add_short_features)(df, target), "date")
    inputs = [*numeric, *(LONG_INPUTS if long else SHORT_INPUTS)]
    parted = materialize(featured.select("split", target, *categorical, *inputs), "training")
    parts = {n: parted.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test")}
    sizes = {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()}
    stages = preparation(parts["train"], inputs, categorical, min_frequency=2, max_levels=DEMAND_LEVELS, unknown_as_infrequent=True, scale=False)
    fitted, vectors = prepare_vectors(parts["train"], stages, [target])

    def fit(name: str) -> tuple[PipelineModel, tuple]:
        # The penalty of the mean squared error that equals one of the summed squared error.
        settings = {**({"regParam": RIDGE_ALPHA / max(sizes.get("train", 1), 1)} if name == "Ridge" else {}), **(overrides or {})}
        estimator = _estimator(REGRESSORS, name, settings, featuresCol="features", labelCol=target)
        model = PipelineModel(stages=[*fitted.stages, fit_learner(estimator, vectors)])
        figures = {}
        for part, rows in parts.items():
            if part != "train" or with_train_figures:
                predicted = model.transform(rows).select(target, "prediction")
                figures[part] = _figures(metrics.regression(predicted, target, "prediction").first(), ERRORS)
        return model, (name, figures.get("train"), figures["validation"], figures["test"], sizes, "chronological")

    # The calendar bounds the rows, so one algorithm fills a few cores only: all are fitted at the same time.
    with ThreadPool(max(1, len(algorithms))) as pool:
        done = pool.map(inheritable_thread_target(df.sparkSession)(fit), algorithms)
    runs, models = [r for _, r in done], {r[0]: m for m, r in done}
    best = min(runs, key=lambda r: math.inf if r[2]["wape"] is None else r[2]["wape"])[0]
    return Training(_run_table(df.sparkSession, runs), models, best, [*categorical, *inputs])


# ---------------------------------------------------------------------------
# Augmentation [M16, M17]
# ---------------------------------------------------------------------------

NONNEGATIVE = ["LIMIT_BAL", *[f"BILL_AMT{i}" for i in range(1, 7)], *[f"PAY_AMT{i}" for i in range(1, 7)]]
DISCRETE = [*PAY_STATUS, "EDUCATION", "MARRIAGE"]


def _normal(keys: Sequence[Column], seed: int) -> Column:
    """A standard normal number that depends on the keys only, so a recomputed task repeats it."""
    u1 = (order_key(keys, seed) + 1).cast("double") / float(HASH_RANGE + 1)
    u2 = order_key(keys, seed + 1).cast("double") / float(HASH_RANGE)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def augment_minority(
    df: DataFrame, row_id: str, label: str = CREDIT_TARGET, target_ratio: float = 0.75, jitter: float = 0.025, seed: int = SEED
) -> tuple[DataFrame, dict]:
    """Copies of minority rows with mild noise, up to ``target_ratio`` of the majority. [M16]

    Copies are dealt evenly over the minority rows in a seeded order. Discrete columns and the
    label are kept, amounts stay at or above 0.
    """
    if not 0 < target_ratio <= 1 or not 0 <= jitter <= 0.15:
        raise ValueError("target_ratio must be in (0, 1] and jitter between 0 and 0.15.")
    continuous = [c for c in CREDIT_FEATURES if c in df.columns and c not in DISCRETE]
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # two classes
    minority, majority = min(counts, key=lambda k: (counts[k], k)), max(counts, key=lambda k: (counts[k], -k))
    needed = max(0, int(counts[majority] * target_ratio) - counts[minority])
    facts = {"original_rows": sum(counts.values()), "synthetic_rows": needed, "minority_class": minority}
    if needed == 0:
        return df.withColumn("is_synthetic", F.lit(False)), facts
    scales = df.agg(*[F.coalesce(F.stddev_samp(as_double(df, c)), F.lit(0.0)).alias(c) for c in continuous]).first()
    rows = df.where(F.col(label) == minority).withColumn("_hash", order_key([F.col(row_id)], seed))
    ranked = add_prior_sums(rows, [], [F.col("_hash"), F.col(row_id)], {"_rank": F.lit(1.0)})
    size = counts[minority]
    copies = F.lit(needed // size) + F.when(F.col("_rank") < needed % size, 1).otherwise(0)
    drawn = ranked.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    noisy = {}
    for position, c in enumerate(continuous):
        spread = max(float(scales[c]) * jitter, 1e-9)
        value = as_double(df, c) + spread * _normal([F.col(row_id), F.col("_copy")], seed + 2 * position + 1)
        noisy[c] = F.greatest(value, F.lit(0.0)) if c in NONNEGATIVE else value
    number = (F.col("_copy") - 1) * size + F.col("_rank") + 1
    names = {"client_id": F.concat(F.lit("AUG_"), F.lpad(number.cast("bigint").cast("string"), 7, "0"))} if "client_id" in df.columns else {}
    kinds = dict(df.dtypes)
    synthetic = drawn.withColumns({**noisy, **names}).withColumn(row_id, F.lit(None).cast(kinds[row_id]))
    base = df.withColumns({c: as_double(df, c) for c in continuous})
    return base.withColumn("is_synthetic", F.lit(False)).unionByName(
        synthetic.select(*df.columns).withColumn("is_synthetic", F.lit(True))
    ), facts


def compare_augmentation(df: DataFrame, row_id: str, kind: str = "baseline", overrides: Mapping | None = None, target_ratio: float = 0.75) -> DataFrame:
    """Figures without and with augmentation on the same holdout, and the recommendation. [M2, M17]"""
    labelled = materialize(df.where(F.col(CREDIT_TARGET).isNotNull()), "labelled")
    parted = materialize(split_stratified(labelled, CREDIT_TARGET, [row_id], cuts=(0.8,), names=("train", "test")), "training")
    train, test = (parted.where(F.col("split") == n).drop("split") for n in ("train", "test"))
    enlarged = materialize(augment_minority(train, row_id, target_ratio=target_ratio)[0], "augmented")
    figures = []
    for rows in (train, enlarged):
        model = train_credit_model(rows, kind, overrides)
        scored = score_credit_model(model, test).withColumn("y", F.col(CREDIT_TARGET))
        figures.append(_figures(metrics.classification(scored, "y", "probability").first(), MEASURES))
    return augmentation_decision(df.sparkSession.createDataFrame([tuple(figures)], "before map<string,double>, after map<string,double>"))


def augmentation_decision(pairs: DataFrame) -> DataFrame:
    """Accepts augmentation when PR-AUC, ROC-AUC and Brier improve together and recall holds. [M17]"""
    def change(name: str) -> Column:
        return F.col("after")[name] - F.col("before")[name]

    score = 2 * change("pr_auc") + change("roc_auc") - 0.5 * change("brier")
    accepted = (score > 0) & (F.col("after")["recall"] >= F.col("before")["recall"] - 0.02)
    return pairs.withColumns({"decision_score": F.round(score, 5), "recommended": F.when(accepted, "augmented").otherwise("baseline")})


# ---------------------------------------------------------------------------
# Importance [A21]
# ---------------------------------------------------------------------------


def permutation_importance(
    df: DataFrame, label: str, row_id: str, features: Sequence[str], score, repeats: int = 3, seed: int = SEED, rows_per_bucket: int = 100_000
) -> DataFrame:
    """Loss of average precision when one feature is shuffled, mean over the repeats. [A21]

    Rows are dealt into buckets by a seeded hash and each value moves to the next row of its
    bucket, a random permutation without a global sort. ``score`` adds ``probability``; all
    shuffled copies are scored in one pass.
    """
    buckets = max(1, df.count() // rows_per_bucket)
    copies = None
    for repeat in range(repeats):
        order = order_key([F.col(row_id)], seed + repeat)
        keyed = df.withColumn("_order", order).withColumn("_bucket", F.col("_order") % buckets)
        ring = Window.partitionBy("_bucket").orderBy("_order", row_id)
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        moved = keyed.withColumns({f"_m_{f}": F.struct(F.lag(F.struct(f)).over(ring).alias("p"), F.last(F.struct(f)).over(whole).alias("l")) for f in features})
        number = F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))
        spread = moved.withColumn("_changed", number)
        taken = {
            f: F.when(F.col("_changed") == i, F.coalesce(F.col(f"_m_{f}.p"), F.col(f"_m_{f}.l"))[f]).otherwise(F.col(f)) for i, f in enumerate(features)
        }
        part = spread.select(label, "_changed", F.lit(repeat).alias("_repeat"), *[c.alias(f) for f, c in taken.items()])
        copies = part if copies is None else copies.unionByName(part)
    base = metrics.ranking_quality(score(df.select(label, *features)), label, "probability").select("pr_auc").scalar()
    quality = metrics.ranking_quality(score(copies), label, "probability", by=["_changed", "_repeat"])
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_changed") + 1)
    loss = quality.withColumn("_loss", base - F.col("pr_auc")).groupBy(name.alias("feature")).agg(F.avg("_loss").alias("importance"))
    return top_importance(loss, len(features))


def model_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Importances a tree model carries, by feature name. [A21]"""
    encoder = next(s for s in model.stages if isinstance(s, LevelEncoderModel))
    values = model.stages[-1].featureImportances
    weights = dict(zip(values.indices.tolist(), values.values.tolist(), strict=True)) if hasattr(values, "indices") else dict(enumerate(values.toArray().tolist()))
    held = df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in weights.items()], "index int, importance double")
    return encoder.feature_names(df.sparkSession).join(held, "index", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def top_importance(importance: DataFrame, top_k: int = 10) -> DataFrame:
    """The strongest features by magnitude, with their direction. [A21]"""
    direction = F.when(F.col("importance") >= 0, "increases predictive signal").otherwise("reduces predictive signal")
    return importance.withColumn("direction", direction).orderBy(F.desc(F.abs("importance")), "feature").limit(top_k)
