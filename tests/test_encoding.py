"""The table of levels behind model inputs."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from duecast.operators import learn, profile
from duecast.operators.encoding import LevelEncoder


@pytest.fixture(scope="module")
def rows(spark):
    cells = [("a", 1.0)] * 8 + [("b", 2.0)] * 6 + [("c", None)] + [("it's \\ \"odd\"", 4.0)] * 2 + [(None, float("nan"))]
    return spark.createDataFrame(cells, "c string, n double").withColumn("empty", F.lit(None).cast("string")).withColumn("value", F.lit("x"))


def _vectors(model, df):
    return [r.features.toArray().tolist() for r in model.transform(df).collect()]


@pytest.mark.parametrize("rows_per_task", [10**9, 2])
def test_levels_by_frequency(spark, rows, rows_per_task):
    model = LevelEncoder(["n"], ["c", "empty"], min_frequency=2, scale=False, rows_per_task=rows_per_task).fit(rows)
    assert model.width == 1 + 4 and set(model.columns) == {"c"}
    new = spark.createDataFrame([("a", 1.0), ("it's \\ \"odd\"", None), ("c", 3.0), ("unseen", 3.0), (None, 3.0)], "c string, n double").withColumn("empty", F.lit("z")).coalesce(1)
    got = sorted(_vectors(model, new))
    assert got == sorted([[1, 1, 0, 0, 0], [1.5, 0, 0, 1, 0], [3, 0, 0, 0, 1], [3, 0, 0, 0, 0], [3, 1, 0, 0, 0]])
    names = {r["index"]: r["feature"] for r in model.feature_names(spark).collect()}
    assert names == {0: "n", 1: "c_a", 2: "c_b", 3: "c_it's \\ \"odd\"", 4: "c_infrequent"}


def test_unseen_levels_share_where_asked(spark, rows):
    new = spark.createDataFrame([("unseen", 1.0), ("c", 1.0)], "c string, n double")
    model = LevelEncoder([], ["c"], min_frequency=2, unknown_as_infrequent=True).fit(rows)
    assert _vectors(model, new) == [[0, 0, 0, 1]] * 2
    assert model.levels(spark).where("not frequent").isEmpty()  # rare levels need no row then
    cut = LevelEncoder([], ["c"], min_frequency=1, max_levels=2).fit(rows)
    assert _vectors(cut, new) == [[0, 1]] * 2 and cut.width == 2


def test_numbers_are_filled_and_scaled(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, 5), (float("nan"), 5)], "x double, same int")
    model = LevelEncoder(["x", "same"], []).fit(df)
    deviation = df.select(F.stddev_samp(F.coalesce(F.nanvl("x", F.lit(None)), F.lit(2.0)))).first()[0]
    got = sorted(_vectors(model, df))
    assert [g[0] for g in got] == pytest.approx([x / deviation for x in (1, 2, 2, 3)]) and {g[1] for g in got} == {0.0}


def test_empty_tables_have_no_levels(spark, rows):
    model = LevelEncoder(["n"], ["c"]).fit(rows.limit(0))
    assert _vectors(model, rows.limit(1)) == [[0.0]] and model.feature_names(spark).count() == 1


def test_a_million_titles(spark):
    """Levels stay on Spark: nothing of their number is in the model, its plan or the schema, and a learner fits."""
    titles = 1_000_000
    df = spark.range(titles).select(F.concat(F.lit("title "), "id").alias("title"), (F.col("id") % 97).cast("double").alias("n"), (F.col("id") % 2).cast("double").alias("y"))
    fitted, vectors = learn.prepare_vectors(df, learn.preparation(df, ["n"], ["title"], min_frequency=1), ["y"])
    model = fitted.stages[0]
    assert model.width == titles + 1
    few = learn.preparation(df.limit(20), ["n"], ["title"], min_frequency=1)[0].fit(df.limit(20))
    plans = [len(m.transform(df)._jdf.queryExecution().analyzed().toString()) for m in (model, few)]
    assert abs(plans[0] - plans[1]) < 200 and len(str(vars(model))) < 1500
    assert len(model.transform(df).schema.json()) < 1000
    learner = LogisticRegression(labelCol="y", maxIter=1, regParam=0.1).fit(vectors)
    assert learner.coefficients.size == titles + 1
    assert model.transform(df).select(F.col("title")).distinct().count() == titles


def test_a_pipeline_takes_the_encoder(spark, rows):
    df = rows.withColumn("y", (F.col("n") > 1.5).cast("double")).na.fill({"y": 0.0})
    model = Pipeline(stages=[*learn.preparation(df, ["n"], ["c"]), LogisticRegression(labelCol="y", maxIter=3)]).fit(df)
    assert model.transform(df).where("prediction is null").isEmpty()


def test_a_crowded_category_is_not_encoded(spark):
    """A table with more levels than its profile said sends max_levels + 1 of them to the driver, and stays one column."""
    df = spark.range(500).select(F.col("id").cast("string").alias("kind"), (F.col("id") % 3).cast("string").alias("small"), F.col("id").alias("y"))
    roles = spark.createDataFrame([(0, "kind", "categorical", "feature", ""), (1, "small", "categorical", "feature", ""), (2, "y", "integer", "target", "")], "position int, column_name string, kind string, role string, reason string")
    assert profile.preprocess(df, roles).columns == ["kind", "small_0", "small_1", "small_2", "y"]
