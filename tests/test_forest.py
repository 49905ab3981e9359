"""Forests grown from rows dealt to their nodes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from duecast.operators import forest, learn, metrics


@pytest.fixture(scope="module")
def rows(spark):
    share = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(6)]
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, share[0]).otherwise(0.0).alias("a"), share[1].alias("b"), F.round(share[2], 1).alias("c"), share[3].alias("noise"), share[4].alias("draw"))
    y = (F.col("a") + F.col("b") * F.col("c") + 0.5 * F.col("draw") > 0.9).cast("int")
    df = df.select("id", array_to_vector(F.array("a", "b", "c", "noise")).alias("features"), y.alias("y"))
    return learn.materialize(learn.add_class_weight(df, "y"), "rows")


def _forest(**settings):
    return learn._estimator(learn.CLASSIFIERS, "Random Forest", {"numTrees": 12, "maxDepth": 8, **settings}, featuresCol="features", labelCol="y", weightCol="weight")


def _scores(model, df):
    return {r["id"]: r["probability"] for r in learn.positive_probability(model.transform(df)).select("id", "probability").collect()}


def test_trees_are_the_same_wherever_their_nodes_are_grown(rows, monkeypatch):
    """large nodes are split from histograms of all tasks, small ones where their rows are."""
    whole = forest.fit(_forest(), rows)
    parted = forest.fit(_forest(), rows, task_rows=300)
    assert _scores(whole, rows) == _scores(parted, rows)
    assert whole.featureImportances.toArray() == pytest.approx(parted.featureImportances.toArray())
    monkeypatch.setattr(forest, "BLOCK_BYTES", 1)
    assert _scores(forest.fit(_forest(), rows), rows) == _scores(whole, rows)


def test_the_forest_is_as_good_as_that_of_mllib(rows):
    """same bootstrap, candidates, impurity, least rows of a leaf and class weights; only the random draws differ."""
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    models = [forest.fit(_forest(numTrees=40), train), learn.fit_learner(_forest(numTrees=40), train)]
    own, other = (metrics.classification(learn.positive_probability(m.transform(test)).select("y", "probability"), "y", "probability").first() for m in models)
    assert own["roc_auc"] > 0.85 and all(abs(own[n] - other[n]) < 0.02 for n in ("roc_auc", "pr_auc", "brier", "balanced_accuracy"))
    assert models[0].featureImportances.toArray() == pytest.approx(models[1].featureImportances.toArray(), abs=0.06)
    made = models[0].transform(test)
    assert made.columns == [*test.columns, "rawPrediction", "probability", "prediction"] == models[1].transform(test).columns
    r = made.first()
    assert r.rawPrediction.toArray() == pytest.approx(40 * r.probability.toArray()) and r.prediction == float(r.probability[1] > 0.5)


def test_one_tree_by_hand(spark):
    """Limits lie between values, leaves of the same decision are one, and shares are weighted by class."""
    grower = forest._Grower([[0.5], [0.5, 1.5]], 1, 3, 1, 7, (1.0, 3.0))
    grower.tried, grower.top, grower.open = 2, {0: {}}, {0: {1: None}}
    cells = [(0, 0, 0)] * 4 + [(1, 0, 0)] * 3 + [(1, 1, 0)] * 2 + [(1, 1, 1)] + [(1, 2, 1)] * 4
    packed = np.array(cells, np.uint8)
    nodes = grower._below(0, 1, packed, np.ones(len(cells), np.uint8))
    by_id = {int(n["id"]): n for n in nodes}
    assert (by_id[1]["feature"], by_id[1]["bin"], by_id[1]["n0"], by_id[1]["n1"]) == (1, 0, 9, 5)
    assert (by_id[3]["feature"], by_id[3]["bin"]) == (1, 1) and (by_id[6]["n0"], by_id[6]["n1"], by_id[7]["n0"], by_id[7]["n1"]) == (2, 1, 0, 4)
    table = forest.pa.table({"nodes": forest.pa.array([nodes.tobytes()], forest.pa.binary())})
    tree = grower.assemble((forest.pa.scalar(0, forest.pa.int32()),), table)
    # 3 of 5 by weight in the left child of the right side: it decides like its sibling, so both are one leaf.
    assert forest._mean_share(np.array([[0, 0], [1, 1], [1, 2]]), [tree["nodes"][0].as_py()]) == pytest.approx([0.0, 15 / 17, 15 / 17])


def test_trees_of_one_leaf(spark):
    """a large root that no feature splits is a tree as well."""
    df = learn.materialize(learn.add_class_weight(spark.range(900).select("id", array_to_vector(F.array(F.lit(1.0))).alias("features"), (F.col("id") % 3 == 0).cast("int").alias("y")), "y"), "rows")
    for task_rows in (10_000, 100):
        model = forest.fit(_forest(), df, task_rows=task_rows)
        assert model.stored.count() == 12 and not model.featureImportances.toArray().any()
        assert set(np.round(list(_scores(model, df).values()), 1)) == {0.5}


def test_deep_forests_leave_mllib(spark, rows):
    """140 trees of depth 18 took many passes a level; shallow ones, other settings and more classes stay there."""
    assert forest.outgrows_mllib(_forest(numTrees=2000, maxDepth=18), rows)
    assert not forest.outgrows_mllib(_forest(), rows)
    assert not forest.outgrows_mllib(_forest(numTrees=2000, maxDepth=18, impurity="entropy"), rows)
    assert not forest.outgrows_mllib(_forest(numTrees=2000, maxDepth=18), rows.withColumn("y", F.lit(2)))
    assert not forest.outgrows_mllib(_forest(numTrees=2000, maxDepth=18), rows.limit(0))
    trained = learn.fit_learner(_forest(numTrees=150, maxDepth=18, minInstancesPerNode=1), rows.repartition(3))
    assert isinstance(trained, forest.ForestModel) and not trained.hasSummary


def test_limits_of_bins(spark):
    """Few values have a limit between any two; a value that most rows share takes one limit only."""
    df = spark.range(10_000).select(F.array((F.col("id") % 2).cast("double"), F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id") / 1.0), F.lit(4.0), F.col("id") / 1.0).alias("x"))
    found = forest.cuts(df, 4, 32)
    assert found[0] == [0.5] and found[2] == []
    assert found[1][0] == 0.0 and len(found[1]) > 20 and found[1] == sorted(set(found[1]))
    assert len(found[3]) == 31 and max(abs(b - a - 312.5) for a, b in zip(found[3], found[3][1:])) < 60
