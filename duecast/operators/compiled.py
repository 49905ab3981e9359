"""Fitted pipelines as Column expressions.

A linear model becomes a weighted sum, a tree ensemble a fold over its node tables that every row walks by itself. The
expression can stand inside other expressions: a recursive projection is one fold per series, and a row's drivers are
found inside the row, without a ``transform`` per step and without copies of rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.operators.encoding import LevelEncoderModel
from duecast.session import scratch_path

LINEAR = (LinearRegressionModel, LogisticRegressionModel)
BOOSTED = (GBTClassificationModel, GBTRegressionModel)
FORESTS = (RandomForestClassificationModel, RandomForestRegressionModel)
TREES = (DecisionTreeClassificationModel, DecisionTreeRegressionModel)
SHARES = (RandomForestClassificationModel, DecisionTreeClassificationModel)

_TREE = "array<struct<weight:double,depth:int,feature:array<int>,limit:array<double>,left:array<int>,right:array<int>,value:array<double>>>"


def _literal(value, kind: str) -> Column:
    """A constant of any size from one text, folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class CompiledModel:
    """A pipeline of a preparation (encoder or assembler) and a learner. ``column`` is its prediction, or the probability of class 1."""

    def __init__(self, model: PipelineModel, spark):
        self.preparation, self.learner = model.stages
        self.spark = spark
        if isinstance(self.preparation, LevelEncoderModel):
            self.numeric, self.categorical = list(self.preparation.numeric), dict(self.preparation.columns)
        else:
            self.numeric, self.categorical = list(self.preparation.getInputCols()), {}
        if not isinstance(self.learner, LINEAR):
            self.trees = self._node_tables()

    @staticmethod
    def fits(model: PipelineModel) -> bool:
        """Whether the pipeline has a form known here; binary classifiers only."""
        stages = getattr(model, "stages", [])
        if len(stages) != 2 or not isinstance(stages[0], (LevelEncoderModel, VectorAssembler)) or not isinstance(stages[1], (*LINEAR, *BOOSTED, *FORESTS, *TREES)):
            return False
        return getattr(stages[1], "numClasses", 2) == 2

    def _node_tables(self) -> list[dict]:
        """The learner's nodes as it stores them: per tree its weight and, by node number, test, children and value."""
        path = scratch_path(self.spark, "model")
        self.learner.write().save(path)
        rows = self.spark.read.parquet(f"{path}/data")
        if "treeID" not in rows.columns:
            rows = rows.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
            weights = {0: 1.0}
        else:
            weights = {r[0]: r[2] for r in self.spark.read.parquet(f"{path}/treesMetadata").collect()}  # one row per tree
        trees: dict[int, dict[int, object]] = {}
        for r in rows.collect():  # the model itself, which the driver holds already
            trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
        shares = isinstance(self.learner, SHARES)
        scale = 1.0 / max(len(trees), 1) if isinstance(self.learner, FORESTS) else 1.0
        out = []
        for number, nodes in sorted(trees.items()):
            table = {"weight": scale if isinstance(self.learner, (*FORESTS, *TREES)) else weights[number], "depth": _depth(nodes), "feature": [], "limit": [], "left": [], "right": [], "value": []}
            for i in range(max(nodes) + 1):
                node = nodes[i]
                test, leaf = node["split"], node["leftChild"] < 0
                stats = node["impurityStats"]
                table["feature"].append(-1 if leaf else test["featureIndex"])
                table["limit"].append(0.0 if leaf else test["leftCategoriesOrThreshold"][0])
                table["left"].append(node["leftChild"])
                table["right"].append(node["rightChild"])
                table["value"].append((stats[1] / sum(stats) if sum(stats) else 0.0) if shares else node["prediction"])
            out.append(table)
        return out

    def with_slots(self, df: DataFrame) -> DataFrame:
        """The indicator of every categorical column, joined once; ``column`` reads them."""
        return self.preparation.with_slots(df) if self.categorical else df

    def slot_of(self, column: str, value: str | None) -> Column:
        """The indicator of one given level, as a constant."""
        number, _, _ = self.categorical[column]
        one = self.spark.createDataFrame([(value,)], f"`{column}` string")
        for other in self.categorical:
            if other != column:
                one = one.withColumn(other, F.lit(None).cast("string"))
        return F.lit(self.preparation.with_slots(one).first()[f"__slot_{number}"]).cast("int")

    def column(self, values: Mapping[str, Column] | None = None, slots: Mapping[str, Column] | None = None) -> Column:
        """The model's output where some inputs are the given expressions and all others are columns."""
        values, slots = values or {}, slots or {}
        numbers = [self._number(c, values.get(c)) for c in self.numeric]
        places = [slots.get(c, F.col(f"__slot_{n}")) for c, (n, _, _) in self.categorical.items()]
        if isinstance(self.learner, LINEAR):
            return self._linear(numbers, places)
        return self._walked(numbers, places)

    def output(self, usual: Mapping[str, float | str]) -> Callable[[Mapping[str, Column]], Column]:
        """``column`` for replacements by usual values, categories included: what ``scoring.drivers_in_row`` asks for."""
        fixed = {c: self.slot_of(c, usual[c]) for c in self.categorical if c in usual}
        return lambda values: self.column({c: v for c, v in values.items() if c not in fixed}, {c: fixed[c] for c in values if c in fixed})

    def _number(self, name: str, value: Column | None) -> Column:
        cell = (F.col(f"`{name}`") if value is None else value).cast("double")
        if not isinstance(self.preparation, LevelEncoderModel):
            return cell
        known = F.when(~F.isnan(cell), cell)
        return F.coalesce(known, F.lit(self.preparation.medians[name])) * F.lit(self.preparation.factors[name])

    def _linear(self, numbers: list[Column], places: list[Column]) -> Column:
        weights = [float(w) for w in self.learner.coefficients.toArray()]
        total = F.lit(float(self.learner.intercept))
        for weight, number in zip(weights, numbers, strict=False):
            total = total + F.lit(weight) * number
        offset = len(numbers)
        for place, (_, width, _) in zip(places, self.categorical.values(), strict=True):
            total = total + F.coalesce(F.get(_literal(weights[offset : offset + width], "array<double>"), place), F.lit(0.0))
            offset += width
        return 1.0 / (1.0 + F.exp(-total)) if isinstance(self.learner, LogisticRegressionModel) else total

    def _walked(self, numbers: list[Column], places: list[Column]) -> Column:
        inputs, offset, starts = F.array(*numbers).cast("array<double>"), len(numbers), []
        for _, width, _ in self.categorical.values():
            starts.append(offset)
            offset += width

        def input_value(feature: Column) -> Column:
            """A number, or 1 where the feature is the indicator of the row's level."""
            shown = F.lit(False)
            for start, place in zip(starts, places, strict=True):
                shown = shown | F.coalesce(feature == place + start, F.lit(False))
            return F.when(feature < len(numbers), F.get(inputs, feature)).otherwise(shown.cast("double"))

        def leaf(tree: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                feature = F.get(tree["feature"], node)
                return F.when(feature < 0, node).when(input_value(feature) <= F.get(tree["limit"], node), F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))

            return F.aggregate(F.sequence(F.lit(0), tree["depth"]), F.lit(0), step)

        total = F.aggregate(_literal(self.trees, _TREE), F.lit(0.0), lambda so_far, tree: so_far + tree["weight"] * F.get(tree["value"], leaf(tree)))
        return 1.0 / (1.0 + F.exp(-2.0 * total)) if isinstance(self.learner, GBTClassificationModel) else total


def _depth(nodes: dict) -> int:
    depth, level = 0, [0]
    while level := [c for i in level for c in (nodes[i]["leftChild"], nodes[i]["rightChild"]) if c >= 0]:
        depth += 1
    return depth
