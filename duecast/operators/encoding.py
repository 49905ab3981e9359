"""Model inputs from a table of levels: numbers filled and scaled, categories as indicators.

The levels of all categorical columns are one Parquet table (column, value, slot) in the shared folder. Levels are
ranked by how often they occur, on Spark, and rows find their slot by a join on the value: a broadcast while a
column's part of the table is small, a shuffle join beyond. The driver holds a few numbers per column, never a level.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from duecast.operators.quantiles import exact_medians, value_counts
from duecast.operators.skew import ROWS_PER_TASK, add_prior_sums
from duecast.session import materialize, scratch_path

INFREQUENT = "infrequent"
#: Vectors up to this width are written out cell by cell, wider ones as places and values.
DENSE_WIDTH = 100
_BOXED = StructType([StructField("v", VectorUDT())])


class LevelEncoder(Estimator):
    """Medians and scales of numbers, and the table of levels. [M5]

    Levels seen fewer than ``min_frequency`` times, or beyond the ``max_levels`` most frequent where that is given, share
    one indicator. A missing category counts as the most frequent level. A level not seen in training has no indicator, or
    the shared one with ``unknown_as_infrequent`` or where levels were cut off. Columns without any value have no indicators.
    """

    def __init__(
        self, numeric: Sequence[str], categorical: Sequence[str], min_frequency: int = 5, max_levels: int | None = None, unknown_as_infrequent: bool = False,
        scale: bool = True, output: str = "features", rows_per_task: int = ROWS_PER_TASK,
    ):
        super().__init__()
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.min_frequency, self.max_levels, self.unknown_as_infrequent = min_frequency, max_levels, unknown_as_infrequent
        self.scale, self.output, self.rows_per_task = scale, output, rows_per_task

    def _fit(self, df: DataFrame) -> LevelEncoderModel:
        numbers = df.select(*[_number(c).alias(c) for c in self.numeric])
        medians = {c: m or 0.0 for c, m in exact_medians(numbers, self.numeric).items()} if self.numeric else {}
        factors = dict.fromkeys(self.numeric, 1.0)
        if self.numeric and self.scale:
            spread = numbers.agg(*[F.stddev_samp(F.coalesce(F.col(c), F.lit(medians[c]))).alias(c) for c in self.numeric]).first()
            factors = {c: 1.0 / spread[c] if spread[c] and math.isfinite(spread[c]) else 0.0 for c in self.numeric}
        path = scratch_path(df.sparkSession, "levels")
        columns = self._write_levels(df, path) if self.categorical else {}
        return LevelEncoderModel(self.numeric, medians, factors, columns, path, self.output)

    def _write_levels(self, df: DataFrame, path: str) -> dict[str, tuple[int, int, bool]]:
        """Per column with a value: (number of the column, indicators, whether a level not in the table takes the last one)."""
        number = F.element_at(F.create_map(*[x for i, c in enumerate(self.categorical) for x in (F.lit(c), F.lit(i))]), F.col("column_name"))
        counts = materialize(value_counts(df, self.categorical).select(number.alias("column_no"), "value", "count"), "level-counts")
        ranked = add_prior_sums(counts, ["column_no"], [F.desc("count"), F.col("value")], {"rank": F.lit(1.0)}, self.rows_per_task)
        sizes = counts.groupBy("column_no").agg(F.count("*").alias("levels")).collect()  # one row per column
        sizes = {r["column_no"]: r["levels"] for r in sizes}
        limit = {i: self.max_levels - 1 if self.max_levels is not None and n > self.max_levels else n for i, n in sizes.items()}
        kept = F.element_at(F.create_map(*[x for i, n in limit.items() for x in (F.lit(i), F.lit(n))]), F.col("column_no")) if limit else F.lit(0)
        frequent = (F.col("rank") < kept) & (F.col("count") >= self.min_frequency)
        ranked = materialize(ranked.withColumn("frequent", frequent), "level-ranks")
        found = {r["column_no"]: r["n"] for r in ranked.groupBy("column_no").agg(F.count_if("frequent").alias("n")).collect()}  # one row per column
        if not found:
            return {}
        shared = F.element_at(F.create_map(*[x for i, n in found.items() for x in (F.lit(i), F.lit(n))]), F.col("column_no"))
        # Where a level that is not in the table takes the shared indicator anyway, rare levels need no row.
        open_ended = {i: n < sizes[i] and (self.unknown_as_infrequent or limit[i] < sizes[i]) for i, n in found.items()}
        needed = F.col("frequent") | ~F.col("column_no").isin([i for i, is_open in open_ended.items() if is_open])
        table = ranked.where(needed).select("column_no", "value", F.when(F.col("frequent"), F.col("rank").cast("int")).otherwise(shared).alias("slot"), "count", "frequent")
        table.repartition("column_no", F.xxhash64("value") % 16).write.partitionBy("column_no").parquet(path)
        return {self.categorical[i]: (i, n + int(n < sizes[i]), open_ended[i]) for i, n in sorted(found.items())}


class LevelEncoderModel(Model):
    """Adds the vector column; other columns stay."""

    def __init__(self, numeric: Sequence[str], medians: dict, factors: dict, columns: dict[str, tuple[int, int, bool]], path: str, output: str):
        super().__init__()
        self.numeric, self.medians, self.factors, self.columns, self.path, self.output = list(numeric), medians, factors, columns, path, output

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(n for _, n, _ in self.columns.values())

    def levels(self, spark) -> DataFrame:
        """(column_no, value, slot, count, frequent) of every stored level."""
        return spark.read.schema("value string, slot int, count bigint, frequent boolean, column_no int").parquet(self.path)

    def number(self, column: str) -> Column:
        """A number as the model sees it."""
        return F.coalesce(_number(column), F.lit(self.medians[column])) * F.lit(self.factors[column])

    def with_slots(self, df: DataFrame) -> DataFrame:
        """``__slot_<n>`` per categorical column: the indicator of the row's level, null where it has none."""
        for column, (number, width, is_open) in self.columns.items():
            level, value, slot = f"__level_{number}", f"__value_{number}", f"__slot_{number}"
            table = self.levels(df.sparkSession).where(F.col("column_no") == number).select(F.col("value").alias(value), F.col("slot").alias(level))
            cell = F.col(f"`{column}`").cast("string")
            other = F.lit(width - 1 if is_open else None).cast("int")
            df = df.join(table, cell == F.col(value), "left").withColumn(slot, F.when(cell.isNull(), 0).otherwise(F.coalesce(level, other))).drop(level, value)
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        numbers = [self.number(c) for c in self.numeric]
        if not self.columns:
            return df.withColumn(self.output, array_to_vector(F.array(*numbers).cast("array<double>")))
        if self.width <= DENSE_WIDTH:
            cells = [_indicators(F.col(f"__slot_{number}"), width) for number, width, _ in self.columns.values() if width]
            vector = array_to_vector(F.concat(F.array(*numbers).cast("array<double>"), *cells))
            return self.with_slots(df).withColumn(self.output, vector).drop(*[f"__slot_{number}" for number, _, _ in self.columns.values()])
        offset, places, slots = len(self.numeric), [], []
        for number, width, _ in self.columns.values():
            slots.append(f"__slot_{number}")
            places.append(F.col(slots[-1]) + offset)
            offset += width
        places = F.array_compact(F.array(*places))
        known = F.array(*[F.lit(i) for i in range(len(self.numeric))]).cast("array<int>")
        values = F.concat(F.array(*numbers).cast("array<double>"), F.array_repeat(F.lit(1.0), F.size(places)))
        # A vector column read from its fields: no encoder with a name per level in the schema.
        fields = F.struct(F.lit(0).alias("type"), F.lit(self.width).alias("size"), F.concat(known, places).alias("indices"), values.alias("values"))
        boxed = F.from_json(F.to_json(F.struct(fields.alias("v"))), _BOXED)
        return self.with_slots(df).withColumn(self.output, boxed["v"]).drop(*slots)

    def feature_names(self, spark) -> DataFrame:
        """(index, feature): numbers by name, indicators as ``column_value``."""
        names = spark.createDataFrame([(i, c) for i, c in enumerate(self.numeric)], "index int, feature string")
        offset, parts = len(self.numeric), []
        for column, (number, width, _) in self.columns.items():
            parts.append((number, column, offset, width))
            offset += width
        if not parts:
            return names
        spans = spark.createDataFrame(parts, "column_no int, column_name string, offset int, width int")
        levels = self.levels(spark).where("frequent").join(F.broadcast(spans), "column_no")
        named = levels.select((F.col("offset") + F.col("slot")).alias("index"), F.concat_ws("_", "column_name", "value").alias("feature"))
        counted = levels.groupBy("column_no").agg(F.count("*").alias("n"))
        last = spans.join(counted, "column_no", "left").where(F.coalesce("n", F.lit(0)) < F.col("width"))
        return names.unionByName(named).unionByName(last.select((F.col("offset") + F.col("width") - 1).alias("index"), F.concat_ws("_", "column_name", F.lit(INFREQUENT)).alias("feature")))


def _indicators(slot: Column, width: int) -> Column:
    """1 at the slot and 0 elsewhere, in a plan of the same length for every width."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == slot, 1.0).otherwise(0.0))


def _number(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)
