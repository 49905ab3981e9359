"""Facts of many columns from one pass: counts, and distinct values by mergeable sketches first.

Every task turns its cells into (column, hash, conditions) rows and merges them at once into one row per column: counts and a
HyperLogLog sketch. Only those rows are shuffled. Distinct values are then counted exactly, over 128-bit hashes and never
over text, for columns whose estimate is at most ``EXACT`` or lies near a limit that a decision depends on; for the rest
the estimate stands.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values up to which a count is always exact.
EXACT = 1_000_000
#: An estimate this close to a limit, as a share of it, is replaced by an exact count: six standard errors of the sketch.
NEAR = 0.05
#: Text columns with at most so many values meet the conditions once per value, others once per cell.
FEW = 10_000
_LG_K = 14


@dataclass
class Facts:
    """One column: all rows, filled cells, distinct values, whether these are counted or estimated, and the measures asked for."""

    rows: int = 0
    filled: int = 0
    distinct: int = 0
    exact: bool = True
    measures: dict[str, float] = field(default_factory=dict)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def column_facts(
    df: DataFrame, columns: Sequence[str], flags: Callable[[Column, str], Mapping[str, Column]] | None = None, total: Callable[[Column], Column] | None = None,
    limits: Callable[[Facts], Sequence[float]] = lambda facts: (), exact_up_to: int | None = EXACT,
) -> dict[str, Facts]:
    """Facts per column; two jobs at most.

    ``flags`` gives conditions on a cell of a type, counted as the measures of their names; cells that are no whole or floating
    numbers, dates or truth values are met as text. ``total`` is a number of a cell's text, summed as ``total``. ``limits`` gives the
    distinct counts at which a column's treatment changes. With ``exact_up_to`` None all counts of distinct values are estimates.
    """
    kinds, place = dict(df.dtypes), {c: i for i, c in enumerate(columns)}
    text = [c for c in columns if flags is not None and kinds[c] not in (*WHOLE, "float", "double", "date", "timestamp", "timestamp_ntz", "boolean")]
    names = list(flags(F.lit(""), "string")) if flags else []

    def value(c: str) -> Column:
        return F.col(f"`{c}`").cast("string") if c in text else F.col(f"`{c}`")

    def marks(cell: Column, kind: str) -> Column:
        """One number holds all conditions, so that each is evaluated once per cell, before the counts."""
        return sum((F.when(m, 1 << i).otherwise(0) for i, m in enumerate(flags(cell, kind).values())), F.lit(0)) if flags else F.lit(0)

    def counted(of: Column) -> list[Column]:
        return [F.sum(F.when(F.col("marks").bitwiseAND(1 << i) != 0, of).otherwise(0)).alias(n) for i, n in enumerate(names)]

    cells = [F.struct(
        F.lit(place[c]).alias("place"), F.when(value(c).isNotNull(), F.xxhash64(value(c))).alias("hash"),
        (F.lit(None) if c in text else F.when(value(c).isNotNull(), marks(value(c), kinds[c]))).cast("int").alias("marks"),
        (total(value(c).cast("string")) if total else F.lit(None)).cast("bigint").alias("total"),
    ) for c in columns]
    merged = df.select(F.inline(F.array(*cells))).groupBy("place").agg(
        F.count("*").alias("_rows"), F.count("hash").alias("_filled"), F.hll_sketch_estimate(F.hll_sketch_agg("hash", F.lit(_LG_K))).alias("_distinct"),
        F.sum("total").alias("total"), *counted(F.lit(1)),
    )
    found = {c: Facts(measures=dict.fromkeys([*names, "total"], 0)) for c in columns}
    for r in merged.collect():  # one row per column
        found[columns[r["place"]]] = Facts(r["_rows"], r["_filled"], min(r["_distinct"] or 0, r["_filled"]), False, {n: r[n] or 0 for n in (*names, "total")})

    def decides(facts: Facts) -> bool:
        return exact_up_to is not None and (facts.distinct <= exact_up_to or any(abs(facts.distinct - limit) <= NEAR * max(limit, 1) for limit in limits(facts)))

    filled = [c for c in columns if found[c].filled]
    few = [c for c in filled if c in text and found[c].distinct <= FEW]
    chosen = [c for c in filled if c not in few and decides(found[c])]
    jobs = []
    if few:  # conditions once per value: no more than FEW texts per column and task are shuffled
        rows = F.inline(F.array(*[F.struct(F.lit(place[c]).alias("place"), value(c).alias("text")) for c in few]))
        levels = df.select(rows).where("text is not null").groupBy("place", "text").count()
        jobs.append(levels.select("place", "count", marks(F.col("text"), "string").alias("marks")).groupBy("place").agg(F.count("*").alias("distinct"), *counted(F.col("count"))))
    if many := [c for c in filled if c in text and c not in few]:
        rows = F.inline(F.array(*[F.struct(F.lit(place[c]).alias("place"), value(c).alias("text")) for c in many]))
        jobs.append(df.select(rows).where("text is not null").select("place", marks(F.col("text"), "string").alias("marks")).groupBy("place").agg(F.lit(None).cast("bigint").alias("distinct"), *counted(F.lit(1))))
    if chosen:
        rows = F.inline(F.array(*[F.struct(F.lit(place[c]).alias("place"), F.xxhash64(value(c)).alias("a"), F.xxhash64(F.lit(1), value(c)).alias("b"), value(c).isNotNull().alias("is_filled")) for c in chosen]))
        pairs = df.select(rows).where("is_filled").select("place", "a", "b").distinct()
        jobs.append(pairs.groupBy("place").agg(F.count("*").alias("distinct"), *[F.lit(None).cast("bigint").alias(n) for n in names]))
    if jobs:
        for r in reduce(DataFrame.unionByName, jobs).collect():  # one row per column and kind of count
            facts = found[columns[r["place"]]]
            facts.distinct = facts.distinct if r["distinct"] is None else r["distinct"]
            facts.measures.update({n: r[n] for n in names if r[n] is not None})
    for c in columns:
        found[c].exact = c in chosen or c in few or not found[c].filled
    return found
