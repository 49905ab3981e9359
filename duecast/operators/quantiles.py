"""Exact medians, quantiles and modes of whole columns.

Spark's exact percentile keeps every distinct value of a column in one task. It is used only
while a column is known to be short; beyond that the wanted order statistics are bracketed by
approximate percentiles and counted, until the bracket is small.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1_000_000
FINAL = 50_000


def _order_statistics(df: DataFrame, wanted: Mapping[str, tuple[Column, int, set[int]]], final: int) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks. ``wanted`` maps a name to (column, number of values, ranks)."""
    found: dict[tuple[str, int], float] = {}
    # Open ranks by bracket (name, low, high, the count at or below low, the count inside); neighbouring ranks share their guesses.
    brackets = {(n, None, None, 0, size): set(ranks) for n, (_, size, ranks) in wanted.items() if ranks}

    def inside(name, low, high):
        value = wanted[name][0]
        keep = value.isNotNull()
        if low is not None:
            keep = keep & (value > F.lit(low))
        if high is not None:
            keep = keep & (value < F.lit(high))
        return F.when(keep, value)

    while brackets:
        jobs, exprs = [], []
        for (name, low, high, below, count), ranks in brackets.items():
            value = inside(name, low, high)
            for group in _neighbours(ranks):
                places = [rank - below for rank in group]
                if count <= final:
                    exprs.append(F.slice(F.sort_array(F.collect_list(value)), places[0] + 1, len(places)))
                else:
                    bounds = [max(0.0, places[0] / max(count - 1, 1) - 2e-4), min(1.0, places[-1] / max(count - 1, 1) + 2e-4)]
                    exprs.append(F.percentile_approx(value, bounds, 10_000))
                jobs.append((name, low, high, below, count, group))
        guesses = df.agg(*[e.alias(f"v{i}") for i, e in enumerate(exprs)]).first()
        unresolved, counts = {}, []
        for i, (name, _, _, _, count, group) in enumerate(jobs):
            if count <= final:
                found.update({(name, rank): v for rank, v in zip(group, guesses[f"v{i}"], strict=True)})
            else:
                unresolved[i] = guesses[f"v{i}"]
                value = wanted[name][0]
                for j, bound in enumerate(unresolved[i]):
                    counts += [F.count_if(value < F.lit(bound)).alias(f"lt{i}_{j}"), F.count_if(value <= F.lit(bound)).alias(f"le{i}_{j}")]
        brackets = {}
        if not unresolved:
            break
        tally = df.agg(*counts).first()
        for i, (first, second) in unresolved.items():
            name, low, high, below, count, group = jobs[i]
            lt1, le1, lt2, le2 = (tally[f"{c}{i}_{j}"] for j in (0, 1) for c in ("lt", "le"))
            for rank in group:
                if lt1 <= rank < le1:
                    found[(name, rank)] = first
                    continue
                if lt2 <= rank < le2:
                    found[(name, rank)] = second
                    continue
                if rank < lt1:
                    bracket = (name, low, first, below, lt1 - below)
                elif rank < lt2:
                    bracket = (name, first, second, le1, lt2 - le1)
                else:
                    bracket = (name, second, high, le2, below + count - le2)
                brackets.setdefault(bracket, set()).add(rank)
    return found


def _neighbours(ranks: set[int]) -> list[list[int]]:
    """Ranks in order, those that follow each other together."""
    groups: list[list[int]] = []
    for rank in sorted(ranks):
        if groups and rank == groups[-1][-1] + 1:
            groups[-1].append(rank)
        else:
            groups.append([rank])
    return groups


def exact_quantiles(
    df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], small: int = SMALL, final: int = FINAL
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; NULL cells are left out. [A13, A14]"""
    if df.count() <= small:
        values = df.agg(*[F.percentile(c, F.array(*[F.lit(s) for s in shares])).alias(n) for n, c in columns.items()]).first()
        return {n: list(values[n]) if values[n] is not None else [None] * len(shares) for n in columns}
    sizes = df.agg(*[F.count(c).alias(n) for n, c in columns.items()]).first().asDict()
    wanted = {}
    for name, column in columns.items():
        positions = [s * (sizes[name] - 1) for s in shares] if sizes[name] else []
        ranks = {f(p) for p in positions for f in (math.floor, math.ceil)}
        wanted[name] = (column.cast("double"), sizes[name], ranks)
    at = _order_statistics(df, wanted, final)
    result: dict[str, list[float | None]] = {}
    for name in columns:
        size, values = sizes[name], []
        for share in shares:
            if not size:
                values.append(None)
                continue
            position = share * (size - 1)
            low, high = at[(name, math.floor(position))], at[(name, math.ceil(position))]
            values.append(low + (high - low) * (position - math.floor(position)))
        result[name] = values
    return result


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = SMALL) -> dict[str, float | None]:
    return {n: v[0] for n, v in exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5], small).items()}


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, count) for all columns in one pass; missing cells are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value is not null").groupBy("column_name", "value").count()


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column as text; of equally frequent ones the smallest. [A13]"""
    place = F.struct(-F.col("count"), F.col("value").try_cast("double"), F.col("value"))
    return value_counts(df, columns).groupBy("column_name").agg(F.min_by("value", place).alias("mode"), F.max("count").alias("count"))
