"""Ordered windows that stay bounded when one key holds a large share of the rows.

A window over a key runs in one task. Keys above ``rows_per_task`` rows are therefore cut
into segments along the window's order: each segment is windowed on its own and then gets
what the segments before it carry over. All other keys take the plain window. Both ways
give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.session import materialize

ROWS_PER_TASK = 2_000_000
SEGMENT = "_segment"


def split_hot(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys with more than ``rows_per_task`` rows (None if there are none).

    At most total / rows_per_task keys can be hot, so the list is small enough to broadcast.
    The count itself is combined map-side and reads the key columns only.
    """
    counts = df.groupBy(*keys).count().where(F.col("count") > rows_per_task).drop("count")
    rows = counts.collect()
    if not rows:
        return df, None
    listed = df.sparkSession.createDataFrame(rows, counts.schema)
    hot = F.broadcast(listed.toDF(*[f"_hot_{k}" for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def segment(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Range-partition by key and order and pin each row to its partition number.

    The number is written out once: recomputing a range partitioning after a lost executor
    may choose other bounds.
    """
    parts = max(2, math.ceil(df.count() / rows_per_task))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def before(keys: Sequence[str]) -> Window:
    """All earlier segments of a key."""
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def add_prior_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    rows_per_task: int = ROWS_PER_TASK,
    include_current: bool = False,
    at_most: int | None = None,
) -> DataFrame:
    """Running sums per key over the rows before the current one (or up to it); 0 at the start.

    Without keys the order is global. ``at_most`` is a known bound on the number of rows: while
    it fits one task, nothing needs to be counted.
    """
    last = Window.currentRow if include_current else -1

    def local(part: DataFrame, by: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return part.withColumns({name: F.coalesce(F.sum(value).over(frame), F.lit(0.0)) for name, value in sums.items()})

    if at_most is not None and at_most <= rows_per_task:
        cold, hot = df, None
    elif keys:
        cold, hot = split_hot(df, keys, rows_per_task)
    else:  # one global order: a single task only while the table fits it
        cold, hot = (df, None) if df.count() <= rows_per_task else (df.limit(0), df)
    result = local(cold, keys)
    if hot is None:
        return result
    pieces = segment(hot, keys, order, rows_per_task)
    totals = pieces.groupBy(*keys, SEGMENT).agg(*[F.sum(v).alias(f"_total_{n}") for n, v in sums.items()])
    carry = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(SEGMENT).alias("_segment_of_carry"),
        *[F.coalesce(F.sum(f"_total_{n}").over(before(keys)), F.lit(0.0)).alias(f"_carry_{n}") for n in sums],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col(SEGMENT) == F.col("_segment_of_carry")]
    # One carry row per hot key and segment: as few as the segments themselves.
    joined = local(pieces, [*keys, SEGMENT]).join(F.broadcast(carry), same, "left")
    merged = joined.withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in sums})
    return result.unionByName(merged.select(*result.columns))


HALO = "_halo"


def with_halo(df: DataFrame, keys: Sequence[str], order: str, depth: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows in segments of (keys, order), each with copies of the ``depth`` rows before it; copies carry ``_halo``.

    A window over (keys, segment) that reaches back ``depth`` rows then sees the same rows as one over the keys. ``order``
    tells the rows of a key apart. What is copied is found from the row counts per key and segment.
    """
    pieces = segment(df, keys, [F.col(order)], rows_per_task)
    counts = materialize(pieces.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_n")), "segment-counts")
    up_to = Window.partitionBy(*keys).orderBy(SEGMENT)
    running = counts.withColumn("_through", F.sum("_n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    # Each earlier segment of a key holds at least one row, so the last ``depth`` segments are enough.
    earlier = F.collect_list(F.struct(F.col(SEGMENT).alias("source"), F.col("_through").alias("through"))).over(up_to.rowsBetween(-depth, -1))
    wanted = running.withColumn("_from", F.filter(earlier, lambda e: F.col("_through") - F.col("_n") - e["through"] < depth))
    wanted = wanted.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(SEGMENT).alias("_target"), F.explode("_from.source").alias("_source"))
    last = Window.partitionBy(*keys, SEGMENT).orderBy(F.desc(order))
    tails = pieces.withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= depth).drop("_place")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col(SEGMENT) == F.col("_source")]
    copied = tails.join(wanted, same).withColumn(SEGMENT, F.col("_target")).select(*pieces.columns)
    return pieces.withColumn(HALO, F.lit(False)).unionByName(copied.withColumn(HALO, F.lit(True)))


#: Segments whose carries are found in one window; more are grouped, level by level.
SEGMENTS_PER_BLOCK = 4096


def carry_known(edges: DataFrame, names: Sequence[str], count: int, per_block: int = SEGMENTS_PER_BLOCK) -> DataFrame:
    """(segment, names): per segment the last known value of all earlier ones; ``edges`` holds each segment's own last one.

    A prefix over blocks of segments: windows inside blocks, the same again over the blocks' own last values, and one join
    per level. No task sees more than ``per_block`` segments.
    """
    block = F.floor(F.col(SEGMENT) / per_block).cast("int")
    earlier = Window.partitionBy("_block").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    inside = edges.withColumn("_block", block).withColumns({f"_in_{n}": F.last(n, ignorenulls=True).over(earlier) for n in names})
    if count <= per_block:
        return inside.select(SEGMENT, *[F.col(f"_in_{n}").alias(n) for n in names])
    whole = edges.groupBy(block.alias("_of")).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(SEGMENT))).alias(n) for n in names])
    above = carry_known(whole.withColumnRenamed("_of", SEGMENT), names, math.ceil(count / per_block), per_block)
    above = above.select(F.col(SEGMENT).alias("_of"), *[F.col(n).alias(f"_up_{n}") for n in names])
    joined = inside.join(above, F.col("_block") == F.col("_of"), "left")
    return joined.select(SEGMENT, *[F.coalesce(f"_in_{n}", f"_up_{n}").alias(n) for n in names])


def fill_known(df: DataFrame, columns: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK, per_block: int = SEGMENTS_PER_BLOCK) -> DataFrame:
    """Missing cells take the last value before them in ``order``, those before the first value take that one.

    ``order`` is any list of columns that tells all rows apart. Rows are cut into ranges of it; each range fills itself, and
    its first rows take what earlier ranges carry over. A column without any value stays as it is.
    """
    pieces = segment(df, [], [F.col(c) for c in order], rows_per_task)
    place = [F.col(c) for c in order]
    known = {c: F.when(F.col(c).isNotNull(), F.struct(*place, F.col(c).alias("_value"))) for c in columns}
    edges = materialize(
        pieces.groupBy(SEGMENT).agg(*[F.max(k).alias(f"last_{i}") for i, k in enumerate(known.values())], *[F.min(k).alias(f"first_{i}") for i, k in enumerate(known.values())]), "edges"
    )
    facts = edges.agg(F.max(SEGMENT).alias("top"), *[F.min(f"first_{i}").alias(f"first_{i}") for i in range(len(columns))]).first()
    if facts["top"] is None:
        return df
    names = [f"last_{i}" for i in range(len(columns))]
    carry = carry_known(edges.select(SEGMENT, *[F.col(n)["_value"].alias(n) for n in names]), names, facts["top"] + 1, per_block)
    carry = carry.withColumnRenamed(SEGMENT, "_segment_of_carry")
    before_here = Window.partitionBy(SEGMENT).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    own = pieces.withColumns({f"_own_{i}": F.last(c, ignorenulls=True).over(before_here) for i, c in enumerate(columns)})
    # The windows have dealt the rows by segment, so the join moves the carries only.
    joined = own.join(F.broadcast(carry) if facts["top"] < per_block else carry, F.col(SEGMENT) == F.col("_segment_of_carry"), "left")
    kinds = dict(df.dtypes)
    first = [F.lit(None if facts[f"first_{i}"] is None else facts[f"first_{i}"]["_value"]).cast(kinds[c]) for i, c in enumerate(columns)]
    return joined.withColumns({c: F.coalesce(f"_own_{i}", f"last_{i}", first[i]) for i, c in enumerate(columns)}).select(*df.columns)
