"""Demand series: lags, rolling statistics, running cash, size reduction and time splits.

The inputs are keyed by (date, store, product); repeated keys are removed first (``filters.demand_problems``) and refused
here, so a series of days is only as long as the calendar. Longer series are cut into overlapping segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from duecast.functions.values import calendar_parts, order_key
from duecast.operators.features import fill_demand_defaults
from duecast.operators.skew import HALO, ROWS_PER_TASK, SEGMENT, add_prior_sums, split_hot, with_halo
from duecast.session import materialize

SERIES = ["store_id", "product_id"]
SHORT_LAGS = (1, 7, 14)
LONG_LAGS = (1, 7, 14, 30)
ROLLING = (7, 14, 30)
HASH_RANGE = 1 << 60
ROWS_PER_BUCKET = 1_000_000


def _over_series(df: DataFrame, made, depth: int, rows_per_task: int | None) -> DataFrame:
    """Columns that look back up to ``depth`` rows of a series; a repeated series and date ends the run with an error.

    A series of days is as long as the calendar at most. Where the order is finer than days, long series are cut into segments
    that carry the rows before them, so that none needs a task of its own.
    """
    if rows_per_task is None and dict(df.dtypes)["date"] == "date":
        cold, hot = df, None
    else:
        cold, hot = split_hot(df, SERIES, rows_per_task or ROWS_PER_TASK)

    def add(part: DataFrame, by: Sequence[str]) -> DataFrame:
        series = Window.partitionBy(*by).orderBy("date")
        repeated = F.lag("date").over(series) == F.col("date")
        fault = F.raise_error(F.lit("A series holds two rows of one date; remove repeated keys first."))
        columns = {n: F.when(repeated, fault).otherwise(c) if n == "lag_1" else c for n, c in made(series).items()}
        return part.withColumns(columns)

    plain = add(cold, SERIES)
    if hot is None:
        return plain
    pieces = add(with_halo(hot, SERIES, "date", depth, rows_per_task or ROWS_PER_TASK), [*SERIES, SEGMENT])
    return plain.unionByName(pieces.where(~F.col(HALO)).select(*plain.columns))


def add_short_features(df: DataFrame, value: str = "units_sold", rows_per_task: int | None = None) -> DataFrame:
    """Weekday, month and the values 1, 7 and 14 rows back. [M9, W12]"""
    parts = calendar_parts(F.col("date"))
    dated = df.withColumns({"dow": parts["day_of_week"], "month": parts["month"]})
    return _over_series(dated, lambda series: {f"lag_{k}": F.lag(value, k).over(series) for k in SHORT_LAGS}, max(SHORT_LAGS), rows_per_task)


def add_long_features(df: DataFrame, value: str = "units_sold", rows_per_task: int | None = None) -> DataFrame:
    """Calendar parts, lags up to 30, and mean and deviation of the previous 7, 14 and 30 rows. [M10, X9, X17, W12, W13]"""
    parts = calendar_parts(F.col("date"))
    dated = fill_demand_defaults(df).withColumns({n: parts[n] for n in ("day_of_week", "month", "day_of_year", "is_weekend")})

    def made(series: Window) -> dict[str, Column]:
        out = {f"lag_{k}": F.lag(value, k).over(series) for k in LONG_LAGS}
        for w in ROLLING:
            frame = series.rowsBetween(-w, -1)
            out[f"roll_mean_{w}"] = F.avg(value).over(frame)
            out[f"roll_std_{w}"] = F.when(F.count(value).over(frame) >= 2, F.stddev_samp(value).over(frame))
        return out

    return _over_series(dated, made, max(*LONG_LAGS, *ROLLING), rows_per_task)


def assess_cash(df: DataFrame, entity: str, period: str, opening_cash: float | None, minimum_cash: float = 0.0) -> DataFrame:
    """Residual, anomaly flag, projected closing cash and shortfall per entity and period. [W14]

    ``df`` has one row per entity and period with ``actual`` and ``forecast_value``.
    """
    d = df.withColumn("residual", F.col("actual") - F.col("forecast_value"))
    scale = F.greatest(d.agg(F.stddev_samp("residual")).scalar(), F.lit(1e-9))
    d = d.withColumn("is_anomaly", F.abs("residual") > 2 * scale)
    if opening_cash is None:
        return d.withColumn("cash_shortfall_risk", F.lit(False))
    running = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.lit(float(opening_cash)) + F.sum("forecast_value").over(running)
    return d.withColumn("projected_closing_cash", closing).withColumn(
        "cash_shortfall_risk", F.col("projected_closing_cash") < F.lit(float(minimum_cash))
    )


# ---------------------------------------------------------------------------
# Size reduction [T1-T3, S6, S7]
# ---------------------------------------------------------------------------


def row_bytes(df: DataFrame) -> Column:
    """Approximate encoded width of a row: text length, 8 bytes for any other cell."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        total = total + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    return total


def stable_sort(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Sort with ties in row order. [T1]"""
    return df.orderBy(*[c for c in keys if c in df.columns], row_id)


def keep_newest(df: DataFrame, keep: int, row_id: str = "row_id") -> DataFrame:
    """The newest rows of every series, in proportion to its size and at least one, ``keep`` rows at most. [T2]

    When the minimum of one row per series exceeds ``keep``, the last series in key order win.
    """
    sizes = df.groupBy(*SERIES).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    share = F.greatest(F.lit(1), F.bround(F.lit(float(keep)) * F.col("_n") / total).cast("bigint"))
    quota = sizes.select(*SERIES, F.least(share, F.col("_n")).alias("_quota"))
    later = add_prior_sums(quota, [], [F.desc(c) for c in SERIES], {"_later": F.col("_quota").cast("double")})
    allowed = later.select(
        *[F.col(c).alias(f"_k_{c}") for c in SERIES], F.least(F.col("_quota"), F.lit(keep) - F.col("_later")).alias("_allowed")
    ).where("_allowed > 0")
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"), F.desc(row_id))
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in SERIES] + [F.col("_rank") <= F.col("_allowed")]
    return ranked.join(allowed, same, "left_semi").drop("_rank")


def _bucket_bits(rows: int) -> int:
    """Hash bits that give buckets of about a million rows, 65536 buckets at most."""
    return min(16, max(4, (rows // ROWS_PER_BUCKET).bit_length()))


def sample_rows(df: DataFrame, keep: int, ids: Sequence[str], seed: int, row_id: str) -> DataFrame:
    """Exactly ``keep`` rows, those with the smallest seeded hash of their ids.

    Counting hash buckets finds the bucket in which the cut falls; only its rows are ranked.
    """
    keyed = df.withColumn("_hash", order_key([F.col(c) for c in ids], seed))
    bucket = F.shiftright("_hash", 60 - _bucket_bits(df.count()))
    counts = keyed.groupBy(bucket.alias("b")).count().orderBy("b").collect()
    left, cut = keep, None
    for row in counts:  # at most 65536 counts
        if row["count"] > left:
            cut = row["b"]
            break
        left -= row["count"]
    if cut is None:
        return df
    below = keyed.where(bucket < cut)
    rank = Window.partitionBy("_bucket").orderBy("_hash", row_id)
    edge = keyed.where(bucket == cut).withColumn("_bucket", F.lit(cut)).withColumn("_rank", F.row_number().over(rank))
    return below.unionByName(edge.where(F.col("_rank") <= left).drop("_rank", "_bucket")).drop("_hash")


def rows_for_bytes(df: DataFrame, limit_bytes: int) -> tuple[int, int, int]:
    """(rows, bytes, rows that fit into the limit on average)."""
    facts = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    rows, size = facts["n"], facts["b"]
    return rows, size, rows if size <= limit_bytes else max(1, int(rows * limit_bytes / size))


def fit_to_size(df: DataFrame, limit_bytes: int, ids: Sequence[str], row_id: str, seed: int = 42) -> tuple[DataFrame, dict]:
    """Problem rows (``is_problem``) go first, then a seeded sample keeps the table within the limit. [T3]"""
    # Several passes follow, so the marked rows are written once.
    marked = materialize(df, "marked")
    clean = marked.where("not is_problem").drop("is_problem")
    rows, size, keep = rows_for_bytes(clean, limit_bytes)
    kept, kept_rows, kept_size = clean, rows, size
    while kept_size > limit_bytes and kept_rows > 1:
        kept = sample_rows(clean, keep, ids, seed, row_id)
        kept_rows, kept_size, _ = rows_for_bytes(kept, limit_bytes)
        keep = max(1, min(keep - 1, int(keep * limit_bytes / max(kept_size, 1)) - 1))
    source = marked.count()
    return kept, {
        "source_rows": source, "problem_rows_removed": source - rows, "random_rows_removed": rows - kept_rows, "final_rows": kept_rows,
        "final_bytes": kept_size,
    }


#: Bins of one pass over the rank shares.
SHARE_BINS = 4096


def fit_series_to_size(df: DataFrame, limit_bytes: int, row_id: str = "row_id", rows_per_task: int = ROWS_PER_TASK, bins: int = SHARE_BINS) -> DataFrame:
    """The newest rows of all series whose summed width stays within a byte limit. [T2]

    Rows come in the order of their rank share: the newest row of every series first, then by rank from the newest over the
    length of the series; ties go by the last series in key order, newest first. The kept rows are as many of the first as fit.
    Two histograms of bytes over the share find the bin of the cut, and only its rows are ordered: three passes at any size.
    """
    ranked = add_prior_sums(df.withColumn("_bytes", row_bytes(df)), SERIES, [F.desc("date"), F.desc(row_id)], {"_newer": F.lit(1.0)}, rows_per_task)
    sizes = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in SERIES]).agg(F.count("*").alias("_length"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in SERIES]
    share = F.when(F.col("_newer") == 0, 0.0).otherwise((F.col("_newer") + 1) / F.col("_length"))
    placed = materialize(ranked.join(sizes, same).select(*df.columns, "_bytes", share.alias("_share")), "rank-shares")

    def passing(rows: DataFrame, place: Column, left: int) -> tuple[int | None, int]:
        """The bin in which the limit is reached, and what is left of it there."""
        for r in rows.groupBy(place.alias("bin")).agg(F.sum("_bytes").alias("bytes")).orderBy("bin").collect():  # one row per bin
            if r["bytes"] > left:
                return r["bin"], left
            left -= r["bytes"]
        return None, left

    coarse = F.least(F.floor(F.col("_share") * bins), F.lit(bins - 1))
    first, left = passing(placed, coarse, limit_bytes)
    if first is None:
        return df
    fine = F.least(F.floor((F.col("_share") * bins - first) * bins), F.lit(bins - 1))
    inside = placed.where(coarse == first)
    second, left = passing(inside, fine, left)
    edge = inside.where(fine == second)
    order = [F.col("_share"), *[F.desc(c) for c in SERIES], F.desc("date"), F.desc(row_id)]
    cut = add_prior_sums(edge, [], order, {"_before": F.col("_bytes").cast("double")}, rows_per_task).where(F.col("_before") + F.col("_bytes") <= left)
    kept = placed.where(coarse < first).unionByName(inside.where(fine < second))
    return kept.select(df.columns).unionByName(cut.select(df.columns))


def reduce_files(
    df: DataFrame, source_bytes: int, target_bytes: int, ids: Sequence[str], seed: int = 42,
    allowed: tuple[int, int] = (10 * 1024 * 1024, 500 * 1024 * 1024),
) -> DataFrame:
    """A seeded random share of the rows that brings the input to about the target size. [S6]"""
    if not allowed[0] <= target_bytes <= allowed[1]:
        raise ValueError(f"The reduced size must be between {allowed[0]} and {allowed[1]} bytes.")
    share = min(1.0, target_bytes * 0.94 / max(source_bytes, 1))
    return df if share >= 1 else df.where(order_key([F.col(c) for c in ids], seed) < F.lit(int(share * HASH_RANGE)))


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def write_reduced(df: DataFrame, path: str, target_bytes: int, ids: Sequence[str], seed: int = 42, rounds: int = 8, close: float = 0.85) -> dict:
    """Writes the largest found share of the rows whose files stay within ``target_bytes``, as Parquet under ``path``. [S6]

    The share starts from the summed row width and follows the bytes that were really written, down where they exceed the
    target and up where they stay below ``close`` of it. Shares are nested by a seeded hash of the ids, so each round keeps the
    same rows and only moves the cut. Every round has a folder of its own; ``folder`` names the one to use.
    """
    spark, width = df.sparkSession, rows_for_bytes(df, target_bytes)[1]
    low, high, share, best = 0.0, None, min(1.0, target_bytes / max(width, 1)), None
    for number in range(rounds):
        folder = f"{path}/round-{number}"
        metrics = Observation()
        part = df if share >= 1 else df.where(order_key([F.col(c) for c in ids], seed) < F.lit(int(share * HASH_RANGE)))
        part.observe(metrics, F.count("*").alias("rows")).write.parquet(folder)
        size = written_bytes(spark, folder)
        if size <= target_bytes:
            best = {"folder": folder, "rows": metrics.get["rows"], "bytes": size, "share": share, "rounds": number + 1}
            if share >= 1 or size >= close * target_bytes:
                return best
            low = share
        else:
            high = share
        guess = share * 0.96 * target_bytes / max(size, 1)
        # A guess outside what is known to fit and not to fit is replaced by the middle.
        share = guess if low < guess < (high or 1.0) else ((low + high) / 2 if high else 1.0)
    if best is None:
        raise ValueError(f"No share of the rows was written within {target_bytes} bytes in {rounds} rounds.")
    return best


def reduction_report(before: DataFrame, after: DataFrame, seed: int) -> DataFrame:
    """Rows and bytes before and after a reduction, one row. [S7]"""
    kept = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(after)), F.lit(0)).alias("b"))
    return before.agg(F.count("*").alias("rows_read"), F.coalesce(F.sum(row_bytes(before)), F.lit(0)).alias("bytes_read")).select(
        "rows_read", "bytes_read", kept.select("n").scalar().alias("rows_kept"), kept.select("b").scalar().alias("bytes_kept"), F.lit(seed).alias("seed")
    ).withColumn("rows_removed", F.col("rows_read") - F.col("rows_kept"))


# ---------------------------------------------------------------------------
# Splits [W17, M2-M4]
# ---------------------------------------------------------------------------

PARTS = ("train", "validation", "test")


def split_by_dates(df: DataFrame, date: str, cuts: Sequence[float] = (0.7, 0.85)) -> DataFrame:
    """``split`` by position in the list of distinct dates. [M4, W17]"""
    day = F.col(date).cast("date")
    days = [r[0] for r in df.where(day.isNotNull()).select(day.alias("d")).distinct().orderBy("d").collect()]  # calendar days
    if len(days) < 3:
        raise ValueError("A chronological split needs more dates.")
    first, second = (days[int(len(days) * c)] for c in cuts)
    part = F.when(day < F.lit(first), PARTS[0]).when(day < F.lit(second), PARTS[1]).otherwise(PARTS[2])
    return df.where(F.col(date).isNotNull()).withColumn("split", part)


def holdout_by_dates(df: DataFrame, date: str, test_share: float = 0.2) -> DataFrame:
    """Two parts at one date; at least ten dates are needed. [M4, W17]"""
    day = F.col(date).cast("date")
    days = [r[0] for r in df.where(day.isNotNull()).select(day.alias("d")).distinct().orderBy("d").collect()]  # calendar days
    if len(days) < 10:
        raise ValueError("A holdout by dates needs ten days or more.")
    cut = days[max(1, int(len(days) * (1 - test_share)))]
    return df.where(F.col(date).isNotNull()).withColumn("split", F.when(day < F.lit(cut), PARTS[0]).otherwise(PARTS[2]))


def split_by_position(
    df: DataFrame, date: str, row_id: str, cuts: Sequence[float] = (0.7, 0.85), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``split`` by position in date order, ties in row order, undated rows last. [M3, W17]

    Counts per day find the days in which the cuts fall; only rows of those days are ranked, by date, then row.
    """
    day = F.col(date).cast("date")
    counts = df.groupBy(day.alias("day")).count().orderBy(F.col("day").asc_nulls_last()).collect()  # one row per calendar day
    total, seen, edges = sum(r["count"] for r in counts), 0, []
    targets = [int(total * c) for c in cuts]
    for row in counts:
        edges += [(row["day"], target - seen) for target in targets if seen <= target < seen + row["count"]]
        seen += row["count"]

    def part_at(rank: Column) -> Column:
        label = F.lit(PARTS[2])
        for part, (edge, offset) in reversed(list(zip(PARTS, edges))):
            earlier = day.isNotNull() if edge is None else F.coalesce(day < F.lit(edge), F.lit(False))
            label = F.when(earlier | (day.eqNullSafe(F.lit(edge)) & (rank < offset)), part).otherwise(label)
        return label

    on_edge = F.lit(False)
    for edge, _ in edges:
        on_edge = on_edge | day.eqNullSafe(F.lit(edge))
    edge_rows = df.where(on_edge).withColumn("_day", day)
    ranked = add_prior_sums(edge_rows, ["_day"], [F.col(date), F.col(row_id)], {"_rank": F.lit(1.0)}, rows_per_task)
    return df.where(~on_edge).withColumn("split", part_at(F.lit(0.0))).unionByName(
        ranked.withColumn("split", part_at(F.col("_rank"))).drop("_rank", "_day")
    )


def split_stratified(
    df: DataFrame, label: str, ids: Sequence[str], cuts: Sequence[float] = (0.7, 0.85), seed: int = 42, names: Sequence[str] = PARTS
) -> DataFrame:
    """``split`` with the same class shares in every part. [M2]

    As in ``sample_rows``, hash buckets are counted per class and only those in which a cut falls are ranked. The cut points
    are a table, one row per class, joined back by value: nothing of the classes passes the driver, however many there are.
    """
    keyed = df.withColumn("_hash", order_key([F.col(c) for c in ids], seed))
    keyed = keyed.withColumn("_bucket", F.shiftright("_hash", 60 - _bucket_bits(df.count())))
    counts = keyed.groupBy(F.col(label).alias("_class"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    of_class = Window.partitionBy("_class")  # at most 65536 counts
    upto = F.sum("_n").over(of_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(of_class)}).withColumn("_before", F.col("_upto") - F.col("_n"))
    points = []
    for i, cut in enumerate(cuts):
        target = F.floor(F.col("_total") * F.lit(float(cut)) + 0.5)
        here = (F.col("_before") < target) & (target <= F.col("_upto"))
        points += [F.coalesce(F.max(F.when(here, F.col("_bucket"))), F.lit(-1)).alias(f"_b{i}"), F.coalesce(F.max(F.when(here, target - F.col("_before"))), F.lit(0)).alias(f"_o{i}")]
    table = materialize(placed.groupBy("_class").agg(*points), "class-cuts")
    joined = keyed.join(table, F.col(label).eqNullSafe(F.col("_class")))
    edge = F.lit(False)
    for i in range(len(cuts)):
        edge = edge | (F.col("_bucket") == F.col(f"_b{i}"))
    rank = Window.partitionBy(label, "_bucket").orderBy("_hash", *ids)
    inner = joined.where(~edge).withColumn("_rank", F.lit(0))
    ranked = joined.where(edge).withColumn("_rank", F.row_number().over(rank))
    part = F.lit(names[len(cuts)])
    for i in reversed(range(len(cuts))):
        inside = (F.col("_bucket") < F.col(f"_b{i}")) | ((F.col("_bucket") == F.col(f"_b{i}")) & (F.col("_rank") <= F.col(f"_o{i}")))
        part = F.when(inside, names[i]).otherwise(part)
    return inner.unionByName(ranked).withColumn("split", part).select(*df.columns, "split")
