"""Point-in-time payment history of a customer: what was known when an invoice was assessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.functions.values import as_double, days_between, parse_date, ratio
from duecast.operators.skew import ROWS_PER_TASK, SEGMENT, add_prior_sums, before, segment, split_hot

# Names and order of the history features.
HISTORY_FEATURES = [
    "customer_history_available",
    "previous_invoice_count",
    "previous_late_invoice_count",
    "previous_late_ratio",
    "recent_5_late_ratio",
    "previous_average_invoice_amount",
    "invoice_vs_customer_average",
    "average_previous_delay_days",
    "maximum_previous_delay_days",
    "days_since_previous_invoice",
    "consecutive_previous_late_count",
]

# Accepted header names per role.
CUSTOMER_NAMES = ("cust_number", "customer_id", "client_id")
POSTING_NAMES = ("posting_date", "invoice_date", "document_create_date")
DUE_NAMES = ("due_in_date", "due_date")
CLEAR_NAMES = ("clear_date", "clearing_date", "payment_date")
AMOUNT_NAMES = ("total_open_amount", "invoice_amount")
LATE_NAMES = ("is_late", "default_next_month")

RECENT = 5


def find_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """First header that equals one of the names after trimming, lower case and ``_`` for spaces."""
    present = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    return next((present[n] for n in names if n in present), None)


def _as_date(df: DataFrame, name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("date")
    kind = dict(df.dtypes)[name]
    return F.col(name) if kind == "date" else parse_date(F.col(name).cast("string"))


def _as_number(df: DataFrame, name: str | None) -> Column:
    return F.lit(None).cast("double") if name is None else as_double(df, name)


def reference_history(df: DataFrame) -> DataFrame:
    """Invoice history in one layout; rows without customer or posting date are dropped. [Q14]"""
    customer, posting = find_column(df, CUSTOMER_NAMES), find_column(df, POSTING_NAMES)
    if customer is None or posting is None:
        raise ValueError("Invoice history needs a customer and a posting date column.")
    clear, due = _as_date(df, find_column(df, CLEAR_NAMES)), _as_date(df, find_column(df, DUE_NAMES))
    target = find_column(df, LATE_NAMES)
    late = _as_number(df, target) if target else F.coalesce((clear > due).cast("double"), F.lit(0.0))
    keep = ["row_id"] if "row_id" in df.columns else []
    return df.select(
        *keep,
        F.trim(F.col(customer).cast("string")).alias("cust_number"),
        _as_date(df, posting).alias("posting_date"),
        due.alias("due_date"),
        clear.alias("clear_date"),
        _as_number(df, find_column(df, AMOUNT_NAMES)).alias("amount"),
        late.alias("is_late"),
        F.when(clear.isNotNull() & due.isNotNull(), days_between(clear, due)).alias("delay_days"),
    ).na.drop(subset=["cust_number", "posting_date"])


# ---------------------------------------------------------------------------
# Training: every invoice sees the rows before it [W1-W9, J1]
# ---------------------------------------------------------------------------

_ORDER = ("_undated", "_at", "_kind", "_row")


def _timeline(df: DataFrame, row_id: str, allow_exact: bool) -> DataFrame:
    """One probe row per invoice and one event row per known outcome, in a single stream.

    Sorting events before probes of the same day makes an outcome usable on its known date;
    the other way round only from the next day on. Only probe rows carry the invoice itself.
    """
    customer, posting = find_column(df, CUSTOMER_NAMES), find_column(df, POSTING_NAMES)
    clear_name, due_name, late_name = (find_column(df, n) for n in (CLEAR_NAMES, DUE_NAMES, LATE_NAMES))
    assessed, clear, due = _as_date(df, posting), _as_date(df, clear_name), _as_date(df, due_name)
    known = clear if clear_name else assessed
    if late_name:
        late = _as_number(df, late_name)
    elif clear_name and due_name:
        late = F.coalesce((clear > due).cast("double"), F.lit(0.0))
    else:
        late = F.lit(None).cast("double")
    delay = F.when(clear.isNotNull() & due.isNotNull(), days_between(clear, due).cast("double"))
    invoice = F.struct(*[F.col(c) for c in df.columns])
    nothing = F.lit(None)

    def row(at, kind, amount, late_value, delay_value, payload):
        return F.struct(
            at.isNull().alias("_undated"),
            at.alias("_at"),
            F.lit(kind).alias("_kind"),
            amount.cast("double").alias("_amount"),
            late_value.cast("double").alias("_late"),
            delay_value.cast("double").alias("_delay"),
            payload.alias("_invoice"),
        )

    probe = row(assessed, 1, _as_number(df, find_column(df, AMOUNT_NAMES)), nothing, nothing, invoice)
    event = row(known, 0 if allow_exact else 2, nothing, late, delay, F.when(F.lit(False), invoice))
    both = F.array_compact(F.array(probe, F.when(known.isNotNull() & late.isNotNull(), event)))
    return df.select(F.col(customer).alias("_customer"), F.col(row_id).alias("_row"), F.inline(both))


def _running_state(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running counts at every row. All windows share one partitioning and one sort."""
    spec = Window.partitionBy(*by).orderBy(*_ORDER)
    so_far, earlier = spec.rowsBetween(Window.unboundedPreceding, 0), spec.rowsBetween(Window.unboundedPreceding, -1)
    probe, event = F.col("_kind") == 1, F.col("_kind") != 1
    on_time = event & (F.col("_late") != 1)
    over = f"over (partition by {', '.join(by)} order by {', '.join(_ORDER)})"
    state = rows.withColumns(
        {
            "_invoices": F.sum(probe.cast("double")).over(so_far),
            "_amounts": F.sum(F.when(probe, F.coalesce("_amount", F.lit(0.0)))).over(so_far),
            "_last_day": F.max(F.when(probe, F.col("_at"))).over(earlier),
            "_outcomes": F.sum(event.cast("double")).over(so_far),
            "_lates": F.sum(F.when(event, F.col("_late"))).over(so_far),
            "_full_lates": F.sum(F.when(event & (F.col("_late") == 1), 1.0).otherwise(0.0)).over(so_far),
            "_delays": F.sum(F.when(event, F.coalesce("_delay", F.lit(0.0)))).over(so_far),
            "_longest": F.max(F.when(event, F.col("_delay"))).over(so_far),
            "_delay_missing": F.last(F.when(event, F.col("_delay").isNull()), ignorenulls=True).over(so_far),
            **{f"_recent_{k}": F.expr(f"lag(_late, {k}) ignore nulls {over}") for k in range(1, RECENT + 1)},
        }
    )
    # Late outcomes counted up to the last punctual one; the rest is the current run.
    return state.withColumn("_at_break", F.max(F.when(on_time, F.col("_full_lates"))).over(so_far))


def _add_carry(local: DataFrame, key: str) -> DataFrame:
    """Merge what earlier segments of the same customer left behind into each segment's state."""
    latest = F.struct(*_ORDER)
    here = F.when(F.col("_kind") != 1, F.col("_late"))
    own_recent = F.slice(F.array_compact(F.array(here, *[F.col(f"_recent_{k}") for k in range(1, RECENT + 1)])), 1, RECENT)
    summary = local.groupBy(key, SEGMENT).agg(
        F.max("_invoices").alias("invoices"),
        F.max_by("_amounts", latest).alias("amounts"),
        F.max(F.when(F.col("_kind") == 1, F.col("_at"))).alias("last_day"),
        F.max("_outcomes").alias("outcomes"),
        F.max_by("_lates", latest).alias("lates"),
        F.max("_full_lates").alias("full_lates"),
        F.max("_delays").alias("delays"),
        F.max("_longest").alias("longest"),
        F.max_by("_delay_missing", latest).alias("delay_missing"),
        F.max("_at_break").alias("at_break"),
        F.max_by(own_recent, latest).alias("recent"),
    )
    past = before([key])
    # Segments without outcomes are left out here, so five of the others always suffice.
    ahead = Window.partitionBy(key).orderBy(SEGMENT).rowsBetween(-(RECENT - 1), 0)
    newest_first = F.reverse(F.collect_list("recent").over(ahead))
    tails = summary.where("outcomes > 0").select(
        F.col(key).alias("t_key"), F.col(SEGMENT).alias("t_segment"), F.slice(F.flatten(newest_first), 1, RECENT).alias("tail")
    )
    carried = (
        summary.join(tails, F.col(key).eqNullSafe(F.col("t_key")) & (F.col(SEGMENT) == F.col("t_segment")), "left")
        .withColumns(
            {
                "c_full_lates": F.coalesce(F.sum("full_lates").over(past), F.lit(0.0)),
                "c_tail": F.last("tail", ignorenulls=True).over(past),
            }
        )
        .select(
            F.col(key).alias("c_key"),
            F.col(SEGMENT).alias("c_segment"),
            F.sum("invoices").over(past).alias("c_invoices"),
            F.sum("amounts").over(past).alias("c_amounts"),
            F.max("last_day").over(past).alias("c_last_day"),
            F.sum("outcomes").over(past).alias("c_outcomes"),
            F.sum("lates").over(past).alias("c_lates"),
            "c_full_lates",
            F.sum("delays").over(past).alias("c_delays"),
            F.max("longest").over(past).alias("c_longest"),
            F.last("delay_missing", ignorenulls=True).over(past).alias("c_delay_missing"),
            F.max(F.col("c_full_lates") + F.col("at_break")).over(past).alias("c_at_break"),
            "c_tail",
        )
    )
    same = F.col(key).eqNullSafe(F.col("c_key")) & (F.col(SEGMENT) == F.col("c_segment"))
    # One carry row per hot customer and segment.
    joined = local.join(F.broadcast(carried), same, "left")

    def plus(name):
        return F.when(F.col(name).isNull() & F.col(f"c{name}").isNull(), None).otherwise(
            F.coalesce(F.col(name), F.lit(0.0)) + F.coalesce(F.col(f"c{name}"), F.lit(0.0))
        )

    own = F.array_compact(F.array(*[F.col(f"_recent_{k}") for k in range(1, RECENT + 1)]))
    merged = joined.withColumn("_own", F.concat(own, F.coalesce("c_tail", F.array().cast("array<double>"))))
    return merged.withColumns(
        {
            **{n: plus(n) for n in ("_invoices", "_amounts", "_outcomes", "_lates", "_delays")},
            "_last_day": F.coalesce("_last_day", "c_last_day"),
            "_longest": F.greatest("_longest", "c_longest"),
            "_delay_missing": F.coalesce("_delay_missing", "c_delay_missing"),
            "_at_break": F.coalesce(F.col("_at_break") + F.col("c_full_lates"), F.col("c_at_break")),
            "_full_lates": plus("_full_lates"),
            **{f"_recent_{k}": F.get("_own", F.lit(k - 1)) for k in range(1, RECENT + 1)},
        }
    ).select(*local.columns)


def _features(state: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    dated, amount = F.col("_at").isNotNull(), F.col("_amount")
    count = F.col("_invoices") - 1
    prior = F.col("_amounts") - F.coalesce(amount, zero)
    average = F.when(amount.isNotNull(), F.coalesce(ratio(prior, count), zero)).otherwise(zero)
    seen = F.when(dated & (F.col("_outcomes") > 0), F.col("_outcomes"))
    recent = F.array_compact(F.array(*[F.col(f"_recent_{k}") for k in range(1, RECENT + 1)]))
    recent_sum = F.aggregate(recent, zero, lambda total, late: total + late)
    measured = seen.isNotNull() & ~F.col("_delay_missing")
    features = {
        "customer_history_available": F.when(count > 0, 1.0).otherwise(0.0),
        "previous_invoice_count": count,
        "previous_late_invoice_count": F.when(seen.isNotNull(), F.col("_lates")),
        "previous_late_ratio": F.col("_lates") / seen,
        "recent_5_late_ratio": F.when(seen.isNotNull(), ratio(recent_sum, F.size(recent).cast("double"))),
        "previous_average_invoice_amount": average,
        "invoice_vs_customer_average": ratio(amount, average),
        "average_previous_delay_days": F.when(measured, F.col("_delays") / seen),
        "maximum_previous_delay_days": F.when(measured, F.col("_longest")),
        "days_since_previous_invoice": days_between(F.col("_at"), F.col("_last_day")).cast("double"),
        "consecutive_previous_late_count": F.when(seen.isNotNull(), F.col("_full_lates") - F.coalesce("_at_break", zero)),
    }
    undefined_days = F.col("_last_day").isNull() | F.col("_at").isNull()
    features["days_since_previous_invoice"] = F.when(~undefined_days, features["days_since_previous_invoice"])
    return state.where("_kind = 1").select(
        "_invoice.*", *[F.coalesce(features[name], zero).alias(name) for name in HISTORY_FEATURES]
    )


def add_training_history(
    df: DataFrame, row_id: str = "row_id", allow_exact: bool = True, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The eleven history features for every invoice. [W1-W9, J1]

    Counts and amounts come from earlier invoices in the order (posting date, ``row_id``).
    Outcomes count from their clearing date on; with ``allow_exact=False`` only from the day
    after, which also keeps an invoice cleared on its posting day from seeing its own label.
    One shuffle on the customer, unless a customer exceeds ``rows_per_task`` rows.
    """
    customer = find_column(df, CUSTOMER_NAMES)
    if customer is None or find_column(df, POSTING_NAMES) is None:
        raise ValueError("History features need a customer and a posting date column.")
    # An invoice makes at most two rows, so counting invoices bounds the windows and reads one column.
    cold, hot = split_hot(df, [customer], max(1, rows_per_task // 2))
    result = _features(_running_state(_timeline(cold, row_id, allow_exact), ["_customer"]))
    if hot is None:
        return result
    pieces = segment(_timeline(hot, row_id, allow_exact), ["_customer"], [F.col(c) for c in _ORDER], rows_per_task)
    local = _running_state(pieces, ["_customer", SEGMENT])
    return result.unionByName(_features(_add_carry(local, "_customer")))


def add_simple_history(
    df: DataFrame, row_id: str = "row_id", late: str = "is_late", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Prior count, prior late count and ratio, and the mean of prior amounts (NULL when none). [W10]"""
    customer, posting = find_column(df, CUSTOMER_NAMES), find_column(df, POSTING_NAMES)
    amount = _as_number(df, find_column(df, AMOUNT_NAMES))
    order = [_as_date(df, posting).asc_nulls_last(), F.col(row_id)]
    sums = {
        "previous_invoice_count": F.lit(1.0),
        "previous_late_invoice_count": F.coalesce(as_double(df, late), F.lit(0.0)),
        "_amounts": F.coalesce(amount, F.lit(0.0)),
        "_amount_rows": F.when(amount.isNotNull(), 1.0).otherwise(0.0),
    }
    state = add_prior_sums(df, [customer], order, sums, rows_per_task)
    count, lates = F.col("previous_invoice_count"), F.col("previous_late_invoice_count")
    average = ratio(F.col("_amounts"), F.col("_amount_rows"))
    return state.withColumns(
        {
            "previous_late_ratio": F.coalesce(ratio(lates, count), F.lit(0.0)),
            "previous_average_invoice_amount": average,
            "invoice_vs_customer_average": ratio(amount, average),
        }
    ).withColumn("previous_invoice_count", count.cast("bigint")).drop("_amounts", "_amount_rows")
