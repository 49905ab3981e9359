"""Payment history: fixtures, edge rows, and hot customers against the plain path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duecast.operators import history, serving
from duecast.operators.skew import add_prior_sums
from duecast.sources import lenses

D = dt.date


def _invoices(spark, rows):
    layout = "row_id int, cust_number string, posting_date date, due_date date, clear_date date, total_open_amount double, is_late double"
    return spark.createDataFrame(rows, layout)


def test_prior_counts_of_one_customer(spark):
    rows = [(i, "A", D(2026, m, 1), None, D(2026, m, 1), amount, late) for i, (m, amount, late) in enumerate([(1, 100.0, 1.0), (2, 200.0, 0.0), (3, 300.0, 1.0)])]
    out = history.add_simple_history(_invoices(spark, rows)).orderBy("row_id").collect()
    assert [r.previous_invoice_count for r in out] == [0, 1, 2]
    assert [r.previous_late_invoice_count for r in out] == [0, 1, 1]
    assert [r.previous_average_invoice_amount for r in out] == [None, 100.0, 150.0]


def test_strict_history_never_sees_its_own_outcome(spark):
    rows = [(1, "A", D(2026, 1, 1), D(2025, 12, 1), D(2026, 1, 1), 10.0, None)]
    df = _invoices(spark, rows).drop("is_late")
    assert history.add_training_history(df, allow_exact=True).first().previous_late_invoice_count == 1
    assert history.add_training_history(df, allow_exact=False).first().previous_late_invoice_count == 0


def test_edge_rows(spark):
    rows = [
        (1, "A", D(2026, 1, 1), D(2026, 1, 5), D(2026, 1, 9), None, 1.0),
        (2, "A", D(2026, 1, 1), D(2026, 1, 5), None, 50.0, None),
        (3, "A", D(2026, 2, 1), None, D(2026, 2, 2), 70.0, 0.0),
        (4, None, D(2026, 2, 1), None, None, 5.0, None),
        (5, "A", None, None, None, 9.0, None),
    ]
    out = {r.row_id: r for r in history.add_training_history(_invoices(spark, rows)).collect()}
    assert out[1].previous_average_invoice_amount == 0 and out[2].previous_invoice_count == 1
    assert out[3].average_previous_delay_days == 4 and out[3].consecutive_previous_late_count == 1
    assert out[3].previous_average_invoice_amount == 25.0  # a missing amount still counts as an invoice
    assert out[4].customer_history_available == 0
    assert out[5].previous_late_invoice_count == 0 and out[5].days_since_previous_invoice == 0


def _uneven(spark, small):
    """A third of the rows belongs to one customer, another third to none; cells are missing."""
    key = F.col("row_id")
    df = lenses.invoices(spark, small).withColumns(
        {
            "cust_number": F.when(key % 3 == 0, -1).when(key % 3 == 1, F.lit(None)).otherwise(F.col("cust_number")),
            "total_open_amount": F.when(key % 17 > 0, F.col("total_open_amount")),
            "posting_date": F.when(key % 29 > 0, F.col("posting_date")),
            "due_date": F.when(key % 31 > 0, F.col("due_date")),
        }
    )
    return df.withColumn("is_late", (F.col("clear_date") > F.date_add("posting_date", 30)).cast("double"))


def _by_row(df):
    kept = ["row_id", *[F.round(c, 6).alias(c) for c in history.HISTORY_FEATURES]]
    return {r.row_id: r for r in df.select(*kept).collect()}


@pytest.mark.parametrize("allow_exact", [True, False])
def test_hot_customers_get_the_same_features(spark, small, allow_exact):
    df = _uneven(spark, small)
    plain = _by_row(history.add_training_history(df, allow_exact=allow_exact))
    split = _by_row(history.add_training_history(df, allow_exact=allow_exact, rows_per_task=37))
    assert len(plain) == 1500 and plain == split


def test_hot_customers_in_serving(spark, small):
    df = _uneven(spark, small).where("posting_date is not null and cust_number is not null")
    df = df.withColumn("clear_date", F.date_sub("clear_date", 5)).withColumn(
        "record_type", F.when(F.col("document_type") == "O", "Current").otherwise("History")
    )
    plain, split = (_by_row(serving.prepare_assessment(df, rows_per_task=n)[0]) for n in (10**9, 37))
    assert plain and plain == split
    expected = _brute_force(df)
    assert plain.keys() == expected.keys()
    for row, values in expected.items():
        assert list(plain[row]) == pytest.approx(values, abs=2e-6)


def _brute_force(df):
    """The serving features by a loop over all pairs."""
    rows = [r.asDict() for r in df.collect()]
    past = sorted((r for r in rows if r["record_type"] == "History"), key=lambda r: (r["posting_date"], r["row_id"]))
    out = {}
    for c in (r for r in rows if r["record_type"] == "Current"):
        prior = [h for h in past if h["cust_number"] == c["cust_number"] and h["posting_date"] < c["posting_date"]]
        seen = [h for h in prior if h["clear_date"] and h["clear_date"] <= c["posting_date"]]
        late = [1.0 if h["is_late"] == 1 else 0.0 for h in seen]
        amounts = [h["total_open_amount"] for h in prior if h["total_open_amount"] is not None]
        delays = [max((h["clear_date"] - h["due_date"]).days, 0) for h in seen if h["due_date"]]
        mean = sum(amounts) / len(amounts) if amounts else 0.0
        run = 0
        for value in reversed(late):
            if value != 1:
                break
            run += 1
        own = c["total_open_amount"]
        values = [
            float(bool(prior)), float(len(prior)), sum(late), sum(late) / len(late) if late else 0.0, sum(late[-5:]) / len(late[-5:]) if late else 0.0,
            mean, own / mean if mean and own is not None else 1.0, sum(delays) / len(delays) if delays else 0.0, float(max(delays, default=0)),
            float((c["posting_date"] - prior[-1]["posting_date"]).days) if prior else 0.0, float(run),
        ]
        out[c["row_id"]] = [c["row_id"], *values]
    return out


def test_prior_sums_of_hot_keys(spark, small):
    df = _uneven(spark, small).select("row_id", "cust_number", F.lit(1.0).alias("one"))
    for keys in (["cust_number"], []):
        plain = add_prior_sums(df, keys, [F.col("row_id")], {"n": F.col("one")}).collect()
        split = add_prior_sums(df, keys, [F.col("row_id")], {"n": F.col("one")}, rows_per_task=50).collect()
        assert sorted(plain, key=lambda r: r.row_id) == sorted(split, key=lambda r: r.row_id)


def test_assessment_guards(spark):
    df = _invoices(spark, [(1, "A", D(2026, 1, 1), None, None, 1.0, None)])
    with pytest.raises(ValueError, match="known record types"):
        serving.prepare_assessment(df.withColumn("record_type", F.lit("Other")))
    with pytest.raises(ValueError, match="marked as Current"):
        serving.prepare_assessment(df.withColumn("record_type", F.lit("History")))
    with pytest.raises(ValueError, match="due_date"):
        serving.prepare_assessment(df.withColumn("record_type", F.lit("Current")), required=["due_date"])
    with pytest.raises(ValueError, match="No customer column"):
        serving.prepare_assessment(df.drop("cust_number"))
