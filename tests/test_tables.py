"""Quality, files, profiles and stored tables on small fixtures."""

import pytest
from pyspark.sql import functions as F

from duecast.operators import combine, demand, filters, profile, quality, skew
from duecast.operators.features import CREDIT_FEATURES, add_money_fields, choose_target
from duecast.sources import files, workspace


def _credit(spark, rows=40):
    df = spark.range(rows).withColumns(
        {
            "source_row_number": F.col("id") + 2, "client_id": F.concat(F.lit("C"), F.col("id").cast("string")), "LIMIT_BAL": F.lit(50000.0) + F.col("id"),
            "AGE": F.when(F.col("id") == 0, 175).otherwise(35), "EDUCATION": F.lit(2), "MARRIAGE": F.lit(1),
            **{c: (F.col("id") % 4).cast("int") for c in CREDIT_FEATURES if c.startswith("PAY_") and "AMT" not in c},
            **{c: F.lit(1000.0) for c in CREDIT_FEATURES if "AMT" in c},
        }
    )
    return df.withColumn("default_next_month", (F.col("PAY_0") > 1).cast("int")).drop("id")


def test_every_row_lands_in_one_status(spark):
    df = _credit(spark, 240)
    diagnosed = quality.diagnose_credit(df)
    counts = quality.check_coverage(df, diagnosed).first()
    assert counts["rows"] == 240 and counts["rejected"] == 1
    rejected = quality.route(diagnosed)["REJECTED"].first()
    assert rejected.source_row_number == 2 and rejected.issue_codes == "AGE_OUT_OF_RANGE" and rejected.issue_details == "ERROR: AGE is 175.0."


def test_corrections(spark):
    df = _credit(spark)
    layout = "source_row_number int, client_id string, field string, corrected_value string, correction_status string"
    fix = spark.createDataFrame([(2, "C0", "AGE", "35", "NORMALIZED"), (3, "C1", None, None, "EXCLUDE_FROM_TRAINING")], layout)
    fixed, applied = quality.apply_corrections(df, fix)
    assert applied == 2 and fixed.count() == 39 and fixed.where("source_row_number = 2").first().AGE == 35
    for bad in [(99, "C0", "AGE", "1", "NORMALIZED"), (2, "C5", "AGE", "1", "NORMALIZED"), (2, "C0", "NOPE", "1", "NORMALIZED"), (2, "C0", "AGE", None, "NORMALIZED"), (2, "C0", "AGE", "1", "WHATEVER")]:
        with pytest.raises(ValueError):
            quality.apply_corrections(df, spark.createDataFrame([bad], layout))


def test_money(spark):
    df = spark.createDataFrame([(2, 10, 30, 5), (3, 20, 50, 10)], "units_sold int, price int, cash_inflow int, cash_outflow int")
    out = add_money_fields(df).collect()
    assert [r.revenue for r in out] == [20, 60] and [r.net_cashflow for r in out] == [25, 40]
    with pytest.raises(ValueError):
        choose_target(df)


def test_file_structures(spark):
    one = spark.createDataFrame([("2026-01-01", 1)], "date string, units_sold int")
    assert set(combine.combine_files({"a": one, "b": one.withColumnRenamed("date", "Date ")}).columns) == {"date", "units_sold", "_source_file"}
    with pytest.raises(ValueError):
        combine.combine_files({"a": one, "b": one.withColumnRenamed("units_sold", "revenue")})
    report = combine.compatibility({"a": one, "b": one.withColumn("units_sold", F.lit("many"))}).where("file = 'b'").first()
    assert not report.compatible and report.type_mismatches == "units_sold: expected numeric, found text"


def test_overlap_and_fingerprint(spark):
    ab = spark.createDataFrame([("A", 1), ("B", 2)], "client_id string, x int")
    bc = spark.createDataFrame([("B", 9), ("C", 3)], "client_id string, x int")
    report = combine.overlap_report({"1": ab, "2": bc}, ["client_id"]).first()
    assert report.overlapping_rows == 1 and not report.safe_to_merge
    again = spark.createDataFrame([("B", 2), ("A", 1)], "client_id string, x int")
    assert combine.fingerprint(ab).first().fingerprint == combine.fingerprint(again).first().fingerprint
    assert combine.require_one_family(combine.adapt_source(ab, "uci_credit_card")) == "uci_credit_v1"
    mixed = combine.adapt_source(ab, "uci_credit_card").unionByName(combine.adapt_source(ab, "german_credit"))
    with pytest.raises(ValueError):
        combine.require_one_family(mixed)


def test_header_matching():
    found = profile.resolve_headers(["ID", "SEX", "default.payment.next.month", "PAY_AMT1", "PAY_0"], ["client_id", "PAY_0", "PAY_AMT1", "PAY_2", "default_next_month"])
    assert found == {"client_id": "ID", "PAY_0": "PAY_0", "PAY_AMT1": "PAY_AMT1", "default_next_month": "default.payment.next.month"}


def test_one_hot_rebuild(spark):
    df = spark.createDataFrame([("CA02 ", "USD", "RV"), ("U001", None, "X")], "` Business Code ` string, `invoice-currency` string, document_type string")
    out, missing, rebuilt = profile.align_to_model(df, ["business_code_CA02", "invoice_currency_USD", "document type_RV", "nothing_x"])
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1), (0, 0, 0)] and missing == ["nothing_x"] and len(rebuilt) == 3
    with pytest.raises(ValueError):
        profile.model_input(df, ["nothing_x"])


def test_empty_column_is_text(spark):
    df = spark.range(20).select("id", F.lit(None).cast("string").alias("note"), (F.col("id") % 2 == 0).alias("flag"))
    kinds = {r.column_name: r.kind for r in profile.profile(df).collect()}
    assert kinds == {"id": "integer", "note": "string", "flag": "boolean"}


def test_search_is_a_regex_and_skips_missing_cells(spark):
    df = spark.createDataFrame([("Anna", 1), (None, 2), ("nan", 3)], "name string, n int")
    assert [r.n for r in filters.search(df, "^NAN$").collect()] == [3]
    assert filters.search(df, "1|ANN").count() == 1


@pytest.mark.parametrize(("rows", "per_block"), [(10**9, 4096), (7, 3), (3, 2)])
def test_gaps_are_filled_over_segments(spark, rows, per_block):
    """Any order column, here a hash: rows take the last known value before them, the first ones the first known."""
    known = {5, 6, 41, 43, 77}
    source = spark.range(120).select(
        F.col("id"), F.xxhash64("id").alias("key"), F.when(F.col("id").isin(*known), F.col("id")).alias("a"),
        F.when(F.col("id") % 9 == 4, F.concat(F.lit("v"), F.col("id"))).alias("b"), F.lit(None).cast("date").alias("none"),
    )
    ordered = sorted(source.collect(), key=lambda r: r.key)
    got = {r.key: r for r in skew.fill_known(source.repartition(5), ["a", "b", "none"], ["key"], rows, per_block).collect()}
    assert len(got) == 120
    for name in ("a", "b", "none"):
        values = [r[name] for r in ordered]
        last = next((v for v in values if v is not None), None)
        for r, v in zip(ordered, values, strict=True):
            last = last if v is None else v
            assert got[r.key][name] == last
    assert skew.fill_known(source.limit(0), ["a"], ["key"]).count() == 0


def test_no_window_without_partition_when_cleaning(spark):
    df = spark.range(40).select(F.xxhash64("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("2024-01-05")).alias("day"), (F.col("id") % 7).alias("n"))
    roles = spark.createDataFrame([("day", "date", "feature"), ("n", "integer", "feature")], "column_name string, kind string, role string")
    cleaned, report = profile.auto_clean(df, roles, "row_id", rows_per_task=5)
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    found = report.first()
    assert cleaned.where("day is null").isEmpty() and cleaned.count() == found["final_rows"] and found["original_rows"] == 40


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(" cust ;Unnamed: 1;Clear Date;due_date\nA;x;20240110;45296\nB;;;2024-01-01\n", encoding="utf-8")
    out = {r.cust: r for r in files.read_delimited(spark, str(path), sep=";").collect()}
    assert out["A"].delay_days == 5 and out["A"].is_late == 1 and out["B"].delay_days is None and out["B"].is_late is None
    path.write_text("a;b\n")
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(path), sep=";")


def test_latin_text(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("name,n\nJosé,1\n".encode("latin-1"))
    assert files.read_delimited(spark, str(path)).first().name == "José"
    path.write_bytes("name,n\nJosé,1\n".encode("utf-8"))
    assert files.read_delimited(spark, str(path)).first().name == "José"


def test_case_updates(spark, tmp_path):
    scored = spark.createDataFrame([("A", 0.9, "HIGH_RISK"), ("B", 0.5, "MEDIUM_RISK"), ("C", 0.1, "LOW_RISK")], "client_id string, risk_score double, risk_tier string")
    root = str(tmp_path)
    workspace.save_analysis(root, scored, "acme", "ana_1", "f.csv", "2026-01-01")
    assert [r.client_id for r in workspace.cases(spark, root, "acme").collect()] == ["A", "B"]
    first = workspace.cases(spark, root, "acme").first()
    layout = "id string, company_id string, status string, decision string, reason string, updated_at string"
    workspace.update_cases(spark, root, spark.createDataFrame([(first.id, "acme", "CLOSED", "paid", "", "2026-01-02"), (first.id, "other", "CLOSED", "x", "", "2026-01-02")], layout))
    assert [(r.client_id, r.status) for r in workspace.cases(spark, root, "acme").collect()] == [("A", "CLOSED"), ("B", "OPEN")]
    assert workspace.cases(spark, root, "acme", "OPEN").count() == 1
    with pytest.raises(ValueError):
        workspace.apply_case_updates(workspace.cases(spark, root, "acme"), spark.createDataFrame([(first.id, "acme", "GONE", "", "", "")], layout))


def test_dates_in_many_layouts(spark):
    import datetime

    from duecast.functions.values import number, parse_date

    texts = ["01/31/2020", "31/01/2020", "2020/01/31", "31 Jan 2020", "Jan 31, 2020", "January 31 2020", "31.01.2020", "2020-01-31T10:00", "1/31/2020 9:15", "20200131.0"]
    df = spark.createDataFrame([(t,) for t in [*texts, "02/03/2020", "32/13/2020", "nonsense", ""]], "t string")
    got = [r[0] for r in df.select(parse_date(F.col("t"))).collect()]
    assert got[: len(texts)] == [datetime.date(2020, 1, 31)] * len(texts)
    assert got[len(texts) :] == [datetime.date(2020, 2, 3), None, None, None]
    assert df.where("t = '02/03/2020'").select(parse_date(F.col("t"), day_first=True)).first()[0] == datetime.date(2020, 3, 2)
    assert [r[0] for r in spark.createDataFrame([("1d",), ("0x1p3",), ("NaN",), (" 2e3 ",)], "t string").select(number(F.col("t"))).collect()] == [None, None, None, 2000.0]


def test_each_file_has_its_own_encoding(spark, tmp_path):
    from duecast.sources.files import read_delimited

    (tmp_path / "a.csv").write_bytes("id,name\n1,café\n".encode())
    (tmp_path / "b.csv").write_bytes("id,name\n2,café\n".encode("latin-1"))
    rows = read_delimited(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("1", "café"), ("2", "café")]


def test_repeated_rows_tell_missing_cells_apart(spark):
    from duecast.operators.quality import quality_report

    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (1, 1)], "a int, b int")
    assert quality_report(df).first()["duplicate_rows"] == 1


def test_many_files_by_one_read(spark, tmp_path):
    """Columns are found by each file's own header, in whatever order and spelling; short rows end in missing cells."""
    texts = {"a.csv": "Order Date,Amount\n2024-01-01,1\n2024-01-02,\n", "b.csv": "amount,order_date\n7,2024-02-01\namount,order_date\n8\n", "c.csv": "AMOUNT,ORDER DATE\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    cells, headers = files.read_cells(spark, str(tmp_path), width=2)
    assert {r["file"].rsplit("/", 1)[1]: r["header"] for r in headers.collect()} == {"a.csv": ["Order Date", "Amount"], "b.csv": ["amount", "order_date"], "c.csv": ["AMOUNT", "ORDER DATE"]}
    got = combine.combine_cells(cells, headers)
    assert got.columns == ["Order Date", "Amount", "_source_file"]
    assert sorted((r[0] or "", r[1] or "", r[2].rsplit("/", 1)[1]) for r in got.collect()) == [
        ("", "8", "b.csv"), ("2024-01-01", "1", "a.csv"), ("2024-01-02", "", "a.csv"), ("2024-02-01", "7", "b.csv")
    ]
    kinds = {(r["file"][-5:], r["key"]): (r["kind"], r["rows"]) for r in combine.cell_kinds(cells, headers).collect()}
    assert kinds == {
        ("a.csv", "orderdate"): ("datetime", 2), ("a.csv", "amount"): ("numeric", 2), ("b.csv", "orderdate"): ("datetime", 2), ("b.csv", "amount"): ("numeric", 2),
        ("c.csv", "orderdate"): ("empty", 0), ("c.csv", "amount"): ("empty", 0),
    }


def test_many_files_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="same structure"):
        combine.combine_cells(*files.read_cells(spark, str(tmp_path), width=4))
    with pytest.raises(ValueError, match="more than 1 cells"):
        files.read_cells(spark, str(tmp_path), width=1)


def test_structures_take_the_same_jobs_for_any_number_of_files(spark):
    one = spark.range(3).select(F.col("id").cast("string").alias("x"))

    def jobs(count):
        group = f"structures-{count}"
        spark.sparkContext.setJobGroup(group, group)
        report = combine.compatibility({f"f{i}": one for i in range(count)})
        assert report.count() == count
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    first = jobs(2)
    assert jobs(12) <= first + 1  # adaptive execution may plan one more shuffle stage, never one per file


def test_split_over_many_classes(spark):
    """Shares hold in each of 3000 classes, a missing class included."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3001 > 0, F.col("id") % 3001).alias("k"))
    parts = demand.split_stratified(df, "k", ["id"]).groupBy("k", "split").count().groupBy("k").pivot("split", ["train", "validation", "test"]).sum("count").fillna(0, ["train", "validation", "test"]).collect()
    assert len(parts) == 3001
    for r in parts:
        n = r["train"] + r["validation"] + r["test"]
        assert (r["train"], r["train"] + r["validation"]) == (int(n * 0.7 + 0.5), int(n * 0.85 + 0.5))
