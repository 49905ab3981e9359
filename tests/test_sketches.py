"""Facts of many columns by sketches first, exact near limits."""

import pytest
from pyspark.sql import functions as F

from duecast.operators import filters, learn, profile, quality, sketches
from duecast.operators.sketches import column_facts


@pytest.fixture(scope="module")
def rows(spark):
    key = F.col("id")
    return spark.range(20_000).select(
        key.alias("row_id"), F.when(key % 4 > 0, key % 3).alias("few"), key.cast("string").alias("own"), F.lit(None).cast("string").alias("none"),
        (key % 18_900).alias("near"), F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("day"), F.when(key % 2 == 0, "yes").otherwise("No").alias("flag"),
        F.lit("x").alias("value"), F.lit(1).alias("place"),
    )


def test_counts_are_exact_where_they_decide(rows):
    cells = rows.columns
    exact = column_facts(rows, cells)
    assert [(f.rows, f.filled, f.distinct, f.exact) for f in exact.values()] == [
        (20_000, 20_000, 20_000, True), (20_000, 15_000, 3, True), (20_000, 20_000, 20_000, True), (20_000, 0, 0, True), (20_000, 20_000, 18_900, True),
        (20_000, 20_000, 28, True), (20_000, 20_000, 2, True), (20_000, 20_000, 1, True), (20_000, 20_000, 1, True)]
    near = column_facts(rows, cells, limits=lambda f: (0.945 * f.rows,), exact_up_to=100)
    assert near["near"].exact and near["near"].distinct == 18_900 and near["day"].exact and not near["own"].exact
    assert abs(near["own"].distinct - 20_000) < 0.05 * 20_000
    assert not any(f.exact for f in column_facts(rows, cells, exact_up_to=None).values() if f.filled)
    assert column_facts(rows.limit(0), cells)["own"].rows == 0


def test_kinds_and_roles_follow_exact_counts(rows):
    columns = ["column_name", "kind", "missing_count", "numeric_share", "date_share", "samples"]
    exact, sketched = (profile.profile(rows, "row_id", exact_up_to=n) for n in (10**9, 0))
    assert sorted(map(tuple, exact.select(columns).collect()), key=str) == sorted(map(tuple, sketched.select(columns).collect()), key=str)
    assert {r["column_name"]: r["kind"] for r in exact.collect()} == {
        "few": "integer", "own": "integer", "none": "string", "near": "integer", "day": "date", "flag": "boolean", "value": "categorical", "place": "integer"}
    assert sorted(map(tuple, profile.roles(exact).collect())) == sorted(map(tuple, profile.roles(sketched).collect()))
    assert exact.where("not unique_is_exact").isEmpty() and not sketched.where("not unique_is_exact").isEmpty()


def test_first_values_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(profile, "HEAD_ROWS", 3)
    df = spark.range(50).select(F.col("id").alias("row_id"), F.when(F.col("id") > 40, F.col("id")).alias("late"), F.col("id").alias("all"))
    assert {r["column_name"]: r["samples"] for r in profile.profile(df, "row_id").collect()} == {"late": ["41", "42", "43", "44", "45"], "all": ["0", "1", "2", "3", "4"]}


def test_no_cell_text_is_shuffled(spark, rows, monkeypatch):
    """Every exchange of the two jobs carries merged rows or hashes."""
    seen = []
    collect = type(rows).collect

    def noted(self):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(rows), "collect", noted)
    column_facts(rows, rows.columns)
    assert len(seen) == 2 and not any("Expand" in plan for plan in seen)
    for plan in seen:
        partial = [line for line in plan.splitlines() if "HashAggregate(keys=[place" in line]
        assert partial and not any(f"{c}#" in line for line in partial for c in ("text", "day", "flag", "own"))


@pytest.mark.parametrize("few", [10_000, 5])
def test_conditions_by_value_and_by_cell(rows, monkeypatch, few):
    monkeypatch.setattr(sketches, "FEW", few)
    facts = column_facts(rows, rows.columns, profile._shapes)
    assert facts["day"].measures["date"] == 20_000 and facts["flag"].measures["boolean"] == 20_000 and facts["own"].measures["integer"] == 20_000
    assert facts["day"].distinct == 28 and facts["day"].exact and facts["few"].measures["numeric"] == 15_000


def test_screening_and_search_columns(rows):
    usable, removed = learn.screen_features(rows, ["few", "own", "none", "day", "flag", "value"], "place", "row_id")
    assert usable == ["few", "day", "flag"] and removed == {"own": "high-cardinality text", "none": "constant", "value": "constant"}
    exact, rough = ([tuple(r) for r in filters.best_search_column(rows, a).collect()] for a in (False, True))
    assert exact == rough and len(exact) == len(rows.columns)
    assert filters.best_search_column(rows.limit(0)).count() == len(rows.columns)


def test_flat_columns_are_reported(rows):
    found = {r["column"]: r["count"] for r in quality.check_any(rows, ["few", "near", "place"]).where("code = 'low_variance'").collect()}
    assert found == {"few": 3, "place": 1}
