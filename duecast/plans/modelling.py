"""Profiles, contracts, cleaning, scoring, training, model choice and storage."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duecast.operators import learn, profile, projection, quality, scoring, selection
from duecast.operators.encoding import INFREQUENT
from duecast.operators.features import CREDIT_FEATURES, loan_layout
from duecast.operators.quantiles import exact_medians
from duecast.plans import lens_sql as L
from duecast.plans.combining import PROFILED, company_scores
from duecast.plans.filtering import SCORED, scored
from duecast.plans.history import SERVING_SQL, _record_types
from duecast.plans.measures import _rounded
from duecast.plans.scalars import LOANS_SQL
from duecast.session import materialize, scratch_path
from duecast.sources import files, lenses, workspace
from duecast.sources.tables import read

# ------------------------------------------------------------------ profiles


def _uploaded(spark, root):
    df = lenses.invoices(spark, root)
    return df.select(
        "row_id", F.col("row_id").alias("doc_id"), "cust_number", F.col("posting_date").cast("string").alias("posting_date"),
        F.col("clear_date").cast("string").alias("clear_date"), "total_open_amount", "business_code", F.lit("EUR").alias("invoice_currency"),
        F.when(F.col("clear_date").isNotNull(), (F.col("clear_date") > F.col("due_date")).cast("int")).alias("is_late"),
    )


PROFILE_COLUMNS = ["doc_id", "cust_number", "posting_date", "clear_date", "total_open_amount", "business_code", "invoice_currency", "is_late"]
_KINDS = ["integer", "integer", "date", "date", "number", "categorical", "categorical", "integer"]
UPLOADED = f"""{L.INVOICES}, u AS (SELECT row_id, row_id AS doc_id, cust_number, CAST(posting_date AS VARCHAR) AS posting_date, CAST(clear_date AS VARCHAR) AS clear_date,
  total_open_amount, business_code, 'EUR' AS invoice_currency, CASE WHEN clear_date IS NOT NULL THEN CASE WHEN clear_date > due_date THEN 1 ELSE 0 END END AS is_late FROM invoices)"""


def column_profile(spark, root):
    out = profile.profile(_uploaded(spark, root), row_id="row_id")
    return out.withColumn("samples", F.array_join("samples", "; ")).drop("unique_is_exact")


def _profile_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate(zip(PROFILE_COLUMNS, _KINDS)):
        number = 1.0 if kind in ("integer", "number") else 0.0
        day = 1.0 if kind == "date" else 0.0
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing_count, "
            f"count(DISTINCT {c}) AS unique_count, {number}::DOUBLE AS numeric_share, {day}::DOUBLE AS date_share, "
            f"(SELECT string_agg(v, '; ' ORDER BY row_id) FROM (SELECT CAST({c} AS VARCHAR) AS v, row_id FROM u WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 5)) AS samples FROM u"
        )
    return f"WITH {UPLOADED} " + " UNION ALL ".join(parts)


def column_roles(spark, root):
    profiled = profile.profile(_uploaded(spark, root), row_id="row_id")
    return profile.roles(profiled).join(profiled.select("column_name", "rows", "unique_count"), "column_name")


_ROLES = [
    ("doc_id", "integer", "id", "identifier"), ("cust_number", "integer", "feature", "usable"), ("posting_date", "date", "feature", "safe date"),
    ("clear_date", "date", "ignore", "outcome"), ("total_open_amount", "number", "feature", "usable"), ("business_code", "categorical", "feature", "usable"),
    ("invoice_currency", "categorical", "ignore", "empty or constant"), ("is_late", "integer", "target", "target"),
]
# total_open_amount is nearly unique on small tables, so its share decides.
ROLES_SQL = f"WITH {UPLOADED} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS kind, "
    + (f"CASE WHEN count(DISTINCT {c}) >= 0.95 * count(*) THEN 'id' ELSE 'feature' END AS role, CASE WHEN count(DISTINCT {c}) >= 0.95 * count(*) THEN 'nearly unique' ELSE 'usable' END AS reason, "
       if c == "total_open_amount" else f"'{r}' AS role, '{why}' AS reason, ")
    + f"'classification' AS task, count(*) AS rows, count(DISTINCT {c}) AS unique_count FROM u"
    for i, (c, k, r, why) in enumerate(_ROLES)
)


def _changed(spark, root):
    """The same table after a change of layout."""
    return _uploaded(spark, root).select(
        "row_id", "doc_id", F.concat(F.lit("C"), F.col("cust_number")).alias("cust_number"), "posting_date",
        F.when(F.col("row_id") % 2 == 0, F.col("business_code")).alias("business_code"), F.lit(1).alias("company"),
    )


def column_drift(spark, root):
    return profile.drift(profile.profile(_uploaded(spark, root), None).where("column_name <> 'row_id'"), profile.profile(_changed(spark, root)).where("column_name <> 'row_id'"))


DRIFT_SQL = f"""WITH {UPLOADED},
  d AS (SELECT (count(*) - count(business_code) FILTER (row_id % 2 = 0))::DOUBLE / count(*) AS gap, count(DISTINCT business_code) AS b,
               count(DISTINCT business_code) FILTER (row_id % 2 = 0) AS b2 FROM u)
  SELECT column_name, status, old_kind, new_kind, round(CASE WHEN column_name = 'business_code' THEN gap WHEN status IN ('added', 'removed') THEN NULL ELSE 0 END, 6) AS missing_change,
         CAST(CASE WHEN column_name = 'business_code' THEN b2 - b WHEN status IN ('added', 'removed') THEN NULL ELSE 0 END AS BIGINT) AS unique_change
  FROM d, (VALUES ('doc_id', 'same', 'integer', 'integer'), ('cust_number', 'kind changed', 'integer', 'string'), ('posting_date', 'same', 'date', 'date'),
    ('clear_date', 'removed', 'date', NULL), ('total_open_amount', 'removed', 'number', NULL), ('business_code', 'same', 'categorical', 'categorical'),
    ('invoice_currency', 'removed', 'categorical', NULL), ('is_late', 'removed', 'integer', NULL), ('company', 'added', NULL, 'integer')) v(column_name, status, old_kind, new_kind)"""


def version_drift(spark, root):
    """Two stored versions of the profile; the newer one is the reference."""
    stored = None
    for version, created, df in (("v1", 1, _changed(spark, root)), ("v2", 2, _uploaded(spark, root))):
        part = profile.profile(df).where("column_name <> 'row_id'").withColumns({"task": F.lit("credit"), "version": F.lit(version), "created_at": F.lit(created)})
        stored = part if stored is None else stored.unionByName(part)
    return profile.drift_against_versions(stored, profile.profile(_changed(spark, root)).where("column_name <> 'row_id'"), "credit")


# ----------------------------------------------------------------- contracts


def conformed(spark, root):
    """An upload with other spellings, read into the demand contract."""
    df = lenses.demand_text(spark, root).select(
        F.col("date").alias("Sales Date"), F.col("store_id").alias("Store_ID"), F.col("product_id").alias("SKU"), F.col("units_sold").alias("Quantity"),
        F.col("inventory_level").alias("stock"), F.col("amount").alias("note"),
    )
    kinds = {"date": "date", "store_id": "string", "product_id": "string", "units_sold": "integer", "inventory_level": "number", "price": "number"}
    _, report = profile.conform(df, kinds)
    return report


CONFORMED_SQL = f"""WITH {L.DEMAND_TEXT}, c AS (SELECT count(*) AS rows, count(*) FILTER (TRY_CAST(date AS DATE) IS NULL) AS bad_date,
    count(*) FILTER (TRY_CAST(units_sold AS DOUBLE) IS NULL) AS bad_units FROM demand_text)
  SELECT rows, field, source_column, CAST(CASE field WHEN 'date' THEN bad_date WHEN 'units_sold' THEN bad_units WHEN 'price' THEN NULL ELSE 0 END AS BIGINT) AS rejected_cells
  FROM c, (VALUES ('date', 'Sales Date'), ('store_id', 'Store_ID'), ('product_id', 'SKU'), ('units_sold', 'Quantity'), ('inventory_level', 'stock'), ('price', NULL)) v(field, source_column)"""


def conformed_rows(spark, root):
    df = lenses.demand_text(spark, root).select(F.col("row_id").alias("id"), F.col("date").alias("order_date"), F.col("units_sold").alias("Units Sold"), F.col("amount").alias("unit price"))
    table, _ = profile.conform(df, {"client_id": "string", "date": "date", "units_sold": "integer", "price": "number"})
    return table


CONFORMED_ROWS_SQL = f"""WITH {L.DEMAND_TEXT} SELECT CAST(row_id AS VARCHAR) AS client_id, TRY_CAST(date AS DATE) AS date,
  CAST(TRY_CAST(units_sold AS DOUBLE) AS INTEGER) AS units_sold, amount AS price FROM demand_text"""


def contract(spark, root):
    profiled = profile.profile(_uploaded(spark, root), row_id="row_id")
    out = profile.input_contract(profiled, ["total_open_amount", "business_code"], "is_late", {"business_code": "Business unit"})
    return out.withColumn("examples", F.array_join("examples", "; "))


_CONTRACT_ROLES = {
    "doc_id": "identifier / traceability", "cust_number": "identifier / traceability", "clear_date": "training outcome / excluded at prediction",
    "is_late": "training outcome / excluded at prediction", "total_open_amount": "prediction input", "business_code": "prediction input",
}
CONTRACT_SQL = f"WITH {UPLOADED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{k}' AS dtype, {str(c in ('total_open_amount', 'business_code')).lower()} AS required, "
    f"(SELECT CAST({c} AS VARCHAR) FROM u WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 1) AS example, "
    f"(SELECT string_agg(v, '; ' ORDER BY row_id) FROM (SELECT CAST({c} AS VARCHAR) AS v, row_id FROM u WHERE {c} IS NOT NULL ORDER BY row_id LIMIT 3)) AS examples, "
    f"{i} AS source_order, '{_CONTRACT_ROLES.get(c, 'training source / excluded by administrator or governance')}' AS role, "
    f"'{'Business unit' if c == 'business_code' else ''}' AS meaning, {str(c in ('total_open_amount', 'business_code')).lower()} AS used_by_model"
    for i, (c, k) in enumerate(zip(PROFILE_COLUMNS, _KINDS))
)

ENCODED = ["total_open_amount", "Business Code_2-HIGH", "business_code_5-LOW", "document type_F"]


def encoded(spark, root):
    df = lenses.invoices(spark, root).withColumnRenamed("business_code", " Business Code ").withColumnRenamed("document_type", "document-type")
    return profile.model_input(df, ENCODED, keep=["row_id"])


ENCODED_SQL = f"""WITH {L.INVOICES} SELECT row_id, total_open_amount, CAST(business_code = '2-HIGH' AS TINYINT) AS "Business Code_2-HIGH",
  CAST(business_code = '5-LOW' AS TINYINT) AS "business_code_5-LOW", CAST(document_type = 'F' AS TINYINT) AS "document type_F" FROM invoices"""


def model_check(spark, root):
    df = lenses.invoices(spark, root).select("total_open_amount", "business_code", "document_type", "clear_date")
    issues = profile.check_for_model(df, ["clear_date", "business_code_5-LOW", "country"])
    return issues.select("level", "code", F.col("column").alias("column_name"), "count")


MODEL_CHECK_SQL = f"""WITH {L.INVOICES}, d AS (SELECT total_open_amount, business_code, document_type, clear_date FROM invoices),
  i AS (SELECT 'error' AS level, 'missing_model_features' AS code, '' AS column_name, 1::BIGINT AS count
    UNION ALL SELECT 'info', 'legacy_categories_encoded', '', 1
    UNION ALL SELECT 'warning', 'duplicates', '', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))
    UNION ALL SELECT 'warning', 'missing_values', 'clear_date', count(*) FROM d WHERE clear_date IS NULL)
  SELECT * FROM i WHERE count > 0"""


def aligned(spark, root):
    df = lenses.invoices(spark, root).select(F.col("total_open_amount").alias("Total Open Amount"), F.col("cust_number").alias("Cust Number"), "row_id")
    table, issues = profile.align_headers(df, ["total_open_amount", "posting_date"], ["cust_number"])
    total = table.agg(F.round(F.sum("total_open_amount"), 2)).scalar()
    return issues.select("level", "code", F.col("column").alias("column_name"), total.alias("amount"))


ALIGNED_SQL = """SELECT level, code, column_name, (SELECT round(sum(o_totalprice), 2) FROM orders) AS amount
  FROM (VALUES ('error', 'missing_column', 'posting_date'), ('info', 'extra_column', 'row_id')) v(level, code, column_name)"""


def demand_kinds(spark, root):
    """The daily and the weekly layout are told apart by their headers."""
    daily = lenses.demand(spark, root).select(F.col("date").alias("Date"), F.col("store_id").alias("Store ID"), F.col("units_sold").alias("Units Sold"))
    weekly = daily.withColumn("Target_Units_Sold", F.lit(1.0))
    parts = []
    for df in (daily, weekly):
        named, kind = quality.demand_kind(df)
        parts.append(named.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sum("units_sold").alias("units"), F.lit(", ".join(named.columns)).alias("columns")))
    return parts[0].unionByName(parts[1])


DEMAND_KINDS_SQL = f"""WITH {L.DEMAND} SELECT kind, count(*) AS rows, sum(units_sold) AS units, columns FROM demand,
  (VALUES ('daily_retail', 'date, store_id, units_sold'), ('weekly_combined', 'date, store_id, units_sold, target_units_sold')) v(kind, columns) GROUP BY kind, columns"""

# ------------------------------------------------------------------ cleaning


def _dirty(spark, root):
    """Invoices twice for some rows, with gaps."""
    df = lenses.invoices(spark, root)
    gaps = df.select(
        "row_id", "cust_number", F.when(F.col("row_id") % 6 > 0, F.col("posting_date")).alias("posting_date"),
        F.when(F.col("row_id") % 10 > 0, F.col("total_open_amount")).alias("total_open_amount"),
        F.when(F.col("row_id") % 4 > 0, F.col("business_code")).alias("business_code"), F.lit("x").alias("fixed"),
    )
    copies = gaps.withColumn("row_id", F.col("row_id") + 100000000)
    return gaps.unionByName(copies)


def _dirty_roles(spark, root):
    rows = [(0, "cust_number", "integer", "id"), (1, "posting_date", "date", "feature"), (2, "total_open_amount", "number", "feature"), (3, "business_code", "categorical", "feature")]
    return spark.createDataFrame(rows, "position int, column_name string, kind string, role string")


def cleaned(spark, root):
    df, _ = profile.auto_clean(_dirty(spark, root), _dirty_roles(spark, root), "row_id")
    return _rounded(df, 4, "total_open_amount")


CLEANED = f"""{L.INVOICES},
  g AS (SELECT cust_number, CASE WHEN row_id % 6 > 0 THEN posting_date END AS posting_date, CASE WHEN row_id % 10 > 0 THEN total_open_amount END AS total_open_amount,
               CASE WHEN row_id % 4 > 0 THEN business_code END AS business_code, 'x' AS fixed, min(row_id) AS row_id FROM invoices GROUP BY ALL),
  m AS (SELECT median(total_open_amount) AS med, (SELECT business_code FROM g WHERE business_code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual FROM g),
  f AS (SELECT row_id, cust_number, fixed, coalesce(last_value(posting_date IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING),
          first_value(posting_date IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS posting_date,
          coalesce(total_open_amount, med) AS amount, coalesce(business_code, usual) AS business_code FROM g, m),
  q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM f)"""
CLEANED_SQL = f"""WITH {CLEANED} SELECT row_id, cust_number, fixed, posting_date, business_code,
  round(least(greatest(amount, q1 - 1.5::DOUBLE * (q3 - q1)), q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS total_open_amount FROM f, q"""


def cleaning_report(spark, root):
    _, report = profile.auto_clean(_dirty(spark, root), _dirty_roles(spark, root), "row_id")
    return report


REPORT_SQL = f"""WITH {CLEANED}, t AS (SELECT (SELECT 2 * count(*) FROM invoices) AS original_rows, (SELECT count(*) FROM g) AS final_rows,
    (SELECT sum(CASE WHEN posting_date IS NULL THEN 1 ELSE 0 END + CASE WHEN total_open_amount IS NULL THEN 1 ELSE 0 END + CASE WHEN business_code IS NULL THEN 1 ELSE 0 END) FROM g) AS missing,
    (SELECT count(*) FROM f, q WHERE amount < q1 - 1.5::DOUBLE * (q3 - q1) OR amount > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers)
  SELECT original_rows, final_rows, CAST(missing AS BIGINT) AS missing_values_filled, outliers AS outliers_handled, 2 AS type_conversions, original_rows - final_rows AS duplicates_removed FROM t"""


def preprocessed(spark, root):
    df = lenses.invoices(spark, root).select(
        "row_id", "business_code", F.when(F.col("row_id") % 10 > 0, F.col("total_open_amount")).alias("total_open_amount"),
        F.when(F.col("row_id") % 3 > 0, F.col("document_type")).alias("document_type"),
    )
    table = spark.createDataFrame(
        [("business_code", "categorical", "feature"), ("total_open_amount", "number", "feature"), ("document_type", "categorical", "ignore")],
        "column_name string, kind string, role string",
    )
    return _rounded(profile.preprocess(df, table), 4, "total_open_amount")


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PREPROCESSED_SQL = f"""WITH {L.INVOICES}, m AS (SELECT median(total_open_amount) FILTER (row_id % 10 > 0) AS med,
    (SELECT document_type FROM invoices WHERE row_id % 3 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual FROM invoices)
  SELECT row_id, """ + ", ".join(f"CASE WHEN business_code = '{v}' THEN 1 ELSE 0 END AS \"business_code_{v}\"" for v in _LEVELS) + """,
  round(CASE WHEN row_id % 10 > 0 THEN total_open_amount ELSE med END, 4) AS total_open_amount, CASE WHEN row_id % 3 > 0 THEN document_type ELSE usual END AS document_type
  FROM invoices, m"""

# ------------------------------------------------------------------- scoring

# A fixed scorecard stands in for a trained model, so that SQL can repeat the score.
CARD = {"PAY_0": 0.08, "PAY_2": 0.05, "AGE": -0.004, "EDUCATION": 0.03}
BASELINES = {"PAY_0": 1.0, "PAY_2": 1.0, "AGE": 52.0, "EDUCATION": 3.0}


def _card(df):
    total = F.lit(0.4)
    for name, weight in CARD.items():
        total = total + weight * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return df.withColumn("probability", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def _card_output(values):
    total = F.lit(0.4)
    for name, weight in CARD.items():
        total = total + weight * F.coalesce(values.get(name, F.col(name)).cast("double"), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def drivers(spark, root):
    """Top drivers per customer, one row each."""
    df = lenses.credit(spark, root).select("client_id", *CARD)
    found = scoring.drivers_in_row(df, _card_output, BASELINES)
    return found.select("client_id", F.posexplode("drivers").alias("rank", "d")).select(
        "client_id", "rank", F.col("d.feature").alias("feature"), F.col("d.value").alias("value"), F.round("d.impact", 6).alias("impact")
    )




def _card_sql(changed: str | None = None) -> str:
    names = {c: (f"{BASELINES[c]}" if c == changed else c) for c in CARD}
    total = "0.4::DOUBLE"
    for c, w in CARD.items():
        total = f"({total} + {w}::DOUBLE * coalesce({names[c]}::DOUBLE, 0))"
    return f"least(greatest({total}, 0), 1)"


DRIVERS_SQL = f"""WITH {L.CREDIT}, e AS (
    SELECT client_id, unnest([{', '.join(f"{{'i': {i}, 'feature': '{c}', 'value': CAST({c} AS VARCHAR), 'impact': abs({_card_sql()} - {_card_sql(c)})}}" for i, c in enumerate(CARD))}], recursive := true) FROM credit),
  r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY impact DESC, i) AS n FROM e WHERE impact >= 0.0005::DOUBLE)
  SELECT client_id, CAST(n - 1 AS INTEGER) AS rank, feature, value, round(impact, 6) AS impact FROM r WHERE n <= 3"""

INDICATORS = ["LIMIT_BAL", "AGE", "PAY_0", "BILL_AMT1"]


def indicators(spark, root):
    df = lenses.credit(spark, root)
    medians = exact_medians(df.select(*[F.col(c).cast("double").alias(c) for c in INDICATORS]), INDICATORS)
    found = scoring.unusual_indicators(df, medians, top_k=2)
    return found.select("client_id", F.posexplode("unusual_indicators").alias("rank", "u")).select(
        "client_id", "rank", "u.feature", F.round("u.feature_value", 4).alias("feature_value"), "u.relative_position"
    )


INDICATORS_SQL = f"""WITH {L.CREDIT}, m AS (SELECT {', '.join(f'median({c}::DOUBLE) AS m_{c}' for c in INDICATORS)} FROM credit),
  e AS (SELECT client_id, unnest([{', '.join(f"{{'i': {i}, 'feature': '{c}', 'v': coalesce({c}::DOUBLE, 0), 'm': m_{c}}}" for i, c in enumerate(INDICATORS))}], recursive := true) FROM credit, m),
  r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY abs(v - m) / greatest(abs(m), 1) DESC, i) AS n FROM e)
  SELECT client_id, CAST(n - 1 AS INTEGER) AS rank, feature, round(v, 4) AS feature_value,
         CASE WHEN v > m THEN 'Above training median' ELSE 'At or below training median' END AS relative_position FROM r WHERE n <= 2"""


def reasons(spark, root):
    df = lenses.credit(spark, root)
    found = scoring.reason_codes(df, [("PAY_0", 0.4), ("missing_column", 0.3), ("AGE", 0.2), ("EDUCATION", 0.1)], {"PAY_0": 1.0, "AGE": 52.0}, top_k=2)
    return found.select("client_id", F.posexplode("reason_codes").alias("rank", "c")).select("client_id", "rank", "c.feature", "c.value", "c.reference", "c.importance")


REASONS_SQL = f"""WITH {L.CREDIT} SELECT client_id, 0 AS rank, 'PAY_0' AS feature, CAST(PAY_0 AS VARCHAR) AS value, 1.0::DOUBLE AS reference, 0.4::DOUBLE AS importance FROM credit
  UNION ALL SELECT client_id, 1, 'AGE', CAST(AGE AS VARCHAR), 52.0, 0.2 FROM credit"""


def scored_payments(spark, root):
    """Card score, tier and actions per customer."""
    df = _card(lenses.credit(spark, root))
    out = scoring.tier_actions(scoring.score_rows(df, F.col("probability")))
    return out.select("client_id", F.round("risk_score", 6).alias("risk_score"), "risk_tier", F.array_join("recommended_actions", " ").alias("actions"))


PAYMENTS_SQL = f"""WITH {L.CREDIT}, p AS (SELECT client_id, {_card_sql()} AS p FROM credit)
  SELECT client_id, round(p, 6) AS risk_score, CASE WHEN p < 0.35::DOUBLE THEN 'LOW_RISK' WHEN p < 0.65::DOUBLE THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_tier,
    CASE WHEN p < 0.35::DOUBLE THEN 'Maintain standard controls. Consider normal commercial terms.'
         WHEN p < 0.65::DOUBLE THEN 'Send early reminders. Monitor repayment behavior monthly. Consider an early-payment incentive.'
         ELSE 'Request manual credit review. Reduce exposure and tighten payment terms. Increase collection monitoring.' END AS actions FROM p"""


def payment_report(spark, root):
    """One scoring run: every customer's score, tier, drivers as text and actions, beside the run's key figures."""
    rows, kpi = scoring.scoring_report(lenses.credit(spark, root).select("client_id", *CARD), _card_output, BASELINES)
    figures = {n: kpi.select(n).scalar() for n in ("total_records", "high_risk", "medium_risk", "low_risk")}
    return rows.select("client_id", F.round("risk_score", 6).alias("risk_score"), "risk_tier", "key_drivers", F.array_join("recommended_actions", " ").alias("actions"), *[v.alias(n) for n, v in figures.items()])


PAYMENT_REPORT_SQL = f"""WITH {L.CREDIT}, e AS (
    SELECT client_id, unnest([{', '.join(f"{{'i': {i}, 'label': '{c.replace('_', ' ').title()}', 'value': CAST({c} AS DOUBLE), 'impact': abs({_card_sql()} - {_card_sql(c)})}}" for i, c in enumerate(CARD))}], recursive := true) FROM credit),
  r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY impact DESC, i) AS n FROM e WHERE impact >= 0.0005::DOUBLE),
  d AS (SELECT client_id, string_agg(n || '. ' || label || ': ' || coalesce(printf('%.2f', value), 'Not available') || ' | Influence: ' || printf('%.1f', impact * 100) || '%', chr(10) ORDER BY n) AS lines FROM r WHERE n <= 3 GROUP BY 1),
  s AS ({PAYMENTS_SQL}), k AS (SELECT count(*) AS total_records, count(*) FILTER (risk_tier = 'HIGH_RISK') AS high_risk, count(*) FILTER (risk_tier = 'MEDIUM_RISK') AS medium_risk,
    count(*) FILTER (risk_tier = 'LOW_RISK') AS low_risk FROM s)
  SELECT s.client_id, risk_score, risk_tier, coalesce(lines, 'No strong individual driver identified. The score results from several weak combined factors.') AS key_drivers, actions, k.*
  FROM s LEFT JOIN d USING (client_id), k"""


def assessed_uploads(spark, root):
    """Open invoices scored by a card over their history features; the upload marks its records."""
    wanted = ["previous_late_ratio", "recent_5_late_ratio", "business_code_5-LOW"]

    def card(df):
        total = 0.1 + 0.6 * F.col("previous_late_ratio") + 0.2 * F.col("recent_5_late_ratio") + 0.05 * F.col("`business_code_5-LOW`")
        return df.withColumn("probability", total)

    scored_rows, _ = scoring.assess_payments(_record_types(spark, root), wanted, card)
    return scored_rows.select("row_id", F.round("risk_score", 5).alias("risk_score"), "risk_tier")


ASSESSED_SQL = f"""WITH s AS ({SERVING_SQL}), p AS (
    SELECT row_id, 0.1::DOUBLE + 0.6::DOUBLE * previous_late_ratio + 0.2::DOUBLE * recent_5_late_ratio + 0.05::DOUBLE * (CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS p
    FROM s JOIN orders ON o_orderkey = row_id)
  SELECT row_id, round(p, 5) AS risk_score, CASE WHEN p < 0.35::DOUBLE THEN 'LOW_RISK' WHEN p < 0.65::DOUBLE THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_tier FROM p"""


def policy(spark, root):
    out = scoring.apply_policy(scoring.tier_actions(company_scores(spark, root)))
    return out.select("row_id", "company_id", "policy_status", F.array_join("recommended_actions", " / ").alias("actions"))


POLICY_SQL = f"""WITH {PROFILED}, a AS (SELECT *, CASE risk_tier
    WHEN 'HIGH_RISK' THEN ['Request manual credit review.', 'Reduce exposure and tighten payment terms.', 'Increase collection monitoring.']
    WHEN 'MEDIUM_RISK' THEN ['Send early reminders.', 'Monitor repayment behavior monthly.', 'Consider an early-payment incentive.']
    ELSE ['Maintain standard controls.', 'Consider normal commercial terms.'] END AS base FROM profiled),
  b AS (SELECT *, CASE WHEN rk % 2 = 1 THEN list_filter(base, lambda x: NOT contains(lower(x), 'reduce exposure')) ELSE base END AS kept,
        CASE WHEN rk > 0 THEN ['Send early reminders.', 'Follow the rules of ' || currency] ELSE [] END AS own FROM a)
  SELECT row_id, company_id, CASE WHEN require_human_approval THEN 'REQUIRES_HUMAN_REVIEW' ELSE 'ADVISORY' END AS policy_status,
    array_to_string(list_concat(kept, list_filter(own, lambda x: NOT list_contains(kept, x))), ' / ') AS actions FROM b"""


def decision(spark, root):
    df = scored(spark, root)
    counts = df.groupBy("segment").agg(
        F.count_if(F.col("risk_tier") == "HIGH_RISK").alias("high_risk"), F.count_if(F.col("risk_tier") == "MEDIUM_RISK").alias("medium_risk")
    )
    return scoring.payment_decision(counts)


DECISION_SQL = f"""WITH {SCORED} SELECT segment, count(*) FILTER (risk_tier = 'HIGH_RISK') AS high_risk, count(*) FILTER (risk_tier = 'MEDIUM_RISK') AS medium_risk,
  'MANUAL_REVIEW' AS decision_status, 'Prioritize high-risk records for accountable human review.' AS priority_action FROM scored GROUP BY segment"""

# ------------------------------------------------------------- model choice


def _runs(spark, root):
    """One run per business segment: its figures at threshold 0.5."""
    df = lenses.scores(spark, root)
    hit, flag = F.col("y") == 1, F.col("p") >= 0.5
    c = df.groupBy(F.col("segment").alias("algorithm")).agg(
        *[F.count_if(x).cast("double").alias(n) for n, x in (("tp", hit & flag), ("tn", ~hit & ~flag), ("fp", ~hit & flag), ("fn", hit & ~flag))]
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    figures = {
        "accuracy": (tp + tn) / (tp + tn + fp + fn), "precision": tp / (tp + fp), "recall": tp / (tp + fn), "specificity": tn / (tn + fp),
        "f1": 2 * tp / (2 * tp + fp + fn), "pr_auc": tp / (tp + fp) * 0.9, "roc_auc": tn / (tn + fp), "wape": fp / (tp + fn), "rmse": fp, "mae": fn, "r2": tp / (tp + fp),
    }
    return c.select("algorithm", F.create_map(*[x for n, v in figures.items() for x in (F.lit(n), v)]).alias("validation"))


RUNS = f"""{L.SCORES},
  rc AS (SELECT segment AS algorithm, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn,
                count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn FROM scores GROUP BY 1),
  runs AS (SELECT algorithm, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity,
                  2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) * 0.9::DOUBLE AS pr_auc, tn / (tn + fp) AS roc_auc, fp / (tp + fn) AS wape, fp AS rmse, fn AS mae, tp / (tp + fp) AS r2 FROM rc)"""


def ranked(spark, root):
    return selection.rank_classifiers(_runs(spark, root)).select("algorithm", F.round("selection_score", 6).alias("selection_score"))


RANKED_SQL = f"""WITH {RUNS} SELECT algorithm, round(0.18::DOUBLE * pr_auc + 0.14::DOUBLE * (roc_auc + f1 + recall) + 0.10::DOUBLE * precision + 0.06::DOUBLE * accuracy
  - 0.12::DOUBLE * greatest(0, 0.55::DOUBLE - least(recall, specificity, precision)), 6) AS selection_score FROM runs"""


def ranked_forecasters(spark, root):
    return selection.rank_forecasters(_runs(spark, root)).select("algorithm", F.round("selection_score", 6).alias("selection_score"))


RANKED_FORECAST_SQL = f"""WITH {RUNS} SELECT algorithm, round(-(0.55::DOUBLE * wape + 0.20::DOUBLE * (rmse / (abs(rmse) + 1)) + 0.15::DOUBLE * (mae / (abs(mae) + 1))) + 0.10::DOUBLE * r2, 6) AS selection_score FROM runs"""


def best(spark, root):
    runs = _runs(spark, root)
    return selection.best_classifier(runs).withColumn("task", F.lit("credit")).unionByName(selection.best_forecaster(runs).withColumn("task", F.lit("forecast")))


BEST_SQL = f"""WITH {RUNS} SELECT * FROM (SELECT algorithm, 'credit' AS task FROM runs ORDER BY pr_auc DESC, f1 DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT algorithm, 'forecast' FROM runs ORDER BY wape, algorithm LIMIT 1)"""


def model_health(spark, root):
    runs = _runs(spark, root)
    out = selection.assess_models(runs, "credit", "validation", duplicates=F.lit(True))
    return out.select("algorithm", "health", *[F.array_join(c, " ").alias(c) for c in ("strengths", "weaknesses", "recommendations")])


HEALTH_SQL = f"""WITH {RUNS}, s AS (SELECT *, CASE WHEN roc_auc >= 0.8 THEN 1 ELSE 0 END AS good, CASE WHEN recall < 0.65 THEN 1 ELSE 0 END + CASE WHEN precision < 0.6 THEN 1 ELSE 0 END AS bad FROM runs)
  SELECT algorithm, CASE WHEN 2 * good - 2 * bad >= 4 THEN 'Excellent' WHEN 2 * good - 2 * bad >= 1 THEN 'Good' WHEN 2 * good - 2 * bad >= -1 THEN 'Fair' ELSE 'Weak' END AS health,
    CASE WHEN good = 1 THEN 'Good class separation on holdout data.' ELSE 'The pipeline completed with a separated holdout evaluation.' END AS strengths,
    CASE WHEN bad = 0 THEN 'No critical weakness was triggered by configured rules.' ELSE concat_ws(' ',
      CASE WHEN recall < 0.65 THEN 'Recall is limited, so some risky records may be missed.' END,
      CASE WHEN precision < 0.6 THEN 'Precision is limited, increasing manual-review load.' END) END AS weaknesses,
    concat_ws(' ', CASE WHEN recall < 0.65 THEN 'Consider threshold tuning and more representative positive-class examples.' END,
      CASE WHEN precision < 0.6 THEN 'Review false positives and improve discriminating features.' END, 'Review duplicate training records.') AS recommendations FROM s"""


def _model_log(spark, root):
    """Events as an append-only log of model versions."""
    owner = F.when(F.col("user_id") % 30 == 0, "__platform__").when(F.col("user_id") % 30 == 1, "admin_selected_company").otherwise(
        F.concat(F.lit("company_"), F.col("user_id").cast("string"))
    )
    status = F.when(F.col("event_id") % 7 == 0, "CHAMPION").when(F.col("event_id") % 7 == 1, "REJECTED").otherwise("CANDIDATE")
    return read(spark, root, "events").select(
        owner.alias("owner"), F.col("event_type").alias("task"), F.concat(F.lit("v"), (F.col("event_id") % 1000).cast("string")).alias("version"),
        status.alias("status"), F.col("ts").alias("event_ts"),
    )


LOG = """log AS (SELECT CASE WHEN user_id % 30 = 0 THEN '__platform__' WHEN user_id % 30 = 1 THEN 'admin_selected_company' ELSE 'company_' || user_id END AS owner,
    event_type AS task, 'v' || (event_id % 1000) AS version, CASE event_id % 7 WHEN 0 THEN 'CHAMPION' WHEN 1 THEN 'REJECTED' ELSE 'CANDIDATE' END AS status, ts AS event_ts FROM events),
  champs AS (SELECT owner, task, version, event_ts AS activated_at FROM log WHERE status = 'CHAMPION'
             QUALIFY row_number() OVER (PARTITION BY owner, task ORDER BY event_ts DESC, version DESC) = 1)"""


def active(spark, root):
    log = _model_log(spark, root)
    return selection.active_models(log.select("owner", "task").distinct(), log)


ACTIVE_SQL = f"""WITH {LOG}, q AS (SELECT DISTINCT owner, task FROM log),
  pf AS (SELECT task, version FROM champs WHERE owner IN ('__platform__', 'admin_selected_company') QUALIFY row_number() OVER (PARTITION BY task ORDER BY owner) = 1)
  SELECT q.owner, q.task, coalesce(c.version, pf.version) AS version, CASE WHEN c.version IS NOT NULL THEN 'own' WHEN pf.version IS NOT NULL THEN 'platform' ELSE 'none' END AS scope
  FROM q LEFT JOIN champs c ON c.owner = q.owner AND c.task = q.task LEFT JOIN pf ON pf.task = q.task"""

VERSIONS_SQL = f"""WITH {LOG}, l AS (SELECT owner, task, version, arg_max(status, event_ts) AS logged, min(event_ts) AS created_at FROM log GROUP BY 1, 2, 3),
  s AS (SELECT l.owner, l.task, l.version, CASE WHEN l.version = c.version THEN 'CHAMPION' WHEN logged = 'CHAMPION' THEN 'ARCHIVED' ELSE logged END AS status, created_at
        FROM l LEFT JOIN champs c ON c.owner = l.owner AND c.task = l.task)
  SELECT *, CAST(row_number() OVER (PARTITION BY owner, task ORDER BY created_at DESC, version DESC) AS INTEGER) AS position FROM s"""

# ------------------------------------------------------------------ training


def _sound(figures):
    """No figure of a run lies outside the range of its measure."""
    return F.forall(F.map_values(figures), lambda x: x.isNull() | x.between(-1, 1))


def _run_rows(runs, sound):
    return runs.select("algorithm", "method", *[F.col("split")[n].alias(f"{n}_rows") for n in ("train", "validation", "test")], sound.alias("sound"))


def trained_payments(spark, root):
    """Runs of all payment classifiers over all columns and the history: split sizes, and whether all figures are possible ones."""
    runs = learn.train_payment_models(lenses.invoices(spark, root), list(learn.CLASSIFIERS)).runs
    return _run_rows(runs, _sound(F.col("validation")) & _sound(F.col("test")))


TRAINED_PAYMENTS_SQL = f"""WITH {L.INVOICES}, n AS (SELECT count(*) AS n FROM invoices WHERE due_date IS NOT NULL AND clear_date IS NOT NULL),
  c AS (SELECT n, floor(n * 0.7::DOUBLE)::BIGINT AS a, floor(n * 0.85::DOUBLE)::BIGINT AS b FROM n)
  SELECT algorithm, 'chronological' AS method, a AS train_rows, b - a AS validation_rows, n - b AS test_rows, true AS sound
  FROM c, (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) AS t(algorithm)"""


def _with_figures(training, names):
    """Runs with every figure of the validation and test rows, and whether the run was chosen as best."""
    figures = [F.col(part)[n].alias(f"{part}_{n}") for part in ("validation", "test") for n in names]
    return training.runs.select("algorithm", "method", *[F.col("split")[n].alias(f"{n}_rows") for n in ("train", "validation", "test")], *figures, (F.col("algorithm") == training.best).alias("best"))


def every_payment_model(spark, root):
    """All payment classifiers over all columns and the history, with their figures. No SQL: figures of fitted models."""
    return _with_figures(learn.train_payment_models(lenses.invoices(spark, root), list(learn.CLASSIFIERS)), learn.MEASURES)


def trained_credit(spark, root):
    """Both credit models on their training rows. With balanced classes and a free intercept, the residuals of
    logistic regression cancel: its mean probabilities of the two classes add up to one."""
    df = materialize(lenses.credit(spark, root).where("default_next_month is not null"), "credit-rows")
    out = None
    for kind, model in learn.train_credit_models(df).items():
        scored = learn.score_credit_model(model, df)
        mean = [F.avg(F.when(F.col("default_next_month") == y, F.col("probability"))) for y in (0, 1)]
        row = scored.agg(
            F.count("*").alias("rows"), F.sum(F.col("default_next_month").cast("bigint")).alias("positives"), F.min(F.col("probability").between(0, 1)).alias("sound"),
            (F.round(mean[0] + mean[1], 2) if kind == "baseline" else F.lit(None).cast("double")).alias("class_means"),
        ).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def credit_scores(spark, root):
    """Probability of default per client from both credit models."""
    df = materialize(lenses.credit(spark, root).where("default_next_month is not null"), "credit-rows")
    out = None
    for kind, model in learn.train_credit_models(df).items():
        part = learn.score_credit_model(model, df).select(F.lit(kind).alias("kind"), "client_id", "default_next_month", "probability")
        out = part if out is None else out.unionByName(part)
    return out


TRAINED_CREDIT_SQL = f"""WITH {L.CREDIT}, k AS (SELECT CAST(default_next_month AS BIGINT) AS y FROM credit WHERE default_next_month IS NOT NULL)
  SELECT kind, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, true AS sound, CASE WHEN kind = 'baseline' THEN 1.0::DOUBLE END AS class_means
  FROM k, (VALUES ('baseline'), ('boosted')) AS t(kind) GROUP BY kind"""


def trained_loans(spark, root):
    scored = learn.score_trained_loans(loan_layout(lenses.accepted_loans(spark, root)))
    return scored.select("LoanID", "Default", F.col("probability").between(0, 1).alias("sound"))


def loan_scores(spark, root):
    """Probability of default per loan."""
    return learn.score_trained_loans(loan_layout(lenses.accepted_loans(spark, root))).select("LoanID", "Default", "probability")


def _judged(spark, name, scored, label, threshold):
    """One model at its threshold; every count of its measures is counted once more on the scored rows."""
    y, flagged = F.col(label) == 1, F.col("probability") >= threshold
    again = {"tp": y & flagged, "fp": ~y & flagged, "fn": y & ~flagged, "tn": ~y & ~flagged}
    stored = materialize(scored.select(label, "probability"), "predictions")
    counts = stored.agg(*[F.count_if(c).alias(f"again_{n}") for n, c in again.items()], F.avg((F.col(label) - F.col("probability")) * (F.col(label) - F.col("probability"))).alias("squares"))
    found = learn.evaluate_at(stored, label, threshold)
    found = found.withColumns({c: counts.select(c).scalar() for c in counts.columns})
    agrees = F.abs(F.col("brier") - F.col("squares")) < 1e-9
    for n in again:
        agrees = agrees & (F.col(n) == F.col(f"again_{n}"))
    hits, rows = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return found.select(
        F.lit(name).alias("model"), "threshold", rows.alias("rows"), (F.col("tp") + F.col("fn")).alias("positives"), agrees.alias("counts_agree"),
        (F.abs(F.col("accuracy") - hits / rows) < 1e-12).alias("accuracy_follows"),
    )


def judged_models(spark, root):
    """The credit and the loan model on their labelled rows, at 0.50 and at 0.25."""
    credit = materialize(lenses.credit(spark, root).where("default_next_month is not null"), "credit-rows")
    loans = loan_layout(lenses.accepted_loans(spark, root))
    first = _judged(spark, "credit", learn.score_credit_model(learn.train_credit_model(credit), credit), "default_next_month", learn.CREDIT_THRESHOLD)
    return first.unionByName(_judged(spark, "loan", learn.score_trained_loans(loans), "Default", learn.LOAN_THRESHOLD))


TRAINED_LOANS_SQL = f'SELECT LoanID, "Default", true AS sound FROM ({LOANS_SQL})'


def trained_demand(spark, root):
    """Runs of the demand regressors: split sizes by date, and whether all errors are finite and not negative."""
    runs = learn.train_demand_models(lenses.demand(spark, root), ["Ridge", "Gradient Boosting"]).runs
    errors = [F.col(part)[n] for part in ("validation", "test") for n in ("mae", "mse", "rmse", "wape")]
    sound = F.lit(True)
    for error in errors:
        sound = sound & F.coalesce((error >= 0) & (error < float("inf")), F.lit(False))
    return _run_rows(runs, sound)


TRAINED_DEMAND_SQL = f"""WITH {L.DEMAND}, i AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM demand)),
  c AS (SELECT max(date) FILTER (i = floor(n * 0.7::DOUBLE)) AS a, max(date) FILTER (i = floor(n * 0.85::DOUBLE)) AS b FROM i)
  SELECT algorithm, 'chronological' AS method, count(*) FILTER (date < a) AS train_rows, count(*) FILTER (date >= a AND date < b) AS validation_rows,
    count(*) FILTER (date >= b) AS test_rows, true AS sound FROM demand, c, (VALUES ('Ridge'), ('Gradient Boosting')) AS t(algorithm) GROUP BY algorithm"""


JUDGED_SQL = f"""WITH {L.CREDIT}, l AS ({LOANS_SQL})
  SELECT 'credit' AS model, 0.5::DOUBLE AS threshold, count(*) AS rows, CAST(sum(default_next_month) AS BIGINT) AS positives, true AS counts_agree, true AS accuracy_follows FROM credit WHERE default_next_month IS NOT NULL
  UNION ALL SELECT 'loan', 0.25::DOUBLE, count(*), CAST(sum("Default") AS BIGINT), true, true FROM l"""


def long_demand_models(spark, root):
    """All demand regressors over the long features: split sizes by date, and whether every figure of all three parts is a possible one."""
    runs = learn.train_demand_models(lenses.demand(spark, root), list(learn.REGRESSORS), with_train_figures=True, long=True).runs
    sound = F.lit(True)
    for part in ("train", "validation", "test"):
        for n in ("mae", "mse", "rmse", "wape"):
            sound = sound & F.coalesce((F.col(part)[n] >= 0) & (F.col(part)[n] < float("inf")), F.lit(False))
        sound = sound & (F.abs(F.col(part)["rmse"] * F.col(part)["rmse"] - F.col(part)["mse"]) < 1e-6 * (1 + F.col(part)["mse"])) & (F.col(part)["mae"] <= F.col(part)["rmse"] + 1e-9)
    return _run_rows(runs, sound)


def every_demand_model(spark, root):
    """All demand regressors with their figures. No SQL: figures of fitted models."""
    return _with_figures(learn.train_demand_models(lenses.demand(spark, root), list(learn.REGRESSORS)), learn.ERRORS)


def _rare_defaults(spark, root):
    """The credit view with the stricter label of a delay of more than three months."""
    df = lenses.credit(spark, root).select("c_custkey", "client_id", *CREDIT_FEATURES)
    return df.withColumn("default_next_month", (F.col("PAY_0") > 3).cast("int"))


def augmented(spark, root):
    """Row and class counts before and after augmentation."""
    out, _ = learn.augment_minority(_rare_defaults(spark, root), "c_custkey")
    return out.where("default_next_month is not null").groupBy("default_next_month").agg(
        F.count("*").alias("rows"), F.count_if("is_synthetic").alias("synthetic_rows"), F.count_distinct("client_id").alias("clients"),
        F.min(F.when(F.col("is_synthetic"), F.col("BILL_AMT1")) >= 0).alias("amounts_kept_positive"),
    )


AUGMENTED_SQL = f"""WITH {L.CREDIT}, c AS (SELECT CASE WHEN PAY_0 > 3 THEN 1 ELSE 0 END AS y, count(*) AS n FROM credit WHERE PAY_0 IS NOT NULL GROUP BY 1),
  k AS (SELECT y, n, CASE WHEN n = (SELECT min(n) FROM c) THEN greatest(0, CAST(floor((SELECT max(n) FROM c) * 0.75::DOUBLE) AS BIGINT) - n) ELSE 0 END AS added FROM c)
  SELECT y AS default_next_month, n + added AS rows, added AS synthetic_rows, n + added AS clients, CASE WHEN added > 0 THEN true END AS amounts_kept_positive FROM k"""


def importance(spark, root):
    df = lenses.credit(spark, root).where("default_next_month is not null").select("c_custkey", "default_next_month", *CARD)
    out = learn.permutation_importance(df, "default_next_month", "c_custkey", list(CARD), _card)
    bounded = F.col("importance").between(-1, 1) & (F.startswith("direction", F.lit("increases")) == (F.col("importance") >= 0))
    return out.select("feature", bounded.alias("sound"))


IMPORTANCE_SQL = "SELECT feature, true AS sound FROM (VALUES " + ", ".join(f"('{c}')" for c in CARD) + ") AS t(feature)"


def prepared(spark, root):
    """Invoices after the preparation stages: filled numbers, and categories with rare levels grouped."""
    key = F.col("row_id")
    df = lenses.invoices(spark, root).select(
        "row_id", F.when(key % 10 > 0, F.col("total_open_amount")).alias("amount"),
        F.when(key % 6 > 0, F.when(key % 1000 == 7, "rare").otherwise(F.col("business_code"))).alias("code"),
    )
    encoder = learn.preparation(df, ["amount"], ["code"], min_frequency=df.count() // 100, scale=False)[0].fit(df)
    out = encoder.with_slots(encoder.transform(df))
    levels = encoder.levels(spark).where("frequent").select("slot", F.col("value").alias("label"))
    labelled = out.join(levels, F.col("__slot_0") == F.col("slot"), "left")
    vector = vector_to_array("features")
    shown = F.array_position(F.slice(vector, 2, encoder.width), 1.0) - 1 == F.col("__slot_0")
    return labelled.select(
        "row_id", F.round(vector[0], 4).alias("amount"), F.when(shown, F.coalesce("label", F.lit(INFREQUENT))).alias("code"), F.size(vector).alias("width")
    )


PREPARED_SQL = f"""WITH {L.INVOICES}, d AS (SELECT row_id, CASE WHEN row_id % 10 > 0 THEN total_open_amount END AS amount,
    CASE WHEN row_id % 6 > 0 THEN CASE WHEN row_id % 1000 = 7 THEN 'rare' ELSE business_code END END AS code FROM invoices),
  m AS (SELECT median(amount) AS med, (SELECT code FROM d WHERE code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual FROM d)
  SELECT row_id, round(coalesce(amount, med), 4) AS amount, CASE WHEN code = 'rare' THEN 'infrequent' ELSE coalesce(code, usual) END AS code, 7 AS width FROM d, m"""


def stepwise_projection(spark, root):
    """Demand projected twelve days ahead with a fitted ridge model, all days in one fold; the interval is that of its residuals."""
    df = lenses.demand(spark, root)
    result = learn.train_demand_models(df, ["Ridge"], categorical=("store_id", "product_id"), numeric=("inventory_level", "price"))
    out = projection.project_model(df, result.models["Ridge"], horizon=12, frozen=("inventory_level", "price"))
    sound = F.coalesce(F.abs("forecast_value") < float("inf"), F.lit(False)) & (F.col("forecast_lower") < F.col("forecast_upper"))
    return out.select("date", "store_id", "product_id", "inventory_level", F.round("price", 4).alias("price"), sound.alias("sound"))


STEPWISE_SQL = f"""WITH {L.DEMAND}, m AS (SELECT store_id, product_id, max(date) AS last, arg_max(inventory_level, date) AS inventory_level, arg_max(price, date) AS price FROM demand GROUP BY 1, 2)
  SELECT CAST(last + CAST(k AS INTEGER) AS DATE) AS date, store_id, product_id, inventory_level, round(price, 4) AS price, true AS sound FROM m, range(1, 13) AS r(k)"""


def augmentation_comparison(spark, root):
    out = learn.compare_augmentation(_rare_defaults(spark, root), "c_custkey")
    gain = {n: F.col("after")[n] - F.col("before")[n] for n in ("pr_auc", "roc_auc", "brier", "recall")}
    better = (2 * gain["pr_auc"] + gain["roc_auc"] - 0.5 * gain["brier"] > 0) & (gain["recall"] >= -0.02)
    return out.select((F.col("recommended") == F.when(better, "augmented").otherwise("baseline")).alias("follows_figures"), (_sound(F.col("before")) & _sound(F.col("after"))).alias("sound"))


COMPARISON_SQL = "SELECT true AS follows_figures, true AS sound"


def screened(spark, root):
    """Usable and removed columns with the reason."""
    df = _uploaded(spark, root).withColumn("note", F.concat(F.lit("n"), F.col("row_id").cast("string")))
    usable, removed = learn.screen_features(df, df.columns, "is_late", "row_id")
    rows = [(c, "used") for c in usable] + list(removed.items())
    return spark.createDataFrame(rows, "column_name string, reason string").join(
        profile.profile(df, "row_id").select("column_name", "unique_count"), "column_name"
    )


_SCREENED = [
    ("doc_id", "identifier"), ("cust_number", "identifier"), ("posting_date", "outcome/date leakage"), ("clear_date", "outcome/date leakage"),
    ("total_open_amount", "used"), ("business_code", "used"), ("invoice_currency", "constant"), ("note", "high-cardinality text"),
]
SCREENED_SQL = f"WITH {UPLOADED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS reason, count(DISTINCT {'row_id' if c == 'note' else c}) AS unique_count FROM u" for c, r in _SCREENED
)

# ------------------------------------------------------------------- storage


def delimited(spark, root):
    """Invoices written as semicolon text and read back with outcomes filled in."""
    path = scratch_path(spark, "delimited")
    df = lenses.invoices(spark, root)
    serial = F.datediff("due_date", F.lit("1899-12-30").cast("date")).cast("string")
    out = df.select(
        F.col("row_id").alias(" row_id "), F.lit("x").alias("Unnamed: 0"), F.when(F.col("row_id") % 2 == 0, serial).otherwise(F.date_format("due_date", "yyyyMMdd")).alias("due_in_date"),
        F.col("clear_date").cast("string").alias("clear_date"), F.when(F.col("row_id") % 9 == 0, "1").alias("is_late"),
    )
    out.write.option("header", True).option("sep", ";").csv(path)
    return files.read_delimited(spark, path, sep=";").select("row_id", "delay_days", "is_late")


DELIMITED_SQL = f"""WITH {L.INVOICES} SELECT CAST(row_id AS VARCHAR) AS row_id, CASE WHEN clear_date IS NOT NULL THEN greatest(date_diff('day', due_date, clear_date), 0) END::DOUBLE AS delay_days,
  CASE WHEN row_id % 9 = 0 THEN 1 WHEN clear_date IS NOT NULL THEN CASE WHEN clear_date > due_date THEN 1 ELSE 0 END END::DOUBLE AS is_late
  FROM invoices"""


def written(spark, root):
    """A table written as CSV and Parquet; both copies are counted."""
    path = scratch_path(spark, "dataset")
    files.write_dataset(lenses.scores(spark, root).select("row_id", "client_id", "amount"), path)
    read_back = {"csv": spark.read.option("header", True).schema("row_id bigint, client_id bigint, amount double").csv(f"{path}/csv"), "parquet": spark.read.parquet(f"{path}/parquet")}
    parts = [df.agg(F.lit(n).alias("format"), F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount")) for n, df in read_back.items()]
    return parts[0].unionByName(parts[1])


WRITTEN_SQL = "SELECT f AS format, count(*) AS rows, round(sum(o_totalprice), 2) AS amount FROM orders, (VALUES ('csv'), ('parquet')) v(f) GROUP BY f"


def exported(spark, root):
    """High-risk rows exported as CSV, the summary as a JSON report, and both read back."""
    path = scratch_path(spark, "export")
    high = scored(spark, root).where("risk_tier = 'HIGH_RISK'")
    files.export_csv(high, f"{path}/csv")
    summary = high.agg(F.count("*").alias("rows"), F.max("risk_score").alias("highest"))
    # One row per tier.
    advised = scoring.tier_actions(high.select("risk_tier").distinct()).agg(F.array_sort(F.flatten(F.collect_list("recommended_actions")))).scalar()
    files.export_report(summary, f"{path}/report", "ana_1", "payment_risk", "v1", advised)
    rows = spark.read.option("header", True).schema(high.schema).csv(f"{path}/csv").agg(F.count("*").alias("csv_rows"), F.countDistinct("client_id").alias("clients"))
    report = spark.read.schema("analysis_id string, analysis_type string, model_version string, summary struct<rows:bigint,highest:double>, recommendations array<string>").json(f"{path}/report")
    return report.select(
        "analysis_id", "analysis_type", "model_version", "summary.rows", "summary.highest", F.array_join("recommendations", " ").alias("recommendations"), rows.select("csv_rows").scalar().alias("csv_rows"), rows.select("clients").scalar().alias("clients")
    )


EXPORTED_SQL = f"""WITH {SCORED} SELECT 'ana_1' AS analysis_id, 'payment_risk' AS analysis_type, 'v1' AS model_version, count(*) AS rows, max(risk_score) AS highest,
  CASE WHEN count(*) > 0 THEN 'Increase collection monitoring. Reduce exposure and tighten payment terms. Request manual credit review.' ELSE '' END AS recommendations, count(*) AS csv_rows, count(DISTINCT client_id) AS clients FROM scored WHERE risk_tier = 'HIGH_RISK'"""


def stored_runs(spark, root):
    """Two analyses of one company and one of another, listed for the first."""
    path = scratch_path(spark, "runs")
    result = scored(spark, root)
    source = result.select("row_id", "client_id")
    for company, analysis, day in (("Acme & Co", "ana_1", "2026-01-01"), ("Acme & Co", "ana_2", "2026-01-02"), ("other", "ana_3", "2026-01-03")):
        workspace.save_run(path, company, analysis, "credit", source, result, day, "v1")
    listed = workspace.run_history(spark, path, "Acme & Co")
    totals = spark.read.parquet(f"{path}/result").groupBy("company_id", "analysis_id").agg(F.count("*").alias("result_rows"))
    return listed.join(totals, ["company_id", "analysis_id"])


RUNS_SQL = """SELECT 'Acme_Co' AS company_id, a AS analysis_id, 'credit' AS task, 'v1' AS model_version, d AS date, count(*) AS records, count(*) AS result_rows
  FROM orders, (VALUES ('ana_1', '2026-01-01'), ('ana_2', '2026-01-02')) v(a, d) GROUP BY a, d"""


def _client_scores(spark, root):
    df = lenses.scores(spark, root).groupBy("client_id").agg(F.max("p").alias("risk_score"))
    return df.withColumn("risk_tier", F.when(F.col("risk_score") < 0.7, "LOW_RISK").when(F.col("risk_score") < 0.9, "MEDIUM_RISK").otherwise("HIGH_RISK"))


CLIENT_SCORES = f"""{L.SCORES}, cs AS (SELECT client_id, max(p) AS risk_score FROM scores GROUP BY 1),
  ct AS (SELECT *, CASE WHEN risk_score < 0.7::DOUBLE THEN 'LOW_RISK' WHEN risk_score < 0.9::DOUBLE THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_tier FROM cs)"""


def stored_analyses(spark, root):
    path = scratch_path(spark, "analyses")
    workspace.save_analysis(path, _client_scores(spark, root), "acme", "ana_1", "may.csv", "2026-05-31")
    workspace.save_analysis(path, _client_scores(spark, root), "other", "ana_2", "may.csv", "2026-05-31")
    return workspace.analyses(spark, path, "acme")


ANALYSES_SQL = f"""WITH {CLIENT_SCORES} SELECT 'ana_1' AS id, 'acme' AS company_id, 'may.csv' AS file_name, count(*) AS rows, count(*) FILTER (risk_tier = 'HIGH_RISK') AS high_count,
  count(*) FILTER (risk_tier = 'MEDIUM_RISK') AS review_count, count(*) FILTER (risk_tier = 'LOW_RISK') AS standard_count, '2026-05-31' AS created_at FROM ct"""


def updated_cases(spark, root):
    """Every high case reviewed in one batch; the other company stays as it is."""
    path = scratch_path(spark, "cases")
    for company, analysis in (("acme", "ana_1"), ("other", "ana_2")):
        workspace.save_analysis(path, _client_scores(spark, root), company, analysis, "may.csv", "2026-05-31")
    high = workspace.cases(spark, path, "acme").where("risk_tier = 'HIGH_RISK'")
    updates = high.select("id", "company_id", F.lit("REVIEWED").alias("status"), F.lit(" hold ").alias("decision"), F.lit("checked").alias("reason"), F.lit("2026-06-01").alias("updated_at"))
    workspace.update_cases(spark, path, updates)
    stored = spark.read.parquet(f"{path}/cases")
    return stored.select("company_id", "client_id", "risk_tier", "status", "decision", "reason", "updated_at")


CASES_SQL = f"""WITH {CLIENT_SCORES}, c AS (SELECT company, client_id, risk_tier, company = 'acme' AND risk_tier = 'HIGH_RISK' AS done FROM ct, (VALUES ('acme'), ('other')) v(company) WHERE risk_tier <> 'LOW_RISK')
  SELECT company AS company_id, CAST(client_id AS VARCHAR) AS client_id, risk_tier, CASE WHEN done THEN 'REVIEWED' ELSE 'OPEN' END AS status, CASE WHEN done THEN 'hold' ELSE '' END AS decision,
         CASE WHEN done THEN 'checked' ELSE '' END AS reason, CASE WHEN done THEN '2026-06-01' ELSE '2026-05-31' END AS updated_at FROM c"""


def queue(spark, root):
    cases = workspace.open_cases(_client_scores(spark, root), "acme", "ana_1", "2026-05-31")
    return scoring.case_queue(cases).select("client_id", "risk_score", "risk_tier", "status")


QUEUE_SQL = f"WITH {CLIENT_SCORES} SELECT CAST(client_id AS VARCHAR) AS client_id, risk_score, risk_tier, 'OPEN' AS status FROM ct WHERE risk_tier <> 'LOW_RISK' ORDER BY risk_score DESC"

QUERIES = {
    "profile_columns": column_profile,
    "profile_roles": column_roles,
    "profile_drift": column_drift,
    "profile_version_drift": version_drift,
    "contract_conform_report": conformed,
    "contract_conformed_rows": conformed_rows,
    "contract_inputs": contract,
    "contract_encoded_inputs": encoded,
    "contract_model_check": model_check,
    "contract_aligned_headers": aligned,
    "contract_demand_kind": demand_kinds,
    "clean_rows": cleaned,
    "clean_report": cleaning_report,
    "clean_preprocessed": preprocessed,
    "score_drivers": drivers,
    "score_unusual_indicators": indicators,
    "score_reason_codes": reasons,
    "score_payments": scored_payments,
    "score_payment_report": payment_report,
    "score_assessed_uploads": assessed_uploads,
    "score_company_policy": policy,
    "score_decision": decision,
    "models_ranked_classifiers": ranked,
    "models_ranked_forecasters": ranked_forecasters,
    "models_best": best,
    "models_health": model_health,
    "models_active": active,
    "models_versions": lambda s, r: selection.version_numbers(_model_log(s, r)),
    "train_screening": screened,
    "train_preparation": prepared,
    "train_stepwise_projection": stepwise_projection,
    "train_payment_risk": trained_payments,
    "train_credit_behaviour": trained_credit,
    "train_loan_default": trained_loans,
    "train_demand": trained_demand,
    "train_demand_long": long_demand_models,
    "train_model_thresholds": judged_models,
    "train_payment_risk_all": every_payment_model,
    "train_demand_all": every_demand_model,
    "train_credit_behaviour_scores": credit_scores,
    "train_loan_default_scores": loan_scores,
    "train_augmented": augmented,
    "train_augmentation_comparison": augmentation_comparison,
    "train_permutation_importance": importance,
    "store_delimited": delimited,
    "store_dataset": written,
    "store_exports": exported,
    "store_runs": stored_runs,
    "store_analyses": stored_analyses,
    "store_case_updates": updated_cases,
    "store_case_queue": queue,
}
SQL = {
    "profile_columns": _profile_sql(),
    "profile_roles": ROLES_SQL,
    "profile_drift": DRIFT_SQL,
    "profile_version_drift": DRIFT_SQL,
    "contract_conform_report": CONFORMED_SQL,
    "contract_conformed_rows": CONFORMED_ROWS_SQL,
    "contract_inputs": CONTRACT_SQL,
    "contract_encoded_inputs": ENCODED_SQL,
    "contract_model_check": MODEL_CHECK_SQL,
    "contract_aligned_headers": ALIGNED_SQL,
    "contract_demand_kind": DEMAND_KINDS_SQL,
    "clean_rows": CLEANED_SQL,
    "clean_report": REPORT_SQL,
    "clean_preprocessed": PREPROCESSED_SQL,
    "score_drivers": DRIVERS_SQL,
    "score_unusual_indicators": INDICATORS_SQL,
    "score_reason_codes": REASONS_SQL,
    "score_payments": PAYMENTS_SQL,
    "score_payment_report": PAYMENT_REPORT_SQL,
    "score_assessed_uploads": ASSESSED_SQL,
    "score_company_policy": POLICY_SQL,
    "score_decision": DECISION_SQL,
    "models_ranked_classifiers": RANKED_SQL,
    "models_ranked_forecasters": RANKED_FORECAST_SQL,
    "models_best": BEST_SQL,
    "models_health": HEALTH_SQL,
    "models_active": ACTIVE_SQL,
    "models_versions": VERSIONS_SQL,
    "train_screening": SCREENED_SQL,
    "train_preparation": PREPARED_SQL,
    "train_augmented": AUGMENTED_SQL,
    "train_payment_risk": TRAINED_PAYMENTS_SQL,
    "train_credit_behaviour": TRAINED_CREDIT_SQL,
    "train_loan_default": TRAINED_LOANS_SQL,
    "train_demand": TRAINED_DEMAND_SQL,
    "train_demand_long": TRAINED_DEMAND_SQL.replace("('Ridge'), ('Gradient Boosting')", "('Ridge'), ('Random Forest'), ('Gradient Boosting')"),
    "train_model_thresholds": JUDGED_SQL,
    "train_stepwise_projection": STEPWISE_SQL,
    "train_augmentation_comparison": COMPARISON_SQL,
    "train_permutation_importance": IMPORTANCE_SQL,
    "store_delimited": DELIMITED_SQL,
    "store_dataset": WRITTEN_SQL,
    "store_exports": EXPORTED_SQL,
    "store_runs": RUNS_SQL,
    "store_analyses": ANALYSES_SQL,
    "store_case_updates": CASES_SQL,
    "store_case_queue": QUEUE_SQL,
}
