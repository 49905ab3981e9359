"""File unions, overlap, de-duplication, company settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from duecast.operators import combine, scoring
from duecast.plans import lens_sql as L
from duecast.plans.scalars import LOAN_SELECT
from duecast.session import scratch_path
from duecast.sources import lenses
from duecast.sources.files import read_cells
from duecast.sources.tables import read


def _files(spark, root):
    """Orders and customers' orders as two uploads of the same structure but other header spelling and column order."""
    df = read(spark, root, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("order date"), "o_totalprice")
    other = df.select(F.col("o_totalprice").alias("O_TotalPrice"), F.col("o_orderkey").alias("O_OrderKey"), F.col("order date").alias("Order_Date"))
    return {"first.csv": df, "second.csv": other}


def combined(spark, root):
    return combine.combine_files(_files(spark, root)).groupBy("_source_file").agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"), F.min("order date").alias("first_day")
    )


COMBINED_SQL = """SELECT f AS _source_file, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_day
  FROM orders, (VALUES ('first.csv'), ('second.csv')) v(f) GROUP BY f"""


def _written_files(spark, root, extra=False):
    """The files of ``_files`` as delimited text under one folder, each in several parts with a header of its own."""
    files = _files(spark, root)
    if extra:
        files["third.csv"] = files["first.csv"].select(F.col("o_orderkey").alias("o orderkey"), F.concat(F.lit("EUR "), F.col("o_totalprice")).alias("o_totalprice"), F.lit(1).alias("note"))
    path = scratch_path(spark, "delimited")
    for name, df in files.items():
        df.write.option("header", True).csv(f"{path}/{name}")
    return read_cells(spark, f"{path}/*", width=3)


def combined_cells(spark, root):
    """All parts read at once; columns found by the header of each part."""
    out = combine.combine_cells(*_written_files(spark, root))
    return out.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"), F.substring("order date", 1, 10).alias("day"))


COMBINED_CELLS_SQL = """SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
  UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DOUBLE), strftime(o_orderdate, '%Y-%m-%d') FROM orders"""


def cell_structures(spark, root):
    """Kinds of all columns of three kinds of files, from one pass over their cells. The parts of a file are judged together: one may hold a header alone."""
    whole = F.element_at(F.split("file", "/"), -2)
    cells, headers = (df.withColumn("file", whole) for df in _written_files(spark, root, extra=True))
    kinds = combine.cell_kinds(cells, headers.distinct())
    return kinds.groupBy("key", "kind").agg(F.sum("rows").cast("bigint").alias("rows"))


CELL_STRUCTURES_SQL = """SELECT key, kind, files * (SELECT count(*) FROM orders) AS rows
  FROM (VALUES ('oorderkey', 'numeric', 3), ('ototalprice', 'numeric', 2), ('orderdate', 'datetime', 2), ('ototalprice', 'text', 1), ('note', 'numeric', 1)) v(key, kind, files)"""


def compatible(spark, root):
    files = _files(spark, root)
    files["third.csv"] = files["first.csv"].select(
        F.col("o_orderkey").alias("o orderkey"), F.concat(F.lit("EUR "), F.col("o_totalprice")).alias("o_totalprice"), F.lit(1).alias("note")
    )
    return combine.compatibility(files)


COMPATIBLE_SQL = """SELECT * FROM (SELECT count(*) AS rows FROM orders), (VALUES
  ('first.csv', 3, true, '', '', ''), ('second.csv', 3, true, '', '', ''),
  ('third.csv', 3, false, 'order date', 'note', 'o_totalprice: expected numeric, found text'))
  v(file, columns, compatible, missing_columns, extra_columns, type_mismatches)"""


def adapted(spark, root):
    """Line items under the headers of a public sales file, adapted and rolled up per day and category."""
    line = read(spark, root, "lineitem").join(
        read(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("Product Category")), "l_partkey"
    )
    raw = line.select(
        F.col("l_orderkey").alias("Transaction ID"), F.col("l_shipdate").cast("date").alias("Date"), "Product Category",
        F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Total Amount"),
    )
    return combine.adapt_source(raw, "retail_transactions")


def rolled(spark, root):
    return combine.roll_up_transactions(adapted(spark, root)).withColumn("revenue", F.round("revenue", 4))


ROLLED_SQL = """SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS category, sum(l_quantity) AS units_sold, round(sum(l_extendedprice), 4) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def families(spark, root):
    """Two adapted sources mixed; each source belongs to another schema family."""
    sales = adapted(spark, root).select("dataset_source")
    cards = combine.adapt_source(lenses.credit(spark, root).withColumnRenamed("client_id", "ID"), "uci_credit_card").select("dataset_source")
    return combine.source_families(sales.unionByName(cards))


FAMILIES_SQL = """SELECT 'retail_transactions' AS dataset_source, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS rows, 'retail_transactions_v1' AS family
  UNION ALL SELECT 'uci_credit_card', (SELECT count(*) FROM customer), 'uci_credit_v1'"""


def loans(spark, root):
    """The same loans in two files, and a third file without outcomes."""
    df = lenses.accepted_loans(spark, root)
    second = df.withColumn("dti", F.lit("99"))
    return combine.combine_loans({"a": df, "b": second, "c": df.drop("loan_status")}).select("LoanID", "LoanTerm", "DTIRatio", "Default")


LOANS_SQL = f"""WITH {L.ACCEPTED_LOANS} SELECT LoanID, LoanTerm, DTIRatio, "Default" FROM (
  SELECT *, row_number() OVER (PARTITION BY LoanID ORDER BY row_id) AS n FROM ({LOAN_SELECT}, row_id FROM accepted_loans WHERE loan_status <> 'Current')) WHERE n = 1"""



def loan_notes(spark, root):
    """What became of each of the three files."""
    df = lenses.accepted_loans(spark, root)
    return combine.loan_file_notes({"a": df, "b": df.withColumn("dti", F.lit("99")), "c": df.drop("loan_status")})


LOAN_NOTES_SQL = f"""WITH {L.ACCEPTED_LOANS}, k AS (SELECT * FROM ({LOAN_SELECT}, row_id FROM accepted_loans WHERE loan_status <> 'Current')),
  f AS (SELECT (SELECT count(*) FROM accepted_loans) AS rows, count(*) AS used_rows, count(DISTINCT LoanID) AS loans FROM k)
  SELECT CAST(p AS INTEGER) AS position, n AS file, n <> 'c' AS used, rows, CASE WHEN n = 'c' THEN 0 ELSE loans END AS loans,
         CASE WHEN n = 'c' THEN 'Skipped: no repayment outcome in this file.' ELSE 'Used: ' || used_rows || ' rows with a known outcome.' END AS note FROM f, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(p, n)"""

_PRINT = "CAST(CAST(('0x' || substr(md5(sig || '|0'), 1, 15)) AS BIGINT) AS HUGEINT)"


def fingerprints(spark, root):
    """The fingerprint of all orders, and of the same rows in another order."""
    df = read(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    turned = df.repartition(3, "o_orderstatus")
    return combine.fingerprint(df).withColumn("copy", F.lit("source")).unionByName(combine.fingerprint(turned).withColumn("copy", F.lit("reordered")))


FINGERPRINT_SQL = f"""WITH s AS (SELECT o_orderkey || '|' || o_custkey || '|' || o_orderstatus AS sig FROM orders),
  h AS (SELECT CAST(('0x' || substr(md5(sig || '|0'), 1, 15)) AS BIGINT) AS v FROM s),
  f AS (SELECT count(*) AS rows, sha256(count(*) || ':' || sum(CAST(v AS HUGEINT)) || ':' || bit_xor(v)) AS fingerprint FROM h)
  SELECT rows, fingerprint, copy FROM f, (VALUES ('source'), ('reordered')) c(copy)"""


def overlap(spark, root):
    df = read(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    files = {"all": df, "finished": df.where("o_orderstatus = 'F'"), "again": df.select("*")}
    return combine.overlap_report(files, ["o_custkey", "o_orderstatus"])


OVERLAP_SQL = """WITH k AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)
  SELECT 3::BIGINT AS files, 1::BIGINT AS duplicate_files, (SELECT count(*) FROM k) + (SELECT count(*) FROM k WHERE o_orderstatus = 'F') AS overlapping_rows,
         false AS safe_to_merge"""


def shared(spark, root):
    """Customers with finished and with open orders, matched by row hash."""
    df = read(spark, root, "orders").select("o_custkey", "o_orderstatus")
    files = {s: df.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O")}
    return combine.shared_rows(files)


SHARED_SQL = """SELECT md5(CAST(o_custkey AS VARCHAR)) AS key FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"""


def with_future(spark, root):
    """Observed demand followed by shifted rows that carry a forecast only."""
    past = lenses.demand(spark, root).select("date", "store_id", "product_id", "units_sold")
    ahead = past.select(F.date_add("date", 3000).alias("date"), "store_id", F.col("units_sold").alias("forecast_value"))
    return combine.append_future(past, ahead)


FUTURE_SQL = f"""WITH {L.DEMAND} SELECT date, store_id, product_id, units_sold, NULL::DOUBLE AS forecast_value FROM demand
  UNION ALL SELECT date + 3000, store_id, NULL, NULL, units_sold FROM demand"""


def profiles(spark, root):
    """Company settings from the region table."""
    key, name = F.col("r_regionkey"), F.col("r_name")
    none = F.array().cast("array<string>")
    return read(spark, root, "region").select(
        F.concat(F.lit(" "), (key + 1).cast("string")).alias("company_id"), name.alias("currency"),
        (0.2 + key / 10).alias("review_threshold"), (0.5 + key / 10).alias("high_risk_threshold"),
        (key % 2 == 0).alias("require_human_approval"),
        F.when(key % 2 == 1, F.array(F.lit("Reduce EXPOSURE"), F.lit(" "))).otherwise(none).alias("forbidden_actions"),
        F.when(key > 0, F.array(F.lit("Send early reminders."), F.concat(F.lit("Follow the rules of "), name))).otherwise(none).alias("recommendation_rules"),
    )


def company_scores(spark, root):
    df = lenses.scores(spark, root).select("row_id", "company_id", F.col("p").alias("risk_score"))
    return scoring.company_tiers(combine.with_company_profile(df, profiles(spark, root)))


PROFILED = f"""{L.SCORES},
  prof AS (SELECT CAST(r_regionkey + 1 AS VARCHAR) AS company_id, r_name AS currency, 0.2::DOUBLE + r_regionkey / 10.0::DOUBLE AS review_threshold,
                  0.5::DOUBLE + r_regionkey / 10.0::DOUBLE AS high_risk_threshold, r_regionkey % 2 = 0 AS approval, r_regionkey AS rk FROM region),
  profiled AS (SELECT row_id, s.company_id, p AS risk_score, coalesce(currency, 'TND') AS currency, coalesce(review_threshold, 0.5) AS review_threshold,
                  coalesce(high_risk_threshold, 0.6) AS high_risk_threshold, coalesce(approval, true) AS require_human_approval, rk,
                  CASE WHEN p < coalesce(review_threshold, 0.5) THEN 'LOW_RISK' WHEN p < coalesce(high_risk_threshold, 0.6) THEN 'MEDIUM_RISK' ELSE 'HIGH_RISK' END AS risk_tier
               FROM scores s LEFT JOIN prof ON s.company_id = prof.company_id)"""


def company_tiers(spark, root):
    return company_scores(spark, root).select(
        "row_id", "company_id", "currency", "review_threshold", "high_risk_threshold", "require_human_approval", "risk_tier"
    )


COMPANY_SQL = f"""WITH {PROFILED} SELECT row_id, company_id, currency, review_threshold, high_risk_threshold, require_human_approval, risk_tier FROM profiled"""

UNIQUE_SQL = "SELECT DISTINCT o_custkey, o_orderstatus FROM orders"
KINDS_SQL = """SELECT column_name, 'plain' AS source, kind, (SELECT count(*) FROM orders) AS filled FROM (VALUES
  ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'text'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'text'))
  v(column_name, kind)"""

QUERIES = {
    "combine_files": combined,
    "combine_compatibility": compatible,
    "combine_many_files": combined_cells,
    "combine_cell_kinds": cell_structures,
    "combine_column_kinds": lambda s, r: combine.column_kinds(read(s, r, "orders")).select("column_name", F.lit("plain").alias("source"), "kind", "filled"),
    "combine_adapted_rollup": rolled,
    "combine_source_families": families,
    "combine_loan_files": loans,
    "combine_loan_notes": loan_notes,
    "combine_fingerprints": fingerprints,
    "combine_overlap": overlap,
    "combine_shared_rows": shared,
    "combine_future_rows": with_future,
    "combine_unique_rows": lambda s, r: combine.drop_repeated_rows(read(s, r, "orders").select("o_custkey", "o_orderstatus")),
    "join_company_profiles": company_tiers,
}
SQL = {
    "combine_files": COMBINED_SQL,
    "combine_compatibility": COMPATIBLE_SQL,
    "combine_many_files": COMBINED_CELLS_SQL,
    "combine_cell_kinds": CELL_STRUCTURES_SQL,
    "combine_column_kinds": KINDS_SQL,
    "combine_adapted_rollup": ROLLED_SQL,
    "combine_source_families": FAMILIES_SQL,
    "combine_loan_files": LOANS_SQL,
    "combine_loan_notes": LOAN_NOTES_SQL,
    "combine_fingerprints": FINGERPRINT_SQL,
    "combine_overlap": OVERLAP_SQL,
    "combine_shared_rows": SHARED_SQL,
    "combine_future_rows": FUTURE_SQL,
    "combine_unique_rows": UNIQUE_SQL,
    "join_company_profiles": COMPANY_SQL,
}
