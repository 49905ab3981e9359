"""Putting tables together: file unions, overlap, model outputs, company settings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.functions.values import NUMBER_TEXT, order_key, parse_date, safe_id, signature
from duecast.operators.features import loan_layout
from duecast.session import materialize

# Settings of a company without a profile.
PROFILE_DEFAULTS = {"currency": "TND", "language": "English", "review_threshold": 0.5, "high_risk_threshold": 0.6, "require_human_approval": True}

# Schema family per catalogued source, and header maps.
CATALOG = {
    "uci_credit_card": ("uci_credit_v1", {"ID": "client_id", "default.payment.next.month": "default_next_month"}),
    "german_credit": ("german_credit_v1", {}),
    "retail_sku_weekly": (
        "retail_sku_weekly_v1", {"week": "date", "SKU": "product_id", "weekly sales": "units_sold", "vendor": "store_id"}
    ),
    "retail_transactions": (
        "retail_transactions_v1",
        {
            "Transaction ID": "transaction_id", "Date": "date", "Product Category": "category", "Quantity": "units_sold",
            "Price per Unit": "price", "Total Amount": "revenue",
        },
    ),
}


def plain_name(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", header.strip().lower())


def clean_headers(df: DataFrame) -> DataFrame:
    """Trimmed headers without unnamed columns; a table without rows is refused. [S2]"""
    named = df.toDF(*[c.strip() for c in df.columns])
    kept = named.drop(*[c for c in named.columns if c.lower().startswith("unnamed:")])
    if kept.isEmpty():
        raise ValueError("Nothing but headers was read.")
    return kept


def column_kinds(df: DataFrame, share: float = 0.95) -> DataFrame:
    """numeric, datetime, text or empty per column, from one aggregate. [A18]"""
    exprs, rows = [], []
    for i, c in enumerate(df.columns):
        text = F.col(c).cast("string")
        exprs += [
            F.count(text).alias(f"n{i}"), F.count_if(text.rlike(NUMBER_TEXT)).alias(f"num{i}"),
            F.count_if(parse_date(text).isNotNull()).alias(f"day{i}"),
        ]
        n = F.col(f"n{i}")
        kind = F.when(n == 0, "empty").when(F.col(f"num{i}") >= share * n, "numeric").when(F.col(f"day{i}") >= share * n, "datetime")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(plain_name(c)).alias("key"), kind.otherwise("text").alias("kind"), n.alias("filled"), F.col("rows")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *exprs).select(F.inline(F.array(*rows)))


def structures(kinds: DataFrame) -> DataFrame:
    """(file, rows, found) per file from (file, rows, key, column_name, kind); ``found`` lists the file's columns. [S5]"""
    return kinds.groupBy("file").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("key", "column_name", "kind"))).alias("found"))


def compare_structures(found: DataFrame, first: str) -> DataFrame:
    """Columns and kinds of each file against those of the file ``first``, one row per file. [S5]"""
    base = found.where(F.col("file") == first).select("found").scalar()
    compared = found.withColumn("expected", base)
    here, there = F.col("found"), F.col("expected")

    def only(left: Column, right: Column) -> Column:
        lone = F.filter(left, lambda x: ~F.exists(right, lambda y: y["key"] == x["key"]))
        return F.array_sort(F.transform(lone, lambda x: x["column_name"]))

    def differ(x: Column, y: Column) -> Column:
        return (x["key"] == y["key"]) & (x["kind"] != y["kind"]) & (x["kind"] != "empty") & (y["kind"] != "empty")

    def clashes(x: Column) -> Column:
        return F.transform(F.filter(here, lambda y: differ(x, y)), lambda y: F.concat(y["column_name"], F.lit(": expected "), x["kind"], F.lit(", found "), y["kind"]))

    clash = F.array_sort(F.flatten(F.transform(there, clashes)))
    compared = compared.withColumns({"missing": only(there, here), "extra": only(here, there), "clash": clash})
    return compared.select(
        "file", "rows", F.size("found").alias("columns"), ((F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("clash") == 0)).alias("compatible"),
        F.array_join("missing", ", ").alias("missing_columns"), F.array_join("extra", ", ").alias("extra_columns"), F.array_join("clash", "; ").alias("type_mismatches"),
    )


def compatibility(files: Mapping[str, DataFrame]) -> DataFrame:
    """Columns and kinds of each file against the first one, one row per file. [S5]

    The structures of all files are found by one job, whatever their number; nothing of them passes the driver.
    """
    kinds = [column_kinds(df).withColumn("file", F.lit(name)) for name, df in files.items()]
    return compare_structures(materialize(structures(_union(kinds)), "structures"), next(iter(files)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def combine_files(files: Mapping[str, DataFrame]) -> DataFrame:
    """Files of one structure appended in the first file's column order, tagged ``_source_file``. [S4, U1]"""
    if not all(r["compatible"] for r in compatibility(files).select("compatible").collect()):
        raise ValueError("The files do not have the same structure.")
    first = next(iter(files.values()))
    parts = []
    for name, df in files.items():
        by_key = {plain_name(c): c for c in df.columns}
        parts.append(df.select(*[F.col(by_key[plain_name(c)]).alias(c) for c in first.columns], F.lit(name).alias("_source_file")))
    return _union(parts)


def cell_kinds(cells: DataFrame, headers: DataFrame, share: float = 0.95) -> DataFrame:
    """(file, rows, key, column_name, kind) of every column of many files, from one pass over their cells. [S5, A18]

    ``cells`` has (file, cells), ``headers`` (file, header); cells are counted per file and position with map-side combining.
    """
    value = F.col("value")
    counts = cells.select("file", F.posexplode("cells").alias("position", "value")).groupBy("file", "position").agg(
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), F.count_if(value.rlike(NUMBER_TEXT)).alias("numbers"), F.count_if(parse_date(value).isNotNull()).alias("days")
    )
    named = headers.select("file", F.posexplode("header").alias("position", "column_name")).where(F.col("column_name").isNotNull())
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "empty").when(F.col("numbers") >= share * n, "numeric").when(F.col("days") >= share * n, "datetime").otherwise("text")
    return named.join(counts, ["file", "position"], "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), plain_key(F.col("column_name")).alias("key"), "column_name", kind.alias("kind"))


def plain_key(header: Column) -> Column:
    """``plain_name`` as an expression."""
    return F.regexp_replace(F.lower(F.trim(header)), "[^a-z0-9]+", "")


def combine_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of many files under the columns of the file whose name comes first, tagged ``_source_file``. [S4, U1]

    Every cell finds its column by the header of its own file; the number of jobs and of plan branches does not grow with the files.
    """
    found = materialize(structures(cell_kinds(cells, headers)), "structures")
    first = headers.orderBy("file").first()
    if first is None:
        raise ValueError("No file was read.")
    if not compare_structures(found, first["file"]).where("not compatible").isEmpty():
        raise ValueError("The files do not have the same structure.")
    keyed = headers.select("file", F.transform("header", plain_key).alias("_keys"))
    named = cells.join(keyed, "file")
    columns = [F.get("cells", F.array_position("_keys", F.lit(plain_name(c))).cast("int") - 1).alias(c.strip()) for c in first["header"] if c is not None]
    return named.select(*columns, F.col("file").alias("_source_file"))


def append_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """History and future rows in one table; cells a side lacks are NULL. [U2]"""
    return history.unionByName(future, allowMissingColumns=True)


def adapt_source(df: DataFrame, source: str) -> DataFrame:
    """Headers of a catalogued source renamed, and the source tagged. [S9]"""
    _, mapping = CATALOG[source]
    named = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    return named.toDF(*[c.strip() for c in named.columns]).withColumn("dataset_source", F.lit(source))


def source_families(df: DataFrame) -> DataFrame:
    """Rows per source and schema family. [S10]"""
    families = df.sparkSession.createDataFrame([(k, v[0]) for k, v in CATALOG.items()], "dataset_source string, family string")
    # The catalog is a constant of four rows.
    return df.groupBy("dataset_source").count().join(F.broadcast(families), "dataset_source", "left").withColumnRenamed("count", "rows")


def require_one_family(df: DataFrame) -> str:
    """The family all rows belong to; unknown or mixed sources raise. [S10]"""
    found = source_families(df).agg(F.collect_set("family").alias("families"), F.count_if(F.col("family").isNull()).alias("unknown")).first()
    if found["unknown"] or len(found["families"]) != 1:
        raise ValueError(f"Rows of different schema families cannot be trained together: {sorted(found['families'])}")
    return found["families"][0]


def combine_loans(files: Mapping[str, DataFrame], order: str = "row_id") -> DataFrame:
    """Loan files in the loan contract, one row per LoanID: the first by file and row. [S13, U4]

    Files without an outcome column are skipped; ``loan_file_notes`` names them. The first row is a map-side combined minimum.
    """
    parts = []
    for position, (_, df) in enumerate(files.items()):
        if "loan_status" not in df.columns:
            continue
        marked = loan_layout(df, carry={"_order": F.struct(F.lit(position).alias("file"), F.col(order).alias("row"))})
        parts.append(marked)
    if not parts:
        raise ValueError("No file with repayment outcomes was given.")
    return drop_repeated_keys(_union(parts), ["LoanID"], F.col("_order")).drop("_order")


def loan_file_notes(files: Mapping[str, DataFrame]) -> DataFrame:
    """(position, file, used, rows, loans, note) of every file given to ``combine_loans``, skipped ones included. [S13]"""
    parts = []
    for position, (name, df) in enumerate(files.items()):
        used = "loan_status" in df.columns
        loans = F.count_distinct("LoanID") if used else F.lit(0).cast("bigint")
        rows = (loan_layout(df) if used else df).agg(F.count("*").alias("loans_read"), loans.alias("loans"))
        total = df.agg(F.count("*").alias("rows"))
        note = F.concat(F.lit("Used: "), F.col("loans_read").cast("string"), F.lit(" rows with a known outcome.")) if used else F.lit("Skipped: no repayment outcome in this file.")
        parts.append(rows.select(F.lit(position).alias("position"), F.lit(name).alias("file"), F.lit(used).alias("used"), total.scalar().alias("rows"), "loans", note.alias("note")))
    return _union(parts)


def drop_repeated_keys(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row per key in the given order. [U4]"""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), order).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """[U3]"""
    return df.dropDuplicates()


def fingerprint(df: DataFrame, identity: Sequence[str] | None = None) -> DataFrame:
    """A table's fingerprint that does not depend on row order, one row. [A19]

    Row hashes are combined with a sum and an exclusive or, so there is no global sort.
    """
    columns = [c for c in (identity or df.columns) if c in df.columns] or df.columns
    row = order_key([signature([F.col(c) for c in columns])], 0)
    parts = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("mixed"),
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("total").cast("string"), F.col("mixed").cast("string"))
    return parts.select("rows", F.sha2(text, 256).alias("fingerprint"))


def _row_keys(files: Mapping[str, DataFrame], identity: Sequence[str] | None) -> DataFrame:
    parts = []
    for name, df in files.items():
        columns = identity if identity and all(c in df.columns for c in identity) else df.columns
        parts.append(df.select(F.md5(signature([F.col(c) for c in columns])).alias("key"), F.lit(name).alias("file")))
    return _union(parts)


def shared_rows(files: Mapping[str, DataFrame], identity: Sequence[str] | None = None) -> DataFrame:
    """Row hashes that occur in every one of the files. [U5]"""
    keys = _row_keys(files, identity).groupBy("key").agg(F.count_distinct("file").alias("files"))
    return keys.where(F.col("files") == len(files)).select("key")


def overlap_report(files: Mapping[str, DataFrame], identity: Sequence[str] | None = None) -> DataFrame:
    """Identical files and rows that an earlier file already holds. [J5]"""
    prints = _union([fingerprint(df, identity) for df in files.values()])
    per_row = _row_keys(files, identity).groupBy("key").agg((F.count_distinct("file") - 1).alias("again"))
    rows = per_row.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("n"))
    copies = prints.agg((F.count("*") - F.count_distinct("fingerprint")).alias("n"))
    return prints.agg(F.count("*").alias("files")).select(
        "files", copies.scalar().alias("duplicate_files"), rows.scalar().alias("overlapping_rows")
    ).withColumn("safe_to_merge", (F.col("duplicate_files") == 0) & (F.col("overlapping_rows") == 0))


def roll_up_transactions(df: DataFrame) -> DataFrame:
    """Transactions to units and revenue per date and category. [A20]"""
    return df.groupBy("date", "category").agg(F.sum("units_sold").alias("units_sold"), F.sum("revenue").alias("revenue"))


def with_company_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Company settings joined by the safe company id, with defaults where none are stored. [J6]

    Catalyst broadcasts the profiles while their size is below its threshold.
    """
    settings = profiles.select(
        safe_id(F.col("company_id")).alias("_company"), *[F.col(c).alias(f"_p_{c}") for c in profiles.columns if c != "company_id"]
    )
    joined = df.join(settings, safe_id(F.col("company_id")) == F.col("_company"), "left")
    made = {n: F.coalesce(F.col(f"_p_{n}"), F.lit(v)) if n in profiles.columns else F.lit(v) for n, v in PROFILE_DEFAULTS.items()}
    for name in ("forbidden_actions", "recommendation_rules"):
        none = F.array().cast("array<string>")
        made[name] = F.coalesce(F.col(f"_p_{name}"), none) if name in profiles.columns else none
    return joined.withColumns(made).select(*df.columns, *made)


# The decision for a pair of tiers.
STATUS_REASONS = {
    "UNAVAILABLE": "No compatible model input was supplied.",
    "ANY_HIGH": "At least one internal model reports high risk.",
    "BOTH_MEDIUM": "Both internal models report medium risk.",
    "ANY_MEDIUM": "At least one internal model reports medium risk.",
    "ALL_LOW": "All available internal models report low risk.",
}


def combine_assessments(behaviour: DataFrame, loans: DataFrame) -> DataFrame:
    """Two model outputs by client, with the joint decision. [J3, M24]

    ``behaviour`` has client_id, behavior_probability, behavior_tier; ``loans`` has client_id,
    loan_probability, loan_tier. A client may be in either or both.
    """
    joined = behaviour.join(loans, "client_id", "full")
    tiers = [F.col("behavior_tier"), F.col("loan_tier")]

    def any_is(tier: str) -> Column:
        return F.coalesce(tiers[0] == tier, F.lit(False)) | F.coalesce(tiers[1] == tier, F.lit(False))

    both_medium = F.coalesce((tiers[0] == "MEDIUM_RISK") & (tiers[1] == "MEDIUM_RISK"), F.lit(False))
    case = (
        F.when(tiers[0].isNull() & tiers[1].isNull(), "UNAVAILABLE").when(any_is("HIGH_RISK"), "ANY_HIGH").when(both_medium, "BOTH_MEDIUM")
        .when(any_is("MEDIUM_RISK"), "ANY_MEDIUM").otherwise("ALL_LOW")
    )
    status = (
        F.when(F.col("_case") == "UNAVAILABLE", "UNAVAILABLE").when(F.col("_case").isin("ANY_HIGH", "BOTH_MEDIUM"), "MANUAL_REVIEW")
        .when(F.col("_case") == "ANY_MEDIUM", "REVIEW_RECOMMENDED").otherwise("STANDARD_PROCESS")
    )
    reasons = F.create_map(*[F.lit(x) for pair in STATUS_REASONS.items() for x in pair])
    used = F.array_compact(
        F.array(
            F.when(F.col("behavior_probability").isNotNull(), "Payment behavior"), F.when(F.col("loan_probability").isNotNull(), "Loan profile")
        )
    )
    return joined.withColumn("_case", case).withColumns(
        {"final_status": status, "decision_reason": F.element_at(reasons, F.col("_case")), "models_used": F.array_join(used, " + ")}
    ).drop("_case")
