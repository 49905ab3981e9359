"""Column profiles, roles, drift, contracts and cleaning driven by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.functions.values import as_double, NUMBER_TEXT, number, parse_date
from duecast.operators.combine import plain_name
from duecast.operators.quality import _issue_rows, missing_cells, with_repeats
from duecast.operators.quantiles import exact_quantiles, modes, value_counts
from duecast.operators.sketches import EXACT, WHOLE, Facts, column_facts
from duecast.operators.skew import ROWS_PER_TASK, fill_known
from duecast.session import materialize

BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]

# Words that decide a column's role, in the order they are tried.
TARGET_WORDS = [
    "target", "label", "outcome", "result", "default", "churn", "fraud", "risk", "is_late", "late", "delinquent",
]
LEAK_WORDS = ["clear", "settle", "settlement", "paid_date", "actual", "realized", "realised"]
ID_WORDS = ["id", "key", "code", "identifier", "uuid"]
MONEY_WORDS = [
    "amount", "balance", "payment", "invoice", "price", "sales", "revenue", "cost", "profit", "quantity", "units", "terms",
    "credit", "debit", "rate", "margin", "ratio", "score",
]
SAFE_DATE_WORDS = ["due", "invoice", "posting", "create", "period", "fiscal", "year", "quarter", "month"]
DATE_WORDS = ["date", "time", "timestamp"]
IGNORE_WORDS = ["note", "comment", "description", "text", "name"]
PREFERRED_TARGETS = ["is_late", "target", "label", "outcome", "default", "default_next_month", "fraud", "churn"]
OUTCOME_TERMS = [
    "clear_date", "clearing_date", "settlement_date", "paid_date", "payment_date", "days_late", "delay_days", "final_status",
    "actual_payment", "realized", "realised",
]
PURE_ID_TERMS = ["doc_id", "invoice_id", "transaction_id", "uuid", "row_id"]
SAFE_DATE_TERMS = [
    "posting_date", "document_create_date", "baseline_create_date", "due_in_date", "due_date", "invoice_date",
]

# Columns that are outcomes or identifiers in an input contract, and the role texts.
CONTRACT_OUTCOMES = ["is_late", "default_next_month", "clear_date", "clearing_date", "payment_date", "isopen", "is_open"]
CONTRACT_IDENTIFIERS = ["cust_number", "customer_id", "client_id", "doc_id", "invoice_id", "posting_id"]
CONTRACT_ROLES = {
    "outcome": "training outcome / excluded at prediction",
    "identifier": "identifier / traceability",
    "input": "prediction input",
    "other": "training source / excluded by administrator or governance",
}

# Accepted header spellings per contract field.
FIELD_ALIASES = {
    "client_id": ["id", "clientid", "customerid", "accountid", "customer_id", "client_id"],
    "default_next_month": ["defaultpaymentnextmonth", "default_next_month", "defaultnextmonth", "target", "default"],
    "date": ["date", "salesdate", "transactiondate", "orderdate"],
    "store_id": ["storeid", "store", "branchid", "locationid"],
    "product_id": ["productid", "product", "itemid", "item", "sku"],
    "category": ["category", "productcategory", "department"],
    "region": ["region", "area", "territory"],
    "units_sold": ["unitssold", "sales", "quantitysold", "quantity", "demand"],
    "inventory_level": ["inventorylevel", "inventory", "stock", "stocklevel"],
    "promotions_holidays": ["promotionsholidays", "holidaypromotion", "holidaypromotionflag", "promotion", "promo", "discount"],
    "weather_conditions": ["weatherconditions", "weathercondition", "weather", "climate"],
    "price": ["price", "unitprice", "sellingprice"],
    "units_ordered": ["unitsordered", "orderedunits", "quantityordered"],
}


def _any(words: Sequence[str], text: str) -> bool:
    return any(w in text for w in words)


#: Rows looked at first for a column's first values.
HEAD_ROWS = 1000


def _kind(facts: Facts) -> str:
    filled, unique, numeric = facts.filled, facts.distinct, facts.measures["numeric"]
    if not filled:
        return "string"
    if numeric > 0.8 * filled:
        return "integer" if facts.measures["integer"] == numeric else "number"
    if 10 < unique < 0.9 * filled:
        return "date" if facts.measures["date"] > 0.8 * filled else "string"
    if unique <= 2 and facts.measures["boolean"] == filled:
        return "boolean"
    return "categorical" if unique <= 20 else "string"


def _shapes(cell: Column, kind: str) -> dict[str, Column]:
    """What a cell's text looks like; for numbers, dates and truth values this follows from the value."""
    yes, no = F.lit(True), F.lit(False)
    if kind in WHOLE:
        compact = F.when(cell.between(10_000_101, 99_991_231), F.try_to_timestamp(cell.cast("string"), F.lit("yyyyMMdd")).isNotNull()).otherwise(no)
        return {"numeric": yes, "integer": yes, "date": compact, "boolean": cell.isin(0, 1)}
    if kind in ("float", "double"):
        return {"numeric": ~F.isnan(cell) & (F.abs(cell) < float("inf")), "integer": cell % 1 == 0, "date": no, "boolean": no}
    if kind == "boolean":
        return {"numeric": no, "integer": no, "date": no, "boolean": yes}
    if kind != "string":
        return {"numeric": no, "integer": no, "date": yes, "boolean": no}
    numeric = cell.rlike(NUMBER_TEXT)
    return {
        "numeric": numeric, "integer": F.when(numeric, cell.try_cast("double") % 1 == 0).otherwise(no),
        "date": parse_date(cell).isNotNull(), "boolean": F.lower(cell).isin(BOOLEAN_WORDS),
    }


def profile(df: DataFrame, row_id: str | None = None, samples: int = 5, exact_up_to: int = EXACT) -> DataFrame:
    """One row per column: type, counts and shares; with ``row_id`` also the first values. [A12]

    Distinct values beyond ``exact_up_to`` are estimates unless they lie near a limit of the kinds or of the governance rules,
    so kinds and roles follow exact counts; ``unique_is_exact`` tells which.
    """
    columns = [c for c in df.columns if c != row_id]
    facts = column_facts(df, columns, _shapes, limits=lambda f: (0.9 * f.filled, 0.95 * f.rows, 0.02 * f.rows), exact_up_to=exact_up_to)
    rows = []
    for i, c in enumerate(columns):
        f = facts[c]
        share = {n: round(f.measures[n] / f.filled, 6) if f.filled else 0.0 for n in ("numeric", "date")}
        rows.append((i, c, _kind(f), f.rows, f.rows - f.filled, f.distinct, share["numeric"], share["date"], f.exact))
    out = df.sparkSession.createDataFrame(
        rows, "position int, column_name string, kind string, rows bigint, missing_count bigint, unique_count bigint, numeric_share double, date_share double, unique_is_exact boolean"
    )
    return out if row_id is None else out.join(_first_values(df, columns, row_id, samples), "column_name", "left")


def _first_values(df: DataFrame, columns: Sequence[str], row_id: str, samples: int) -> DataFrame:
    """(column_name, samples): each column's first values in row order, from the first rows where these hold enough."""
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    shown: dict[str, list[str]] = {c: [] for c in columns}
    for r in df.orderBy(row_id).limit(HEAD_ROWS).select(*text).collect():
        for c in columns:
            if r[c] is not None and len(shown[c]) < samples:
                shown[c].append(r[c])
    sparse = [c for c in columns if len(shown[c]) < samples]
    if sparse:
        # The limit reaches every task: only a few cells per task and column move.
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in sparse])
        first = F.row_number().over(Window.partitionBy("column_name").orderBy(row_id))
        head = df.select(row_id, F.inline(cells)).where("value is not null").withColumn("_n", first).where(F.col("_n") <= samples)
        for c in sparse:
            shown[c] = []
        for r in head.orderBy("column_name", "_n").collect():
            shown[r["column_name"]].append(r["value"])
    return df.sparkSession.createDataFrame([(c, v or None) for c, v in shown.items()], "column_name string, samples array<string>")


def _first_role(name: str, kind: str) -> str:
    text = name.lower()
    if _any(TARGET_WORDS, text):
        return "target"
    if _any(LEAK_WORDS, text):
        return "ignore"
    if _any(ID_WORDS, text):
        return "id"
    if _any(MONEY_WORDS, text) or (kind == "date" and _any(SAFE_DATE_WORDS, text)):
        return "feature"
    if kind == "date" or _any(DATE_WORDS, text):
        return "datetime"
    return "ignore" if _any(IGNORE_WORDS, text) else "feature"


def _governed(name: str, rows: int, unique: int, missing: int) -> tuple[bool, str]:
    """(excluded, reason) from measured facts and from names that hold outcomes or ids."""
    key, share = name.strip().lower().replace(" ", "_"), unique / max(rows, 1)
    if missing >= 0.98 * rows or unique <= 1:
        return True, "empty or constant"
    if _any(OUTCOME_TERMS, key):
        return True, "outcome"
    if any(t == key or key.endswith("_" + t) for t in PURE_ID_TERMS):
        return True, "identifier"
    if share >= 0.95:
        return True, "nearly unique"
    if "name" in key and share > 0.02:
        return True, "name"
    return False, "safe date" if _any(SAFE_DATE_TERMS, key) else "usable"


def roles(profiled: DataFrame) -> DataFrame:
    """Target, features and excluded columns, and the task. [C1, C2]

    ``profiled`` has one row per column, so the name rules run on the driver.
    """
    rows = [r.asDict() for r in profiled.orderBy("position").collect()]
    for r in rows:
        r["role"] = _first_role(r["column_name"], r["kind"])
    targets = [r for r in rows if r["role"] == "target"]
    preferred = [r for r in rows if r["column_name"].strip().lower() in PREFERRED_TARGETS]
    if preferred:
        targets = preferred[:1]
    if not targets:
        binary = [r for r in rows if r["kind"] in ("integer", "boolean") and r["unique_count"] == 2]
        numeric = [r for r in rows if r["kind"] in ("integer", "number")]
        targets = binary[:1] or (numeric[-1:] if len(numeric) > 1 else [])
    target = targets[0] if targets else None
    regression = target is not None and (target["kind"] == "number" or target["unique_count"] > 10)
    out = []
    for r in rows:
        if r is target:
            out.append((r["position"], r["column_name"], r["kind"], "target", "target"))
            continue
        excluded, reason = _governed(r["column_name"], r["rows"], r["unique_count"], r["missing_count"])
        gone = reason in ("empty or constant", "outcome")
        out.append((r["position"], r["column_name"], r["kind"], ("ignore" if gone else "id") if excluded else "feature", reason))
    table = profiled.sparkSession.createDataFrame(out, "position int, column_name string, kind string, role string, reason string")
    return table.withColumn("task", F.lit("regression" if regression else "classification"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed columns between two profiles, with the change in missing share and distinct values. [C3]"""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        share = F.try_divide(F.col("missing_count"), F.col("rows"))
        return df.select("column_name", F.col("kind").alias(f"{prefix}_kind"), share.alias(f"{prefix}_missing"), F.col("unique_count").alias(f"{prefix}_unique"))

    joined = side(before, "old").join(side(after, "new"), "column_name", "full")
    status = (
        F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed")
        .when(F.col("old_kind") != F.col("new_kind"), "kind changed").otherwise("same")
    )
    return joined.select(
        "column_name", status.alias("status"), "old_kind", "new_kind", F.round(F.col("new_missing") - F.col("old_missing"), 6).alias("missing_change"),
        (F.col("new_unique") - F.col("old_unique")).alias("unique_change"),
    )


def drift_against_versions(versions: DataFrame, current: DataFrame, task: str) -> DataFrame:
    """Drift of the current profile against the latest accepted version of a task. [C4]

    ``versions`` holds the profile rows of every version with ``task``, ``version`` and ``created_at``.
    """
    mine = versions.where(F.col("task") == task)
    latest = mine.agg(F.max_by("version", "created_at")).scalar()
    return drift(mine.where(F.col("version") == latest), current)


# ---------------------------------------------------------------------------
# Contracts [C6, C11, C14, C15, C17, C18]
# ---------------------------------------------------------------------------


def _family(name: str) -> str:
    """Fields of different families are never matched with each other."""
    key = plain_name(name)
    if key in ("pay0", "pay2", "pay3", "pay4", "pay5", "pay6"):
        return "status"
    for prefix in ("payamt", "billamt"):
        if key.startswith(prefix) and key[len(prefix):] in ("1", "2", "3", "4", "5", "6"):
            return prefix
    for field in ("client_id", "default_next_month"):
        if key in {plain_name(a) for a in FIELD_ALIASES[field]}:
            return field
    return "general"


def resolve_headers(columns: Sequence[str], wanted: Sequence[str]) -> dict[str, str]:
    """Source header per field: exact matches first, then aliases; a header serves one field only. [C6]"""
    found: dict[str, str] = {}
    for accept in (lambda f: {plain_name(f)}, lambda f: {plain_name(a) for a in FIELD_ALIASES.get(f, [])}):
        for field in wanted:
            if field in found:
                continue
            names = accept(field)
            match = next(
                (c for c in columns if c not in found.values() and plain_name(c) in names and _family(field) in ("general", _family(c))), None
            )
            if match is not None:
                found[field] = match
    return found


def _coerced(cell: Column, kind: str, source: str) -> Column:
    if kind == "string":
        return cell.cast("string")
    if kind == "date":
        return parse_date(cell.cast("string"))
    value = number(cell) if source == "string" else cell.cast("double")
    return value.try_cast("int") if kind == "integer" else value


def conform(df: DataFrame, kinds: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """The table under the contract's names and types, and per field the cells the type rejected. [C6]

    Fields without a source column are not invented: they are left out and reported.
    """
    found, types = resolve_headers(df.columns, list(kinds)), dict(df.dtypes)
    typed = {f: _coerced(F.col(c), kinds[f], types[c]) for f, c in found.items()}
    table = df.select(*[v.alias(f) for f, v in typed.items()])
    counts = [F.count_if(F.col(found[f]).isNotNull() & v.isNull()).alias(f"r_{f}") for f, v in typed.items()]
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.lit(found.get(f)).cast("string").alias("source_column"),
            (F.col(f"r_{f}") if f in found else F.lit(None)).cast("bigint").alias("rejected_cells"),
        )
        for f in kinds
    ]
    return table, df.agg(F.count("*").alias("rows"), *counts).select("rows", F.inline(F.array(*rows)))


def align_headers(df: DataFrame, required: Sequence[str], ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Headers renamed to the contract's spelling, and issues for missing and extra columns. [C14]"""
    by_key = {plain_name(c): c for c in df.columns}
    rename = {by_key[plain_name(f)]: f for f in [*required, *ids] if f not in df.columns and plain_name(f) in by_key}
    aligned = df.withColumnsRenamed(rename)
    missing = [f for f in required if f not in aligned.columns]
    extra = [c for c in aligned.columns if c not in [*required, *ids]]
    checks = [("error", "missing_column", c, F.lit(True), F.lit(0)) for c in missing]
    checks += [("info", "extra_column", c, F.lit(True), F.lit(0)) for c in extra]
    checks.append(("error", "empty", "", F.col("rows") == 0, F.lit(0)))
    return aligned, _issue_rows(df.agg(F.count("*").alias("rows")), checks)


def input_contract(profiled: DataFrame, used: Sequence[str], target: str, meanings: Mapping[str, str] | None = None) -> DataFrame:
    """What a model expects of each source column, from a profile with samples. [C11]"""
    key = F.replace(F.lower(F.trim("column_name")), F.lit(" "), F.lit("_"))
    role = (
        F.when(key.isin([target.lower(), *CONTRACT_OUTCOMES]), CONTRACT_ROLES["outcome"])
        .when(key.isin(CONTRACT_IDENTIFIERS) | key.endswith("_id"), CONTRACT_ROLES["identifier"])
        .when(F.col("column_name").isin(list(used)), CONTRACT_ROLES["input"])
        .otherwise(CONTRACT_ROLES["other"])
    )
    texts = [x for pair in (meanings or {}).items() for x in (F.lit(pair[0]), F.lit(pair[1]))]
    meaning = F.coalesce(F.try_element_at(F.create_map(*texts), F.col("column_name")), F.lit("")) if texts else F.lit("")
    examples = F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 3)
    required = F.col("column_name").isin(list(used)) & (F.col("column_name") != target)
    return profiled.select(
        F.col("column_name").alias("name"), F.col("kind").alias("dtype"), required.alias("required"), F.coalesce(F.get(examples, F.lit(0)), F.lit("")).alias("example"),
        examples.alias("examples"), F.col("position").alias("source_order"), role.alias("role"), meaning.alias("meaning"), required.alias("used_by_model"),
    )


def _sources(columns: Sequence[str], features: Sequence[str]) -> dict[str, tuple[str, str | None] | None]:
    """Where each feature comes from: (column, None) for a column of that name, (column, category) for a
    ``column_category`` indicator, None where neither is there. The longest column name that fits is the one meant."""
    named: dict[str, str] = {}
    for column in columns:
        named[plain_name(column)] = column

    def source(feature: str) -> tuple[str, str | None] | None:
        if feature in columns:
            return feature, None
        if plain_name(feature) in named:
            return named[plain_name(feature)], None
        text = feature.strip()
        cuts = [i for i in range(len(text) - 2, 0, -1) if text[i] == "_" and plain_name(text[:i]) in named]
        return (named[plain_name(text[: cuts[0]])], text[cuts[0] + 1 :]) if cuts else None

    return {feature: source(feature) for feature in features}


def raw_features(columns: Sequence[str], features: Sequence[str]) -> list[str]:
    """The source column behind each feature; a feature without one keeps its own name."""
    return list(dict.fromkeys(feature if found is None else found[0] for feature, found in _sources(columns, features).items()))


def align_to_model(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """(model inputs, missing features, rebuilt indicators); ``parent_category`` indicators come from raw columns. [C15]"""
    found = _sources(df.columns, features)

    def made(feature: str, column: str, category: str | None) -> Column:
        cell = F.col(f"`{column}`")
        if category is not None:
            cell = (F.trim(F.coalesce(cell.cast("string"), F.lit(""))) == category).cast("tinyint")
        return cell.alias(feature)

    present = [made(feature, *where) for feature, where in found.items() if where is not None]
    return df.select(*keep, *present), [f for f, where in found.items() if where is None], [f for f, where in found.items() if where and where[1] is not None]


def model_input(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns; a missing one raises. [C18]"""
    aligned, missing, _ = align_to_model(df, features, keep)
    if missing:
        raise ValueError("The model was trained with columns that are absent: " + ", ".join(missing))
    return aligned


def check_for_model(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Issues of a table about to be scored, one aggregate. [C17]"""
    aligned, missing, rebuilt = align_to_model(df, features)
    present = [f for f in features if f not in missing]
    values = {f: aligned_column(df, f) for f in present if f not in rebuilt}
    facts = df.agg(
        F.count("*").alias("rows"),
        F.sum(missing_cells(df)).alias("cells"), *[F.count_if(v.isNull()).alias(f"m_{f}") for f, v in values.items()],
    )
    checks = [
        ("error", "empty", "", F.col("rows") == 0, F.lit(0)),
        ("error", "missing_model_features", "", F.lit(bool(missing)), F.lit(len(missing))),
        ("info", "legacy_categories_encoded", "", F.lit(bool(rebuilt)), F.lit(len(rebuilt))),
        ("warning", "duplicates", "", F.col("duplicates") > 0, F.col("duplicates")),
    ]
    checks += [("warning", "missing_values", f, F.col(f"m_{f}") > 0, F.col(f"m_{f}")) for f in values]
    return _issue_rows(with_repeats(facts, df), checks)


def aligned_column(df: DataFrame, feature: str) -> Column:
    by_key = {plain_name(c): c for c in df.columns}
    return F.col(f"`{feature if feature in df.columns else by_key[plain_name(feature)]}`")


# ---------------------------------------------------------------------------
# Cleaning [Q11, Q12, A13, A14]
# ---------------------------------------------------------------------------


def _fill_values(df: DataFrame, numeric: Sequence[str], other: Sequence[str]) -> dict[str, float | str]:
    values: dict[str, float | str] = {}
    if numeric:
        found = exact_quantiles(df, {c: as_double(df, c) for c in numeric}, [0.5])
        values.update({c: v[0] for c, v in found.items() if v[0] is not None})
    if other:
        most = {r["column_name"]: r["mode"] for r in modes(df, other).collect()}  # one row per column
        values.update({c: most.get(c, "unknown") for c in other})
    return values


def auto_clean(df: DataFrame, roles_table: DataFrame, row_id: str, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Repeated rows removed, gaps filled, outliers of features capped, types set; the target is left as it is. [Q11]

    ``row_id`` orders the rows, tells them apart, and is carried along; rows are repeated when all other cells agree. The
    de-duplicated table is written once; everything after reads that.
    """
    info = {r["column_name"]: r for r in roles_table.collect()}  # one row per column
    columns = [c for c in df.columns if c != row_id]
    unique = df.groupBy(*columns).agg(F.min(row_id).alias(row_id), F.count("*").alias("_copies"))
    open_columns = [c for c in columns if c in info and info[c]["role"] != "target"]
    numeric = [c for c in open_columns if info[c]["kind"] in ("integer", "number")]
    dates = [c for c in open_columns if info[c]["kind"] == "date"]
    other = [c for c in open_columns if c not in numeric and c not in dates]
    typed = unique.withColumns({c: as_double(unique, c) for c in numeric}).withColumns(
        {c: F.col(c) if dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else parse_date(F.col(c).cast("string")) for c in dates}
    )
    copies = materialize(typed, "unique-rows")
    typed = copies.select(*df.columns)
    values = _fill_values(typed, numeric, other)
    kinds = dict(typed.dtypes)
    filled = typed.withColumns(
        {c: F.coalesce(F.col(c), F.lit(values[c]).cast(kinds[c])) for c in [*numeric, *other] if c in values}
    )
    capped = [c for c in numeric if info[c]["role"] == "feature"]
    quartiles = exact_quantiles(filled, {c: F.col(c) for c in capped}, [0.25, 0.75]) if capped else {}
    bounds = {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in quartiles.items() if a is not None}
    gaps = sum((F.count_if(F.col(c).isNull()) for c in open_columns), F.lit(0))
    outliers = sum((F.count_if((values_of < lo) | (values_of > hi)) for values_of, lo, hi in ((F.coalesce(F.col(c), F.lit(values.get(c))), *b) for c, b in bounds.items())), F.lit(0))
    report = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("original_rows"), F.count("*").alias("final_rows"), gaps.alias("missing_values_filled"),
        outliers.alias("outliers_handled"), F.lit(len(numeric)).alias("type_conversions"),
    ).withColumn("duplicates_removed", F.col("original_rows") - F.col("final_rows"))
    if dates:
        filled = fill_known(filled, dates, [row_id], rows_per_task)
    clipped = {c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()}
    # A whole-number column stays whole unless a fill value or bound brings in fractions.
    used = {c: [*bounds.get(c, ()), *([values[c]] if c in values else [])] for c in numeric}
    whole = [c for c in numeric if info[c]["kind"] == "integer" and all(float(v).is_integer() for v in used[c])]
    return filled.withColumns(clipped).withColumns({c: F.col(c).cast("bigint") for c in whole}), report


def preprocess(df: DataFrame, roles_table: DataFrame, max_levels: int = 10) -> DataFrame:
    """Dates read, small categories turned into indicators, gaps filled; the target is left as it is. [Q12]"""
    info = {r["column_name"]: r for r in roles_table.collect()}  # one row per column
    open_columns = [c for c in df.columns if c in info and info[c]["role"] != "target"]
    categories = [c for c in open_columns if info[c]["kind"] == "categorical" and info[c]["role"] == "feature"]
    levels: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        # The rank filter reaches the shuffle: at most max_levels + 1 rows per column are collected.
        place = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
        for r in value_counts(df, categories).withColumn("n", place).where(F.col("n") <= max_levels + 1).orderBy("column_name", "n").collect():
            levels[r["column_name"]].append(r["value"])
    encoded = [c for c in categories if len(levels[c]) <= max_levels]
    numeric = [c for c in open_columns if info[c]["kind"] in ("integer", "number")]
    other = [c for c in open_columns if c not in numeric and c not in encoded]
    values, kinds = _fill_values(df, numeric, other), dict(df.dtypes)
    out: list[Column] = []
    for c in df.columns:
        if c in encoded:
            out += [(F.coalesce(F.col(c).cast("string") == v, F.lit(False))).cast("int").alias(f"{c}_{v}") for v in levels[c]]
        elif c in values:
            target_type = "double" if c in numeric else kinds[c]
            cell = as_double(df, c) if c in numeric else F.col(c).try_cast(target_type)
            out.append(F.coalesce(cell, F.lit(values[c]).cast(target_type)).alias(c))
        else:
            out.append(F.col(c))
    dates = [c for c in open_columns if info[c]["kind"] == "date" and kinds[c] == "string"]
    return df.select(*out).withColumns({c: parse_date(F.col(c)) for c in dates})
