"""Domain views over the provided tables, so that every query runs on whole tables.

Nothing here filters by key: defects and missing outcomes are computed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecast.sources.tables import read


def invoices(spark: SparkSession, root: str) -> DataFrame:
    """Orders as invoices: due after 30 days, open when the status is ``O``."""
    o = read(spark, root, "orders")
    posting = F.col("o_orderdate").cast("date")
    clear = F.when(F.col("o_orderstatus") != "O", F.date_add(posting, ((F.col("o_orderkey") * 7919) % 61).cast("int")))
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cust_number"),
        posting.alias("posting_date"),
        F.date_add(posting, 30).alias("due_date"),
        clear.alias("clear_date"),
        F.col("o_totalprice").alias("total_open_amount"),
        F.col("o_orderpriority").alias("business_code"),
        F.col("o_orderstatus").alias("document_type"),
    )


def demand(spark: SparkSession, root: str) -> DataFrame:
    """Units, price and discount per day, store (region) and product (part type)."""
    line = read(spark, root, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.col("l_shipdate").cast("date").alias("date")
    )
    part = read(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product_id"))
    nation = read(spark, root, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, root, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("store_id"))
    store = (
        read(spark, root, "supplier")
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        .join(nation.join(region, "n_regionkey"), "n_nationkey")
        .select("l_suppkey", "store_id")
    )
    daily = (
        line.join(part, "l_partkey")
        .join(store, "l_suppkey")
        .groupBy("date", "store_id", "product_id")
        .agg(
            F.sum("l_quantity").alias("units_sold"),
            F.sum("l_extendedprice").alias("_gross"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
        )
    )
    stock = F.pmod(F.datediff("date", F.lit("1990-01-01").cast("date")) * 37 + F.length("product_id") * 11, F.lit(180))
    return daily.select(
        "date",
        "store_id",
        "product_id",
        "units_sold",
        (F.col("_gross") / F.col("units_sold")).alias("price"),
        "discount_amount",
        stock.cast("double").alias("inventory_level"),
    )


def credit(spark: SparkSession, root: str) -> DataFrame:
    """One row per customer: limits, demographics and the last six orders as bills and payments."""
    recent = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last_six = (
        read(spark, root, "orders")
        .select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
        .withColumn("n", F.row_number().over(recent))
        .where("n <= 6")
    )
    key = F.col("o_orderkey")
    months = []
    for position, pay in enumerate((0, 2, 3, 4, 5, 6), start=1):
        here = F.col("n") == position
        months += [
            F.max(F.when(here, ((key * 17) % 8 - 2).cast("int"))).alias(f"PAY_{pay}"),
            F.max(F.when(here, F.col("o_totalprice"))).alias(f"BILL_AMT{position}"),
            F.max(F.when(here, F.col("o_totalprice") * ((key * 31) % 100) / 100)).alias(f"PAY_AMT{position}"),
        ]
    history = last_six.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*months)
    base = read(spark, root, "customer").select(
        "c_custkey",
        F.col("c_name").alias("client_id"),
        (F.col("c_acctbal") * 50).alias("LIMIT_BAL"),
        (18 + F.col("c_custkey") % 70).cast("int").alias("AGE"),
        (F.col("c_custkey") % 7).cast("int").alias("EDUCATION"),
        (F.col("c_custkey") % 4).cast("int").alias("MARRIAGE"),
        F.col("c_mktsegment").alias("segment"),
    )
    joined = base.join(history, "c_custkey", "left")
    return joined.withColumn("default_next_month", F.when(F.col("PAY_0").isNotNull(), (F.col("PAY_0") > 1).cast("int")))


def credit_text(spark: SparkSession, root: str) -> DataFrame:
    """The credit view as uploaded text, with defects derived from the key."""
    key = F.col("c_custkey")
    df = credit(spark, root)
    # Fixed scale: whole-number text keeps both engines' number formatting equal.
    for name in [c for c in df.columns if c.startswith(("BILL_", "PAY_AMT", "LIMIT"))]:
        df = df.withColumn(name, F.round(F.col(name)).cast("bigint"))
    for name in [c for c in df.columns if c not in ("c_custkey", "client_id", "segment")]:
        df = df.withColumn(name, F.col(name).cast("string"))
    return df.withColumns(
        {
            "source_row_number": key + 2,
            "client_id": F.when(key % 97 == 0, " ")
            .when(key % 89 == 0, F.lit("Customer#000000001"))
            .otherwise(F.col("client_id")),
            "AGE": F.when(key % 53 == 0, "abc").when(key % 61 == 0, "175").otherwise(F.col("AGE")),
            "EDUCATION": F.when(key % 71 == 0, "").otherwise(F.col("EDUCATION")),
            "PAY_0": F.when(key % 67 == 0, "9").otherwise(F.col("PAY_0")),
            "BILL_AMT2": F.when(key % 59 == 0, F.concat(F.lit("-"), F.col("BILL_AMT2"))).otherwise(F.col("BILL_AMT2")),
            "default_next_month": F.when(key % 83 == 0, "2").otherwise(F.col("default_next_month")),
        }
    )


def demand_text(spark: SparkSession, root: str) -> DataFrame:
    """Line items as an uploaded demand file, with defects and repeated keys."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return read(spark, root, "lineitem").select(
        key.alias("row_id"),
        F.when(key % 101 == 0, "invalid").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.when(key % 103 == 0, " ").otherwise((F.col("l_suppkey") % 10).cast("string")).alias("store_id"),
        (F.col("l_partkey") % 20).cast("string").alias("product_id"),
        F.when(key % 107 == 0, "-1").when(key % 109 == 0, "n/a")
        .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("units_sold"),
        F.when(key % 113 == 0, F.lit(None).cast("string")).otherwise(F.col("l_extendedprice").cast("bigint").cast("string"))
        .alias("inventory_level"),
        F.col("l_extendedprice").alias("amount"),
    )


def cash(spark: SparkSession, root: str) -> DataFrame:
    """Purchases as inflow and errors as outflow, per user and day."""
    events = read(spark, root, "events")
    kind, value = F.col("event_type"), F.col("value")
    return events.groupBy(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("period")).agg(
        F.sum(F.when(kind == "purchase", value).otherwise(0.0)).alias("cash_inflow"),
        F.sum(F.when(kind == "error", value).otherwise(0.0)).alias("cash_outflow"),
    )


def scores(spark: SparkSession, root: str) -> DataFrame:
    """Orders with a pseudo-probability in thousandths and a label that follows it."""
    key = F.col("o_orderkey")
    thousandths = ((key % 1000003) * 2654435761) % 1000
    return read(spark, root, "orders").select(
        key.alias("row_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderpriority").alias("segment"),
        (F.col("o_orderkey") % 5).cast("string").alias("company_id"),
        F.col("o_orderstatus").alias("status_code"),
        F.col("o_totalprice").alias("amount"),
        (thousandths / F.lit(1000.0)).alias("p"),
        F.when((key * 7919) % 1000 < thousandths, 1).otherwise(0).alias("y"),
    )


def forecasts(spark: SparkSession, root: str) -> DataFrame:
    """Demand with a pseudo-forecast that leans on the weekday."""
    df = demand(spark, root)
    factor = 0.7 + F.weekday("date") / F.lit(10.0)
    return df.select(
        "date", "store_id", "product_id", "units_sold", "inventory_level", "price",
        F.round(F.col("units_sold") * factor + 3, 2).alias("forecast_value"),
    )


def accepted_loans(spark: SparkSession, root: str) -> DataFrame:
    """Orders joined with customers, in the text layout of an accepted-loan file."""
    key = F.col("o_orderkey")
    customer = read(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return read(spark, root, "orders").join(customer, "o_custkey").select(
        key.alias("row_id"),
        (key / 2).cast("bigint").cast("string").alias("id"),
        (F.col("c_acctbal").cast("bigint") * 21 + 20000).cast("string").alias("annual_inc"),
        F.concat((F.col("o_totalprice").cast("bigint") % 40 + 1).cast("string"), F.lit(",000")).alias("loan_amnt"),
        F.when(key % 11 > 0, (600 + key % 200).cast("string")).alias("fico_range_low"),
        (604 + key % 200).cast("string").alias("fico_range_high"),
        F.when(key % 13 == 0, "n/a").when(key % 13 == 12, "< 1 year").otherwise(F.concat((key % 13).cast("string"), F.lit("+ years")))
        .alias("emp_length"),
        (key % 40).cast("string").alias("total_acc"),
        F.concat((key % 25).cast("string"), F.lit(".5%")).alias("int_rate"),
        F.when(key % 2 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.when(key % 29 > 0, (key % 35).cast("string")).alias("dti"),
        F.when(key % 3 == 0, "MORTGAGE").when(key % 3 == 1, "mortgage").otherwise("RENT").alias("home_ownership"),
        F.col("c_mktsegment").alias("purpose"),
        F.when(key % 10 == 0, "Joint App").otherwise("Individual").alias("application_type"),
        F.when(F.col("o_orderstatus") == "F", "Fully Paid").when(F.col("o_orderstatus") == "P", " Charged Off ")
        .otherwise("Current").alias("loan_status"),
    )
