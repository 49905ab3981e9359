"""Delimited text in, tables and reports out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duecast.functions.values import as_double, days_between, parse_spreadsheet_date
from duecast.operators.combine import clean_headers, plain_name
from duecast.session import materialize


BROKEN_CHARACTER = "\ufffd"


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, schema: StructType | None = None, with_outcomes: bool = True
) -> DataFrame:
    """Delimited text as string columns with clean headers and payment outcomes filled in. [S1-S3]

    Without an ``encoding`` each file is read as UTF-8, or as Latin-1 if that breaks a character of this file.
    No type is inferred: that would read the files twice and guess. A known ``schema`` of
    string columns also saves the header scan.
    """
    def read(charset: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", charset)
        return (reader.schema(schema) if schema is not None else reader).csv(path)

    df = read(encoding or "UTF-8")
    if encoding is None:
        broken = F.lit(any(BROKEN_CHARACTER in c for c in df.columns))
        for c in df.columns:
            broken = broken | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(BROKEN_CHARACTER)), F.lit(False))
        spoilt = [r[0] for r in df.where(broken).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]  # file names
        if spoilt:
            # Both readers see the same path, so that a shared header gives the same columns; each keeps its own files.
            own = F.col("_metadata.file_path").isin(spoilt)
            latin = read("ISO-8859-1").where(own)
            df = latin if set(spoilt) >= set(df.inputFiles()) else df.where(~own).unionByName(latin, allowMissingColumns=True)
    df = clean_headers(df)
    return fill_outcomes(df) if with_outcomes else df


def read_cells(spark: SparkSession, path: str, sep: str = ",", width: int = 256, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """All delimited files under a path by one read: (file, cells) of every row, and (file, header) of every file. [S4, S5]

    Files may order and spell their columns differently; a header has at most ``width`` cells, more are refused. Lines equal to their
    file's header are not rows; files without a line are not listed. Headers, one row a file, are written to the shared folder.
    """
    names = [f"c{i}" for i in range(width + 1)]
    schema = StructType([StructField(n, StringType()) for n in names])
    raw = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).csv(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.array(*names).alias("cells"))
    top = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("cells", F.struct("start", "at")).alias("line"))
    last = F.array_max(F.transform("line", lambda x, i: F.when(x.isNotNull(), i + 1)))
    headers = materialize(top.select("file", "line", F.slice("line", 1, F.coalesce(last, F.lit(0))).alias("header")), "headers")
    if not headers.where(F.size("header") > width).isEmpty():
        raise ValueError(f"A header has more than {width} cells.")
    rows = lines.join(headers, "file").where(F.col("cells") != F.col("line"))
    return rows.select("file", F.slice("cells", 1, F.size("header")).alias("cells")), headers.select("file", "header")


def fill_outcomes(df: DataFrame) -> DataFrame:
    """``delay_days`` and ``is_late`` from clearing and due dates, only where they are blank. [S3, X3, X11]"""
    by_key = {plain_name(c): c for c in df.columns}
    clear_name, due_name = by_key.get("cleardate"), by_key.get("dueindate") or by_key.get("duedate")
    if clear_name is None or due_name is None:
        return df
    kinds = dict(df.dtypes)
    clear, due = (F.col(c) if kinds[c] == "date" else parse_spreadsheet_date(F.col(c).cast("string")) for c in (clear_name, due_name))
    known = clear.isNotNull() & due.isNotNull()
    delay_name, late_name = by_key.get("delaydays", "delay_days"), by_key.get("islate", "is_late")
    measured = F.when(known, days_between(clear, due).cast("double"))
    delay = F.coalesce(as_double(df, delay_name), measured) if "delaydays" in by_key else measured
    late = F.when(known & delay.isNotNull(), (delay > 0).cast("double")).when(known, 0.0)
    if "islate" in by_key:
        late = F.coalesce(as_double(df, late_name), late)
    return df.withColumns({delay_name: delay, late_name: late})


def write_dataset(df: DataFrame, path: str) -> None:
    """The table as CSV and as Parquet. [S14]"""
    df.write.option("header", True).csv(f"{path}/csv")
    df.write.parquet(f"{path}/parquet")


def export_csv(df: DataFrame, path: str) -> None:
    """The rows at hand, as after a filter. [S18]"""
    df.write.option("header", True).csv(path)


def export_report(summary: DataFrame, path: str, analysis_id: str, task: str, model_version: str, recommendations: Sequence[str] | Column = ()) -> None:
    """A one-row summary with its recommendations as a JSON report; a column of the summary may hold them. [S19]"""
    listed = recommendations if isinstance(recommendations, Column) else F.array(*[F.lit(r) for r in recommendations]).cast("array<string>")
    report = summary.select(
        F.lit(analysis_id).alias("analysis_id"), F.lit(task).alias("analysis_type"), F.lit(model_version).alias("model_version"),
        F.struct(*[F.col(c) for c in summary.columns]).alias("summary"), listed.alias("recommendations"),
    )
    report.write.json(path)
