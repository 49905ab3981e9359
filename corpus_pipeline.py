"""From raw documents to token pieces: five stages, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``. An empty table passes through every stage; each stage's operator states what it does
with nulls and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecast.llm import decontamination, ngram_join, piece_dropout, quality_rules, secret_scan
from duecast.session import materialize

#: Near-duplicates share four fifths of their distinct five-word shingles.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; columns named like a figure keep their own values.

    Null and empty texts fail; repeated rows are judged alike and all stay or all go.
    """
    row = quality_rules.working_names(docs.columns)("row")
    return quality_rules.quality_rules(docs.select("text", F.struct(*docs.columns).alias(row))).where("kept").select(f"{row}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; documents without a word all stay, repeats included.

    It is the one with the smallest number (a missing number comes last), of these the one with the smallest hash of
    its text, and of rows equal in both the one with the smallest hash of all columns.
    """
    name = quality_rules.working_names(docs.columns)
    hash_, id_, found_, one, row, least = (name(x) for x in ("hash", "id", "found", "one", "row", "least"))
    found = ngram_join.keyed_components(docs, words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)
    found = materialize(found.where(F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-copies")
    first = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias(id_), F.min("text_hash").alias(found_))
    kept = first.select(id_, found_, F.lit(True).alias(one))
    bare = found.where("root is null").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(found_), F.lit(False).alias(one)).distinct()
    hashed = docs.withColumn(hash_, _text_hash())
    kept = kept.unionByName(bare)
    kept = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept[id_]) & (hashed[hash_] == kept[found_])).withColumn(row, F.xxhash64(*docs.columns))
    number, text = name("number"), name("text")
    counts = kept.where(F.col(one)).groupBy(F.col("doc_id").alias(number), F.col(hash_).alias(text)).agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias(least))
    repeats = materialize(counts.where("rows > 1").drop("rows"), "repeated-rows")
    if repeats.isEmpty():
        return kept.select(docs.columns)
    marked = kept.join(repeats, F.col(one) & F.col("doc_id").eqNullSafe(F.col(number)) & (F.col(hash_) == F.col(text)), "left")
    once = marked.where(F.col(row) == F.col(least)).dropDuplicates(["doc_id", hash_, row])
    return marked.where(F.col(least).isNull()).unionByName(once).select(docs.columns)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Null texts and texts without words stay; rows of one number and text go together."""
    name = quality_rules.working_names(docs.columns)
    hash_, id_, found_ = name("hash"), name("id"), name("found")
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(found_))
    hashed = docs.withColumn(hash_, _text_hash())
    return hashed.join(found, hashed["doc_id"].eqNullSafe(found[id_]) & (hashed[hash_] == found[found_]), "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that is not a widely copied example masked and ``n_chars`` counted anew; null texts stay null."""
    name = quality_rules.working_names(docs.columns)
    hash_, id_, found_, live_ = (name(x) for x in ("hash", "id", "found", "live"))
    live = secret_scan.scan_secrets(docs).withColumn(live_, F.filter("findings", lambda f: ~f["shared"])).where(F.size(live_) > 0)
    live = live.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(found_), live_).dropDuplicates([id_, found_])
    hashed = docs.withColumn(hash_, _text_hash())
    joined = hashed.join(live, hashed["doc_id"].eqNullSafe(live[id_]) & (hashed[hash_] == live[found_]), "left")
    clean = F.col(live_).isNull()
    masked = joined.withColumn("text", F.when(clean, F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col(live_))))
    masked = masked.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return masked.select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every document."""
    encoded = piece_dropout.encode_documents(docs, check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: Seeded merge-dropout has no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
