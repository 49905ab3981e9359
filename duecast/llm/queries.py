"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecast.llm import chat_format, decontamination, filter_audit, lexical_search, ngram_join, piece_dropout, quality_rules, secret_scan, sql, suffix_dedup, token_counts, toxicity, url_filter, web_archive
from duecast.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "failed_rules", "kept")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return left.select("doc_id", "n_bytes", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


CONTROL_CHAT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_CHAT), (-7, 1, "assistant", CONTROL_CHAT)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(control)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_dropout.encode_documents(table(spark, sf_dir, "documents"), check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", "lossless")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(token_counts.write_token_files(table(spark, sf_dir, "documents")))


def _is_kind(kind: str):
    return lambda finding: finding["kind"] == kind


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"].isin(*secret_scan.BASE_KINDS))
    found = found.withColumn("base", base)

    def count(condition) -> F.Column:
        return F.size(F.filter("findings", condition)).cast("long")

    return found.select(
        "doc_id",
        *[count(_is_kind(k)).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("findings")).alias("spans"),
        count(lambda f: f["shared"]).alias("n_shared"),
        count(lambda f: f["n_owners"] == 1).alias("n_owner_specific"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "web-archive")
    web_archive.write_archive(table(spark, sf_dir, "pages"), path)
    return web_archive.page_records(spark, path)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = filter_audit.count_outcomes(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
    return filter_audit.interactions(outcomes)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

SQL = {"op1_quality_rules": sql.OP1, "op4_decontamination": sql.OP4, "op5_url_filter": sql.OP5, "op7_chat_format": sql.OP7, "op10_secret_scan": sql.OP10, "op11_lexical_search": sql.OP11, "op12_warc": sql.OP12, "op13_filter_audit": sql.OP13}
