"""Keys that survive nulls and repeated document numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, _text) of every row: the number, a hash of the whole text, and the text with null as empty.

    Rows with the same number but other texts stay apart; rows equal in both have equal results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def join_keyed(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (_id, _hash) where a null number equals a null number."""
    renamed = right.withColumnsRenamed({"_id": "_rid", "_hash": "_rhash"})
    same = (left["_hash"] == renamed["_rhash"]) & left["_id"].eqNullSafe(renamed["_rid"])
    return left.join(renamed, same, how).drop("_rid", "_rhash")


def space_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, WORD_GAP, -1), "")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
