"""Benchmark decontamination by winnowing.

A window is ten consecutive words of an item (or the whole of a shorter item). The smallest hash of
the five-word grams inside a window is its fingerprint, so any ten words that a document shares with
an item have the same fingerprint on both sides. Document windows that share a fingerprint follow
each other in runs; one row per run is joined with the fingerprints of the items, and only runs that
hit are extended to whole windows and compared word by word.

Items shorter than a window are matched by all grams of their length, since a window of the document
around them need not choose a gram inside them.

The outer forms of explode are used on purpose: for the plain ones the optimizer adds a filter on the
array's size and pushes it below, which evaluates the nested array expressions once more per use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.llm.keys import join_keyed, keyed

GRAM = 5
WINDOW = 10
#: Item windows up to this number are broadcast (about 150 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters a-z and anything beyond ASCII."""
    lowered = F.when(text.rlike("[A-Z]"), F.translate(text, _UPPER, _LOWER)).otherwise(text)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _grams(words: str) -> Column:
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (GRAM - 1), F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, GRAM)]))


def _minima(grams: str) -> Column:
    span = WINDOW - GRAM
    heads = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - span, F.lit(0)))
    return F.transform(heads, lambda g, i: F.least(g, *[F.get(F.col(grams), i + k) for k in range(1, span + 1)]))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, width, gram, print): every window of every item once; print is null for short items."""
    split = benchmark.select(F.col(id_col).alias("item_id"), alnum_words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_w"))
    split = split.where(F.size("_w") > 0).withColumns({"_g": _grams("_w"), "width": F.least(F.size("_w"), F.lit(WINDOW))})
    split = split.withColumn("_m", _minima("_g")).drop("_g")
    placed = split.select("item_id", "width", "_w", "_m", F.explode_outer(F.sequence(F.lit(0), F.size("_w") - F.col("width"))).alias("_i"))
    return placed.select("item_id", "width", F.array_join(F.slice("_w", F.col("_i") + 1, F.col("width")), " ").alias("gram"), F.get("_m", F.col("_i")).alias("print")).distinct()


def _runs(docs: DataFrame) -> DataFrame:
    """(_id, _hash, print, first, last): each run of windows with the same fingerprint."""
    prints = docs.select("_id", "_hash", alnum_words(F.col("_text")).alias("_w")).withColumn("_g", _grams("_w")).drop("_w")
    prints = prints.withColumn("_m", _minima("_g")).drop("_g")
    changes = F.filter(F.transform("_m", lambda m, i: F.when(F.coalesce(F.get(F.col("_m"), i - 1) != m, F.lit(True)), F.struct(m.alias("m"), i.alias("i")))), lambda c: c.isNotNull())
    runs = prints.withColumns({"_r": changes, "_n": F.size("_m")}).drop("_m")
    ended = F.transform("_r", lambda r, j: F.struct(r["m"].alias("print"), r["i"].alias("first"), (F.coalesce(F.get(F.col("_r"), j + 1)["i"], F.col("_n")) - 1).alias("last")))
    return runs.withColumn("_e", ended).select("_id", "_hash", F.inline_outer("_e"))


def benchmark_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(_id, _hash, start, width, item_id): each place where an item's window occurs in a document."""
    small = windows.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    lengths = [r["width"] for r in windows.where(F.col("width") < WINDOW).select("width").distinct().collect()]  # nine at most
    prints = windows.where(F.col("width") == WINDOW).select("print").distinct()
    runs = _runs(docs).join(hint(prints), "print", "left_semi")
    per_doc = runs.groupBy("_id", "_hash").agg(F.collect_set(F.struct("first", "last")).alias("_runs"))
    opened = join_keyed(docs, per_doc, "inner").withColumn("_w", alnum_words(F.col("_text"))).drop("_text")
    places = opened.select("_id", "_hash", "_w", F.explode_outer("_runs").alias("_run")).select("_id", "_hash", "_w", F.explode_outer(F.sequence("_run.first", "_run.last")).alias("start"))
    found = [places.select("_id", "_hash", "start", F.lit(WINDOW).alias("width"), F.array_join(F.slice("_w", F.col("start") + 1, WINDOW), " ").alias("gram"))]
    for width in lengths:
        split = docs.select("_id", "_hash", alnum_words(F.col("_text")).alias("_w")).where(F.size("_w") >= width)
        all_places = split.select("_id", "_hash", "_w", F.explode_outer(F.sequence(F.lit(0), F.size("_w") - width)).alias("start"))
        found.append(all_places.select("_id", "_hash", "start", F.lit(width).alias("width"), F.array_join(F.slice("_w", F.col("start") + 1, width), " ").alias("gram")))
    candidates = reduce(DataFrame.unionByName, found)
    return candidates.join(hint(windows.select("item_id", "width", "gram")), ["width", "gram"]).select("_id", "_hash", "start", "width", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, item_ids (sorted as strings), hit_places, contaminated.

    ``hit_places`` are the hit word numbers, sorted. Null and empty texts (of documents or items) have no words and
    hit nothing; repeated items all count; repeated documents get equal rows; empty tables give no hits.
    """
    base = keyed(docs, id_col, text_col)
    hits = benchmark_hits(base, item_windows(benchmark))
    per_doc = hits.groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "width")).alias("_places"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.sequence(p["start"], p["start"] + p["width"] - 1)))))
    per_doc = per_doc.withColumn("hit_places", words).drop("_places")
    counted = base.select("_id", "_hash", F.size(alnum_words(F.col("_text"))).cast("long").alias("n_words"))
    out = join_keyed(counted, per_doc, "left")
    none = F.array().cast("array<int>")
    out = out.withColumns({"hit_places": F.coalesce("hit_places", none), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), "n_words", F.size("hit_places").cast("long").alias("n_hit"), "item_ids", "hit_places", (F.size("hit_places") > 0).alias("contaminated")
    )
