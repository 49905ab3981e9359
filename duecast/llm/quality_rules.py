"""Quality rules: a threshold table compiled into projections of built-in functions.

No shuffle, no join, no user function: every figure of a document comes from its own row. The
steps are separate projections because Spark evaluates an array column once per projection but a
nested expression once per use.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.llm.keys import all_of, space_words


class Rule(NamedTuple):
    """Holds when least * per <= 100 * figure <= most * per; ``per`` None means a plain count (times 100)."""

    name: str
    figure: str
    per: str | None
    least: int | None
    most: int | None


#: Percent of the second figure, or plain counts.
THRESHOLDS = [
    Rule("length", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 250, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 15),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 50),
]

#: Function words of the languages handled.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "as", "this", "are", "on", "be", "by", "at", "or", "from"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "est", "au", "pas", "avec"],
    "de": ["der", "die", "das", "den", "dem", "des", "und", "ein", "eine", "ist", "von", "zu", "mit", "sich", "auf", "für", "im", "nicht", "als", "auch"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "un", "una", "que", "por", "con", "para", "se", "su", "al", "es", "lo", "no"],
}

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def compile_rules(rules: list[Rule]) -> dict[str, Column]:
    """One boolean column per rule, in whole numbers so that no rounding decides."""
    compiled = {}
    for rule in rules:
        figure, per = F.col(rule.figure) * (100 if rule.per else 1), F.col(rule.per) if rule.per else F.lit(1)
        sides = [figure >= per * rule.least] if rule.least is not None else []
        sides += [figure <= per * rule.most] if rule.most is not None else []
        compiled[rule.name] = all_of(sides)
    return compiled


def working_names(columns: list[str]) -> Callable[[str], str]:
    """Names for working columns that no column of the caller has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return lambda short: prefix + short


def text_figures(docs: DataFrame, text_col: str = "text", result: str = "_figures") -> DataFrame:
    """The rows of ``docs`` with a struct column named by ``result``; columns of any other name stay.

    Null text counts as empty: all figures 0. The repeated-word figure looks at hashed three-word
    windows first; only texts where two hashes agree are compared word by word.
    """
    name = working_names(docs.columns)
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.withColumns({name("t"): text, name("w"): space_words(text), name("l"): F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    heads = F.slice(name("w"), F.lit(1), F.greatest(F.size(name("w")) - 2, F.lit(0)))

    def after(i: Column, k: int) -> Column:
        return F.get(F.col(name("w")), i + k)

    counted = split.withColumns(
        {
            name("h"): F.transform(heads, lambda w, i: F.xxhash64(w, after(i, 1), after(i, 2))),
            name("counts"): F.struct(
                F.size(name("w")).cast("long").alias("n_words"),
                F.length(F.array_join(name("w"), "")).cast("long").alias("word_chars"),
                F.regexp_count(name("t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(F.filter(name("w"), lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
                F.size(name("l")).cast("long").alias("n_lines"),
                (F.size(name("l")) - F.size(F.array_distinct(name("l")))).cast("long").alias("n_dup_lines"),
            ),
        }
    ).drop(name("t"), name("l"))
    doubtful = counted.withColumn(name("again"), F.size(F.array_distinct(name("h"))) < F.size(name("h"))).drop(name("h"))
    window = F.transform(heads, lambda w, i: F.struct(F.concat_ws(" ", w, after(i, 1), after(i, 2)).alias("w"), i.alias("i")))
    ordered = doubtful.withColumn(name("s"), F.when(F.col(name("again")), F.sort_array(window))).drop(name("w"), name("again"))

    def neighbour(j: Column, k: int) -> Column:
        return F.coalesce(F.get(F.col(name("s")), j + k)["w"], F.lit(""))

    twice = F.transform(name("s"), lambda s, j: F.when((s["w"] == neighbour(j, -1)) | (s["w"] == neighbour(j, 1)), s["i"]))
    starts = ordered.withColumn(name("p"), F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop(name("s"))
    covered = F.aggregate(
        F.transform(name("p"), lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col(name("p")), j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda total, n: total + n
    )
    figures = F.struct(f"{name('counts')}.*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # Through a generator, so that the optimizer cannot push a caller's filter below and copy the nested steps into it.
    return starts.withColumn(result, F.explode_outer(F.array(figures))).drop(name("p"), name("counts"))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` plus the figures, ``base_failed``, ``kept`` and ``failed_rules`` (names, comma-joined).

    Null and empty texts have no words and fail; repeated rows are judged alike, each on its own; an
    empty table gives an empty result. A column of ``docs`` with the name of a result column is replaced.
    """
    held = working_names(docs.columns)("figures")
    figured = text_figures(docs, text_col, held)
    names = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    wide = figured.withColumns({n: F.col(f"{held}.{n}") for n in names}).drop(held)
    checks = compile_rules(THRESHOLDS if rules is None else rules)
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(~passed, F.lit(name)) for name, passed in checks.items()])
    return wide.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
