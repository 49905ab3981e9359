"""URL filters as a sort-merge range join.

A host's labels in reverse order make a key under which a rule's host and all its subdomains are one
interval of keys, and intervals are nested or apart. Pages and rules are put in key order: split
points taken from a bounded number of keys deal the pages into ranges, each rule goes to every range
that its interval touches, and each range is swept once, keeping the stack of the rules whose
interval is open. The stack holds at most one host per label; on it the rules whose path opens the
page's path are compared, and the longest wins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many keys are looked at to choose split points; they decide the work, not the result.
SPLIT_KEYS = 20_000
DEFAULT_VERDICT = "allow"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A range holds about so many pages.
RANGE_ROWS = 500_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased in A-Z; both empty for a null url or one without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a separator that is written otherwise inside a label."""
    written = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(written, r"\.", -1)), "\x01"), F.lit("\x01")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def _sweep(pages: pd.DataFrame, rules: pd.DataFrame) -> Iterator[tuple[str | None, str | None]]:
    """(rule, verdict) of each page; both frames are sorted by key."""
    stack: list[tuple[str, list]] = []
    by_host = [(key, list(part[["path", "name", "verdict"]].itertuples(index=False, name=None))) for key, part in rules.groupby("key", sort=True)]
    at = 0
    last, answer = None, (None, None)
    for key, path in zip(pages["key"], pages["path"], strict=True):
        if (key, path) != last:
            while at < len(by_host) and by_host[at][0] <= key:
                opened = by_host[at]
                at += 1
                while stack and not opened[0].startswith(stack[-1][0]):
                    stack.pop()
                if key.startswith(opened[0]):
                    stack.append(opened)
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            fitting = [(len(name), name, verdict) for _, host_rules in stack for opening, name, verdict in host_rules if path.startswith(opening)]
            answer = max(fitting)[1:] if fitting else (None, None)
            last = (key, path)
        yield answer


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rule`` is null and the verdict ``default`` where none fits.

    Rules are (host, path, verdict). A rule fits its host and subdomains where the page's path starts with the rule's;
    the longest host and path together wins, then the larger in text order. Null urls have empty parts and fit nothing;
    rules with a null part or an empty host are left out; equal rules count once, and of equal rules with different
    verdicts the larger in text order (block) wins. Repeated pages are judged alike; empty tables give empty results or no rule.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    kind = dict(pages.dtypes)[id_col]
    # Numbers travel as text: a pandas column with a missing number would round the others.
    parted = pages.select(F.col(id_col).cast("string").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    rows = pages.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(rows // RANGE_ROWS, SPLIT_KEYS // 4))
    # A share by hash is a fixed random choice; a hot key is split by its pages' hashes. The limit only guards against
    # one page repeated without end.
    share = min(1.0, SPLIT_KEYS / max(rows, 1))
    hashed = parted.select("key", F.xxhash64("page_id", "path").alias("h"))
    chosen = hashed.where(F.pmod(F.xxhash64("h", "key"), F.lit(1_000_000_007)) < int(share * 1_000_000_007)).limit(4 * SPLIT_KEYS).collect()
    ordered = sorted((r["key"], r["h"]) for r in chosen)
    splits = sorted({ordered[len(ordered) * i // parts] for i in range(1, parts)}) if ordered else []

    @F.pandas_udf("int")
    def page_range(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splits, pair) for pair in zip(keys, hashes, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def rule_ranges(keys: pd.Series) -> pd.Series:
        low = [bisect.bisect_left(splits, (k, -(2**63))) for k in keys]
        # Keys below a rule's end before the key with its last separator raised by one.
        return pd.Series([list(range(a, bisect.bisect_right(splits, (k[:-1] + "\x02", -(2**63))) + 1)) for a, k in zip(low, keys, strict=True)])

    dealt = parted.withColumn("part", page_range("key", F.xxhash64("page_id", "path")))
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull() & (F.col("host") != ""))
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumns({"key": host_key(F.col("host")), "name": F.concat("host", "path")})
    spread = clean.withColumn("part", F.explode(rule_ranges("key"))).select("part", "key", "path", "name", "verdict")

    def sweep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:  # a range that only rules touch
            return pd.DataFrame(columns=["page_id", "host", "path", "rule", "verdict"]).astype(object)
        left = left.sort_values(["key", "path"], kind="stable")
        answers = list(_sweep(left, right.sort_values("key", kind="stable")))
        return pd.DataFrame({"page_id": left["page_id"], "host": left["host"], "path": left["path"], "rule": [a[0] for a in answers], "verdict": [a[1] or default for a in answers]})

    schema = "page_id string, host string, path string, rule string, verdict string"
    judged = dealt.groupBy("part").cogroup(spread.groupBy("part")).applyInPandas(sweep, schema)
    return judged.withColumn("page_id", F.col("page_id").cast(kind))
