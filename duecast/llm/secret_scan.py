"""Secret scans with corpus-wide ownership of each candidate.

Spans come from built-in regular expressions: the matches of a pattern and the text between them
(split by the same pattern) give every position as a running sum, taken over one row per match.
Each candidate value is then counted over the whole corpus by distinct documents and owners
(sources), in two map-side combined steps so that a value copied everywhere has no hot group. A
value held by many owners is a copied example; one held by a single owner looks live.

Kinds assign, access and hex are always reported. Kind ``key`` (long mixed letters and digits
without a telling name beside them) is reported only where a single owner holds the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duecast.llm.keys import join_keyed, keyed


def either_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


NAMES = "|".join(either_case(n) for n in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: (pattern, group with the value, least characters of it, patterns the value must also show)
KINDS = {
    "assign": (rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ()),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16, ()),
    "hex": (r"([0-9a-f]{32,})", 1, 32, ()),
    "key": (r"([A-Za-z0-9+/_-]{24,})", 1, 24, ("[0-9]", "[A-Z]", "[a-z]")),
}
BASE_KINDS = ("assign", "access", "hex")
#: Values held by this many owners or more are copied examples.
SHARED_OWNERS = 3


def _matches(kind: str, order: int) -> Column:
    pattern, group, _, _ = KINDS[kind]
    zipped = F.arrays_zip(
        F.transform(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)).alias("value"),
        F.slice(F.transform(F.split("_text", pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))).alias("gap"),
    )
    found = F.transform(zipped, lambda z, i: F.struct(F.lit(order).alias("kind_no"), F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value")))
    return F.when(F.col("_text").rlike(pattern), found).otherwise(F.array().cast("array<struct<kind_no:int,kind:string,i:int,gap:int,size:int,value:string>>"))


def candidate_spans(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _owner, kind_no, kind, start, end, value) of all matches that pass; ``docs`` is keyed and has _owner."""
    kinds = list(KINDS)
    worth = docs.where(F.col("_text").rlike("|".join(KINDS[k][0] for k in kinds)))
    rows = worth.select("_id", "_hash", "_owner", F.explode_outer(F.concat(*[_matches(k, n) for n, k in enumerate(kinds)])).alias("m")).select("_id", "_hash", "_owner", "m.*")
    one_doc = Window.partitionBy("_id", "_hash", "_owner", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # A row repeated in the input would add its gaps twice.
    placed = rows.distinct().withColumn("end", F.sum(F.col("gap") + F.col("size")).over(one_doc)).withColumn("start", F.col("end") - F.col("size"))
    passing = F.lit(False)
    for kind in kinds:
        _, _, least, shows = KINDS[kind]
        good = (F.col("kind") == kind) & (F.length("value") >= least)
        for pattern in shows:
            good = good & F.col("value").rlike(pattern)
        passing = passing | good
    return placed.where(passing).select("_id", "_hash", "_owner", "kind_no", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_docs, n_owners) of each candidate value over the whole corpus."""
    value = F.sha2("value", 256).alias("value_hash")
    per_owner = spans.select(value, "_owner", "_id", "_hash").distinct().groupBy("value_hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document row: doc_id, text_hash, findings.

    ``findings`` is an array of (start, kind_no, end, kind, shared, n_docs, n_owners) by start and kind, in code
    points, end exclusive. Null and empty texts have none. A null owner is an owner of its own. Rows equal in
    number, text and owner count once in the corpus but each gets its result.
    """
    text = keyed(docs.withColumn("_o", F.coalesce(F.col(owner_col).cast("string"), F.lit(""))), id_col, text_col)
    owned = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"))
    owned = owned.withColumn("_hash", F.xxhash64("_text"))
    spans = candidate_spans(owned)
    owners = ownership(spans)
    judged = spans.withColumn("value_hash", F.sha2("value", 256)).join(owners, "value_hash")
    judged = judged.where(F.col("kind").isin(*BASE_KINDS) | (F.col("n_owners") == 1))
    finding = F.struct(F.col("start").cast("int").alias("start"), "kind_no", F.col("end").cast("int").alias("end"), "kind", (F.col("n_owners") >= SHARED_OWNERS).alias("shared"), "n_docs", "n_owners")
    per_doc = judged.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set(finding)).alias("findings"))
    out = join_keyed(text.select("_id", "_hash"), per_doc, "left")
    empty = F.array().cast(per_doc.schema["findings"].dataType)
    return out.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.coalesce("findings", empty).alias("findings"))


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """The text with each finding replaced; overlapping findings become one mask."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        findings,
        start,
        lambda a, f: F.when(f["start"] >= a["at"] - 1, F.struct((f["end"] + 1).alias("at"), F.concat(a["out"], F.substring(text, a["at"], f["start"] - a["at"] + 1), F.lit(mask)).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], f["end"] + 1).alias("at"), a["out"].alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"], F.length(text))),
    )
    return F.when(F.size(findings) == 0, text).otherwise(masked)
