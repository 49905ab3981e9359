"""How filters overlap, kept up to date while files arrive.

A stream over a folder of documents counts, per part of the corpus, how many documents fail which set of filters. Four
filters look at one text alone. The fifth, a repeat of a text with a smaller number, can change after the fact: state
keyed by text holds the smallest number seen and what its rows count as; when a smaller number arrives, that
count is retracted and entered again as a repeat. All files are processed as available-now micro-batches; the state and
the written counts live in the shared folder, so a lost executor or a restart repeats a batch without counting it twice.

The counts hold every set of filters that fails together, so all 120 orders follow from one row per part.
"""

from __future__ import annotations

import hashlib
import marshal
import math
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duecast.session import materialize, scratch_path

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
#: Bits of a document's outcome: one per filter, then two for its labels.
REPEAT, GOOD, TOXIC = 16, 32, 64
#: Texts that share one state row on average.
TEXTS_PER_SLOT = 64
FILES_PER_BATCH = 1000

_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))
_PIECE = 1 << 20
# What a row says about itself: it may hold its text's smallest number, it repeats a smaller one of the same batch, or it has no number.
OPEN, REPEATED, UNNUMBERED = 0, 1, 2

_MASKED = "doc_id long, part string, digest binary, code int"
_SENT = "slot int, digest binary, doc_id long, part string, code int, n long, fate int"
_DELTAS = "part string, code int, n long"


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words, distinct, start = 0, set(), 0
    while start < len(raw):
        end = min(start + _PIECE, len(raw))
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        piece = raw[start:end].split()
        words += len(piece)
        distinct.update(piece)
        start = end
    points = len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) != len(raw.translate(None, _SYMBOLS))
    return (words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT_PERCENT * words) << 1 | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2 | symbols << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        codes = pa.array([failures(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digests, codes], ["doc_id", "part", "digest", "code"])


def _combine(slots: int):
    """Rows of one text in a batch become one per number that may be the smallest; all others are counted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch).append_column("place", pa.array(np.arange(batch.num_rows)))
            least = rows.group_by("digest").aggregate([("doc_id", "min")])
            place = rows.join(least, "digest").sort_by("place")
            number, smallest = place.column("doc_id"), place.column("doc_id_min")
            missing = number.is_null().to_numpy()
            fate = np.where(missing, UNNUMBERED, np.where(number.fill_null(0).to_numpy() > smallest.fill_null(0).to_numpy(), REPEATED, OPEN)).astype(np.int32)
            settled = fate != OPEN
            digests = [b"" if s else d for s, d in zip(settled, rows.column("digest").to_pylist(), strict=True)]
            numbers = np.where(settled, 0, number.fill_null(0).to_numpy())
            heads = np.array([int.from_bytes(d[:8], "big") % slots if d else -1 for d in digests], np.int64)
            heads[settled] = max(int(heads.max()), 0)
            table = pa.table({
                "slot": pa.array(heads.astype(np.int32)), "digest": pa.array(digests, pa.binary()), "doc_id": pa.array(numbers, pa.int64()), "part": rows.column("part"),
                "code": rows.column("code"), "fate": pa.array(fate), "n": pa.array(np.ones(len(fate), np.int64)),
            })
            table = table.group_by(["slot", "digest", "doc_id", "part", "code", "fate"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            yield from table.select(["slot", "digest", "doc_id", "part", "code", "n", "fate"]).combine_chunks().to_batches()

    return run


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts to add and to take back; the state maps a text to its smallest number and what its rows count as."""
    held = marshal.loads(state.get[0]) if state.exists else {}
    deltas: Counter = Counter()
    for frame in frames:
        columns = [frame[c].tolist() for c in ("digest", "doc_id", "part", "code", "n", "fate")]
        for digest, number, part, code, n, fate in zip(*columns, strict=True):
            if fate != OPEN:
                deltas[part, code | (REPEAT if fate == REPEATED else 0)] += n
                continue
            smallest, counted = held.get(digest, (None, None))
            if smallest is not None and number > smallest:
                deltas[part, code | REPEAT] += n
                continue
            if smallest is None or number < smallest:
                for (old, was), many in (counted or {}).items():
                    deltas[old, was] -= many
                    deltas[old, was | REPEAT] += many
                held[digest] = (number, counted := {})
            counted[part, code] = counted.get((part, code), 0) + n
            deltas[part, code] += n
    state.update((marshal.dumps(held),))
    rows = [(part, code, n) for (part, code), n in deltas.items() if n]
    yield pd.DataFrame(rows, columns=["part", "code", "n"]).astype({"part": object, "code": "int32", "n": "int64"})


def count_outcomes(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int = FILES_PER_BATCH, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, code, n): documents per part and set of failed filters and labels, from all Parquet files under ``path``.

    ``folder`` keeps the stream's state; a later call with the same folder takes in only files that came since. Null texts are
    empty; a null part is the empty one. Rows without a number never repeat a text and never make others repeats. Repeated rows
    each count; those with their text's smallest number are no repeats. Labels of one number count if any of its rows says 1.
    """
    folder = folder or scratch_path(spark, "filter-audit")
    files = spark.read.parquet(path)
    slots = _slots(spark, folder, files)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("marked")).agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    marks = materialize(marks, "label-marks")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", files_per_batch).parquet(_pattern(path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    plain = stream.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    masked = plain.mapInArrow(_masks, _MASKED)
    code = F.col("code") + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))
    marked = masked.join(marks, F.col("doc_id") == F.col("marked"), "left").select("doc_id", "part", "digest", code.cast("int").alias("code"))
    sent = marked.mapInArrow(_combine(slots), _SENT)
    deltas = sent.groupBy("slot").applyInPandasWithState(_settle, _DELTAS, "held binary", "append", GroupStateTimeout.NoTimeout)
    query = deltas.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/deltas").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_DELTAS).parquet(f"{folder}/deltas").groupBy("part", "code").agg(F.sum("n").alias("n")).where("n <> 0")


def _pattern(path: str) -> str:
    """The stream reader takes a single file only as a pattern."""
    head, _, name = path.rstrip("/").rpartition("/")
    return path if any(c in path for c in "*?[{") else f"{head}/{{{name}}}" if head else f"{{{name}}}"


def _slots(spark: SparkSession, folder: str, files: DataFrame) -> int:
    """State rows, fixed when a folder is first used: as many as its first files' texts ask for."""
    path = f"{folder}/slots"
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(parent):
        spark.createDataFrame([(min(max(1, files.count() // TEXTS_PER_SLOT), 2**31 - 1),)], "slots long").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).first()["slots"]


def interactions(outcomes: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters."""
    full = (1 << len(FILTERS)) - 1
    fails = F.col("code").bitwiseAND(full)

    def passing(extra: Column) -> list[Column]:
        """Documents that pass every filter of a set, for each set."""
        return [F.sum(F.when((fails.bitwiseAND(s) == 0) & extra, F.col("n")).otherwise(0)) for s in range(full + 1)]

    always = F.lit(True)
    parts = outcomes.groupBy("part").agg(
        F.array(passing(always)).alias("pass"),
        F.array(passing(F.col("code").bitwiseAND(GOOD) != 0)).alias("pass_good"),
        F.array(passing(F.col("code").bitwiseAND(TOXIC) != 0)).alias("pass_toxic"),
        F.array([F.sum(F.when(fails == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]).alias("only"),
    )

    def share(k: int) -> Column:
        """Removals by one filter summed over all orders: a set comes before it in |set|! (4 - |set|)! of them."""
        terms = []
        for s in range(full + 1):
            if not s >> k & 1:
                size = s.bit_count()
                weight = math.factorial(size) * math.factorial(len(FILTERS) - 1 - size)
                terms.append(weight * (F.col("pass")[s] - F.col("pass")[s | 1 << k]))
        return sum(terms[1:], terms[0])

    parts = parts.withColumn("shares", F.array([share(k) for k in range(len(FILTERS))]))
    orders = F.array([F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array([F.lit(k + 1) for k in range(len(FILTERS))])))

    def bit(k: int) -> Column:
        place = F.instr(F.lit(FILTERS), F.substring("filter_order", k, 1))
        return F.element_at(F.array([F.lit(1 << j) for j in range(len(FILTERS))]), place)

    before = sum([F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))], F.lit(0))
    steps = steps.withColumn("before", before).withColumn("place", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1)
    steps = steps.withColumn("after", F.col("before") + F.element_at(F.array([F.lit(1 << j) for j in range(len(FILTERS))]), F.col("place") + 1))
    own = F.element_at(F.array([F.lit(1 << j) for j in range(len(FILTERS))]), F.col("place") + 1)

    def lost(column: str) -> Column:
        return (F.col(column)[F.col("before")] - F.col(column)[F.col("after")]).cast("long")

    failing = F.col("pass")[0] - F.col("pass")[own]
    return steps.select(
        "part", "filter_order", "step",
        F.col("pass")[F.col("after")].cast("long").alias("kept"),
        lost("pass").alias("removed"),
        (failing - lost("pass")).cast("long").alias("redundant"),
        F.col("only")[F.col("place")].cast("long").alias("unique_fails"),
        lost("pass_good").alias("good_lost"),
        lost("pass_toxic").alias("toxic_lost"),
        F.col("shares")[F.col("place")].cast("long").alias("shapley"),
    )
