"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed to 32 bits. The
model is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of their number: their
features are extracted in parallel, and one task runs the updates in a fixed order. Per-coordinate
rates and the L1 term leave a few thousand weights, which every scoring task receives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duecast.llm import bytewords as bw
from duecast.llm.ngram_join import small_batches

#: Most labelled rows used to fit; every row is scored.
FIT_ROWS = 8000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.01
THRESHOLD = 0.7
_SIEVE_BITS = 20


def held_out(id_col: Column) -> Column:
    """True for rows whose label must not be used."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, 32-bit feature) for chunks of a text column, repeats included."""
    raw, ends = bw.text_buffer(column)
    for a, b in bw.chunks(ends):
        part, cuts = bw.LOWER[raw[ends[a] : ends[b]]], ends[a : b + 1] - ends[a]
        first, stop, row = bw.word_spans(part, cuts, bw.ALNUM_WORDS)
        words = bw.word_hashes(part, first, stop)
        rows, codes = [row], [bw.chain(words)]
        for gap in (1, 2):
            if len(words) > gap:
                whole = row[gap:] == row[:-gap]
                rows.append(row[gap:][whole])
                codes.append(bw.chain(np.full(int(whole.sum()), gap, np.uint64), words[:-gap][whole], words[gap:][whole]))
        yield a, b - a, np.concatenate(rows), (np.concatenate(codes) >> np.uint64(32)).astype(np.int64)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, rows, row, code in features(batch.column(1)):
            lists = [np.unique(code[row == i]) for i in range(rows)] if rows < 64 else None
            if lists is None:
                order = np.argsort(row, kind="stable")
                lists = [np.unique(x) for x in np.split(code[order], np.searchsorted(row[order], np.arange(1, rows)))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), batch.column(2).slice(a, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["doc_id", "y", "x"])


def ftrl(ys: np.ndarray, xs: list[np.ndarray], dims: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of ``dims`` coordinates; coordinate 0 is the bias and bears no penalty."""
    z, n = np.zeros(dims), np.zeros(dims)

    def weights(at: np.ndarray) -> np.ndarray:
        shrink = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z[at]) <= shrink, 0.0, -(z[at] - np.sign(z[at]) * shrink) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(at == 0, 0.0, L2)))

    for _ in range(epochs):
        for y, x in zip(ys, xs, strict=True):
            w = weights(x)
            slope = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] += slope - (np.sqrt(n[x] + slope * slope) - np.sqrt(n[x])) / ALPHA * w
            n[x] += slope * slope
    return weights(np.arange(dims))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.int64()))])).combine_chunks()
    numbers, ys = table.column(0).to_numpy(), table.column(1).to_numpy()
    lists = table.column(2).combine_chunks()
    codes, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    order = np.lexsort((ys, numbers, bw.mix(numbers.astype(np.uint64))))
    xs = [np.concatenate([[0], place[ends[i] : ends[i + 1]] + 1]) for i in order]
    w = ftrl(ys[order].astype(float), xs, len(codes) + 1)
    kept = np.flatnonzero(w[1:])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], codes[kept]])), pa.array(np.concatenate([w[:1], w[1:][kept]]))], names=["code", "weight"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights), code -1 the bias, from the labelled rows that are not held out.

    A number with several labels counts as toxic if any says so; null labels and numbers are not used. Without
    any labelled row the model is a bias of 0.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    vectors = texts.select("doc_id", "text", "y").mapInArrow(_extract, "doc_id long, y int, x array<long>")
    # One task for at most ``rows`` feature lists: the updates are sequential. The shuffle keeps the scan, the join and
    # the extraction out of that task.
    model = vectors.repartition(1).mapInArrow(_fit, "code long, weight double").toPandas().sort_values("code")
    return model["code"].to_numpy(np.int64), model["weight"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of no features. Repeated rows score alike."""
    codes, weights = model
    bias, codes, weights = float(weights[0]), codes[1:], weights[1:]
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[codes & ((1 << _SIEVE_BITS) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for a, rows, row, code in features(batch.column(1)):
                near = np.flatnonzero(sieve[code & ((1 << _SIEVE_BITS) - 1)])
                at = np.searchsorted(codes, code[near])
                hit = codes[np.minimum(at, len(codes) - 1)] == code[near] if len(codes) else np.zeros(0, bool)
                once = np.unique(row[near[hit]] * len(codes) + at[hit])
                np.add.at(total, a + once // max(len(codes), 1), weights[once % max(len(codes), 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, with a model fitted on the rows that are not held out."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
