"""Ranked lexical search over all documents: impact vectors in buckets of falling length.

A document becomes a sparse vector of integer impacts over the terms that any item uses, an item a sparse vector of
integer term weights; a score is their inner product. The vectors are range-partitioned and sorted by falling length,
the way LEMP lays out its buckets. Blocks of that order are met with

* the Cauchy-Schwarz bound: where |item| * |longest vector| stays below the item's threshold, the block, or the rest
  of it from some row on, is skipped;
* a coordinate bound inside: the item's heaviest coordinates are summed, and what the others can add is at most the
  product of the remaining lengths;
* an exact score of the survivors in 64-bit integers.

Thresholds come from the longest vectors, searched first, and rise inside each task. Bounds are computed in doubles
with a margin above their rounding, so that no row is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duecast.llm.batches import arrow_batches
from duecast.session import materialize

TOP = 50
#: Terms of items handled at once: they and their weights are sent to every task. More items take several passes.
BLOCK_TERMS = 500_000
#: Vectors searched first for thresholds: those of the longest buckets, at least so many where there are.
SEED_ROWS = 4096
#: Bucket lengths differ by a factor of at most 2 ** (1 / STEPS).
STEPS = 8
#: Vectors met at once inside a task.
BLOCK_ROWS = 4096
#: Share of an item's squared length that its focus coordinates hold.
FOCUS = 0.9
#: Bounds are raised by this share, far above the rounding of sums in doubles.
MARGIN = 1 + 1e-9

#: Impacts: SCALE * tf div (TF_UNIT * tf + LENGTH_UNIT * m), m = 100 - SLOPE + (SLOPE * n * N) div L.
SCALE, TF_UNIT, LENGTH_UNIT, SLOPE = 1_000_000_000, 1000, 20, 50

# UTF-8 bytes of a term: digits, letters with A-Z lowered, and every byte of a character beyond ASCII. All others separate.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Texts are split in pieces of about so many bytes, cut at a separator.
_PIECE = 1 << 20
_GAP = re.compile(rb" ")

_COUNTED = "doc_id long, text_hash long, n long, terms array<int>, counts array<long>"
_VECTORS = "doc_id long, text_hash long, norm double, level int, terms array<int>, impacts array<long>"
_HITS = "query int, doc_id long, text_hash long, score long"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    spaced, start = raw.translate(_TERM_BYTES), 0
    while len(spaced) - start > _PIECE:
        cut = _GAP.search(spaced, start + _PIECE)
        end = cut.start() if cut else len(spaced)
        yield spaced[start:end].split()
        start = end
    yield spaced[start:].split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t for piece in _pieces(raw or b"") for t in piece}) for raw in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item_hash"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "item_hash", "terms"])


def _lists(lengths: list[int] | np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))


def _count_terms(vocabulary):
    """Of each document its number of terms, and the counts of those that items use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            totals, lengths, terms, counts = [], [], [], []
            for raw in batch.column("text").to_pylist():
                seen, total = Counter(), 0
                for piece in _pieces(raw or b""):
                    total += len(piece)
                    for term, n in Counter(piece).items():
                        number = known.get(term)
                        if number is not None:
                            seen[number] += n
                own = sorted(seen)
                totals.append(total)
                lengths.append(len(own))
                terms += own
                counts += [seen[t] for t in own]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(totals, pa.int64()), _lists(lengths, np.array(terms, np.int32)), _lists(lengths, np.array(counts, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "terms", "counts"])

    return run


def _impacts(documents: int, total: int):
    """Impact vectors and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False)
            m = (100 - SLOPE) + (SLOPE * batch.column("n").to_numpy(zero_copy_only=False) * documents) // total
            impacts = (SCALE * counts) // (TF_UNIT * counts + LENGTH_UNIT * np.repeat(m, lengths))
            rows = np.repeat(np.arange(len(lengths)), lengths)
            norms = np.sqrt(np.bincount(rows, weights=impacts.astype(np.float64) ** 2, minlength=len(lengths)))
            levels = np.where(norms > 0, np.floor(STEPS * np.log2(np.maximum(norms, 1e-300))), -1).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(norms), pa.array(levels), _lists(lengths, terms.flatten().to_numpy(zero_copy_only=False)), _lists(lengths, impacts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "norm", "level", "terms", "impacts"])

    return run


def item_vectors(terms: list[np.ndarray], weights: np.ndarray) -> dict[str, list]:
    """Items as weight vectors, heaviest coordinates first: plain arrays, which any executor can read."""
    out: dict[str, list] = {"size": len(weights), "terms": [], "weights": [], "norms": [], "focus": [], "rest": []}
    for own in terms:
        own = own[weights[own] > 0]
        own = own[np.argsort(-weights[own], kind="stable")]
        held = weights[own]
        squares = np.cumsum(held.astype(np.float64) ** 2)
        whole = float(squares[-1]) if len(squares) else 0.0
        focus = int(np.searchsorted(squares, FOCUS * whole)) + 1 if len(squares) else 0
        out["terms"].append(own)
        out["weights"].append(held)
        out["norms"].append(math.sqrt(whole))
        out["focus"].append(focus)
        out["rest"].append(math.sqrt(float(np.sum(held[focus:].astype(np.float64) ** 2))))
    return out


class _Best:
    """The highest scores of one item so far; ties by number, rows without one last, then by text hash."""

    def __init__(self, top: int, threshold: int):
        self.top, self.threshold, self.held, self.parts = top, max(threshold, 1), 0, []

    def add(self, scores, numbers, missing, hashes) -> None:
        self.parts.append((scores, numbers, missing, hashes))
        self.held += len(scores)
        if self.held > 2 * self.top:
            self.cut()

    def cut(self) -> None:
        scores, numbers, missing, hashes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((hashes, numbers, missing, -scores))[: self.top]
        self.parts = [(scores[order], numbers[order], missing[order], hashes[order])]
        self.held = len(order)
        if self.held == self.top:
            self.threshold = max(self.threshold, int(scores[order[-1]]))


class _Block:
    """Vectors of falling length, by row and by coordinate."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.norms = batch.column("norm").to_numpy(zero_copy_only=False)
        terms, impacts = batch.column("terms"), batch.column("impacts")
        self.lengths = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.terms, self.impacts = terms.flatten().to_numpy(zero_copy_only=False), impacts.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(self.lengths)), self.lengths)[order]
        self.held = self.impacts[order].astype(np.float64)
        self.places = np.searchsorted(self.terms[order], np.arange(size + 1))

    def survivors(self, queries: dict, q: int, threshold: int) -> np.ndarray:
        norm = queries["norms"][q]
        rows = int(np.searchsorted(-self.norms, -threshold / (norm * MARGIN), side="right")) if norm else 0
        if not rows:
            return np.zeros(0, np.int64)
        part, squares = np.zeros(rows), np.zeros(rows)
        for term, weight in zip(queries["terms"][q][: queries["focus"][q]], queries["weights"][q], strict=False):
            a, b = self.places[term], self.places[term + 1]
            b = a + int(np.searchsorted(self.rows[a:b], rows))
            own, held = self.rows[a:b], self.held[a:b]
            part[own] += weight * held
            squares[own] += held * held
        most = part + queries["rest"][q] * np.sqrt(np.maximum(self.norms[:rows] ** 2 * MARGIN - squares, 0))
        return np.flatnonzero(most * MARGIN >= threshold)

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows]
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        places = np.repeat(self.starts[rows] - first, lengths) + np.arange(int(lengths.sum()))
        return np.add.reduceat(dense[self.terms[places]] * self.impacts[places], first)


def _search(queries, thresholds: list[int], top: int):
    """Each task's best rows of every item, none below the thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value
        best = [_Best(top, t) for t in thresholds]
        dense = np.zeros(known["size"], np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                # Batches keep the order of the sorted files; where a task reads several files, each starts anew.
                piece = piece.take(pc.sort_indices(piece, [("norm", "descending")]))
                block = _Block(piece, known["size"])
                numbers = piece.column("doc_id")
                missing = numbers.is_null().to_numpy(zero_copy_only=False)
                numbers = numbers.fill_null(0).to_numpy(zero_copy_only=False)
                hashes = piece.column("text_hash").to_numpy(zero_copy_only=False)
                for q, own in enumerate(best):
                    rows = block.survivors(known, q, own.threshold)
                    if not len(rows):
                        continue
                    dense[known["terms"][q]] = known["weights"][q]
                    scores = block.scores(rows, dense)
                    dense[known["terms"][q]] = 0
                    good = scores >= own.threshold
                    if good.any():
                        rows = rows[good]
                        own.add(scores[good], numbers[rows], missing[rows], hashes[rows])
        for q, own in enumerate(best):
            if own.parts:
                own.cut()
                scores, numbers, missing, hashes = own.parts[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(numbers, mask=missing), pa.array(hashes), pa.array(scores)], ["query", "doc_id", "text_hash", "score"])

    return run


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _rank_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """(query, rank, doc_id, text_hash, score) for items given as lists of their distinct terms."""
    spark: SparkSession = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    sent = spark.sparkContext.broadcast(vocabulary)
    with arrow_batches(spark, 2000, "8m"):
        counted = materialize(docs.mapInArrow(_count_terms(sent), _COUNTED), "term-counts")
    facts = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = facts["documents"], facts["total"] or 0
    if not total or not vocabulary:
        return spark.createDataFrame([], f"{_HITS}, rank int")
    held = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per term of the items
        held[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in held], np.int64)
    queries = item_vectors([np.array(sorted(vocabulary[t] for t in r["terms"]), np.int64) for r in rows], weights)
    with arrow_batches(spark, 2000, "8m"):
        vectors = counted.where(F.size("terms") > 0).mapInArrow(_impacts(documents, total), _VECTORS)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        vectors = vectors.repartitionByRange(parts, F.desc("norm"), "doc_id", "text_hash").sortWithinPartitions(F.desc("norm"))
        vectors = materialize(vectors, "impact-vectors")
    levels = {r["level"]: r["count"] for r in vectors.groupBy("level").count().collect()}  # buckets: at most a few hundred
    cut, seen = max(levels, default=0), 0
    for level in sorted(levels, reverse=True):
        cut, seen = level, seen + levels[level]
        if seen >= SEED_ROWS:
            break
    shipped = spark.sparkContext.broadcast(queries)
    with arrow_batches(spark, BLOCK_ROWS, "16m"):
        first = vectors.where(F.col("level") >= cut).mapInArrow(_search(shipped, [0] * len(rows), top), _HITS)
        first = materialize(_ranked(first, top).drop("rank"), "first-hits")
        thresholds = [0] * len(rows)
        for r in first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).collect():  # one row per item
            thresholds[r["query"]] = r["least"]
        # The Cauchy-Schwarz bound of the most demanding item, read from the statistics of the sorted files.
        shortest = min((t / n for t, n in zip(thresholds, queries["norms"], strict=True) if n), default=0) / MARGIN
        others = vectors.where((F.col("level") < cut) & (F.col("norm") >= shortest * (1 - 1e-9)))
        others = materialize(others.mapInArrow(_search(shipped, thresholds, top), _HITS), "later-hits")
    return _ranked(first.unionByName(others), top)


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score, text_hash): the ``top`` documents of each item with a score above 0.

    Null and empty texts have no terms: such documents are never found and count in no statistic, such items find
    nothing. Repeated document rows are documents of their own with equal scores; ties go by number, rows without a
    number last, then by text hash. Equal item rows are answered once, items of one number and other texts each with ranks
    of their own; an item without a number keeps its null. Empty tables give an empty result. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    kind = dict(asked.dtypes)["item_id"]
    asked = asked.select("item_id", F.xxhash64(F.col("item_id").cast("string"), "text").alias("item_hash"), F.col("text").cast("binary").alias("text"))
    with arrow_batches(spark, 2000, "8m"):
        asked = materialize(asked.mapInArrow(_item_terms, f"item_id {kind}, item_hash long, terms array<binary>"), "item-terms")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    parts = []
    for block in range(blocks):
        rows = asked.where(F.pmod("item_hash", F.lit(blocks)) == block).where(F.size("terms") > 0).orderBy("item_hash").collect()  # bounded by BLOCK_TERMS, but for one larger item
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {kind}")
        found = _rank_block(plain, rows, top).join(F.broadcast(names), "query")
        parts.append(found.select("item_id", "rank", "doc_id", "score", "text_hash"))
    return reduce(DataFrame.unionByName, parts)
