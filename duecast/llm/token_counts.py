"""Token counts by separator scan over flat, unindexed token files.

A token file is a run of unsigned 16-bit identifiers in which a separator ends each document; it is
kept in blocks that cut documents anywhere. Each block is scanned on its own: one vectorised search
gives the separators, and with them the tokens before the first, between, and after the last. A
prefix scan over the blocks of a file then gives each block the tokens that its first document brings
along and the number of documents before it. The scan is done in two levels, so a file that holds
most of the data does not pass through one task block by block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duecast.llm.ngram_join import small_batches
from duecast.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts text before merging; fixed by the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 17
#: Blocks of a file scanned together at the lower level.
GROUP_BLOCKS = 1024


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, first_ordinal, doc_ids) written to the shared folder.

    ``doc_ids`` names the documents whose separator lies in the block, for joining results only. Null and
    empty texts are documents of no tokens.
    """
    small_batches(docs.sparkSession)
    encoding = encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        block, done, held, size, pending = 0, 0, [], 0, []

        def flush(tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal block, done, pending
            ends = int(np.count_nonzero(tokens == SEPARATOR))
            row = [[file], [block], [tokens.tobytes()], [done], [pending[:ends]]]
            block, done, pending = block + 1, done + ends, pending[ends:]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["file", "block", "tokens", "first_ordinal", "doc_ids"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(np.array([*encoding.encode_ordinary(text.as_py() or ""), SEPARATOR], np.uint16))
                pending.append(number)
                size += len(held[-1])
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    whole = size - size % block_tokens
                    for at in range(0, whole, block_tokens):
                        yield flush(flat[at : at + block_tokens])
                    held, size = [flat[whole:]], size - whole
        if size:
            yield flush(np.concatenate(held))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, to = docs.sparkSession, scratch_path(docs.sparkSession, "token-files")
    schema = "file long, block long, tokens binary, first_ordinal long, doc_ids array<long>"
    plain.mapInArrow(run, schema).write.option("compression", "zstd").parquet(to)
    return spark.read.schema(schema).parquet(to)


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, size, ends, head, tail, inner) of every block; a null block is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ends, head, tail, inner = [], [], [], [], []
            for tokens in batch.column(2):
                flat = np.frombuffer(tokens.as_py() or b"", np.dtype("<u2"))
                at = np.flatnonzero(flat == separator)
                size.append(len(flat))
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(flat))
                tail.append(len(flat) - 1 - int(at[-1]) if len(at) else len(flat))
                inner.append(np.diff(at) - 1 if len(at) > 1 else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (size, ends, head, tail)], pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "size", "ends", "head", "tail", "inner"])

    small_batches(blocks.sparkSession, 64)
    schema = "file long, block long, size long, ends long, head long, tail long, inner array<long>"
    return blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), "tokens").mapInArrow(run, schema)


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, separators not counted.

    Tokens after the last separator of a file are a document of their own; a file without tokens has none. Blocks of a
    file are read in order of ``block``; rows with a null file or block are left out; no blocks, no documents.
    """
    scanned = scan_blocks(blocks.where(F.col("file").isNotNull() & F.col("block").isNotNull()), separator)
    scanned = scanned.withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    near = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = scanned.withColumns({"before": F.coalesce(F.sum("size").over(near), zero), "docs": F.coalesce(F.sum("ends").over(near), zero)})
    placed = placed.withColumn("end_at", F.when(F.col("ends") > 0, F.col("before") + F.col("size") - F.col("tail")))
    placed = placed.withColumn("last", F.max("end_at").over(near))
    totals = placed.groupBy("file", "grp").agg(F.sum("size").alias("g_size"), F.sum("ends").alias("g_docs"), F.max("end_at").alias("g_last"))
    far = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"g_before": F.coalesce(F.sum("g_size").over(far), zero), "g_docs_before": F.coalesce(F.sum("g_docs").over(far), zero)})
    totals = totals.withColumn("g_last_before", F.coalesce(F.max(F.col("g_before") + F.col("g_last")).over(far), zero))
    joined = placed.join(totals.select("file", "grp", "g_before", "g_docs_before", "g_last_before"), ["file", "grp"])
    start = F.col("g_before") + F.col("before")
    carry = start - F.coalesce(F.col("g_before") + F.col("last"), F.col("g_last_before"))
    ended = joined.where("ends > 0").select("file", (F.col("g_docs_before") + F.col("docs")).alias("first"), F.concat(F.array(carry + F.col("head")), "inner").alias("sizes"))
    counts = ended.select("file", "first", F.posexplode("sizes").alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")
    whole = joined.groupBy("file").agg(F.sum("size").alias("size"), F.sum("ends").alias("ordinal"), F.max(F.col("g_before") + F.col("end_at")).alias("end"))
    rest = whole.withColumn("n_tokens", F.col("size") - F.coalesce("end", zero)).where("n_tokens > 0").select("file", "ordinal", "n_tokens")
    return counts.unionByName(rest)


def document_counts(files: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) for files made by ``write_token_files``; repeated documents keep their rows."""
    names = files.select("file", "first_ordinal", F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("first_ordinal") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(count_tokens(files), ["file", "ordinal"]).select("doc_id", "n_tokens")
