"""Chat formatting by columnar byte assembly.

Rows are put in order of conversation and turn; each Arrow batch is then written by arithmetic on
whole columns: the lengths of all segments (marks, roles, texts), their running sums as places in the
output, and one scatter per kind of segment into a preallocated buffer that becomes the Arrow result.

The template is ``<|turn|>role<|says|>text<|end|>`` per turn. Control strings inside roles and texts
(of this and of other common templates) get a backslash after their first character and backslashes
are doubled, so the output can be read back exactly. The loss mask holds the texts of one role, as
byte spans into the output.

A conversation is written in pieces where a batch ends inside it, so that memory stays bounded for any
length; pieces are numbered and join without a gap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecast.llm import bytewords as bw
from duecast.llm.ngram_join import small_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LOSS_ROLE = "assistant"
#: First character, then the rest, of every control string.
_CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"

PIECES = "conv_id long, piece long, n_turns long, formatted string, loss_start array<long>, loss_bytes array<long>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring(texts, "\\", "\\\\"), _CONTROL, r"\1\\\2")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"(?s)\\(.)", r"\1")


def _scatter(out: np.ndarray, place: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> None:
    """Copies row i of a byte column to out[place[i]:]."""
    size = np.diff(ends)
    out[np.arange(len(raw)) + np.repeat(place - ends[:-1], size)] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row ends, text starts, text sizes) of one formatted buffer for all rows."""
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (TURN, SAYS, END)]
    role_raw, role_ends = bw.text_buffer(escape(roles))
    text_raw, text_ends = bw.text_buffer(escape(texts))
    n = len(roles)
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = (len(m) for m in marks)
    sizes[:, 1], sizes[:, 3] = np.diff(role_ends), np.diff(text_ends)
    stops = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = stops - sizes
    out = np.empty(int(stops[-1, 4]) if n else 0, np.uint8)
    for column, mark in zip((0, 2, 4), marks, strict=True):
        out[starts[:, column][:, None] + np.arange(len(mark))] = mark
    _scatter(out, starts[:, 1], role_raw, role_ends)
    _scatter(out, starts[:, 3], text_raw, text_ends)
    return out, np.concatenate([[0], stops[:, 4]]), starts[:, 3], sizes[:, 3]


def _format(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # A null conversation number is a conversation of its own.
            conv, known = batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_valid())
            out, ends, text_at, text_size = assemble(batch.column(1).fill_null(""), batch.column(2).fill_null(""))
            new = np.flatnonzero((conv[1:] != conv[:-1]) | (known[1:] != known[:-1])) + 1
            lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(conv)]])
            loss = np.asarray(pc.equal(batch.column(1).fill_null(""), loss_role))
            first = (conv[0], known[0])
            numbers = np.zeros(len(lo), np.int64)
            numbers[0] = pieces if first == last else 0
            last, pieces = (conv[-1], known[-1]), int(numbers[-1]) + 1
            formatted = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(np.concatenate([ends[lo], ends[hi[-1:]]]).astype(np.int64)), pa.py_buffer(out))
            own = np.repeat(ends[lo], hi - lo)[loss]
            spans = np.concatenate([[0], np.cumsum(np.add.reduceat(loss.astype(np.int32), lo))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x)) for x in (text_at[loss] - own, text_size[loss])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo)), pa.array(numbers), pa.array(hi - lo), formatted.cast(pa.string()), *lists], schema=pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_bytes", pa.list_(pa.int64()))]))

    return run


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss_start, loss_bytes), pieces of a conversation in order in one partition.

    ``turns`` has (conv_id, turn, role, text). Null roles and texts count as empty, null turns come first, rows of one
    turn are ordered by role and text, and repeated rows are repeated turns; further columns are not read; an empty table
    gives no conversation.
    """
    small_batches(turns.sparkSession)
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(loss_role), PIECES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from formatted text alone."""
    turns = [part.partition(SAYS) for part in formatted.split(TURN)[1:]]
    flat = unescape(pa.array([x for role, _, text in turns for x in (role, text.removesuffix(END))], pa.string())).to_pylist()
    return list(zip(flat[::2], flat[1::2], strict=True))


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, starts: list[int], sizes: list[int]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        raw = formatted.encode()
        masked = unescape(pa.array([raw[a : a + n].decode() for a, n in zip(starts, sizes, strict=True)], pa.string())).to_pylist()
        for text in masked:
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its pieces in order; only running digests are kept."""
    at: tuple | None = None
    state = _Digest()

    def row() -> tuple:
        return at[0], state.n_turns, state.turns.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)

    for batch in batches:
        done = []
        for conv, formatted, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_bytes")), strict=True):
            if at != (conv,):
                if at is not None:
                    done.append(row())
                at, state = (conv,), _Digest()
            state.add(formatted, starts, sizes)
        if done:
            yield sent(done)
    if at is not None:
        yield sent([row()])


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from ``format_chats`` output.

    Conversations without a number are one conversation with a null number; numbers keep all their digits. No pieces give no row.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_start", "loss_bytes").mapInArrow(_digests, schema)
