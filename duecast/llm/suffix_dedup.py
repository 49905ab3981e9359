"""Removes repeated byte strings with a distributed difference-cover suffix sort.

Every 100-byte string names one of its own 24-byte grams, the leftmost with the smallest hash: its
anchor. Equal strings have equal anchors at the same place, so strings can only meet in the bucket of
their anchor's hash, and the suffix sort can be dealt out by anchors without comparing across tasks:

1. A document is cut into blocks, the runs of string starts with one anchor. Blocks with the same
   bytes are collapsed: all but the first are repeats as a whole. Tasks settle most copies of frequent
   blocks where they find them, so that one anchor sends a few rows a task; one sorted pass settles the
   rest. Blocks whose anchor occurs once cannot repeat and are dropped.
2. What is left, blocks with a shared anchor but other bytes around it, is sorted (where the 38 bytes on one
   side of the anchor are shared too; else nothing of 100 bytes can be) by the difference-cover method: sort and name the triples at two of three positions, recurse on the names
   while they are not unique, sort the remaining suffixes by one letter and the rank behind it, and
   merge. Adjacent suffixes with the same first 100 bytes are equal strings; the earliest stays.
3. Anchors with more than ``HOT_BLOCKS`` differing blocks would make one task large. Their strings
   are hashed (128 bits) and counted position by position with map-side combining instead.

Block borders, hashes and the bytes of differing blocks are shuffled. Texts are shuffled once by document, for
both joins (cutting out the blocks, and dropping the removed bytes); every size of input goes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecast.llm import bytewords as bw
from duecast.llm.ngram_join import batch_limits
from duecast.session import materialize

LENGTH = 100
GRAM = 24
#: Blocks of at most 175 bytes that are sorted together: about as many as let three names share a 64-bit key.
HOT_BLOCKS = 16_000
#: Bytes sorted at a time, beside those of the anchor that passes it; blocks of one anchor always stay together.
SORT_BYTES = 300_000
#: Frequent blocks that a task remembers, 40 bytes each. Beyond it more copies go to the sorted pass; the result is the same.
REMEMBERED = 200_000
_U = np.uint64
_TOP = _U(2**64 - 1)


def _running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and the inverse powers that make any span's hash independent of its place."""
    n = len(raw)
    sums = np.zeros(n + 1, _U)
    np.cumsum(bw._BYTE_CODES[raw] * bw._power_table(bw._STEP, n), out=sums[1:])
    return sums, bw._power_table(bw._UNSTEP, n + 1)


def blocks(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, block hash) of every block in a byte buffer of rows."""
    n, none = len(raw), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    sums, back = _running(raw)
    grams = bw.mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    grams[left[: n - GRAM + 1] < GRAM] = _TOP
    value, place, span, window = grams, np.arange(len(grams), dtype=np.int32), 1, LENGTH - GRAM + 1

    def lower(shift: int) -> None:
        nonlocal value, place
        m = len(value) - shift
        right = value[shift:] < value[:m]
        value, place = np.where(right, value[shift:], value[:m]), np.where(right, place[shift:], place[:m])

    while span * 2 <= window:
        lower(span)
        span *= 2
    if span < window:
        lower(window - span)
    whole = left[: len(place)] >= LENGTH
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    first = np.flatnonzero(whole & change)
    if not len(first):
        return none, none, none, none, none
    last_of = np.ones(len(place), bool)
    last_of[:-1] = change[1:] | ~whole[1:]
    last = np.flatnonzero(whole & last_of)
    anchor = place[first].astype(np.int64)
    inner = bw.chain((sums[last + LENGTH] - sums[first]) * back[first], (last - first).astype(_U), (anchor - first).astype(_U))
    row = np.searchsorted(ends, first, "right") - 1
    return row, first - ends[row], last - ends[row], grams[anchor].astype(np.int64), inner.astype(np.int64)


class _Frequent:
    """Blocks found several times by one task, with the earliest row at that time, which was sent on as open."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, _U)
        self.rows = np.zeros((0, 5), np.int64)

    def settle(self, rows: np.ndarray) -> np.ndarray:
        """Marks rows (anchor, inner, id, same, first) that repeat an earlier block of this task."""
        keys = bw.chain(rows[:, 0].astype(_U), rows[:, 1].astype(_U))
        order = np.argsort(keys)
        keys = keys[order]
        several = np.zeros(len(rows), bool)
        several[1:] = keys[1:] == keys[:-1]
        several[:-1] |= several[1:]
        marked = np.zeros(len(rows), bool)
        heads, at = order[~several], keys[~several]
        again = order[several]
        if len(again):
            again = again[np.lexsort(rows[again].T[::-1])]
            sorted_ = rows[again]
            opens = np.ones(len(again), bool)
            opens[1:] = (sorted_[1:, :2] != sorted_[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(opens)
            least = np.repeat(starts, np.diff(np.append(starts, len(again))))
            marked[again] = (sorted_ != sorted_[least]).any(axis=1)  # the same row again is not a repeat
            again = again[starts]
            heads, at = np.concatenate([heads, again]), np.concatenate([at, bw.chain(rows[again, 0].astype(_U), rows[again, 1].astype(_U))])
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
            met = np.flatnonzero(self.keys[place] == at)
            known, here = self.rows[place[met]], rows[heads[met]]
            before = known[:, 2] < here[:, 2]
            for k in (3, 4):
                before |= (known[:, 2:k] == here[:, 2:k]).all(axis=1) & (known[:, k] < here[:, k])
            marked[heads[met[before & (known[:, :2] == here[:, :2]).all(axis=1)]]] = True
        again = again[: max(0, REMEMBERED - len(self.keys))]
        if len(again):
            fresh = bw.chain(rows[again, 0].astype(_U), rows[again, 1].astype(_U))
            self.keys, kept = np.unique(np.concatenate([self.keys, fresh]), return_index=True)
            self.rows = np.concatenate([self.rows, rows[again]])[kept]
        return marked


def _find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, inner, id, same, first, last) of every block; settled repeats have -1 - last, and a key of their place as anchor."""
    frequent = _Frequent()
    for batch in batches:
        raw, ends = bw.text_buffer(batch.column(2))
        ids, same = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b in bw.chunks(ends, 2 << 20):
            row, first, last, anchor, inner = blocks(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            if not len(row):
                continue
            id_, same_ = ids[a + row], same[a + row]
            settled = frequent.settle(np.stack([anchor, inner, id_, same_, first], axis=1))
            anchor = np.where(settled, bw.chain(id_.astype(_U), first.astype(_U)).astype(np.int64), anchor)
            inner, last = np.where(settled, 0, inner), np.where(settled, -1 - last, last)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, inner, id_, same_, first, last)], names=["anchor", "inner", "id", "same", "first", "last"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted blocks: (whole, anchor, id, same, first, last); ``whole`` marks repeats of an earlier block."""
    before = waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        settled = rows[:, 5] < 0
        if settled.any():
            done, rows = rows[settled], rows[~settled]
            done[:, 5] = -1 - done[:, 5]
            yield _flagged(done, done[:0])
            if not len(rows):
                continue
        if before is not None:
            rows = np.concatenate([before[None], rows])
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)  # the same row again is not a repeat
        start = 0 if before is None else 1
        new_anchor, new_inner = np.ones(len(rows), bool), np.ones(len(rows), bool)
        new_anchor[1:] = rows[1:, 0] != rows[:-1, 0]
        new_inner[1:] = new_anchor[1:] | (rows[1:, 1] != rows[:-1, 1])
        whole = rows[start:][(~new_inner & fresh)[start:]]
        first = np.flatnonzero(new_inner[start:]) + start
        found, opens = rows[first], new_anchor[first]
        if waiting is not None:
            found, opens = np.concatenate([waiting[0], found]), np.concatenate([waiting[1], opens])
        shared = ~opens
        shared[:-1] |= ~opens[1:]
        keep = found[:-1][shared[:-1]] if len(found) else found
        # The last block waits: whether its anchor is shared shows with the next one.
        waiting, before = (found[-1:], opens[-1:]), rows[-1]
        yield _flagged(whole, keep)
    if waiting is not None and not waiting[1][0]:
        yield _flagged(waiting[0][:0], waiting[0])


def _flagged(whole: np.ndarray, differing: np.ndarray) -> pa.RecordBatch:
    flag = np.concatenate([np.ones(len(whole), bool), np.zeros(len(differing), bool)])
    rows = np.concatenate([whole, differing])
    return pa.RecordBatch.from_arrays([pa.array(flag), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 2, 3, 4, 5)]], names=["whole", "anchor", "id", "same", "first", "last"])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of positive letters in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    letters = np.concatenate([s, np.zeros(4, np.int64)])
    sample = np.arange(n + (n % 3 == 1))
    sample = sample[sample % 3 != 0]
    base = int(s.max()) + 1
    keys, names = np.unique((letters[sample] * base + letters[sample + 1]) * base + letters[sample + 2], return_inverse=True)
    names = names + 1
    rank = np.zeros(n + 4, np.int64)
    if len(keys) < len(sample):
        one = sample % 3 == 1
        places = np.concatenate([sample[one], sample[~one]])
        order = suffix_array(np.concatenate([names[one], names[~one]]))
        rank[places[order]] = np.arange(1, len(order) + 1)
    else:
        rank[sample] = names
    sampled = np.empty(len(sample), np.int64)
    sampled[rank[sample] - 1] = sample
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], letters[rest]))]
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), len(sampled))
    while True:  # how many sampled suffixes come before each of the rest
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        i, j = rest[open_], sampled[middle]
        near = j % 3 == 1
        head = letters[j] - letters[i]
        second = np.where(near, rank[j + 1] - rank[i + 1], letters[j + 1] - letters[i + 1])
        third = np.where(near, 0, rank[j + 2] - rank[i + 2])
        before = (head < 0) | ((head == 0) & ((second < 0) | ((second == 0) & (third < 0))))
        low[open_[before]], high[open_[~before]] = middle[before] + 1, middle[~before]
    out = np.empty(n, np.int64)
    at = low + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def later_strings(raw: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, offset) of every 100-byte string that an earlier one equals; ``order`` ranks the blocks."""
    count, size = len(ends) - 1, np.diff(ends)
    owner = np.repeat(np.arange(count), size)
    offset = np.arange(len(raw)) - ends[owner]
    letters = np.empty(len(raw) + count, np.int64)
    shifted = np.arange(len(raw)) + owner  # one separator, different for each block, after every block
    letters[shifted] = raw.astype(np.int64) + 1 + count
    letters[ends[1:] + np.arange(count)] = np.arange(1, count + 1)
    sorted_ = suffix_array(letters)
    place = np.full(len(letters), -1, np.int64)
    place[shifted] = np.arange(len(raw))
    at = place[sorted_]
    at = at[at >= 0]
    at = at[size[owner[at]] - offset[at] >= LENGTH]
    if not len(at):
        return at, at
    view = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    new = np.ones(len(at), bool)
    for a in range(1, len(at), 16384):
        b = min(a + 16384, len(at))
        new[a:b] = (view[at[a:b]] != view[at[a - 1 : b - 1]]).any(axis=1)
    when = order[owner[at]] * 256 + offset[at]
    starts = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(when, starts), np.diff(np.concatenate([starts, [len(at)]])))
    later = at[when != earliest]
    return owner[later], offset[later]


def may_repeat(raw: np.ndarray, ends: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether a block can share a 100-byte string with another of its anchor.

    Such a string reaches at least half of what it has beside the anchor to the left or to the right of it; blocks whose
    anchor with that much on its left is met nowhere else, nor with that much on its right, share none.
    """
    reach, count = (LENGTH - GRAM + 1) // 2, len(ends) - 1
    sums, back = _running(raw)
    grams = bw.mix((sums[GRAM:] - sums[: len(raw) - GRAM + 1]) * back[: len(raw) - GRAM + 1])
    owner = np.repeat(np.arange(count), np.diff(ends))[: len(grams)]
    hits = np.flatnonzero(grams == anchors[owner].astype(_U))
    hits = hits[hits + GRAM <= ends[owner[hits] + 1]]
    # Any place of the anchor in the block may be the one; all of them are compared.
    block = owner[hits]
    keep = np.zeros(count, bool)
    for start, stop in ((hits - reach, hits + GRAM), (hits, hits + GRAM + reach)):
        inside = np.flatnonzero((start >= ends[block]) & (stop <= ends[block + 1]))
        side = bw.mix((sums[stop[inside]] - sums[start[inside]]) * back[start[inside]])
        _, names, times = np.unique(side, return_inverse=True, return_counts=True)
        keep[block[inside[times[names] > 1]]] = True
    return keep


def _runs(block: np.ndarray, offset: np.ndarray, ids: np.ndarray, same: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Starts in a row as (id, same, first, last)."""
    order = np.lexsort((offset, block))
    block, offset = block[order], offset[order]
    cut = np.ones(len(block), bool)
    cut[1:] = (block[1:] != block[:-1]) | (offset[1:] != offset[:-1] + 1)
    start = np.flatnonzero(cut)
    stop = np.concatenate([start[1:], [len(block)]]) - 1 if len(start) else start
    b = block[start]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[b], same[b], first[b] + offset[start], first[b] + offset[stop])], names=["id", "same", "first", "last"])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later strings among the blocks of each anchor; rows come sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        ids, same, first = (table.column(k).to_numpy() for k in (1, 2, 3))
        column = table.column(4).combine_chunks().cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        keep = may_repeat(raw, ends, table.column(0).to_numpy())
        raw, ends = raw[np.repeat(keep, np.diff(ends))], np.concatenate([[0], np.cumsum(np.diff(ends)[keep])])
        ids, same, first = ids[keep], same[keep], first[keep]
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((first, same, ids))] = np.arange(len(ids))
        return _runs(*later_strings(raw, ends, order), ids, same, first)

    for batch in batches:
        held.append(batch)
        size += batch.column(4).nbytes
        if size >= SORT_BYTES:
            table = pa.Table.from_batches(held)
            anchors = table.column(0).to_numpy()
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            lengths = np.cumsum([len(x) for x in table.column(4).to_pylist()])
            done = 0
            for cut in cuts:
                if lengths[cut - 1] - (lengths[done - 1] if done else 0) >= SORT_BYTES:
                    yield work(table.slice(done, cut - done))
                    done = int(cut)
            rest = table.slice(done)
            held, size = rest.to_batches(), int(lengths[-1] - (lengths[done - 1] if done else 0))
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        anchors = table.column(0).to_numpy()
        yield work(table)


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, id, same, at) of every 100-byte string of the blocks."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            ids, same, first = (part.column(k).to_numpy() for k in (1, 2, 3))
            column = part.column(4).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw, ends = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
            count = np.diff(ends) - LENGTH + 1
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(ends[:-1], count) + offset
            sums, back = _running(raw)
            ahead = bw.mix((sums[at + LENGTH] - sums[at]) * back[at])
            sums, back = _running(raw[::-1])
            mirror = len(raw) - at - LENGTH
            behind = bw.mix((sums[mirror + LENGTH] - sums[mirror]) * back[mirror])
            columns = (ahead.astype(np.int64), behind.astype(np.int64), np.repeat(ids, count), np.repeat(same, count), np.repeat(first, count) + offset)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h1", "h2", "id", "same", "at"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte runs (id, same, start, stop) from start runs sorted by (id, same, first)."""
    held: list[int] | None = None
    for batch in batches:
        out = []
        for i, s, first, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[:2] == [i, s] and first <= held[3]:
                held[3] = max(held[3], last + LENGTH)
            else:
                if held:
                    out.append(held)
                held = [i, s, first, last + LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["id", "same", "start", "stop"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[k]], pa.int64()) for k in range(4)], names=["id", "same", "start", "stop"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, same, first, bytes) of every wanted block."""
    for batch in batches:
        raw, ends = bw.text_buffer(batch.column(2))
        wanted = batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        anchor, first, last = (c.to_numpy() for c in wanted.flatten().flatten())
        for a in range(0, len(row), 20_000):
            part = slice(a, a + 20_000)
            start = ends[row[part]] + first[part]
            size = last[part] + LENGTH - first[part]
            stops = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.arange(stops[-1]) + np.repeat(start - stops[:-1], size)]
            cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])
            rows = pa.array(row[part])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first[part]), cut], names=["anchor", "id", "same", "first", "bytes"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, kept = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, at, parts = (text or "").encode(), 0, []
            for span in spans or []:
                parts.append(raw[at : span["start"]])
                at = span["stop"]
            sizes.append(len(raw))
            kept.append(b"".join([*parts, raw[at:]]))
        spans = batch.column(2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): UTF-8 bytes without those covered by a 100-byte string that starts earlier.

    Earlier means in a document with a smaller number, or before in the same one; a null number comes first. Null
    texts are empty; texts under 100 bytes stay whole. Rows equal in number and text are one document and get
    equal results; rows that share only the number are ordered by a hash of their text. No rows, no result.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unique = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    same = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = plain.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), same.alias("same"), "text")
    found = keyed.select("id", "same", "text").mapInArrow(_find_blocks, "anchor long, inner long, id long, same long, first long, last long")
    order = ["anchor", "inner", "id", "same", "first"]
    collapsed = found.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_collapse, "whole boolean, anchor long, id long, same long, first long, last long")
    collapsed = materialize(collapsed, "blocks")
    differing = collapsed.where("not whole")
    hot = materialize(differing.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_BLOCKS).select("anchor"), "hot-anchors")
    # Texts, and the lists that are joined to them, meet by merge joins at every size: all of them read one shuffle of the texts.
    texts = keyed.select("doc_id", "id", "same", "text")

    def cut_out(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy("id", "same").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))
        met = texts.join(wanted.hint("merge"), ["id", "same"]).select("id", "same", "text", "wanted", "doc_id")
        pieces = met.mapInArrow(_cut_out, "anchor long, id long, same long, first long, bytes binary")
        return pieces if unique else pieces.distinct()

    crowded = not hot.isEmpty()
    calm = cut_out(differing.join(hot, "anchor", "left_anti") if crowded else differing)
    later = calm.repartition("anchor").sortWithinPartitions("anchor", "id", "same", "first").mapInArrow(_sort_blocks, "id long, same long, first long, last long")
    covered = collapsed.where("whole").select("id", "same", "first", "last").unionByName(later)
    if crowded:
        strings = cut_out(differing.join(hot, "anchor", "left_semi")).mapInArrow(_hash_strings, "h1 long, h2 long, id long, same long, at long")
        earliest = strings.groupBy("h1", "h2").agg(F.min(F.struct("id", "same", "at")).alias("earliest"))
        again = strings.join(earliest, ["h1", "h2"]).where(F.struct("id", "same", "at") != F.col("earliest"))
        covered = covered.unionByName(again.select("id", "same", F.col("at").alias("first"), F.col("at").alias("last")))
    merged = covered.repartition("id", "same").sortWithinPartitions("id", "same", "first", "last").select("id", "same", "first", "last").mapInArrow(_merge, "id long, same long, start long, stop long")
    spans = merged.groupBy("id", "same").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    joined = texts.join(spans.hint("merge"), ["id", "same"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_keep, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
