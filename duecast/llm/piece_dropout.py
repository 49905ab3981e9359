"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type segmentation: of all candidate merges of a word the one with the best score (leftmost on
ties) is taken from the agenda until none is left. Every candidate is skipped with probability
``dropout``, decided by a hash of (seed, document, word, place, merged piece), so each word is cut
in varied ways but the same row always in the same way, on any executor and after any retry.

All words of a batch that have the same number of characters are worked on together: one round takes
one merge of every word, so a word's agenda is a row of a matrix that loses one column a round. Words
over ``MATRIX_CHARS`` characters use a heap instead; both give the same pieces.

Nothing is lost: characters outside the vocabulary, and the space mark itself, become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecast.llm import bytewords as bw

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
MATRIX_CHARS = 40
MARK = "▁"
_NONE = np.int32(2**31 - 1)
_U = np.uint64
_BLOCK_ROWS = 8192


class Pieces:
    """Tables of one vocabulary as arrays: they travel to the workers, the model file need not."""

    def __init__(self, model_path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)]
        ids = {name: i for i, name in enumerate(names) if not special[i]}
        if any(MARK in name.lstrip(MARK) for name in ids):
            raise ValueError("A piece holds the space mark after other characters; words cannot be cut at spaces.")
        scores = sorted({model.get_score(i) for i in ids.values()}, reverse=True)
        order = {score: k for k, score in enumerate(scores)}
        self.count = count
        self.rank = np.full(count, _NONE, np.int32)
        for i in ids.values():
            self.rank[i] = order[model.get_score(i)]
        self.first_byte = next(i for i in range(count) if model.is_byte(i))
        chars = {ord(name): i for name, i in ids.items() if len(name) == 1}
        self.char = np.full(1 << 16, -1, np.int32)
        for point, i in chars.items():
            if point < 1 << 16:
                self.char[point] = i
        beyond = sorted(point for point in chars if point >= 1 << 16)
        self.beyond, self.beyond_id = np.array(beyond, np.uint32), np.array([chars[p] for p in beyond], np.int32)
        self.space = ids[MARK]
        pairs = [(ids[name[:k]], ids[name[k:]], i) for name, i in ids.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids]
        self._build(np.array(pairs, np.int64))
        raw = [bytes([i - self.first_byte]) if model.is_byte(i) else b"" if special[i] else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def _build(self, pairs: np.ndarray) -> None:
        self.bits = max(16, int(len(pairs)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        keys, merged = pairs[:, 0] * self.count + pairs[:, 1], pairs[:, 2].astype(np.int32)
        slot = self._slot(keys)
        while len(keys):  # each free slot takes one key, the others try the next slot
            _, pick = np.unique(slot, return_index=True)
            pick = pick[self.keys[slot[pick]] == -1]
            self.keys[slot[pick]], self.merged[slot[pick]] = keys[pick], merged[pick]
            left = np.ones(len(keys), bool)
            left[pick] = False
            keys, merged, slot = keys[left], merged[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        keys = left.astype(np.int64) * self.count + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.merged[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def _ranks(p: Pieces, left: np.ndarray, right: np.ndarray, word: np.ndarray, place: np.ndarray, limit: np.uint64) -> np.ndarray:
    """The rank of each candidate merge; none where there is no piece or the keyed hash skips it."""
    joined = p.join(left, right)
    rank = np.where(joined >= 0, p.rank[joined], _NONE)
    if limit:
        live = np.flatnonzero(joined >= 0)
        draw = bw.mix(word[live] + place[live].astype(_U) * _U(0xD1342543DE82EF95) + joined[live].astype(_U) * _U(0x2545F4914F6CDD1D))
        rank[live[draw < limit]] = _NONE
    return rank


def _matrix(p: Pieces, symbols: np.ndarray, word: np.ndarray, limit: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, pieces) of equally long words, as they are finished."""
    n, width = symbols.shape
    rows = np.arange(n)
    place = np.tile(np.arange(width, dtype=np.int16), (n, 1))
    if width > 1:
        rank = _ranks(p, symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), np.repeat(word, width - 1), place[:, :-1].ravel(), limit).reshape(n, width - 1)
    while len(rows):
        width = symbols.shape[1]
        if width == 1:
            yield rows, symbols
            return
        best = rank.argmin(axis=1)
        line = np.arange(len(rows))
        done = rank[line, best] == _NONE
        if done.any():
            yield rows[done], symbols[done]
            go = ~done
            rows, symbols, place, rank, best, word = rows[go], symbols[go], place[go], rank[go], best[go], word[go]
            line = line[: len(rows)]
            if not len(rows):
                return
        symbols[line, best] = p.join(symbols[line, best], symbols[line, best + 1])
        keep = np.ones(symbols.shape, bool)
        keep[line, best + 1] = False
        symbols, place = symbols[keep].reshape(len(rows), width - 1), place[keep].reshape(len(rows), width - 1)
        keep = np.ones(rank.shape, bool)
        keep[line, best] = False
        rank = rank[keep].reshape(len(rows), width - 2)
        for shift, some in ((1, np.flatnonzero(best > 0)), (0, np.flatnonzero(best < width - 2))):
            at = best[some] - shift
            rank[some, at] = _ranks(p, symbols[some, at], symbols[some, at + 1], word[some], place[some, at], limit)


def _heap(p: Pieces, symbols: np.ndarray, word: np.uint64, limit: np.uint64) -> np.ndarray:
    """The pieces of one long word."""
    n = len(symbols)
    piece, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    first = _ranks(p, symbols[:-1], symbols[1:], np.full(n - 1, word), np.arange(n - 1), limit)
    agenda = [(int(r), i, piece[i], piece[i + 1]) for i, r in enumerate(first) if r != _NONE]
    heapq.heapify(agenda)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            a, b = np.array([piece[i]]), np.array([piece[after[i]]])
            rank = _ranks(p, a, b, np.array([word]), np.array([i]), limit)[0]
            if rank != _NONE:
                heapq.heappush(agenda, (int(rank), i, piece[i], piece[after[i]]))

    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if piece[i] != a or j >= n or piece[j] != b:
            continue
        piece[i], piece[j], after[i] = int(p.join(np.array([a]), np.array([b]))[0]), -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return np.array([x for x in piece if x >= 0], np.int32)


def encode_texts(p: Pieces, raw: np.ndarray, ends: np.ndarray, keys: np.ndarray, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, ends) of the texts in a byte buffer; ``keys`` names the rows."""
    limit = _U(min(int(dropout * 2**64), 2**64 - 1))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    char_at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    bounds = char_at[ends]
    full = np.flatnonzero(np.diff(bounds) > 0)
    points = np.insert(points, bounds[full], 32)  # the leading space that the model expects
    starts = bounds[full] + np.arange(len(full))
    gap = points == 32
    symbols = np.where(points < 1 << 16, p.char[np.minimum(points, (1 << 16) - 1)], np.int32(-1))
    far = np.flatnonzero(points >= 1 << 16)
    if len(far) and len(p.beyond):
        at = np.minimum(np.searchsorted(p.beyond, points[far]), len(p.beyond) - 1)
        symbols[far] = np.where(p.beyond[at] == points[far], p.beyond_id[at], -1)
    symbols[gap], symbols[points == ord(MARK)] = p.space, -1
    alone = symbols < 0
    cut = np.zeros(len(points), bool)
    cut[starts] = True
    cut[1:] |= (gap[1:] & ~gap[:-1]) | alone[1:] | alone[:-1]
    first = np.flatnonzero(cut)
    size = np.diff(np.concatenate([first, [len(points)]]))
    doc = full[np.searchsorted(starts, first, "right") - 1] if len(first) else np.zeros(0, np.int64)
    opening = np.searchsorted(doc, doc, "left")
    word = bw.mix(bw.mix(keys[doc].astype(_U) + _U(seed * 0x9E3779B97F4A7C15 % 2**64)) + (np.arange(len(first)) - opening).astype(_U))
    count = np.zeros(len(first), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    odd = np.flatnonzero(alone[first]) if len(first) else first
    for width, (low, high) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)), 1):
        some = odd[(points[first[odd]] >= low) & (points[first[odd]] < high)]
        if len(some):
            data = np.frombuffer("".join(map(chr, points[first[some]])).encode(), np.uint8).reshape(-1, width)
            found.append((some, data.astype(np.int32) + p.first_byte))
    plain = np.flatnonzero(~alone[first]) if len(first) else first
    plain = plain[np.argsort(size[plain], kind="stable")]
    for group in np.split(plain, np.flatnonzero(np.diff(size[plain])) + 1):
        if not len(group):
            continue
        width = size[group[0]]
        if width > MATRIX_CHARS:
            found += [(np.array([g]), _heap(p, symbols[first[g] : first[g] + width], word[g], limit)[None, :]) for g in group]
            continue
        for at in range(0, len(group), _BLOCK_ROWS):
            block = group[at : at + _BLOCK_ROWS]
            found += [(block[rows], pieces) for rows, pieces in _matrix(p, symbols[first[block][:, None] + np.arange(width)], word[block], limit)]
    for words, pieces in found:
        count[words] = pieces.shape[1]
    place = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(place[-1], np.int32)
    for words, pieces in found:
        out[place[words][:, None] + np.arange(pieces.shape[1])] = pieces
    return out, place[np.searchsorted(doc, np.arange(len(ends)), "left")]


def decode_pieces(p: Pieces, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of the texts that the pieces stand for, without the leading space."""
    size = p.size[pieces]
    stop = np.concatenate([[0], np.cumsum(size)])
    raw = p.bytes[np.arange(stop[-1]) + np.repeat(p.at[pieces] - stop[:-1], size)]
    text_ends = stop[ends]
    lead = text_ends[:-1][np.diff(text_ends) > 0]
    return np.delete(raw, lead), text_ends - np.searchsorted(lead, text_ends, "left")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, check: bool = False) -> DataFrame:
    """(doc_id, ids) of every row and, with ``check``, ``lossless``: whether decoding gave the same bytes.

    Null and empty texts have no pieces; a null number counts as 0 in the hash; repeated rows get equal pieces; an
    empty table gives an empty result. Only the two named columns are read.
    """
    from duecast.llm.ngram_join import small_batches

    p = Pieces(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = bw.text_buffer(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy()
            for a, b in bw.chunks(ends, 1 << 20):
                part, cuts = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                pieces, stops = encode_texts(p, part, cuts, keys[a:b], dropout, seed)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(pieces))]
                if check:
                    back, back_ends = decode_pieces(p, pieces, stops)
                    digest = [hashlib.sha256(back[back_ends[i] : back_ends[i + 1]].tobytes()).hexdigest() for i in range(b - a)]
                    same = [digest[i] == hashlib.sha256(part[cuts[i] : cuts[i + 1]].tobytes()).hexdigest() for i in range(b - a)]
                    columns += [pa.array(digest, pa.string()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded_sha256", "lossless"][: len(columns)])

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded_sha256 string, lossless boolean" if check else ""))


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none."""
    p = Pieces(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            raw, ends = decode_pieces(p, batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
            texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
