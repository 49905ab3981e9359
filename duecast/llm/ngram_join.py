"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes the set of its distinct three-word shingles, hashed to 63 bits. Equal sets are
   collapsed: only the smallest document of each set goes on, and sets so small that one more shingle
   falls below the limit (under nine at 0.9) can link with equal sets only.
2. Sets are partitioned into groups of similar sets: those made mostly of shingles that many documents
   hold are grouped by the smallest of these, the others by their smallest shingle that a few hold. Groups over
   ``CHUNK`` members are dealt into chunks by hash, so that no group grows with the data.
3. The matrix holds the union of each group's tokens, as rows (token, group). Two linked sets share
   ``shared_tokens`` of their first tokens in one global order (rare ones first), so the union needs these
   tokens alone. Each set is a query: its overlap with every union is counted, and only groups that
   reach the bound are opened.
4. Queries are sent to one unit of work per pair of groups. There each is bounded again by its overlap
   with the union of all tokens of the other side, and only if that allows a link, compared with the
   members that asked back. A unit emits a spanning forest of its links, never all of them.
5. Links between groups are joined into components by alternating large and small stars.

The order of tokens and the groups decide the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duecast.llm import bytewords as bw
from duecast.session import materialize

WORDS = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
SHARED = 3
CHUNK = 256
#: Tokens held by this many documents or more come last in the global order.
COMMON = 16
#: Rows up to which a table is sent to every executor (8 to 32 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: The same for tokens of several sets, nine bytes each.
SHARED_TOKENS = 4_000_000

_SKETCH = "doc_id long, text_hash long, n long, d1 long, d2 long, low array<long>"


def prefix_size(n, percent: int = PERCENT):
    """First tokens of a set of ``n`` of which a linked set holds ``shared_tokens`` among its own."""
    return n - (percent * n + 99) // 100 + shared_tokens(percent)


def low_limit(percent: int) -> int:
    """Tokens below this hash are counted over the corpus and so ordered by rarity.

    Two and a half times a prefix: even a set that is half a common passage then fills its prefix with its own tokens.
    """
    return int(min(1.0, 2.5 * (100 - percent) / 100) * 2**63) - 1


def least_size(percent: int = PERCENT) -> int:
    """The smallest set that can link with another than its equal: n / (n + 1) reaches the limit."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**62


def shared_tokens(percent: int = PERCENT) -> int:
    """Tokens that any two linked sets share and that open a group: ``SHARED``, or fewer where sets with fewer can link."""
    return min(SHARED, least_size(percent))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 63-bit shingle hashes) for every row with a word."""
    raw, ends = bw.text_buffer(column)
    for a, b in bw.chunks(ends):
        part, cuts = bw.LOWER[raw[ends[a] : ends[b]]], ends[a : b + 1] - ends[a]
        first, stop, row = bw.word_spans(part, cuts, bw.SPACE_WORDS)
        hashes = bw.word_hashes(part, first, stop)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        if len(hashes) >= words:
            grams = bw.chain(*[hashes[i : len(hashes) - words + 1 + i] for i in range(words)]) >> np.uint64(1)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= words:
                yield a + i, np.unique(grams[lo : hi - words + 1]).astype(np.int64)
            elif hi > lo:
                yield a + i, (bw.chain(*[hashes[k : k + 1] for k in range(lo, hi)]) >> np.uint64(1)).astype(np.int64)


def _sketches(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, one, two, low, low_ends = [], [], [], [], [], [0]
            for row, tokens in shingle_sets(batch.column(1), words):
                keep = max(int(np.searchsorted(tokens, low_limit(percent))), min(len(tokens), prefix_size(len(tokens), percent)))
                rows.append(row)
                sizes.append(len(tokens))
                for part, sums in zip(digest(tokens), (one, two), strict=True):
                    sums.append(part)
                low.append(tokens[:keep])
                low_ends.append(low_ends[-1] + keep)
            missing = np.setdiff1d(np.arange(batch.num_rows), rows)
            gap, n = len(missing), len(rows)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(np.concatenate([np.array(rows, np.int64), missing]))).cast(pa.int64()) for k in (0, 2)),
                    pa.array(np.concatenate([np.array(sizes, np.int64), np.zeros(gap, np.int64)])),
                    pa.array(np.concatenate([np.array(one, np.uint64), np.zeros(gap, np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([np.array(two, np.uint64), np.zeros(gap, np.uint64)]).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.array(low_ends + [low_ends[-1]] * gap, np.int32)), pa.array(flat)) if n + gap else pa.array([], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n", "d1", "d2", "low"],
            )

    return run


def digest(tokens: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set: sums of two mixes of its tokens."""
    hashed = tokens.astype(np.uint64)
    return bw.mix(hashed).sum(dtype=np.uint64), bw.mix(hashed ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def _blobs(words: int):
    """(node, tokens) of documents whose set still is the one that ``node`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows, blobs = batch.column(2).to_numpy(), [], []
            for row, tokens in shingle_sets(batch.column(1), words):
                if digest(tokens)[0].astype(np.int64) == nodes[row]:
                    rows.append(row)
                    blobs.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows, pa.int64())), pa.array(blobs, pa.binary())], names=["node", "tokens"])

    return run


def _member(values: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(values, tokens), len(values) - 1)] == tokens if len(values) else np.zeros(len(tokens), bool)


def _prefixes(percent: int, shared: np.ndarray | None, common: np.ndarray | None):
    """(node, grp, first) from (node, n, low) and, where the tables are not given, each set's own held tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            low = batch.column(2)
            flat, ends = low.flatten().to_numpy(), np.concatenate([[0], np.cumsum(low.value_lengths().to_numpy())]).astype(np.int64)
            if shared is not None:
                several, often = _member(shared, flat), _member(common, flat)
            groups, first, first_ends = [], [], [0]
            for i, n in enumerate(sizes):
                tokens = flat[ends[i] : ends[i + 1]]
                if shared is not None:
                    held, crowd = several[ends[i] : ends[i + 1]], often[ends[i] : ends[i + 1]]
                else:
                    held, crowd = (np.isin(tokens, np.array(batch.column(k)[i].as_py() or [], np.int64)) for k in (3, 4))
                near = tokens < low_limit(percent)
                alone, few, many, rest = tokens[near & ~held], tokens[near & held & ~crowd], tokens[near & crowd], tokens[~near]
                if 2 * len(many) > len(alone) + len(few) + len(many):
                    groups.append(many[0])
                else:
                    groups.append(next(x[0] for x in (few, rest, many, alone) if len(x)))
                take = max(0, min(n, prefix_size(n, percent)) - len(alone))
                # A token of one set alone takes its place but meets nothing; with fewer others than a link shares there is none.
                first.append(np.concatenate([few, many, rest])[: take if take >= shared_tokens(percent) else 0])
                first_ends.append(first_ends[-1] + len(first[-1]))
            flat_first = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(groups, np.int64)), pa.ListArray.from_arrays(pa.array(np.array(first_ends, np.int32)), pa.array(flat_first))], names=["node", "grp", "first"]
            )

    return run


def _order_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(node, grp, first): each set's group and its first tokens in the global order, but those of this set alone."""
    counts = sets.select(F.explode("low").alias("token")).where(F.col("token") < low_limit(percent)).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    held = materialize(counts.where("c > 1").select("token", (F.col("c") >= COMMON).alias("often")), "shared-tokens")
    schema = "node long, grp long, first array<long>"
    if held.count() <= SHARED_TOKENS:
        table = held.toArrow()  # not toPandas(), which goes through a Python object per row
        tokens, often = table.column("token").to_numpy(), table.column("often").to_numpy()
        return sets.mapInArrow(_prefixes(percent, np.sort(tokens), np.sort(tokens[often])), schema)
    per_set = sets.select("node", F.explode("low").alias("token")).join(held, "token").groupBy("node")
    per_set = per_set.agg(F.collect_set("token").alias("held"), F.collect_set(F.when(F.col("often"), F.col("token"))).alias("crowd"))
    return sets.join(per_set, "node", "left").select("node", "n", "low", "held", "crowd").mapInArrow(_prefixes(percent, None, None), schema)


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in parent if top(x) != x]


def _compare(ids: np.ndarray, home: np.ndarray, sets: list[np.ndarray], percent: int, same: bool) -> list[tuple[int, int]]:
    """Links between the members (home) and the queries (not home) of one unit, as a forest."""
    members = np.arange(len(ids)) if same else np.flatnonzero(home)
    queries = members if same else np.flatnonzero(~home)
    if not len(members) or not len(queries):
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(members)), sizes[members])
    tokens = np.concatenate([sets[m] for m in members])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    links = []
    for q in queries:
        own = sets[q]
        at, to = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        if 100 * np.count_nonzero(to > at) < percent * len(own):
            continue
        runs = to - at
        places = np.arange(runs.sum()) + np.repeat(at - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
        common = np.bincount(owner[places], minlength=len(members))
        linked = 100 * common >= percent * (len(own) + sizes[members] - common)
        links += [(int(ids[q]), int(ids[m])) for m in members[linked] if ids[m] != ids[q]]
    return _forest(links)


def _units(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            a, b, part, ids = (table.column(k).to_numpy() for k in range(4))
            blobs = table.column(4).to_pylist()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
                sets = [np.frombuffer(x, np.int64) for x in blobs[lo:hi]]
                out += _compare(ids[lo:hi], part[lo:hi] == a[lo], sets, percent, a[lo] == b[lo])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            a, b = held.column(0).to_numpy(), held.column(1).to_numpy()
            changes = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            if len(changes):
                whole = int(changes[-1]) + 1
                yield work(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield work(held)

    return run


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root): the smallest node reachable over edges (u, v); nodes that are their own root are left out.

    Alternates large stars (a node's larger neighbours point to its smallest) and small stars (its
    smaller ones do) until nothing changes: a logarithmic number of rounds, each written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, label)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null and empty texts have no shingles and form components of their own. Repeated rows keep their
    number of rows; each row's own text decides its component, which is named by its smallest number. Rows without
    a number are linked like others; where a component has no number at all its name is null. An empty table gives an empty result.
    """
    return keyed_components(docs, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id")


def keyed_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``ngram_components`` with ``text_hash`` and ``root``, which tells components apart where numbers repeat or are missing.

    ``root`` is null for rows without a word.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100: below, sets without a common shingle would link.")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # What finds a set's text again: the number, or the text's hash where there is none.
    pick = F.coalesce("doc_id", "text_hash").alias("pick")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    sketches = materialize(plain.select("doc_id", "text", "text_hash").mapInArrow(_sketches(words, percent), _SKETCH), "shingle-sketches")
    classes = materialize(sketches.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("text_hash")).alias("pick")), "shingle-classes")
    sets = sketches.where(F.col("n") >= least_size(percent)).select("*", pick).join(classes, ["d1", "d2", "n", "pick"], "left_semi").select(F.col("d1").alias("node"), "n", "low")
    if not sets.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])
    ordered = materialize(_order_tokens(sets.select("node", "n", "low"), percent), "shingle-order")
    big = _hinted(materialize(ordered.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK), "big-groups"))
    dealt = F.when(F.col("c") > CHUNK, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / CHUNK))).otherwise(F.lit(0))
    parts = ordered.join(big, "grp", "left").select("node", F.xxhash64("grp", dealt).alias("part"), "first")
    parts = materialize(parts, "shingle-parts")
    rows = parts.select("node", "part", F.explode("first").alias("token")).repartition("token")
    matrix = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("part", "other")
    bounds = rows.join(matrix, "token").where((F.col("part") != F.col("other")) | (F.col("members") > 1)).groupBy("node", "part", "other").agg(F.count(F.lit(1)).alias("c"))
    asked = materialize(bounds.where(F.col("c") >= shared_tokens(percent)).select("node", "part", "other"), "opened-groups")
    opened = materialize(asked.select("node").distinct().join(classes.select(F.col("d1").alias("node"), "pick"), "node").select("pick", "node"), "opened")
    blobs = materialize(plain.select("doc_id", "text", pick).join(_hinted(opened), "pick").select("doc_id", "text", "node").mapInArrow(_blobs(words), "node long, tokens binary"), "opened-sets")
    if opened.select("node").distinct().count() < blobs.count():
        blobs = blobs.dropDuplicates(["node"])
    sent = asked.join(blobs, "node").select(F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node", "tokens")
    sent = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b").sortWithinPartitions("a", "b")
    roots = components(sent.mapInArrow(_units(percent), "u long, v long"))
    rooted = classes.join(roots, classes["d1"] == roots["node"], "left").select("d1", "d2", "n", "doc_id", F.coalesce("root", "d1").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = rooted.join(smallest, "root").select("d1", "d2", "n", "component", "root")
    joined = sketches.select("doc_id", "text_hash", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "text_hash", "root")


def batch_limits(spark: SparkSession, rows: int = 20_000, size: str = "8m") -> None:
    """Texts differ widely in length; Arrow batches bounded in bytes keep the Python workers' memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    batch_limits(spark, rows)
