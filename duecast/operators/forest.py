"""Random forests of deep trees.

MLlib keeps a histogram for every node of a level and sends it whole from every part; with 140 trees of depth 18 that is
many passes a level, and the nodes become objects on the driver. Here rows are binned once. Only nodes with more rows than
a task should hold are split from shared histograms; the rows of every other node are sent to one task, which grows all
that lies below. A row's weight in a tree and a node's candidate features are hashes, so a tree is the same wherever its
nodes are grown. Trees are a Parquet table in the shared folder and go to every executor as arrays: at most
2 ** (depth + 1) nodes a tree, 7 bytes each, whatever the number of rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duecast.session import materialize

#: Rows that one task may hold to grow a part of a tree.
TASK_ROWS = 1_000_000
#: Rows of one packed piece.
CHUNK_ROWS = 16_384
#: Bytes of histograms that are looked at together.
BLOCK_BYTES = 1 << 26
#: Vectors up to this width are binned; wider ones are left to MLlib.
MOST_FEATURES = 100
#: Settings that are read here; a forest with any other is left to MLlib.
_SETTINGS = {"numTrees", "maxDepth", "minInstancesPerNode", "maxBins", "seed", "featuresCol", "labelCol", "weightCol"}

# Functions of this module travel to Python workers with the job, wherever the driver found the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def outgrows_mllib(estimator: RandomForestClassifier, rows: DataFrame) -> bool:
    """Whether MLlib needs several passes a level: histograms of all nodes of a level do not fit the memory of one."""
    if not {p.name for p in estimator.params if estimator.isSet(p)} <= _SETTINGS or estimator.getMaxBins() > 256:
        return False
    first = rows.select(estimator.getFeaturesCol()).first()
    if first is None or first[0].size > MOST_FEATURES:
        return False
    nodes = min(2 ** max(estimator.getMaxDepth() - 1, 0), rows.count() / (2 * estimator.getMinInstancesPerNode()))
    node_bytes = math.ceil(math.sqrt(first[0].size)) * estimator.getMaxBins() * 3 * 8
    if estimator.getNumTrees() * nodes * node_bytes <= estimator.getMaxMemoryInMB() << 20:
        return False
    label = F.col(estimator.getLabelCol())
    return rows.where(label.isNull() | ~label.isin(0, 1)).isEmpty()


def fit(estimator: RandomForestClassifier, rows: DataFrame, task_rows: int = TASK_ROWS) -> ForestModel:
    """The forest of the estimator's settings on rows whose weight depends on their class only. [M6]"""
    features, label, weight = estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()
    vectors = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    width = rows.select(features).first()[0].size
    classes = {r["y"]: r["weight"] for r in rows.groupBy(F.col(label).cast("int").alias("y")).agg(F.max(weight).alias("weight")).collect()}  # two classes
    grower = _Grower(
        cuts(vectors, width, estimator.getMaxBins()), estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed(),
        (classes.get(0, 1.0), classes.get(1, 1.0)),
    )
    chunks = materialize(vectors.mapInArrow(grower.pack, "chunk bigint, rows binary"), "forest-rows")
    top, open_nodes = _split_large(grower, chunks, rows.count(), task_rows)
    grower.top, grower.open = top, open_nodes
    parts = chunks.mapInArrow(grower.deal, "tree int, node int, rows binary")
    groups = sum(len(nodes) for nodes in open_nodes.values())
    grown = parts.repartition(max(1, min(groups, 2000)), "tree", "node").groupBy("tree", "node").applyInArrow(lambda key, table: grower.grow(key, table), "tree int, nodes binary")
    whole = [(t, bytearray()) for t, nodes in open_nodes.items() if not nodes]  # trees that ended in large leaves
    if whole:
        grown = grown.unionByName(rows.sparkSession.createDataFrame(whole, grown.schema))
    trees = grown.groupBy("tree").applyInArrow(lambda key, table: grower.assemble(key, table), "tree int, nodes binary, importance array<double>")
    return ForestModel(materialize(trees, "forest"), grower.cuts, grower.trees, features)


def cuts(vectors: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Per feature, ascending limits of its bins: between all values where they are few, else quantiles of all rows.

    A value that many rows share is a limit once; the limits it leaves free are spent on the other values.
    """
    cells = [F.get("x", F.lit(i)) for i in range(width)]
    shares = [k / (8 * bins) for k in range(1, 8 * bins)]
    found = vectors.agg(
        *[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(cells)], *[F.min(c).alias(f"l{i}") for i, c in enumerate(cells)],
        *[F.max(c).alias(f"h{i}") for i, c in enumerate(cells)], *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cells)],
    ).first()
    few = [i for i in range(width) if found[f"n{i}"] <= 2 * bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    exploded = vectors.select(F.posexplode("x").alias("i", "v")).where(F.col("i").isin(few)).distinct()
    for r in exploded.collect():  # about 2 * bins values of each feature
        values[r["i"]].append(r["v"])
    out = []
    for i in range(width):
        distinct = sorted(values.get(i, []))
        if i in values and len(distinct) <= bins:
            out.append([(a + b) / 2 for a, b in zip(distinct, distinct[1:])])
        else:
            limits = sorted({v for v in [found[f"l{i}"], *found[f"q{i}"]] if v < found[f"h{i}"]})
            out.append(limits if len(limits) < bins else [limits[(k * len(limits)) // bins] for k in range(1, bins)])
    return out


def _split_large(grower: _Grower, chunks: DataFrame, rows: int, task_rows: int) -> tuple[dict, dict]:
    """Nodes with more rows than a task may hold, level by level: (tree -> node -> its split, tree -> node -> its class counts)."""
    top: dict[int, dict[int, tuple]] = {t: {} for t in range(grower.trees)}
    open_nodes: dict[int, dict[int, tuple | None]] = {t: {1: None} for t in top}
    size = {t: {1: rows} for t in top}
    while True:
        large = {t: [n for n in nodes if size[t][n] > task_rows] for t, nodes in open_nodes.items()}
        large = {t: sorted(nodes) for t, nodes in large.items() if nodes}
        if not large:
            return top, open_nodes
        grower.top, grower.open = top, large
        counted = chunks.mapInArrow(grower.count, "tree int, node int, counts binary")
        split = counted.groupBy("tree", "node").applyInArrow(lambda key, table: grower.choose(key, table), "tree int, node int, feature int, bin int, gain double, own array<bigint>, left array<bigint>")
        for r in split.collect():  # at most trees * 2 * rows / task_rows
            t, n, own, left = r["tree"], r["node"], tuple(r["own"]), tuple(r["left"])
            top[t][n] = (r["feature"], r["bin"], r["gain"], own)
            del open_nodes[t][n]
            if r["feature"] >= 0:
                right = (own[0] - left[0], own[1] - left[1])
                open_nodes[t].update({2 * n: left, 2 * n + 1: right})
                size[t].update({2 * n: sum(left), 2 * n + 1: sum(right)})


_NODE = np.dtype([("id", "<i4"), ("feature", "<i2"), ("bin", "u1"), ("n0", "<i8"), ("n1", "<i8"), ("gain", "<f8")])


class _Grower:
    """What tasks need to grow trees. Nodes are numbered from 1, the children of n are 2n and 2n + 1."""

    def __init__(self, limits: Sequence[Sequence[float]], trees: int, depth: int, least: int, seed: int, weights: tuple[float, float]):
        self.cuts, self.trees, self.depth, self.least, self.seed, self.weights = [np.asarray(c, float) for c in limits], trees, depth, least, seed, weights
        self.width, self.bins = len(limits), max([len(c) for c in limits], default=0) + 1
        self.tried = math.ceil(math.sqrt(self.width))
        self.top: dict = {}
        self.open: dict = {}

    # ---- rows

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Binned features and label of many rows as one cell."""
        start, waiting, held, number = TaskContext.get().partitionId() << 32, [], 0, 0

        def chunk(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([start + number], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            packed = np.empty((batch.num_rows, self.width + 1), np.uint8)
            packed[:, :-1] = binned(batch.column(0), self.cuts)
            packed[:, -1] = batch.column(1).to_numpy(zero_copy_only=False)
            waiting.append(packed)
            held += len(packed)
            while held >= CHUNK_ROWS:
                rows = np.concatenate(waiting)
                yield chunk(rows[:CHUNK_ROWS])
                number += 1
                waiting, held = [rows[CHUNK_ROWS:]], len(rows) - CHUNK_ROWS
        if held:
            yield chunk(np.concatenate(waiting))

    def _drawn(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk and tree: (tree, binned rows, times each is drawn, open node or 0)."""
        for batch in batches:
            for chunk, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, self.width + 1)
                for tree in self.open:
                    drawn = np.random.default_rng([self.seed & 0xFFFFFFFF, tree, chunk]).poisson(1.0, len(rows)).astype(np.uint8)
                    yield tree, rows, drawn, self._descend(tree, rows)

    def _descend(self, tree: int, rows: np.ndarray) -> np.ndarray:
        """The node of every row below the splits made so far; 0 where that is not an open one."""
        at = np.ones(len(rows), np.int32)
        splits = {n: s for n, s in self.top.get(tree, {}).items() if s[0] >= 0}
        for n in sorted(splits):  # parents come first; few nodes are this large
            here = np.flatnonzero(at == n)
            at[here] = 2 * n + (rows[here, splits[n][0]] > splits[n][1])
        return np.where(np.isin(at, list(self.open[tree])), at, 0)

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of every open node of every tree, with the times they are drawn."""
        for tree, rows, drawn, at in self._drawn(batches):
            nodes, cells = [], []
            for node in self.open[tree]:
                taken = np.flatnonzero((drawn > 0) & (at == node))
                if len(taken):
                    nodes.append(node)
                    cells.append(np.concatenate([rows[taken], drawn[taken, None]], axis=1).tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(cells, pa.binary())], ["tree", "node", "rows"])

    # ---- splits

    def _candidates(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        """The features that each node tries, as a function of seed, tree and node."""
        with np.errstate(over="ignore"):
            key = nodes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(self.width, dtype=np.uint64)[None, :]
            key = (key + np.uint64((self.seed * 1_000_003 + tree + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            for _ in range(2):
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        return np.sort(np.argsort(key, axis=1, kind="stable")[:, : self.tried], axis=1)

    def _histograms(self, tried: np.ndarray, rows: np.ndarray, drawn: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Drawn rows by (node, candidate, bin, class)."""
        nodes, out = len(tried), np.empty((len(tried), self.tried, self.bins, 2))
        number, label = np.arange(len(rows)), rows[:, self.width]
        for k in range(self.tried):
            key = (slot.astype(np.int64) * self.bins + rows[number, tried[slot, k]]) * 2 + label
            out[:, k] = np.bincount(key, weights=drawn, minlength=nodes * self.bins * 2).reshape(nodes, self.bins, 2)
        return out

    def _best(self, tried: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per node: (feature or -1, last bin of the left child, decrease of Gini impurity, class counts of the left child)."""
        nodes = len(tried)
        left = np.cumsum(counts, axis=2)
        own = left[:, :1, -1:, :]
        right = own - left
        valid = (left.sum(-1) >= self.least) & (right.sum(-1) >= self.least)

        def purity(part: np.ndarray) -> np.ndarray:
            a, b = part[..., 0] * self.weights[0], part[..., 1] * self.weights[1]
            total = a + b
            return np.divide(a * a + b * b, total, out=np.zeros_like(total), where=total > 0)

        scores = np.where(valid, purity(left) + purity(right), -np.inf).reshape(nodes, -1)
        best = scores.argmax(1)
        total = (own * self.weights).sum(-1).reshape(nodes)
        score = scores[np.arange(nodes), best]
        gain = np.divide(score - purity(own).reshape(nodes), total, out=np.full(nodes, -np.inf), where=total > 0)
        k, cut = best // self.bins, best % self.bins
        feature = np.where(gain > 1e-12, tried[np.arange(nodes), k], -1)
        return feature, cut, np.where(feature >= 0, gain, 0.0), left[np.arange(nodes), k, cut]

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Histograms of the large nodes over the rows of one task."""
        sums: dict[int, np.ndarray] = {}
        for tree, rows, drawn, at in self._drawn(batches):
            nodes = np.asarray(self.open[tree])
            here = np.flatnonzero((at > 0) & (drawn > 0))
            found = self._histograms(self._candidates(tree, nodes), rows[here], drawn[here], np.searchsorted(nodes, at[here]))
            sums[tree] = found if tree not in sums else sums[tree] + found
        for tree, found in sums.items():
            nodes = self.open[tree]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array([h.tobytes() for h in found], pa.binary())], ["tree", "node", "counts"]
            )

    def choose(self, key: tuple, table: pa.Table) -> pa.Table:
        """The split of one large node from the histograms of all tasks."""
        tree, node = (k.as_py() for k in key)
        counts = sum(np.frombuffer(c.as_buffer()) for c in table["counts"]).reshape(1, self.tried, self.bins, 2)
        own = counts[0, 0].sum(0)
        feature, cut, gain, left = (v[0] for v in self._best(self._candidates(tree, np.array([node])), counts))
        if node.bit_length() > self.depth:
            feature, gain = -1, 0.0
        row = {"tree": tree, "node": node, "feature": int(feature), "bin": int(cut), "gain": float(gain), "own": own.astype(int).tolist(), "left": left.astype(int).tolist()}
        return pa.Table.from_pylist([row], pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("own", pa.list_(pa.int64())), ("left", pa.list_(pa.int64()))]))

    def grow(self, key: tuple, table: pa.Table) -> pa.Table:
        """All nodes from one on, level by level, over its rows."""
        tree, node = (k.as_py() for k in key)
        packed = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for c in table["rows"]]).reshape(-1, self.width + 2)
        nodes = self._below(tree, node, packed[:, :-1], packed[:, -1])
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    def _below(self, tree: int, root: int, rows: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        ids, slot = np.array([root], np.int64), np.zeros(len(rows), np.int32)
        own = np.bincount(rows[:, self.width], weights=drawn, minlength=2)[None, :2]
        block = max(1, BLOCK_BYTES // (self.tried * self.bins * 2 * 8))
        levels = []
        while len(ids):
            level = np.zeros(len(ids), _NODE)
            level["id"], level["n0"], level["n1"], level["feature"] = ids, own[:, 0], own[:, 1], -1
            levels.append(level)
            able = (own.min(1) > 0) & (own.sum(1) >= 2 * self.least)
            if int(ids[0]).bit_length() > self.depth or not able.any():
                break
            # Rows of nodes that are done go no further.
            wanted = np.flatnonzero(able)
            place = np.full(len(ids), -1, np.int32)
            place[wanted] = np.arange(len(wanted))
            slot = place[slot]
            staying = slot >= 0
            rows, drawn, slot = rows[staying], drawn[staying], slot[staying]
            feature, cut, left = np.empty(len(wanted), np.int64), np.empty(len(wanted), np.int64), np.empty((len(wanted), 2))
            for a in range(0, len(wanted), block):
                part = wanted[a : a + block]
                tried = self._candidates(tree, ids[part])
                here = slice(None) if len(wanted) <= block else (slot >= a) & (slot < a + block)
                found = self._best(tried, self._histograms(tried, rows[here], drawn[here], slot[here] - a))
                feature[a : a + block], cut[a : a + block], level["gain"][part], left[a : a + block] = found
            level["feature"][wanted], level["bin"][wanted] = feature, cut
            cut_nodes = np.flatnonzero(feature >= 0)
            place = np.full(len(wanted), -1, np.int32)
            place[cut_nodes] = 2 * np.arange(len(cut_nodes))
            staying = place[slot] >= 0
            rows, drawn, slot = rows[staying], drawn[staying], slot[staying]
            slot = place[slot] + (rows[np.arange(len(rows)), feature[slot]] > cut[slot])
            parents, lefts = wanted[cut_nodes], left[cut_nodes]
            own = np.stack([lefts, own[parents] - lefts], axis=1).reshape(-1, 2)
            ids = (2 * ids[parents][:, None] + np.arange(2)[None, :]).ravel()
        return np.concatenate(levels)

    def assemble(self, key: tuple, table: pa.Table) -> pa.Table:
        """One tree from its parts: leaves of one parent that decide alike are joined, as in MLlib, and nodes get places."""
        tree = key[0].as_py()
        made = [np.frombuffer(c.as_buffer(), _NODE) for c in table["nodes"] if len(c.as_buffer())]
        above = np.zeros(len(self.top[tree]), _NODE)
        for i, (n, (feature, cut, gain, own)) in enumerate(self.top[tree].items()):
            above[i] = (n, feature, cut, own[0], own[1], gain)
        nodes = np.concatenate([above, *made])
        present = set(nodes["id"][nodes["id"] < 2 * max([1, *self.open[tree]])].tolist())
        lost = [(n, -1, 0, *own, 0.0) for n, own in self.open[tree].items() if n not in present and own is not None]
        nodes = np.sort(np.concatenate([nodes, np.array(lost, _NODE)]), order="id")
        zeros, ones = nodes["n0"] * self.weights[0], nodes["n1"] * self.weights[1]
        decides, leaf, kept = ones > zeros, nodes["feature"] < 0, np.ones(len(nodes), bool)
        child = np.searchsorted(nodes["id"], 2 * nodes["id"].astype(np.int64))
        depth = np.frexp(nodes["id"].astype(float))[1]
        for d in range(int(depth.max()), 0, -1):
            inner = np.flatnonzero((depth == d) & ~leaf)
            c = child[inner]
            alike = inner[leaf[c] & leaf[c + 1] & (decides[c] == decides[c + 1])]
            leaf[alike] = True
            kept[child[alike]] = kept[child[alike] + 1] = False
        place = np.cumsum(kept) - 1
        inner = kept & ~leaf
        importance = np.bincount(nodes["feature"][inner], weights=nodes["gain"][inner] * (zeros + ones)[inner], minlength=self.width)
        total = zeros + ones
        link = np.divide(ones, total, out=np.zeros(len(nodes)), where=total > 0).astype("<f4").view("<i4")
        link[inner] = place[child[inner]]
        feature = np.where(leaf, -1, nodes["feature"]).astype("<i2")
        cell = feature[kept].tobytes() + link[kept].tobytes() + nodes["bin"][kept].tobytes()
        share = importance / importance.sum() if importance.sum() > 0 else importance
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([cell], pa.binary()), "importance": pa.array([share.tolist()], pa.list_(pa.float64()))})


def binned(vectors: pa.Array, limits: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every cell; a value on a limit belongs to the lower bin."""
    cells = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(limits))
    return np.stack([np.searchsorted(limit, cells[:, i], side="left").astype(np.uint8) for i, limit in enumerate(limits)], axis=1)


def _mean_share(cells: np.ndarray, trees: Sequence[bytes]) -> np.ndarray:
    """Mean over the trees of the share of class 1 in a row's leaf."""
    total = np.zeros(len(cells))
    for tree in trees:
        size = len(tree) // 7
        feature, link, cut = np.frombuffer(tree, "<i2", size), np.frombuffer(tree, "<i4", size, 2 * size), np.frombuffer(tree, np.uint8, size, 6 * size)
        at, live = np.zeros(len(cells), np.int32), np.arange(len(cells))
        while len(live):
            node = at[live]
            inner = feature[node] >= 0
            live, node = live[inner], node[inner]
            at[live] = link[node] + (cells[live, feature[node]] > cut[node])
        total += link[at].view("<f4")
    return total / max(len(trees), 1)


class ForestModel(Model):
    """Adds ``rawPrediction``, ``probability`` and ``prediction`` like MLlib's forest of two classes; other columns stay."""

    hasSummary = False
    numClasses = 2

    def __init__(self, stored: DataFrame, limits: Sequence[np.ndarray], trees: int, features: str):
        super().__init__()
        self.stored, self.limits, self.trees, self.features = stored, list(limits), trees, features
        self._sent = None

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the trees of each feature's share in the decrease of impurity."""
        total = self.stored.select(F.posexplode("importance").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row per feature
        found = np.zeros(len(self.limits))
        for r in total:
            found[r["i"]] = r["v"]
        return Vectors.dense(found / found.sum() if found.sum() > 0 else found)

    def _trees(self):
        if self._sent is None:
            # Part by part, so that no single result holds the forest.
            self._sent = self.stored.sparkSession.sparkContext.broadcast([bytes(r["nodes"]) for r in self.stored.select("nodes").toLocalIterator()])
        return self._sent

    def _transform(self, df: DataFrame) -> DataFrame:
        sent, limits, share = self._trees(), self.limits, "__share"

        @F.arrow_udf("double")
        def score(vectors: pa.Array) -> pa.Array:
            return pa.array(_mean_share(binned(vectors, limits), sent.value))

        p = F.col(share)
        return df.withColumn(share, score(vector_to_array(self.features))).withColumns({
            "rawPrediction": array_to_vector(F.array((1 - p) * self.trees, p * self.trees)), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (p > 0.5).cast("double"),
        }).drop(share)
