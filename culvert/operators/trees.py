"""Forests and boosted trees over binned features, each tree or class grown by one task that holds the training rows in bytes.

The steps are those of MLlib: at most ``BINS`` ranges of each feature at weighted quantiles of all rows, Poisson bags, a random
subset of the features at every node, Gini impurity with class weights, leaves that agree with their sibling joined; boosting
fits log loss per class against the rest. A node costs its rows, not a table of all bins and classes, so deep trees cost no
more than shallow ones a level. Rows are put in order first, so that draws don't depend on how the table is laid out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS, LEAF = 32, 255
TREES_A_TASK = 5
BINNED = "cuts array<array<double>>, bins binary, labels binary"
GROWN = "tree int, feature binary, bin binary, leaf binary, leaves binary, gains binary"


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Between which values a feature is cut into at most ``bins`` ranges of about the same weight."""
    values, place = np.unique(values, return_inverse=True)
    between = (values[1:] + values[:-1]) / 2.0
    if len(between) < bins:
        return between
    total = np.cumsum(np.bincount(place, weights))
    middle, stride = (total[1:] + total[:-1]) / 2.0, total[-1] / bins
    out, last = [], -1
    for k in range(1, bins):
        last = max(last + 1, int(np.searchsorted(middle, k * stride, "right")))
        if last >= len(between):
            break
        out.append(between[last])
    return np.array(out)


def binned(x: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The range of each value, feature by feature; a value on a cut lies below it."""
    return np.stack([np.searchsorted(c, v, "left").astype(np.uint8) for c, v in zip(cuts, x, strict=True)])


def class_weights(labels: np.ndarray, classes: int) -> np.ndarray:
    sizes = np.bincount(labels, minlength=classes)
    return len(labels) / (np.count_nonzero(sizes) * np.maximum(sizes, 1.0))


def _prepared(group: pa.Table, features: Sequence[str], weighted: bool) -> pa.Table:
    labels = group.column("_y").to_numpy()
    weights = class_weights(labels, int(labels.max()) + 1)[labels] if weighted else np.ones(len(labels))
    x = [group.column(f"_x{k}").to_numpy() for k in range(len(features))]
    cuts = [cuts_of(v, weights) for v in x]
    bins = binned(x, cuts)
    order = np.lexsort((labels, *bins))
    out = [pa.array([[c.tolist() for c in cuts]], pa.list_(pa.list_(pa.float64()))), pa.array([bins[:, order].tobytes()], pa.binary()), pa.array([labels[order].astype(np.uint16).tobytes()], pa.binary())]
    return pa.Table.from_arrays(out, names=["cuts", "bins", "labels"])


def numbers(names: Sequence[str]) -> list:
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, n in enumerate(names)]


def prepared(train: DataFrame, label: str, classes: Sequence[str], features: Sequence[str], weighted: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Cuts, ranges and class numbers of all rows with a label: a few bytes a row reach the driver."""
    place = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")
    rows = train.filter(F.col(label).isNotNull()).select(F.lit(0).alias("_all"), place.alias("_y"), *numbers(features))
    row = rows.groupBy("_all").applyInArrow(lambda group: _prepared(group, features, weighted), BINNED).first()
    return [np.array(c) for c in row["cuts"]], np.frombuffer(row["bins"], np.uint8).reshape(len(features), -1), np.frombuffer(row["labels"], np.uint16)


@dataclass
class Tree:
    """Nodes level by level: ``feature`` (``LEAF``: none) and the last range that goes left; the children of the k-th split
    stand at 1 + 2k and 2 + 2k. ``leaf`` names, for each leaf in order, its row of ``leaves``."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    leaves: np.ndarray
    gains: np.ndarray

    def __post_init__(self):
        self.depth = 0
        begin, size = 0, 1
        while size:  # the splits of a level are half the nodes of the next
            splits = int(np.count_nonzero(self.feature[begin : begin + size] != LEAF))
            begin, size, self.depth = begin + size, 2 * splits, self.depth + (splits > 0)

    def find(self, bins: np.ndarray) -> np.ndarray:
        """The row of ``leaves`` of each column of ``bins``."""
        split = self.feature != LEAF
        before = np.cumsum(split) - split
        # a leaf is its own left child, and nothing is beyond its range
        left = np.where(split, 1 + 2 * before, np.arange(len(split)))
        width = bins.shape[1]
        feature, last = np.where(split, self.feature, 0).astype(np.int64) * width, np.where(split, self.bin, LEAF).astype(np.uint8)
        flat, rows, at = bins.ravel(), np.arange(width), np.zeros(width, np.int64)
        for _ in range(self.depth):
            at = left[at] + (flat[feature[at] + rows] > last[at])
        return self.leaf[(at - before[at])]


def _levels(levels: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray, gains: np.ndarray) -> Tree:
    feature, last = (np.concatenate([x[k] for x in levels]) for k in range(2))
    # equal leaves are stored once
    _, first, place = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, values.dtype.itemsize * values.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return Tree(feature.astype(np.uint8), last.astype(np.uint8), place.astype(np.uint32), values[first], gains)


def _best_dense(key: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and last left range of the best split of each node, from a table of all ranges."""
    m, classes = counts.shape
    left = np.cumsum(np.bincount(key, minlength=m * BINS * classes).reshape(m, BINS, classes), axis=1)[:, :-1]
    score = _score(left, counts[:, None, :], weights)
    at = np.argmax(score, axis=1)
    return score[np.arange(m), at], at


def _best_sparse(key: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the ranges that occur: rows sorted by node and range."""
    m, classes = counts.shape
    key = np.sort(key)
    place = key // classes
    ends = np.flatnonzero(place[1:] != place[:-1])
    ends = ends[place[ends] // BINS == place[ends + 1] // BINS]  # something of the node is left on the right
    score, at = np.full(m, -np.inf), np.zeros(m, np.int64)
    if not len(ends):
        return score, at
    own, node = key - place * classes, place[ends] // BINS
    before = np.cumsum(counts, axis=0) - counts
    left = np.stack([np.cumsum(own == c)[ends] for c in range(classes)], axis=1) - before[node]
    found = _score(left, counts[node], weights)
    heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    best = np.maximum.reduceat(found, heads)
    hit = np.flatnonzero(found == np.repeat(best, np.diff(np.append(heads, len(node)))))
    which, first = np.unique(node[hit], return_index=True)
    score[which], at[which] = best, place[ends[hit[first]]] % BINS
    return score, at


def _score(left: np.ndarray, whole: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over the weight, of both sides together; the higher, the purer. Minus infinity if one side is empty."""
    low = left * weights
    high = (whole - left) * weights
    a, b = low.sum(axis=-1), high.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.einsum("...c,...c->...", low, low) / a + np.einsum("...c,...c->...", high, high) / b
    return np.where((a > 0) & (b > 0), score, -np.inf)


def forest_tree(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, depth: int, draws: np.random.Generator) -> Tree:
    """A tree of a Poisson bag; a node looks at the square root of the features, rounded up."""
    features, n = bins.shape
    classes, some = len(weights), math.ceil(math.sqrt(features))
    rows = np.repeat(np.arange(n), draws.poisson(1.0, n))
    node, flat = np.zeros(len(rows), np.int64), bins.ravel()
    levels, held, scored = [], [], []
    size = 1
    for level in range(depth + 1):
        own = labels[rows].astype(np.int64)
        counts = np.bincount(node * classes + own, minlength=size * classes).reshape(size, classes)
        total = counts @ weights
        with np.errstate(divide="ignore", invalid="ignore"):
            parent = ((counts * weights) ** 2).sum(axis=1) / total
        open_nodes = (np.count_nonzero(counts, axis=1) > 1) & (level < depth)
        feature, last, best = np.full(size, LEAF), np.zeros(size, np.int64), np.full(size, -np.inf)
        rank = np.cumsum(open_nodes) - 1
        inside = open_nodes[node]
        rows, node, own = rows[inside], rank[node[inside]], own[inside]
        live, m = np.flatnonzero(open_nodes), int(open_nodes.sum())
        if m:
            chosen = np.argsort(draws.random((m, features)), axis=1)[:, :some]
            for k in range(some):
                key = (node * BINS + flat[chosen[node, k] * n + rows]) * classes + own
                score, at = (_best_dense if m * BINS * classes <= 2 * len(rows) else _best_sparse)(key, counts[live], weights)
                better = score > best[live]
                best[live[better]], feature[live[better]], last[live[better]] = score[better], chosen[better, k], at[better]
        split = best > parent * (1 + 1e-12)
        feature[~split], last[~split] = LEAF, 0
        levels.append((feature, last))
        held.append(counts)
        scored.append(np.where(split, best - parent, 0.0))
        if not split.any():
            break
        went = split[live][node]
        rows, node = rows[went], live[node[went]]
        right = flat[feature[node] * n + rows] > last[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        size = 2 * int(split.sum())
    levels, held, scored = _joined(levels, held, scored, weights)
    gains = np.zeros(features)
    for (feature, _), s in zip(levels, scored, strict=True):
        split = feature != LEAF
        gains += np.bincount(feature[split], s[split], minlength=features)
    return _levels(levels, np.concatenate([c[f == LEAF] for (f, _), c in zip(levels, held, strict=True)]).astype(np.int32), gains)


def _joined(levels: list, held: list, scored: list, weights: np.ndarray) -> tuple[list, list, list]:
    """Splits whose two sides are leaves of the same class become leaves, from the deepest level on."""
    levels = [(f.copy(), b) for f, b in levels]
    for k in range(len(levels) - 2, -1, -1):
        feature, below = levels[k][0], levels[k + 1][0]
        splits = np.flatnonzero(feature != LEAF)
        if not len(splits):
            continue
        leaf = (below == LEAF).reshape(-1, 2).all(axis=1)
        guess = np.argmax(held[k + 1] * weights, axis=1).reshape(-1, 2)
        gone = leaf & (guess[:, 0] == guess[:, 1])
        feature[splits[gone]] = LEAF
        stay = np.repeat(~gone, 2)
        levels[k + 1] = tuple(x[stay] for x in levels[k + 1])
        held[k + 1], scored[k + 1] = held[k + 1][stay], scored[k + 1][stay]
    keep = [len(f) > 0 for f, _ in levels]
    return [x for x, y in zip(levels, keep) if y], [x for x, y in zip(held, keep) if y], [x for x, y in zip(scored, keep) if y]


def boosted_trees(bins: np.ndarray, positive: np.ndarray, rounds: int, depth: int, step: float, share: float, draws: np.random.Generator) -> Iterator[Tree]:
    """Trees of one class against the rest; their values, the step included, add up to the margin."""
    y = np.where(positive, 1.0, -1.0)
    margin = np.zeros(len(y))
    for k in range(rounds):
        left = y if k == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
        rows = np.flatnonzero(draws.random(len(y)) < share) if share < 1 else np.arange(len(y))
        tree = _regression(bins, left, rows, depth, 1.0 if k == 0 else step)
        margin += tree.leaves[tree.find(bins), 0]
        yield tree


def _tables(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Count and sum of each range of each node, feature by feature."""
    base, own = node * BINS, left[rows]
    out = np.empty((2, len(bins), size, BINS))
    for k, feature in enumerate(bins):
        key = base + feature[rows]
        out[0, k] = np.bincount(key, minlength=size * BINS).reshape(size, BINS)
        out[1, k] = np.bincount(key, own, minlength=size * BINS).reshape(size, BINS)
    return out


def _regression(bins: np.ndarray, left: np.ndarray, rows: np.ndarray, depth: int, step: float) -> Tree:
    features, n = bins.shape
    flat, node, size = bins.ravel(), np.zeros(len(rows), np.int64), 1
    tables = _tables(bins, rows, node, left, 1)
    levels, values, gains = [], [], np.zeros(features)
    for level in range(depth + 1):
        count, total = tables[:, 0].sum(axis=-1)
        feature, last = np.full(size, LEAF), np.zeros(size, np.int64)
        split = np.zeros(size, bool)
        if level < depth:
            low = np.cumsum(tables, axis=-1)[..., :-1]
            a, b = low[0], count[:, None] - low[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((a > 0) & (b > 0), low[1] ** 2 / a + (total[:, None] - low[1]) ** 2 / b, -np.inf)
                parent = np.where(count > 0, total**2 / count, 0.0)
            score = score.transpose(1, 0, 2).reshape(size, -1)
            at = np.argmax(score, axis=1)
            best = score[np.arange(size), at]
            split = best > parent + 1e-9 * np.maximum(1.0, np.abs(parent))
            feature[split], last[split] = at[split] // (BINS - 1), at[split] % (BINS - 1)
            gains += np.bincount(feature[split], (best - parent)[split], minlength=features)
        levels.append((feature, last))
        values.append(np.where(count > 0, total / np.maximum(count, 1), 0.0)[~split])
        if not split.any():
            break
        went = split[node]
        rows, node = rows[went], node[went]
        right = flat[feature[node] * n + rows] > last[node]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        size = 2 * int(split.sum())
        if level + 1 < depth:
            # the larger side of a split is what its smaller side leaves of it
            small = np.bincount(node, minlength=size).reshape(-1, 2).argmin(axis=1)
            chosen = small[node >> 1] == (node & 1)
            own = _tables(bins, rows[chosen], node[chosen] >> 1, left, size // 2)
            new = np.empty((2, features, size, BINS))
            places = np.arange(size // 2) * 2
            new[:, :, places + small], new[:, :, places + 1 - small] = own, tables[:, :, split] - own
            tables = new
        else:
            tables = np.zeros((2, features, size, BINS))
            tables[0, 0, :, 0], tables[1, 0, :, 0] = np.bincount(node, minlength=size), np.bincount(node, left[rows], minlength=size)
    return _levels(levels, step * np.concatenate(values)[:, None], gains)


def _packed(numbered: Iterator[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
    for number, t in numbered:
        values = [t.feature, t.bin, t.leaf, t.leaves, t.gains]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["tree", "feature", "bin", "leaf", "leaves", "gains"])


def _grow_forest(batches: Iterator[pa.RecordBatch], shared, depth: int, seed: int) -> Iterator[pa.RecordBatch]:
    bins, labels, weights = shared.value
    for batch in batches:
        for first, end in zip(batch.column("first").to_pylist(), batch.column("end").to_pylist(), strict=True):
            yield from _packed((k, forest_tree(bins, labels, weights, depth, np.random.default_rng([seed & 0xFFFFFFFF, k]))) for k in range(first, end))


def _grow_boosted(batches: Iterator[pa.RecordBatch], shared, seed: int, **settings) -> Iterator[pa.RecordBatch]:
    bins, labels, _ = shared.value
    for batch in batches:
        for c in batch.column("first").to_pylist():
            draws = np.random.default_rng([seed & 0xFFFFFFFF, c])
            trees = boosted_trees(bins, labels == c, draws=draws, **settings)
            yield from _packed((c * settings["rounds"] + k, t) for k, t in enumerate(trees))


@dataclass
class Trees:
    """All trees of a model. A forest's leaves are class counts, to be weighted; boosted ones belong to one class each, in order."""

    classes: list[str]
    cuts: list[np.ndarray]
    weights: np.ndarray
    trees: list[Tree]
    boosted: bool

    def scores(self, x: Sequence[np.ndarray]) -> np.ndarray:
        """Rows x classes: mean shares of a forest, margins of boosted trees."""
        bins = binned(x, self.cuts)
        out = np.zeros((bins.shape[1], len(self.classes)))
        for k, tree in enumerate(self.trees):
            if self.boosted:
                out[:, k * len(self.classes) // len(self.trees)] += tree.leaves[tree.find(bins), 0]
            else:
                share = tree.leaves * self.weights
                out += (share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300))[tree.find(bins)]  # an empty bag has no share
        return out if self.boosted else out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)

    def importances(self) -> np.ndarray:
        """Share of each feature in what the splits gain, the trees counting alike."""
        out = np.zeros(len(self.cuts))
        for tree in self.trees:
            if tree.gains.sum() > 0:
                out += tree.gains / tree.gains.sum()
        return out / out.sum() if out.sum() > 0 else out

    def scorer(self, spark: SparkSession) -> Callable:
        """A column function: a struct of the features to an array of scores."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def score(rows: pa.Array) -> pa.Array:
            found = shared.value.scores([rows.field(k).to_numpy(zero_copy_only=False) for k in range(rows.type.num_fields)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel(), pa.float64()))

        return score

    def table(self) -> pa.Table:
        rows = pa.Table.from_batches(list(_packed(enumerate(self.trees))))
        # a row below 0 for what the trees share
        head = [-1, *(v.tobytes() for v in (np.array([len(c) for c in self.cuts], np.int64), np.concatenate([*self.cuts, np.empty(0)]), self.weights)), "\0".join(self.classes).encode(), bytes([self.boosted])]
        return pa.concat_tables([pa.table([pa.array([v], t) for v, t in zip(head, rows.schema.types)], schema=rows.schema), rows])

    @classmethod
    def of(cls, rows: list) -> Trees:
        head, *rows = sorted(rows, key=lambda r: r["tree"])
        sizes, cuts = np.frombuffer(head["feature"], np.int64), np.frombuffer(head["bin"])
        return cls(bytes(head["leaves"]).decode().split("\0"), np.split(cuts, np.cumsum(sizes)[:-1]), np.frombuffer(head["leaf"]), *_unpacked(rows, head["gains"][0] == 1, len(np.frombuffer(head["leaf"]))))


def _unpacked(rows: list, boosted: bool, classes: int) -> tuple[list[Tree], bool]:
    kind = (np.float64, 1) if boosted else (np.int32, classes)
    return [
        Tree(np.frombuffer(r["feature"], np.uint8), np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["leaf"], np.uint32), np.frombuffer(r["leaves"], kind[0]).reshape(-1, kind[1]), np.frombuffer(r["gains"]))
        for r in rows
    ], boosted


def grow(train: DataFrame, label: str, features: Sequence[str], boosted: bool, seed: int, trees: int, depth: int, **settings) -> Trees:
    """A forest of ``trees``, or as many rounds of boosting a class, of the rows of ``train`` that have a label."""
    spark = train.sparkSession
    classes = sorted(r[0] for r in train.select(label).filter(F.col(label).isNotNull()).distinct().collect())  # a fixed list
    if not classes:
        raise ValueError("no labelled rows to learn from")
    cuts, bins, labels = prepared(train, label, classes, features, weighted=not boosted)
    weights = class_weights(labels, len(classes))
    shared = spark.sparkContext.broadcast((bins, labels, weights))
    firsts = list(range(len(classes))) if boosted else list(range(0, trees, TREES_A_TASK))
    asked = spark.range(len(firsts), numPartitions=len(firsts))
    if boosted:
        asked = asked.select(F.col("id").cast("int").alias("first"))
        grown = partial(_grow_boosted, shared=shared, seed=seed, rounds=trees, depth=depth, **settings)
    else:
        asked = asked.select((F.col("id") * TREES_A_TASK).cast("int").alias("first"), F.least((F.col("id") + 1) * TREES_A_TASK, F.lit(trees)).cast("int").alias("end"))
        grown = partial(_grow_forest, shared=shared, depth=depth, seed=seed)
    rows = sorted(asked.mapInArrow(grown, GROWN).collect(), key=lambda r: r["tree"])
    shared.destroy()
    return Trees(classes, cuts, weights, *_unpacked(rows, boosted, len(classes)))
