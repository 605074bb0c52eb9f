"""Histogram boosting of many models at once: a model is a row.

``samples`` hold feature vectors per data key (a series, or a series and fold); ``specs`` hold one row per model: its data key,
further run keys (formulation, variant, strategy, hyper-parameters) and what to fit. ``fit`` returns the specs with
their trees, ``score`` joins such rows to bars. There is no loop of fits: all models of a job grow together.

Features become bins by cut points taken from the training rows. Gradients and Hessians are rounded to multiples of
``1 / SCALE``, so their sums are whole numbers: no order of rows, partitioning or repeated task changes a tree.

- Data keys of up to ``LOCAL_ROWS`` rows travel to one task with their specs, and grow there.
- Larger ones stay in blocks of ``BLOCK`` rows. Each level of a tree is one pass: blocks add up histograms per (model, output,
  node, feature, bin), Spark sums them, and a split is chosen per node. The number of passes depends on trees and depth only,
  for however many models. Both ways give the same trees.

Objectives: ``binary`` (logistic loss of label 1 against the rest, positives weighted by the class ratio), ``softmax`` (labels
-1, 0, 1, a tree for each class, balanced weights), ``pseudo_huber`` (slope 1). Trees have second-order gains and leaf values with L2
``REG_LAMBDA``, start from margin 0 and split only where both sides hold a Hessian sum of ``MIN_CHILD``. Ties go to the lower feature,
then the lower cut. With validation rows the loss on them stops a model after ``PATIENCE`` trees without improvement; the best
number of trees is kept. A missing feature value goes right.

Defined cases: a data key without training rows gives models without trees, whose score is that of margin 0; specs without
samples likewise; samples without specs are not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.session import cut_lineage

LOCAL_ROWS = 131_072
BLOCK = 8_192
SPECS_PER_TASK = 8
BINS = 64
SCALE = 1 << 24
REG_LAMBDA = 1.0
MIN_CHILD = 1.0
MIN_GAIN = 1e-6
PATIENCE = 10
OUTPUTS = {"binary": 1, "softmax": 3, "pseudo_huber": 1}
SPEC = "objective string, label int, n_trees int, max_depth int, learning_rate double, features array<int>"
TREES = "outputs int, kept int, loss double, feature array<int>, threshold array<double>, leaf array<double>"


@dataclass(frozen=True)
class Spec:
    objective: str
    label: int
    n_trees: int
    max_depth: int
    learning_rate: float
    features: tuple[int, ...]

    @property
    def outputs(self) -> int:
        return OUTPUTS[self.objective]

    @property
    def inner(self) -> int:
        """Inner nodes of a tree."""
        return (1 << self.max_depth) - 1


# --- losses ---------------------------------------------------------------------------


def targets(spec: Spec, label: np.ndarray) -> np.ndarray:
    if spec.objective == "binary":
        return (label == 1).astype(np.float64)
    return label + 1.0 if spec.objective == "softmax" else label


def class_weights(spec: Spec, counts: dict[float, int]) -> dict[float, float]:
    """Weight of each target value, from the counts of the training rows."""
    if spec.objective == "binary":
        return {0.0: 1.0, 1.0: counts.get(0.0, 0) / max(1, counts.get(1.0, 0))}
    if spec.objective == "softmax":
        total = sum(counts.values())
        return {c: total / (len(counts) * n) for c, n in counts.items()}
    return {}


def weights_of(weights: dict[float, float], y: np.ndarray) -> np.ndarray:
    out = np.ones(len(y))
    for value, w in weights.items():
        out[y == value] = w
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE)


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(spec: Spec, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives per row and output, in multiples of 1 / SCALE."""
    if spec.objective == "pseudo_huber":
        z = margin[:, 0] - y
        root = 1.0 + z * z
        g, h = z / np.sqrt(root), 1.0 / (root * np.sqrt(root))
        return _whole(g * w)[:, None], _whole(h * w)[:, None]
    if spec.objective == "binary":
        p = 1.0 / (1.0 + np.exp(-margin[:, 0]))
        return _whole((p - y) * w)[:, None], _whole(np.maximum(p * (1.0 - p), 1e-16) * w)[:, None]
    p = _softmax(margin)
    own = y[:, None] == np.arange(3)
    return _whole((p - own) * w[:, None]), _whole(np.maximum(2.0 * p * (1.0 - p), 1e-16) * w[:, None])


def losses(spec: Spec, margin: np.ndarray, y: np.ndarray, weights: dict[float, float]) -> tuple[int, int]:
    """Sum of the weighted losses of validation rows, and of their weights, in multiples of 1 / SCALE."""
    w = np.ones(len(y))
    if spec.objective == "pseudo_huber":
        each = np.sqrt(1.0 + (margin[:, 0] - y) ** 2) - 1.0
    elif spec.objective == "binary":
        each = np.logaddexp(0.0, margin[:, 0]) - y * margin[:, 0]
    else:
        # A class that training never saw weighs as one.
        w = weights_of(weights, y)
        p = _softmax(margin)[np.arange(len(y)), y.astype(int)]
        each = -np.log(np.maximum(p, 1e-15))
    return int(_whole(each * w).sum()), int(_whole(w).sum())


# --- trees ----------------------------------------------------------------------------


def binned(x: np.ndarray, cuts: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers: a value is in bin b if it exceeds b of the cuts; missing values are above all."""
    out = np.empty(x.shape, np.uint8)
    for f, own in enumerate(cuts):
        out[:, f] = np.searchsorted(np.asarray(own), x[:, f], side="left")
    return out


def histogram(bins: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of whole g and h per (node, feature, bin); exact in doubles up to 2^53."""
    n, f = bins.shape
    at = ((node[:, None] * f + np.arange(f)) * BINS + bins).ravel()
    shape, size = (n_nodes, f, BINS), n_nodes * f * BINS
    return tuple(np.bincount(at, np.repeat(v, f), size).reshape(shape) for v in (g, h))


def leaf_value(g: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
    return -(g / SCALE) / (h / SCALE + REG_LAMBDA) * rate


def best_splits(g: np.ndarray, h: np.ndarray, allowed: Sequence[int]) -> list[tuple[int, int, float, float, float, float]]:
    """(feature or -1, cut, left g, left h, g, h) of each node of a histogram."""
    g, h = g / SCALE, h / SCALE
    gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
    gt, ht = g[:, :1].sum(axis=2)[:, :, None], h[:, :1].sum(axis=2)[:, :, None]
    gr, hr = gt - gl, ht - hl
    gain = gl * gl / (hl + REG_LAMBDA) + gr * gr / (hr + REG_LAMBDA) - gt * gt / (ht + REG_LAMBDA)
    gain[(hl < MIN_CHILD) | (hr < MIN_CHILD)] = -np.inf
    banned = np.ones(g.shape[1], bool)
    banned[list(allowed)] = False
    gain[:, banned] = -np.inf
    out = []
    for v in range(len(gain)):
        f, cut = divmod(int(gain[v].argmax()), BINS - 1)
        split = gain[v, f, cut] > MIN_GAIN
        out.append((f if split else -1, cut, gl[v, f, cut] * SCALE, hl[v, f, cut] * SCALE, gt[v, 0, 0] * SCALE, ht[v, 0, 0] * SCALE))
    return out


class Forest:
    """Trees of one model as complete binary trees in arrays, in bins; ``level`` of the tree under growth is open."""

    def __init__(self, spec: Spec) -> None:
        self.spec, self.level = spec, 0
        #: Per finished tree: feature, cut (outputs x inner nodes) and leaf (outputs x leaves).
        self.done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._open()

    def _open(self) -> None:
        k, d = self.spec.outputs, self.spec.max_depth
        self.level = 0
        self.feature, self.cut = np.full((k, self.spec.inner), -1, np.int32), np.zeros((k, self.spec.inner), np.int32)
        self.leaf = np.zeros((k, 1 << d))

    def add_level(self, splits: dict[tuple[int, int], tuple]) -> None:
        """Splits of the open level by (output, node of the level). A node without a split hands its value to all leaves below."""
        first, width = (1 << self.level) - 1, 1 << (self.spec.max_depth - self.level)
        rate = self.spec.learning_rate
        for (k, v), (f, cut, gl, hl, g, h) in splits.items():
            leaves = self.leaf[k, v * width : (v + 1) * width]
            if f < 0:
                if self.level == 0:
                    leaves[:] = leaf_value(g, h, rate)
                continue
            self.feature[k, first + v], self.cut[k, first + v] = f, cut
            leaves[: width // 2] = leaf_value(gl, hl, rate)
            leaves[width // 2 :] = leaf_value(g - gl, h - hl, rate)
        self.level += 1
        if self.level == self.spec.max_depth:
            self.done.append((self.feature, self.cut, self.leaf))
            self._open()

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Node of the open level for each row and output."""
        out = np.zeros((len(bins), self.spec.outputs), np.int64)
        for k in range(self.spec.outputs):
            out[:, k] = _route(bins, self.feature[k], self.cut[k], self.level)
        return out

    def open_nodes(self) -> list[tuple[int, int]]:
        """(output, node) of the open level whose parent was split."""
        first = (1 << self.level) - 1
        nodes = [(k, v) for k in range(self.spec.outputs) for v in range(1 << self.level)]
        return [(k, v) for k, v in nodes if not self.level or self.feature[k, (first + v - 1) // 2] >= 0]

    def add_tree(self, margin: np.ndarray, bins: np.ndarray, tree: int = -1) -> None:
        feature, cut, leaf = self.done[tree]
        for k in range(self.spec.outputs):
            margin[:, k] += leaf[k][_route(bins, feature[k], cut[k], self.spec.max_depth)]

    def result(self, cuts: Sequence[Sequence[float]], kept: int, loss: float | None) -> dict:
        """The first ``kept`` trees with thresholds in values, flat."""
        trees = self.done[:kept]
        flat = lambda i: np.concatenate([t[i].ravel() for t in trees]) if trees else np.zeros(0)
        feature, cut = flat(0).astype(int).tolist(), flat(1).astype(int).tolist()
        threshold = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(feature, cut, strict=True)]
        return {"outputs": self.spec.outputs, "kept": kept, "loss": loss, "feature": feature, "threshold": threshold, "leaf": flat(2).tolist()}


def _route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after ``levels`` steps; nodes without a split lead left."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        at = (1 << level) - 1 + node
        f = feature[at]
        node = 2 * node + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[at]))
    return node


class Patience:
    """Best number of trees by validation loss."""

    def __init__(self) -> None:
        self.best: float | None = None
        self.kept, self.stopped = 0, False

    def seen(self, trees: int, total: int, weight: int) -> None:
        if not weight or not trees or self.stopped:
            return
        loss = total / weight
        if self.best is None or loss < self.best:
            self.best, self.kept = loss, trees
        elif trees - self.kept >= PATIENCE:
            self.stopped = True


def grow(spec: Spec, bins: np.ndarray, label: np.ndarray, val: np.ndarray, cuts: Sequence[Sequence[float]]) -> dict:
    """One model, all of its rows at hand."""
    forest, patience = Forest(spec), Patience()
    y = targets(spec, label)
    weights = class_weights(spec, dict(zip(*(a.tolist() for a in np.unique(y[~val], return_counts=True)), strict=True)))
    train, own, w = bins[~val], y[~val], weights_of(weights, y[~val])
    held, held_y = bins[val], y[val]
    margin, held_margin = np.zeros((len(train), spec.outputs)), np.zeros((len(held), spec.outputs))
    while len(train) and len(forest.done) < spec.n_trees and not patience.stopped:
        g, h = gradients(spec, margin, own, w)
        for level in range(spec.max_depth):
            node = forest.nodes(train)
            splits = {}
            for k in {k for k, _ in forest.open_nodes()}:
                found = best_splits(*histogram(train, node[:, k], 1 << level, g[:, k], h[:, k]), spec.features)
                splits.update({(k, v): found[v] for j, v in forest.open_nodes() if j == k})
            forest.add_level(splits)
        forest.add_tree(margin, train)
        if len(held):
            forest.add_tree(held_margin, held)
            patience.seen(len(forest.done), *losses(spec, held_margin, held_y, weights))
    return forest.result(cuts, patience.kept if len(held) else len(forest.done), patience.best)


# --- Spark ----------------------------------------------------------------------------


def samples_of(df: DataFrame, keys: Sequence[str], features: Sequence[str], labels: Sequence[str], val: Column) -> DataFrame:
    """``keys, x, y, val`` from rows with feature and label columns."""
    vector = lambda cols: F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(*keys, vector(features).alias("x"), vector(labels).alias("y"), val.alias("val"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _specs(table: pa.Table) -> list[tuple[dict, Spec]]:
    return [
        (r, Spec(r["objective"], r["label"], r["n_trees"], r["max_depth"], r["learning_rate"], tuple(r["features"])))
        for r in table.to_pylist()
    ]


def _together(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Both sides grouped by ``keys``; the right one under fresh column identities, as both may stem from one table."""
    fresh = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(fresh.groupBy(*keys))


def _cuts(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n rows, and the cut points of each feature from the training rows."""
    x = [F.col("x")[i] for i in range(samples.select(F.size("x")).limit(1).collect()[0][0])] if not samples.isEmpty() else []
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    present = [F.when(~F.col("val") & ~F.isnan(v), v) for v in x]
    found = [F.coalesce(F.array_distinct(F.percentile_approx(v, shares, F.lit(10_000))), F.array().cast("array<double>")) for v in present]
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*found).cast("array<array<double>>").alias("cuts"))


def fit(samples: DataFrame, specs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The specs, one row each, with their trees (columns ``TREES``)."""
    keys = list(keys)
    samples = cut_lineage(samples)
    sized = cut_lineage(_cuts(samples, keys))
    jobs = cut_lineage(specs.join(sized, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))))
    small = _fit_local(samples, jobs.filter(F.col("n") <= LOCAL_ROWS), keys, specs.columns)
    large = jobs.filter(F.col("n") > LOCAL_ROWS)
    if large.isEmpty():
        return small
    return small.unionByName(_fit_large(samples, large, keys, specs.columns))


def _result_schema(specs: DataFrame, columns: Sequence[str]) -> StructType:
    return StructType([*(specs.schema[c] for c in columns), *StructType.fromDDL(TREES)])


def _fit_local(samples: DataFrame, jobs: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    schema = _result_schema(jobs, columns)
    arrow = to_arrow_schema(schema)
    others = [c for c in columns if c not in keys]
    spread = F.pmod(F.xxhash64(*others), F.ceil(F.col("_m") / SPECS_PER_TASK))
    counted = jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    dealt = jobs.join(counted, keys).withColumn("_chunk", spread.cast("long")).drop("_m")
    chunks = dealt.select(*keys, "_chunk").distinct()
    copies = samples.join(chunks, keys)

    def grown(own: pa.Table, todo: pa.Table) -> pa.Table:
        out = []
        if todo.num_rows:
            cuts = todo["cuts"][0].as_py() or []
            x = _matrix(own["x"])
            bins = binned(x, cuts) if len(x) else np.zeros((0, max(1, len(cuts))), np.uint8)
            labels = _matrix(own["y"]) if len(x) else np.zeros((0, 1))
            val = own["val"].to_numpy().astype(bool) if len(x) else np.zeros(0, bool)
            for row, spec in _specs(todo):
                label = labels[:, spec.label] if len(x) else np.zeros(0)
                out.append({**{c: row[c] for c in columns}, **grow(spec, bins, label, val, cuts)})
        return pa.Table.from_pylist(out, arrow)

    return _together(copies, dealt, [*keys, "_chunk"]).applyInArrow(grown, schema)


def _fit_large(samples: DataFrame, jobs: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """Level by level: ``state`` holds per model the splits chosen so far and the validation losses seen."""
    schema = _result_schema(jobs, columns)
    blocks = _blocks(samples, jobs, keys)
    model = F.xxhash64(*columns).alias("model")
    counts = _label_counts(samples, jobs, keys)
    state = jobs.join(counts, keys).select(model, *columns, "cuts", "counts", F.expr("CAST(array() AS array<struct<level: int, output: int, node: int, feature: int, cut: int, gl: double, hl: double, g: double, h: double>>)").alias("splits"), F.expr("CAST(array() AS array<struct<trees: int, total: long, weight: long>>)").alias("seen"))
    state = cut_lineage(state)
    depth = jobs.agg(F.max("max_depth"), F.max("n_trees")).first()
    for tree in range(depth[1]):
        live = state
        for level in range(depth[0]):
            parts = _partials(blocks, live, keys, tree, level)
            chosen = _chosen(parts, live)
            live = cut_lineage(
                live.join(chosen, "model", "left")
                .withColumn("splits", F.concat("splits", F.coalesce("more", F.array().cast(state.schema["splits"].dataType))))
                .withColumn("seen", F.concat("seen", F.coalesce("losses", F.array().cast(state.schema["seen"].dataType))))
                .drop("more", "losses")
            )
        state = live
    # One more look at the validation rows for the last tree.
    chosen = _chosen(_partials(blocks, state, keys, depth[1], 0), state).select("model", "losses")
    last = state.join(chosen, "model", "left").withColumn("seen", F.concat("seen", F.coalesce("losses", F.array().cast(state.schema["seen"].dataType))))
    arrow = to_arrow_schema(schema)

    def finish(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            out = []
            for row, spec in _specs(table):
                forest, patience = _replayed(spec, row, spec.n_trees)
                held = any(s["weight"] for s in row["seen"])
                kept = patience.kept if held else len(forest.done)
                out.append({**{c: row[c] for c in columns}, **forest.result(row["cuts"], kept, patience.best)})
            yield from pa.Table.from_pylist(out, arrow).to_batches()

    return last.drop("losses").mapInArrow(finish, schema)


def _blocks(samples: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of large data keys packed into blocks: binned features, labels and flags as bytes."""
    sizes = jobs.groupBy(*keys).agg(F.first("n").alias("n"), F.first("cuts").alias("cuts"))
    dealt = samples.join(sizes.select(*keys, "n"), keys)
    # Equal rows are told apart by their place in the partition: which block holds a row changes no sum.
    spread = F.pmod(F.xxhash64("x", "y", F.rand(7)), F.ceil(F.col("n") / BLOCK))
    dealt = cut_lineage(dealt.withColumn("_b", spread).drop("n"))
    cuts = dealt.select(*keys, "_b").distinct().join(sizes.drop("n"), keys)
    schema = StructType([*(samples.schema[k] for k in keys), *StructType.fromDDL("rows int, bins binary, labels binary, val binary")])
    arrow = to_arrow_schema(schema)

    def pack(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return arrow.empty_table()
        bins = binned(_matrix(rows["x"]), own["cuts"][0].as_py())
        row = {k: rows[k][0].as_py() for k in keys}
        val = rows["val"].to_numpy().astype(np.uint8)
        return pa.Table.from_pylist([{**row, "rows": len(bins), "bins": bins.tobytes(), "labels": _matrix(rows["y"]).tobytes(), "val": val.tobytes()}], arrow)

    return cut_lineage(_together(dealt, cuts, [*keys, "_b"]).applyInArrow(pack, schema))


def _label_counts(samples: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts: training rows per label column and class -1, 0, 1 or other (9)."""
    rows = samples.filter(~F.col("val")).join(jobs.select(*keys).distinct(), keys, "left_semi")
    each = rows.select(*keys, F.posexplode("y").alias("label", "v"))
    value = F.when(F.col("v").isin(-1.0, 0.0, 1.0), F.col("v")).otherwise(9.0)
    flat = each.groupBy(*keys, "label", value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return flat.groupBy(*keys).agg(F.collect_list(F.struct("label", "v", "n")).alias("counts"))


def _weights(spec: Spec, row: dict) -> dict[float, float]:
    counts: dict[float, int] = {}
    if spec.objective != "pseudo_huber":
        for c in row["counts"]:
            if c["label"] == spec.label:
                y = float(targets(spec, np.array([c["v"]]))[0])
                counts[y] = counts.get(y, 0) + c["n"]
    return class_weights(spec, counts)


def _replayed(spec: Spec, row: dict, trees: int, level: int = 0) -> tuple[Forest, Patience]:
    """The forest of ``row`` after so many trees and levels, and the patience left after the losses in it."""
    forest, patience = Forest(spec), Patience()
    for s in sorted(row["seen"], key=lambda s: s["trees"]):
        patience.seen(s["trees"], s["total"], s["weight"])
    levels: dict[int, dict] = {}
    for s in row["splits"]:
        levels.setdefault(s["level"], {})[s["output"], s["node"]] = (s["feature"], s["cut"], s["gl"], s["hl"], s["g"], s["h"])
    trees = min(trees, spec.n_trees)
    for at in range(trees * spec.max_depth + (level if trees < spec.n_trees else 0)):
        forest.add_level(levels.get(at, {}))
    return forest, patience


PARTS = "model long, level int, output int, node int, feature int, bin int, g long, h long"


def _partials(blocks: DataFrame, state: DataFrame, keys: list[str], tree: int, level: int) -> DataFrame:
    """Histogram parts of each block for this level of each model that still grows, and losses (output -1) of the trees before."""
    arrow = to_arrow_schema(StructType.fromDDL(PARTS))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                (row, spec), *_ = _specs(table)
                if level >= spec.max_depth or tree > spec.n_trees:
                    continue
                forest, patience = _replayed(spec, row, tree, level)
                if patience.stopped:
                    continue
                bins = np.frombuffer(row["bins"], np.uint8).reshape(row["rows"], -1)
                label = np.frombuffer(row["labels"]).reshape(row["rows"], -1)[:, spec.label]
                val = np.frombuffer(row["val"], np.uint8).astype(bool)
                y, weights = targets(spec, label), _weights(spec, row)
                margin = np.zeros((len(bins), spec.outputs))
                for t in range(len(forest.done)):
                    forest.add_tree(margin, bins, t)
                out = []
                at = len(forest.done) * spec.max_depth + level
                if level == 0 and val.any():
                    out.append((row["model"], len(forest.done), -1, 0, 0, 0, *losses(spec, margin[val], y[val], weights)))
                if len(forest.done) < spec.n_trees and not val.all():
                    train = bins[~val]
                    g, h = gradients(spec, margin[~val], y[~val], weights_of(weights, y[~val]))
                    node = forest.nodes(train)
                    open_ = set(forest.open_nodes())
                    for k in range(spec.outputs):
                        hg, hh = histogram(train, node[:, k], 1 << level, g[:, k], h[:, k])
                        for v, f, b in zip(*(a.tolist() for a in np.nonzero((hg != 0) | (hh != 0))), strict=True):
                            if (k, v) in open_:
                                out.append((row["model"], at, k, v, f, b, int(hg[v, f, b]), int(hh[v, f, b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, a.type) for c, a in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    names = ["model", "objective", "label", "n_trees", "max_depth", "learning_rate", "features", "counts", "splits", "seen"]
    return blocks.join(state.select(*keys, *names), keys).select(*names, "rows", "bins", "labels", "val").mapInArrow(run, PARTS)


CHOSEN = (
    "model long, more array<struct<level: int, output: int, node: int, feature: int, cut: int, gl: double, hl: double, g: double, h: double>>, "
    "losses array<struct<trees: int, total: long, weight: long>>"
)


def _chosen(parts: DataFrame, state: DataFrame) -> DataFrame:
    """Splits per model from summed histograms: at most outputs x nodes x features x BINS rows a model."""
    summed = parts.groupBy("model", "level", "output", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    allowed = state.select("model", F.size("cuts").alias("width"), "features")
    arrow = to_arrow_schema(StructType.fromDDL(CHOSEN))

    def choose(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return arrow.empty_table()
        c = {name: rows[name].to_numpy() for name in rows.column_names}
        width, features = own["width"][0].as_py(), own["features"][0].as_py()
        lost = c["output"] < 0
        losses_ = [{"trees": int(t), "total": int(g), "weight": int(h)} for t, g, h in zip(c["level"][lost], c["g"][lost], c["h"][lost], strict=True)]
        more = []
        for k, v in sorted(set(zip(c["output"][~lost].tolist(), c["node"][~lost].tolist(), strict=True))):
            mine = (c["output"] == k) & (c["node"] == v)
            g, h = np.zeros((1, width, BINS)), np.zeros((1, width, BINS))
            g[0, c["feature"][mine], c["bin"][mine]] = c["g"][mine]
            h[0, c["feature"][mine], c["bin"][mine]] = c["h"][mine]
            names = ("feature", "cut", "gl", "hl", "g", "h")
            split = dict(zip(names, best_splits(g, h, features)[0], strict=True))
            more.append({"level": int(c["level"][mine][0]), "output": k, "node": v, **split})
        return pa.Table.from_pylist([{"model": rows["model"][0].as_py(), "more": more, "losses": losses_}], arrow)

    return _together(summed, allowed, ["model"]).applyInArrow(choose, CHOSEN)


# --- scores ---------------------------------------------------------------------------


def margins(x: np.ndarray, outputs: int, depth: int, feature: Sequence[int], threshold: Sequence[float], leaf: Sequence[float]) -> np.ndarray:
    """Sum of the trees for each row and output."""
    inner = (1 << depth) - 1
    feature, threshold = np.array(feature, np.int64).reshape(-1, outputs, inner), np.array(threshold, np.float64).reshape(-1, outputs, inner)
    leaf = np.array(leaf, np.float64).reshape(-1, outputs, inner + 1)
    out, rows = np.zeros((len(x), outputs)), np.arange(len(x))
    for t in range(len(feature)):
        for k in range(outputs):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                f = feature[t, k, at]
                node = 2 * node + ((f >= 0) & ~(x[rows, np.maximum(f, 0)] <= threshold[t, k, at]))
            out[:, k] += leaf[t, k, node]
    return out


def predicted(objective: str, margin: np.ndarray) -> np.ndarray:
    """P(label 1), or the predicted value."""
    if objective == "pseudo_huber":
        return margin[:, 0]
    return 1.0 / (1.0 + np.exp(-margin[:, 0])) if objective == "binary" else _softmax(margin)[:, 2]


def score(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], run_keys: Sequence[str], block: Column) -> DataFrame:
    """``rows`` under every model of their key, with ``run_keys`` and ``score``.

    ``block`` numbers groups of bounded size within a key, such as a position div ``BLOCK``: rows meet the models of their key
    in the tasks of these groups, and are shuffled once.
    """
    keys = list(keys)
    columns = rows.columns
    vector = F.array(*[F.col(c).cast("double") for c in features])
    dealt = rows.withColumns({"_x": vector, "_b": block})
    own = models.select(*keys, *run_keys, "objective", "max_depth", "outputs", "feature", "threshold", "leaf")
    needed = dealt.select(*keys, "_b").distinct().join(own, keys)
    schema = StructType([*rows.schema, *(models.schema[c] for c in run_keys), *StructType.fromDDL("score double")])
    arrow = to_arrow_schema(schema)

    def scored(mine: pa.Table, under: pa.Table) -> pa.Table:
        if not mine.num_rows or not under.num_rows:
            return arrow.empty_table()
        x = _matrix(mine["_x"])
        base, out = mine.select(columns), []
        for m in under.to_pylist():
            margin = margins(x, m["outputs"], m["max_depth"], m["feature"], m["threshold"], m["leaf"])
            one = base
            for c in run_keys:
                one = one.append_column(c, pa.array([m[c]] * len(x), arrow.field(c).type))
            out.append(one.append_column("score", pa.array(predicted(m["objective"], margin))).cast(arrow))
        return pa.concat_tables(out)

    return _together(dealt, needed, [*keys, "_b"]).applyInArrow(scored, schema)
