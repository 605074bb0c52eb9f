"""One tree against brute force, block passes against local growth, what each objective learns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as gb


def specs_of(spark, rows):
    return spark.createDataFrame(rows, f"k string, run string, {gb.SPEC}")


def samples_of(spark, frames):
    rows = [(k, [float(v) for v in x], [float(v) for v in y], bool(val)) for k, xs, ys, vals in frames for x, y, val in zip(xs, ys, vals, strict=True)]
    return spark.createDataFrame(rows, "k string, x array<double>, y array<double>, val boolean").repartition(3)


def data(seed, n, f=3):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, f)), 2)
    target = np.where(x[:, 0] + 0.3 * draw.normal(size=n) > 0.4, 1, np.where(x[:, 1] > 0.3, 0, -1))
    ret = 0.02 * x[:, 0] + 0.01 * draw.normal(size=n)
    val = np.arange(n) >= n * 4 // 5
    return x, np.column_stack([target, ret]), val


def brute_tree(x, g, h, depth, allowed, rate):
    """Every feature, every value as a cut: (feature, threshold, left, right) or a leaf value."""
    value = lambda m: -g[m].sum() / (h[m].sum() + 1) * rate
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)

    def node(own, left):
        best = (1e-6, None)
        for f in allowed if left else ():
            for cut in sorted(set(x[own, f])):
                low = own & (x[:, f] <= cut)
                high = own & ~(x[:, f] <= cut)
                if low.any() and high.any() and h[low].sum() >= 1 and h[high].sum() >= 1:
                    gain = part(low) + part(high) - part(own)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, low, high))
        if best[1] is None:
            return value(own)
        f, cut, low, high = best[1]
        return f, cut, node(low, left - 1), node(high, left - 1)

    return node(np.ones(len(x), bool), depth)


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("depth", "allowed"), [(1, [0, 1, 2]), (3, [0, 1, 2]), (2, [1, 2])])
def test_one_tree_equals_brute_force(depth, allowed):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 12, (150, 3)).astype(float)
    label = (x[:, 0] + x[:, 2] * draw.random(150) > 10).astype(float)
    spec = gb.Spec("binary", 0, 1, depth, 0.1, tuple(allowed))
    cuts = [sorted(set(x[:, f])) for f in range(3)]
    got = gb.grow(spec, gb.binned(x, cuts), label, np.zeros(150, bool), cuts)
    weight = np.where(label == 1, (label == 0).sum() / (label == 1).sum(), 1.0)
    tree = brute_tree(x, (0.5 - label) * weight, 0.25 * weight, depth, allowed, 0.1)
    margin = gb.margins(x, 1, depth, got["feature"], got["threshold"], got["leaf"])[:, 0]
    assert margin == pytest.approx([walk(tree, r) for r in x], abs=1e-6)


def test_gradients_are_the_slopes_of_the_losses():
    draw = np.random.default_rng(4)
    for objective, label in (("binary", draw.integers(-1, 2, 40)), ("softmax", draw.integers(-1, 2, 40)), ("pseudo_huber", draw.normal(size=40))):
        spec = gb.Spec(objective, 0, 1, 1, 0.1, (0,))
        y = gb.targets(spec, label.astype(float))
        margin = draw.normal(size=(40, spec.outputs))
        g, _ = gb.gradients(spec, margin, y, np.ones(40))
        for i in range(0, 40, 7):
            for k in range(spec.outputs):
                up, down = margin[i : i + 1].copy(), margin[i : i + 1].copy()
                up[0, k] += 1e-3
                down[0, k] -= 1e-3
                slope = (gb.losses(spec, up, y[i : i + 1], {})[0] - gb.losses(spec, down, y[i : i + 1], {})[0]) / 2e-3
                assert slope == pytest.approx(g[i, k], abs=gb.SCALE * 1e-3)


OBJECTIVES = (("binary", 0), ("softmax", 0), ("pseudo_huber", 1))


def test_block_passes_grow_the_same_trees(spark, monkeypatch):
    frames = [("a", *data(1, 260)), ("b", *data(2, 90))]
    specs = specs_of(spark, [(k, f"{o}{d}", o, label, 4 - d, d, 0.3, [0, 1, 2][: d + 1]) for k in "ab" for o, label in OBJECTIVES for d in (1, 2)])
    rows = samples_of(spark, frames)
    local = {(r["k"], r["run"]): r for r in gb.fit(rows, specs, ["k"]).collect()}
    monkeypatch.setattr(gb, "LOCAL_ROWS", 0)
    monkeypatch.setattr(gb, "BLOCK", 40)
    large = {(r["k"], r["run"]): r for r in gb.fit(rows, specs, ["k"]).collect()}
    assert len(local) == 12 and local == large


def test_patience_keeps_the_best_number_of_trees(spark, monkeypatch):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(80, 2))
    y = np.column_stack([draw.choice([-1, 1], 80), np.zeros(80)])
    frames = [("a", x, y, np.arange(80) >= 40)]
    specs = specs_of(spark, [("a", "r", "binary", 0, 60, 2, 0.5, [0, 1])])
    rows = samples_of(spark, frames)
    kept = gb.fit(rows, specs, ["k"]).first()
    assert 1 <= kept["kept"] < 50 and len(kept["feature"]) == 3 * kept["kept"]
    # The loss on the validation rows is least at that number.
    losses = []
    spec = gb.Spec("binary", 0, 60, 2, 0.5, (0, 1))
    for n in range(1, 30):
        own = gb.fit(rows, specs.withColumn("n_trees", F.lit(n)).withColumn("run", F.lit(str(n))), ["k"]).first() if n in (1, kept["kept"]) else None
        if own:
            margin = gb.margins(x[40:], 1, 2, own["feature"], own["threshold"], own["leaf"])
            losses.append(gb.losses(spec, margin, (y[40:, 0] == 1).astype(float), {})[0])
    assert losses[-1] <= losses[0]


def test_objectives_learn_and_scores_join(spark):
    x, y, val = data(5, 600)
    specs = specs_of(spark, [("a", o, o, label, 30, 3, 0.2, [0, 1, 2]) for o, label in OBJECTIVES])
    models = gb.fit(samples_of(spark, [("a", x, y, val)]), specs, ["k"])
    rows = [("a", i, *map(float, x[i]), int(y[i, 0]), float(y[i, 1])) for i in range(600)] + [("z", 9, 0.0, 0.0, 0.0, 1, 0.0)]
    bars = spark.createDataFrame(rows, "k string, i long, f0 double, f1 double, f2 double, target int, ret double")
    out = gb.score(bars, models, ["k"], ["f0", "f1", "f2"], ["run"], F.expr("i div 100"))
    got = out.toPandas()
    assert len(got) == 1800 and list(out.columns) == [*bars.columns, "run", "score"]
    for objective in ("binary", "softmax"):
        own = got[got.run == objective]
        assert own[own.target == 1].score.mean() > own[own.target != 1].score.mean() + 0.2
        assert own.score.between(0, 1).all()
    huber = got[got.run == "pseudo_huber"]
    assert np.corrcoef(huber.score, huber.ret)[0, 1] > 0.8


def test_defined_cases(spark):
    specs = specs_of(spark, [("none", "r", "binary", 0, 3, 2, 0.3, [0, 1, 2]), ("flat", "r", "softmax", 0, 3, 2, 0.3, [0, 1, 2]), ("gap", "r", "binary", 0, 3, 1, 0.3, [0])])
    flat = (np.ones((40, 3)), np.column_stack([np.ones(40), np.zeros(40)]), np.zeros(40, bool))
    gap = np.column_stack([np.where(np.arange(40) % 2, math.nan, 1.0), np.zeros(40), np.zeros(40)])
    frames = [("flat", *flat), ("gap", gap, np.column_stack([np.where(np.arange(40) % 2, 1, -1), np.zeros(40)]), np.zeros(40, bool)), ("unused", *data(1, 20))]
    got = {r["k"]: r for r in gb.fit(samples_of(spark, frames), specs, ["k"]).collect()}
    assert set(got) == {"none", "flat", "gap"} and got["none"]["kept"] == 0 and got["none"]["feature"] == []
    assert set(got["flat"]["feature"]) == {-1}
    right = gb.margins(np.array([[math.nan, 0, 0], [1.0, 0, 0]]), 1, 1, got["gap"]["feature"], got["gap"]["threshold"], got["gap"]["leaf"])
    assert right[0, 0] > 0 > right[1, 0]
    empty = samples_of(spark, [("x", *data(1, 4))]).filter("k = 'y'")
    assert gb.fit(empty, specs, ["k"]).filter("kept = 0").count() == 3
