"""Trees grown in one task: splits against plain loops, forests against MLlib, and the sizes that the queries ask for."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from culvert.catalog import learn as catalog
from culvert.operators import learn, trees


def plain_cuts(values, weights, bins):
    """MLlib's walk through the distinct values."""
    sums = {}
    for v, w in zip(values, weights):
        sums[v] = sums.get(v, 0.0) + w
    pairs = sorted(sums.items())
    if len(pairs) <= bins:
        return [(a[0] + b[0]) / 2 for a, b in zip(pairs, pairs[1:])]
    stride = sum(sums.values()) / bins
    out, now, target = [], pairs[0][1], stride
    for before, (v, w) in zip(pairs, pairs[1:]):
        was, now = now, now + w
        if abs(was - target) < abs(now - target):
            out.append((before[0] + v) / 2)
            target += stride
    return out


@pytest.mark.parametrize("n", [1, 5, 40, 2000])
def test_cuts(n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), rng.integers(0, 50, n).astype(float), rng.integers(0, 3, n).astype(float)):
        weights = rng.integers(1, 4, n).astype(float)
        assert trees.cuts_of(values, weights).tolist() == plain_cuts(values.tolist(), weights.tolist(), trees.BINS)


def test_best_split_of_a_node():
    """Both ways to look for splits, against every split of every node."""
    rng = np.random.default_rng(5)
    nodes, classes, n = 7, 3, 300
    node, bins, y = rng.integers(0, nodes, n), rng.integers(0, trees.BINS, n), rng.integers(0, classes, n)
    bins[node == 2] = 4  # nothing to split
    weights = np.array([1.0, 0.5, 2.0])
    counts = np.bincount(node * classes + y, minlength=nodes * classes).reshape(nodes, classes)
    key = (node * trees.BINS + bins) * classes + y
    for find in (trees._best_dense, trees._best_sparse):
        score, at = find(key, counts, weights)
        for k in range(nodes):
            best = (-math.inf, 0)
            for cut in range(trees.BINS - 1):
                sides = [np.bincount(y[(node == k) & side], minlength=classes) * weights for side in (bins <= cut, bins > cut)]
                if all(s.sum() > 0 for s in sides):
                    value = sum((s**2).sum() / s.sum() for s in sides)
                    best = max(best, (value, -cut)) if abs(value - best[0]) > 1e-9 else best
            assert score[k] == pytest.approx(best[0]) and (best[0] == -math.inf or at[k] == -best[1])


def noisy(spark, n=3000):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=n), rng.normal(size=n)
    names = np.where(rng.random(n) < 0.1, "c", np.where(x + 0.3 * y > 0, "a", "b"))
    return spark.createDataFrame([(i, str(k), float(u), float(v)) for i, (k, u, v) in enumerate(zip(names, x, y))], "id long, label string, x double, y double")


def test_forest_against_mllib_and_whatever_the_layout(spark):
    df = noisy(spark)
    train, rest = df.filter("id < 2000"), df.filter("id >= 2000")
    own = learn.fit(train, "label", "rf", ("x", "y"), numTrees=30, maxDepth=8)
    index = F.array_position(F.array(*map(F.lit, "abc")), F.col("label")).cast("double") - 1
    table = learn.feature_matrix(learn.balanced_weights(train, "label"), ("x", "y")).withColumn("_label", index)
    other = RandomForestClassifier(labelCol="_label", featuresCol="features", weightCol="weight", seed=0, numTrees=30, maxDepth=8).fit(table)
    theirs = other.transform(learn.feature_matrix(rest, ("x", "y"))).select("id", F.col("prediction").cast("int").alias("p"))
    both = learn.predict(rest, own).select("id", "label", F.col("traffic.predicted_type").alias("own")).join(theirs, "id").collect()
    right = sum(r["own"] == r["label"] for r in both), sum("abc"[r["p"]] == r["label"] for r in both)
    assert len(both) == 1000 and abs(right[0] - right[1]) < 40 and sum(r["own"] == "abc"[r["p"]] for r in both) > 850
    again = learn.fit(train.repartition(7, "id").sort(F.desc("x")), "label", "rf", ("x", "y"), numTrees=30, maxDepth=8)
    got = [sorted((r["id"], *r["_p"]) for r in learn.predict_array(rest, m).select("id", "_p").collect()) for m in (own, again)]
    assert got[0] == got[1]


def test_boosted_trees_and_saved_models(spark, tmp_path):
    df = noisy(spark)
    for algo, settings in (("rf", {"numTrees": 8}), ("gbt", {"maxIter": 20})):
        model = learn.fit(df.filter("id < 2000"), "label", algo, ("x", "y"), **settings)
        model.save(str(tmp_path / algo))
        back = learn.Model.load(str(tmp_path / algo))
        assert (back.algo, back.version, back.classes, back.importances, back.means) == (model.algo, model.version, model.classes, model.importances, model.means)
        got = [learn.predict(df.filter("id >= 2000"), m).select("id", "label", "traffic.*").orderBy("id").collect() for m in (model, back)]
        assert got[0] == got[1] and sum(r["label"] == r["predicted_type"] for r in got[0]) > 800


def test_boosting_steps():
    """The first tree fits the labels, the next ones what the log loss leaves, each by the mean of its leaf."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, trees.BINS, (2, 500)).astype(np.uint8)
    positive = (bins[0] > 12) ^ (rng.random(500) < 0.2)
    y, margin = np.where(positive, 1.0, -1.0), np.zeros(500)
    for k, tree in enumerate(trees.boosted_trees(bins, positive, 5, 2, 0.1, 1.0, rng)):
        left = y if k == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        at = tree.find(bins)
        for leaf in set(at.tolist()):
            assert tree.leaves[leaf, 0] == pytest.approx((1.0 if k == 0 else 0.1) * left[at == leaf].mean())
        sides = [((left[s].sum()) ** 2 / s.sum() + left[~s].sum() ** 2 / (~s).sum(), f, c) for f in (0, 1) for c in range(trees.BINS - 1) for s in [bins[f] <= c] if s.any() and not s.all()]
        assert max(sides)[0] == pytest.approx(next(v for v, f, c in sides if (f, c) == (tree.feature[0], tree.bin[0])))
        margin += tree.leaves[at, 0]


def test_odd_training_tables(spark):
    one = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0)], "label string, x double, y double")
    model = learn.fit(one, "label", "rf", ("x", "y"), numTrees=3)
    assert {tuple(r["_p"]) for r in learn.predict_array(one, model).collect()} == {(1.0,)}
    with pytest.raises(ValueError):
        learn.fit(one.filter("label IS NULL"), "label", "rf", ("x", "y"))


def test_selection_has_the_default_sizes(spark, monkeypatch):
    """all rounds of boosting and all trees, at their whole depth."""
    asked, plain = [], learn.grow

    def grow(train, label, features, boosted, seed, trees, depth, **settings):
        asked.append((boosted, trees, depth, settings.get("step"), settings.get("share")))
        return plain(train, label, features, boosted, seed, 2, 2, **settings)

    monkeypatch.setattr(learn, "grow", grow)
    assert catalog._selection(spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [(False, 150, 16, None, None), (True, 300, 6, 0.1, 0.9)]
