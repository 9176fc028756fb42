"""Second-order boosting against closed forms and a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.boost import Boost, ManyBoosts, best_splits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack((rng.normal(size=1500), rng.integers(0, 6, 1500), rng.normal(size=1500)))
    x[rng.random(1500) < 0.1, 2] = np.nan
    y = (rng.random(1500) < 1 / (1 + np.exp(-(2 * (x[:, 0] > 0.3) - 1 + 0.8 * (x[:, 1] == 2) + np.where(np.isnan(x[:, 2]), 1.5, 0))))).astype(float)
    fold = rng.integers(0, 3, 1500)
    rows = [(i, float(t), *[None if np.isnan(v) else float(v) for v in r], int(k)) for i, (t, r, k) in enumerate(zip(y, x, fold))]
    return x, y, fold, spark.createDataFrame(rows, "id long, y double, a double, b double, c double, k int").repartition(4)


def test_one_split_is_the_closed_form(data):
    x, y, _, frame = data
    work = ManyBoosts(frame, F.col("y"), ["b"], ["id"])
    model = work.fit([Boost(depth=1, penalty=2.0)], 1)[0]
    gains = []
    for cut in range(5):
        left = x[:, 1] <= cut
        parts = [(0.5 - y[s]).sum() ** 2 / (0.25 * s.sum() + 2.0) for s in (left, ~left)]
        gains.append(sum(parts) - (0.5 - y).sum() ** 2 / (0.25 * len(y) + 2.0))
    cut = int(np.argmax(gains))
    left = x[:, 1] <= cut
    tree = model.trees[0]
    assert work.edges[0][tree.cut[0] - 1] == cut
    assert np.allclose(tree.value[1:3], [-(0.5 - y[s]).sum() / (0.25 * s.sum() + 2.0) for s in (left, ~left)])


def test_nulls_take_the_better_side():
    g, h = np.array([[[-5.0, 4.0, -4.0]]]), np.ones((1, 1, 3))
    gain, column, cut, null_left, sums = best_splits(g, h, 1.0, 0.0, [0])[0]
    assert (column, cut, null_left, sums) == (0, 1, False, (4.0, 1.0, -9.0, 2.0)) and abs(gain - (16 / 2 + 81 / 3 - 25 / 4)) < 1e-12


def test_many_models_stages_and_folds(data):
    """Models side by side equal each alone, stages equal shorter fits, settled margins change nothing; the loss falls with the stages."""
    x, y, fold, frame = data
    settings = [dict(depth=2, repeat=0, fold=1), dict(depth=1, shrinkage=0.4), dict(depth=3, row_share=0.75, column_share=0.6, repeat=0, fold=0)]
    together = ManyBoosts(frame, F.col("y"), ["a", "b", "c"], ["id"], [F.col("k")], settle_every=3)
    models = together.fit([Boost(**s) for s in settings], 8)
    got = {(r.i, r.stage, r.obs, r.call): (r.n, r.loss) for r in together.staged(models, [4, 8]).collect()}
    for i, s in enumerate(settings):
        alone = ManyBoosts(frame, F.col("y"), ["a", "b", "c"], ["id"], [F.col("k")])
        for stage in (4, 8) if i == 0 else (8,):
            model = alone.fit([Boost(**s)], stage)[0] if stage == 4 else ManyBoosts(frame, F.col("y"), ["a", "b", "c"], ["id"], [F.col("k")]).fit([Boost(**s)], 8)[0]
            for r in alone.staged([model], [stage]).collect():
                n, loss = got[i, stage, r.obs, r.call]
                assert n == r.n and abs(loss - r.loss) < 1e-9
    assert sum(n for (i, t, _, _), (n, _) in got.items() if (i, t) == (0, 8)) == (fold == 1).sum()
    loss = {t: sum(v for (i, s, _, _), (_, v) in got.items() if (i, s) == (1, t)) for t in (4, 8)}
    p, f = y.mean(), 0.0
    assert loss[8] < loss[4] < -len(y) * (p * np.log(p) + (1 - p) * np.log(1 - p))


def test_trees_of_one_split_add_up_in_tables(data):
    """Margins from tables equal the trees one by one, nulls included, and no margin is written; columns not drawn have no histogram."""
    *_, frame = data
    work = ManyBoosts(frame, F.col("y"), ["a", "b", "c"], ["id"], [F.col("k")], settle_every=3)
    model = work.fit([Boost(depth=1, column_share=0.67, row_share=0.8, repeat=0, fold=1)], 8)[0]
    assert work.base == 0 and len(model.trees) == 8
    bins = np.random.default_rng(1).integers(0, work.bins, (300, 3)).astype(np.uint8)
    for first, upto in ((0, 8), (2, 5), (3, None)):
        plain = sum(model.shrinkage * t.value[t.nodes(bins, 1)] for t in model.trees[first:upto])
        assert np.allclose(model.margin(bins, first, upto), plain)
    hist = work._histograms([model], 0, [[0, 2]])[0]
    assert not hist[:, 1].any() and np.allclose(hist[:, 0].sum(axis=1), hist[:, 2].sum(axis=1))


def test_empty_and_constant_rows(spark):
    none = ManyBoosts(spark.createDataFrame([], "id long, y double, a double"), F.col("y"), ["a"], ["id"])
    assert none.fit([Boost()], 2)[0].trees[0].column[0] == -1 and none.staged([Boost()], [0]).count() == 0
    flat = ManyBoosts(spark.createDataFrame([(i, float(i % 2 == 0), None) for i in range(9)], "id long, y double, a double"), F.col("y"), ["a"], ["id"])
    model = flat.fit([Boost(shrinkage=1.0)], 1)[0]
    assert model.trees[0].column[0] == -1 and abs(model.trees[0].value[0] - 0.5 / (0.25 * 9 + 1)) < 1e-12
