import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as L
from riskloom.operators import resample as S
from riskloom.sources import tables as IO

PREDICTORS = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(900):
        a, b, noise = rng.normal(), rng.lognormal(), rng.normal()
        kind = ["Bulk", "RoRo", "Tanker"][i % 3]
        p = 1 / (1 + np.exp(-(-1.8 + 1.2 * a + 0.3 * b + (kind == "RoRo"))))
        out.append((i, "fail" if rng.random() < p else "pass", kind, float(a), float(b), float(noise)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id int, crms string, type string, a double, b double, noise double").repartition(4).persist()


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.solve(info, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def test_logistic_models_the_event(spark, df, rows):
    x = np.array([[1, r[3], r[4], r[2] == "RoRo", r[2] == "Tanker"] for r in rows], float)
    y = np.array([r[1] == "fail" for r in rows], float)
    beta, se = newton(x, y)
    model = L.fit_logistic(df, "crms", "fail", ["a", "b", "type"])
    table = {r["term"]: r for r in L.coefficients(model, spark).collect()}
    for term, b, s in zip(["(Intercept)", "a_x", "b_x", "type_RoRo", "type_Tanker"], beta, se):
        assert abs(table[term]["estimate"] - b) < 1e-5 and abs(table[term]["se"] - s) < 1e-4
    odds = {r["term"]: r["estimate"] for r in L.coefficients(model, spark, odds=True).collect()}
    assert abs(odds["a_x"] - np.exp(beta[1])) < 1e-4
    first = L.variable_importance(model, spark).first()
    assert first["term"] == "a_x" and abs(first["importance"] - beta[1] / se[1]) < 1e-2
    scored = model.score(df).agg(F.sum("p_event")).first()[0]
    assert abs(scored - y.sum()) < 1e-3
    p = 1 / (1 + np.exp(-x @ beta))
    ratio = L.dispersion(model.score(df), "crms", "fail", 5).first()["ratio"]
    assert abs(ratio - np.sum((y - p) ** 2 / (p * (1 - p))) / (900 - 5)) < 1e-4


def test_missing_predictor_gives_missing_score(spark, df):
    model = L.fit_logistic(df, "crms", "fail", ["a"])
    holes = spark.createDataFrame([(1, None), (2, 0.5)], "id int, a double")
    got = {r["id"]: r["p_event"] for r in model.score(holes).collect()}
    assert got[1] is None and 0 < got[2] < 1


def test_saved_model_scores_the_same(df, tmp_path):
    model = L.fit_logistic(df, "crms", "fail", ["a", "b", "type"], scale=True)
    IO.save_model(model.pipeline, str(tmp_path / "m"))
    back = L.Fitted(IO.load_model(str(tmp_path / "m")), model.names)
    one = {r["id"]: r["p_event"] for r in model.score(df).collect()}
    two = {r["id"]: r["p_event"] for r in back.score(df).collect()}
    assert one == two


def test_step_aic_against_newton(spark, df, rows):
    parts = {
        "a": [[r[3]] for r in rows], "b": [[r[4]] for r in rows], "noise": [[r[5]] for r in rows],
        "type": [[r[2] == "RoRo", r[2] == "Tanker"] for r in rows], "copy": [[np.sin(7.0 * r[0])] for r in rows],
    }
    y = np.array([r[1] == "fail" for r in rows], float)

    def aic(terms):
        x = np.column_stack([np.ones(len(y)), *[np.array(parts[t], float) for t in terms]])
        beta, _ = newton(x, y)
        eta = x @ beta
        return -2 * np.sum(y * eta - np.log1p(np.exp(eta))) + 2 * x.shape[1]

    terms, want = list(parts), []
    want.append((None, aic(terms)))
    while terms:
        best, drop = min((aic([t for t in terms if t != d]), d) for d in terms)
        if best >= want[-1][1]:
            break
        terms.remove(drop)
        want.append((drop, best))
    kept, path = L.step_aic(df.withColumn("copy", F.sin(F.col("id") * 7.0)), "crms", "fail", list(parts))
    got = [(r["dropped"], r["aic"]) for r in path.orderBy("step").collect()]
    assert kept == terms and [d for d, _ in got] == [d for d, _ in want] and len(got) > 1
    assert np.allclose([v for _, v in got], [v for _, v in want], atol=1e-3)


def test_step_aic_can_drop_everything(spark):
    nothing, _ = L.step_aic(spark.createDataFrame([(["fail", "pass"][i % 2], float(i % 7)) for i in range(140)], "crms string, z double"), "crms", "fail", ["z"])
    assert nothing == []


def test_partial_dependence_by_hand(df, rows):
    model = L.fit_logistic(df, "crms", "fail", ["a", "b"])
    got = {r["value"]: r["yhat"] for r in L.partial_dependence(model, df, "a", grid=[-1.0, 0.0, 2.0]).collect()}
    glm = model.pipeline.stages[-1]
    for v, yhat in got.items():
        eta = glm.intercept + glm.coefficients[0] * v + glm.coefficients[1] * np.array([r[4] for r in rows])
        assert abs(yhat - np.mean(1 / (1 + np.exp(-eta)))) < 1e-9
    assert len(L.partial_dependence(model, df, "a").collect()) == 51


def test_folds_are_fixed_and_cover(df):
    placed = S.cv_folds(df, ["id"]).select("id", "repeat", "fold").toPandas()
    again = S.cv_folds(df.repartition(7), ["id"]).select("id", "repeat", "fold").toPandas()
    key = ["id", "repeat"]
    assert placed.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert len(placed) == 2700 and set(placed["fold"]) == set(range(5))
    sizes = placed.groupby(["repeat", "fold"]).size()
    assert sizes.min() > 120 and sizes.max() < 250


def test_smote_balances_between_neighbours(spark, df):
    few = df.where("crms = 'pass' OR id % 3 = 0")
    made = S.smote(few, "crms", "fail", PREDICTORS, ["id"]).toPandas()
    before = few.toPandas()
    n_fail, n_pass = (before["crms"] == "fail").sum(), (before["crms"] == "pass").sum()
    assert (made["crms"] == "pass").sum() == n_pass
    assert abs((made["crms"] == "fail").sum() - n_pass) < 0.15 * n_pass
    old = before[before["crms"] == "fail"]
    new = made[made["crms"] == "fail"]
    for c in PREDICTORS:
        assert new[c].min() >= old[c].min() and new[c].max() <= old[c].max()
    # Each made row lies on a line from its base row to one of the base's five nearest rows.
    z = (old[PREDICTORS] - old[PREDICTORS].mean()) / old[PREDICTORS].std()
    points, base_of = z.to_numpy(), {i: k for k, i in enumerate(old["id"])}
    fresh = new[~new[PREDICTORS].apply(tuple, axis=1).isin(set(old[PREDICTORS].apply(tuple, axis=1)))]
    zn = ((fresh[PREDICTORS] - old[PREDICTORS].mean()) / old[PREDICTORS].std()).to_numpy()
    for row, i in zip(zn[:40], fresh["id"][:40]):
        k = base_of[i]
        d = ((points - points[k]) ** 2).sum(axis=1)
        near = [j for j in np.argsort(d) if j != k][:5]
        gaps = []
        for j in near:
            line = points[j] - points[k]
            u = np.clip((row - points[k]) @ line / (line @ line), 0, 1)
            gaps.append(np.abs(row - points[k] - u * line).max())
        assert min(gaps) < 1e-9
    again = S.smote(few.repartition(3), "crms", "fail", PREDICTORS, ["id"]).toPandas()
    assert np.allclose(np.sort(made["a"]), np.sort(again["a"]))


@pytest.mark.parametrize("rows,columns,part_rows,shape", [(30_000, 20, 5000, "normal"), (900, 3, 40, "ties"), (7, 2, 3, "normal"), (400, 1, 30, "heavy")])
def test_nearest_rows_equal_brute_force(spark, rows, columns, part_rows, shape):
    rng = np.random.default_rng(rows)
    z = rng.normal(size=(rows, columns)) * np.linspace(3, 1, columns)
    z = np.round(z) if shape == "ties" else z
    z[: rows // 3] = z[0] if shape == "heavy" else z[: rows // 3]
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(rows), "tie": (np.arange(rows) * 7919) % 104_729, "z": list(z.tolist())}))
    got = {r["id"]: r["mates"] for r in S.nearest_rows(frame, 5, part_rows).collect()}
    assert len(got) == rows
    tie = (np.arange(rows) * 7919) % 104_729
    for i in rng.permutation(rows)[:300]:
        d = np.zeros(rows)
        for c in range(columns):
            d += (z[i, c] - z[:, c]) ** 2
        d[i] = np.inf
        assert got[i] == np.lexsort((tie, d))[: min(5, rows - 1)].tolist()


def test_nearest_rows_of_those_that_ask(spark):
    z = np.random.default_rng(4).integers(0, 40, (1500, 3)).astype(float)
    frame = spark.createDataFrame([(i, (i * 7919) % 1500, x.tolist()) for i, x in enumerate(z)], "id long, tie long, z array<double>")
    got = {r["id"]: r["mates"] for r in S.nearest_rows(frame, 4, 60, asking=F.col("id") % 9 == 0).collect()}
    assert sorted(got) == list(range(0, 1500, 9))
    tie = (np.arange(1500) * 7919) % 1500
    for i, mates in got.items():
        far = ((z - z[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        assert mates == np.lexsort((tie, far))[:4].tolist()


def test_cells_that_a_row_asks_for_are_few():
    points = np.random.default_rng(5).normal(size=(40_000, 5))  # alike along every axis: a projection parts little
    cells = S.Cells.grown(points, 500)
    part = cells.first[cells.leaf(points)]
    low, high = (np.stack([f(points[part == p], axis=0) for p in range(cells.parts.sum())]) for f in (np.min, np.max))
    row, _ = cells.bounded(low, high).within(points[:300], np.full(300, 0.3))
    assert cells.parts.sum() > 80 and len(row) / 300 < 12
    assert (np.bincount(part) <= 500).all()


def test_smote_in_blocks_with_one_heavy_point(spark):
    rows = [(i, "fail", 1.0 if i % 3 == 0 else float(i)) for i in range(600)] + [(1000 + i, "pass", 0.0) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, crms string, x double")
    made = S.smote(df, "crms", "fail", ["x"], ["id"], block_rows=40).toPandas()
    assert (made["crms"] == "fail").sum() == 1200
    assert made["x"].max() <= 599


def test_yeo_johnson_is_at_the_top(df, rows):
    lam = S.yeo_johnson_lambdas(df, ["a", "b"])
    for c, k in (("a", 3), ("b", 4)):
        x = np.array([r[k] for r in rows])

        def ll(v):
            up = np.log1p(np.clip(x, 0, None)) if abs(v) < 1e-9 else ((np.clip(x, 0, None) + 1) ** v - 1) / v
            down = -np.log1p(-np.clip(x, None, 0)) if abs(2 - v) < 1e-9 else -((1 - np.clip(x, None, 0)) ** (2 - v) - 1) / (2 - v)
            y = np.where(x >= 0, up, down)
            return -len(x) / 2 * np.log(y.var()) + (v - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

        grid = np.arange(-3, 3.001, 0.005)
        top = grid[np.argmax([ll(v) for v in grid])]
        assert abs(lam[c] - top) <= 0.0251
    out = S.learn_scaling(df, ["a", "b"], lambdas=lam).transform(df).agg(F.avg("b").alias("m"), F.stddev("b").alias("s")).first()
    assert abs(out["m"]) < 1e-9 and abs(out["s"] - 1) < 1e-9


def test_constant_and_flag_columns_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (0.0, 5.0), (1.0, 5.0)], "flag double, flat double")
    out = S.learn_scaling(df, ["flag", "flat"]).transform(df).toPandas()
    assert np.isfinite(out.to_numpy()).all() and abs(out["flag"].mean()) < 1e-12


def test_cross_validation(df):
    scored = L.cross_validate(df, ["id"], "crms", "fail", ["a", "b"], lambda d: L.fit_logistic(d, "crms", "fail", ["a", "b"], scale=True), folds=3, repeats=2)
    assert scored.count() == 1800
    per_id = scored.groupBy("repeat", "id").count().where("count <> 1").count()
    assert per_id == 0
    metrics = L.resample_metrics(scored, "fail").toPandas()
    assert len(metrics) == 6 and metrics["ROC"].mean() > 0.7 and metrics["Sens"].between(0, 1).all()


def test_trees_learn_the_signal(df):
    from riskloom.operators.roc import auc

    for model in (L.fit_forest(df, "crms", "fail", PREDICTORS, trees=20, depth=4), L.fit_boosted(df, "crms", "fail", PREDICTORS, trees=10, depth=2)):
        assert auc(model.score(df), "crms", "p_event", "fail").first()["auc"] > 0.75


def test_tuning_and_tolerance(spark, df):
    found = L.tune(df, ["id"], "crms", "fail", ["a", "b"], L.fit_logistic, [{"scale": False}, {"scale": True}], folds=3, repeats=1, oversample=False)
    assert L.pick_within_tolerance(found) == 0
    rows = spark.createDataFrame([(0, 0.70), (1, 0.79), (2, 0.80)], "point int, ROC double")
    assert L.pick_within_tolerance(rows) == 1
    table = L.compare_models({"one": found.where("point = 0"), "two": found.where("point = 1")}).toPandas()
    assert len(table) == 6 and (table["min"] <= table["median"]).all() and (table["mean"] <= table["max"]).all()


def test_feature_elimination(df):
    table = L.feature_elimination(df, ["id"], "crms", "fail", PREDICTORS, [1, 2], folds=3).toPandas()
    assert list(table["size"]) == [1, 2, 3] and table["accuracy"].between(0.5, 1).all()
    assert L.best_size(L.feature_elimination(df, ["id"], "crms", "fail", ["a", "noise"], [1], folds=3)) in (1, 2)


def test_imputation(spark, rows):
    holes = [(r[0], r[2], None if r[0] % 10 == 0 else 2.0 * r[3], None if r[0] % 15 == 0 else r[3]) for r in rows]
    df = spark.createDataFrame(holes, "id int, type string, y double, a double")
    full = S.impute_trees(df, ["y", "a"], ["type"]).toPandas().set_index("id")
    assert full[["y", "a"]].notna().all().all()
    truth = {r[0]: 2.0 * r[3] for r in rows}
    gaps = [i for i in truth if i % 10 == 0 and i % 15 != 0]
    assert np.corrcoef([full.loc[i, "y"] for i in gaps], [truth[i] for i in gaps])[0, 1] > 0.9
    kept = [i for i in truth if i % 10]
    assert all(full.loc[i, "y"] == truth[i] for i in kept)
    median = S.impute_median(df, ["y"]).toPandas().set_index("id")
    assert median.loc[0, "y"] == np.median([x[2] for x in holes if x[2] is not None])


def test_prediction_table(df):
    model = L.fit_logistic(df, "crms", "fail", ["a", "b"])
    out = L.predict_table(model, df, "fail", "pass", best=0.2).toPandas()
    assert ((out["p_event"] > 0.5) == (out["pred"] == "fail")).all()
    assert ((out["p_event"] > 0.2) == (out["adj_pred"] == "fail")).all()


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " x ", None), (2, "NA", 2.5)], "a int, b string, c double")
    assert IO.write_table(df, str(tmp_path / "p")).count() == 2
    back = IO.write_table(df.where("a = 1"), str(tmp_path / "c"), "csv").first()
    assert back["a"] == 1 and back["b"].strip() == "x" and back["c"] is None
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "1").mkdir()
    (tmp_path / "book" / "1" / "part.csv").write_text("a,b,c\n1,  x  ,NA\n2,NA,2.5\n")
    rows = [tuple(r) for r in IO.read_sheet(spark, str(tmp_path / "book"), 1, df.schema).collect()]
    assert rows == [(1, "x", None), (2, None, 2.5)]


def test_text_gaps_are_imputed(spark, rows):
    holes = [(r[0], None if r[0] % 10 == 0 else ["lo", "hi"][r[3] > 0], float(r[3]), None if r[0] % 7 == 0 else 1.5 * r[3]) for r in rows]
    df = spark.createDataFrame(holes, "id int, kind string, a double, y double")
    got = {r["id"]: r["kind"] for r in S.impute_trees(df, ["a", "y"], ["kind"]).collect()}
    gaps = {h[0]: ["lo", "hi"][h[2] > 0] for h in holes if h[1] is None}
    assert len(got) == len(holes) and sum(got[i] == k for i, k in gaps.items()) >= 0.9 * len(gaps)
    assert all(got[h[0]] == h[1] for h in holes if h[1])


def test_averaged_cells(spark):
    rows = [(1, 0, "a", "a"), (1, 0, "a", "b"), (1, 1, "a", "a"), (1, 1, "a", "a"), (1, 1, "b", "a"), (1, 1, "b", "b")]
    got = {(r["truth"], r["estimate"]): (r["n"], r["percent"]) for r in L.averaged_cells(spark.createDataFrame(rows, "repeat int, fold int, obs string, pred string"), "obs", "pred").collect()}
    assert got == {("a", "a"): (1.5, 50.0), ("a", "b"): (0.5, 25.0), ("b", "a"): (0.5, 12.5), ("b", "b"): (0.5, 12.5)}


def single_fit(x, y, steps=40):
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ b))
    return b, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None])))), -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()


def test_many_fits_equal_single_ones(spark):
    """All subsets of three columns of very unlike scale, on all rows and without a fold, in common passes."""
    from itertools import combinations

    from riskloom.operators.newton import Candidate, ManyFits

    rng = np.random.default_rng(4)
    x = np.column_stack((rng.normal(size=900), rng.normal(1e4, 3e3, 900), rng.integers(0, 2, 900)))
    y = (rng.random(900) < 1 / (1 + np.exp(-(x[:, 0] - (x[:, 1] - 1e4) / 5e3 + x[:, 2])))).astype(float)
    fold = rng.integers(0, 3, 900)
    frame = spark.createDataFrame([(float(t), *map(float, r), int(k)) for t, r, k in zip(y, x, fold)], "y double, a double, b double, c double, k int").repartition(5)
    work = ManyFits(frame, F.col("y"), ["a", "b", "c"], [F.col("k")])
    asked = [Candidate(list(s), r, f) for n in range(4) for s in combinations(range(3), n) for r, f in ((-1, -1), (0, 1))]
    work.fit(asked)
    for c in asked:
        used = np.ones(900, bool) if c.repeat < 0 else fold != c.fold
        beta, errors, loss = single_fit(x[used][:, c.columns], y[used])
        assert np.allclose(c.beta, beta, rtol=1e-8, atol=1e-10) and np.allclose(c.errors, errors, rtol=1e-8) and abs(c.loss - loss) < 1e-8 and c.rows == used.sum()
        assert abs(c.aic - (2 * loss + 2 * len(beta))) < 1e-7
    calls = {(r.i, r.obs, r.call): r.n for r in work.held_out_calls(asked[-1:]).collect()}
    held = fold == 1
    told = np.column_stack((np.ones(900), x))[held] @ asked[-1].beta > 0
    assert calls == {(0, o, c): n for o in (True, False) for c in (True, False) if (n := int(((y[held] > 0) == o)[told == c].sum()))}
    same = [Candidate([0, 1]), Candidate([0])]  # a column that repeats another adds nothing
    twice = ManyFits(frame.withColumn("b", F.col("a")), F.col("y"), ["a", "b"])
    twice.fit(same)
    assert same[0].rank == same[1].rank == 2 and abs(same[0].aic - same[1].aic) < 1e-7
    apart = [Candidate([0])]  # separated rows: no maximum, but an end
    ManyFits(frame.withColumn("y", (F.col("a") > 0).cast("double")), F.col("y"), ["a"]).fit(apart)
    assert apart[0].loss < 1e-3
    nothing = [Candidate([0])]
    ManyFits(frame.limit(0), F.col("y"), ["a"]).fit(nothing)
    assert nothing[0].rows == 0


@pytest.mark.parametrize("shape", ["plain", "ties", "copies"])
def test_resamples_oversampled_together_equal_single_ones(spark, shape):
    """The neighbours of all training parts from one search are those of a search in each part, equal distances included."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 3)) * [1, 5, 0.2]
    if shape == "ties":
        x = rng.integers(0, 4, (700, 3)).astype(float)
    keys = np.arange(700) // (2 if shape == "copies" else 1)  # keys that come twice, with different values and as far from each other
    x[350:] = x[350:] if shape != "copies" else np.round(x[350:])
    rows = [(int(k), "fail" if i % 3 == 0 else "pass", "t", *map(float, v)) for i, (k, v) in enumerate(zip(keys, x))]
    parts = [S.Resample(r, f, L.job_seed(5, r, f)) for r in (1, 2) for f in range(2)]
    df = spark.createDataFrame(rows, "id long, crms string, kind string, a double, b double, c double").repartition(3, "id").persist()
    df = df.withColumns({f"_f{r}": S.fold_of(["id"], 2, r, 5) for r in (1, 2)})
    names = ["id", "crms", "kind", "a", "b", "c"]
    made = S.smote_resamples(df, "crms", "fail", ["a", "b", "c"], ["id"], parts, block_rows=40).persist()
    assert made.groupBy("_job").count().count() == 4
    for job, part in enumerate(parts):
        train = df.where(part.trained).select(*names)
        want = sorted(tuple(r) for r in S.smote(train, "crms", "fail", ["a", "b", "c"], ["id"], seed=part.seed, block_rows=40).exceptAll(train).collect())
        got = sorted(tuple(r) for r in made.where(F.col("_job") == job).select(*names).collect())
        assert len(got) == len(want) > 0 and [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-9)


def test_scalings_and_fits_together_equal_single_ones(spark, df):
    names = ["a", "b", "noise", "flag", "flat"]
    parts = [S.Resample(r, f, 1) for r in (1, 2) for f in range(3)]
    wide = df.withColumns({"flag": (F.col("id") % 2).cast("double"), "flat": F.lit(0.1), "noise": F.col("noise") - 2, **{f"_f{r}": S.fold_of(["id"], 3, r, 9) for r in (1, 2)}})
    more = df.sparkSession.createDataFrame([(j, float(3 * i), 0.5 * i + j, -1.0 * i, i % 2.0, 0.1, ["fail", "pass"][i % 2]) for j in range(6) for i in range(9)], "_job int, a double, b double, noise double, flag double, flat double, crms string")
    rows = wide.withColumn("_job", F.lit(None).cast("int")).unionByName(more, allowMissingColumns=True)
    known = S.scalings(rows, names, parts, 3)
    from riskloom.operators.newton import Candidate, ResampledFits

    work = ResampledFits(rows, F.col("crms") == "fail", names, parts, known)
    asked = work.fit([Candidate([0, 1, 3], j) for j in range(6)])
    for job, part in enumerate(parts):
        train = rows.where((F.col("_job") == job) | (F.col("_job").isNull() & part.trained)).select(*names, "crms")
        single = S.learn_scaling(train, names)
        one, two = (m.transform(train).toPandas()[names].to_numpy() for m in (single, known[job].stage(names)))
        assert np.allclose(one[:, :4], two[:, :4], atol=1e-8) and np.abs(two[:, 4]).max() < 1e-9  # a constant is 0
        beta, _ = newton(np.column_stack((np.ones(len(one)), one[:, [0, 1, 3]])), (train.toPandas()["crms"] == "fail").to_numpy().astype(float))
        assert np.allclose(asked[job].beta, beta, atol=1e-7)


def test_models_compared_share_their_training_parts(df):
    """A recipe and the same fit as a plain function, which learns all by itself, predict the same."""
    recipe = L.Recipe(L.fit_logistic, "crms", "fail", ["a", "b"], {"scale": True})
    forest = L.Recipe(L.fit_forest, "crms", "fail", ["a", "b"], {"trees": 3, "depth": 3})
    fits = {"recipe": recipe, "plain": lambda d: L.fit_logistic(d, "crms", "fail", ["a", "b"], scale=True), "forest": forest}
    got = L.cross_validate_each(df, ["id"], "crms", "fail", ["a", "b"], fits, folds=2, repeats=1)
    both = got["recipe"].join(got["plain"].withColumnRenamed("p_event", "q"), ["repeat", "fold", "id"])
    assert both.count() == got["forest"].count() == 900 and both.agg(F.max(F.abs(F.col("p_event") - F.col("q")))).first()[0] < 1e-6


def test_hash_of_a_seed_is_sparks(spark):
    rows = spark.range(-3, 4).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(17)).alias("s"), F.xxhash64("id", F.lit(2_900_000_123)).alias("t")).collect()
    for seed, c in ((17, "s"), (2_900_000_123, "t")):
        assert S.seeded_hash(np.array([r["h"] for r in rows]), seed).tolist() == [r[c] for r in rows]


def test_compared_results_are_computed_once(spark):
    """Means, medians and ends are read off one result of each model; its resamples are not scored again for each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(float(i), float(-i), 0.5) for i in range(5)], "ROC double, Sens double, Spec double")
    table = L.compare_models({m: rows.mapInArrow(counted, rows.schema) for m in ("one", "two")}).toPandas().set_index(["model", "metric"])
    assert seen.value == 10
    assert tuple(table.loc[("two", "ROC"), ["mean", "min", "median", "max"]]) == (2.0, 0.0, 2.0, 4.0)


def test_tuning_results_are_stored(df):
    """The choice of a point and its rows read stored metrics; they are not scored again for each use."""
    found = L.tune(df, ["id"], "crms", "fail", ["a", "b"], L.fit_logistic, [{"scale": False}], folds=2, repeats=1, oversample=False)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


@pytest.mark.parametrize("scale", [False, True])
def test_boosted_trees_in_common_passes_equal_mllib(df, scale):
    settings = {"trees": 6, "depth": 2, "shrinkage": 0.3, "min_node": 5, "scale": scale}
    fits = {"passes": L.Recipe(L.fit_boosted, "crms", "fail", PREDICTORS, settings), "mllib": lambda d: L.fit_boosted(d, "crms", "fail", PREDICTORS, **settings)}
    parts = L.cross_validate_each(df, ["id"], "crms", "fail", PREDICTORS, fits, folds=3, repeats=1)
    one, two = ({r["id"]: r["p_event"] for r in parts[n].collect()} for n in ("passes", "mllib"))
    assert one.keys() == two.keys() and len(one) == 900
    assert np.mean([abs(one[i] - two[i]) < 1e-9 for i in one]) > 0.99  # a value on a cut may fall to the other side


@pytest.mark.parametrize("trees,depth", [(40, 5), (1000, 30)])
def test_forests_grown_together(df, trees, depth):
    """As good as single MLlib forests; the draws do not follow from the layout of the rows."""
    from riskloom.operators.roc import auc

    recipe = L.Recipe(L.fit_forest, "crms", "fail", PREDICTORS, {"trees": trees, "depth": depth})
    one = L.cross_validate(df, ["id"], "crms", "fail", PREDICTORS, recipe, folds=3, repeats=1)
    assert one.count() == 900 and one.select("id").distinct().count() == 900
    mllib = L.cross_validate(df, ["id"], "crms", "fail", PREDICTORS, lambda d: L.fit_forest(d, "crms", "fail", PREDICTORS, trees=40, depth=min(depth, 10)), folds=3, repeats=1)
    area = [auc(x, "obs", "p_event", "fail").first()["auc"] for x in (one, mllib)]
    assert area[0] > 0.65 and abs(area[0] - area[1]) < 0.03


def test_deep_trees_part_all_rows_and_count_votes_exactly():
    from riskloom.operators.trees import ONE, Forest, grown_votes

    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 12, (700, 3)).astype(np.uint8), axis=0)
    y = rng.integers(0, 2, len(x))
    draw = lambda **kw: grown_votes(x, y, 1 - y, x, Forest(1, 3, 30), 0, 4, np.random.default_rng(3), **kw)
    votes = draw()
    assert (draw(span=50, nodes=7) == votes).all()  # stretches only bound the memory
    drawn = np.random.default_rng(3)
    told = np.zeros(len(x))
    for _ in range(4):
        hit, missed = drawn.poisson(y), drawn.poisson(1 - y)
        told += hit + missed > 0
    sure = told == 4  # a tree that drew a row ends with it alone
    assert sure.any() and (votes[sure] == 4 * ONE * y[sure]).all()


def test_tuned_point_runs_the_whole_grid(monkeypatch, df):
    from riskloom.plans import models_catalog as Q

    seen = {}
    monkeypatch.setattr(Q, "_rows", lambda *_: df)
    monkeypatch.setattr(Q.L, "tune", lambda *args, **kw: seen.update(args=args, **kw) or args[0].limit(0).selectExpr("0 AS point"))
    monkeypatch.setattr(Q.L, "pick_within_tolerance", lambda found: 0)
    Q.tuned_point(df.sparkSession, "")
    assert list(seen["args"][6]) == [{"mtry": 2}, {"mtry": 5}] and seen.keys() == {"args"}  # 1000 trees of depth 30, five folds, three repeats
    assert L.Recipe(L.fit_forest, "crms", "fail", ["a"], {"mtry": 2}).filled.items() >= {"trees": 1000, "depth": 30}.items()


def test_only_predictions_stay_on_disk(spark, df):
    import os

    folder = IO.checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    recipes = {"glm": L.Recipe(L.fit_logistic, "crms", "fail", PREDICTORS, {"scale": True}), "trees": L.Recipe(L.fit_boosted, "crms", "fail", PREDICTORS, {"trees": 2})}
    found = L.cross_validate_each(df, ["id"], "crms", "fail", PREDICTORS, recipes, folds=3, repeats=1)
    kept = {x for x in set(os.listdir(folder)) - before if x.startswith("settled-")}
    assert kept == {os.path.basename(os.path.dirname(f)) for part in found.values() for f in part.inputFiles()} and len(kept) == 2
    assert [part.count() for part in found.values()] == [900, 900]


def test_rows_of_other_regions_come_along_where_a_cell_reaches():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(3000, 3))
    cells = S.Cells.grown(z, 100)
    part = cells.first[cells.leaf(z)]
    k, many = 8, int(cells.parts.sum())
    low, high = (np.stack([f(z[part == p], axis=0) for p in range(many)]) for f in (np.min, np.max))
    reach = np.array([S._closest(z[part == p], z[part == p], k, np.arange((part == p).sum()))[1][:, -1].max() for p in range(many)])
    reach[0] = -1  # nobody asks there
    row, to = cells.bounded(low, high).reaching(z, reach)
    lent = set(zip(row.tolist(), to.tolist()))
    assert 0 not in to and len(lent) < 0.6 * len(z) * many
    for i in rng.permutation(3000)[:200]:
        if part[i]:
            far = ((z - z[i]) ** 2).sum(axis=1)
            assert {(int(j), int(part[i])) for j in np.argsort(far)[: k + 1]} <= lent
