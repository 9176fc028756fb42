import itertools

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.operators import roc as R


def brute_auc(rows):
    pos = [s for t, s in rows if t == "fail" and s is not None]
    neg = [s for t, s in rows if t == "pass" and s is not None]
    return sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    rows = []
    for name, scale in (("coarse", 4), ("fine", 1e6), ("tiny", 1e-9)):
        for _ in range(300):
            hit = rng.random() < 0.3
            value = float(np.floor((rng.normal() + 0.4 * hit) * 4) / 4 * scale)
            rows.append((name, "fail" if hit else "pass", value))
    rows += [("constant", "fail", 1.0), ("constant", "pass", 1.0), ("single", "fail", 1.0), ("single", "fail", 2.0)]
    rows += [("inverted", "fail", 1.0), ("inverted", "pass", 2.0), ("inverted", "pass", None), ("inverted", None, 9.0)]
    return rows, spark.createDataFrame(rows, "name string, crms string, value double")


def test_auc_equals_pair_count(scored):
    rows, df = scored
    got = {r["name"]: r["auc"] for r in R.auc(df, "crms", "value", "fail", ["name"]).collect()}
    for name in ("coarse", "fine", "tiny"):
        assert abs(got[name] - brute_auc([(t, v) for n, t, v in rows if n == name])) < 1e-12
    assert got["constant"] == 0.5
    assert got["inverted"] == 0.0
    assert got["single"] is None


def test_auc_three_ways(scored):
    _, df = scored
    part = df.where("name = 'coarse'")
    area = R.auc(part, "crms", "value", "fail").first()["auc"]
    curve = R.roc_curve(part, "crms", "value", "fail").toPandas().sort_values("threshold")
    x, y = 1 - curve["specificity"].to_numpy(), curve["sensitivity"].to_numpy()
    trapezoid = float(-np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))
    labelled = part.select((F.col("crms") == "fail").cast("double").alias("label"), F.col("value").alias("rawPrediction"))
    evaluated = BinaryClassificationEvaluator(numBins=0).evaluate(labelled)
    assert abs(area - trapezoid) < 1e-12
    assert abs(area - evaluated) < 1e-9


def test_curve_ends_and_single_class(scored):
    _, df = scored
    curve = R.roc_curve(df, "crms", "value", "fail", ["name"]).toPandas()
    assert "single" not in set(curve["name"])
    part = curve[curve["name"] == "constant"].sort_values("threshold")
    assert [tuple(r) for r in part[["threshold", "specificity", "sensitivity"]].to_numpy()] == [(-np.inf, 0, 1), (1, 0, 1), (np.inf, 1, 0)]


def test_best_threshold_against_every_threshold(scored):
    rows, df = scored
    got = R.best_threshold(df, "crms", "value", "fail", ["name"]).toPandas()
    for name in ("coarse", "fine", "tiny"):
        pos = np.array([v for n, t, v in rows if n == name and t == "fail"])
        neg = np.array([v for n, t, v in rows if n == name and t == "pass"])
        js = {v: (pos >= v).sum() * len(neg) - (neg >= v).sum() * len(pos) for v in set([*pos, *neg])}
        top = max(js.values())
        assert set(got[got["name"] == name]["threshold"]) == {v for v, j in js.items() if j == top}


def test_ties_and_corner_distance(spark):
    # Thresholds 2 and 4 share J = 0.5 at different corner distances.
    rows = [("fail", 4.0), ("pass", 3.0), ("fail", 2.0), ("pass", 1.0)]
    df = spark.createDataFrame(rows, "crms string, value double")
    assert sorted(r["threshold"] for r in R.best_threshold(df, "crms", "value", "fail").collect()) == [2.0, 4.0]
    rows = [("fail", 5.0), ("fail", 4.0), ("pass", 3.0), ("pass", 2.5), ("pass", 2.2), ("fail", 2.0), ("pass", 1.0), ("fail", 0.5), ("fail", 0.4), ("fail", 0.3)]
    df = spark.createDataFrame(rows, "crms string, value double")
    both = R.best_threshold(df, "crms", "value", "fail").collect()
    assert [r["threshold"] for r in both] == [4.0]
    near = R.best_threshold(spark.createDataFrame([("fail", 4.0), ("pass", 3.0), ("fail", 2.0), ("pass", 1.0)], "crms string, value double"), "crms", "value", "fail", tie="nearest").collect()
    far = R.roc_summary(spark.createDataFrame([("fail", 4.0), ("pass", 3.0), ("fail", 2.0), ("pass", 1.0)], "crms string, value double"), "crms", "value", "fail", tie="farthest", one_row=True).collect()
    assert len(near) == 2 and len(far) == 1 and far[0]["threshold"] == 2.0


def test_report(spark, scored):
    _, df = scored
    labels = spark.createDataFrame([("coarse", "Coarse score")], "name string, Predictor string")
    rows = R.report_table(R.roc_summary(df, "crms", "value", "fail", ["name"]), labels).collect()
    assert rows[0]["auc"] == max(r["auc"] for r in rows)
    assert {r["Predictor"] for r in rows if r["name"] == "coarse"} == {"Coarse score"}


def test_no_window_over_a_whole_series(spark, scored):
    """Every window that sorts scores is partitioned by bin as well as by series."""
    _, df = scored
    plan = R.auc(df, "crms", "value", "fail", ["name"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "_s#" in line.split("windowspecdefinition")[-1]:
            assert "_bin#" in line


def test_missing_group_level_is_a_group(spark):
    rows = [(None, "fail", 2.0), (None, "pass", 1.0), ("a", "fail", 1.0), ("a", "pass", 2.0)]
    df = spark.createDataFrame(rows, "type string, crms string, value double")
    got = {r["type"]: (r["auc"], r["threshold"]) for r in R.roc_summary(df, "crms", "value", "fail", ["type"], one_row=True).collect()}
    assert got == {None: (1.0, 2.0), "a": (0.0, 1.0)}
    assert {r["type"] for r in R.roc_curve(df, "crms", "value", "fail", ["type"]).collect()} == {None, "a"}
