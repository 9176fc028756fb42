import numpy as np

from riskloom.functions import tails
from riskloom.operators import confusion as M


def frame(spark, tp, fp, fn, tn):
    rows = [("fail", "fail")] * tp + [("pass", "fail")] * fp + [("fail", "pass")] * fn + [("pass", "pass")] * tn
    return spark.createDataFrame([*rows, (None, "fail"), ("pass", None)], "crms string, pred string")


def test_cells_and_metrics(spark):
    df = frame(spark, 8, 2, 4, 16)
    assert tuple(M.confusion(df, "crms", "pred", "fail").first()) == (8, 2, 4, 16)
    got = {r["metric"]: r["estimate"] for r in M.class_metrics(df, "crms", "pred", "fail").collect()}
    assert list(got) == M.METRICS
    assert got["accuracy"] == 0.8 and got["sens"] == 8 / 12 and got["spec"] == 16 / 18
    assert got["precision"] == 0.8 and got["f_meas"] == 16 / 22
    chance = (10 * 12 + 20 * 18) / 900
    assert abs(got["kap"] - (0.8 - chance) / (1 - chance)) < 1e-12
    assert abs(got["mcc"] - (8 * 16 - 2 * 4) / np.sqrt(10 * 12 * 18 * 20)) < 1e-12


def test_empty_predicted_class_and_all_correct(spark):
    got = {r["metric"]: r["estimate"] for r in M.class_metrics(frame(spark, 0, 0, 3, 5), "crms", "pred", "fail").collect()}
    assert got["ppv"] is None and got["mcc"] is None and got["sens"] == 0.0
    got = {r["metric"]: r["estimate"] for r in M.class_metrics(frame(spark, 3, 0, 0, 5), "crms", "pred", "fail").collect()}
    assert got["kap"] == 1.0 and got["accuracy"] == 1.0


def test_swapped_arguments_swap_recall_and_precision(spark):
    df = frame(spark, 8, 2, 4, 16)
    right = {r["metric"]: r["estimate"] for r in M.class_metrics(df, "crms", "pred", "fail").collect()}
    swapped = {r["metric"]: r["estimate"] for r in M.class_metrics(df, "pred", "crms", "fail").collect()}
    assert swapped["sens"] == right["ppv"] and swapped["ppv"] == right["sens"]


def test_zero_cells_kept(spark):
    cells = M.confusion_cells(M.confusion(frame(spark, 3, 0, 0, 5), "crms", "pred", "fail"), "fail", "pass")
    assert {(r["truth"], r["estimate"]): r["n"] for r in cells.collect()} == {("fail", "fail"): 3, ("pass", "fail"): 0, ("fail", "pass"): 0, ("pass", "pass"): 5}


def test_statistics_agree_with_metrics(spark):
    row = M.matrix_statistics(frame(spark, 8, 2, 4, 16), "crms", "pred", "fail").first()
    assert row["accuracy"] == 0.8 and row["no_information_rate"] == 0.6 and row["prevalence"] == 0.4
    # Published limits of 24 in 30 and the binomial tail at 0.6, by direct summation.
    from math import comb

    tail = sum(comb(30, k) * 0.6**k * 0.4 ** (30 - k) for k in range(24, 31))
    assert abs(row["accuracy_p"] - tail) < 1e-12
    low, high = row["accuracy_low"], row["accuracy_high"]
    assert abs(sum(comb(30, k) * low**k * (1 - low) ** (30 - k) for k in range(24, 31)) - 0.025) < 1e-9
    assert abs(sum(comb(30, k) * high**k * (1 - high) ** (30 - k) for k in range(0, 25)) - 0.025) < 1e-9
    assert abs(row["mcnemar_p"] - float(tails.chi_one_tail((abs(2 - 4) - 1) ** 2 / 6))) < 1e-12
    terms = {r["term"] for r in M.tidy_statistics(M.matrix_statistics(frame(spark, 8, 2, 4, 16), "crms", "pred", "fail")).collect()}
    assert {"accuracy", "kap", "mcnemar", "detection_rate"} <= terms


def test_statistics_without_disagreement(spark):
    row = M.matrix_statistics(frame(spark, 3, 0, 0, 5), "crms", "pred", "fail").first()
    assert row["mcnemar_p"] is None and row["accuracy_high"] == 1.0


def test_sweep_equals_direct_counting(spark):
    rng = np.random.default_rng(2)
    scores = np.concatenate([np.round(rng.random(300), 2), rng.random(300), [0.0, 1.0, 0.29, 0.57, 0.58, -0.2, 1.4]])
    truth = rng.random(len(scores)) < 0.4
    df = spark.createDataFrame([("fail" if t else "pass", float(s)) for t, s in zip(truth, scores)], "crms string, p double")
    got = M.threshold_sweep(df, "crms", "p", "fail").toPandas().sort_values("threshold")
    assert len(got) == 99
    for r in got.itertuples():
        called = scores >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((called & truth).sum(), (called & ~truth).sum(), (~called & truth).sum(), (~called & ~truth).sum())
    best = M.sweep_best(M.threshold_sweep(df, "crms", "p", "fail")).toPandas()
    assert set(best["threshold"]) == set(got[got["j_index"] == got["j_index"].max()]["threshold"])


def test_sweep_averaged_over_resamples(spark):
    rows = [(1, "fail", 0.9), (1, "pass", 0.1), (2, "fail", 0.2), (2, "pass", 0.8)]
    df = spark.createDataFrame(rows, "r int, crms string, p double")
    mean = M.averaged_sweep(M.threshold_sweep(df, "crms", "p", "fail", ["r"]), ["r"])
    got = {round(r["threshold"], 2): r["sens"] for r in mean.collect()}
    assert got[0.5] == 0.5 and got[0.1] == 1.0


def test_misclassified(spark):
    df = frame(spark, 1, 2, 3, 4)
    assert M.misclassified(df, "crms", "pred").count() == 5
