import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators import ordered as O


def test_bins_never_decrease(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([
        rng.normal(size=3000), rng.lognormal(sigma=8, size=3000), -rng.lognormal(sigma=8, size=3000),
        2.0 ** np.arange(-1000, 1000, 7), [0.0, np.inf, -np.inf, 5e-324, 1.7e308], 1.6e15 + np.arange(2000),
    ])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = df.withColumn("b", O.value_bin(F.col("x"))).toPandas().sort_values("x")
    assert (np.diff(got["b"].to_numpy()) >= 0).all()


def test_running_totals_match_sorting(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x), int(rng.integers(1, 4))) for g in "ab" for x in sorted(set(np.round(rng.normal(scale=50, size=400), 1)))]
    df = spark.createDataFrame(rows, "g string, x double, n long")
    got = O.running_totals(df, ["g"], "x", ["n"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("x")
        want = part["n"].cumsum().shift(fill_value=0)
        assert (part["n_ahead"] == want).all()
        assert (part["n_all"] == part["n"].sum()).all()


# Every case runs in one session; the frames are small.
@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = O.exact_quantiles(df, [], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    want = np.quantile(values, [0.25, 0.5, 0.9])
    assert np.allclose([got["a"], got["b"], got["c"]], want, rtol=1e-12, atol=1e-9)


def test_quantiles_with_a_hot_value_and_nulls(spark):
    rows = [("hot", 7.0)] * 500 + [("hot", float(i)) for i in range(400)] + [("one", 3.5), ("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["q"], r["m"]) for r in O.exact_quantiles(df, ["g"], "x", {"q": 0.25, "m": 0.5}).collect()}
    hot = [x for g, x in rows if g == "hot"]
    assert got["hot"] == (float(np.quantile(hot, 0.25)), float(np.median(hot)))
    assert got["one"] == (3.5, 3.5)
    assert "none" not in got


def test_dense_codes(spark):
    df = spark.createDataFrame([(30,), (10,), (10,), (None,), (20,)], "x int")
    got = sorted((r["x"] or 0, r["c"]) for r in O.ranked_codes(df, [], "x", "c").collect())
    assert got == [(0, None), (10, 1), (10, 1), (20, 2), (30, 3)]


def test_edges_are_searched_once_a_row(spark):
    """Two searches, of the lists and in one of them, however often their results are named."""
    df = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") / 7).alias("x"))
    edges = O.settled(O.bin_edges(df, ["g"], "x"))
    plan = O.binned(df, ["g"], "x", edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 2
    flat = np.array([e for part in edges.first()[O.EDGES] for e in part])
    got = O.binned(df, ["g"], "x", edges).select("x", F.shiftright(O.BIN, 25).alias("b")).toPandas().sort_values("x")
    upto = np.searchsorted(flat, got["x"], "right")
    assert len(flat) > 3 and (got["b"] == 2 * upto - np.isin(got["x"], flat)).all()
