"""One group, value or key holding a large share of the rows: same results, no lone heavy task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordered as O
from riskloom.operators import profile as A
from riskloom.operators import roc as R


@pytest.fixture(scope="module")
def skewed(spark):
    """200,000 rows: 60 % in one group, a third of that on one value."""
    n = F.col("id")
    u = F.pmod(F.xxhash64(n), F.lit(1_000_003)) / 1_000_003.0
    group = F.when(u < 0.6, "hot").otherwise(F.concat(F.lit("g"), F.pmod(n, F.lit(40))))
    value = F.when(F.pmod(n, F.lit(3)) == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64(n, F.lit(7)), F.lit(100_000)) / 1000.0)
    hit = F.pmod(F.xxhash64(n, F.lit(9)), F.lit(100)) < F.lit(20) + (value / 5).cast("int")
    return spark.range(200_000).select(n, group.alias("g"), value.alias("x"), hit.alias("hit")).persist()


def test_auc_and_quantiles_on_a_hot_group(skewed):
    hot = skewed.where("g = 'hot'").toPandas()
    got = R.auc(skewed, "hit", "x", True, ["g"]).where("g = 'hot'").first()
    pos, neg = np.sort(hot[hot["hit"]]["x"]), np.sort(hot[~hot["hit"]]["x"])
    wins = np.searchsorted(neg, pos, "left").sum() + 0.5 * (np.searchsorted(neg, pos, "right") - np.searchsorted(neg, pos, "left")).sum()
    assert abs(got["auc"] - wins / (len(pos) * len(neg))) < 1e-12
    q = O.exact_quantiles(skewed, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.99}).where("g = 'hot'").first()
    assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(hot["x"], [0.1, 0.5, 0.99]))


@pytest.mark.parametrize("low,width", [(0.0, 100.0), (0.9999, 0.0001), (1.7e9, 86_400.0), (-1e12, 1.0), (0.0, 1e-300)])
def test_largest_sorted_share_is_small(skewed, low, width):
    """Distinct values of the hot group spread over many bins, wherever they lie; a third of its rows on one value is a bin of its own."""
    rows = skewed.select("g", (F.lit(low) + F.col("x") / 100 * width).alias("x"))
    placed = O.binned(rows, ["g"], "x", O.bin_edges(rows, ["g"], "x").persist()).where("g = 'hot'")
    sizes = placed.groupBy(O.BIN).agg(F.count("*").alias("n"), F.count_distinct("x").alias("values"), F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    assert (sizes[sizes["values"] > 1].n < 0.01 * sizes.n.sum()).all() and (sizes["values"] <= 0.015 * sizes["values"].sum()).all()
    by = sizes.sort_values(O.BIN)
    assert (by.high.to_numpy()[:-1] < by.low.to_numpy()[1:]).all()
    assert sizes.n.max() > 0.3 * sizes.n.sum()


def test_squeezed_scores_and_times(spark):
    """Scores in [0.9999, 1] and epoch seconds: exact totals and quantiles."""
    n = F.col("id")
    rows = spark.range(60_000).select(F.pmod(n, F.lit(2)).alias("g"), F.when(n % 2 == 0, 0.9999 + F.pmod(F.xxhash64(n), F.lit(40_000)) / 4e8).otherwise(1.7e9 + F.pmod(F.xxhash64(n), F.lit(30_000))).alias("x"))
    held = rows.toPandas()
    got = O.exact_quantiles(rows, ["g"], "x", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.999, "e": 1.0}).toPandas().set_index("g")
    for g, part in held.groupby("g"):
        assert np.array_equal(got.loc[g], np.quantile(part.x, [0.0, 0.31, 0.5, 0.999, 1.0])) or np.allclose(got.loc[g], np.quantile(part.x, [0.0, 0.31, 0.5, 0.999, 1.0]), rtol=1e-15)
    values = rows.groupBy("g", "x").agg(F.count("*").alias("n"))
    totals = O.running_totals(values, ["g"], "x", ["n"]).toPandas()
    for g, part in totals.groupby("g"):
        part = part.sort_values("x")
        assert (part.n_ahead == part.n.cumsum().shift(fill_value=0)).all() and part[O.BIN].value_counts().max() < max(0.01 * len(part), 600)


def test_quantiles_without_broadcast(spark, skewed):
    """A result over the session's broadcast limit goes through a shuffled join and gives the same."""
    one = {r["g"]: r["m"] for r in O.exact_quantiles(skewed, ["g"], "x", {"m": 0.5}).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        two = {r["g"]: r["m"] for r in O.exact_quantiles(skewed, ["g"], "x", {"m": 0.5}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert one == two and len(one) == 41


def test_quantile_scan_is_not_shuffled(skewed):
    """Rows meet the target bins by broadcast: no exchange of the data by group and bin."""
    plan = O.exact_quantiles(skewed, ["g"], "x", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_first_and_duplicates_on_a_hot_key(skewed):
    first = A.keep_first(skewed.select("g", "id"), ["g"], [F.col("id")]).toPandas().set_index("g")["id"]
    want = skewed.groupBy("g").agg(F.min("id").alias("id")).toPandas().set_index("g")["id"]
    assert first.sort_index().equals(want.sort_index())
    assert A.duplicate_rows(skewed, ["g"]).count() == 200_000


def test_scan_reads_only_what_is_used(spark, tmp_path):
    wide = spark.range(100).select(F.col("id"), *[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(8)], (F.col("id") % 2 == 0).alias("hit"))
    wide.write.parquet(str(tmp_path / "wide"))
    back = spark.read.parquet(str(tmp_path / "wide"))
    plan = R.auc(R.to_series(back, ["c1", "c2"], ["hit"]).where("hit IS NOT NULL"), "hit", "value", True, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c1:double,c2:double,hit:boolean>" in plan
    assert "PushedFilters: [IsNotNull(hit)]" in plan
