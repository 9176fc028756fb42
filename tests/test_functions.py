import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import dates as D
from riskloom.functions import numeric as N
from riskloom.functions import text as X
from riskloom.operators import prepare as P
from riskloom.operators import profile as A


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clean_names():
    assert [C.clean_name(n) for n in ("LoF", "Caw c", "Ports_12m", "% cover", "2021", "Side (Port/Stbd)", "LOA", "Max_LU_12m")] == [
        "lo_f", "caw_c", "ports_12m", "percent_cover", "x2021", "side_port_stbd", "loa", "max_lu_12m",
    ]


def test_clean_names_repeats(spark):
    assert C.clean_names(spark.createDataFrame([(1, 2)], ["a b", "a.b"])).columns == ["a_b", "a_b_2"]


def test_ranges_and_relocation(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 4)], ["a", "b", "c", "d"])
    assert C.cols_between(df, "b", "d") == ["b", "c", "d"]
    assert C.relocate(df, "d", after="a").columns == ["a", "d", "b", "c"]
    assert C.relocate(df, ["c", "d"], before="a").columns == ["c", "d", "a", "b"]
    assert C.drop_at(df, 0, 1).columns == ["c", "d"]
    assert C.cols_where(df, numeric=True, without="a") == ["b", "d"]
    assert C.derive_unused(df, "e", F.col("a") + F.col("d"), ["a", "d"], after="b").columns == ["b", "e", "c"]
    lookup = spark.createDataFrame([("a", "A1"), ("zzz", "no")], ["old", "new"])
    assert C.rename_from(df, lookup, "old", "new").columns == ["A1", "b", "c", "d"]


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert C.columns_with_nulls(df) == ["b"]


def test_text(spark):
    assert one(spark, X.title_case(F.lit("xing zhi-HAI o'neil"))) == "Xing Zhi-Hai O'neil"
    assert one(spark, X.sentence_case(F.lit("ALL Areas"))) == "All areas"
    assert one(spark, X.after_last_comma(F.lit("Lyttelton, New Zealand"))) == "New Zealand"
    assert one(spark, X.after_last_comma(F.lit("Fiji"))) == "Fiji"
    assert one(spark, X.after_last_comma(F.lit(None).cast("string"))) is None
    assert one(spark, X.strip_all(F.lit("A-1-2"), "-")) == "A12"
    assert one(spark, X.yes_no(F.lit(None).cast("string"))) is None
    assert one(spark, X.yes_no(F.lit("Yes, some"))) == "Yes"


def test_recode_and_levels(spark):
    df = spark.createDataFrame([("Reefer",), ("Bulk",), (None,), ("RoRo",)], "t string")
    got = df.select(
        X.recode(F.col("t"), {"Reefer": "Container"}).alias("r"),
        X.collapse(F.col("t"), "Cargo", ["Reefer", "Bulk"]).alias("c"),
        X.level_rank(F.col("t"), ["Bulk", "Reefer"]).alias("o"),
    ).collect()
    assert [tuple(r) for r in got] == [("Container", "Cargo", 2), ("Bulk", "Cargo", 1), (None, None, None), ("RoRo", "RoRo", 3)]
    lookup = spark.createDataFrame([("Reefer", "Container")], "k string, v string")
    assert sorted(str(r["t"]) for r in P.recode_from(df, "t", lookup, "k", "v").collect()) == ["Bulk", "Container", "None", "RoRo"]


def test_rounding(spark):
    values = {0.125: 0.12, -0.125: -0.12, 0.0: 0.0}
    for x, want in values.items():
        assert one(spark, N.half_even(F.lit(x), 2)) == want
    assert one(spark, N.signif(F.lit(1234.5), 2)) == 1200.0
    assert one(spark, N.signif(F.lit(0.00123), 2)) == 0.0012
    assert one(spark, N.signif(F.lit(-0.0678), 2)) == -0.068
    assert one(spark, N.signif(F.lit(0.0), 2)) == 0.0
    assert one(spark, N.signif(F.lit(546.0), 2)) == 550.0


def test_strict_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(N.strict_mean(F.col("x")).alias("m")).collect()}
    assert got == {"a": None, "b": 3.0, "c": None}


def test_row_helpers(spark):
    df = spark.createDataFrame([(1.0, 0.0, -2.0), (None, 1.0, 1.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    got = df.select(N.row_sum(cols), N.richness(cols), N.presence(F.col("a")), N.at_least_zero(F.col("c")), N.at_least_zero(F.col("a"))).collect()
    assert tuple(got[0]) == (-1.0, 1, 1.0, 0.0, 1.0)
    assert tuple(got[1]) == (None, None, None, 1.0, None)
    assert one(spark, N.to_number(F.lit(" 1.5 "))) == 1.5
    assert one(spark, N.to_number(F.lit("n/a"))) is None


def test_days(spark):
    a, b = F.lit(dt.date(2021, 3, 5)), F.lit(dt.datetime(2021, 3, 1, 23, 0))
    assert one(spark, D.days_between(a, b)) == 4
    assert one(spark, D.days_between(b, a)) == -4
    assert one(spark, D.days_between(a, a)) == 0
    none = F.lit(None).cast("date")
    assert one(spark, D.days_between(a, none)) is None
    assert one(spark, D.days_or(a, none, F.lit(99))) == 99
    assert one(spark, D.days_between(F.lit("2021-03-05"), F.lit("rubbish"))) is None
    assert one(spark, D.to_day(F.lit("05/03/2021"), "dd/MM/yyyy")) == dt.date(2021, 3, 5)


def test_patch_and_exclude(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), (None, 4.0)], "k string, x double")
    fixes = spark.createDataFrame([("b", 9.0), ("zzz", 1.0)], "k string, v double")
    got = {r["k"]: r["x"] for r in P.patch(df, "k", "x", fixes, "v").collect()}
    assert got == {"a": 1.0, "b": 9.0, "c": None, None: 4.0}
    assert sorted(r["k"] for r in P.exclude_keys(df, "k", fixes).collect()) == ["a", "c"]


def test_joins(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "name int, v string")
    dim = spark.createDataFrame([(1, "one")], "value int, label string")
    assert {tuple(r) for r in P.lookup_join(df, dim, {"name": "value"}).collect()} == {(1, "x", "one"), (2, "y", None)}
    right = spark.createDataFrame([(1, "r1"), (3, "r3")], "name int, w string")
    assert [tuple(r) for r in P.align(df, right, ["name"], ["v"]).collect()] == [(1, "x", "r1")]
    stacked = P.stack({"p": df, "q": right}, "src")
    assert {tuple(r) for r in stacked.collect()} == {("p", 1, "x", None), ("p", 2, "y", None), ("q", 1, None, "r1"), ("q", 3, None, "r3")}


def test_backfill(spark):
    rows = [(-3.0, 5.0, 1.0, 1.0), (None, 10.0, 0.0, 0.0), (None, 10.0, 0.0, 2.0), (None, 10.0, 3.0, 1.0), (100.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "clean double, film double, cover double, lof double")
    clean, film = P.backfill_clean(*[F.col(c) for c in df.columns])
    got = [tuple(r) for r in df.select(clean, film).collect()]
    assert got == [(0.0, 5.0), (100.0, 10.0), (90.0, 10.0), (None, 10.0), (100.0, 0.0)]


def test_profile_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "g string, h string")
    freq = {r["value"]: (r["n"], r["percent"], r["valid_percent"]) for r in A.freq_table(df, "g").collect()}
    assert freq == {"a": (2, 0.5, 2 / 3), "b": (1, 0.25, 1 / 3), None: (1, 0.25, None)}
    cells = {(r["g"], r["h"]): r["n"] for r in A.crosstab(df, "g", "h").collect()}
    assert cells == {("a", "x"): 1, ("a", None): 1, (None, "x"): 1, (None, None): 0, ("b", "x"): 1, ("b", None): 0}
    known = {(r["g"], r["h"]): r["n"] for r in A.crosstab(df, "g", "h", show_na=False).collect()}
    assert known == {("a", "x"): 1, ("b", "x"): 1}
    nulls = {r["var"]: r["nas"] for r in A.null_profile(df).collect()}
    assert nulls == {"g": 1, "h": 1}


def test_group_moments_counts_nulls_in_n(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0)], "g string, x double")
    got = {r["g"]: r for r in A.group_moments(df, ["g"], "x").collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["median"]) == (3, 2.0, 2.0)
    assert abs(got["a"]["se"] - (2**0.5) / 3**0.5) < 1e-12
    assert got[None]["median"] == 5.0


def test_status_with_unknown(spark):
    rows = [("v", "bow", 0.0), ("v", "bow", 1.0), ("v", "hull", 0.0), ("w", "bow", None), ("w", "hull", 1.0)]
    df = spark.createDataFrame(rows, "unit string, area string, f double")
    got = {(r["unit"], r["area"]): (r["mean_area"], r["failed"], r["status"], r["sum_fail"], r["fail_prop"]) for r in A.unit_status(df, ["unit"], ["area"], ["f"]).collect()}
    assert got[("v", "bow")] == (0.5, 1, "Fail", 1, 0.5)
    assert got[("v", "hull")] == (0.0, 0, "Pass", 1, 0.5)
    assert got[("w", "bow")] == (None, None, None, None, None)


def test_keep_first_and_duplicates(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, None)], "key string, o int, v string")
    assert {tuple(r) for r in A.keep_first(df, ["key"], [F.col("o")]).collect()} == {("k", 1, "a"), ("m", 3, None)}
    assert [tuple(r) for r in A.duplicate_keys(df, ["key"]).collect()] == [("k", 2)]
    assert A.duplicate_rows(df, ["key"]).count() == 2


def test_top_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, 0.0)], "g string, i int, x double")
    assert sorted(r["i"] for r in A.top_per_group(df, ["g"], "x").collect()) == [1, 2, 4]


def test_numbered(spark):
    df = spark.createDataFrame([(v,) for v in ("b", "a", "c", "a")], "v string")
    assert {r["v"]: r["no"] for r in P.numbered(df, "v", "no").collect()} == {"a": 1, "b": 2, "c": 3}


def test_beta_tail_does_not_jump_where_shapes_get_large():
    from math import exp, lgamma, log, log1p

    import numpy as np

    from riskloom.functions import tails

    for a, b, x in ((99_999, 2_999, 0.97), (100_001, 2_999, 0.97), (100_001, 3_001, 0.97), (100_001, 1, 0.99998), (250_000, 250_000, 0.501)):
        n = a + b - 1  # P(X >= a) of n trials
        terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(x) + (n - k) * log1p(-x) for k in range(a, n + 1)]
        assert abs(tails.beta_cdf(a, b, x) - sum(map(exp, terms))) < 1e-7
    assert np.allclose(tails.beta_cdf(5e8, 5e8, 0.5), 0.5, atol=1e-8)


def test_draws_are_exact_at_every_size():
    import numpy as np

    from riskloom.functions import tails

    rng = np.random.default_rng(5)
    for good, bad, take in ((11_000_000, 1_089_000_000, 10), (110_000_000, 990_000_000, 10), (3, 7, 4), (5, 1000, 100), (600_000_000, 600_000_000, 50)):
        n = 100_000
        seen = np.bincount(tails.draw_hypergeometric(rng, np.full(n, good), np.full(n, bad), np.full(n, take))) / n
        want = np.exp(tails.log_hypergeometric(np.arange(len(seen)), good, bad, take))
        often = want * n > 10
        assert (np.abs(seen - want)[often] < 5 * np.sqrt(want * (1 - want) / n)[often]).all()
    assert (tails.draw_hypergeometric(rng, np.array([5, 0]), np.array([0, 5]), np.array([3, 3])) == [3, 0]).all()
