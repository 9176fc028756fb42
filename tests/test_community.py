import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import association as T
from riskloom.operators import community as E

TAXA = ["t1", "t2", "t3", "t4"]


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(60):
        g = ["fail", "pass"][i % 2]
        t = ["Bulk", "RoRo", "Tanker"][i % 3]
        x = [float(rng.random() < p) * float(rng.integers(1, 9)) for p in ((0.8, 0.2, 0.5, 1.0) if g == "fail" else (0.3, 0.6, 0.5, 1.0))]
        rows.append((i, g, t, *x))
    rows.append((60, "pass", "Bulk", 0.0, 0.0, 0.0, 0.0))  # an empty site
    return rows, spark.createDataFrame(rows, "site int, crms string, type string, t1 double, t2 double, t3 double, t4 double")


def brute_d(a, b, metric):
    apart, both = np.abs(a - b).sum(), (a + b).sum()
    if metric == "euclid":
        return float(np.sqrt(((a - b) ** 2).sum()))
    bray = apart / both
    return float(bray if metric == "bray" else 2 * bray / (1 + bray))


@pytest.mark.parametrize("metric", ["bray", "jaccard", "euclid"])
def test_distances_against_brute_force(sites, metric):
    rows, df = sites
    got = E.profile_distances(E.profiles(df, TAXA), TAXA, metric).collect()
    different = {tuple(r[3:]): 0 for r in rows}
    for r in rows:
        different[tuple(r[3:])] += 1
    assert len(got) == len(different) * (len(different) - 1) // 2
    for r in got:
        a, b = (np.array([float(x) for x in r[p].split("|")]) for p in ("profile1", "profile2"))
        assert abs(r["d"] - brute_d(a, b, metric)) < 1e-12
        assert (r["n1"], r["n2"]) == (different[tuple(a)], different[tuple(b)])


def brute_permanova(x, g):
    n = len(x)
    d2 = np.array([[0.0 if (a == b).all() else brute_d(a, b, "bray") ** 2 for b in x] for a in x])
    total = d2[np.triu_indices(n)].sum() / n
    within = 0.0
    for v in set(g):
        at = [i for i in range(n) if g[i] == v]
        within += sum(d2[i, j] for i, j in itertools.combinations(at, 2)) / len(at)
    return total, within


def test_permanova_against_all_pairs(sites):
    rows, df = sites
    present = E.presence_table(df, TAXA)
    x = (np.array([r[3:] for r in rows]) > 0).astype(float)
    total, within = brute_permanova(x, [r[1] for r in rows])
    row = E.permanova(present, TAXA, "crms").first()
    assert abs(row["ss_total"] - total) < 1e-9 and abs(row["ss_within"] - within) < 1e-9
    terms = {r["term"]: r for r in E.permanova_terms(present, TAXA, ["crms", "type"], permutations=99).collect()}
    assert abs(terms["crms"]["sumsq"] - (total - within)) < 1e-9
    assert abs(terms["Total"]["sumsq"] - total) < 1e-9
    both = sum(terms[t]["sumsq"] for t in ("crms", "type", "Residuals"))
    assert abs(both - total) < 1e-9
    assert terms["crms"]["df"] == 1 and terms["type"]["df"] == 2 and terms["Total"]["df"] == 60
    assert 0.01 <= terms["crms"]["p"] <= 0.05 and terms["type"]["p"] > 0.01
    # Same statistic from either route.
    assert abs(row["f"] - ((total - within) / 1) / (within / 59)) < 1e-9


def test_second_term_is_adjusted(sites):
    """The second term's sum of squares equals the projection on the site level."""
    rows, df = sites
    x = (np.array([r[3:] for r in rows]) > 0).astype(float)
    n = len(x)
    d2 = np.array([[0.0 if (a == b).all() else brute_d(a, b, "bray") ** 2 for b in x] for a in x])
    centre = np.eye(n) - 1 / n
    gower = -0.5 * centre @ d2 @ centre
    design = [np.ones((n, 1))]
    for k in (1, 2):
        levels = sorted({r[k] for r in rows})
        design.append(np.column_stack([[float(r[k] == v) for r in rows] for v in levels]))

    def hat(parts):
        m = np.column_stack(parts)
        return m @ np.linalg.pinv(m)

    want = np.trace((hat(design) - hat(design[:2])) @ gower)
    got = {r["term"]: r["sumsq"] for r in E.permanova_terms(E.presence_table(df, TAXA), TAXA, ["crms", "type"], permutations=9).collect()}
    assert abs(got["type"] - want) < 1e-9


@pytest.mark.parametrize("block,metric", [(512, "bray"), (7, "bray"), (9, "euclid")])
def test_permanova_over_log_cover_in_blocks(spark, block, metric):
    """Every site a profile of its own, and some profiles of many sites: blocks change nothing, p is that of shuffled labels."""
    rng = np.random.default_rng(8)
    x = np.concatenate((np.log1p(rng.gamma(1.0, 2.0, size=(70, 3))), np.tile([[1.0, 0.0, 2.0]], (25, 1)), np.zeros((12, 3))))
    g = rng.integers(0, 3, len(x))
    x[:70] += (g[:70] == 1)[:, None] * np.array([0.35, 0.0, 0.0])
    frame = spark.createDataFrame([(*map(float, v), "abc"[k]) for v, k in zip(x, g)], "p double, q double, r double, grp string")
    got = {r["term"]: r for r in E.permanova_terms(frame, ["p", "q", "r"], ["grp"], metric, permutations=399, block_profiles=block, at_once=50).collect()}
    if metric == "bray":
        both = (x[:, None] + x[None]).sum(axis=2)
        d2 = np.divide(np.abs(x[:, None] - x[None]).sum(axis=2), both, out=np.zeros_like(both), where=both > 0) ** 2
    else:
        d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    total = d2.sum() / 2 / len(x)

    def f_of(labels):
        within = sum(d2[np.ix_(labels == k, labels == k)].sum() / 2 / (labels == k).sum() for k in range(3))
        return (total - within) / 2 / (within / (len(x) - 3)), within

    f, within = f_of(g)
    assert abs(got["grp"]["f"] - f) < 1e-9 * abs(f) and abs(got["Total"]["sumsq"] - total) < 1e-9 * total and abs(got["Residuals"]["sumsq"] - within) < 1e-9 * within
    p = (sum(f_of(rng.permutation(g))[0] >= f for _ in range(2000)) + 1) / 2001
    assert abs(got["grp"]["p"] - p) < 4 * np.sqrt(p * (1 - p) / 399) + 0.005 and got["grp"]["df"] == 2


def test_centroid_distance_equals_pair_form(sites):
    rows, df = sites
    present = E.presence_table(df, TAXA)
    got = {r["site"]: r["dist"] for r in E.centroid_distances(present, TAXA, "type").collect()}
    x = (np.array([r[3:] for r in rows]) > 0).astype(float)
    for i, r in enumerate(rows):
        at = [j for j, o in enumerate(rows) if o[2] == r[2]]
        d2 = ((x[at][:, None] - x[at][None]) ** 2).sum(axis=2)
        mine = ((x[i] - x[at]) ** 2).sum(axis=1).mean() - d2.mean() / 2
        assert abs(got[r[0]] ** 2 - mine) < 1e-9
    f = T.anova_one_way(E.centroid_distances(present, TAXA, "type"), "dist", "type").first()
    assert f["df_between"] == 2 and f["f"] >= 0


def test_indicator_values(sites):
    rows, df = sites
    got = {(r["taxon"], r["grp"]): (r["a"], r["b"], r["stat"]) for r in E.indicator_values(df, TAXA, "crms").collect()}
    for k, t in enumerate(TAXA):
        means = {g: np.mean([r[3 + k] for r in rows if r[1] == g]) for g in ("fail", "pass")}
        for g in means:
            b = np.mean([r[3 + k] > 0 for r in rows if r[1] == g])
            a = means[g] / sum(means.values())
            assert np.allclose(got[(t, g)], (a, b, np.sqrt(a * b)))


def test_permuted_sums_keep_groups_and_totals(spark, sites):
    rows, df = sites
    got = E.permuted_sums(df, TAXA, ["site"], "crms", 60, seed=5, blocks=4).toPandas()
    assert len(got) == 120 and set(got[got.grp == "fail"].n) == {30.0}
    for _, part in got.groupby("permutation"):
        assert np.allclose(np.sum(part.sums.tolist(), axis=0), [sum(r[3 + k] for r in rows) for k in range(len(TAXA))])
        assert np.array_equal(np.sum(part.hits.tolist(), axis=0), [sum(r[3 + k] > 0 for r in rows) for k in range(len(TAXA))])
    one = np.array([v[0] for v in got[got.grp == "fail"].sums])
    x = np.array([r[3] for r in rows], float)
    spread = 30 * (len(x) - 30) / (len(x) - 1) * x.var()  # of a sum of 30 drawn without replacement
    assert len(set(one)) > 30 and abs(one.mean() - 30 * x.mean()) < 4 * np.sqrt(spread / 60) and 0.5 < one.var() / spread < 1.8
    again = E.permuted_sums(df.repartition(7), TAXA, ["site"], "crms", 60, seed=5, blocks=4).toPandas()
    key = ["permutation", "grp"]
    assert np.allclose(np.stack(got.sort_values(key).sums), np.stack(again.sort_values(key).sums))


def test_combinations_of_groups(sites):
    from itertools import combinations

    rows, df = sites
    got = {(r["taxon"], r["grp"]): (r["a"], r["b"], r["stat"]) for r in E.indicator_combinations(df, TAXA, "type").collect()}
    levels = sorted({r[2] for r in rows})
    want = [c for n in range(1, len(levels)) for c in combinations(levels, n)]
    assert {g for _, g in got} == {"+".join(c) for c in want} and len(levels) == 3
    for k, t in enumerate(TAXA):
        means = {g: np.mean([r[3 + k] for r in rows if r[2] == g]) for g in levels}
        for c in want:
            a = sum(means[g] for g in c) / sum(means.values())
            b = np.mean([r[3 + k] > 0 for r in rows if r[2] in c])
            assert np.allclose(got[(t, "+".join(c))], (a, b, np.sqrt(a * b)))
    assert {r["grp"] for r in E.indicator_test(df, TAXA, ["site"], "type", permutations=19, most=None).collect()} <= {"+".join(c) for c in want}


@pytest.mark.parametrize("kind", ["presence", "cover", "one"])
def test_spatial_medians_are_least(spark, sites, kind):
    """No point around gives a smaller sum of distances; in one dimension it is the median."""
    rows, df = sites
    taxa = TAXA[:1] if kind == "one" else TAXA
    df = E.presence_table(df, taxa) if kind == "presence" else df
    x = np.array([[r[3 + TAXA.index(t)] for t in taxa] for r in rows], float)
    x = (x > 0).astype(float) if kind == "presence" else x
    rng = np.random.default_rng(1)
    for r in E.spatial_medians(df, taxa, "type").collect():
        mine, at = x[[o[2] == r["type"] for o in rows]], np.array([r[t] for t in taxa])
        total = lambda p: np.linalg.norm(mine - p, axis=1).sum()
        tried = [at + rng.normal(size=len(taxa)) * s for s in (1e-1, 1e-2, 1e-3, 1e-4) for _ in range(200)] + list(mine)
        assert total(at) <= min(map(total, tried)) + 1e-6
        if kind == "one":
            assert abs(total(at) - total(np.median(mine, axis=0))) < 1e-6
    spread = E.median_distances(df, taxa, "type")
    assert spread.count() == len(rows)


def test_indicator_test(sites):
    _, df = sites
    rows = {r["taxon"]: r for r in E.indicator_test(df, TAXA, ["site"], "crms", permutations=199, seed=2).collect()}
    assert rows["t1"]["grp"] == "fail" and rows["t1"]["p"] < 0.05
    assert all(0 < r["p"] <= 1 for r in rows.values())
    again = {r["taxon"]: r["p"] for r in E.indicator_test(df, TAXA, ["site"], "crms", permutations=199, seed=2).collect()}
    assert again == {t: r["p"] for t, r in rows.items()}


def test_shares_and_means(sites):
    _, df = sites
    share = E.taxa_share(df, ["crms"], TAXA).groupBy("crms").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in share)
    assert E.ordination(df, TAXA, ["site"]).columns == ["site", "axis1", "axis2"]
    logged = E.site_means(df.withColumn("t1", F.when(F.col("site") != 0, F.col("t1"))), ["crms"], TAXA)
    got = {r["crms"]: r["t1"] for r in logged.collect()}
    assert got["fail"] is None and got["pass"] is not None


def test_one_group_and_empty_bar_do_not_divide_by_zero(spark, sites):
    from riskloom.operators import figures as V

    rows, df = sites
    row = E.permanova(E.presence_table(df, TAXA).withColumn("all", F.lit("x")), TAXA, "all").first()
    assert row["df_between"] == 0 and row["f"] is None
    empty = spark.createDataFrame([("a", "t", 0.0), ("b", "t", 1.0)], "bar string, name string, x double")
    assert {r["bar"]: r["share"] for r in V.mean_share(empty, ["bar"], "name", "x").collect()} == {"a": None, "b": 1.0}


def test_permanova_leaves_out_incomplete_sites(spark):
    taxa = ["a", "b", "c"]
    rows = [("x", 1.0, 0.0, 0.0), ("x", 1.0, 1.0, 0.0), ("x", 1.0, 0.0, 0.0), ("y", 0.0, 1.0, 1.0), ("y", 0.0, 0.0, 1.0), ("y", 0.0, 1.0, 1.0)]
    more = [*rows, ("x", None, 1.0, 1.0), ("y", 1.0, None, 0.0), (None, 1.0, 1.0, 1.0)]
    schema = "grp string, a double, b double, c double"
    whole, some = spark.createDataFrame(rows, schema), spark.createDataFrame(more, schema)
    one, two = E.permanova(whole, taxa, "grp").first(), E.permanova(some, taxa, "grp").first()
    assert one == two
    terms = {r["term"]: r for r in E.permanova_terms(some, taxa, ["grp"], permutations=64).collect()}
    assert abs(terms["grp"]["f"] - one["f"]) < 1e-9 and abs(terms["grp"]["sumsq"] - one["ss_between"]) < 1e-9


def test_day_sites_hold_all_amounts(spark):
    """The distance queries read all events: their sites hold every amount, and still lack taxa."""
    import os

    import oracle

    from riskloom.plans import registry
    from riskloom.plans.catalog import QUERIES

    folder = f"{oracle.DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are not here")
    sites = registry.day_sites(spark, folder).toPandas()
    events = spark.read.parquet(f"{folder}/events.parquet").toPandas()
    pairs = events.assign(day=events.ts.dt.date).groupby(["user_id", "day", "event_type"]).value.sum()
    assert len(sites) == pairs.reset_index().groupby(["user_id", "day"]).ngroups and sites.user_id.is_unique
    assert (sites[registry.TAXA] > 0).sum().sum() == (pairs > 0).sum()
    assert abs(np.expm1(sites[registry.TAXA]).sum().sum() - events.value.sum()) < 1e-6 * events.value.sum()
    assert len(QUERIES["bray_curtis"](spark, folder).collect()) > 300
