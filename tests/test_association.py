import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.operators import association as T


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(9)
    rows = []
    for name in ("u", "v"):
        for i in range(240):
            t = ["Bulk", "Container", "RoRo"][int(rng.integers(0, 3) if rng.random() < 0.6 else 0)]
            c = "fail" if rng.random() < (0.3 if t == "Bulk" else 0.6) else "pass"
            if name == "v" and t == "RoRo" and c == "fail":
                continue  # an empty cell
            rows.append((name, t, c, float(1e6 + rng.normal() + (t == "RoRo") + 0.5 * (c == "fail"))))
    rows += [("u", None, "fail", 1.0), ("u", "Bulk", "fail", None)]
    return rows, spark.createDataFrame(rows, "name string, type string, crms string, value double")


def nested_ss(rows, interaction):
    y = np.array([r[3] for r in rows])
    t, c = [r[1] for r in rows], [r[2] for r in rows]
    one = np.ones((len(y), 1))
    a = np.column_stack([np.array([x == v for x in t], float) for v in sorted(set(t))])
    b = np.column_stack([np.array([x == v for x in c], float) for v in sorted(set(c))])
    designs = [one, np.column_stack([one, a]), np.column_stack([one, a, b])]
    if interaction:
        designs.append(np.column_stack([one, *[a[:, [i]] * b[:, [j]] for i in range(a.shape[1]) for j in range(b.shape[1])]]))
    y = y - y.mean()
    rss, rank = [], []
    for x in designs:
        coef = np.linalg.lstsq(x, y, rcond=None)[0]
        rss.append(float(((y - x @ coef) ** 2).sum()))
        rank.append(np.linalg.matrix_rank(x))
    return [(rank[i + 1] - rank[i], rss[i] - rss[i + 1]) for i in range(len(designs) - 1)] + [(len(y) - rank[-1], rss[-1])]


@pytest.mark.parametrize("interaction", [True, False])
def test_two_way_equals_nested_fits(cells, interaction):
    rows, df = cells
    got = T.anova_two_way(df, "value", "type", "crms", ["name"], interaction=interaction).toPandas().sort_values(["name", "ord"])
    for name in ("u", "v"):
        part = got[got["name"] == name]
        want = nested_ss([r for r in rows if r[0] == name and r[1] is not None and r[3] is not None], interaction)
        assert list(part["df"]) == [d for d, _ in want]
        assert np.allclose(part["sumsq"], [s for _, s in want], rtol=1e-6, atol=1e-6)
        assert abs(part["sumsq"].sum() - sum(s for _, s in want)) < 1e-5
        assert part["p"].dropna().between(0, 1).all()


def test_one_way_and_constant(spark, cells):
    rows, df = cells
    row = T.anova_one_way(df.where("name = 'u'"), "value", "crms").first()
    y = [r[3] for r in rows if r[0] == "u" and r[3] is not None]
    g = [r[2] for r in rows if r[0] == "u" and r[3] is not None]
    means = {v: np.mean([x for x, k in zip(y, g) if k == v]) for v in set(g)}
    within = sum((x - means[k]) ** 2 for x, k in zip(y, g))
    assert abs(row["ss_within"] - within) < 1e-4 * within
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, x double")
    row = T.anova_one_way(flat, "x", "g").first()
    assert row["ss_between"] == 0 and row["f"] is None


def test_correlation_null_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, None), (3.0, 5.0, 1.0), (4.0, 9.0, 2.0)], "a double, b double, c double")
    def table(use):
        return {(r["var1"], r["var2"]): r["r"] for r in T.corr_matrix(df, ["a", "b", "c"], use).collect()}

    strict, complete, pairwise = table("everything"), table("complete"), table("pairwise")
    assert strict[("a", "c")] is None and abs(strict[("a", "b")] - np.corrcoef([1, 2, 3, 4], [2, 4.5, 5, 9])[0, 1]) < 1e-12
    assert abs(complete[("a", "b")] - np.corrcoef([1, 3, 4], [2, 5, 9])[0, 1]) < 1e-12
    assert abs(pairwise[("a", "c")] - np.corrcoef([1, 3, 4], [5, 1, 2])[0, 1]) < 1e-12
    assert complete[("c", "c")] == 1.0


def test_correlation_p(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    y = x + rng.normal(size=30)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {(r["var1"], r["var2"]): r["p"] for r in T.corr_pvalues(df, ["x", "y"]).collect()}
    r = np.corrcoef(x, y)[0, 1]
    # For 28 degrees of freedom, by integrating the t density.
    t = abs(r) * np.sqrt(28 / (1 - r * r))
    grid = np.linspace(t, t + 200, 2_000_001)
    dens = (1 + grid**2 / 28) ** (-14.5)
    from math import gamma, pi, sqrt

    scale = gamma(14.5) / (sqrt(28 * pi) * gamma(14))
    want = 2 * scale * np.sum((dens[1:] + dens[:-1]) / 2) * (grid[1] - grid[0])
    assert abs(got[("x", "y")] - want) < 1e-8
    assert got[("x", "x")] == 0.0


def test_drop_correlated(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(a), float(a + 0.05 * rng.normal()), float(b)) for a, b in zip(x, z)]
    gone = T.drop_correlated(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"], 0.8)
    assert len(gone) == 1 and gone[0] in {"x", "y"}


def test_fisher_two_by_two(spark):
    rows = [("tea", True, True)] * 3 + [("tea", True, False)] + [("tea", False, True)] + [("tea", False, False)] * 3
    rows += [("empty", True, True)] * 4 + [("tea", None, True)]
    df = spark.createDataFrame(rows, "t string, x boolean, y boolean")
    got = {r["t"]: (r["a"], r["b"], r["c"], r["d"], round(r["p"], 4)) for r in T.fisher_2x2(df, F.col("x"), F.col("y"), ["t"]).collect()}
    assert got["tea"] == (3, 1, 1, 3, 0.4857)
    assert got["empty"] == (4, 0, 0, 0, 1.0)


def test_fisher_large_margins():
    assert tails.fisher_two_sided(10**9, 0, 0, 10**9) == 0.0
    p = tails.fisher_two_sided(500_000, 500_000, 500_000, 500_500)
    z = (500_000 * 500_500 - 500_000 * 500_000) / np.sqrt(1_000_000 * 1_000_500 * 1_000_000 * 1_000_500 / 2_000_500)
    from math import erfc, sqrt

    assert abs(p - erfc(z / sqrt(2))) < 0.01


def test_fisher_rxc_near_exact(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "y")] * 3 + [(None, "x")]
    df = spark.createDataFrame(rows, "g string, h string")
    row = T.fisher_rxc(df, "g", "h", replicates=4000, seed=3).first()
    assert row["n"] == 8 and abs(row["p"] - 0.4857) < 0.03
    again = T.fisher_rxc(df, "g", "h", replicates=4000, seed=3).first()
    assert again["p"] == row["p"]
    assert T.fisher_rxc(df, "g", "h", replicates=100, show_na=True).first()["n"] == 9


def test_tails_against_known_values():
    assert abs(float(tails.f_tail(4.0, 2, 10)) - (1 + 0.8) ** -5) < 1e-12
    assert abs(float(tails.t_two_sided(2.0, 10)) - 0.07338803) < 1e-7
    for df2 in (1e4, 3e5, 1e9):
        assert abs(float(tails.f_tail(4.0, 2, df2)) - np.exp(-df2 / 2 * np.log1p(8 / df2))) < 1e-8
    assert abs(float(tails.chi_one_tail(3.841458820694124)) - 0.05) < 1e-9
    rng = np.random.default_rng(0)
    drawn = tails.draw_tables(rng, np.array([10, 20, 5]), np.array([15, 20]), 50)
    assert (drawn.sum(axis=2) == [10, 20, 5]).all() and (drawn.sum(axis=1) == [15, 20]).all() and (drawn >= 0).all()
    big = tails.draw_tables(rng, np.array([10**9, 2 * 10**9]), np.array([10**9, 2 * 10**9]), 20)
    assert (big.sum(axis=2) == [10**9, 2 * 10**9]).all() and (big >= 0).all()


def test_drop_correlated_over_columns_still_in(spark):
    """Five columns, so that means after a removal differ from means over all."""
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(3):
        base = rng.normal(size=(60, 2))
        x = np.column_stack([base[:, 0], base[:, 0] + 0.3 * rng.normal(size=60), base[:, 1], base[:, 0] + base[:, 1], base[:, 1] + 0.2 * rng.normal(size=60)])
        names = list("abcde")
        m = np.abs(np.round(np.corrcoef(x.T), 2))
        np.fill_diagonal(m, np.nan)
        order, gone = sorted(range(5), key=lambda k: -np.nanmean(m[k])), set()
        for p, i in enumerate(order):
            for j in order[p + 1 :]:
                if i not in gone and j not in gone and m[i, j] > 0.6:
                    stay = [k for k in range(5) if k not in gone]
                    mean_i = np.nanmean([m[i, k] for k in stay])
                    rest = np.nanmean([[m[a, k] for k in stay] for a in stay if a != j])
                    gone.add(i if mean_i > rest else j)
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
        assert T.drop_correlated(df, names, 0.6) == [n for k, n in enumerate(names) if k in gone]
