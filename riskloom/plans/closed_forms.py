"""Queries whose statistics have a closed form that SQL can write: tests, one-factor models, ordination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import tails
from riskloom.functions.columns import ref
from riskloom.operators import association as T
from riskloom.operators import community as E
from riskloom.operators import confusion as M
from riskloom.operators import models as L
from riskloom.operators import resample as S
from riskloom.operators.roc import auc
from riskloom.plans.registry import DAY_SQL, SITE_SQL, TAXA, UNITS_SQL, day_sites, query, rounded, site_table, table, units
from riskloom.plans.tests_catalog import CELLS_SQL, JUDGED_SQL, TWO_WAY_SQL, _judged, _pa, _roots

GROUPS_SQL = f"""{UNITS_SQL}, g AS (SELECT type, count(*) AS n, count(*) FILTER (crms = 'fail') AS e FROM units GROUP BY 1),
b AS (SELECT * FROM g ORDER BY type LIMIT 1)"""


def _one_factor(spark: SparkSession, sf_dir: str) -> tuple[L.Fitted, DataFrame]:
    rows = units(spark, sf_dir).select("unit", "crms", "type")
    return L.fit_logistic(rows, "crms", "fail", ["type"]), rows


@query(f"""WITH {GROUPS_SQL} SELECT round(ln(g.e / (g.n - g.e)) - ln(b.e / (b.n - b.e)), 4) AS estimate,
  round(sqrt(1 / g.e + 1 / (g.n - g.e) + 1 / b.e + 1 / (b.n - b.e)), 4) AS se FROM g CROSS JOIN b WHERE g.type <> b.type
UNION ALL SELECT round(ln(e / (n - e)), 4), round(sqrt(1 / e + 1 / (n - e)), 4) FROM b""")
def glm_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.coefficients(_one_factor(spark, sf_dir)[0], spark).select("estimate", "se"), "estimate", "se", digits=4)


@query(f"""WITH {GROUPS_SQL} SELECT round(abs((ln(g.e / (g.n - g.e)) - ln(b.e / (b.n - b.e))) / sqrt(1 / g.e + 1 / (g.n - g.e) + 1 / b.e + 1 / (b.n - b.e))), 3) AS importance
FROM g CROSS JOIN b WHERE g.type <> b.type""")
def importance_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.variable_importance(_one_factor(spark, sf_dir)[0], spark).select("importance"), "importance", digits=3)


@query(f"""WITH {GROUPS_SQL} SELECT unit, crms, round(e / n, 5) AS p_event, round(1 - e / n, 5) AS p_other, CASE WHEN e / n > 0.5 THEN 'fail' ELSE 'pass' END AS pred
FROM units JOIN g ON units.type = g.type""")
def predict_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _one_factor(spark, sf_dir)
    out = L.predict_table(model, rows, "fail", "pass", best=0.33).select("unit", "crms", "p_event", "p_other", "pred")
    return rounded(out, "p_event", "p_other", digits=5)


@query(f"""WITH {GROUPS_SQL} SELECT round(sum(n), 2) AS pearson, CAST(sum(n) - count(*) AS BIGINT) AS df, round(sum(n) / (sum(n) - count(*)), 6) AS ratio FROM g""")
def dispersion_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _one_factor(spark, sf_dir)
    return rounded(rounded(L.dispersion(model.score(rows), "crms", "fail", len(model.names) + 1), "pearson", digits=2), "ratio")


@query(f"""WITH {GROUPS_SQL}, f AS (SELECT -2 * sum(e * ln(e / n) + (n - e) * ln(1 - e / n)) + 2 * count(*) AS with_type,
  -2 * (sum(e) * ln(sum(e) / sum(n)) + (sum(n) - sum(e)) * ln(1 - sum(e) / sum(n))) + 2 AS without FROM g)
SELECT 0 AS step, NULL AS dropped, round(with_type, 3) AS aic FROM f UNION ALL SELECT 1, 'type', round(without, 3) FROM f WHERE without < with_type""")
def step_aic_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("unit", "crms", "type")
    return rounded(L.step_aic(rows, "crms", "fail", ["type"])[1], "aic", digits=3)


@query(f"""WITH {TWO_WAY_SQL} SELECT name, term, round((1 + 2 * (sumsq / 2 / (rest / rdf)) / rdf) ** (-rdf / 2), 6) AS p FROM
 (SELECT name, 'l_returnflag' AS term, s1 AS sumsq, rest, rdf FROM s UNION ALL SELECT name, 'l_returnflag:l_linestatus', sc - s1 - s2, rest, rdf FROM s)""")
def anova_two_df_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An F tail with two degrees of freedom above is a power."""
    out = T.anova_two_way(_roots(spark, sf_dir), "value", "l_returnflag", "l_linestatus", ["name"])
    return rounded(out.where((ref("df") == 2) & (ref("term") != "Residuals")).select("name", "term", "p"), "p")


@query(f"""WITH {DAY_SQL}, pa AS (SELECT grp, {', '.join(f'(CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END) AS {t}' for t in TAXA)} FROM sites),
m AS (SELECT grp AS g, {', '.join(f'avg({t}) AS m_{t}' for t in TAXA)} FROM pa GROUP BY 1),
d AS (SELECT grp, sqrt({' + '.join(f'({t} - m_{t}) ** 2' for t in TAXA)}) AS dist FROM pa JOIN m ON grp = g),
c AS (SELECT grp, count(*) AS n, avg(dist) AS mean, var_pop(dist) AS v FROM d GROUP BY 1), t AS (SELECT sum(n * mean) / sum(n) AS mm FROM c),
s AS (SELECT sum(n) - 3 AS dw, sum(n * (mean - mm) ** 2) / 2 / (sum(n * v) / (sum(n) - 3)) AS f FROM c CROSS JOIN t)
SELECT round((1 + 2 * f / dw) ** (-dw / 2), 6) AS p FROM s""")
def dispersion_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.anova_one_way(E.centroid_distances(_pa(spark, sf_dir), TAXA, "grp"), "dist", "grp")
    tail = tails.f_tail_col("f", ref("df_between").cast("double"), ref("df_within").cast("double"))
    return rounded(out.select(tail.alias("p")), "p")


@query(f"""WITH {JUDGED_SQL}, c AS (SELECT type, {CELLS_SQL} FROM j GROUP BY 1), k AS (SELECT *, tp + fp + fn + tn AS n, tp + tn AS hit, greatest(tp + fn, fp + tn) / (tp + fp + fn + tn) AS r FROM c),
x AS (SELECT *, unnest(range(hit, n + 1)) AS i FROM k)
SELECT type, round(least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(r) + (n - i) * ln(1 - r)))), 6) AS accuracy_p FROM x GROUP BY 1""")
def accuracy_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(at least as many right under the no-information rate): an upper binomial tail, summed in SQL."""
    stats = M.matrix_statistics(_judged(spark, sf_dir), "crms", "pred_21_simple", "fail", ["type"])
    return rounded(stats.select("type", "accuracy_p"), "accuracy_p")


DROP_SQL = """WITH r AS (SELECT round(abs(corr(l_quantity, l_extendedprice)), 2) AS r FROM lineitem)
SELECT CASE WHEN r > 0.8 THEN 1 ELSE 0 END AS dropped FROM r"""


@query(DROP_SQL)
def drop_correlated_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of two columns go: one when they are correlated above the cutoff."""
    gone = T.drop_correlated(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 0.8)
    return spark.createDataFrame([(len(gone),)], "dropped int")


@query(f"""WITH {UNITS_SQL}, f AS (SELECT unit % 5 AS fold, crms, av_speed FROM units),
w AS (SELECT fold, crms, (rank() OVER (PARTITION BY fold ORDER BY av_speed) + (count(*) OVER (PARTITION BY fold, av_speed) - 1) / 2) AS r FROM f)
SELECT fold, round((sum(r) FILTER (crms = 'fail') - count(*) FILTER (crms = 'fail') * (count(*) FILTER (crms = 'fail') + 1) / 2)
  / (count(*) FILTER (crms = 'fail') * count(*) FILTER (crms <> 'fail')), 8) AS auc FROM w GROUP BY 1""")
def auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area by fold of a fixed score over a given fold column, as mean ranks give it."""
    rows = units(spark, sf_dir).select(F.pmod("unit", F.lit(5)).alias("fold"), "crms", "av_speed")
    return rounded(auc(rows, "crms", "av_speed", "fail", ["fold"]).select("fold", "auc"), "auc", digits=8)


@query(f"""WITH {SITE_SQL}, c AS (SELECT var_samp(click) AS a, covar_samp(click, view) AS b, var_samp("view") AS d FROM sites),
v AS (SELECT (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS top, a, b, d FROM c), u AS (SELECT b / sqrt(b * b + (top - a) ** 2) AS x, (top - a) / sqrt(b * b + (top - a) ** 2) AS y FROM v)
SELECT user_id, round(abs(click * x + "view" * y), 6) AS axis1, round(abs("view" * x - click * y), 6) AS axis2 FROM sites CROSS JOIN u""")
def pca_two_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axes of two taxa by the formula for a 2 x 2 matrix; an axis has no sign."""
    axes = E.ordination(site_table(spark, sf_dir), ["click", "view"], ["user_id"])
    return rounded(axes.withColumns({a: F.abs(a) for a in ("axis1", "axis2")}), "axis1", "axis2")


@query("""WITH x AS (SELECT p_retailprice AS x FROM part), l AS (SELECT round(-3 + 0.25 * i, 6) AS lam FROM range(0, 25) t(i)), y AS (SELECT lam, CASE WHEN x >= 0 AND abs(lam) < 1e-9 THEN ln(1 + x) WHEN x >= 0 THEN (pow(x + 1, lam) - 1) / lam
    WHEN abs(2 - lam) < 1e-9 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END AS y, sign(x) * ln(1 + abs(x)) AS j FROM x CROSS JOIN l),
  s AS (SELECT lam, -count(*) / 2 * ln(var_pop(y)) + (lam - 1) * sum(j) AS ll FROM y GROUP BY 1)
  SELECT arg_max(lam, ll) AS coarse FROM s""")
def yeo_johnson_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lambda of the coarse grid, by the profile likelihood."""
    part = table(spark, sf_dir, "part")
    grid = {"p_retailprice": [round(-3 + 0.25 * i, 6) for i in range(25)]}
    best = S._best_lambda(S._profile_likelihood(part, ["p_retailprice"], grid))
    return spark.createDataFrame([(best["p_retailprice"],)], "coarse double")


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL")
def fisher_rxc_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fisher_rxc(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select("n")


@query(f"""WITH {SITE_SQL}, l AS (UNPIVOT sites ON {', '.join(TAXA)} INTO NAME taxon VALUE value), m AS (SELECT taxon, grp, avg(value) AS m, avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS b FROM l GROUP BY 1, 2),
s AS (SELECT taxon, grp, sqrt(m / sum(m) OVER (PARTITION BY taxon) * b) AS stat FROM m)
SELECT taxon, arg_max(grp, stat) AS grp, round(max(stat), 8) AS stat FROM s GROUP BY 1""")
def indval_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed part of the indicator test: the best group of each taxon."""
    tested = E.indicator_test(site_table(spark, sf_dir), TAXA, ["user_id"], "grp", permutations=9)
    return rounded(tested.select("taxon", "grp", "stat"), "stat", digits=8)
