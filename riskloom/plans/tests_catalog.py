"""Queries: rules, confusion, ROC, statistical tests, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.operators import association as T
from riskloom.operators import community as E
from riskloom.operators import confusion as M
from riskloom.operators import roc as R
from riskloom.operators import rules as D
from riskloom.operators.profile import unit_means
from riskloom.plans.registry import (
    DAY_SQL, MEASURES, SCORES_SQL, SITE_SQL, TAXA, UNITS_SQL, day_sites, query, rounded, scores, site_table, table, units,
)

PRED_17 = """CASE WHEN type IN ('Bulk', 'Tanker') AND (time_since_owm > 260 OR time_since_af > 260) OR (laid_up_more_10d > 0 AND ports_12m > 35) THEN 'fail'
  WHEN type = 'Container' AND time_since_owm > 550 OR (time_since_survey > 200 AND time_since_af > 500) THEN 'fail'
  WHEN type = 'RoRo' AND (time_since_owm > 230 OR time_since_af > 230 OR ports_12m > 80) THEN 'fail'
  WHEN type = 'Passenger' AND (time_since_owm > 230 OR time_since_af > 320 OR laid_up_more_10d > 0 OR max_lu_12m > 5) THEN 'fail' ELSE 'pass' END"""
PRED_21 = """CASE WHEN type = 'Bulker/Tanker' AND time_since_af > 324 OR laid_up_more_10d > 0 OR time_since_owm > 324 OR av_speed < 12 THEN 'fail'
  WHEN type = 'Container' AND time_since_af > 550 OR time_since_owm > 569 THEN 'fail'
  WHEN type = 'RoRo' AND time_since_af > 363 OR time_since_owm > 363 OR time_since_survey > 329 THEN 'fail'
  WHEN type = 'Passenger' AND time_since_af > 437 OR time_since_owm > 270 THEN 'fail' ELSE 'pass' END"""


@query(f"WITH {UNITS_SQL} SELECT unit, {PRED_17} AS pred_17, {PRED_21} AS pred_21 FROM units")
def rule_set_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rules_2021(D.rules_2017(units(spark, sf_dir))).select("unit", "pred_17", "pred_21")


@query(f"""WITH {UNITS_SQL} SELECT unit, CASE WHEN type = 'Container' AND (time_since_af > 550 OR time_since_owm > 569) THEN 'fail'
  WHEN type = 'RoRo' AND (time_since_af > 363 OR time_since_owm > 363 OR time_since_survey > 329) THEN 'fail'
  WHEN type = 'Passenger' AND (time_since_af > 437 OR time_since_owm > 270) THEN 'fail' ELSE 'pass' END AS pred_21 FROM units""")
def rule_set_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rules_2021(units(spark, sf_dir), bracketed=True).select("unit", "pred_21")


@query(f"""WITH {UNITS_SQL}, g AS (SELECT *, CASE WHEN ports_12m < 5 THEN NULL ELSE time_since_af END AS af FROM units)
SELECT unit, CASE WHEN af > 342 THEN 'fail' WHEN af <= 342 THEN 'pass' END AS pred_21_simple FROM g""")
def rule_set_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    gappy = units(spark, sf_dir).withColumn("time_since_af", F.when(ref("ports_12m") >= 5, ref("time_since_af")))
    return D.rules_2021_simple(gappy).select("unit", "pred_21_simple")


@query(f"""WITH {UNITS_SQL} SELECT unit, CASE WHEN NPorts > 47 THEN 'fail' WHEN type = 'Cargo' AND time_since_af > 340 THEN 'fail'
  WHEN type = 'RoRo' AND time_since_af > 320 OR NPorts > 32 THEN 'fail' WHEN type = 'Passenger' AND time_since_af > 370 OR MMDays > 2 THEN 'fail' ELSE 'pass' END AS pred_21,
  CASE WHEN type = 'Container' AND time_since_af > 550 OR type = 'RoRo' AND time_since_af > 363 OR type = 'Passenger' AND time_since_af > 437 THEN 'fail' ELSE 'pass' END AS pred_21a,
  CASE WHEN time_since_af > 342 THEN 'fail' ELSE 'pass' END AS pred_21_simple FROM units""")
def rule_set_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rules_merged(units(spark, sf_dir)).select("unit", "pred_21", "pred_21a", "pred_21_simple")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 AND l_discount > 0.05 THEN 'fail' WHEN l_returnflag = 'R' THEN 'review' ELSE 'pass' END AS verdict FROM lineitem""")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [(1, "l_quantity > 45 AND l_discount > 0.05", "fail"), (2, "l_returnflag = 'R'", "review")]
    rules = spark.createDataFrame(lines, "ord int, predicate string, outcome string")
    out = D.apply_rule_table(table(spark, sf_dir, "lineitem"), rules, "verdict")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "verdict")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rules_2021_simple(units(spark, sf_dir))


JUDGED_SQL = f"{UNITS_SQL}, j AS (SELECT *, CASE WHEN time_since_af > 342 THEN 'fail' ELSE 'pass' END AS pred FROM units)"
CELLS_SQL = """count(*) FILTER (crms = 'fail' AND pred = 'fail') AS tp, count(*) FILTER (crms = 'pass' AND pred = 'fail') AS fp,
  count(*) FILTER (crms = 'fail' AND pred = 'pass') AS fn, count(*) FILTER (crms = 'pass' AND pred = 'pass') AS tn"""


@query(f"WITH {JUDGED_SQL} SELECT crms AS truth, pred AS estimate, count(*) AS n FROM j GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = M.confusion(_judged(spark, sf_dir), "crms", "pred_21_simple", "fail")
    return M.confusion_cells(cells, "fail", "pass")


METRIC_SQL = """(tp + tn) / n AS accuracy, ((tp + tn) / n - pe) / (1 - pe) AS kap, tp / (tp + fn) AS sens, tn / (tn + fp) AS spec, tp / (tp + fp) AS ppv, tn / (tn + fn) AS npv,
  (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, tp / (tp + fn) + tn / (tn + fp) - 1 AS j_index, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS bal_accuracy,
  (tp + fp) / n AS detection_prevalence, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f_meas"""
PE_SQL = """(SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM
  (SELECT *, tp + fp + fn + tn AS n FROM (SELECT type, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM c)))"""


@query(f"""WITH {JUDGED_SQL}, c AS (SELECT type, {CELLS_SQL} FROM j GROUP BY 1), w AS (SELECT type, {METRIC_SQL} FROM {PE_SQL})
SELECT type, metric, round(estimate, 8) AS estimate FROM (UNPIVOT w ON {', '.join('"' + m + '"' for m in M.METRICS)} INTO NAME metric VALUE estimate)""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.class_metrics(_judged(spark, sf_dir), "crms", "pred_21_simple", "fail", ["type"]), "estimate", digits=8)


@query(f"WITH {JUDGED_SQL} SELECT unit, type, crms, pred FROM j WHERE crms <> pred")
def misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.misclassified(_judged(spark, sf_dir), "crms", "pred_21_simple", ["unit", "type", "crms", "pred_21_simple"])
    return rows.withColumnRenamed("pred_21_simple", "pred")


@query()
def confusion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.matrix_statistics(_judged(spark, sf_dir), "crms", "pred_21_simple", "fail", ["type"])
    return M.tidy_statistics(stats, ["type"])


@query(f"""WITH {UNITS_SQL}, j AS (SELECT *, {PRED_17} AS pred FROM units WHERE ports_12m > 20), c AS (SELECT 'all' AS type, {CELLS_SQL} FROM j)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 8) AS no_information_rate,
  round((tp + fn) / (tp + fp + fn + tn), 8) AS prevalence, round(tp / (tp + fp + fn + tn), 8) AS detection_rate FROM c""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.validate_rules(units(spark, sf_dir), D.rules_2017, "crms", "pred_17", "fail", ref("ports_12m") > 20)
    rates = ["accuracy", "no_information_rate", "prevalence", "detection_rate"]
    return rounded(stats.select(*M.CELLS, *rates), *rates, digits=8)


def _measure_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_series(table(spark, sf_dir, "lineitem"), MEASURES, ["l_linestatus", "l_returnflag"])


def _roc_sql(source: str, by: str) -> str:
    """Distinct scores with running counts, then per-series totals."""
    return f"""d AS (SELECT {by}, value AS s, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM ({source}) GROUP BY {by}, s),
  c AS (SELECT *, sum(p) OVER (PARTITION BY {by}) AS pp, sum(n) OVER (PARTITION BY {by}) AS nn,
    sum(p) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM d),
  a AS (SELECT {by}, sum(n * (tp - p + p / 2)) / (max(pp)::DOUBLE * max(nn)::DOUBLE) AS auc, max(pp) AS pp, max(nn) AS nn FROM
    (SELECT *, n AS x FROM c) GROUP BY {by}),
  r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY tp * nn - fp * pp DESC) AS k, 1 - fp / nn AS spec, tp / pp AS sens FROM c)"""


LINE_SERIES = """SELECT name, l_returnflag, l_linestatus = 'F' AS hit, value FROM (UNPIVOT (SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)"""


@query(f"""WITH {SCORES_SQL}, {_roc_sql("SELECT 'all' AS name, quality = 1 AS hit, score AS value FROM scores", 'name')}
SELECT round(s, 8) AS threshold, round(spec, 8) AS specificity, round(sens, 8) AS sensitivity FROM
  (SELECT s, 1 - fp / nn + n / nn - n / nn AS spec, sens FROM r)""")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = R.roc_curve(scores(spark, sf_dir), "quality", "score", 1, ends=False)
    return rounded(curve, "threshold", "specificity", "sensitivity", digits=8)


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name')} SELECT name, s AS threshold, NULL::VARCHAR AS beyond, round(spec, 8) AS specificity, round(sens, 8) AS sensitivity FROM r
  UNION ALL SELECT name, NULL, 'low', 0, 1 FROM a UNION ALL SELECT name, NULL, 'high', 1, 0 FROM a""")
def roc_curve_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends at minus and plus infinity are shown by a label, as infinities do not compare well."""
    curve = R.roc_curve(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name"])
    infinite = F.abs("threshold") == float("inf")
    beyond = F.when(infinite, F.when(ref("threshold") > 0, "high").otherwise("low"))
    curve = curve.withColumn("beyond", beyond).withColumn("threshold", F.when(~infinite, ref("threshold")))
    return rounded(curve, "specificity", "sensitivity", digits=8)


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name')} SELECT name, round(auc, 8) AS auc, CAST(pp AS BIGINT) AS n_event, CAST(nn AS BIGINT) AS n_other FROM a""")
def auc_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auc(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name"]), "auc", digits=8)


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name, l_returnflag')} SELECT name, l_returnflag, round(auc, 8) AS auc, CAST(pp AS BIGINT) AS n_event, CAST(nn AS BIGINT) AS n_other FROM a""")
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.auc(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name", "l_returnflag"]), "auc", digits=8)


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name, l_returnflag')} SELECT name, l_returnflag, s AS threshold, round(spec, 8) AS specificity, round(sens, 8) AS sensitivity FROM r WHERE k = 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.best_threshold(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name", "l_returnflag"])
    return rounded(best, "specificity", "sensitivity", digits=8).select("name", "l_returnflag", "threshold", "specificity", "sensitivity")


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name')} SELECT r.name, round(auc, 6) AS auc, s AS threshold, round(spec, 6) AS specificity, round(sens, 6) AS sensitivity FROM r JOIN a ON r.name = a.name WHERE k = 1""")
def roc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.roc_summary(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name"])
    return rounded(out, "auc", "specificity", "sensitivity").select("name", "auc", "threshold", "specificity", "sensitivity")


@query(f"""WITH {UNITS_SQL}, {_roc_sql("SELECT 'mpi_c' AS name, crms = 'fail' AS hit, mpi_c::DOUBLE AS value FROM units", 'name')}
SELECT s AS threshold, round(spec, 8) AS specificity, round(sens, 8) AS sensitivity, round(auc, 8) AS auc FROM r CROSS JOIN (SELECT auc FROM a)""")
def ordinal_score_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir)
    curve = R.roc_curve(rows, "crms", "mpi_c", "fail", ends=False)
    area = R.auc(rows, "crms", "mpi_c", "fail").select("auc").scalar()
    return rounded(curve.withColumn("auc", area), "specificity", "sensitivity", "auc", digits=8)


def _signif_sql(x: str) -> str:
    power = f"(floor(log10(abs({x}))) - 1)"
    return f"round(CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / 10 ** {power}, 0) * 10 ** {power} END, 6)"


@query(f"""WITH {_roc_sql(LINE_SERIES, 'name, l_returnflag')}, e AS (SELECT *, (1 - sens) ** 2 + (1 - spec) ** 2 AS corner FROM r WHERE k = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY name, l_returnflag ORDER BY round(corner, 12) DESC, s) AS nth FROM e)
SELECT upper(substr(b.name, 3, 1)) || substr(b.name, 4) AS Predictor, b.name, b.l_returnflag, {_signif_sql('auc')} AS auc, {_signif_sql('s')} AS threshold,
  {_signif_sql('spec')} AS specificity, {_signif_sql('sens')} AS sensitivity FROM b JOIN a ON a.name = b.name AND a.l_returnflag = b.l_returnflag WHERE nth = 1""")
def roc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = R.roc_summary(_measure_series(spark, sf_dir), "l_linestatus", "value", "F", ["name", "l_returnflag"], tie="farthest", one_row=True)
    labels = spark.createDataFrame([(m, m.removeprefix("l_").capitalize()) for m in MEASURES], "name string, Predictor string")
    return rounded(R.report_table(summary, labels), "auc", "threshold", "specificity", "sensitivity")


SWEEP_SQL = f"""{SCORES_SQL}, g AS (SELECT k / 100.0::DOUBLE AS t FROM range(1, 100) x(k)),
m AS (SELECT lang, t, count(*) FILTER (quality = 1 AND score >= t) AS tp, count(*) FILTER (quality <> 1 AND score >= t) AS fp,
  count(*) FILTER (quality = 1 AND score < t) AS fn, count(*) FILTER (quality <> 1 AND score < t) AS tn FROM scores CROSS JOIN g GROUP BY 1, 2),
w AS (SELECT lang, t, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM m)"""


@query(f"""WITH {SWEEP_SQL} SELECT t AS threshold, round(avg(sens), 8) AS sens, round(avg(spec), 8) AS spec, round(avg(accuracy), 8) AS accuracy,
  round(avg(sens + spec - 1), 8) AS j_index, round(avg(sqrt((1 - sens) ** 2 + (1 - spec) ** 2)), 8) AS dist FROM w GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = M.threshold_sweep(scores(spark, sf_dir), "quality", "score", 1, ["lang"])
    kept = ["sens", "spec", "accuracy", "j_index", "dist"]
    return rounded(M.averaged_sweep(sweep, ["lang"]).select("threshold", *kept), *kept, digits=8)


@query(f"""WITH {SWEEP_SQL}, v AS (SELECT t, avg(sens + spec - 1) AS j FROM w GROUP BY 1)
SELECT lang, quality, count(*) AS n, count(*) FILTER (score > (SELECT min(t) FROM v WHERE j = (SELECT max(j) FROM v))) AS called FROM scores GROUP BY 1, 2""")
def sweep_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    sweep = M.averaged_sweep(M.threshold_sweep(rows, "quality", "score", 1, ["lang"]), ["lang"])
    best = M.sweep_best(sweep).agg(F.min("threshold")).scalar()
    return rows.groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.sum((ref("score") > best).cast("long")).alias("called")
    )


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 8) AS r FROM lineitem"
    for a in MEASURES for b in MEASURES
)


@query(CORR_SQL)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.corr_matrix(table(spark, sf_dir, "lineitem"), MEASURES), "r", digits=8)


@query()
def corr_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.corr_pvalues(table(spark, sf_dir, "lineitem"), MEASURES)


@query()
def drop_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    copy = li.withColumn("gross", ref("l_extendedprice") * (1 + ref("l_tax"))).withColumn("net", ref("l_extendedprice") * (1 - ref("l_discount")))
    gone = T.drop_correlated(copy, [*MEASURES, "gross", "net"], 0.8)
    return copy.drop(*gone)


ANOVA_LONG = """long AS (UNPIVOT (SELECT l_returnflag, l_linestatus, sqrt(l_quantity) AS l_quantity, sqrt(l_extendedprice) AS l_extendedprice, sqrt(l_discount) AS l_discount, sqrt(l_tax) AS l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure_series(spark, sf_dir).withColumn("value", F.sqrt("value"))


@query(f"""WITH {ANOVA_LONG}, g AS (SELECT name, l_returnflag, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2),
t AS (SELECT name, sum(n * m) / sum(n) AS mm FROM g GROUP BY 1), s AS (SELECT g.name, count(*) - 1 AS df_between, CAST(sum(n) AS BIGINT) - count(*) AS df_within,
  sum(n * (m - mm) ** 2) AS ssb, sum(n * v) AS ssw FROM g JOIN t ON g.name = t.name GROUP BY 1)
SELECT name, df_between, df_within, round(ssb, 4) AS ss_between, round(ssw, 2) AS ss_within, round((ssb / df_between) / (ssw / df_within), 6) AS f FROM s""")
def anova_one_way_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(T.anova_one_way(_roots(spark, sf_dir), "value", "l_returnflag", ["name"]), "f")
    out = rounded(rounded(out, "ss_between", digits=4), "ss_within", digits=2)
    return out.select("name", "df_between", "df_within", "ss_between", "ss_within", "f")


# With a two-level second factor the adjusted term has a closed form per first-factor level.
TWO_WAY_SQL = f"""{ANOVA_LONG}, c AS (SELECT name, l_returnflag AS a, l_linestatus AS b, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2, 3),
ca AS (SELECT name, a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1, 2), t AS (SELECT name, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
p AS (SELECT name, a, max(CASE WHEN b = 'F' THEN n END) AS n1, max(CASE WHEN b = 'O' THEN n END) AS n0, max(CASE WHEN b = 'F' THEN m END) AS m1, max(CASE WHEN b = 'O' THEN m END) AS m0 FROM c GROUP BY 1, 2),
s AS (SELECT t.name, (SELECT sum(ca.n * (ca.m - t.m) ** 2) FROM ca WHERE ca.name = t.name) AS s1,
  (SELECT sum(n1 * n0 / (n1 + n0) * (m1 - m0)) ** 2 / sum(n1 * n0 / (n1 + n0)) FROM p WHERE p.name = t.name) AS s2,
  (SELECT sum(c.n * (c.m - t.m) ** 2) FROM c WHERE c.name = t.name) AS sc, (SELECT sum(c.n * c.v) FROM c WHERE c.name = t.name) AS rest, t.n - 6 AS rdf FROM t)"""


@query(f"""WITH {TWO_WAY_SQL}
SELECT name, term, CAST(df AS BIGINT) AS df, round(sumsq, 3) AS sumsq, round(sumsq / df / (rest / rdf), 5) AS f FROM
 (SELECT name, 'l_returnflag' AS term, 2 AS df, s1 AS sumsq, rest, rdf FROM s UNION ALL SELECT name, 'l_linestatus', 1, s2, rest, rdf FROM s UNION ALL SELECT name, 'l_returnflag:l_linestatus', 2, sc - s1 - s2, rest, rdf FROM s)""")
def anova_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.anova_two_way(_roots(spark, sf_dir), "value", "l_returnflag", "l_linestatus", ["name"])
    out = rounded(rounded(out.where("term <> 'Residuals'"), "sumsq", digits=3), "f", digits=5)
    return out.select("name", "term", "df", "sumsq", "f")


@query(f"""WITH {TWO_WAY_SQL}
SELECT name, term, CAST(df AS BIGINT) AS df, round(sumsq, 3) AS sumsq, round(sumsq / df / ((rest + sc - s1 - s2) / (rdf + 2)), 5) AS f FROM
 (SELECT *, 'l_returnflag' AS term, 2 AS df, s1 AS sumsq FROM s UNION ALL SELECT *, 'l_linestatus', 1, s2 FROM s)""")
def anova_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.anova_two_way(_roots(spark, sf_dir), "value", "l_returnflag", "l_linestatus", ["name"], interaction=False)
    out = rounded(rounded(out.where("term <> 'Residuals'"), "sumsq", digits=3), "f", digits=5)
    return out.select("name", "term", "df", "sumsq", "f")


@query()
def anova_two_way_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.anova_two_way(_measure_series(spark, sf_dir), "value", "l_returnflag", "l_linestatus", ["name"])


@query(f"""WITH {JUDGED_SQL}, t AS (SELECT type, {CELLS_SQL} FROM j GROUP BY 1),
k AS (SELECT *, tp + fp AS rw, tp + fn AS cl, tp + fp + fn + tn AS tot FROM t),
x AS (SELECT *, unnest(range(greatest(0, rw + cl - tot), least(rw, cl) + 1)) AS i FROM k),
l AS (SELECT *, -(lgamma(i + 1) + lgamma(rw - i + 1) + lgamma(cl - i + 1) + lgamma(tot - rw - cl + i + 1)) AS lp FROM x),
o AS (SELECT *, max(lp) OVER (PARTITION BY type) AS top, max(CASE WHEN i = tp THEN lp END) OVER (PARTITION BY type) AS seen FROM l)
SELECT type, tp AS a, fp AS b, fn AS c, tn AS d, round(sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp - top) ELSE 0 END) / sum(exp(lp - top)), 6) AS p FROM o GROUP BY 1, 2, 3, 4, 5""")
def fisher_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return rounded(T.fisher_2x2(rows, ref("pred_21_simple") == "fail", ref("crms") == "fail", ["type"]), "p")


@query()
def fisher_rxc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fisher_rxc(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


PROFILE_SQL = f"""{DAY_SQL}, pa AS (SELECT {', '.join(f'(CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END) AS {t}' for t in TAXA)}, grp FROM sites),
v AS (SELECT concat_ws('|', {', '.join(f"CASE WHEN {t} > 0 THEN '1.0' ELSE '0.0' END" for t in TAXA)}) AS p, {', '.join(f'max({t}) AS {t}' for t in TAXA)}, count(*) AS n FROM pa GROUP BY 1),
d AS (SELECT a.p AS profile1, b.p AS profile2, a.n AS n1, b.n AS n2, {' + '.join(f'abs(a.{t} - b.{t})' for t in TAXA)} AS apart, {' + '.join(f'a.{t} + b.{t}' for t in TAXA)} AS whole FROM v a JOIN v b ON a.p < b.p)"""


def _pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence table: which taxa a user showed on a day."""
    return E.presence_table(day_sites(spark, sf_dir), TAXA)


def _distances(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return rounded(E.profile_distances(E.profiles(_pa(spark, sf_dir), TAXA), TAXA, metric), "d", digits=8)


@query(f"WITH {PROFILE_SQL} SELECT profile1, profile2, n1, n2, round(apart / whole, 8) AS d FROM d")
def bray_curtis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir, "bray")


@query(f"WITH {PROFILE_SQL} SELECT profile1, profile2, n1, n2, round(2 * (apart / whole) / (1 + apart / whole), 8) AS d FROM d")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir, "jaccard")


@query(f"WITH {PROFILE_SQL} SELECT profile1, profile2, n1, n2, round(sqrt(apart), 8) AS d FROM d")
def euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir, "euclid")


@query(f"""WITH {DAY_SQL}, m AS (SELECT grp, {', '.join(f'avg({t}) AS {t}' for t in TAXA)}, count(*) AS n_sites FROM sites GROUP BY 1)
SELECT a.grp AS profile1, b.grp AS profile2, a.n_sites AS n1, b.n_sites AS n2, round(({' + '.join(f'abs(a.{t} - b.{t})' for t in TAXA)}) / ({' + '.join(f'a.{t} + b.{t}' for t in TAXA)}), 8) AS d
FROM m a JOIN m b ON a.grp < b.grp""")
def bray_curtis_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = day_sites(spark, sf_dir)
    means = sites.groupBy("grp").agg(*[F.avg(t).alias(t) for t in TAXA], F.count(F.lit(1)).alias("n_sites"))
    return rounded(E.profile_distances(means, TAXA, "bray", ref("grp")), "d", digits=8)


# Written over all pairs of sites; the query itself goes over profiles.
@query(f"""WITH {DAY_SQL}, pa AS (SELECT user_id, grp, {', '.join(f'(CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END) AS {t}' for t in TAXA)} FROM sites),
y AS (SELECT a.grp AS g1, b.grp AS g2, {' + '.join(f'abs(a.{t} - b.{t})' for t in TAXA)} AS apart, {' + '.join(f'a.{t} + b.{t}' for t in TAXA)} AS whole FROM pa a JOIN pa b ON a.user_id < b.user_id),
z AS (SELECT g1, g2, CASE WHEN whole = 0 THEN 0 ELSE (apart / whole) ** 2 END AS q FROM y),
s AS (SELECT grp, count(*) AS n FROM pa GROUP BY 1), w AS (SELECT sum(x / n) AS ssw, sum(n) AS n, count(*) AS k FROM (SELECT g1, sum(q) AS x FROM z WHERE g1 = g2 GROUP BY 1) JOIN s ON g1 = grp),
t AS (SELECT k - 1 AS df_between, CAST(n AS BIGINT) - k AS df_within, ssw, (SELECT sum(q) FROM z) / n AS sst FROM w)
SELECT df_between, df_within, round(sst - ssw, 6) AS ss_between, round(ssw, 6) AS ss_within, round(sst, 6) AS ss_total, round((sst - ssw) / sst, 6) AS r2,
  round(((sst - ssw) / df_between) / (ssw / df_within), 6) AS f FROM t""")
def permanova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.permanova(_pa(spark, sf_dir), TAXA, "grp")
    return rounded(out, "ss_between", "ss_within", "ss_total", "r2", "f")


@query()
def permanova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _pa(spark, sf_dir).withColumn("half", F.concat(F.lit("h"), F.pmod(F.floor(ref("user_id") / 3), F.lit(2))))
    return E.permanova_terms(sites, TAXA, ["grp", "half"])


@query(f"""WITH {DAY_SQL}, pa AS (SELECT user_id, grp, {', '.join(f'(CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END) AS {t}' for t in TAXA)} FROM sites),
m AS (SELECT grp AS g, {', '.join(f'avg({t}) AS m_{t}' for t in TAXA)} FROM pa GROUP BY 1)
SELECT user_id, grp, round(sqrt({' + '.join(f'({t} - m_{t}) ** 2' for t in TAXA)}), 8) AS dist FROM pa JOIN m ON grp = g""")
def dispersion_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.centroid_distances(_pa(spark, sf_dir), TAXA, "grp"), "dist", digits=8).select("user_id", "grp", "dist")


@query(f"""WITH {DAY_SQL}, pa AS (SELECT user_id, grp, {', '.join(f'(CASE WHEN {t} > 0 THEN 1.0::DOUBLE ELSE {t} END) AS {t}' for t in TAXA)} FROM sites),
m AS (SELECT grp AS g, {', '.join(f'avg({t}) AS m_{t}' for t in TAXA)} FROM pa GROUP BY 1),
d AS (SELECT grp, sqrt({' + '.join(f'({t} - m_{t}) ** 2' for t in TAXA)}) AS dist FROM pa JOIN m ON grp = g),
c AS (SELECT grp, count(*) AS n, avg(dist) AS mean, var_pop(dist) AS v FROM d GROUP BY 1), t AS (SELECT sum(n * mean) / sum(n) AS mm FROM c),
s AS (SELECT count(*) - 1 AS df_between, CAST(sum(n) AS BIGINT) - count(*) AS df_within, sum(n * (mean - mm) ** 2) AS ssb, sum(n * v) AS ssw FROM c CROSS JOIN t)
SELECT df_between, df_within, round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, round(ssb / df_between / (ssw / df_within), 6) AS f FROM s""")
def dispersion_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.anova_one_way(E.centroid_distances(_pa(spark, sf_dir), TAXA, "grp"), "dist", "grp")
    return rounded(out.drop("ms_between", "ms_within"), "ss_between", "ss_within", "f")


@query()
def dispersion_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.functions.tails import f_tail_col

    table_ = T.anova_one_way(E.centroid_distances(_pa(spark, sf_dir), TAXA, "grp"), "dist", "grp")
    return table_.withColumn("p", f_tail_col("f", ref("df_between").cast("double"), ref("df_within").cast("double")))


@query(f"""WITH {SITE_SQL}, l AS (UNPIVOT sites ON {', '.join(TAXA)} INTO NAME taxon VALUE value), m AS (SELECT taxon, grp, avg(value) AS m, avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS b FROM l GROUP BY 1, 2)
SELECT taxon, grp, round(m / sum(m) OVER (PARTITION BY taxon), 8) AS a, round(b, 8) AS b, round(sqrt(m / sum(m) OVER (PARTITION BY taxon) * b), 8) AS stat FROM m""")
def indval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.indicator_values(site_table(spark, sf_dir), TAXA, "grp"), "a", "b", "stat", digits=8)


@query(f"""WITH {DAY_SQL}, m AS (SELECT grp AS g, median("view") AS m FROM sites GROUP BY 1)
SELECT grp, count(*) AS n, round(sum(abs("view" - m)) / count(*), 6) AS mean_dist FROM sites JOIN m ON grp = g GROUP BY 1""")
def dispersion_median_one_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one dimension the spatial median is the median; where it is not unique the mean distance still is."""
    rows = E.median_distances(day_sites(spark, sf_dir), ["view"], "grp")
    return rounded(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean_dist")), "mean_dist")


@query()
def dispersion_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread about spatial medians between groups, over all taxa."""
    return T.anova_one_way(E.median_distances(_pa(spark, sf_dir), TAXA, "grp"), "dist", "grp")


@query(f"""WITH {SITE_SQL}, l AS (UNPIVOT sites ON {', '.join(TAXA)} INTO NAME taxon VALUE value),
m AS (SELECT taxon, grp, avg(value) AS m, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM l GROUP BY 1, 2),
c AS (SELECT * FROM (VALUES ('g0'), ('g1'), ('g2'), ('g0+g1'), ('g0+g2'), ('g1+g2')) v(combination))
SELECT m.taxon, combination AS grp, round(sum(m) FILTER (contains(combination, m.grp)) / sum(m), 8) AS a,
  round(sum(hits) FILTER (contains(combination, m.grp)) / sum(n) FILTER (contains(combination, m.grp)), 8) AS b,
  round(sqrt(sum(m) FILTER (contains(combination, m.grp)) / sum(m) * sum(hits) FILTER (contains(combination, m.grp)) / sum(n) FILTER (contains(combination, m.grp))), 8) AS stat
FROM m CROSS JOIN c GROUP BY 1, 2""")
def indval_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.indicator_combinations(site_table(spark, sf_dir), TAXA, "grp"), "a", "b", "stat", digits=8)


@query()
def indval_combinations_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.indicator_test(site_table(spark, sf_dir), TAXA, ["user_id"], "grp", most=None)


@query()
def indval_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.indicator_test(site_table(spark, sf_dir), TAXA, ["user_id"], "grp")


@query()
def taxa_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ordination(site_table(spark, sf_dir), TAXA, ["user_id", "grp"])


@query(f"""WITH {SITE_SQL} SELECT grp, {', '.join(f'round(avg({t}), 6) AS {t}' for t in TAXA)} FROM sites GROUP BY 1""")
def range_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(unit_means(site_table(spark, sf_dir), ["grp"], TAXA, strict=False), *TAXA)
