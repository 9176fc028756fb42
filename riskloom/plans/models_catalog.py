"""Queries: resampling and models. Rows only; results depend on random draws fixed by a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.operators import models as L
from riskloom.operators import resample as S
from riskloom.operators.boost import Boost, ManyBoosts
from riskloom.operators.roc import auc
from riskloom.plans.registry import UNITS_SQL, query, rounded, table, units

PREDICTORS = ["time_since_af", "ports_12m", "av_speed", "quantity", "late_days"]
KEY = ["unit"]


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with features of their lines; outcome and type as in the rule sets."""
    lines = table(spark, sf_dir, "lineitem").groupBy(ref("l_orderkey").alias("unit")).agg(
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double").alias("late_days"),
        F.count(F.lit(1)).cast("double").alias("lines"),
    )
    return units(spark, sf_dir).join(lines, "unit")


@query("""SELECT repeat, count(*) AS n, count(DISTINCT o_orderkey) AS units FROM orders CROSS JOIN range(1, 4) r(repeat) GROUP BY 1""")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = S.cv_folds(table(spark, sf_dir, "orders"), ["o_orderkey"])
    whole = placed.where(ref("fold").between(0, 4)).groupBy(ref("repeat").cast("long").alias("repeat"))
    return whole.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("units"))


@query()
def yeo_johnson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).select("unit", *PREDICTORS)
    return S.learn_scaling(rows, PREDICTORS, suffix="_t").transform(rows)


@query()
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).select("unit", "crms", *PREDICTORS)
    return S.smote(rows, "crms", "fail", PREDICTORS, KEY).groupBy("crms").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in PREDICTORS]
    )


@query()
def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).withColumn("time_since_af", F.when(ref("ports_12m") >= 5, ref("time_since_af")))
    return S.impute_trees(rows, PREDICTORS, ["type"]).select("unit", *PREDICTORS)


@query("""WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) FILTER (c_acctbal >= 0) AS med FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE round(med, 6) END AS c_acctbal FROM customer CROSS JOIN m""")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.when(ref("c_acctbal") >= 0, ref("c_acctbal")).alias("c_acctbal"))
    return rounded(S.impute_median(cust, ["c_acctbal"]), "c_acctbal")


def _cv(rows: DataFrame, fit) -> DataFrame:
    return L.cross_validate(rows, KEY, "crms", "fail", PREDICTORS, fit)


def _recipe(fitter, predictors=PREDICTORS, **settings) -> L.Recipe:
    return L.Recipe(fitter, "crms", "fail", predictors, settings)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_rows(spark, sf_dir).select("unit", "crms", "type", *PREDICTORS)


@query()
def glm_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _cv(_rows(spark, sf_dir), _recipe(L.fit_logistic, scale=True))
    return L.resample_metrics(scored, "fail")


@query()
def rf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _cv(_rows(spark, sf_dir), _recipe(L.fit_forest, trees=20, mtry=2, depth=5))
    return L.resample_metrics(scored, "fail")


@query()
def gbt_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _cv(_rows(spark, sf_dir), _recipe(L.fit_boosted, trees=10, depth=2))
    return L.resample_metrics(scored, "fail")


@query()
def gbt_subsampled_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _cv(
        _rows(spark, sf_dir),
        _recipe(L.fit_boosted, trees=10, depth=2, shrinkage=0.3, min_node=1, subsample=0.75),
    )
    return L.resample_metrics(scored, "fail")


@query(f"""WITH {UNITS_SQL}, s AS (SELECT laid_up_more_10d AS x, sum(CASE WHEN crms = 'fail' THEN -0.5 ELSE 0.5 END) AS g, 0.25 * count(*) AS h FROM units GROUP BY 1)
SELECT x, round(-g / (h + 1), 8) AS leaf FROM s""")
def second_order_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree on one 0/1 predictor: a leaf is the sum of gradients over curvature and penalty."""
    rows = units(spark, sf_dir).select("unit", "laid_up_more_10d", (ref("crms") == "fail").cast("double").alias("y"))
    work = ManyBoosts(rows, ref("y"), ["laid_up_more_10d"], KEY)
    tree = work.fit([Boost(depth=1, min_gain=float("-inf"))], 1)[0].trees[0]  # split also where the penalty takes all gain
    return rounded(spark.createDataFrame([(0, float(tree.value[1])), (1, float(tree.value[2]))], "x int, leaf double"), "leaf", digits=8)


@query()
def extreme_boosting_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order boosting with row and column sampling: 15 resamples side by side, scored after 50, 100 and 150 trees of one fit each."""
    rows = _rows(spark, sf_dir).withColumn("y", (ref("crms") == "fail").cast("double"))
    work = ManyBoosts(rows, ref("y"), PREDICTORS, KEY, [S.fold_of(KEY, 5, r, 1234567) for r in (1, 2, 3)])
    models = [Boost(depth=1, shrinkage=0.3, row_share=0.75, column_share=0.6, repeat=r, fold=f, seed=1 + 5 * r + f) for r in range(3) for f in range(5)]
    scored = work.staged(work.fit(models, 150), [50, 100, 150])
    cells = scored.groupBy("stage").agg(F.sum("n").alias("n"), F.sum(F.when(ref("obs") == ref("call"), ref("n"))).alias("right"), F.sum("loss").alias("loss"))
    return cells.select("stage", "n", (ref("right") / ref("n")).alias("accuracy"), (ref("loss") / ref("n")).alias("log_loss"))


@query()
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    two = ["time_since_af", "av_speed"]
    fits = {
        "full": _recipe(L.fit_logistic, scale=True),
        "two": _recipe(L.fit_logistic, two, scale=True),
    }
    scored = L.cross_validate_each(rows, KEY, "crms", "fail", PREDICTORS, fits)
    return L.compare_models({name: L.resample_metrics(part, "fail") for name, part in scored.items()})


@query()
def tuned_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests of 1000 trees of depth 30 at each point of the grid, in five folds and three repeats."""
    found = L.tune(_rows(spark, sf_dir), KEY, "crms", "fail", PREDICTORS, L.fit_forest, L.FOREST_GRID)
    return found.where(ref("point") == L.pick_within_tolerance(found))


def _full(spark: SparkSession, sf_dir: str) -> tuple[L.Fitted, DataFrame]:
    rows = _rows(spark, sf_dir)
    return L.fit_logistic(rows, "crms", "fail", ["time_since_af", "av_speed", "type"]), rows


@query()
def glm_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coefficients(_full(spark, sf_dir)[0], spark, odds=True)


@query()
def glm_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _full(spark, sf_dir)
    return L.dispersion(model.score(rows), "crms", "fail", len(model.names) + 1)


@query()
def var_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.variable_importance(_full(spark, sf_dir)[0], spark)


@query()
def step_aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.step_aic(_rows(spark, sf_dir), "crms", "fail", ["time_since_af", "av_speed", "ports_12m", "type"])[1]


@query()
def rfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.feature_elimination(_rows(spark, sf_dir), KEY, "crms", "fail", PREDICTORS, range(1, 6))


@query()
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _full(spark, sf_dir)
    return L.partial_dependence(model, rows, "time_since_af", points=250)


@query()
def predict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _full(spark, sf_dir)
    return L.predict_table(model, rows, "fail", "pass", best=0.33).select("unit", "crms", "p_event", "p_other", "pred", "adj_pred")


@query()
def resample_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _cv(_rows(spark, sf_dir), _recipe(L.fit_logistic, ["time_since_af", "av_speed"], scale=True))
    return auc(scored, "obs", L.P, "fail", ["repeat", "fold"])
