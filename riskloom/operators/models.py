"""Fitting, selecting and explaining classifiers with MLlib. Every model predicts P(event)."""

from __future__ import annotations

import inspect
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskloom.functions.columns import ref
from riskloom.operators.confusion import confusion, with_metrics
from riskloom.operators.newton import Candidate, ManyFits, ResampledFits
from riskloom.operators.profile import group_min_med_max
from riskloom.operators.resample import Resample, Scaling, factor_levels, fold_of, learn_scaling, scalings, smote, smote_resamples
from riskloom.operators.roc import auc
from riskloom.operators.trees import Boosted, Forest, Trees, bag, binnings, boost, forest_votes, shallow, training_blocks
from riskloom.sources.tables import drop_settled, settled

LABEL, P = "_label", "p_event"


def with_label(df: DataFrame, truth: str, event: object) -> DataFrame:
    return df.withColumn(LABEL, (ref(truth) == F.lit(event)).cast("double")).where(ref(LABEL).isNotNull())


@dataclass
class Design:
    """Numeric columns behind each model term: a factor is 0/1 columns, first level as base."""

    terms: dict[str, list[str]]
    stage: SQLTransformer

    def columns(self, terms: Sequence[str] | None = None) -> list[str]:
        return [c for t in (terms or self.terms) for c in self.terms[t]]


def design(df: DataFrame, predictors: Sequence[str]) -> Design:
    kinds = dict(df.dtypes)
    terms: dict[str, list[str]] = {}
    made = []
    for name in predictors:
        if kinds[name] == "string":
            terms[name] = []
            for i, level in enumerate(factor_levels(df, name)[1:]):
                terms[name].append(f"{name}_{level}")
                quoted = level.replace("\\", "\\\\").replace("'", "\\'")
                made.append(f"CAST(`{name}` = '{quoted}' AS DOUBLE) AS `{name}_{level}`")
        else:
            terms[name] = [f"{name}_x"]
            made.append(f"CAST(`{name}` AS DOUBLE) AS `{name}_x`")
    return Design(terms, SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"))


def linear_score(model: GeneralizedLinearRegressionModel | Linear, columns: Sequence[str], without: str | None = None) -> Column:
    """The linear predictor of a generalised linear model, less the part of one column."""
    eta = F.lit(float(model.intercept))
    for c, b in zip(columns, model.coefficients):
        if c != without:
            eta = eta + F.lit(float(b)) * ref(c)
    return eta


@dataclass
class Fitted:
    """A fitted pipeline with its coefficient names (empty for trees)."""

    pipeline: PipelineModel
    names: list[str]

    def score(self, df: DataFrame, out: str = P) -> DataFrame:
        """Add P(event); rows with a missing predictor get null."""
        *made, packer, model = self.pipeline.stages
        needed = list(packer.getInputCols())
        ready = PipelineModel(made).transform(df)
        if isinstance(model, GeneralizedLinearRegressionModel):
            return _logistic(ready, linear_score(model, needed), df.columns, out)
        gap = F.lit(False)
        for c in needed:
            gap = gap | ref(c).isNull()
        filled = ready.withColumn("_gap", gap).na.fill(0.0, subset=needed)
        scored = PipelineModel([packer, model]).transform(filled)
        value = F.when(~ref("_gap"), vector_to_array("probability")[1])
        return scored.withColumn("_score", value).select(*[ref(c) for c in df.columns], ref("_score").alias(out))

    @property
    def summary(self):
        return self.pipeline.stages[-1].summary


def _logistic(ready: DataFrame, eta: Column, columns: Sequence[str], out: str) -> DataFrame:
    """As a plain expression the score stays in generated code, without a vector per row."""
    return ready.withColumn("_score", 1 / (1 + F.exp(-eta))).select(*[ref(c) for c in columns], ref("_score").alias(out))


@dataclass
class Linear:
    """A logistic model on numeric columns as its coefficients, behind the stages that make them."""

    stages: list[SQLTransformer]
    names: list[str]
    intercept: float
    coefficients: list[float]

    def score(self, df: DataFrame, out: str = P) -> DataFrame:
        """Add P(event); rows with a missing predictor get null."""
        return _logistic(PipelineModel(self.stages).transform(df), linear_score(self, self.names), df.columns, out)


def _scaler(scaling: Scaling, columns: Sequence[str]) -> SQLTransformer:
    return scaling.stage(columns, given=lambda c: c.removesuffix("_x"))


def _fit(train: DataFrame, predictors: Sequence[str], estimator, scale: bool, scaling: Scaling | None = None) -> Fitted:
    """``scaling``: what is already known of the numeric predictors; learnt where it is needed and not given."""
    plan = design(train, predictors)
    ready = plan.stage.transform(train).na.drop(subset=plan.columns())
    stages = [plan.stage]
    if scale:
        stages.append(_scaler(scaling, plan.columns()) if scaling else learn_scaling(ready, plan.columns()))
        ready = stages[-1].transform(ready)
    stages.append(VectorAssembler(inputCols=plan.columns(), outputCol="_x"))
    # Fits pass over the rows many times.
    packed = stages[-1].transform(ready).select(LABEL, "_x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = estimator.fit(packed)
    finally:
        packed.unpersist()
    return Fitted(PipelineModel([*stages, model]), plan.columns())


def _glm(max_iter: int = 25) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol=LABEL, maxIter=max_iter, tol=1e-8
    )


def fit_logistic(df: DataFrame, truth: str, event: object, predictors: Sequence[str], scale: bool = False, scaling: Scaling | None = None) -> Fitted:
    return _fit(with_label(df, truth, event), predictors, _glm(), scale, scaling)


def fit_forest(
    df: DataFrame, truth: str, event: object, predictors: Sequence[str],
    trees: int = 1000, mtry: int = 2, depth: int = 30, scale: bool = True, seed: int = 1, scaling: Scaling | None = None,
) -> Fitted:
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=LABEL, numTrees=trees, featureSubsetStrategy=str(mtry), maxDepth=depth, seed=seed
    )
    return _fit(with_label(df, truth, event), predictors, forest, scale, scaling)


def fit_boosted(
    df: DataFrame, truth: str, event: object, predictors: Sequence[str],
    trees: int = 100, depth: int = 1, shrinkage: float = 0.1, min_node: int = 10, scale: bool = True, seed: int = 1,
    subsample: float = 1.0, scaling: Scaling | None = None,
) -> Fitted:
    boosted = GBTClassifier(
        featuresCol="_x", labelCol=LABEL, maxIter=trees, maxDepth=depth, stepSize=shrinkage,
        minInstancesPerNode=min_node, subsamplingRate=subsample, seed=seed,
    )
    return _fit(with_label(df, truth, event), predictors, boosted, scale, scaling)


# Tuning grids of the candidate models.
FOREST_GRID = [{"mtry": m} for m in (2, 5)]
BOOSTED_GRID = [{"trees": t, "depth": d, "shrinkage": 0.1, "min_node": 10} for d in (1, 2, 3) for t in (100, 500, 1000)]
EXTREME_GRID = [
    {"trees": t, "depth": d, "shrinkage": s, "min_node": 1, "subsample": u}
    for d in (1, 2, 3) for s in (0.3, 0.4) for u in (0.5, 0.75, 1.0) for t in (50, 100, 150)
]


def job_seed(seed: int, repeat: int, fold: int) -> int:
    """A seed of its own for every resample."""
    return zlib.crc32(f"{seed}:{repeat}:{fold}".encode())


@dataclass(frozen=True)
class Recipe:
    """One of the ``fit_`` functions with all but the rows. Resampling knows what it does, and so can share passes between training parts."""

    fitter: Callable[..., Fitted]
    truth: str
    event: object
    predictors: Sequence[str]
    settings: Mapping[str, object]

    def __call__(self, train: DataFrame, **known) -> Fitted:
        return self.fitter(train, self.truth, self.event, self.predictors, **self.settings, **known)

    @property
    def scales(self) -> bool:
        """Whether it learns a scaling, and takes one that is known."""
        takes = inspect.signature(self.fitter).parameters
        return "scaling" in takes and bool(self.settings.get("scale", takes["scale"].default))

    @property
    def filled(self) -> dict[str, object]:
        """The settings, and the fitter's own where they name none."""
        return {n: p.default for n, p in inspect.signature(self.fitter).parameters.items() if p.default is not p.empty} | dict(self.settings)


def cross_validate(
    df: DataFrame, key: Sequence[str], truth: str, event: object, predictors: Sequence[str], fit: Callable[[DataFrame], Fitted],
    folds: int = 5, repeats: int = 3, oversample: bool = True, seed: int = 1234567, parallelism: int = 5,
) -> DataFrame:
    """Out-of-fold predictions (repeat, fold, key, obs, p_event) of one model (see :func:`cross_validate_each`)."""
    return cross_validate_each(df, key, truth, event, predictors, {"": fit}, folds, repeats, oversample, seed, parallelism)[""]


def cross_validate_each(
    df: DataFrame,
    key: Sequence[str],
    truth: str,
    event: object,
    predictors: Sequence[str],
    fits: Mapping[object, Callable[[DataFrame], Fitted]],
    folds: int = 5,
    repeats: int = 3,
    oversample: bool = True,
    seed: int = 1234567,
    parallelism: int = 5,
) -> dict[object, DataFrame]:
    """For each model its out-of-fold predictions (repeat, fold, key, obs, p_event), all on the same training parts.

    In every training part the rarer class is oversampled first; transforms and model are then
    learnt on it. Held-out rows are never oversampled. Training parts are made once for all models, their neighbours and scalings in
    common passes; recipes on numeric predictors are fitted in common passes, too, or forests in tasks of their own, other fits run side by side.
    The predictions are computed once and stored; the training parts are deleted then.
    """
    kinds = dict(df.dtypes)
    numeric = [c for c in predictors if kinds[c] != "string"]
    used = df.select(*[ref(c) for c in dict.fromkeys([*key, truth, *predictors])]).where(ref(truth).isNotNull())
    resamples = [Resample(r, f, job_seed(seed, r, f)) for r in range(1, repeats + 1) for f in range(folds)]
    spark = df.sparkSession  # rows in as many files as tasks may read side by side
    spread = used.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    held = settled(spread.withColumns({f"_f{r}": fold_of(key, folds, r, seed) for r in range(1, repeats + 1)}))
    plain = {name: fit for name, fit in fits.items() if oversample and isinstance(fit, Recipe) and set(fit.predictors) <= set(numeric) and len(numeric) == len(predictors)}
    rows = held.withColumn("_job", F.lit(None).cast("int"))
    try:
        if oversample:
            counts = held.agg(F.count_if(ref(truth) == F.lit(event)).alias("e"), F.count(F.lit(1)).alias("n")).first()
            event_rare = counts["e"] * 2 <= counts["n"]
            marked = held.withColumn("_rare", (ref(truth) == F.lit(event)) == F.lit(event_rare)).na.drop(subset=numeric)
            typed = marked.select(*[ref(c).cast("double").alias(c) if c in set(numeric) else ref(c) for c in marked.columns])
            # fits in common passes need no more of the new rows than these columns
            made = smote_resamples(marked, "_rare", True, numeric, key, resamples, keep=[truth] if len(plain) == len(fits) else used.columns)
            rows = typed.withColumn("_job", F.lit(None).cast("int")).drop("_rare").unionByName(made, allowMissingColumns=True)

        columns = [c for c in numeric if any(c in fit.predictors for fit in plain.values() if fit.scales)]
        known = scalings(rows, columns, resamples, folds) if columns else [None] * len(resamples)
        models: dict[tuple[object, int], Fitted | Linear | Trees] = {}
        for scaled in (True, False):
            together = {n: f for n, f in plain.items() if f.fitter is fit_logistic and (f.truth, f.event) == (truth, event) and f.scales == scaled}
            models |= _fit_together(rows, together, resamples, known if scaled else [None] * len(resamples))
        grown, voted = _trees_together(rows, held, {n: f for n, f in plain.items() if f.fitter in (fit_forest, fit_boosted) and (f.truth, f.event) == (truth, event)}, resamples, known)
        models |= grown

        def one(work: tuple[object, int]) -> Fitted:
            name, job = work
            train = rows.where((ref("_job") == job) | (ref("_job").isNull() & resamples[job].trained)).drop("_job", *[f"_f{r}" for r in range(1, repeats + 1)])
            return fits[name](train, scaling=known[job]) if name in plain and fits[name].scales else fits[name](train)

        left = [(name, job) for job in range(len(resamples)) for name in fits if (name, job) not in models and name not in voted]
        with ThreadPool(max(1, min(parallelism, len(left)))) as pool:
            models |= dict(zip(left, pool.map(one, left, chunksize=1)))

        def predicted(name: object) -> DataFrame:
            if name in voted:
                return settled(voted[name].select("repeat", "fold", *[ref(c) for c in key], ref(truth).alias("obs"), ref(P)))
            out = None
            for job, resample in enumerate(resamples):
                part = models[name, job].score(held.where(~resample.trained)).select(
                    F.lit(resample.repeat).alias("repeat"), F.lit(resample.fold).alias("fold"), *[ref(c) for c in key], ref(truth).alias("obs"), ref(P)
                )
                out = part if out is None else out.unionByName(part)
            return settled(out)

        return {name: predicted(name) for name in fits}
    finally:
        drop_settled(rows, held)


def _fit_together(rows: DataFrame, recipes: Mapping[object, Recipe], resamples: Sequence[Resample], known: Sequence[Scaling | None]) -> dict[tuple[object, int], Linear]:
    """Logistic models on numeric predictors for all resamples: Newton steps in common passes."""
    if not recipes:
        return {}
    columns = list(dict.fromkeys(c for fit in recipes.values() for c in fit.predictors))
    first = next(iter(recipes.values()))
    scaled = [k or Scaling({}, {c: (0.0, 1.0) for c in columns}) for k in known]
    work = ResampledFits(rows, ref(first.truth) == F.lit(first.event), columns, resamples, scaled)
    asked = {(name, job): Candidate([columns.index(c) for c in fit.predictors], job) for name, fit in recipes.items() for job in range(len(resamples))}
    work.fit(list(asked.values()))
    out = {}
    for (name, job), a in asked.items():
        plan = design(rows, recipes[name].predictors)
        stages = [plan.stage, *([_scaler(known[job], plan.columns())] if known[job] else [])]
        out[name, job] = Linear(stages, plan.columns(), float(a.beta[0]), [float(b) for b in a.beta[1:]])
    return out


def _trees_together(
    rows: DataFrame, held: DataFrame, recipes: Mapping[object, Recipe], resamples: Sequence[Resample], known: Sequence[Scaling | None]
) -> tuple[dict[tuple[object, int], Trees], dict[object, DataFrame]]:
    """Models of boosted and shallow bagged recipes on numeric predictors, grown in common passes; of deep forests the rows left out with repeat, fold and P(event)."""
    models, voted = {}, {}
    for columns, scaled in dict.fromkeys((tuple(f.predictors), f.scales) for f in recipes.values()):
        mine = {n: f for n, f in recipes.items() if (tuple(f.predictors), f.scales) == (columns, scaled)}
        label = (ref(next(iter(mine.values())).truth) == F.lit(next(iter(mine.values())).event)).cast("double")
        parts = binnings(rows, columns, resamples, known if scaled else [None] * len(resamples))
        blocks = training_blocks(rows, label, resamples, parts)
        forests = {n: Forest(**{k: f.filled[k] for k in ("trees", "mtry", "depth", "seed")}) for n, f in mine.items() if f.fitter is fit_forest}
        deep = {n: f for n, f in forests.items() if not shallow(f, len(columns), len(resamples))}
        if len(deep) < len(mine):
            stored = settled(blocks)
        for name, recipe in mine.items():
            s = recipe.filled
            if name in deep:
                continue
            made = {j: Boosted(parts[j], s["depth"], shrinkage=s["shrinkage"]) if name not in forests else Trees(parts[j], s["depth"]) for j in range(len(resamples))}
            if name in forests:
                bag(stored, made, forests[name], resamples)
            else:
                boost(stored, made, s["trees"], s["min_node"], s["subsample"], s["seed"])
            models |= {(name, j): m for j, m in made.items()}
        if len(deep) < len(mine):
            drop_settled(stored)
        if deep:
            placed = settled(held.withColumn("_id", F.monotonically_increasing_id()))
            votes = settled(forest_votes(placed, blocks, resamples, parts, list(deep.values())))
            asked = placed.withColumn("job", F.explode(F.array(*[F.when(~r.trained, F.lit(j)) for j, r in enumerate(resamples)]))).where("job IS NOT NULL")
            at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), ref("job"))
            asked = asked.withColumns({"repeat": at([r.repeat for r in resamples]), "fold": at([r.fold for r in resamples])})
            for i, name in enumerate(deep):
                chances = votes.where(ref("forest") == i).select("job", ref("id").alias("_id"), ref("p").alias(P))
                voted[name] = asked.join(chances, ["job", "_id"], "left")
    return models, voted


def oversampled(df: DataFrame, key: Sequence[str], truth: str, event: object, predictors: Sequence[str], seed: int = 1234567) -> DataFrame:
    """The whole table as the final fit of a resampled model takes it: the rarer class oversampled, as in each training part."""
    kinds = dict(df.dtypes)
    numeric = [c for c in predictors if kinds[c] != "string"]
    used = df.select(*[ref(c) for c in dict.fromkeys([*key, truth, *predictors])]).where(ref(truth).isNotNull())
    counts = used.agg(F.count_if(ref(truth) == F.lit(event)).alias("e"), F.count(F.lit(1)).alias("n")).first()
    event_rare = counts["e"] * 2 <= counts["n"]
    marked = used.withColumn("_rare", (ref(truth) == F.lit(event)) == F.lit(event_rare)).na.drop(subset=numeric)
    return smote(marked, "_rare", True, numeric, key, seed=job_seed(seed, 0, 0)).drop("_rare")


def averaged_cells(called: DataFrame, truth: str, estimate: str, by: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """(truth, estimate, n, percent): cells of the confusion matrix averaged over resamples, as counts and as shares of each resample."""
    known = called.where(ref(truth).isNotNull() & ref(estimate).isNotNull())
    cells = known.groupBy(*[ref(c) for c in by], truth, estimate).agg(F.count(F.lit(1)).alias("_n"))
    sizes = known.groupBy(*[ref(c) for c in by]).agg(F.count(F.lit(1)).alias("_all"))
    resamples = sizes.agg(F.count(F.lit(1)).alias("_k"))
    summed = cells.join(sizes, list(by)).groupBy(truth, estimate).agg(F.sum("_n").alias("_n"), F.sum(ref("_n") / ref("_all")).alias("_share"))
    return summed.crossJoin(resamples).select(
        ref(truth).alias("truth"), ref(estimate).alias("estimate"), (ref("_n") / ref("_k")).alias("n"), (ref("_share") / ref("_k") * 100).alias("percent")
    )


def resample_metrics(predictions: DataFrame, event: object, by: Sequence[str] = ("repeat", "fold"), cut: float = 0.5) -> DataFrame:
    """ROC (area), Sens, Spec, accuracy and kappa per resample."""
    called = predictions.withColumn("_call", F.when(ref(P) > cut, F.lit(event)).when(ref(P) <= cut, F.lit("not_event")))
    cells = with_metrics(confusion(called, "obs", "_call", event, by))
    area = auc(predictions, "obs", P, event, by).select(*[ref(c) for c in by], ref("auc").alias("ROC"))
    return area.join(cells, list(by)).select(
        *[ref(c) for c in by], "ROC", ref("sens").alias("Sens"), ref("spec").alias("Spec"), ref("accuracy").alias("Accuracy"), ref("kap").alias("Kappa")
    )


def tune(
    df: DataFrame, key: Sequence[str], truth: str, event: object, predictors: Sequence[str],
    fitter: Callable[..., Fitted], grid: Sequence[Mapping], **cv,
) -> DataFrame:
    """Resample metrics of every grid point (``point`` is its position, simplest first)."""
    fits = {i: Recipe(fitter, truth, event, predictors, settings) for i, settings in enumerate(grid)}
    out = None
    for i, scored in cross_validate_each(df, key, truth, event, predictors, fits, **cv).items():
        part = resample_metrics(scored, event).withColumn("point", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return settled(out)  # a few rows, read for the choice and again for the chosen


def pick_within_tolerance(results: DataFrame, metric: str = "ROC", percent: float = 2.0) -> int:
    """First (simplest) grid point whose mean is within ``percent`` of the best."""
    means = results.groupBy("point").agg(F.avg(ref(metric)).alias("m")).orderBy("point").collect()
    best = max(r["m"] for r in means)
    return next(r["point"] for r in means if (best - r["m"]) / best * 100 <= percent)


def compare_models(results: Mapping[str, DataFrame], metrics: Sequence[str] = ("ROC", "Sens", "Spec")) -> DataFrame:
    """mean, median, min and max per model and metric over shared resamples."""
    out = None
    for model, table in results.items():
        part = table.select(F.lit(model).alias("model"), *[ref(m) for m in metrics])
        out = part if out is None else out.unionByName(part)
    long = settled(out).unpivot(["model"], list(metrics), "metric", "value")  # a few rows, read several times
    means = long.groupBy("model", "metric").agg(F.avg("value").alias("mean"))
    return means.join(group_min_med_max(long, ["model", "metric"], "value"), ["model", "metric"]).orderBy("metric", "model")


def coefficients(fitted: Fitted, spark, odds: bool = False) -> DataFrame:
    """term, estimate (or odds ratio), se, z, conf_low, conf_high, p of a logistic model."""
    model, s = fitted.pipeline.stages[-1], fitted.summary
    # The summary lists the intercept last.
    names = [*fitted.names, "(Intercept)"]
    values = [*[float(v) for v in model.coefficients], float(model.intercept)]
    rows = [
        (i, n, b, se, b / se if se else None, p)
        for i, (n, b, se, p) in enumerate(zip(names, values, s.coefficientStandardErrors, s.pValues))
    ]
    table = spark.createDataFrame(rows, "ord int, term string, estimate double, se double, z double, p double")
    table = table.withColumns({"conf_low": ref("estimate") - 1.96 * ref("se"), "conf_high": ref("estimate") + 1.96 * ref("se")})
    if odds:
        table = table.withColumns({c: F.exp(ref(c)) for c in ("estimate", "conf_low", "conf_high")})
    return table


def variable_importance(fitted: Fitted, spark) -> DataFrame:
    """Absolute z per term, largest first."""
    table = coefficients(fitted, spark).where(ref("term") != "(Intercept)")
    return table.select("term", F.abs("z").alias("importance")).orderBy(F.desc_nulls_last("importance"))


def dispersion(scored: DataFrame, truth: str, event: object, parameters: int, p: str = P) -> DataFrame:
    """Pearson dispersion of a fitted binomial model; about 1 when the model holds."""
    y = (ref(truth) == F.lit(event)).cast("double")
    spread = ref(p) * (1 - ref(p))
    # A probability of exactly 0 or 1 adds nothing when it is right and no finite amount when not.
    part = F.when(spread > 0, F.pow(y - ref(p), 2) / F.nullif(spread, F.lit(0.0))).when(y == ref(p), F.lit(0.0)).otherwise(F.lit(float("inf")))
    rows = scored.where(ref(p).isNotNull() & y.isNotNull())
    return rows.agg(F.sum(part).alias("pearson"), (F.count(F.lit(1)) - parameters).alias("df")).withColumn(
        "ratio", ref("pearson") / F.nullif(ref("df"), F.lit(0))
    )


class _Terms:
    """Term sets as candidates over one prepared frame: all fits of a round are Newton steps in common passes."""

    def __init__(self, df: DataFrame, truth: str, event: object, predictors: Sequence[str], folds: Sequence[Column] = ()):
        self.plan = design(df, predictors)
        ready = self.plan.stage.transform(with_label(df, truth, event)).na.drop(subset=self.plan.columns())
        self.columns = self.plan.columns()
        self.fits = ManyFits(ready, ref(LABEL), self.columns, folds)

    def candidate(self, terms: Sequence[str], repeat: int = -1, fold: int = -1) -> Candidate:
        return Candidate([self.columns.index(c) for t in terms for c in self.plan.terms[t]], repeat, fold)


def step_aic(df: DataFrame, truth: str, event: object, predictors: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Backward selection by AIC: (terms kept, path of (step, dropped, aic)).

    All models use the rows complete in the starting predictors. A factor goes as one term. The models of a round, one
    for each term that may go, are fitted together.
    """
    work = _Terms(df, truth, event, predictors)
    try:
        terms = list(predictors)
        current = work.fits.fit([work.candidate(terms)])[0].aic
        path = [(0, None, current)]
        while terms:
            tried = work.fits.fit([work.candidate([x for x in terms if x != t]) for t in terms])
            best, drop = min((c.aic, t) for c, t in zip(tried, terms))
            if best >= current:
                break
            terms.remove(drop)
            current = best
            path.append((len(path), drop, current))
    finally:
        work.fits.close()
    return terms, df.sparkSession.createDataFrame([(i, t, float(a)) for i, t, a in path], "step int, dropped string, aic double")


def feature_elimination(
    df: DataFrame, key: Sequence[str], truth: str, event: object, predictors: Sequence[str],
    sizes: Sequence[int], folds: int = 5, repeats: int = 1, seed: int = 1234567,
) -> DataFrame:
    """Accuracy and kappa per number of predictors, averaged over folds: (size, accuracy, kappa).

    Per fold all predictors are fitted once and ranked by absolute z; each size then takes the top
    ones. The full set is always one of the sizes. All folds are fitted together, then all sizes of all folds, and
    one more pass counts the calls on the rows left out.
    """
    wanted = sorted({*[s for s in sizes if s <= len(predictors)], len(predictors)})
    work = _Terms(df, truth, event, predictors, [fold_of(key, folds, r, seed) for r in range(1, repeats + 1)])
    try:
        jobs = [(r, f) for r in range(repeats) for f in range(folds)]
        full = work.fits.fit([work.candidate(predictors, r, f) for r, f in jobs])
        asked, names = [], []
        for (r, f), model in zip(jobs, full):
            strength = dict(zip(work.columns, np.abs(model.z)))
            ranked = sorted(predictors, key=lambda t: -max(strength[c] for c in work.plan.terms[t]))
            asked += [work.candidate(ranked[:size], r, f) for size in wanted]
            names += [(size, r, f) for size in wanted]
        work.fits.fit(asked)
        spark = df.sparkSession
        known = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i long, size int, repeat int, fold int")
        calls = work.fits.held_out_calls(asked).join(known, "i")
        cells = calls.groupBy("size", "repeat", "fold").agg(*[
            F.coalesce(F.sum(F.when((ref("obs") == o) & (ref("call") == c), ref("n"))), F.lit(0)).alias(n)
            for n, o, c in (("tp", True, True), ("fn", True, False), ("fp", False, True), ("tn", False, False))
        ])
        table = with_metrics(cells).groupBy("size").agg(F.avg("accuracy").alias("accuracy"), F.avg("kap").alias("kappa"))
        # A few rows, taken while the prepared frame is still cached.
        return spark.createDataFrame(table.orderBy("size").collect(), table.schema)
    finally:
        work.fits.close()


def best_size(table: DataFrame, metric: str = "accuracy") -> int:
    return table.orderBy(F.desc_nulls_last(metric), "size").first()["size"]


def _mean_scores(fixed: DataFrame, grid: Sequence[float], slope: float, rows: int = 2048) -> DataFrame:
    """(value, yhat): the mean over ``_eta`` of the logistic function of _eta + slope * value."""
    shift = slope * np.asarray(grid, float)

    def sums(batches):
        total, n = np.zeros(len(shift)), 0
        for batch in batches:
            eta = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            n += len(eta)
            for at in range(0, len(eta), rows):
                with np.errstate(over="ignore"):  # exp beyond the doubles is a probability of 0
                    total += (1 / (1 + np.exp(-(eta[at : at + rows, None] + shift)))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shift))), pa.array(total), pa.array(np.full(len(shift), n))], names=["i", "total", "n"])

    parts = fixed.mapInArrow(sums, "i long, total double, n long").groupBy("i").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("yhat"))
    values = fixed.sparkSession.createDataFrame(list(enumerate(map(float, grid))), "i long, value double")
    return values.join(parts, "i").select("value", "yhat")


def partial_dependence(fitted: Fitted, df: DataFrame, predictor: str, points: int = 51, grid: Sequence[float] | None = None) -> DataFrame:
    """Mean P(event) with the predictor set to each grid value on every row: (value, yhat).

    A logistic score is one pass: the part that does not move is computed once for each row, and each task hands on one sum for each grid
    value. For other models each row is repeated per grid value inside its task.
    """
    if grid is None:
        ends = df.agg(F.min(ref(predictor)).alias("a"), F.max(ref(predictor)).alias("b")).first()
        grid = [float(v) for v in np.linspace(float(ends["a"]), float(ends["b"]), points)]
    *made, packer, model = fitted.pipeline.stages
    column = f"{predictor}_x"
    if isinstance(model, GeneralizedLinearRegressionModel) and len(made) == 1 and column in packer.getInputCols():
        columns = list(packer.getInputCols())
        slope = float(model.coefficients[columns.index(column)])
        fixed = made[0].transform(df).select(linear_score(model, columns, column).alias("_eta"))
        return _mean_scores(fixed, grid, slope)
    moved = df.withColumn(predictor, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    scored = fitted.score(moved)
    return scored.groupBy(ref(predictor).alias("value")).agg(F.avg(P).alias("yhat"))


def predict_table(fitted: Fitted, df: DataFrame, event: str, other: str, cut: float = 0.5, best: float | None = None) -> DataFrame:
    """P(event), P(other), class at ``cut`` and, when given, class at a chosen threshold."""
    scored = fitted.score(df)
    out = scored.withColumn("p_other", 1 - ref(P)).withColumn(
        "pred", F.when(ref(P) > cut, F.lit(event)).when(ref(P) <= cut, F.lit(other))
    )
    if best is not None:
        out = out.withColumn("adj_pred", F.when(ref(P) > best, F.lit(event)).when(ref(P) <= best, F.lit(other)))
    return out
