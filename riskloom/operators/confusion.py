"""Truth against label or score: confusion matrices, metrics, threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import tails
from riskloom.functions.columns import ref


CELLS = ["tp", "fp", "fn", "tn"]

# Names of the class metrics, in their usual order.
METRICS = [
    "accuracy", "kap", "sens", "spec", "ppv", "npv", "mcc", "j_index",
    "bal_accuracy", "detection_prevalence", "precision", "recall", "f_meas",
]


def _ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def confusion(df: DataFrame, truth: str, estimate: str, event: object, by: Sequence[str] = ()) -> DataFrame:
    """Columns tp, fp, fn, tn per group; rows with an unknown truth or estimate are left out."""
    hit, call = ref(truth) == F.lit(event), ref(estimate) == F.lit(event)

    def cell(t: Column, e: Column) -> Column:
        return F.coalesce(F.sum((t & e).cast("long")), F.lit(0).cast("long"))

    cells = [cell(hit, call).alias("tp"), cell(~hit, call).alias("fp"), cell(hit, ~call).alias("fn"), cell(~hit, ~call).alias("tn")]
    rows = df.where(ref(truth).isNotNull() & ref(estimate).isNotNull())
    return rows.groupBy(*[ref(c) for c in by]).agg(*cells)


def confusion_cells(cells: DataFrame, event: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """The matrix as four rows (truth, estimate, n), empty cells kept."""
    quad = [("tp", event, event), ("fp", other, event), ("fn", event, other), ("tn", other, other)]
    items = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(e).alias("estimate"), ref(c).alias("n")) for c, t, e in quad])
    return cells.select(*[ref(c) for c in by], F.explode(items).alias("_c")).select(*[ref(c) for c in by], "_c.*")


def with_metrics(cells: DataFrame) -> DataFrame:
    """Add the class metrics to a frame with tp, fp, fn, tn; empty denominators give null."""
    tp, fp, fn, tn = (ref(c).cast("double") for c in CELLS)
    n = tp + fp + fn + tn
    called, real = tp + fp, tp + fn
    chance = _ratio(called * real + (fn + tn) * (fp + tn), n * n)
    accuracy = _ratio(tp + tn, n)
    sens, spec = _ratio(tp, real), _ratio(tn, tn + fp)
    columns = {
        "accuracy": accuracy,
        "kap": _ratio(accuracy - chance, 1 - chance),
        "sens": sens,
        "spec": spec,
        "ppv": _ratio(tp, called),
        "npv": _ratio(tn, tn + fn),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt(called) * F.sqrt(real) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "j_index": sens + spec - 1,
        "bal_accuracy": (sens + spec) / 2,
        "detection_prevalence": _ratio(called, n),
        "precision": _ratio(tp, called),
        "recall": sens,
        "f_meas": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return cells.withColumns(columns)


def class_metrics(
    df: DataFrame, truth: str, estimate: str, event: object, by: Sequence[str] = (), only: Sequence[str] = METRICS
) -> DataFrame:
    """Long form (by..., metric, estimate)."""
    wide = with_metrics(confusion(df, truth, estimate, event, by))
    items = F.array(*[F.struct(F.lit(m).alias("metric"), ref(m).alias("estimate")) for m in only])
    return wide.select(*[ref(c) for c in by], F.explode(items).alias("_m")).select(*[ref(c) for c in by], "_m.*")


def _matrix_tests(frame: pd.DataFrame) -> pd.DataFrame:
    tp, fp, fn, tn = (frame[c].to_numpy(float) for c in CELLS)
    n, right = tp + fp + fn + tn, tp + tn
    floor = np.maximum(tp + fn, fp + tn)
    safe = np.maximum(n, 1)
    low, high = tails.exact_interval(right, safe)
    differ = fp + fn
    with np.errstate(divide="ignore", invalid="ignore"):
        mcnemar = tails.chi_one_tail(np.where(differ > 0, (np.maximum(np.abs(fp - fn) - 1, 0)) ** 2 / differ, np.nan))
    upper = tails.binomial_upper(right, safe, floor / safe)
    blank = n == 0
    out = frame.copy()
    for name, value in (("accuracy_low", low), ("accuracy_high", high), ("accuracy_p", upper), ("mcnemar_p", mcnemar)):
        out[name] = np.where(blank, np.nan, value)
    return out


def matrix_statistics(df: DataFrame, truth: str, estimate: str, event: object, by: Sequence[str] = ()) -> DataFrame:
    """Class metrics plus exact accuracy interval, no-information rate and tests, one row per group.

    The counting is a plain aggregation; only its result rows pass through the tail functions.
    """
    cells = confusion(df, truth, estimate, event, by)
    schema = T.StructType(list(cells.schema.fields))
    for name in ("accuracy_low", "accuracy_high", "accuracy_p", "mcnemar_p"):
        schema = schema.add(name, "double")
    tested = cells.mapInPandas(lambda frames: (_matrix_tests(f) for f in frames), schema)
    tested = tested.withColumns({c: F.nanvl(ref(c), F.lit(None).cast("double")) for c in schema.names[-4:]})
    tp, fp, fn, tn = (ref(c) for c in CELLS)
    n = tp + fp + fn + tn
    return with_metrics(tested).withColumns(
        {
            "no_information_rate": _ratio(F.greatest(tp + fn, fp + tn), n),
            "prevalence": _ratio(tp + fn, n),
            "detection_rate": _ratio(tp, n),
        }
    )


def tidy_statistics(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form (term, estimate, conf_low, conf_high, p_value) of :func:`matrix_statistics`."""
    skip = {*by, *CELLS, "accuracy_low", "accuracy_high", "accuracy_p", "mcnemar_p"}
    none = F.lit(None).cast("double")

    def line(term: str, estimate: Column, low: Column = none, high: Column = none, p: Column = none) -> Column:
        return F.struct(
            F.lit(term).alias("term"), estimate.alias("estimate"), low.alias("conf_low"), high.alias("conf_high"), p.alias("p_value")
        )

    lines = [line("mcnemar", none, p=ref("mcnemar_p"))]
    for name in stats.columns:
        if name == "accuracy":
            lines.append(line(name, ref(name), ref("accuracy_low"), ref("accuracy_high"), ref("accuracy_p")))
        elif name not in skip:
            lines.append(line(name, ref(name)))
    return stats.select(*[ref(c) for c in by], F.explode(F.array(*lines)).alias("_l")).select(*[ref(c) for c in by], "_l.*")


def misclassified(df: DataFrame, truth: str, estimate: str, columns: Sequence[str] = ()) -> DataFrame:
    """Rows whose estimate differs from the truth."""
    rows = df.where(ref(truth) != ref(estimate))
    return rows.select(*[ref(c) for c in columns]) if columns else rows


def threshold_sweep(
    df: DataFrame, truth: str, score: str, event: object, by: Sequence[str] = (), steps: int = 100
) -> DataFrame:
    """Cells, metrics and corner distance at thresholds 1/steps ... (steps-1)/steps.

    Each score is put in the step it passes, once; the cells of all thresholds are then sums over
    at most ``steps`` + 1 rows per group. Scores at a threshold count as event.
    """
    group = list(by)
    hit = (ref(truth) == F.lit(event)).cast("long")
    # Number of thresholds k / steps that are <= score, settled against the very doubles compared.
    near = F.floor(ref("_s") * steps).cast("int")
    step = (
        F.when(near / F.lit(float(steps)) > ref("_s"), near - 1)
        .when((near + 1) / F.lit(float(steps)) <= ref("_s"), near + 1)
        .otherwise(near)
    )
    rows = df.select(*[ref(c) for c in group], ref(score).cast("double").alias("_s"), hit.alias("_p"))
    rows = rows.where(ref("_s").isNotNull() & ~F.isnan("_s") & ref("_p").isNotNull())
    rows = rows.withColumn("_k", F.greatest(F.lit(0), F.least(F.lit(steps), step)))
    counts = rows.groupBy(*[ref(c) for c in group], "_k").agg(F.sum("_p").alias("_p"), F.sum(1 - ref("_p")).alias("_n"))
    # A zero row per threshold, so that steps without scores are present.
    grid = (
        counts.select(*[ref(c) for c in group]).distinct()
        if group
        else counts.agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0").select(F.lit(0).alias("_g"))
    )
    zero = F.lit(0).cast("long")
    grid = grid.select(*[ref(c) for c in group], F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_k"))
    filled = counts.unionByName(grid.select("*", zero.alias("_p"), zero.alias("_n")))
    filled = filled.groupBy(*[ref(c) for c in group], "_k").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    whole = W.partitionBy(*([ref(c) for c in group] or [F.lit(0)]))
    above = whole.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    summed = filled.select(
        *[ref(c) for c in group],
        "_k",
        F.sum("_p").over(above).alias("tp"),
        F.sum("_n").over(above).alias("fp"),
        (F.sum("_p").over(whole) - F.sum("_p").over(above)).alias("fn"),
        (F.sum("_n").over(whole) - F.sum("_n").over(above)).alias("tn"),
    ).where((ref("_k") > 0) & (ref("_k") < steps))
    cells = summed.select(*[ref(c) for c in group], (ref("_k") / F.lit(float(steps))).alias("threshold"), *CELLS)
    return with_metrics(cells).withColumn("dist", F.sqrt(F.pow(1 - ref("sens"), 2) + F.pow(1 - ref("spec"), 2)))


def averaged_sweep(sweep: DataFrame, resample: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric over resamples, per threshold."""
    keep = [c for c in [*METRICS, "dist"] if c in sweep.columns]
    return sweep.groupBy(*[ref(c) for c in by], "threshold").agg(*[F.avg(ref(c)).alias(c) for c in keep])


def sweep_best(sweep: DataFrame, by: Sequence[str] = (), metric: str = "j_index") -> DataFrame:
    """Threshold rows at the largest value of a metric, ties kept."""
    whole = W.partitionBy(*([ref(c) for c in by] or [F.lit(0)]))
    top = sweep.withColumn("_top", F.max(ref(metric)).over(whole))
    return top.where(ref(metric) == ref("_top")).drop("_top")


def validate_rules(df: DataFrame, rule, truth: str, estimate: str, event: object, where: Column | None = None) -> DataFrame:
    """Filter, apply a rule function, and test its label against the truth."""
    rows = df if where is None else df.where(where)
    return matrix_statistics(rule(rows), truth, estimate, event)
