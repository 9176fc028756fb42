"""ROC curves, AUC and best thresholds of one or many scores.

Predictor name and vessel type are grouping keys, so one job serves every curve. Rows collapse to
distinct scores (combined before the shuffle) and are then put in order by
:mod:`riskloom.operators.ordered`, so one large series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.functions.numeric import signif
from riskloom.operators.ordered import BIN, known, running_totals
from riskloom.operators.small import plain_keys, solid_keys

_SINGLE = "_series"


def to_series(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide -> long: one row per (row, column), values as double, nulls kept."""
    wide = df.select(*[ref(c) for c in keep], *[ref(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), name, value)


def _points(df: DataFrame, truth: str, score: str, event: object, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Per distinct score: events and others at it, below it, and in the whole series."""
    group = list(by) or [_SINGLE]
    rows = df if by else df.withColumn(_SINGLE, F.lit(0))
    rows = rows.select(
        *[ref(c) for c in group],
        ref(score).cast("double").alias("_s"),
        (ref(truth) == F.lit(event)).cast("long").alias("_p"),
    ).where(known(ref("_s")) & ref("_p").isNotNull())
    rows = solid_keys(rows, group).withColumn("_n", 1 - ref("_p"))
    counts = rows.groupBy(*[ref(c) for c in group], "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return running_totals(counts, group, "_s", ["_p", "_n"], rows), group


def _whole(c: Column) -> Column:
    """Products of two counts pass 2^63 on large tables."""
    return c.cast("decimal(19,0)")


def _rates() -> list[Column]:
    return [
        ref("_s").alias("threshold"),
        (ref("_n_ahead") / ref("_n_all")).alias("specificity"),
        ((ref("_p_all") - ref("_p_ahead")) / ref("_p_all")).alias("sensitivity"),
    ]


def _two_classes(points: DataFrame) -> DataFrame:
    return points.where((ref("_p_all") > 0) & (ref("_n_all") > 0))


def roc_curve(
    df: DataFrame, truth: str, score: str, event: object, by: Sequence[str] = (), ends: bool = True
) -> DataFrame:
    """Rows (by..., threshold, specificity, sensitivity) for "score >= threshold means event".

    ``ends`` adds thresholds -Inf and +Inf. Series without both classes give no rows.
    """
    points, group = _points(df, truth, score, event, by)
    curve = _two_classes(points).select(*[ref(c) for c in group], *_rates(), ref("_p_ahead"), ref("_n_ahead"))
    if ends:
        # The row at the lowest score (nothing ahead of it) brings the two end points along.
        point = F.struct("threshold", "specificity", "sensitivity")
        outer = [
            F.struct(F.lit(t).alias("threshold"), F.lit(spec).alias("specificity"), F.lit(sens).alias("sensitivity"))
            for t, spec, sens in ((float("-inf"), 0.0, 1.0), (float("inf"), 1.0, 0.0))
        ]
        lowest = (ref("_p_ahead") == 0) & (ref("_n_ahead") == 0)
        rows = F.when(lowest, F.array(point, *outer)).otherwise(F.array(point))
        curve = curve.select(*[ref(c) for c in group], F.explode(rows).alias("_row"))
        curve = curve.select(*[ref(c) for c in group], "_row.*")
    return plain_keys(curve, group).drop(_SINGLE, "_p_ahead", "_n_ahead")


def _twice_wins() -> Column:
    """Twice the pairs an event wins at this score: others below count 2, others at it 1."""
    return _whole(ref("_p")) * _whole(ref("_n_ahead") * 2 + ref("_n"))


def _auc_of(twice: Column, pos: Column, neg: Column) -> Column:
    pairs = pos.cast("double") * neg.cast("double")
    return F.when(pairs > 0, twice.cast("double") / 2 / F.nullif(pairs, F.lit(0.0)))


def auc(df: DataFrame, truth: str, score: str, event: object, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., auc, n_event, n_other); ties count half; null with one class only."""
    points, group = _points(df, truth, score, event, by)
    out = points.groupBy(*[ref(c) for c in group]).agg(
        F.sum(_twice_wins()).alias("_twice"), F.sum("_p").alias("n_event"), F.sum("_n").alias("n_other")
    )
    area = _auc_of(ref("_twice"), ref("n_event"), ref("n_other"))
    out = out.select(*[ref(c) for c in group], area.alias("auc"), "n_event", "n_other")
    return plain_keys(out, group).drop(_SINGLE)


def roc_summary(
    df: DataFrame,
    truth: str,
    score: str,
    event: object,
    by: Sequence[str] = (),
    tie: str | None = None,
    one_row: bool = False,
) -> DataFrame:
    """AUC and all thresholds at the largest Youden J, per series, in one pass.

    ``tie`` settles equal J by the distance to the perfect corner: ``"farthest"`` keeps the largest
    distance, ``"nearest"`` the smallest, ``None`` keeps all; ``one_row`` then keeps the lowest
    threshold. J is compared as a whole number, J * P * N = tp * N - fp * P.

    Each score bin first settles its own best rows (no shuffle: points already lie by bin) and hands
    on its share of the AUC, so the window over a series sees about one row per bin.
    """
    points, group = _points(df, truth, score, event, by)
    tp, fp = ref("_p_all") - ref("_p_ahead"), ref("_n_all") - ref("_n_ahead")
    gain = _whole(tp) * _whole(ref("_n_all")) - _whole(fp) * _whole(ref("_p_all"))
    scored = _two_classes(points).withColumn("_gain", gain).withColumn("_twice", _twice_wins())
    in_bin = W.partitionBy(*[ref(c) for c in [*group, BIN]])
    first = F.row_number().over(in_bin.orderBy(F.desc("_gain"), "_s"))
    local = scored.withColumns(
        {"_bin_gain": F.max("_gain").over(in_bin), "_bin_twice": F.sum("_twice").over(in_bin), "_first": first}
    ).where(ref("_gain") == ref("_bin_gain"))
    share = F.when(ref("_first") == 1, ref("_bin_twice"))
    series = W.partitionBy(*[ref(c) for c in group])
    best = local.withColumns({"_top": F.max("_gain").over(series), "_wins": F.sum(share).over(series)})
    best = best.where(ref("_gain") == ref("_top")).select(
        *[ref(c) for c in group],
        _auc_of(ref("_wins"), ref("_p_all"), ref("_n_all")).alias("auc"),
        ref("_p_all").alias("n_event"),
        ref("_n_all").alias("n_other"),
        *_rates(),
    )
    best = best.withColumn("youden", ref("specificity") + ref("sensitivity") - 1).withColumn(
        "corner", F.pow(1 - ref("sensitivity"), 2) + F.pow(1 - ref("specificity"), 2)
    )
    if tie is not None:
        edge = {"farthest": F.max, "nearest": F.min}[tie]("corner").over(series)
        best = best.withColumn("_edge", edge).where(ref("corner") == ref("_edge")).drop("_edge")
    if one_row:
        lowest = F.row_number().over(series.orderBy("threshold"))
        best = best.withColumn("_nth", lowest).where(ref("_nth") == 1).drop("_nth")
    return plain_keys(best, group).drop(_SINGLE)


def best_threshold(
    df: DataFrame, truth: str, score: str, event: object, by: Sequence[str] = (), tie: str | None = None
) -> DataFrame:
    """Thresholds at the largest Youden J per series (see :func:`roc_summary` for ``tie``)."""
    return roc_summary(df, truth, score, event, by, tie).drop("auc", "n_event", "n_other")


def report_table(
    summary: DataFrame, labels: DataFrame | None = None, key: str = "name", label: str = "Predictor", above: float | None = None
) -> DataFrame:
    """Labelled summary, two significant digits, highest AUC first; optionally only AUC above a limit."""
    out = summary if above is None else summary.where(ref("auc") > above)
    if labels is not None:
        out = out.join(labels.select(ref(key), ref(label)), key, "left")
    lead = [label] if labels is not None else []
    rounded = ["auc", "threshold", "specificity", "sensitivity"]
    keep = [c for c in out.columns if c not in {*lead, *rounded, "n_event", "n_other", "youden", "corner"}]
    picked = out.select(*[ref(c) for c in [*lead, *keep]], *[signif(ref(c)).alias(c) for c in rounded])
    return picked.orderBy(F.desc_nulls_last("auc"))
