"""The tables behind figures: bins, boxes, stacked bars, grids, scatter points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.operators.ordered import exact_quantiles, ranked_codes
from riskloom.operators.profile import MEDIAN, QUARTILES, count_by, group_share
from riskloom.operators.small import attach


def _refs(names: Sequence[str]) -> list[Column]:
    return [ref(c) for c in names]


def hist_bins(df: DataFrame, value: str, bins: int, facet: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """Counts per (facet, fill, bin). The first and last bins are centred on the facet's extremes;
    a value on an edge belongs to the lower bin. Empty bins are not listed."""
    if bins < 2:
        raise ValueError("at least two bins")
    rows = df.select(*_refs([*facet, *fill]), ref(value).cast("double").alias("_v")).where(ref("_v").isNotNull())
    edges = rows.groupBy(*_refs(facet)).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    joined = attach(rows, edges, facet)
    width = (ref("_high") - ref("_low")) / F.lit(float(bins - 1))
    spot = F.when(width > 0, F.ceil((ref("_v") - ref("_low")) / F.nullif(width, F.lit(0.0)) - 0.5)).otherwise(F.lit(0))
    centre = ref("_low") + ref("bin") * width
    counted = (
        joined.withColumn("bin", F.greatest(spot.cast("int"), F.lit(0)))
        .groupBy(*_refs([*facet, *fill]), "bin", "_low", "_high")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(*_refs([*facet, *fill]), "bin", centre.alias("centre"), "n")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR, row and outlier counts per group."""
    rows = df.where(ref(value).isNotNull())
    quart = exact_quantiles(rows, by, value, QUARTILES)
    fenced = attach(rows, quart, by)
    reach = 1.5 * (ref("q3") - ref("q1"))
    inside = (ref(value) >= ref("q1") - reach) & (ref(value) <= ref("q3") + reach)
    return fenced.groupBy(*_refs([*by, "q1", "median", "q3"])).agg(
        F.min(F.when(inside, ref(value))).alias("whisker_low"),
        F.max(F.when(inside, ref(value))).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
    )


def outlier_rows(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows beyond the whisker fences of their group."""
    quart = exact_quantiles(df, by, value, QUARTILES)
    reach = 1.5 * (ref("q3") - ref("q1"))
    out = attach(df, quart, by).where((ref(value) < ref("q1") - reach) | (ref(value) > ref("q3") + reach))
    return out.select(*_refs(df.columns))


def stacked_share(df: DataFrame, facet: Sequence[str], x: str, fill: str) -> DataFrame:
    """Rows (facet, x, fill, n, prop): prop sums to 1 per bar."""
    return group_share(df, [*facet, x, fill], [*facet, x], digits=None)


def count_bars(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return count_by(df, keys)


def mean_share(df: DataFrame, bar: Sequence[str], fill: str, value: str) -> DataFrame:
    """Mean of a value per (bar, fill) and its share of the bar."""
    means = df.groupBy(*_refs([*bar, fill])).agg(F.avg(ref(value)).alias("value"))
    return means.withColumn("share", ref("value") / F.nullif(F.sum("value").over(W.partitionBy(*_refs(bar))), F.lit(0.0)))


def level_order(df: DataFrame, level: str, value: str, stat: str = "median") -> DataFrame:
    """Levels with their median or mean and a dense position in ascending order."""
    if stat == "median":
        table = exact_quantiles(df, [level], value, MEDIAN).withColumnRenamed("median", "stat")
    else:
        table = df.groupBy(ref(level)).agg(F.avg(ref(value)).alias("stat"))
    return ranked_codes(table, [], "stat", "ord")


def heat_grid(status: DataFrame, unit: str, area: str, value: str, unit_stat: str) -> DataFrame:
    """Unit x area cells with axis positions: areas by median value, units by median of ``unit_stat``."""
    areas = level_order(status, area, value).select(ref(area), ref("ord").alias("area_ord"))
    units = level_order(status, unit, unit_stat).select(ref(unit), ref("ord").alias("unit_ord"))
    return status.join(areas, area, "left").join(units, unit, "left")


def scatter(df: DataFrame, x: str, y: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Points of two measures."""
    return df.select(*_refs([key, x, y, *keep]))
