"""Frequency tables, cross-tabs, group summaries and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.functions.numeric import half_even, row_sum, strict_mean
from riskloom.operators.ordered import exact_quantiles
from riskloom.operators.small import null_safe_join


def _refs(names: Sequence[str]) -> list[Column]:
    return [ref(c) for c in names]


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*_refs(keys)).agg(F.count(F.lit(1)).alias(name))


def group_share(
    df: DataFrame, keys: Sequence[str], within: Sequence[str] = (), digits: int | None = 2
) -> DataFrame:
    """Count per keys and its share of the ``within`` group (of all rows when empty).

    The window runs over the counted rows, not over the data.
    """
    counts = count_by(df, keys)
    total = F.sum("n").over(W.partitionBy(*_refs(within))) if within else counts.agg(F.sum("n")).scalar()
    share = ref("n") / total
    return counts.withColumn("prop", share if digits is None else half_even(share, digits))


def freq_table(df: DataFrame, column: str) -> DataFrame:
    """value, n, percent and valid_percent (share among known values; null on the null row)."""
    counts = df.groupBy(ref(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    valid = F.when(ref("value").isNotNull(), ref("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("all"), F.sum(valid).alias("valid"))).scalar()
    return counts.select("value", "n", (ref("n") / totals["all"]).alias("percent"), (valid / totals["valid"]).alias("valid_percent"))


def crosstab(df: DataFrame, row: str, column: str, show_na: bool = True) -> DataFrame:
    """Long cross-tab (row, column, n); every pair of seen levels is present, also with n = 0."""
    cells = df.groupBy(ref(row), ref(column)).agg(F.count(F.lit(1)).alias("n"))
    if not show_na:
        cells = cells.where(ref(row).isNotNull() & ref(column).isNotNull())
    # Every row level takes the whole list of column levels (structs keep a null level), which is
    # as short as the category has levels.
    levels = cells.agg(F.collect_set(F.struct(ref(column).alias("level")))).scalar()
    grid = cells.select(ref(row)).distinct().select(ref(row), F.explode(levels).alias("_l"))
    grid = grid.select(ref(row), F.col("_l.level").alias(column))
    both = cells.unionByName(grid.withColumn("n", F.lit(0).cast("long")))
    return both.groupBy(ref(row), ref(column)).agg(F.sum("n").alias("n"))


def crosstab_wide(df: DataFrame, row: str, column: str, levels: Sequence[str], show_na: bool = True) -> DataFrame:
    """One column per stated level; ``NA_`` counts rows without one when ``show_na``."""
    rows = df if show_na else df.where(ref(row).isNotNull() & ref(column).isNotNull())
    aggs = [F.coalesce(F.sum((ref(column) == F.lit(v)).cast("long")), F.lit(0).cast("long")).alias(str(v)) for v in levels]
    if show_na:
        aggs.append(F.sum(ref(column).isNull().cast("long")).alias("NA_"))
    return rows.groupBy(ref(row)).agg(*aggs)


# Quantile points of the usual summaries.
MEDIAN = {"median": 0.5}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _with_quantiles(df: DataFrame, by: Sequence[str], value: str, table: DataFrame, points: dict[str, float]) -> DataFrame:
    quantiles = exact_quantiles(df, by, value, points)
    if not by:
        one = F.lit(0).alias("_one")
        return table.select("*", one).join(quantiles.select("*", one), "_one", "left").drop("_one")
    return null_safe_join(table, quantiles, by, "left")


def group_min_med_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, minimum, maximum; nulls skipped."""
    table = df.groupBy(*_refs(by)).agg(F.min(ref(value)).alias("min"), F.max(ref(value)).alias("max"))
    return _with_quantiles(df, by, value, table, MEDIAN)


def group_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, median, min, max, sd, n, quartiles and standard error. n counts rows with nulls too."""
    x = ref(value)
    table = df.groupBy(*_refs(by)).agg(
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )
    out = _with_quantiles(df, by, value, table, QUARTILES)
    return out.withColumn("se", ref("sd") / F.sqrt("n"))


def group_se_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd, se and 1.96 se."""
    x = ref(value)
    table = df.groupBy(*_refs(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return table.withColumn("se", ref("sd") / F.sqrt("n")).withColumn("ci", ref("se") * 1.96)


def unit_means(df: DataFrame, by: Sequence[str], values: Sequence[str], strict: bool = True) -> DataFrame:
    """Mean of each value per coarser unit; null when strict and an input is null."""
    mean = strict_mean if strict else F.avg
    return df.groupBy(*_refs(by)).agg(*[mean(ref(c)).alias(c) for c in values])


def unit_status(df: DataFrame, unit: Sequence[str], area: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Mean failure per unit and area, 0/1 flag and label, and the unit's failing share of areas."""
    sums = df.select(*_refs([*unit, *area]), row_sum(_refs(flags)).alias("_sum"))
    means = sums.groupBy(*_refs([*unit, *area])).agg(strict_mean(ref("_sum")).alias("mean_area"))
    return _status(means, unit, ref("mean_area"))


def unit_status_sum(df: DataFrame, unit: Sequence[str], area: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """As :func:`unit_status` from sums: total, row count, flag and label per unit and area."""
    sums = df.select(*_refs([*unit, *area]), row_sum(_refs(flags)).alias("_sum"))
    whole = F.when(F.count("_sum") == F.count(F.lit(1)), F.sum("_sum"))
    totals = sums.groupBy(*_refs([*unit, *area])).agg(whole.alias("sum_area"), F.count(F.lit(1)).alias("n"))
    return _status(totals, unit, ref("sum_area"))


def _status(cells: DataFrame, unit: Sequence[str], measure: Column) -> DataFrame:
    failing = measure > 0
    flagged = cells.withColumn("failed", F.when(failing, F.lit(1)).when(~failing, F.lit(0))).withColumn(
        "status", F.when(failing, F.lit("Fail")).when(~failing, F.lit("Pass"))
    )
    areas = W.partitionBy(*_refs(unit))
    known = F.count("failed").over(areas) == F.count(F.lit(1)).over(areas)
    total = F.when(known, F.sum("failed").over(areas))
    return flagged.withColumn("sum_fail", total).withColumn("fail_prop", ref("sum_fail") / F.count(F.lit(1)).over(areas))


def area_ranking(status: DataFrame, area: Sequence[str]) -> DataFrame:
    """Mean of flag / row count per area, highest first."""
    ratio = status.groupBy(*_refs(area)).agg(strict_mean(ref("failed") / ref("n")).alias("m"))
    return ratio.orderBy(F.desc_nulls_last("m"), *[F.asc(c) for c in area])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, only_gaps: bool = False) -> DataFrame:
    """Nulls per column, long form, in one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.coalesce(F.sum(ref(c).isNull().cast("long")), F.lit(0).cast("long")).alias(c) for c in names])
    items = F.array(*[F.struct(F.lit(c).alias("var"), ref(c).alias("nas")) for c in names])
    out = counts.select(F.explode(items).alias("_i")).select("_i.*")
    return out.where("nas > 0") if only_gaps else out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on more than one row, with their count."""
    return count_by(df, keys).where("n > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows behind :func:`duplicate_keys`. Repeats are counted with map-side combining and
    joined back, so one heavily repeated key is not sorted in one task."""
    return null_safe_join(df, duplicate_keys(df, keys).select(*_refs(keys)), keys, "left_semi")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; an aggregation, so it combines before the shuffle.

    Order columns ascend with nulls first, as structs compare; equal ones go by the other columns.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[ref(c).alias(f"_v{i}") for i, c in enumerate(rest)])
    first = df.groupBy(*_refs(keys)).agg(F.min(packed).alias("_first"))
    out = first.select(*_refs(keys), *[F.col(f"_first._v{i}").alias(c) for i, c in enumerate(rest)])
    return out.select(*_refs(df.columns))


def column_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(ref(column)).alias("min"), F.max(ref(column)).alias("max"))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, quartiles, mean, max and null count per column, long form."""
    long = df.select(*[ref(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "var", "value")
    table = long.groupBy("var").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.sum(ref("value").isNull().cast("long")).alias("nas"),
    )
    return _with_quantiles(long, ["var"], "value", table, QUARTILES)


def top_per_group(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows at the group's largest value, ties kept. Largest values come from an aggregation that
    combines before the shuffle; a large group is not sorted in one task."""
    top = df.groupBy(*[ref(c).alias(f"_r_{c}") for c in by]).agg(F.max(ref(value)).alias("_top"))
    match = [ref(c).eqNullSafe(ref(f"_r_{c}")) for c in by] + [ref(value) == ref("_top")]
    return df.join(top, match, "left_semi")


def first_rows(df: DataFrame, order: Sequence[Column], n: int = 6) -> DataFrame:
    return df.orderBy(*order).limit(n)


def split_name(df: DataFrame, column: str, into: Sequence[str], pattern: str = "[^A-Za-z0-9]+") -> DataFrame:
    """Split a name column at non-alphanumeric runs."""
    parts = F.split(ref(column), pattern)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)}).drop(column)
