"""Aligning, patching and stacking tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.sources.tables import checkpointed


def lookup_join(
    df: DataFrame, lookup: DataFrame, on: Mapping[str, str] | Sequence[str] | str, how: str = "left"
) -> DataFrame:
    """Join a lookup table under stated keys (``{"name": "value"}`` for differing names).

    No broadcast hint: Spark broadcasts the lookup when its size is under the session's limit, and
    falls back to a shuffled join, with skewed keys split at run time, when it is not.
    """
    if isinstance(on, str):
        on = [on]
    if isinstance(on, Mapping):
        taken = set(on)
        side = lookup.select(
            *[ref(right).alias(left) for left, right in on.items()],
            *[ref(c) for c in lookup.columns if c not in set(on.values()) and c not in taken],
        )
        return df.join(side, list(on), how)
    return df.join(lookup, list(on), how)


def align(df: DataFrame, lookup: DataFrame, on: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Every lookup row with its match; rows where the required columns found none are dropped."""
    return df.join(lookup, list(on), "right").na.drop(subset=list(required))


def recode_from(df: DataFrame, column: str, lookup: DataFrame, old: str, new: str) -> DataFrame:
    """Recode by a mapping table; values it does not list stay.

    The mapping must be unique in ``old``; of repeats the smallest new value is used.
    """
    side = lookup.groupBy(ref(old).alias(column)).agg(F.min(ref(new)).alias("_new"))
    out = df.join(side, column, "left").withColumn(column, F.coalesce(ref("_new"), ref(column)))
    return out.select(*[ref(c) for c in df.columns])


def patch(df: DataFrame, key: str, column: str, fixes: DataFrame, value: str) -> DataFrame:
    """Correct single cells by key; keys that are not in the data have no effect."""
    side = fixes.groupBy(ref(key)).agg(F.first(ref(value), ignorenulls=True).alias("_fix"))
    out = df.join(side, key, "left").withColumn(column, F.coalesce(ref("_fix"), ref(column)))
    return out.select(*[ref(c) for c in df.columns])


def exclude_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is not listed; rows without a key go too, as in a row filter."""
    return df.where(ref(key).isNotNull()).join(keys.select(ref(key)), key, "left_anti")


def fill(df: DataFrame, columns: Sequence[str], value: float | str) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def stack(parts: Mapping[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Union by name under a source label; columns a part lacks are null."""
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias(label), *[ref(c) for c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def numbered(values: DataFrame, value: str, name: str) -> DataFrame:
    """1, 2, ... over the distinct values in ascending order, at any number of values.

    Values are dealt by range; each slice is numbered on its own, from the rows of the slices before.
    """
    order = ref(value).asc_nulls_last()
    dealt = values.select(ref(value)).distinct().repartitionByRange(order).withColumn("_slice", F.spark_partition_id())
    sliced = checkpointed(dealt)  # a slice's number must not change between its two readings
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_slice", before.alias("_before"))  # one row a slice
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(order))
    return sliced.withColumn("_i", inside).join(starts, "_slice").select(ref(value), (ref("_i") + ref("_before")).cast("long").alias(name))


def backfill_clean(clean: Column, film: Column, cover: Column, rating: Column) -> tuple[Column, Column]:
    """Repaired (clean, film) shares of a sample.

    A negative clean share counts as 0. A missing one is 100 where cover and rating are 0, else what
    the film leaves of 100 where cover is 0. A missing film share is 0 on a fully clean sample.
    """
    clean = F.when(clean < 0, F.lit(0.0)).otherwise(clean)
    clean = F.when(clean.isNull() & (cover == 0) & (rating == 0), F.lit(100.0)).otherwise(clean)
    clean = F.when(clean.isNull() & (cover == 0), F.lit(100.0) - film).otherwise(clean)
    return clean, F.when(film.isNull() & (clean == 100), F.lit(0.0)).otherwise(film)
