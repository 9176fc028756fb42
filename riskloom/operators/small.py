"""Small helpers: joins on group columns, and sorted batches by key. No side carries a hint: adaptive execution broadcasts by measured bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import ref
from riskloom.sources.tables import settled

def null_safe_join(big: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns where a missing level is a group of its own."""
    side = small.select(*[ref(c).alias(f"_r_{c}") if c in set(by) else ref(c) for c in small.columns])
    match = [ref(c).eqNullSafe(ref(f"_r_{c}")) for c in by]
    return big.join(side, match, how).drop(*[f"_r_{c}" for c in by])


def attach(big: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a result to the data on ``by``; on nothing when it is a single row."""
    if by:
        return null_safe_join(big, settled(small), by)
    row = small.first()
    return big.withColumns({c: F.lit(row[c]).cast(small.schema[c].dataType) for c in small.columns})


def solid_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wrap nullable group columns in a struct, which is never null itself, so that plain joins on
    them keep the group of missing levels and still match the partitioning of windows."""
    return df.withColumns({c: F.struct(ref(c).alias("v")) for c in by if df.schema[c].nullable})


def plain_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Undo :func:`solid_keys`."""
    wrapped = [c for c in by if c in df.columns and isinstance(df.schema[c].dataType, T.StructType)]
    return df.withColumns({c: ref(c)["v"] for c in wrapped})


def groups_of(batches, keys: Sequence[str], most: int):
    """The rows of each run of equal integer keys in sorted batches, in parts of at most ``most`` rows."""
    held, last, n = [], None, 0
    for batch in batches:
        values = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys]) if batch.num_rows else np.zeros((0, len(keys)))
        cuts = np.flatnonzero(np.any(values[1:] != values[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            while a < b:
                at = tuple(int(v) for v in values[a])
                if held and (at != last or n >= most):
                    yield last, pa.Table.from_batches(held)
                    held, n = [], 0
                take = min(b - a, most - n)
                held.append(batch.slice(a, take))
                last, n, a = at, n + take, a + take
    if held:
        yield last, pa.Table.from_batches(held)
