"""Running totals and exact quantiles over groups of any size.

A plain ``Window.partitionBy(group).orderBy(value)`` sends a whole group to one task. Here each
value falls into a bin that never decreases with the value. What lies ahead of a row is then the
total of the earlier bins plus the rows ahead inside its bin, so the window over a group only sees
one row per bin, and the window over a bin only the values in it. The result is exact: bins only
decide which task does the work. They are cut where the data lie: at edges from a quantile sketch, which Spark merges
from all rows in one pass, with every value that is an edge in a bin of its own. Edges are written once, so a task that runs again after
a lost executor makes the same bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.operators.small import null_safe_join, plain_keys, solid_keys
from riskloom.sources.tables import settled

BIN = "_bin"

# A bin spans a factor 2^(1/4096), so a smooth score has at most 0.02 % of its values in one bin.
_PER_OCTAVE = 4096.0
# Above 4096 times the largest binary exponent of a double, so that signs do not mix.
_SHIFT = 5_000_000


def value_bin(value: Column) -> Column:
    """Signed logarithmic bin of a double, non-decreasing in the value; 0 for zero."""
    size = F.abs(value)
    place = (
        F.when(size == F.lit(float("inf")), F.lit(2 * _SHIFT))
        .when(size > 0, F.lit(_SHIFT) + F.floor(F.log2(size) * _PER_OCTAVE))
        .otherwise(F.lit(0))
        .cast("int")
    )
    return F.when(value < 0, -place).otherwise(place)


# A group has a bin for each so many of its rows, up to _BINS, each cut further by the signed logarithm; edges are searched in two steps of 16.
_ROWS_IN_BIN, _BINS, _STEP = 512, 256, 16
# The sketch's ranks are right to one part in so many.
_ACCURACY = 10_000
EDGES = "_edges"


def bin_edges(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``_edges`` for each group: distinct values that part its rows about evenly, in lists of 16; none where the group is small.

    A value that holds more than a bin's share of the rows is sure to be an edge.
    """
    shares = [i / _BINS for i in range(1, _BINS)]
    sketch = rows.groupBy(*_refs(by)).agg(
        F.percentile_approx(ref(value), shares, _ACCURACY).alias("_q"), F.least(F.lit(_BINS), F.ceil(F.count(F.lit(1)) / _ROWS_IN_BIN)).cast("int").alias("_k")
    )
    steps = F.sequence(F.lit(1), ref("_k") - 1)
    picked = F.array_distinct(F.transform(steps, lambda i: F.get(ref("_q"), (i * _BINS / ref("_k")).cast("int") - 1)))
    parts = F.sequence(F.lit(0), ((F.size("_e") - 1) / _STEP).cast("int"))
    lists = F.transform(parts, lambda c: F.slice(ref("_e"), c * _STEP + 1, _STEP))
    none = F.array().cast("array<array<double>>")
    with_edges = sketch.withColumn("_e", F.when(ref("_k") > 1, picked).otherwise(F.array().cast("array<double>")))
    return with_edges.select(*_refs(by), F.when(F.size("_e") > 0, lists).otherwise(none).alias(EDGES))


def with_edge_bin(rows: DataFrame, value: str, edges: str, name: str) -> DataFrame:
    """Add twice the edges up to the value, less one if it equals the last of them. Each list is searched once a row: a step is a column of its own."""
    x, at, here, upto = ref(value), ref("_at"), ref("_here"), ref("_upto")
    out = rows.withColumn("_at", F.size(F.filter(ref(edges), lambda e: e[0] <= x)))
    out = out.withColumn("_here", F.get(ref(edges), at - 1))
    out = out.withColumn("_upto", F.size(F.filter(here, lambda e: e <= x)))
    place = 2 * ((at - 1) * _STEP + upto) - (F.get(here, upto - 1) == x).cast("int")
    return out.withColumn(name, F.when(at == 0, F.lit(0)).otherwise(place)).drop("_at", "_here", "_upto")


def binned(rows: DataFrame, by: Sequence[str], value: str, edges: DataFrame) -> DataFrame:
    """``rows`` with their bin in ``_bin``; ``edges`` of :func:`bin_edges`, settled."""
    joined = with_edge_bin(rows.join(edges, list(by)), value, EDGES, "_place")
    place = F.shiftleft(ref("_place").cast("long"), 25) + (value_bin(ref(value)) + (1 << 24))
    return joined.withColumn(BIN, place).select(*_refs([*rows.columns, BIN]))


def known(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def _refs(names: Sequence[str]) -> list[Column]:
    return [ref(c) for c in names]


def _ahead(name: str, by: Sequence[str], order: str) -> Column:
    window = W.partitionBy(*_refs(by)).orderBy(ref(order)).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(ref(name)).over(window), F.lit(0).cast("long"))


def bin_totals(placed: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """One row per (group, bin): ``<count>`` in it, ``<count>_ahead`` and the group's ``<count>_all``."""
    bins = placed.groupBy(*_refs([*by, BIN])).agg(*[F.sum(ref(c)).alias(c) for c in counts])
    whole = W.partitionBy(*_refs(by))
    return bins.withColumns(
        {f"{c}_ahead": _ahead(c, by, BIN) for c in counts} | {f"{c}_all": F.sum(ref(c)).over(whole) for c in counts}
    )


def running_totals(
    df: DataFrame, by: Sequence[str], value: str, counts: Sequence[str], rows: DataFrame | None = None
) -> DataFrame:
    """Add ``<count>_ahead`` (sum over smaller values of the group), ``<count>_all`` and the bin.

    ``df`` holds one row per (group, value); value is a double, not null, not NaN; group columns are
    not null (see :func:`~riskloom.operators.small.solid_keys`). ``rows`` may
    give the rows it was collapsed from: bin totals are then read off them, which combines before
    the shuffle instead of waiting for the collapse.
    """
    whole = df if rows is None else rows
    edges = settled(bin_edges(whole, by, value))
    placed = binned(df, by, value, edges)
    totals = bin_totals(placed if rows is None else binned(rows, by, value, edges), by, counts)
    keys = [*by, BIN]
    local = placed.withColumns({f"_{c}_in": _ahead(c, keys, value) for c in counts})
    joined = local.join(totals.drop(*counts), keys)
    return joined.select(
        *_refs([*df.columns, BIN]),
        *[(ref(f"_{c}_in") + ref(f"{c}_ahead")).alias(f"{c}_ahead") for c in counts],
        *[ref(f"{c}_all") for c in counts],
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles per group, linear between neighbours; one output column per name.

    A first pass sketches each group and brackets every wanted rank by two values whose ranks are sure to lie around it. A second
    counts the rows before, between and behind the brackets, and those inside by value, combined before the shuffle. The
    data is neither shuffled nor sorted: brackets are one row per group and join as Spark sees fit for their size. Should a rank lie outside its
    brackets after all, these are widened and the second pass is done again.
    """
    rows = df.select(*_refs(by), ref(value).cast("double").alias("_v")).where(known(ref("_v")))
    rows = solid_keys(rows, by)
    lone = "_all"
    if not by:
        rows, by = rows.withColumn(lone, F.lit(0)), [lone]
    wanted = sorted(set(map(float, quantiles.values())))
    for margin in (4 / _ACCURACY, 0.02, 1.0):
        near = settled(_near_ranks(rows, by, wanted, margin))
        keys = [*by, BIN]
        total = near.groupBy(*_refs(keys)).agg(F.sum("_c").alias("_n"), F.max(ref("_v").isNotNull()).alias("_inside"))
        bins = total.withColumns({"_n_ahead": _ahead("_n", by, BIN), "_n_all": F.sum(ref("_n")).over(W.partitionBy(*_refs(by)))})

        def holds(p: float, start: Column, count: Column) -> Column:
            place = (ref("_n_all") - 1) * F.lit(p)
            low, high, stop = F.floor(place), F.ceil(place), start + count
            return ((low >= start) & (low < stop)) | ((high >= start) & (high < stop))

        outside = F.lit(False)
        for p in wanted:
            outside = outside | holds(p, ref("_n_ahead"), ref("_n"))
        if bins.where(~ref("_inside") & outside).isEmpty():
            break
    inside = near.where(ref("_v").isNotNull()).join(bins.drop("_n", "_inside"), keys)
    inside = inside.withColumn("_start", ref("_n_ahead") + _ahead("_c", keys, "_v"))
    picks = []
    for name, p in quantiles.items():
        here = F.when(holds(float(p), ref("_start"), ref("_c")), ref("_v"))
        place = F.max((ref("_n_all") - 1) * F.lit(float(p)))
        low = F.min(here)
        picks.append((low + (F.max(here) - low) * (place - F.floor(place))).alias(name))
    return plain_keys(inside.groupBy(*_refs(by)).agg(*picks), by).drop(lone)


def _near_ranks(rows: DataFrame, by: Sequence[str], wanted: Sequence[float], margin: float) -> DataFrame:
    """Counts ``_c`` by group, ``_bin`` and ``_v``: the value for rows inside a bracket, null for rows before, between and behind them."""
    shares = [share for p in wanted for share in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = rows.groupBy(*_refs(by)).agg(F.percentile_approx("_v", shares, _ACCURACY).alias("_q"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    ends = {}
    for i, p in enumerate(wanted):
        ends[f"_low{i}"] = ref("_least") if shares[2 * i] == 0 else ref("_q")[2 * i]
        ends[f"_high{i}"] = ref("_most") if shares[2 * i + 1] == 1 else ref("_q")[2 * i + 1]
    brackets = settled(sketch.select(*_refs(by), *[c.alias(n) for n, c in ends.items()]))
    value, place, inside = ref("_v"), F.lit(0), F.lit(False)
    for i in range(len(wanted)):
        place = place + (value >= ref(f"_low{i}")).cast("int") + (value > ref(f"_high{i}")).cast("int")
        inside = inside | ((value >= ref(f"_low{i}")) & (value <= ref(f"_high{i}")))
    placed = rows.join(brackets, list(by)).select(*_refs(by), place.alias(BIN), F.when(inside, value).alias("_v"))
    return placed.groupBy(*_refs([*by, BIN, "_v"])).agg(F.count(F.lit(1)).alias("_c"))


def ranked_codes(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Dense code 1, 2, ... of a numeric value among the group's distinct values."""
    group = list(by) or ["_g"]
    marked = df if by else df.withColumn("_g", F.lit(0))
    values = (
        solid_keys(marked.select(*_refs(group), ref(value).cast("double").alias("_x")), group)
        .where(known(ref("_x")))
        .distinct()
        .withColumn("_one", F.lit(1).cast("long"))
    )
    codes = running_totals(values, group, "_x", ["_one"])
    codes = plain_keys(codes.select(*_refs(group), "_x", (ref("_one_ahead") + 1).alias(name)), group)
    joined = null_safe_join(marked.withColumn("_x", ref(value).cast("double")), codes, [*group, "_x"], "left")
    return joined.select(*_refs([*df.columns, name]))
