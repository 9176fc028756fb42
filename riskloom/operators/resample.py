"""Folds, minority oversampling, transforms learnt on training rows, imputation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import columns_with_nulls, ref
from riskloom.functions.numeric import hash_unit
from riskloom.operators.ordered import exact_quantiles
from riskloom.operators.profile import MEDIAN
from riskloom.operators.small import groups_of
from riskloom.sources.tables import drop_settled, settled


def fold_of(key: Sequence[str], folds: int, repeat: Column | int, seed: int) -> Column:
    """Fold 0 ... folds-1, fixed by the row key, the repeat and the seed."""
    repeat = repeat if isinstance(repeat, Column) else F.lit(repeat)
    return F.pmod(F.xxhash64(*[ref(c) for c in key], repeat, F.lit(seed)), F.lit(folds)).cast("int")


def cv_folds(df: DataFrame, key: Sequence[str], folds: int = 5, repeats: int = 3, seed: int = 1234567) -> DataFrame:
    """Every row once per repeat with the fold that holds it out."""
    times = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return times.withColumn("fold", fold_of(key, folds, ref("repeat"), seed))


def _closest(asked: np.ndarray, points: np.ndarray, k: int, own: np.ndarray | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest points of each row, nearest first, and their distances; ``own`` is a row's own place among the points, which does not count.

    Equal distances go by ``order``.
    """
    k = min(k, len(points))
    order = np.arange(len(points)) if order is None else order
    index, far = np.empty((len(asked), k), np.int64), np.empty((len(asked), k))
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        d, gap = np.zeros((len(part), len(points))), np.empty((len(part), len(points)))
        for c in range(points.shape[1]):  # column by column: no cancellation
            np.subtract(part[:, c, None], points[None, :, c], out=gap)
            d += np.multiply(gap, gap, out=gap)
        row = np.arange(len(part))
        if own is not None:
            d[row, own[at : at + len(part)]] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        limit = d[row, near[:, -1]]
        cells = np.lexsort((order[near], d[row[:, None], near]), axis=1)
        index[at : at + len(part)] = near[row[:, None], cells]
        for i in np.flatnonzero((d <= limit[:, None]).sum(axis=1) > k):  # others are as far as the last
            near = np.flatnonzero(d[i] <= limit[i])
            index[at + i] = near[np.lexsort((order[near], d[i, near]))[:k]]
        far[at : at + len(part)] = np.sqrt(d[row[:, None], index[at : at + len(part)]])
    return index, far


@dataclass
class Cells:
    """A k-d tree: a node parts its rows at ``cut`` of column ``axis`` (-1: a leaf); a leaf has ``parts`` parts from ``first`` on."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def grown(points: np.ndarray, most: float) -> Cells:
        """Cut at the median of the widest column until a leaf has up to ``most`` points; a leaf of equal points that holds more has several parts."""
        nodes: list[list] = [[-1, 0.0, -1, -1, -1, 0]]
        waiting, used = [(0, points)], 0
        while waiting:
            at, mine = waiting.pop()
            spread = np.ptp(mine, axis=0) if len(mine) else np.zeros(points.shape[1])
            if len(mine) <= most or not spread.max(initial=0) > 0:
                nodes[at][4:] = used, max(1, math.ceil(len(mine) / most))
                used += nodes[at][5]
                continue
            axis = int(np.argmax(spread))
            values = mine[:, axis]
            cut = np.partition(values, len(values) // 2)[len(values) // 2]
            if cut == values.max():
                cut = values[values < cut].max()
            under = values <= cut
            nodes[at][:4] = axis, cut, len(nodes), len(nodes) + 1
            waiting += [(len(nodes), mine[under]), (len(nodes) + 1, mine[~under])]
            nodes += [[-1, 0.0, -1, -1, -1, 0], [-1, 0.0, -1, -1, -1, 0]]
        return Cells(*(np.array(c) for c in zip(*nodes)))

    def leaf(self, z: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(z), int), np.arange(len(z))
        while (self.axis[node] >= 0).any():
            axis = self.axis[node]
            step = np.where(z[row, axis] <= self.cut[node], self.below[node], self.above[node])
            node = np.where(axis < 0, node, step)
        return node

    def bounded(self, low: np.ndarray, high: np.ndarray) -> Cells:
        """With the box of each node, from those of the parts; ``low`` is above ``high`` where a part is empty."""
        self.part_low, self.part_high = low, high
        self.low, self.high = np.full((len(self.axis), low.shape[1]), np.inf), np.full((len(self.axis), low.shape[1]), -np.inf)
        for at in range(len(self.axis) - 1, -1, -1):  # a node comes before those below it
            if self.axis[at] < 0:
                mine = slice(self.first[at], self.first[at] + self.parts[at])
                self.low[at], self.high[at] = low[mine].min(axis=0), high[mine].max(axis=0)
            else:
                two = [self.below[at], self.above[at]]
                self.low[at], self.high[at] = self.low[two].min(axis=0), self.high[two].max(axis=0)
        return self

    def reaching(self, z: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the parts whose box, or that of a node above, comes as close to a row of ``z`` as the reach of the part (-1: none)."""
        most = np.full(len(self.axis), -1.0)
        for at in range(len(self.axis) - 1, -1, -1):
            most[at] = reach[self.first[at] : self.first[at] + self.parts[at]].max() if self.axis[at] < 0 else max(most[self.below[at]], most[self.above[at]])

        def close(i: np.ndarray, low: np.ndarray, high: np.ndarray, far: np.ndarray) -> np.ndarray:
            gap = np.maximum(np.maximum(low - z[i], z[i] - high), 0)
            return (low <= high).all(axis=1) & (far >= 0) & (np.sqrt((gap * gap).sum(axis=1)) <= far * (1 + 1e-9))

        i, node, found = np.arange(len(z)), np.zeros(len(z), int), [(np.zeros(0, int), np.zeros(0, int))]
        while len(i):
            keep = close(i, self.low[node], self.high[node], most[node])
            i, node = i[keep], node[keep]
            end = self.axis[node] < 0
            times = self.parts[node[end]]
            j = np.repeat(i[end], times)
            part = np.repeat(self.first[node[end]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            keep = close(j, self.part_low[part], self.part_high[part], reach[part])
            found.append((j[keep], part[keep]))
            i, node = np.tile(i[~end], 2), np.concatenate((self.below[node[~end]], self.above[node[~end]]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def within(self, z: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the parts with a row whose box comes as close to a row of ``z`` as its bound."""

        def close(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            gap = np.maximum(np.maximum(low - z[i], z[i] - high), 0)
            return (low <= high).all(axis=1) & (np.sqrt((gap * gap).sum(axis=1)) <= bound[i] * (1 + 1e-9))

        i, node, found = np.arange(len(z)), np.zeros(len(z), int), []
        while len(i):
            keep = close(i, self.low[node], self.high[node])
            i, node = i[keep], node[keep]
            end = self.axis[node] < 0
            times = self.parts[node[end]]
            j = np.repeat(i[end], times)
            part = np.repeat(self.first[node[end]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            keep = close(j, self.part_low[part], self.part_high[part])
            found.append((j[keep], part[keep]))
            i, node = np.tile(i[~end], 2), np.concatenate((self.below[node[~end]], self.above[node[~end]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def nearest_rows(rows: DataFrame, k: int, part_rows: int = 1000, asking: Column | None = None) -> DataFrame:
    """(id, mates): for each row of ``(id long, tie long, z array<double>)`` the ids of its ``k`` nearest other rows, nearest first, ties by ``tie``. Exact.

    With ``asking`` only those rows are answered that it holds for, still from all rows. ``z`` has no null. ``rows`` is read several times.
    """
    found = _near_by_cell(rows, k, part_rows, asking)
    if found is None:
        return rows.sparkSession.createDataFrame([], "id long, mates array<long>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "tie", "mate")))), 1, k)  # at most k from each part that was asked
    return found.groupBy("id").agg(F.transform(best, lambda m: m["mate"]).alias("mates"))


def _near_by_cell(rows: DataFrame, k: int, part_rows: int, asking: Column | None, carry: bool = False) -> DataFrame | None:
    """(id, far, tie, mate, load): a list of the nearest for each row that asks and each cell searched for it; the ``k`` nearest of all are among them. None without rows.

    With ``carry``, ``load array<double>`` of the mates comes along, one after the other. Rows lie in the cells of a k-d tree of about ``part_rows`` each, grown
    over a bounded sample, which decides on the cuts only. A row's neighbours in its own cell bound its k-th distance, and cells whose box comes closer than that
    are searched as well; rows farther than the bound are not handed on. Cells and the rows that ask for them meet in blocks of bounded size.
    """
    spark = rows.sparkSession
    n, d, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("z")), F.max(F.size("load")) if carry else F.lit(0)).first()
    if not n:
        return None
    step = math.ceil(n / 50_000)
    sample = rows.where(F.pmod(F.xxhash64("tie"), F.lit(step)) == 0).select("z").toArrow() if n > part_rows else None

    def matrix(part: pa.Table | pa.RecordBatch, column: str = "z", width: int = d) -> np.ndarray:
        z = part.column(column)
        return (z.combine_chunks() if isinstance(z, pa.ChunkedArray) else z).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)

    cells = Cells.grown(matrix(sample) if sample is not None and sample.num_rows else np.zeros((0, d)), part_rows / step)
    parts = int(cells.parts.sum())
    asks_for = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
    extra = ["load"] if carry else []

    def place(batches):
        names = ["id", "tie", "z", "ask", *extra]
        for batch in batches:
            leaf = cells.leaf(matrix(batch))
            # a point that many rows share makes a leaf of several parts: its rows are dealt over them
            part = cells.first[leaf] + (batch.column("h").to_numpy() % cells.parts[leaf])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(part.astype(np.int32))], names=[*names, "part"])

    given = rows.select("id", "tie", "z", asks_for.alias("ask"), *extra, F.xxhash64("tie", F.lit(1)).alias("h"))
    placed = settled(given.mapInArrow(place, f"id long, tie long, z array<double>, ask boolean, {'load array<double>, ' if carry else ''}part int"))
    result = "id long, far array<double>, tie array<long>, mate array<long>, load array<double>"

    def rows_out(asker, far, index, names, tie, load, bound=None):
        """One row for each asker that has any mate within its bound."""
        keep = np.ones(far.shape, bool) if bound is None else far <= bound[:, None] * (1 + 1e-9)
        times = keep.sum(axis=1)
        some = np.flatnonzero(times)
        ends = np.concatenate(([0], np.cumsum(times[some]))).astype(np.int32)
        flat = index[keep]  # row by row
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (far[keep], tie[flat], names[flat])]
        loads = pa.ListArray.from_arrays(pa.array(ends * wide), pa.array(load[flat].ravel())) if carry else pa.nulls(len(some), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(asker[some]), *lists, loads], names=["id", "far", "tie", "mate", "load"])

    def inside(batches):
        for _, part in groups_of(batches, ["part"], 1 << 62):
            asks_ = np.flatnonzero(part.column("ask").to_numpy())
            z, names, tie = matrix(part), part.column("id").to_numpy(), part.column("tie").to_numpy()
            if len(z) < 2 or not len(asks_):
                continue
            index, far = _closest(z[asks_], z, min(k, len(z) - 1), asks_, tie)
            yield rows_out(names[asks_], far, index, names, tie, matrix(part, "load", wide) if carry else None)

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.select("part", "id", "tie", "z", "ask", *extra).repartition(width, "part").sortWithinPartitions("part", "tie", "id")
    found = dealt.mapInArrow(inside, result)
    if parts > 1:
        found = settled(found)
        boxes = placed.groupBy("part").agg(*[f(ref("z")[i]) for f in (F.min, F.max) for i in range(d)]).collect()  # one row a part
        low, high = np.full((parts, d), np.inf), np.full((parts, d), -np.inf)
        for part, *box in boxes:
            low[part], high[part] = box[:d], box[d:]
        shared = spark.sparkContext.broadcast(cells.bounded(low, high))
        bound = found.select("id", F.when(F.size("far") >= k, F.array_max("far")).alias("bound"))
        asking_ = placed.where("ask").join(bound, "id", "left").select("id", "z", "part", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

        def ask(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    mine = batch.slice(lo, 1024)
                    i, part = shared.value.within(matrix(mine), mine.column("bound").to_numpy())
                    other = part != mine.column("part").to_numpy()[i]
                    i, part = i[other], part[other]
                    for a in range(0, len(i), 4096):
                        rows_ = mine.take(pa.array(i[a : a + 4096]))
                        yield pa.RecordBatch.from_arrays([rows_.column("id"), rows_.column("z"), rows_.column("bound"), pa.array(part[a : a + 4096].astype(np.int32))], names=["id", "z", "bound", "part"])

        asks = settled(asking_.mapInArrow(ask, "id long, z array<double>, bound double, part int"))
        blocks = settled(asks.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / 10_000).cast("int").alias("blocks")))
        h = F.pmod(F.xxhash64("id"), ref("blocks")).cast("int")
        none = [F.array().cast("array<double>").alias(c) for c in extra]
        left = asks.join(blocks, "part").select("part", h.alias("block"), F.lit(1).alias("asks"), "id", F.lit(0).cast("long").alias("tie"), "z", "bound", *none)
        right = placed.join(blocks, "part").select(
            "part", F.explode(F.sequence(F.lit(0), ref("blocks") - 1)).alias("block"), F.lit(0).alias("asks"), "id", "tie", "z", F.lit(0.0).alias("bound"), *extra
        )

        def across(batches):
            for _, part in groups_of(batches, ["part", "block"], 1 << 62):
                asks_ = part.column("asks").to_numpy() > 0
                if not asks_.any():
                    continue
                z, names, tie = matrix(part), part.column("id").to_numpy(), part.column("tie").to_numpy()
                index, far = _closest(z[asks_], z[~asks_], k, None, tie[~asks_])
                load = matrix(part.filter(pa.array(~asks_)), "load", wide) if carry else None
                yield rows_out(names[asks_], far, index, names[~asks_], tie[~asks_], load, part.column("bound").to_numpy()[asks_])

        met = left.union(right).repartition(width, "part", "block").sortWithinPartitions("part", "block", "asks", "tie", "id")
        found = found.union(met.mapInArrow(across, result))
    return found


def smote(
    df: DataFrame,
    label: str,
    minority: object,
    features: Sequence[str],
    key: Sequence[str],
    neighbours: int = 5,
    over_ratio: float = 1.0,
    seed: int = 1,
    block_rows: int = 1000,
) -> DataFrame:
    """Add minority rows between a minority row and one of its nearest minority neighbours until
    the minority has about ``over_ratio`` times the other rows.

    Neighbours are exact, by the distance of standardised features, whatever the number of rows (see :func:`nearest_rows`), and looked for only where a row gets new ones. Which neighbour a new row
    lies towards, and how far, follows from row key and seed. The new rows carry the other columns of the row they start from.
    """
    is_minor = ref(label) == F.lit(minority)
    stats = df.agg(
        F.sum(is_minor.cast("long")).alias("_n"),
        F.count(ref(label)).alias("_all"),
        *[F.avg(F.when(is_minor, ref(c))).alias(f"_m{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(F.when(is_minor, ref(c))).alias(f"_s{i}") for i, c in enumerate(features)],
    ).first()
    n = stats["_n"] or 0
    others = stats["_all"] - n
    missing = over_ratio * others - n
    if n < 2 or missing <= 0:
        return df
    per_row = missing / n
    keys = [ref(c) for c in key]
    scaled = [
        F.coalesce((ref(c).cast("double") - F.lit(stats[f"_m{i}"])) / F.lit(stats[f"_s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)
    ]
    extra = F.lit(math.floor(per_row)) + (hash_unit(*keys, seed=seed) < F.lit(per_row % 1)).cast("int")
    typed = df.select(*[ref(c).cast("double").alias(c) if c in set(features) else ref(c) for c in df.columns])
    minor = settled(typed.where(is_minor).select(
        F.struct(*[ref(c) for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("id"), F.xxhash64(*keys, F.lit(seed)).alias("tie"),
        F.array(*scaled).alias("z"), extra.alias("extra"),
    ))
    near = nearest_rows(minor, neighbours, block_rows, asking=ref("extra") > 0)
    copies = minor.where("extra > 0").join(near, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), ref("extra"))))
    base = [ref("row")[c] for c in key]
    pick = F.get("mates", F.pmod(F.xxhash64(*base, ref("copy"), F.lit(seed + 2)), F.size("mates")).cast("int"))
    chosen = copies.select("row", pick.alias("mate"), hash_unit(*base, ref("copy"), seed=seed + 3).alias("share"))
    ends = minor.select(F.col("id").alias("mate"), F.struct(*[ref("row")[c].alias(f"f{i}") for i, c in enumerate(features)]).alias("to"))
    both = chosen.join(ends, "mate")
    place = {c: i for i, c in enumerate(features)}

    def value(c: str) -> Column:
        here = ref("row")[c]
        return here if c not in place else here + ref("share") * (ref("to")[f"f{place[c]}"] - here)

    return typed.unionByName(both.select(*[value(c).alias(c) for c in df.columns]))


@dataclass(frozen=True)
class Resample:
    """A training part: all rows but those of one fold, whose column is ``_f<repeat>``; ``seed`` is that of its oversampling."""

    repeat: int
    fold: int
    seed: int

    @property
    def trained(self) -> Column:
        return ref(f"_f{self.repeat}") != self.fold


def jobs_of(resamples: Sequence[Resample]) -> Column:
    """The places of the resamples whose training part holds the row."""
    return F.array_compact(F.array(*[F.when(r.trained, F.lit(i)) for i, r in enumerate(resamples)]))


def hashed(h: np.ndarray, value: np.ndarray | int, long: bool) -> np.ndarray:
    """``xxhash64(keys..., value)`` from ``h``, the ``xxhash64(keys...)``: its last step, for an int or a long."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray | np.uint64, by: int) -> np.ndarray | np.uint64:
        return (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        v, value = h.astype(np.int64).view(np.uint64) + five, np.asarray(value).astype(np.uint64)
        if long:
            v = turned((v + np.uint64(8)) ^ (turned(value * two, 31) * one), 27) * one + four
        else:
            v = turned((v + np.uint64(4)) ^ (value * one), 23) * two + three
        v = (v ^ (v >> np.uint64(33))) * two
        v = (v ^ (v >> np.uint64(29))) * three
        return (v ^ (v >> np.uint64(32))).view(np.int64)


def seeded_hash(h: np.ndarray, seed: int) -> np.ndarray:
    """:func:`hashed` with the seed of a job as ``lit`` types it: an int, or a long above the ints."""
    return hashed(h, seed, seed >= 1 << 31)


def unit_of(h: np.ndarray) -> np.ndarray:
    """The number that :func:`~riskloom.functions.numeric.hash_unit` makes of a hash."""
    return (h.view(np.uint64) >> np.uint64(11)) / float(1 << 53)


def enough_mates(k: int, share: float, missed: float = 1e-9) -> int:
    """So many nearest rows, that fewer than ``k`` of them (four kept as a margin) are in a training part of that share of the rows with a chance of ``missed`` at most."""
    n = k
    while sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k)) > missed and n < 500:
        n += 1
    return n + 4


def smote_resamples(
    df: DataFrame, label: str, minority: object, features: Sequence[str], key: Sequence[str], resamples: Sequence[Resample],
    neighbours: int = 5, over_ratio: float = 1.0, block_rows: int = 1000, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows that :func:`smote` adds to each training part: (_job, columns of ``df`` or those to ``keep``), ``_job`` being the place of the resample.

    The training parts differ in a share of their rows and slightly in the scale of their features, so nearest rows are looked for once among all minority rows, more
    than are needed. Of these, each training part takes its own nearest by its own distances. That they are the nearest is certain where a row outside
    the list, at least as far as the last in it, cannot be nearer in this part's scale; a row of a part where it is not certain, or where equally far
    neighbours share a key and differ, is looked for again in that part alone. ``df`` has the fold columns of the resamples.

    Minority rows lie in the cells of a k-d tree; neighbouring cells make a region, which one task searches. Rows of other regions that may be near come along: those
    as close to the box of a cell as its farthest list reaches inside it. No list of neighbours leaves a task, only new rows.
    """
    spark, d, keys = df.sparkSession, len(features), [ref(c) for c in key]
    is_minor = ref(label) == F.lit(minority)
    typed = df.select(*[ref(c).cast("double").alias(c) if c in set(features) else ref(c) for c in df.columns])
    measures = [
        F.sum(is_minor.cast("long")).alias("_n"), F.count(ref(label)).alias("_all"),
        *[F.avg(F.when(is_minor, ref(c))).alias(f"_m{i}") for i, c in enumerate(features)],
        *[F.stddev_samp(F.when(is_minor, ref(c))).alias(f"_s{i}") for i, c in enumerate(features)],
    ]
    per = {r["_job"]: r for r in typed.withColumn("_job", F.explode(jobs_of(resamples))).groupBy("_job").agg(*measures).collect()}
    whole = typed.agg(*measures).first()
    middle = lambda r: np.array([r[f"_m{i}"] if r[f"_m{i}"] is not None else 0.0 for i in range(d)])
    spread = lambda r: np.array([r[f"_s{i}"] or 1.0 for i in range(d)])
    asked: dict[int, float] = {}  # new rows for each row
    for job in range(len(resamples)):
        n = per[job]["_n"] or 0 if job in per else 0
        missing = over_ratio * (per[job]["_all"] - n) - n if n else 0
        if n >= 2 and missing > 0:
            asked[job] = missing / n
    columns = [c for c in df.columns if keep is None or c in {*keep, *features}]
    carried = [c for c in columns if c not in set(features)]
    if not asked:
        return typed.select(F.lit(0).alias("_job"), *[ref(c) for c in columns]).where(F.lit(False))
    most = max(enough_mates(neighbours, per[job]["_n"] / whole["_n"]) for job in asked)
    repeats, folds = sorted({r.repeat for r in resamples}), max(r.fold for r in resamples) + 1
    place_of = sum((ref(f"_f{r}").cast("long") * folds**i for i, r in enumerate(repeats)), F.lit(0).cast("long"))
    others = [c for c in df.columns if c not in set(features)]
    minor = settled(typed.where(is_minor).select(
        F.struct(*[ref(c) for c in others]).alias("row"), F.monotonically_increasing_id().alias("id"), F.xxhash64(*keys).alias("tie"), place_of.alias("place"),
        *[ref(c).alias(f"x{i}") for i, c in enumerate(features)],
    ))
    scales = {job: (middle(per[job]), spread(per[job]), folds ** repeats.index(resamples[job].repeat), resamples[job].fold, resamples[job].seed) for job in asked}
    all_middle, all_spread, names = middle(whole), spread(whole), [f"x{i}" for i in range(d)]

    def matrix(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([part.column(c).to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part.column(c).to_numpy() for c in names], axis=1).astype(float)

    def standard(x: np.ndarray) -> np.ndarray:
        return np.nan_to_num((x - all_middle) / all_spread, nan=0.0)

    def copies(tie: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(row, job): how many new rows start from it."""
        out = np.zeros((len(tie), len(resamples)), np.int64)
        for job, (_, _, step, fold, seed) in scales.items():
            extra = math.floor(asked[job]) + (unit_of(hashed(tie, seed, True)) < asked[job] % 1)
            out[:, job] = np.where(place // step % folds != fold, extra, 0)
        return out

    n, step = int(whole["_n"]), math.ceil(whole["_n"] / 50_000)
    sample = standard(matrix(minor.where(F.pmod(F.xxhash64("tie"), F.lit(step)) == 0).select(*names).toArrow())) if n > block_rows else np.zeros((0, d))
    cells = Cells.grown(sample, block_rows / step)
    parts = int(cells.parts.sum())
    cores = spark.sparkContext.defaultParallelism
    joined = min(64, max(1, parts // (4 * cores)))  # cells of a region: numbers that follow each other lie side by side
    regions = math.ceil(parts / joined)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cells.leaf(standard(matrix(batch)))
            # a point that many rows share makes a leaf of several parts: its rows are dealt over them
            part = (cells.first[leaf] + batch.column("tie").to_numpy() % cells.parts[leaf]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(part // joined)], names=[*batch.schema.names, "part", "region"])

    def with_part(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(dealt, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, region int").fields]))

    def reach_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in groups_of(batches, ["part"], 1 << 62):
            z = standard(matrix(rows))
            asks = np.flatnonzero(copies(rows.column("tie").to_numpy(), rows.column("place").to_numpy()).any(axis=1))
            reach = -1.0 if not len(asks) else np.inf if len(z) <= most else _closest(z[asks], z, most, asks)[1][:, -1].max()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(reach)]), pa.array([z.min(axis=0)]), pa.array([z.max(axis=0)])], names=["part", "reach", "low", "high"])

    own = [ref("region"), ref("part"), ref("tie"), ref("place"), *[ref(c) for c in names], ref("id"), F.struct(*[ref("row")[c].alias(c) for c in carried]).alias("row") if carried else F.lit(None).cast("int").alias("row")]
    searched = with_part(minor).select(*own)
    if parts > 1:
        slim = with_part(minor.select("tie", "place", *names))
        found = slim.repartition(regions, "region").sortWithinPartitions("part").mapInArrow(reach_of, "part int, reach double, low array<double>, high array<double>").collect()  # one row a part
        low, high, reach = np.full((parts, d), np.inf), np.full((parts, d), -np.inf), np.full(parts, -1.0)
        for r in found:
            low[r["part"]], high[r["part"]], reach[r["part"]] = r["low"], r["high"], r["reach"]
        shared = spark.sparkContext.broadcast((cells.bounded(low, high), reach))

        def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes, reach = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    mine = batch.slice(lo, 1024)
                    i, part = boxes.reaching(standard(matrix(mine)), reach)
                    pairs = np.unique(np.stack((i, part // joined), axis=1), axis=0)
                    pairs = pairs[pairs[:, 1] != mine.column("region").to_numpy()[pairs[:, 0]]]
                    for a in range(0, len(pairs), 8192):
                        rows = mine.take(pa.array(pairs[a : a + 8192, 0]))
                        arrays = [pa.array(pairs[a : a + 8192, 1].astype(np.int32)), pa.array(np.full(rows.num_rows, -1, np.int32)), *[rows.column(c) for c in ("tie", "place", *names)]]
                        yield pa.RecordBatch.from_arrays(arrays, names=["region", "part", "tie", "place", *names])

        loans = slim.mapInArrow(lent, f"region int, part int, tie long, place long, {', '.join(f'{c} double' for c in names)}")
        searched = searched.unionByName(loans, allowMissingColumns=True)

    def near(asks: np.ndarray, among: np.ndarray, z: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest others of each row, as places (-1: none), and the distance of the last (inf: all are listed)."""
        index, far = np.full((len(asks), 0), -1), np.zeros((len(asks), 0))
        for a in range(0, max(1, len(among)), 1 << 14):  # bounds the memory
            mine = among[a : a + (1 << 14)]
            more, gap = _closest(z[asks], z[mine], most + 1, None, tie[mine])
            index, far = np.concatenate((index, mine[more]), axis=1), np.concatenate((far, gap), axis=1)
            if index.shape[1] > more.shape[1]:
                order = np.lexsort((tie[index], far), axis=1)[:, : most + 1]
                index, far = np.take_along_axis(index, order, axis=1), np.take_along_axis(far, order, axis=1)
        order = np.argsort(index == asks[:, None], axis=1, kind="stable")  # the row itself goes last
        index, far = (np.take_along_axis(v, order, axis=1) for v in (index, far))
        index[:, -1:] = np.where(index[:, -1:] == asks[:, None], -1, index[:, -1:])
        index = index[:, :most]
        if index.shape[1] < most:
            index = np.pad(index, ((0, 0), (0, most - index.shape[1])), constant_values=-1)
        return index, np.where((index < 0).any(axis=1), np.inf, far[:, min(most, far.shape[1]) - 1])

    def distances(a: np.ndarray, b: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
        total = np.zeros(b.shape[:2])
        for c in range(d):  # column by column: no cancellation
            total += ((a[:, None, c] - m[c]) / s[c] - (b[:, :, c] - m[c]) / s[c]) ** 2
        return np.sqrt(total)

    def made_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches, ["region"], 1 << 62):
            x, tie, place, part = matrix(rows), rows.column("tie").to_numpy(), rows.column("place").to_numpy(), rows.column("part").to_numpy()
            z = standard(x)
            for one in np.unique(part[part >= 0]):
                inside = np.flatnonzero(part == one)
                wanted = copies(tie[inside], place[inside])
                some = np.flatnonzero(wanted.any(axis=1))
                if not len(some):
                    continue
                asks, among = inside[some], np.arange(len(z))
                bound = _closest(z[asks], z[inside], most, some)[1][:, -1] if len(inside) > most else np.full(len(asks), np.inf)
                if len(inside) > most:
                    gap = np.maximum(np.maximum(z[asks].min(axis=0) - z, z - z[asks].max(axis=0)), 0)
                    among = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= bound.max() * (1 + 1e-9))
                index, limit = np.empty((len(asks), most), np.int64), np.empty(len(asks))
                leaf = Cells.grown(z[asks], 96).leaf(z[asks])
                for group in np.split(np.argsort(leaf, kind="stable"), np.flatnonzero(np.diff(np.sort(leaf))) + 1):
                    mine = z[asks[group]]
                    gap = np.maximum(np.maximum(mine.min(axis=0) - z[among], z[among] - mine.max(axis=0)), 0)
                    close = among[np.sqrt((gap * gap).sum(axis=1)) <= bound[group].max() * (1 + 1e-9)]
                    index[group], limit[group] = near(asks[group], close, z, tie)
                with np.errstate(invalid="ignore", over="ignore"):
                    yield from new_rows(rows, asks, wanted[some], index, limit, x, tie, place)

    def new_rows(rows: pa.Table, asks: np.ndarray, wanted: np.ndarray, index: np.ndarray, limit: np.ndarray, x: np.ndarray, tie: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        nowhere = index < 0
        for job, (m, s, step, fold, seed) in scales.items():
            i = np.flatnonzero(wanted[:, job])
            if not len(i):
                continue
            times = wanted[i, job]
            again = np.repeat(np.arange(len(i)), times)
            copy = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times) + 1
            start = hashed(tie[asks[i]][again], copy, False)
            h, share = seeded_hash(start, seed + 2), unit_of(hashed(start, seed + 3, True))
            them, here = index[i], x[asks[i]]
            gap = distances(here, x[them], m, s)
            gap[nowhere[i] | (place[them] // step % folds == fold)] = np.inf
            order = np.argsort(gap, axis=1, kind="stable")
            sorted_ = np.take_along_axis(gap, order, axis=1)[:, : neighbours + 1]
            equal = np.flatnonzero(((sorted_[:, 1:] == sorted_[:, :-1]) & np.isfinite(sorted_[:, 1:])).any(axis=1))
            order[equal] = np.lexsort((seeded_hash(tie[them[equal]], seed), gap[equal]), axis=-1)
            order = order[:, : neighbours + 1]
            gap, them = np.take_along_axis(gap, order, axis=1), np.take_along_axis(them, order, axis=1)
            have = np.minimum(np.isfinite(gap).sum(axis=1), neighbours)
            sure = np.isinf(limit[i]) | (gap[:, :neighbours].max(axis=1) < limit[i] * (all_spread / s).min(initial=1.0) * (1 - 1e-9))
            alike = (gap[:, 1:] == gap[:, :-1]) & np.isfinite(gap[:, 1:]) & (tie[them[:, 1:]] == tie[them[:, :-1]])
            sure &= ~(alike & (x[them[:, 1:]] != x[them[:, :-1]]).any(axis=2)).any(axis=1) & (have > 0)
            to = x[them[again, h % np.maximum(have[again], 1)]]
            made = here[again] + share[:, None] * (to - here[again])
            base, sure = pa.array(asks[i][again]), sure[again]
            arrays = [rows.column("row").take(base).combine_chunks(), pa.array(rows.column("id").to_numpy()[asks[i]][again], pa.int64(), mask=sure), pa.array(np.full(len(again), job, np.int32)), *[pa.array(made[:, c]) for c in range(d)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "job", *names])

    schema = T.StructType([searched.schema["row"], *T.StructType.fromDDL(f"id long, job int, {', '.join(f'{c} double' for c in names)}")])
    ready = searched.repartition(regions, "region").sortWithinPartitions("region", "part", "tie", "id")
    made = settled(ready.mapInArrow(made_in, schema))  # ``id`` where it is not certain
    place = {c: i for i, c in enumerate(features)}
    rows = made.where("id IS NULL").select(ref("job").alias("_job"), *[ref(f"x{place[c]}").alias(c) if c in place else ref("row")[c].alias(c) for c in columns])
    again = made.where("id IS NOT NULL").select("id", "job").distinct()
    unsure = sorted(r["job"] for r in again.select("job").distinct().collect())
    for job in unsure:
        resample, field = resamples[job], lambda c: ref(f"x{place[c]}") if c in place else ref("row")[c]
        own_keys, scaled = [field(c) for c in key], [F.coalesce((ref(f"x{i}") - F.lit(m)) / F.lit(s), F.lit(0.0)) for i, (m, s) in enumerate(zip(middle(per[job]).tolist(), spread(per[job]).tolist()))]
        mine = again.where(ref("job") == job).select("id", F.lit(True).alias("ask"))
        part = settled(minor.where(field(f"_f{resample.repeat}") != resample.fold).join(mine, "id", "left").select(
            "id", "row", *names, F.xxhash64(*own_keys, F.lit(resample.seed)).alias("tie"), F.array(*scaled).alias("z"), F.coalesce("ask", F.lit(False)).alias("ask")
        ))
        alone = nearest_rows(part.select("id", "tie", "z", "ask"), neighbours, block_rows, asking=ref("ask"))
        extra = F.lit(math.floor(asked[job])) + (hash_unit(*own_keys, seed=resample.seed) < F.lit(asked[job] % 1)).cast("int")
        picked = part.where("ask").join(alone, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), extra))).select(
            "row", *names, F.get("mates", F.pmod(F.xxhash64(*own_keys, ref("copy"), F.lit(resample.seed + 2)), F.size("mates")).cast("int")).alias("id"),
            hash_unit(*own_keys, ref("copy"), seed=resample.seed + 3).alias("share"),
        )
        both = picked.join(part.select("id", *[ref(c).alias(f"to_{c}") for c in names]), "id")
        rows = rows.unionByName(both.select(F.lit(job).alias("_job"), *[
            (ref(f"x{place[c]}") + ref("share") * (ref(f"to_x{place[c]}") - ref(f"x{place[c]}"))).alias(c) if c in place else ref("row")[c].alias(c) for c in columns
        ]))
    if not unsure:
        drop_settled(minor)
    return rows


def _yeo_johnson_sql(x: str, lam: float) -> str:
    """Transform at one lambda as SQL text, so that it can be stored with a model."""
    up = f"log1p({x})" if abs(lam) < 1e-9 else f"(pow({x} + 1D, {lam!r}D) - 1D) / {lam!r}D"
    two = 2 - lam
    down = f"-log1p(-({x}))" if abs(two) < 1e-9 else f"-(pow(1D - {x}, {two!r}D) - 1D) / {two!r}D"
    return f"CASE WHEN {x} >= 0 THEN {up} WHEN {x} < 0 THEN {down} END"


def yeo_johnson(x: Column, lam: Column) -> Column:
    two = F.lit(2.0) - lam
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / two)
    return F.when(x >= 0, up).when(x < 0, down)


def _profile_likelihood(df: DataFrame, columns: Sequence[str], grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """(name, lam, ll). A task adds up count, mean and squares about it for all lambdas of all columns; Spark joins the tasks' sums."""
    names, tried = list(columns), [np.asarray(grids[c], float) for c in columns]

    def powered(part: np.ndarray, lam: float) -> np.ndarray:
        return part if abs(lam) < 1e-9 else np.expm1(lam * part) / lam

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(lams), 3)) for lams in tried]
        j = np.zeros(len(names))
        for batch in batches:
            for i, lams in enumerate(tried):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                for at in range(0, len(x), 1 << 14):
                    mine = x[at : at + (1 << 14)]
                    up, down = np.log1p(mine[~(mine < 0)]), np.log1p(-mine[mine < 0])
                    j[i] += up.sum() - down.sum()
                    n = len(mine)
                    for at_, lam in enumerate(lams):
                        with np.errstate(over="ignore", invalid="ignore"):
                            t = np.concatenate((powered(up, lam), -powered(down, 2 - lam))) if len(down) else powered(up, lam)
                            mean = t.mean()
                            held, middle, squares = total[i][at_]
                            gap = mean - middle
                            both = held + n
                            total[i][at_] = both, middle + gap * n / both, squares + ((t - mean) ** 2).sum() + gap * gap * held * n / both
        which = np.repeat(np.arange(len(names)), [len(lams) for lams in tried])
        cells = np.concatenate(total)
        used = cells[:, 0] > 0
        arrays = [which[used], np.concatenate(tried)[used], *cells[used].T, j[which[used]]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["i", "lam", "n", "mean", "squares", "j"])

    wide = df.select(*[ref(c).cast("double").alias(c) for c in columns])
    parts = wide.mapInArrow(sums, "i long, lam double, n double, mean double, squares double, j double")
    whole = Window.partitionBy("i", "lam")  # a row for each task
    parts = parts.withColumn("middle", F.sum(ref("n") * ref("mean")).over(whole) / F.sum("n").over(whole))
    per = parts.groupBy("i", "lam").agg(
        F.sum("n").alias("n"), (F.sum(ref("squares") + ref("n") * F.pow(ref("mean") - ref("middle"), 2)) / F.sum("n")).alias("v"), F.sum("j").alias("j")
    )
    name = F.get(F.array(*[F.lit(c) for c in names]), ref("i").cast("int"))
    return per.select(name.alias("name"), "lam", F.when(ref("v") > 0, -ref("n") / 2 * F.log("v") + (ref("lam") - 1) * ref("j")).alias("ll"))


def yeo_johnson_lambdas(df: DataFrame, columns: Sequence[str], low: float = -3.0, high: float = 3.0) -> dict[str, float]:
    """Lambda of largest likelihood per column, by a coarse and a fine grid: two aggregations over
    all columns. A constant column keeps 1, which leaves it as it is."""
    coarse = {c: list(np.round(np.arange(low, high + 0.01, 0.25), 6)) for c in columns}
    best = _best_lambda(_profile_likelihood(df, columns, coarse))
    fine = {c: list(np.round(best.get(c, 1.0) + np.arange(-0.25, 0.2501, 0.025), 6)) for c in columns}
    best |= _best_lambda(_profile_likelihood(df, columns, fine))
    return {c: best.get(c, 1.0) for c in columns}


def _best_lambda(table: DataFrame) -> dict[str, float]:
    top = table.where("ll IS NOT NULL").groupBy("name").agg(F.max_by("lam", "ll").alias("lam"))
    return {r["name"]: r["lam"] for r in top.collect()}


def learn_scaling(
    df: DataFrame, columns: Sequence[str], suffix: str = "", lambdas: Mapping[str, float] | None = None, power: bool = True
) -> Transformer:
    """Power transform, centre and scale learnt on ``df``, as a storable pipeline stage.

    Columns are replaced, or written under ``suffix``. A 0/1 column is only centred and scaled: a
    power transform of two values is again a linear map.
    """
    if power and lambdas is None:
        spans = df.agg(*[F.count_if((ref(c) != 0) & (ref(c) != 1)).alias(c) for c in columns]).first()
        lambdas = yeo_johnson_lambdas(df, [c for c in columns if spans[c]]) if any(spans[c] for c in columns) else {}
    lambdas = lambdas or {}
    texts = _scaling_texts(columns, lambdas)
    stats = df.agg(
        *[F.avg(F.expr(t)).alias(f"m{i}") for i, t in enumerate(texts.values())],
        *[F.stddev_samp(F.expr(t)).alias(f"s{i}") for i, t in enumerate(texts.values())],
    ).first()
    return Scaling(lambdas, {c: (stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)}).stage(columns, suffix)


def _scaling_texts(columns: Sequence[str], lambdas: Mapping[str, float]) -> dict[str, str]:
    return {c: _yeo_johnson_sql(f"`{c}`", lambdas[c]) if c in lambdas else f"CAST(`{c}` AS DOUBLE)" for c in columns}


@dataclass
class Scaling:
    """Lambda (columns without one stay), centre and spread of columns."""

    lambdas: Mapping[str, float]
    moments: Mapping[str, tuple[float, float]]

    def stage(self, columns: Sequence[str], suffix: str = "", given: Callable[[str], str] = str) -> SQLTransformer:
        """``given`` tells the name under which the scaling knows a column."""
        texts = _scaling_texts(columns, {c: self.lambdas[given(c)] for c in columns if given(c) in self.lambdas})
        made = []
        for c, text in texts.items():
            mean, sd = self.moments[given(c)]
            made.append(f"(({text}) - {float(mean)!r}D) / {float(sd)!r}D AS `{c}{suffix}`")
        kept = "*" if suffix else f"* EXCEPT ({', '.join(f'`{c}`' for c in columns)})"
        return SQLTransformer(statement=f"SELECT {', '.join([kept, *made])} FROM __THIS__")


def powered(x: np.ndarray, lam: float) -> np.ndarray:
    """The power transform of :func:`yeo_johnson`."""
    up, down = np.log1p(np.maximum(x, 0)), np.log1p(-np.minimum(x, 0))
    return np.where(x >= 0, up if abs(lam) < 1e-9 else np.expm1(lam * up) / lam, -down if abs(2 - lam) < 1e-9 else -np.expm1((2 - lam) * down) / (2 - lam))


def joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, mean and squares about it (along the last axis) of two sets of values together."""
    n = a[..., 0] + b[..., 0]
    gap, safe = b[..., 1] - a[..., 1], np.maximum(n, 1)
    return np.stack((n, a[..., 1] + gap * b[..., 0] / safe, a[..., 2] + b[..., 2] + gap * gap * a[..., 0] * b[..., 0] / safe), axis=-1)


def _cell_moments(rows: DataFrame, columns: Sequence[str], grids: Sequence[np.ndarray], repeats: Sequence[int], folds: int, jobs: int) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each column and cell: (count, mean, squares about it) by lambda, and (sum of signed logarithms, values other than 0 and 1).

    A cell holds the given rows of one fold of a repeat, or the rows added for one job. Tasks hand on a block for each cell and column, which Spark brings together; rows have no null.
    """
    first_job = len(repeats) * folds
    names = [*columns, "_job", *[f"_f{r}" for r in repeats]]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((first_job + jobs, len(lams), 3)) for lams in grids]
        side = np.zeros((len(grids), first_job + jobs, 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                n = part.num_rows
                job = part.column(len(grids)).fill_null(-1).to_numpy(zero_copy_only=False)
                given, made = np.flatnonzero(job < 0), np.flatnonzero(job >= 0)
                held = np.zeros((first_job + jobs, n))
                for i in range(len(repeats)):
                    held[i * folds + part.column(len(grids) + 1 + i).fill_null(0).to_numpy(zero_copy_only=False)[given], given] = 1
                held[first_job + job[made], made] = 1
                count = held.sum(axis=1)
                for i, lams in enumerate(grids):
                    x = part.column(i).to_numpy(zero_copy_only=False)
                    up, down, sign = np.log1p(np.maximum(x, 0)), np.log1p(-np.minimum(x, 0)), x >= 0
                    side[i] += held @ np.column_stack((up - down, (x != 0) & (x != 1)))
                    with np.errstate(over="ignore", invalid="ignore"):
                        t = np.empty((n, len(lams)))
                        for k, lam in enumerate(lams):
                            t[:, k] = up if abs(lam) < 1e-9 else np.expm1(lam * up) / lam
                            if not sign.all():
                                t[~sign, k] = -down[~sign] if abs(2 - lam) < 1e-9 else -np.expm1((2 - lam) * down[~sign]) / (2 - lam)
                        middle = t[0] + (t - t[0]).mean(axis=0)  # exact where all are alike
                        t -= middle
                        one, two = held @ t, held @ (t * t)
                        mean = one / np.maximum(count, 1)[:, None]
                        block = np.stack((np.broadcast_to(count[:, None], mean.shape), middle + mean, np.maximum(two - one * mean, 0)), axis=-1)
                        block[count == 0] = 0
                        total[i] = joined_moments(total[i], block)
        for i in range(len(grids)):
            used = np.flatnonzero(total[i][:, 0, 0] > 0)
            arrays = [pa.array(np.full(len(used), i)), pa.array(used), pa.array([total[i][c].ravel() for c in used], pa.list_(pa.float64())), pa.array([side[i, c] for c in used], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "cell", "v", "side"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, cell), part in groups_of(batches, ["i", "cell"], 1 << 62):
            held, side = None, np.zeros(2)
            for v, more in zip(part.column("v").to_pylist(), part.column("side").to_pylist()):
                v = np.array(v).reshape(-1, 3)
                held, side = v if held is None else joined_moments(held, v), side + more
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([cell]), pa.array([held.ravel()]), pa.array([side])], names=["i", "cell", "v", "side"])

    shape = "i long, cell long, v array<double>, side array<double>"
    wide = rows.select(*[ref(c) for c in names]).mapInArrow(sums, shape)
    out: list[dict] = [{} for _ in grids]
    for r in wide.repartition("i", "cell").sortWithinPartitions("i", "cell").mapInArrow(merged, shape).collect():  # a row for each column and cell
        out[r["i"]][r["cell"]] = np.array(r["v"]).reshape(-1, 3), np.array(r["side"])
    return out


def scalings(rows: DataFrame, columns: Sequence[str], resamples: Sequence[Resample], folds: int, low: float = -3.0, high: float = 3.0) -> list[Scaling]:
    """What :func:`learn_scaling` learns on the training part of each resample, in two passes over the rows for all of them.

    ``rows`` are the given ones, ``_job`` null, with their fold columns, and those of :func:`smote_resamples`; columns are doubles without null.
    """
    repeats = sorted({r.repeat for r in resamples})

    def parts(grids: Sequence[np.ndarray]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        found = _cell_moments(rows, columns, grids, repeats, folds, len(resamples))
        out = []
        for job, resample in enumerate(resamples):
            start = repeats.index(resample.repeat) * folds
            cells = [*[start + f for f in range(folds) if f != resample.fold], len(repeats) * folds + job]
            mine = []
            for i, lams in enumerate(grids):
                held, side = np.zeros((len(lams), 3)), np.zeros(2)
                for v, more in (found[i][c] for c in cells if c in found[i]):
                    held, side = joined_moments(held, v), side + more
                mine.append((held, side))
            out.append(mine)
        return out

    def best(lams: np.ndarray, held: np.ndarray, side: np.ndarray) -> float | None:
        n = np.maximum(held[:, 0], 1)
        v = np.where(held[:, 2] > 1e-24 * n * held[:, 1] ** 2, held[:, 2], 0) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(v > 0, -n / 2 * np.log(v) + (lams - 1) * side[0], np.nan)
        return None if np.isnan(ll).all() else float(lams[np.nanargmax(ll)])

    coarse = np.round(np.arange(low, high + 0.01, 0.25), 6)
    first = parts([coarse] * len(columns))
    middles = [[best(coarse, *cell) if cell[1][1] else None for cell in mine] for mine in first]
    steps = np.arange(-0.25, 0.2501, 0.025)
    fine = [np.unique(np.round(np.concatenate([(1.0 if m[i] is None else m[i]) + steps for m in middles] + [[1.0]]), 6)) for i in range(len(columns))]
    out = []
    for middle, mine, before in zip(middles, parts(fine), first):
        lambdas, moments = {}, {}
        for i, c in enumerate(columns):
            held, side = mine[i]
            lam = 1.0
            if side[1]:  # values of 0 and 1 only are centred and scaled as they are
                near = np.isin(fine[i], np.round((1.0 if middle[i] is None else middle[i]) + steps, 6))
                found = best(fine[i][near], held[near], side)
                lam = lambdas[c] = found if found is not None else 1.0 if middle[i] is None else middle[i]
            n, mean, squares = held[np.flatnonzero(fine[i] == lam)[0]]
            flat = n < 2 or not squares > 1e-24 * n * mean * mean
            moments[c] = float(mean), 1.0 if flat else math.sqrt(squares / (n - 1))
        out.append(Scaling(lambdas, moments))
    return out


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    long = df.select(*[ref(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "x")
    return {r["name"]: r["median"] for r in exact_quantiles(long, ["name"], "x", MEDIAN).collect()}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill gaps by the exact column median."""
    found = _medians(df, columns)
    return df.withColumns({c: F.coalesce(ref(c).cast("double"), F.lit(found.get(c))) for c in columns})


def impute_trees(
    df: DataFrame, columns: Sequence[str], factors: Sequence[str] = (), trees: int = 10, depth: int = 8, seed: int = 1
) -> DataFrame:
    """Fill gaps of each column and factor by bagged trees on all the others (factors as 0/1 columns).

    Gaps in the predictors of a tree take the column median. Identifier columns are left out by not
    naming them. One fit per column that has gaps.
    """
    gaps = set(columns_with_nulls(df.select(*[ref(c) for c in [*columns, *factors]])))
    if not gaps:
        return df
    middle = _medians(df, columns)
    helpers = {f"_h_{c}": F.coalesce(ref(c).cast("double"), F.lit(middle.get(c, 0.0))) for c in columns}
    levels = {f: factor_levels(df, f) for f in factors}
    for f in factors:
        for i, level in enumerate(levels[f]):
            helpers[f"_h_{f}_{i}"] = F.coalesce((ref(f) == F.lit(level)).cast("double"), F.lit(0.0))
    work = df.withColumns(helpers)
    for c in columns:
        if c not in gaps:
            continue
        inputs = [h for h in helpers if h != f"_h_{c}"]
        packed = VectorAssembler(inputCols=inputs, outputCol="_x").transform(work)
        tree = RandomForestRegressor(
            featuresCol="_x", labelCol="_y", predictionCol="_fill", numTrees=trees, maxDepth=depth,
            featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed,
        )
        model = tree.fit(packed.where(ref(c).isNotNull()).withColumn("_y", ref(c).cast("double")))
        work = model.transform(packed).withColumn(c, F.coalesce(ref(c).cast("double"), ref("_fill"))).drop("_x", "_fill")
    for f in factors:
        if f not in gaps or not levels[f]:
            continue
        inputs = [h for h in helpers if h not in {f"_h_{f}_{i}" for i in range(len(levels[f]))}]
        names = F.array(*[F.lit(x) for x in levels[f]])
        if len(levels[f]) == 1 or not inputs:
            work = work.withColumn(f, F.coalesce(ref(f), names[0]))
            continue
        packed = VectorAssembler(inputCols=inputs, outputCol="_x").transform(work)
        tree = RandomForestClassifier(
            featuresCol="_x", labelCol="_y", predictionCol="_fill", numTrees=trees, maxDepth=depth,
            featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed,
        )
        model = tree.fit(packed.where(ref(f).isNotNull()).withColumn("_y", (F.array_position(names, ref(f)) - 1).cast("double")))
        filled = model.transform(packed).withColumn(f, F.coalesce(ref(f), F.get(names, ref("_fill").cast("int"))))
        work = filled.drop("_x", "_fill", "rawPrediction", "probability")
    return work.select(*[ref(c) for c in df.columns])


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """Sorted levels of a category. Each becomes a model column, so there are few."""
    return sorted(r["v"] for r in df.select(ref(column).alias("v")).where("v IS NOT NULL").distinct().collect())
