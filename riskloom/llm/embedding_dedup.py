"""Near-duplicate vectors by tiled comparison along principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import components, dealt, groups_of, smallest_ids, stored
from riskloom.llm.vectors import common_length, matrix, unit, usable


def principal_axes(vectors: DataFrame, d: int) -> np.ndarray:
    """Axes (columns) of the unit vectors by falling second moment. The moments are summed over all rows by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v"), d))
                total += x.T @ x
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    cells = vectors.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    moment = np.zeros((d, d))
    for row in cells.collect():  # d x d numbers
        moment[row["i"], row["j"]] = row["s"]
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1]


def close_pairs(x: np.ndarray, y: np.ndarray, least: float, lead: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows (in principal coordinates) whose product may reach ``least``.

    Products grow by ``lead`` axes at a time; what the other axes can add is at most the product of the norms left
    there, and a pair stops as soon as that is not enough.
    """
    d, slack = x.shape[1], 1e-9
    rest = lambda z, k: np.sqrt(np.maximum(np.einsum("ij,ij->i", z[:, k:], z[:, k:]), 0))
    i, j = np.nonzero(x[:, :lead] @ y[:, :lead].T + rest(x, lead)[:, None] * rest(y, lead)[None, :] >= least - slack)
    got = np.einsum("ij,ij->i", x[i, :lead], y[j, :lead])
    for k in range(lead, d, lead):
        got = got + np.einsum("ij,ij->i", x[i, k : k + lead], y[j, k : k + lead])
        on = got + rest(x, k + lead)[i] * rest(y, k + lead)[j] >= least - slack
        i, j, got = i[on], j[on], got[on]
    return i, j


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links a-b among n indices the smallest index that each reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(rows: DataFrame, d: int, axes: np.ndarray, least: float, strip: int = 512) -> DataFrame:
    """For each pair of tiles: how many rows each class (by its number) is linked to (``b`` null), and links that span its components."""
    shared = rows.sparkSession.sparkContext.broadcast(axes)  # d x d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (left, right), part in groups_of(batches, ["left", "right"]):
            raw = unit(matrix(part.column("v"), d))
            turned = raw @ shared.value
            ids, weight, tile = (part.column(c).to_numpy() for c in ("node", "n", "tile"))
            a_rows, b_rows = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
            y, found = turned[b_rows], []
            for s in range(0, len(a_rows), strip):
                mine = a_rows[s : s + strip]
                i, j = close_pairs(turned[mine], y, least)
                i, j = mine[i], b_rows[j]
                if left == right:
                    i, j = i[i < j], j[i < j]
                exact = np.einsum("ij,ij->i", raw[i], raw[j]) >= least
                found.append((i[exact], j[exact]))
            i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
            if len(i):
                links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                some = np.flatnonzero(links)
                label = smallest_reached(len(ids), i, j)
                moved = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids[some], ids[moved]))),
                        pa.array([None] * len(some) + ids[label[moved]].tolist(), pa.int64()),
                        pa.array(links[some].astype(np.int64).tolist() + [0] * len(moved), pa.int64()),
                    ],
                    names=["a", "b", "n"],
                )

    keys = ["left", "right"]
    return stored(dealt(rows, keys).mapInArrow(run, "a long, b long, n long"), "links")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, tile_rows: int = 4096) -> DataFrame:
    """``key, n_links, component_id, kept``, one row for each row of ``df``: links are cosines of ``threshold`` or more.

    Equal vectors are one class with a count, so that copies are compared once. Classes are sorted along the first principal axis
    of all vectors and cut at quantiles into tiles of about ``tile_rows``. Two tiles are compared unless the gap
    between their ranges on that axis already forbids the cosine; inside, see ``close_pairs``. What passes is decided on the
    given values in double precision. The number of tiles, and what each row is copied to, grows with the table: comparing
    all with all is quadratic where vectors do not lie apart.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components are linked with nothing; so are rows with
    null id, which are kept. Rows that share an id and differ in their vector are looked at one by one: classes have numbers of their own.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("second"), "v"), "ok": usable("v") & F.col("id").isNotNull()})
    d = common_length(rows.where("ok"), "v")
    good = F.col("ok") & (F.size("v") == d)
    everyone = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    classes = everyone.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # the numbers stay as written
    total = classes.count()
    apart = everyone.where("not ok").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return apart
    axes = principal_axes(classes, d)
    first = df.sparkSession.sparkContext.broadcast(axes[:, 0].copy())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = unit(matrix(batch.column("v"), d)) @ first.value if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "n", "v")), pa.array(at)], names=["node", "n", "v", "at"])

    kind = classes.schema["v"].dataType.simpleString()
    # equal places are told apart by a tiny share that follows from the number
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * 1e-15
    placed = stored(classes.mapInArrow(place, f"node long, n long, v {kind}, at double").withColumn("pos", F.col("at") + share), "placed")
    tiles = -(-total // tile_rows)
    cuts = sorted(set(placed.approxQuantile("pos", [k / tiles for k in range(1, tiles)], 0.2 / tiles))) if tiles > 1 else []
    tile = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("pos"))) if cuts else F.lit(0)
    placed = placed.withColumn("tile", tile.cast("long"))
    spans = sorted(map(tuple, placed.groupBy("tile").agg(F.min("at"), F.max("at")).collect()))  # one row a tile
    angle = [(t, np.arccos(np.clip(high, -1, 1)), np.arccos(np.clip(low, -1, 1))) for t, low, high in spans]
    widest = np.arccos(threshold) + 1e-6
    partners = {t: [u for u, a, b in angle if u >= t and max(a - high, low - b) <= widest] for t, low, high in angle}
    met = {t: sorted({(t, u) for u in partners[t]} | {(u, t) for u in partners if t in partners[u]}) for t in partners}
    pairs = df.sparkSession.createDataFrame(
        [(t, a, b) for t, ps in met.items() for a, b in ps], "tile long, left long, right long"
    )
    found = _compare(placed.join(pairs, "tile").select("left", "right", "node", "n", "v", "tile"), d, axes, threshold)
    direct = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    least = smallest_ids(classes, components(found.where("b is not null").select("a", "b")))
    known = classes.select("k1", "k2", "rep", "n", "node").join(direct, F.col("node") == F.col("a"), "left").join(least, "node", "left")
    known = stored(known.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "known")
    placed_rows = everyone.where("ok").select("id", "k1", "k2").join(known, ["k1", "k2"])
    return placed_rows.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).union(apart)
