"""Hard negatives by a secondary-sort shuffle: scores sorted within anchors, windows opened by positives as the rows stream by."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import dealt, groups_of, shuffle_width, stored
from riskloom.llm.vectors import common_length, matrix

#: Scores are text between steps: their exact integers can be longer than a 64-bit integer.
FOUND = "anchor long, anchor_id long, positive boolean, score string, id long, row long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LONG = 2**63 - 1


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole doubles: in doubles where they hold them, else in Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return a @ b.T

    def exact(m):
        return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)

    return exact(a) @ exact(b).T


def small(x: np.ndarray) -> np.ndarray:
    """Rows whose products with each other are exact in doubles; the few others are worked apart from them."""
    return np.abs(x).max(axis=1, initial=0) < 2.0 ** ((53 - np.log2(max(1, x.shape[1]))) / 2)


def scores(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows of a, rows of b, products)`` of parts that together cover all pairs."""
    sa, sb = small(a), small(b)
    for i, j in ((sa, sb), (~sa, sb), (sa, ~sb), (~sa, ~sb)):
        if i.any() and j.any():
            for at in np.array_split(np.flatnonzero(i), -(-i.sum() // 64)):
                yield at, np.flatnonzero(j), products(a[at], b[j])


def first(mask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores under the mask, all that tie with the last of them by smaller id."""
    at = np.flatnonzero(mask)
    if len(at) > k:
        if score.dtype != object:  # those below the k-th score go before anything is sorted
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        return np.array(heapq.nsmallest(k, at.tolist(), key=lambda i: (-score[i], ids[i])), np.int64)
    return at


def in_order(found: DataFrame) -> RDD:
    """The rows, those of an anchor together, by falling score, positives before negatives, rising id: one shuffle that sorts as it deals."""
    keyed = found.rdd.map(lambda r: ((r.anchor, -int(r.score), not r.positive, r.id, r.row), r.anchor_id))
    return keyed.repartitionAndSortWithinPartitions(shuffle_width(found.sparkSession), lambda key: portable_hash(key[0]))


def first_of_each(rows: Iterator, k: int) -> Iterator[tuple]:
    """The first ``k`` rows of each anchor."""
    last, n = None, 0
    for (anchor, less, _, i, row), anchor_id in rows:
        last, n = (last, n + 1) if anchor == last else (anchor, 1)
        if n <= k:
            yield anchor, i, row, str(-less)


def negatives(rows: Iterator, k: int, low: int, high: int) -> Iterator[tuple]:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of sorted rows, in one pass.

    Scores fall as rows go by, so a positive opens a window, a negative is handed to each window that it is low enough for, and a window closes after ``k``
    negatives or when scores have fallen below it. What is held is the open windows of one anchor, never its rows.
    """
    last, windows = None, []
    for (anchor, less, negative, i, _), anchor_id in rows:
        score = -less
        if anchor != last:
            last, windows = anchor, []
        if not negative:
            windows.append([i, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and low * w[1] <= 100 * score]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], i, max(-LONG - 1, min(LONG, w[1])), max(-LONG - 1, min(LONG, score))


def mine(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, k: int = 3,
    low: int = 50, high: int = 95, scale: float = 256, block_rows: int = 16_384, block_anchors: int = 1024,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives for each row that ``is_anchor``.

    A component x counts as floor(scale * x), a score is the integer inner product of a row with the anchor, higher first, ties to the smaller id. An anchor's positives are
    its first ``positives`` other rows of the same label; for each the first ``k`` rows of other labels with low * positive score <= 100 * score <= high *
    positive score are returned, all if fewer. A positive below zero has none: its window is empty.

    Anchors meet all rows in blocks of bounded size. A block hands on, for each anchor, its own first positives; sorted by anchor and falling score in the
    shuffle, the first of each anchor are its positives. A second pass of the blocks hands on, for each positive, the first ``k`` rows of its window in that block, and the
    rows of an anchor stream by in order: a positive opens a window and negatives are emitted from it. Blocks only leave out what cannot be among
    the first; all windows are cut in that stream.

    Rows with null key or label, and vectors that are null, empty, of another length than most or hold null or non-finite components (also after scaling)
    take no part; zero vectors do. Rows that share a key are rows and anchors of their own, except that they are no candidates for each other. Scores are exact
    at any size; beyond 64 bits they are cut to the range of a long only when returned. Without anchors or rows the result is empty.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    d = common_length(rows, "v")
    codes = F.xxhash64("label") if not rows.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.col("label").cast("long")
    rows = rows.where(F.size("v") == d).select("id", "v", codes.alias("label"), "asks", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "rows")  # with a number for each row that stays
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    if not n or not asking:
        return spark.createDataFrame([], RESULT)
    nb, na = -(-n // block_rows), -(-asking // block_anchors)
    h, zero = F.xxhash64("row"), F.lit(0).cast("long")
    none = F.lit(None).cast("array<string>")
    each_anchor = F.explode(F.sequence(zero, F.lit(na - 1).cast("long"))).alias("a")
    each_block = F.explode(F.sequence(zero, F.lit(nb - 1).cast("long"))).alias("b")
    right = rows.select(each_anchor, F.pmod(h, F.lit(nb)).alias("b"), "id", "v", "label", "row", F.lit(False).alias("asks"), none.alias("windows"))

    def blocks(anchors: DataFrame, pick) -> DataFrame:
        left = anchors.select(F.pmod(h, F.lit(na)).alias("a"), each_block, "id", "v", "label", "row", F.lit(True).alias("asks"), "windows")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in groups_of(batches, ["a", "b"]):
                asks = part.column("asks").to_numpy().astype(bool)
                x, ids, labels, row = whole(matrix(part.column("v"), d), scale), *(part.column(c).to_numpy() for c in ("id", "label", "row"))
                windows = part.column("windows").filter(pa.array(asks)).to_pylist()
                anchor, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
                out = []
                for at, against, s in scores(x[anchor], x[rest]):
                    to = rest[against]
                    for i, line in zip(at, s):
                        me = anchor[i]
                        for j in pick(line, labels[to] == labels[me], ids[to], ids[to] != ids[me], windows[i]):
                            out.append((int(row[me]), int(ids[me]), bool(labels[to[j]] == labels[me]), str(int(line[j])), int(ids[to[j]]), int(row[to[j]])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["anchor", "anchor_id", "positive", "score", "id", "row"])

        return stored(dealt(left.unionByName(right), ["a", "b"]).mapInArrow(find, FOUND), "found")

    def nearest(score, same, ids, other, _):
        return first(same & other, score, ids, positives)

    def windowed(score, same, ids, other, windows):
        picked: set[int] = set()
        for p in {int(w) for w in windows}:
            least, most = -(-low * p // 100), high * p // 100
            if p >= 0 and (score.dtype == object or least < 2**62):  # scores in doubles are below 2**53
                most = most if score.dtype == object else min(most, 2**62)
                picked.update(first(~same & other & (score >= least) & (score <= most), score, ids, k).tolist())
        return sorted(picked)

    anchors = rows.where("asks").withColumn("windows", none)
    near = blocks(anchors, nearest)
    chosen = in_order(near).mapPartitions(lambda part: first_of_each(part, positives)).toDF("anchor long, id long, row long, score string")
    chosen = stored(chosen, "positives")
    opened = chosen.groupBy(F.col("anchor").alias("_anchor")).agg(F.collect_list("score").alias("windows"))  # at most ``positives`` values each
    with_windows = rows.where("asks").join(opened, F.col("row") == F.col("_anchor"))
    hard = blocks(with_windows, windowed)
    ids = rows.where("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    both = hard.unionByName(chosen.join(ids, "anchor").withColumn("positive", F.lit(True)))
    return in_order(both).mapPartitions(lambda part: negatives(part, k, low, high)).toDF(RESULT)
