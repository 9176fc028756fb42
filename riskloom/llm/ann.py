"""Approximate nearest neighbours by adaptive dimension scans of probed lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import dealt, groups_of, stored
from riskloom.llm.vectors import common_length, matrix, usable


@dataclass
class Index:
    """Lists of a rotated space in which a small distance is a large inner product.

    A vector x becomes (x, sqrt(m - |x|^2)) with m the largest square norm, a query (q, 0): then |x' - q'|^2 =
    m + |q|^2 - 2 <x, q>. Both are turned by one random rotation, so that any leading coordinates are a fair
    sample of a distance.
    """

    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    most: float

    def turned(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack((x, more)) @ self.rotation

    def order(self, turned: np.ndarray) -> np.ndarray:
        """The lists of each row by distance."""
        c = self.centres
        return np.argsort((c * c).sum(axis=1)[None, :] - 2 * turned @ c.T, axis=1, kind="stable")


def fit(sample: np.ndarray, most: float, lists: int, k: int, target: float, seed: int = 7, steps: int = 12) -> Index:
    """Lists and probes from a sample: the fewest probes that find ``target`` of the sample's own ``k`` nearest."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
    index = Index(rotation, np.zeros((1, len(rotation))), 1, most)
    x = index.turned(sample, False)
    index.centres = x[rng.permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
    for _ in range(steps):
        own = index.order(x)[:, 0]
        for c in range(len(index.centres)):
            if (own == c).any():
                index.centres[c] = x[own == c].mean(axis=0)
    own = index.order(x)[:, 0]
    asked = rng.permutation(len(x))[:300]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if best.size:
        place = np.argsort(index.order(index.turned(sample[asked], True)), axis=1)  # list to its turn
        turn = np.sort(place[np.arange(len(asked))[:, None], own[best]].ravel())
        index.probes = int(turn[min(len(turn) - 1, int(np.ceil(target * len(turn))))]) + 1
    return index


def scan(q: np.ndarray, x: np.ndarray, k: int, columns: int = 16, rows: int = 512, errors: float = 2.1) -> list[np.ndarray]:
    """For each turned query the rows of ``x`` that may be among its ``k`` nearest.

    Rows are taken in blocks and columns in blocks. From the leading columns of a block a distance is estimated; a
    row is abandoned when, were it as near as the k-th nearest so far, so large an estimate would lie more than
    ``errors`` standard deviations out. Rows that survive all columns have exact distances and move the bound.
    """
    d, n = x.shape[1], len(x)
    kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    bound = np.full(len(q), np.inf)
    for s in range(0, n, rows):
        part = x[s : s + rows]
        i = j = got = None
        for c in range(0, d, columns):
            a, b = q[:, c : c + columns], part[:, c : c + columns]
            if i is None:
                total = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0) + (total if c else 0)
                got = total
            else:
                step = a[i] - b[j]
                got = got + np.einsum("ij,ij->i", step, step)
            m = min(d, c + columns)
            if m < d:
                limit = bound * (m / d) * (1 + errors / np.sqrt(m)) ** 2
                if i is None:
                    on = total <= limit[:, None]
                    if on.sum() < 0.2 * on.size:  # few survive: go on pair by pair
                        i, j = np.nonzero(on)
                        got = total[i, j]
                else:
                    on = got <= limit[i]
                    i, j, got = i[on], j[on], got[on]
        if i is None:
            i, j = np.nonzero(total <= bound[:, None] + 1e-9)
            got = total[i, j]
        cuts = np.searchsorted(i, np.arange(len(q) + 1))
        for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                rows_of, far = np.concatenate((kept[r][0], j[a:b] + s)), np.concatenate((kept[r][1], got[a:b]))
                if len(far) > k:
                    bound[r] = np.partition(far, k - 1)[k - 1]
                    near = far <= bound[r] + 1e-9
                    rows_of, far = rows_of[near], far[near]
                elif len(far) == k:
                    bound[r] = far.max()
                kept[r] = rows_of, far
    return [r for r, _ in kept]


#: Norms within a band differ by less than 2**BAND, so that a band's largest norm leaves the others their digits.
BAND = 20


def power(exponent: Column | int) -> Column:
    """2 to the exponent, within the range of doubles."""
    e = F.lit(exponent) if isinstance(exponent, int) else exponent
    return F.pow(F.lit(2.0), F.greatest(F.lit(-1000), F.least(F.lit(1000), e)).cast("double"))


def search(
    df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, target: float = 0.97, sample_rows: int = 8192,
    block_rows: int = 4096, block_queries: int = 512,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` its ``k`` nearest other rows by inner product.

    Vectors are parted into bands of norms within a factor of 2**20 (one band as a rule, some hundred at most), scaled by a power of two, so that a
    vector of any finite size neither overflows nor swallows the digits of others. In each band lists, rotation and the number of probes are fitted on a sample of at
    most ``sample_rows`` (those with the smallest id hashes, of a hashed share of a large band),
    ``sqrt(n) / 4`` lists, at most 1024; every row is indexed. Each query is compared with the whole
    of its probed lists, and with further lists where those hold fewer than ``k`` others. Lists and the queries that ask
    for them meet in blocks of bounded size, so a list that holds most of the table is many tasks. Scores are inner products
    of the given values in double precision; equal scores go to the smaller id. A sum that overflows is infinite, and last where it is no number.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components, and rows with null id,
    take no part. Rows that share an id are candidates of their own, except for queries with that id. With fewer than ``k``
    others, all are returned; without queries or vectors the result is empty.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where(usable("v") & F.col("id").isNotNull())
    d = common_length(rows, "v")
    exponent = F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("int")
    rows = rows.where(F.size("v") == d).withColumn("e", exponent).withColumn("band", F.floor(F.col("e") / BAND).cast("int"))
    rows = stored(rows, "vectors")
    scaled = F.transform("v", lambda x: x * power((F.col("band") + 1) * -BAND))
    square = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x)
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy("band").collect()  # bounded by the exponents of doubles
    found = [_search_band(rows, b["band"], b["n"], b["most"], d, k, target, sample_rows, block_rows, block_queries) for b in bands]
    result = "query_id long, rank int, vec_id long, score double"
    if not found:
        return spark.createDataFrame([], result)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_band(
    every: DataFrame, band: int, n: int, most: float, d: int, k: int, target: float, sample_rows: int, block_rows: int, block_queries: int
) -> DataFrame:
    """``query_id, vec_id, score`` of what each query may have among its nearest in one band."""
    spark = every.sparkSession
    rows = every.where(F.col("band") == band)
    shrink = 2.0 ** max(-1000, min(1000, -BAND * (band + 1)))
    some = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(max(1, n // (4 * sample_rows)))) == 0  # so that few rows are sorted
    picked = rows.where(some).select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample_rows)  # bounded
    sample = np.array([r["v"] for r in picked.select("v").collect()], np.float64).reshape(-1, d)
    if not len(sample):  # a small band without hashed ids
        sample = np.array([r["v"] for r in rows.select("v").limit(sample_rows).collect()], np.float64)
    lists = int(min(1024, max(1, round(n**0.5 / 4))))
    index = spark.sparkContext.broadcast(fit(sample * shrink, most * (1 + 1e-12), lists, k, target))

    def query_rows(part) -> np.ndarray:
        """Queries, each scaled by its own power of two: the order of its candidates stays."""
        e = part.column("e").to_numpy()
        return matrix(part.column("v"), d) * np.exp2(np.clip(-e, -1000, 1000).astype(float))[:, None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = index.value.order(index.value.turned(matrix(batch.column("v"), d) * shrink, False))[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own.astype(np.int64))], names=["id", "v", "list"])

    placed = stored(rows.mapInArrow(assign, "id long, v array<double>, list long"), "placed")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most 1024 rows
    held = spark.sparkContext.broadcast(np.array([sizes.get(c, 0) for c in range(lists)]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = index.value.order(index.value.turned(query_rows(batch), True))
                enough = 1 + (np.cumsum(held.value[order], axis=1) < k + 1).sum(axis=1)
                wanted = [o[: max(index.value.probes, int(e))] for o, e in zip(order, enough)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("e"), pa.array(wanted, pa.list_(pa.int64()))], names=["id", "v", "e", "lists"])

    asked = every.where("asks").select("id", "v", "e").mapInArrow(probe, "id long, v array<double>, e int, lists array<long>")
    asked = stored(asked.select("id", "v", "e", F.explode("lists").alias("list")), "asked")
    asks = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    blocks = spark.createDataFrame(
        [(c, -(-sizes[c] // block_rows), -(-asks[c] // block_queries)) for c in sizes if c in asks], "list long, nb long, nq long"
    )
    h, zero = F.xxhash64("id"), F.lit(0).cast("long")
    right = placed.join(F.broadcast(blocks), "list").select(  # at most 1024 rows
        "list", F.pmod(h, "nb").alias("b"), F.explode(F.sequence(zero, F.col("nq") - 1)).alias("r"), "id", "v", F.lit(0).alias("e"), F.lit(False).alias("asks")
    )
    left = asked.join(F.broadcast(blocks), "list").select(
        "list", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("b"), F.pmod(h, "nq").alias("r"), "id", "v", "e", F.lit(True).alias("asks")
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups_of(batches, ["list", "b", "r"]):
            raw, ids = matrix(part.column("v"), d), part.column("id").to_numpy()
            asks = part.column("asks").to_numpy().astype(bool)
            q, x, q_ids, x_ids = raw[asks], raw[~asks], ids[asks], ids[~asks]
            if not len(q) or not len(x):
                continue
            out = [[], [], []]
            with np.errstate(over="ignore", invalid="ignore"):
                near_rows = scan(index.value.turned(query_rows(part.filter(pa.array(asks))), True), index.value.turned(x * shrink, False), k + 1)
                for r, near in enumerate(near_rows):
                    near = near[x_ids[near] != q_ids[r]]
                    score = np.einsum("ij,ij->i", x[near], np.broadcast_to(q[r], (len(near), d)))
                    best = np.lexsort((x_ids[near], -np.where(np.isnan(score), -np.inf, score)))[:k]
                    out[0].append(np.full(len(best), q_ids[r]))
                    out[1].append(x_ids[near][best])
                    out[2].append(score[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    return dealt(left.unionByName(right), ["list", "b", "r"]).mapInArrow(find, "query_id long, vec_id long, score double")
