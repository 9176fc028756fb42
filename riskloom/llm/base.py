"""What the corpus operators share: written tables, components of a link table, the query registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function, with the SQL that must give the same rows."""

    def keep(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors see.

    Only a local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """The frame, written once to the shared folder and read back.

    Later passes neither repeat the work nor depend on the executors that did it.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sub_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most_bytes`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the undirected links; a component is its smallest node.

    Each round hangs every neighbour of a node under the smallest of them (larger neighbours, then
    smaller ones), so that the depth falls by a constant factor a round; a round is two grouped
    minima with a join, and its links are written to the shared folder.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now v < u in each link; the smaller neighbours of a node hang under the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.select("u", F.col("m").alias("v")).union(moved).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def smallest_ids(classes: DataFrame, parts: DataFrame, node: str = "node", rep: str = "rep") -> DataFrame:
    """``node, least, head`` of the nodes in ``parts (node, component)``: the smallest ``rep`` in a node's component, and the smallest node that has it."""
    ids = classes.select(F.col(node).alias("node"), F.col(rep).alias("rep"))
    held = parts.select("node", "component").join(ids, "node")
    least = stored(held.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("first")), "least")
    return parts.join(least, "component").select("node", F.col("first.rep").alias("least"), F.col("first.node").alias("head"))


def with_computed(docs: DataFrame, text: str, ddl: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``docs`` with columns that a Python function finds from the texts, a few MB of text at a time.

    ``make`` is called once for each task and gives a function from a list of texts (None for null) to one list
    for each column of ``ddl``. Columns of ``docs`` with those names (in any case) are replaced in place; others are kept.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(ddl)
    names = {f.name.lower() for f in added}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in sub_batches(batches, text):
            got = find(batch.column(text).to_pylist())
            new = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(got, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=kept + arrow.names)

    mapped = docs.mapInArrow(run, schema)
    own = {c.lower() for c in docs.columns}
    return mapped.select(*[F.col(f"`{c}`") for c in docs.columns], *[f.name for f in added if f.name.lower() not in own])


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal integer keys in batches that are sorted by them; longer runs come in parts of ``most``."""
    held, held_key, n = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(int(c[a]) for c in columns)
            for c in range(a, b, most or b - a):
                part = batch.slice(c, min(most or b - a, b - c))
                if held and (key != held_key or most and n + part.num_rows > most):
                    yield held_key, pa.Table.from_batches(held)
                    held, n = [], 0
                held_key, n = key, n + part.num_rows
                held.append(part)
    if held:
        yield held_key, pa.Table.from_batches(held)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys together and in order, in as many partitions as shuffles have."""
    return df.repartition(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)


def joined_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the smallest index that each index reaches."""
    labels = np.arange(len(linked))
    while True:
        least = np.minimum(labels, np.where(linked, labels, len(linked)).min(axis=1, initial=len(linked)))
        least = np.minimum(least, least[least])
        if (least == labels).all():
            return labels
        labels = least
