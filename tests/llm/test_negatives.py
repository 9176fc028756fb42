"""Hard negatives against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives, queries  # noqa: F401
from riskloom.llm.base import QUERIES

LONG = 2**63 - 1


def brute(rows, is_anchor, scale=256, positives=5, k=3, low=50, high=95):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, vector, label) rows."""
    used = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        used.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for i, v, label in used:
        if not is_anchor(i):
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, m == label) for j, w, m in used if j != i)
        for p, j in [(-s, j) for s, j, same in near if same][:positives]:
            hard = [(-s, n) for s, n, same in near if not same and low * p <= -100 * s <= high * p][:k]
            cut = lambda s: max(-LONG - 1, min(LONG, s))
            out += [(i, j, r, n, cut(p), cut(s)) for r, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    assert want and got(QUERIES["op11_hard_negatives"](spark, sf_dir)) == want


@pytest.mark.parametrize("blocks", [(16_384, 1024), (37, 3)])
def test_ties_repeats_and_odd_rows(spark, blocks):
    """Small whole numbers, so that scores tie, also at zero; repeated rows and ids; huge and unusable vectors; a label that holds most rows."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], 0 if rng.random() < 0.6 else int(rng.integers(1, 4))) for i in range(300)]
    rows += rows[:20] + [(5, [1.0, 1.0, 0.0, 2.0], 3), (7, [0.0, 0.0, 0.0, 0.0], 1), (140, [0.0] * 4, 2)]
    rows += [(400, [1e12, -3e15, 5.5, 1e10], 0), (401, [1e160, 1.0, 2.0, 3.0], 1), (402, [1e300, 1e300, 0.0, -1.0], 0), (403, [1e155, 2.0, 2.0, 1.0], 0)]
    rows += [(410, None, 1), (None, [1.0] * 4, 1), (411, [1.0] * 4, None), (412, [1.0, None, 1.0, 1.0], 0), (413, [float("nan")] * 4, 0), (414, [1e308] * 4, 0), (415, [], 1), (420, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).withColumn("windows", F.lit(1))
    result = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, scale=1, block_rows=blocks[0], block_anchors=blocks[1])
    assert got(result) == brute([r for r in rows if r[1] is None or len(r[1]) != 3], lambda i: i % 20 == 0, scale=1)


def test_text_labels_and_empty_tables(spark):
    rows = [(i, [float(i % 7), 1.0], "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert got(hard_negatives.mine(df, F.col("vec_id") < 4)) == brute(rows, lambda i: i < 4)
    assert got(hard_negatives.mine(df.limit(0), F.col("vec_id") < 4)) == [] and got(hard_negatives.mine(df, F.lit(False))) == []


def test_a_long_anchor_streams():
    """The iterator hands rows on as they come: a result is out before the rest of the anchor has been read."""
    read = []

    def rows():
        for i in range(100_000):
            read.append(i)
            yield (1, -(100_000 - i), i > 0, i, i), 50

    stream = hard_negatives.negatives(rows(), 3, 50, 95)
    assert next(stream) == (50, 0, 1, 5000, 100_000, 95_000) and len(read) == 5001
    assert len(list(stream)) == 2
