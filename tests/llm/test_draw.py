"""Importance resampling against a plain loop."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, target_draw  # noqa: F401
from riskloom.llm.base import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most_n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, most_n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, most_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    def counted(texts):
        n = [0] * buckets
        for t in texts:
            for f in features(t, most_n)[1]:
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = counted(x for _, x in docs), counted(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, all_features = features(text, most_n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in all_features) // len(all_features) if all_features else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(all_features), weight, score, None, len(words)])
    asked = sorted((r for r in out if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for k, r in enumerate(asked[: percent * len(asked) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir, documents):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(list(zip(documents["doc_id"], documents["text"])), target)
    got = rows_of(QUERIES["op12_target_draw"](spark, sf_dir))
    assert got == want and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("most_n", [1, 3])
def test_odd_rows(spark, tricky, most_n):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    target = spark.createDataFrame([("First line of a text",), (None,), ("",), ("日本語 second LINE",)], "other string")
    weighed = target_draw.weigh(tricky, target, target_text="other", buckets=50, most_n=most_n)
    got = target_draw.draw(weighed, percent=60, min_words=3)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_features", "weight", "score", "rank"]  # the given score is replaced
    assert rows_of(got) == brute(rows, [r.other for r in target.collect()], most_n, 50, 60, 3)


def test_empty_tables(spark, tricky):
    none = tricky.limit(0)
    assert target_draw.draw(target_draw.weigh(none, tricky)).count() == 0
    got = target_draw.draw(target_draw.weigh(tricky, none), percent=100, min_words=0)
    assert got.where("rank is null").count() == tricky.where("doc_id is null").count()


def test_ties_and_repeats_take_gapless_ranks(spark):
    """One text under one id many times, so that a single score holds a third of all rows; the draw ends inside it."""
    many = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("some words here").alias("text"))
    got = target_draw.draw(target_draw.weigh(many, many), percent=50, min_words=1)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, 451))
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in many.collect()], ["some words here"] * 900, percent=50, min_words=1)


def test_pieces_of_long_texts():
    text = "Ab cd-Éf 12 " * 400 + "x" * 5000 + " end of it"
    for most_n in (1, 2, 4):
        whole, n = target_draw.feature_counts(text, most_n)
        old = target_draw.word_lists.__defaults__
        target_draw.word_lists.__defaults__ = (1, 7)
        try:
            cut = target_draw.feature_counts(text, most_n)
        finally:
            target_draw.word_lists.__defaults__ = old
        words, every = features(text, most_n)
        assert cut == (whole, n) and n == len(words) and sum(whole.values()) == len(every)
        assert set(whole) == {zlib.crc32(f.encode()) for f in every}
