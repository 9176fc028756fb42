"""Importance resampling towards a target corpus: hashed word n-grams, log-ratio gains and a seeded draw without replacement."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import stored, sub_batches, with_computed

#: Each byte of a UTF-8 text: A-Z in lower case, digits, a-z and all bytes of longer characters as they are, a blank for the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Scores in a bin of the draw; with 64-bit weights left aside a score lies within some 100,000 of zero, which is a few hundred bins.
BIN = 256


def word_lists(text: str | None, most_n: int = 1, piece: int = 1 << 20) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in lists of about ``piece`` bytes, and how many words at the start of a list were in the one before."""
    data = (text or "").encode().translate(TABLE)
    at, before = 0, []
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        words = before + data[at:end].split()
        yield words, len(before)
        before = words[len(words) - most_n + 1 :] if most_n > 1 else []
        at = end


def feature_counts(text: str | None, most_n: int = 1) -> tuple[Counter, int]:
    """How often each crc32 of a run of 1 to ``most_n`` words, joined by blanks, occurs; and the number of words.

    The checksum of a run is that of a blank and its last word, seeded with the checksum of the run without it.
    """
    counts, n = Counter(), 0
    for words, old in word_lists(text, most_n):
        n += len(words) - old
        sums = list(map(crc32, words))
        counts.update(sums[old:] if old else sums)
        spaced = [b" " + w for w in words] if most_n > 1 else []
        for k in range(1, most_n):
            sums = list(map(crc32, spaced[k:], sums))
            counts.update(sums[max(0, old - k) :])
    return counts, n


def in_buckets(counts: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(counts.keys(), np.int64, len(counts)) % buckets
    return keys, np.fromiter(counts.values(), np.int64, len(counts))


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = 10_000, most_n: int = 1) -> DataFrame:
    """``bucket, n``: the features of all texts in each bucket that has some; a task hands on one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in sub_batches(batches, "text"):
            held = Counter()
            for t in batch.column("text").to_pylist():
                held.update(feature_counts(t, most_n)[0])
            np.add.at(totals, *in_buckets(held, buckets))
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["bucket", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10_000, most_n: int = 1) -> list[int]:
    """For each bucket floor(1000 ln(share in the target / share in the documents)), shares with one more feature in every bucket.

    At most two rows for each bucket come to the driver.
    """
    source = {r.bucket: r.n for r in bucket_totals(docs, text, buckets, most_n).collect()}
    aimed = {r.bucket: r.n for r in bucket_totals(target, target_text, buckets, most_n).collect()}
    all_source, all_aimed = sum(source.values()) + buckets, sum(aimed.values()) + buckets
    return [math.floor(1000 * math.log((aimed.get(b, 0) + 1) * all_source / ((source.get(b, 0) + 1) * all_aimed))) for b in range(buckets)]


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10_000, most_n: int = 1) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` (long), the floored mean gain of a document's features.

    Features are all runs of 1 to ``most_n`` consecutive words of the whole text, repeats counted, hashed to ``buckets``. Gains are taken
    over all documents and the whole target. Null texts have no words; without features the weight is 0. An empty target has no
    features, an empty table gives an empty one. Columns of ``docs`` with those three names are replaced.
    """
    gain = docs.sparkSession.sparkContext.broadcast(np.array(gains(docs, target, text, target_text, buckets, most_n), np.int64))

    def make():
        def find(texts: list) -> list:
            out = []
            for t in texts:
                counts, n_words = feature_counts(t, most_n)
                keys, times = in_buckets(counts, buckets)
                n = int(times.sum())
                out.append((n_words, n, int(gain.value[keys] @ times) // n if n else 0))
            return [list(c) for c in zip(*out)] or [[], [], []]

        return find

    return with_computed(docs, text, "n_words long, n_features long, weight long", make)


def draw(weighed: DataFrame, key: str = "doc_id", seed: int | str = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``weighed`` (see ``weigh``) with ``score`` and ``rank`` (long): a weighted draw of ``percent`` of the documents without replacement.

    A score is the weight and a Gumbel number from the hash of seed and key, so that the highest scores are a draw in proportion to
    exp(weight / 1000), and a repeated task draws the same. Of the N rows with at least ``min_words`` words and a key the floor(percent * N / 100) with
    the highest scores are drawn, ties to the smaller key; ``rank`` counts them from 1 and is null for the others. Rows without a key have a null
    score and are not drawn. Rows that share a key are rows of their own; those equal in score too are ordered by features, weight and words.

    No task orders the whole table: rows are counted by score, scores by bins of 256, bins are ordered (a few hundred rows), and only rows
    of drawn scores are numbered, each score by itself. Columns named ``score`` or ``rank`` are replaced.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = stored(weighed.drop("score", "rank").withColumn("score", F.col("weight") + noise), "scored")
    asks = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    eligible = rows.where(asks)
    by_score = stored(eligible.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") / BIN)), "by_score")
    take = percent * (by_score.agg(F.sum("n")).first()[0] or 0) // 100

    def above(w):
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    bins = by_score.groupBy("bin").agg(F.sum("n").alias("n"))
    bins = bins.select("bin", above(Window.orderBy(F.desc("bin"))).alias("above_bin"))
    places = by_score.select("bin", F.col("score").alias("_at"), above(Window.partitionBy("bin").orderBy(F.desc("score"))).alias("in_bin")).join(bins, "bin")
    places = places.select("_at", (F.col("above_bin") + F.col("in_bin")).alias("_above")).where(F.col("_above") < take)
    places = stored(places, "places")  # so that Spark knows its size: broadcast or not is its choice
    placed = rows.join(places, asks & (F.col("score") == F.col("_at")), "left")
    within = Window.partitionBy("score").orderBy(key, F.desc("n_features"), F.desc("weight"), F.desc("n_words"))
    number = F.col("_above") + F.row_number().over(within)
    drawn = placed.where("_above is not null").withColumn("rank", F.when(number <= take, number))
    rest = placed.where("_above is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_at", "_above")
