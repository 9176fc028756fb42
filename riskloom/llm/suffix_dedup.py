"""Exact substring dedup with suffix arrays of bounded shards.

Only a window that occurs twice matters, and equal windows must meet in one shard. Every window is routed by its
minimizer, the gram (a third of a window long) of smallest hash in it, which its content alone decides. Runs of windows with the same
minimizer are one segment of text. Segments whose gram occurs once in the corpus are done with; equal segments are
counted, not shipped twice; what remains is sorted in shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import dealt, groups_of, shuffle_width, stored, sub_batches
from riskloom.llm.minhash import BYTE, mixed

PIECE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker for the next piece."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _tables:
        _tables.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _tables[size] = np.cumprod(up), np.cumprod(down)
    return _tables[size]


class Rolling:
    """Hashes of any substring of a byte array, from one pass."""

    def __init__(self, data: np.ndarray):
        up, self.down = _steps(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def segments(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(key, hash, start, windows) of each segment of the texts that lie between ``bounds`` in ``data``."""
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    n = len(data) - width + 1
    if n <= 0:
        return empty
    rolling, gram = Rolling(data), max(1, width // 3)
    at = np.arange(len(data) - gram + 1)
    grams = rolling(at, at + gram)
    # the hash in the upper bits and the place below: the least is the leftmost of the smallest
    low = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    held, reach = low, 1
    span = width - gram + 1
    while reach * 2 <= span:
        held = np.minimum(held[: len(held) - reach], held[reach:])
        reach *= 2
    held = np.minimum(held[: n], held[span - reach : span - reach + n])
    place = (held & np.uint64((1 << 24) - 1)).astype(np.int64)
    whole = np.zeros(n, bool)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            whole[a : b - width + 1] = True
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return empty
    count = np.add.reduceat(whole, start, dtype=np.int64)
    return grams[place[start]], rolling(start, start + count + width - 1), start, count


def text_segments(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text number, key, hash, start, windows); long texts in overlapping pieces, short ones together."""
    out, held, numbers, size = [], [], [], 0

    def flush():
        nonlocal held, numbers, size
        if held:
            bounds = np.cumsum([0] + [len(h) for h in held])
            key, seg, start, count = segments(np.frombuffer(b"".join(held), np.uint8), bounds, width)
            which = np.searchsorted(bounds, start, "right") - 1
            skip = np.array([s for _, s in numbers])
            out.append((np.array([i for i, _ in numbers])[which], key, seg, start - bounds[which] + skip[which], count))
        held, numbers, size = [], [], 0

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - width + 1), PIECE):
            part = t[a : a + PIECE + width - 1]
            if len(part) >= width:
                held.append(part)
                numbers.append((i, a))
                size += len(part)
            if size >= PIECE:
                flush()
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` bytes: groups that are still equal are refined by the rank of the
    suffix as far on as they are sorted, which doubles that length (Larsson and Sadakane)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    rank, h = np.zeros(n + 1, np.int64), 8
    rank[n] = -1

    def ranked(at: np.ndarray, keys: list[np.ndarray]) -> None:
        new = np.ones(len(at), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))

    ranked(np.arange(n), [first[order]])
    while h < depth:
        r = rank[order]
        equal = r[1:] == r[:-1]
        at = np.flatnonzero(np.concatenate((equal, [False])) | np.concatenate(([False], equal)))
        if not len(at):
            break
        group = r[at]
        ahead = rank[np.minimum(order[at] + h, n)]
        by = np.lexsort((ahead, group))
        order[at] = order[at][by]
        ranked(at, [group, ahead[by]])
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the order with the one before it (Kasai's rule, all places at once).

    Where a suffix and its neighbour are preceded by the same byte, the prefix is that of the place before less
    one; only the other places are compared byte by byte, eight at a time.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    own = (before < 0) | (before == 0) | (at == 0)
    own |= data[at - 1] != data[np.maximum(before, 1) - 1]
    # the neighbour of the place before must be the one before this place's neighbour
    own[1:] |= before[:-1] + 1 != before[1:]
    i = np.flatnonzero(own & (before >= 0))
    j, length = before[i], np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    alive = np.arange(len(i))
    got = np.zeros(len(i), np.int64)
    while len(alive):
        a, b = i[alive] + got[alive], j[alive] + got[alive]
        room = np.minimum(8, n - np.maximum(a, b))
        same = np.ones(len(alive), bool)
        for k in range(8):
            same &= (k < room) & (padded[np.minimum(a, n) + k] == padded[np.minimum(b, n) + k])
            got[alive[same]] += 1
        alive = alive[same]
    length[i] = got
    last = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(length[last] - (at - last), 0)[order]


def repeated_windows(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows at ``starts`` (each within its own segment): occurs at another start; is the first of its equals."""
    order = suffix_array(data, width)
    prefix = common_prefixes(data, order)
    listed = np.zeros(len(data), bool)
    listed[starts] = True
    at = np.flatnonzero(listed[order])
    least = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else np.zeros(0, np.int64)
    same = least >= width
    again, first = np.zeros(len(data), bool), np.zeros(len(data), bool)
    again[order[at[:-1][same]]] = again[order[at[1:][same]]] = True
    first[order[at[np.concatenate(([True], ~same))]]] = True
    return again[starts], first[starts]


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of true flags within equal neighbouring groups."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | (group[1:] != group[:-1])
    at = np.flatnonzero(begin)
    return at, np.add.reduceat(flags, at, dtype=np.int64) if len(at) else at


SEGMENT = "array<struct<key: bigint, seg: bigint, pos: bigint, windows: bigint>>"


def _shared_keys(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "t"):
            key = text_segments([t.encode("utf-8", "replace") for t in batch.column("t").to_pylist()], width)[1]
            if len(key):
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return rows.select("t").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _key_filter(keys: DataFrame, bits: int, parts: int = 16) -> np.ndarray:
    """A Bloom filter of fixed size; each task fills its own part of it. Too many keys only let more segments pass."""
    size = bits // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            part = part_of(key, parts)
            for p in np.unique(part).tolist():
                flags = held.setdefault(p, np.zeros(size, bool))  # one part, unpacked
                for k in probes(key[part == p], size):
                    flags[k] = True
        for p, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bits"])

    part = F.col("key").bitwiseAND(parts - 1)
    whole = np.zeros((parts, size // 8), np.uint8)
    for row in keys.repartition(parts, part).mapInArrow(run, "part long, bits binary").collect():  # ``bits`` in all
        whole[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return whole


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The lowest bits of a hash: being the smallest of a window, it has few of the highest."""
    return (key & np.uint64(parts - 1)).astype(np.int64)


def probes(key: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = mixed(key), mixed(key ^ BASE) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(4)]


def dedup_substrings(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 200, shard_bytes: int = 1 << 20, filter_bits: int = 1 << 26
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` (the remaining UTF-8 bytes) of each document.

    A byte goes when a ``width``-byte string that covers it also starts at another place, in this document or another; strings are
    judged on the input. Null text is empty. Rows with the same id, or none, are documents of their own.

    1. The corpus' grams that are minimizers more than once are counted, and a Bloom filter of fixed size made of them.
    2. Documents are written once with those of their segments that the filter passes.
    3. Segments that occur more than once are repeated whole. Of each gram with several different segments, one copy of each is sent to a
    shard: suffix array, common prefixes, and the windows that another start shares.
    4. A gram whose segments need more than ``shard_bytes`` is cut into several shards. Each sends its distinct windows to be merged as hashes (64 bits, under the gram's
    64) in packed arrays, one for each bucket of about 256 KB of the gram (at most ``MOST_BUCKETS``, then buckets grow): in a bucket
    the sorted runs of all shards are searched for each other's.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    shared = stored(_shared_keys(rows, width), "grams")
    passing = spark.sparkContext.broadcast(_key_filter(shared, filter_bits))  # filter_bits in size
    parts = len(passing.value)
    size = filter_bits // parts

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in sub_batches(batches, "t"):
            texts = [t.encode("utf-8", "replace") for t in batch.column("t").to_pylist()]
            which, gram, seg, pos, windows = text_segments(texts, width)
            part = part_of(gram, parts)
            on = np.ones(len(gram), bool)
            for k in probes(gram, size):
                on &= (passing.value[part, k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 > 0
            which, gram, seg, pos, windows = (x[on] for x in (which, gram, seg, pos, windows))
            offsets = np.searchsorted(which, np.arange(len(texts) + 1))
            cells = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in (gram, seg, pos, windows)], names=["key", "seg", "pos", "windows"])
            segs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(texts))), batch.column("id"), pa.array(texts, pa.binary()), segs], names=["row", "id", "data", "segs"]
            )
            number += len(texts)

    base = stored(rows.mapInArrow(describe, f"row long, id {kind}, data binary, segs {SEGMENT}"), "documents")
    marked = base.where(F.size("segs") > 0)
    places = marked.select("row", F.inline("segs"))
    kinds = places.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("pos", "row").alias("pos"), F.max("windows").alias("windows"))
    kinds = stored(kinds, "segments")
    grams = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (width - 1)).alias("bytes")).where("kinds > 1")
    grams = stored(grams, "grams")
    total = grams.agg(F.sum("bytes")).first()[0] or 0
    found = []
    if total:
        buckets = max(1, round(total / shard_bytes))
        large = F.col("bytes") > shard_bytes
        sub = F.when(large, F.pmod("seg", F.ceil(F.col("bytes") / shard_bytes))).otherwise(-1)
        merged_in = F.when(large, F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("bytes") / BUCKET_BYTES))).otherwise(0).cast("int").alias("nb")
        wanted = kinds.join(grams.select("key", "bytes"), "key").select(
            F.when(large, F.col("key")).otherwise(F.pmod("key", F.lit(buckets))).alias("shard"), sub.cast("long").alias("sub"), "key", "row", "pos", "windows", merged_in
        )
        asked = wanted.groupBy("row").agg(F.collect_list(F.struct("shard", "sub", "key", "pos", "windows", "nb")).alias("asks"))
        cut = marked.select("row", "data").join(asked, "row").select("row", "data", F.inline("asks")).select(
            "shard", "sub", "key", "row", "pos", "windows", "nb", F.substring(F.col("data"), (F.col("pos") + 1).cast("int"), (F.col("windows") + (width - 1)).cast("int")).alias("part")
        )
        results = stored(_sort_shards(cut, width), "windows")
        span = F.array(F.struct("pos", "windows")).alias("spans")
        found = [results.where("packed is null").select("row", span), _merge_shards(results.where("packed is not null"))]
    single = kinds.where("n = 1").select("row", "pos")
    repeats = places.select("row", "pos", "windows").join(single, ["row", "pos"], "left_anti").select("row", F.array(F.struct("pos", "windows")).alias("spans"))
    for more in found:
        repeats = repeats.union(more)
    spans = repeats.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "data"):
            out = [[], [], [], []]
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                edge = np.zeros(len(data) + 1, np.int64)
                for s in spans or ():
                    edge[s["pos"]] += 1
                    edge[s["pos"] + s["windows"] + width - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for o, v in zip(out, (len(data), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum()), kept)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"]
            )

    ddl = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    changed = marked.select("row", "id", "data").join(spans, "row", "left").select("id", "data", "spans").mapInArrow(remove, ddl)
    zero = F.lit(0).cast("long")
    same = base.where(F.size("segs") == 0).select(F.col("id").alias(key), F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("data").alias("kept"))
    return changed.union(same)


#: A packed window: its hash, document row, position, and whether its own shard has it more than once.
PACKED = np.dtype([("hash", "<u8"), ("row", "<i8"), ("pos", "<i8"), ("again", "?")])
BUCKET_BYTES, MOST_BUCKETS = 1 << 18, 4096


def _sort_shards(cut: DataFrame, width: int) -> DataFrame:
    """Runs of repeated windows (``packed`` null), and for grams in several shards their distinct windows, packed by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, sub), part in groups_of(batches, ["shard", "sub"]):
            texts = part.column("part").to_pylist()
            data = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
            gram, row, pos, windows = (part.column(c).to_numpy() for c in ("key", "row", "pos", "windows"))
            which = np.repeat(np.arange(len(texts)), windows)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = begin[which] + inside
            again, first = repeated_windows(data, starts, width)
            at, count = _runs(again, which)
            if len(at):
                yield batch(row[which[at]], (pos[which] + inside)[at], count)
            if sub >= 0:
                k = np.flatnonzero(first)
                sent = np.zeros(len(k), PACKED)
                sent["hash"] = Rolling(data)(starts[k], starts[k] + width)
                sent["row"], sent["pos"], sent["again"] = row[which[k]], (pos[which] + inside)[k], again[k]
                bucket = (mixed(sent["hash"]) % np.uint64(part.column("nb")[0].as_py())).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ids, cuts = np.unique(bucket[order], return_index=True)
                packed = [rows.tobytes() for rows in np.split(sent[order], cuts[1:])]
                for n in range(0, len(ids), 16):  # a few MB at a time
                    some = ids[n : n + 16]
                    yield batch(np.zeros(len(some), int), some, np.zeros(len(some), int), packed[n : n + 16], int(gram[0]), sub)

    def batch(row, pos, windows, packed=None, gram=None, sub=None):
        n = len(row)
        arrays = [pa.array(row), pa.array(pos), pa.array(windows), pa.array(packed or [None] * n, pa.binary()), pa.array([gram] * n, pa.int64()), pa.array([sub] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "pos", "windows", "packed", "key", "sub"])

    return dealt(cut, ["shard", "sub"]).mapInArrow(run, "row long, pos long, windows long, packed binary, key long, sub long")


def _merge_shards(packed: DataFrame) -> DataFrame:
    """``row, spans``: the windows that another shard of their gram holds too. In each bucket of a gram the shards' sorted runs are searched
    for each other's entries. A window that was repeated in its own shard is only looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups_of(batches, ["key", "bucket"]):
            runs = [np.sort(np.frombuffer(p, PACKED), order="hash") for p in part.column("packed").to_pylist()]
            everything = np.sort(np.concatenate([r["hash"] for r in runs]))
            found = []
            for own in runs:
                h = own["hash"]
                many = np.searchsorted(everything, h, "right") - np.searchsorted(everything, h, "left")
                mine = np.searchsorted(h, h, "right") - np.searchsorted(h, h, "left")
                found.append(own[(many > mine) & ~own["again"]])
            on = np.sort(np.concatenate(found), order=["row", "pos"])
            if len(on):
                rows, cuts = np.unique(on["row"], return_index=True)
                cells = pa.StructArray.from_arrays([pa.array(on["pos"]), pa.array(np.ones(len(on), np.int64))], names=["pos", "windows"])
                spans = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(on)), pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([pa.array(rows), spans], names=["row", "spans"])

    chosen = packed.select("key", F.col("pos").alias("bucket"), "packed")
    return dealt(chosen, ["key", "bucket"]).mapInArrow(run, "row long, spans array<struct<pos: long, windows: long>>")
