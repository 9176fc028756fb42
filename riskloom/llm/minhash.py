"""Near-duplicate texts: an LSH forest of MinHash signatures proposes groups, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import components, dealt, groups_of, joined_labels, shuffle_width, smallest_ids, stored, sub_batches

HASHES = 64
#: Values that two documents of a region share at least, and values by which an order is sorted; how far neighbours in a deepened region are compared.
DEPTH, DEEPEST, NEIGHBOURS = 3, 16, 8
#: Signatures of two sets that are 0.8 alike agree in half of 64 values but for one chance in a thousand million.
LEAST_AGREEING = 0.5
_draw = np.random.default_rng(20240607)
BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
#: Odd factors: 1-16 for the words of a shingle, 39 and later for texts shorter than one.
ODD = _draw.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
A = _draw.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = _draw.integers(0, 2**32, HASHES, dtype=np.uint32)
#: By which minima each order is sorted. The first eighteen begin with three minima that no other begins with; the others are drawn.
ORDERS = (np.arange(18)[:, None] * DEPTH + np.arange(DEEPEST)) % HASHES
MORE_ORDERS = np.stack([_draw.permutation(HASHES)[:DEEPEST] for _ in range(62)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), ODD[0], np.uint64)
    p[0] = 1
    return np.cumprod(p)


def word_hashes(data: bytes, most: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and a 64-bit hash of each, A-Z in lower case; worked in pieces cut at white space."""
    whole = np.frombuffer(data, np.uint8)
    at, starts, hashes = 0, [], []
    while at < len(whole):
        n = most
        while at + n < len(whole):
            spaces = np.flatnonzero(IS_SPACE[whole[at : at + n]])
            if len(spaces):
                n = int(spaces[-1]) + 1
                break
            n *= 2
        part = whole[at : at + n]
        space = IS_SPACE[part]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        if len(first):
            spans = np.diff(np.append(first, len(part)))
            offset = np.zeros(len(part), np.int64)
            offset[first[0] :] = np.arange(first[0], len(part)) - np.repeat(first, spans)
            value = BYTE[LOWER[part]] * _powers(int(spans.max()))[offset]
            value[space] = 0
            starts.append(first + at)
            hashes.append(mixed(np.add.reduceat(value, first)))
        at += len(part)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a shorter text is one shingle, an empty one none."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    begins = np.cumsum([0] + [len(d) + 1 for d in data])
    starts, hashes = word_hashes(b" ".join(data))
    cuts = np.searchsorted(starts, begins)
    n = len(hashes) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(words if n > 0 else 0):
        rolled += hashes[j : j + n] * ODD[j + 1]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.add.reduce(hashes[a:b] * ODD[40 : 40 + b - a], keepdims=True) + ODD[39:40] * np.uint64(b - a)
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` minima for each set, none of them empty."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    bounds = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(values * a + b, bounds) for a, b in zip(A, B)], axis=1)


def linked_pairs(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Boolean matrix: the intersection holds at least ``percent`` per cent of the union. Exact, by blocks of shared shingles."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], number[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((m, m), np.int64)
    total = int(shared.sum())
    for c in range(0, total, columns):
        a, b = np.searchsorted(place, (c, c + columns))
        cells = np.zeros((m, min(columns, total - c)), np.float32)
        cells[owner[a:b], place[a:b] - c] = 1
        both += (cells @ cells.T).astype(np.int64)  # whole numbers below 4096: no rounding
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    return linked


def _sign(rows: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "t", 1 << 20):
            sets = shingle_sets(batch.column("t").to_pylist(), words)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full) if full else ())
            key = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = [next(signed).astype("<u4").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc", "th", "n", "key", "sig"],
            )

    return rows.mapInArrow(run, "doc long, th long, n long, key binary, sig binary")


def _forest(reps: DataFrame, orders: np.ndarray) -> DataFrame:
    """A row of each document in each order: the minima in that order (two bytes of each), which is what it is sorted by, and a byte of every minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(n, HASHES)
            short = pa.array([row.tobytes() for row in sig.astype(np.uint8)], pa.binary())
            for t, order in enumerate(orders):
                path = pa.array([row.tobytes() for row in sig[:, order].astype(np.uint16).astype(">u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), path, batch.column("doc"), short], names=["tree", "path", "doc", "bytes"])

    return reps.mapInArrow(run, "tree int, path binary, doc long, bytes binary")


def _regions(lcp: np.ndarray, dense: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans of two rows and more that share a prefix, and which rows lie where ``DEPTH`` values were too few.

    ``lcp`` holds the common prefix of each row with the one before. A span that shares ``DEPTH`` values and holds over ``dense`` rows is cut where neighbours
    share fewer than one value more, and so on; only spans that share all ``DEEPEST`` values may hold more.
    """
    found, still, deepened = [], [(0, len(lcp))], np.zeros(len(lcp), bool)
    for depth in range(DEPTH, DEEPEST + 1):
        dense_ones = []
        for lo, hi in still:
            starts = np.concatenate(([lo], lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] < depth)))
            ends = np.append(starts[1:], hi)
            held = ends - starts
            many = held > (dense if depth < DEEPEST else len(lcp))
            found += zip(starts[(held > 1) & ~many].tolist(), ends[(held > 1) & ~many].tolist())
            dense_ones += zip(starts[many].tolist(), ends[many].tolist())
        if depth == DEPTH:
            for lo, hi in dense_ones:
                deepened[lo:hi] = True
        still = dense_ones
    return found, deepened


def _near_in_order(docs: np.ndarray, lcp: np.ndarray, minima: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among a stretch of sorted rows, and which of them lie in deepened regions. ``lcp`` begins with 0."""
    left, right = [], []
    regions, deepened = _regions(lcp, dense)
    for lo, hi in regions:
        own = docs[lo:hi]
        if lo == 0 or hi - lo > dense:
            left.append(own), right.append(np.full(hi - lo, own[0]))
        elif hi == len(docs):
            left.append(own), right.append(np.full(hi - lo, own[-1]))
        else:
            agree = np.stack([(minima[lo:hi] == row).sum(axis=1) for row in minima[lo:hi]])
            label = joined_labels(agree >= LEAST_AGREEING * HASHES)
            left.append(own), right.append(own[label])
    if deepened.any():
        region = np.cumsum(lcp < DEPTH)
        for step in range(1, min(NEIGHBOURS, len(docs) - 1) + 1):
            at = np.flatnonzero(deepened[step:] & (region[step:] == region[:-step]))
            at = at[(minima[at] == minima[at + step]).sum(axis=1) >= LEAST_AGREEING * HASHES]
            left.append(docs[at]), right.append(docs[at + step])
    if not left:
        return docs[:0], docs[:0], deepened
    return *_spanning(np.concatenate(left), np.concatenate(right)), deepened


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link for each document of ``a`` and ``b`` but the least of those that hang together."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[one] != label[other]).any():
        least = np.minimum(label[one], label[other])
        for end in (one, other):
            np.minimum.at(label, label[end], least)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _first_of_parts(docs: np.ndarray, lcp: np.ndarray, deepened: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one row for each part of the deepened regions that the links ``a, b``, a link for each document but the first of a part, leave in several."""
    at = np.flatnonzero(deepened)
    if not len(at):
        return at
    label, order = docs[at].copy(), np.argsort(a)
    if len(a):
        place = np.minimum(np.searchsorted(a[order], label), len(a) - 1)
        label = np.where(a[order][place] == label, b[order][place], label)
    pairs, first = np.unique(np.stack([np.cumsum(lcp < DEPTH)[at], label]), axis=1, return_index=True)
    _, region, times = np.unique(pairs[0], return_inverse=True, return_counts=True)
    return at[first[times[region] > 1]]


def _in_orders(forest: DataFrame, dense: int) -> DataFrame:
    """``what, a, b, tree, path``: 0 for a link that holds together whatever may be alike, 1 for a part of the deepened region ``tree, path``.

    A part is named by its document ``a``; there are rows only where a stretch leaves a region in several parts, as one part hangs together.

    Each order is sorted by the minima across the cluster. Longest-common-prefix neighbours form regions: documents that share ``DEPTH`` minima, or, where that
    is a dense region, as many more as leave ``dense`` documents. In a region those hang together that agree in ``LEAST_AGREEING`` of all minima; in a
    deepened one the next ``NEIGHBOURS`` in the order are compared too, across its cuts. A region that may go on in another task or stretch hangs together
    whole, and with the edge of the other; so does one that shares all ``DEEPEST`` minima.
    """

    def rows(what, a, b, tree=None, path=None):
        n = len(a)
        tree, path = tree if tree is not None else [None] * n, path if path is not None else [None] * n
        return pa.RecordBatch.from_arrays(
            [pa.array([what] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(tree, pa.int32()), pa.array(path, pa.binary())],
            names=["what", "a", "b", "tree", "path"],
        )

    def stretches(batches, most=1 << 16):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stretches(batches):
            n, docs, tree = part.num_rows, part.column("doc").to_numpy(), part.column("tree").to_numpy()
            paths = part.column("path").to_pylist()
            values = np.frombuffer(b"".join(paths), ">u2").reshape(n, DEEPEST)
            minima = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8).reshape(n, HASHES)
            same = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
            lcp = np.append(0, np.logical_and.accumulate(same, axis=1).sum(axis=1))
            a, b, deepened = _near_in_order(docs, lcp, minima, dense)
            yield rows(0, a, b)
            for what, at in ((1, _first_of_parts(docs, lcp, deepened, a, b)), (2, np.unique([0, n - 1]))):
                yield rows(what, docs[at], docs[at], tree[at], [paths[k][: 2 * DEPTH] for k in at])

    width = shuffle_width(forest.sparkSession)
    order = ["tree", "path", "doc"]
    got = forest.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(run, "what int, a long, b long, tree int, path binary")
    got = stored(got, "forest")
    edges = got.where("what = 2").select("a", "tree", "path")
    least = edges.groupBy("tree", "path").agg(F.min("a").alias("b"))
    tied = edges.join(least, ["tree", "path"]).where("a <> b").select(F.lit(0).alias("what"), "a", "b", "tree", "path")
    return got.where("what < 2").union(tied)


def _candidates(reps: DataFrame, dense: int) -> DataFrame:
    """``a, b``: links by ``ORDERS``, and by ``MORE_ORDERS`` of the documents of deepened regions, whose deeper prefixes each find less.

    A deepened region whose documents hang together already has no link to lose, and is not sorted again.
    """
    first = stored(_in_orders(_forest(reps, ORDERS), dense), "orders")
    links = first.where("what = 0").select("a", "b")
    deep = first.where("what = 1").select(F.col("a").alias("doc"), "tree", "path")
    if deep.isEmpty():
        return links
    parts = stored(components(links), "parts")
    deep = deep.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    apart = stored(deep.groupBy("tree", "path").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("tree", "path"), "apart")
    placed = _forest(reps, ORDERS).select("tree", F.substring("path", 1, 2 * DEPTH).alias("path"), "doc")
    again = stored(placed.join(apart, ["tree", "path"], "left_semi").select("doc").distinct(), "deepened")
    links = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if again.isEmpty():
        return links
    return links.union(_in_orders(_forest(reps.join(again, "doc", "left_semi"), MORE_ORDERS), dense).where("what = 0").select("a", "b"))


def _verify(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among the documents of each (comp, r, b); where ``side`` tells two apart, only links from side to side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups_of(batches, ["comp", "r", "b"]):
            docs = part.column("doc").to_numpy()
            side = part.column("side").to_numpy()
            sets = shingle_sets(part.column("t").to_pylist(), words)
            linked = linked_pairs(sets, percent)
            if side.any():
                linked &= side[:, None] != side[None, :]
            label = joined_labels(linked)
            moved = label != np.arange(len(docs))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(docs[moved]), pa.array(docs[label[moved]])], names=["a", "b"])

    keys = ["comp", "r", "b"]
    return stored(dealt(rows.select(*keys, "doc", "side", "t"), keys).mapInArrow(run, "a long, b long"), "links")


def _exact(texts: DataFrame, cand: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(node, component) by full shingle sets, of documents ``texts (doc, comp, t)`` in proposed groups ``cand (doc, comp)``.

    A group of up to ``block`` documents is compared whole in one task. A larger one is cut into blocks by a hash; each block
    is compared in itself and with four documents of the group. Where a group is then still in several parts, all
    documents outside its largest part are compared with all documents of the group, block by block.
    """
    zero = F.lit(0).cast("long")
    h = F.xxhash64("doc")
    large = stored(cand.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") > block), "large")
    sized = texts.join(large, "comp", "left").withColumn("nb", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)))
    own = sized.select("comp", zero.alias("r"), F.pmod(h, "nb").alias("b"), "doc", zero.alias("side"), "t")
    hubs = cand.join(large, "comp").groupBy("comp", "m", F.pmod(h, F.lit(4)).alias("q")).agg(F.min("doc").alias("doc"))
    hubs = stored(hubs.select("comp", "m", "doc"), "hubs")
    again = texts.join(hubs, ["comp", "doc"]).select("comp", "doc", "t", F.ceil(F.col("m") / block).alias("nb"))
    again = again.select("comp", zero.alias("r"), F.explode(F.sequence(zero, F.col("nb") - 1)).alias("b"), "doc", zero.alias("side"), "t")
    links = _verify(own.union(again), words, percent)
    if large.isEmpty():
        return components(links)
    parts = components(links)
    members = cand.join(large, "comp").join(parts, F.col("doc") == F.col("node"), "left")
    members = stored(members.select("comp", "m", "doc", F.coalesce("component", "doc").alias("part")), "members")
    counts = members.groupBy("comp", "m", "part").agg(F.count("*").alias("n"))
    split = counts.groupBy("comp", "m").agg(F.max_by("part", "n").alias("main"), F.max("n").alias("most")).where("most < m")
    split = stored(split, "split")
    if split.isEmpty():
        return parts
    blocks = split.select("comp", "main", F.ceil(F.col("m") / block).alias("nb"), F.ceil((F.col("m") - F.col("most")) / block).alias("nr"))
    rows = members.select("comp", "doc", "part").join(blocks, "comp").join(texts.select("doc", "t"), "doc")
    rest = rows.where("part <> main").select(
        "comp", F.pmod(h, "nr").alias("r"), F.explode(F.sequence(zero, F.col("nb") - 1)).alias("b"), "doc", F.lit(1).cast("long").alias("side"), "t"
    )
    every = rows.select("comp", F.explode(F.sequence(zero, F.col("nr") - 1)).alias("r"), F.pmod(h, "nb").alias("b"), "doc", zero.alias("side"), "t")
    return components(links.union(_verify(rest.union(every), words, percent)))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block: int = 256, dense: int = 256
) -> DataFrame:
    """``key, n_shingles, component_id, kept, head, text_hash``, one row for each row of ``docs``.

    Documents are linked when their sets of distinct ``words``-word shingles (words parted by ASCII white space, A-Z in lower case)
    have ``percent`` per cent of their union in common; a component is the smallest id that links reach. Equal sets are one class from the
    start. An LSH forest proposes groups: the signatures are sorted in ``ORDERS``, and documents meet where they share a prefix of ``DEPTH`` minima, which two documents
    at 0.8 miss in all orders 2.5 times in a million, and less the more alike they are. A region of more than ``dense`` documents is deepened, minimum by minimum, and its documents,
    unless they hang together by then, are sorted in ``MORE_ORDERS`` as well. Proposed groups are decided on whole sets.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows with null id take no
    part and are kept. Rows that share an id and differ in text are looked at one by one: what is compared and joined are classes of equal sets,
    each with a number of its own. ``text_hash`` tells such rows apart, and ``head`` is true for the rows of one class in each component, which holds its smallest id
    (and for rows that take no part). An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).withColumn("th", F.xxhash64("t"))
    signed = stored(_sign(rows, words), "signed")
    full = signed.where("n > 0 and doc is not null")
    reps = full.groupBy("key").agg(F.min(F.struct("doc", "th", "sig")).alias("one")).select("key", "one.*", F.monotonically_increasing_id().alias("node"))
    reps = stored(reps, "reps")  # the numbers stay as written
    groups = components(_candidates(reps.select(F.col("node").alias("doc"), "sig"), dense))
    cand = stored(groups.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "groups")
    chosen = cand.join(reps.select(F.col("node").alias("doc"), F.col("doc").alias("id"), "th"), "doc")
    texts = rows.select(F.col("doc").alias("id"), "th", "t").join(chosen, ["id", "th"]).select("doc", "comp", "t")
    found = _exact(stored(texts, "texts"), cand, words, percent, block)
    least = smallest_ids(reps, found, rep="doc")
    classes = reps.select("key", "doc", "node").join(least, "node", "left")
    classes = stored(classes.select("key", F.coalesce("least", "doc").alias("comp"), F.coalesce(F.col("head") == F.col("node"), F.lit(True)).alias("head")), "classes")
    placed = full.join(classes, "key").select("doc", "th", "n", "comp", "head")
    alone = signed.where("n = 0 or doc is null").select("doc", "th", "n", F.col("doc").alias("comp"), F.lit(True).alias("head"))
    return placed.union(alone).select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc") == F.col("comp"), F.lit(True)).alias("kept"),
        "head", F.col("th").alias("text_hash"),
    )
