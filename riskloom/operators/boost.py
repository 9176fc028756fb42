"""Boosted trees of second order: gradient and curvature histograms, many models over the same rows at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import ref
from riskloom.sources.tables import settled

MISSING = 0  # the bin of nulls; others count from 1
BLOCK = "n long, y binary, u binary, f binary, b binary, m binary"


@dataclass
class Tree:
    """A binary tree in heap order; ``column`` -1 marks a leaf, bins up to ``cut`` go left, nulls where ``null_left`` says."""

    column: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def blank(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        node, row = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(levels):
            c = self.column[node]
            b = bins[row, np.maximum(c, 0)]
            right = np.where(b == MISSING, ~self.null_left[node], b > self.cut[node])
            node = np.where(c < 0, node, 2 * node + 1 + right)
        return node


@dataclass
class Boost:
    """A boosted model: its settings, the fold it leaves out (``repeat`` -1: none), and its trees."""

    depth: int = 1
    shrinkage: float = 0.3
    row_share: float = 1.0
    column_share: float = 1.0
    penalty: float = 1.0
    min_weight: float = 1.0
    min_gain: float = 1e-12
    repeat: int = -1
    fold: int = -1
    seed: int = 1
    trees: list[Tree] = field(default_factory=list)

    def table(self, first: int = 0, upto: int | None = None) -> tuple[float, dict[int, np.ndarray]]:
        """Trees of one split add up by column: what rows without a split get, and for each column used the sum by bin."""
        base, sums, bin_ = 0.0, {}, np.arange(256)
        for t in self.trees[first:upto]:
            c = int(t.column[0])
            if c < 0:
                base += self.shrinkage * t.value[0]
            else:
                right = np.where(bin_ == MISSING, not t.null_left[0], bin_ > t.cut[0])
                sums[c] = sums.get(c, 0.0) + self.shrinkage * np.where(right, t.value[2], t.value[1])
        return base, sums

    def margin(self, bins: np.ndarray, first: int = 0, upto: int | None = None, table: tuple | None = None) -> np.ndarray:
        if self.depth == 1:
            base, sums = table or self.table(first, upto)
            total = np.full(len(bins), base)
            for c, by_bin in sums.items():
                total += by_bin[bins[:, c]]
            return total
        total = np.zeros(len(bins))
        for t in self.trees[first:upto]:
            total += self.shrinkage * t.value[t.nodes(bins, self.depth)]
        return total


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float, min_weight: float, allowed: Sequence[int]):
    """For histograms (node, column, bin) of gradient and curvature the best (gain, column, cut, null_left) of each node, and both sides' sums.

    The gain of a split is GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty); nulls go to the side that gains more. Equal gains take the first column and cut.
    """
    score = lambda a, b: a * a / (b + penalty)
    whole_g, whole_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
    found = []
    for nulls in (False, True):
        left_g = np.cumsum(g[:, :, 1:], axis=2)[:, :, :-1] + (g[:, :, :1] if nulls else 0)
        left_h = np.cumsum(h[:, :, 1:], axis=2)[:, :, :-1] + (h[:, :, :1] if nulls else 0)
        right_g, right_h = whole_g - left_g, whole_h - left_h
        gain = score(left_g, left_h) + score(right_g, right_h) - score(whole_g, whole_h)
        bad = (left_h < min_weight) | (right_h < min_weight)
        bad[:, [c for c in range(g.shape[1]) if c not in set(allowed)]] = True
        found.append((np.where(bad, -np.inf, gain), left_g, left_h, right_g, right_h))
    out = []
    for k in range(len(g)):
        options = np.stack([f[0][k] for f in found], axis=2)  # column, cut, side of nulls
        c, b, s = np.unravel_index(int(np.argmax(options)), options.shape)
        out.append((float(options[c, b, s]), int(c), int(b) + 1, bool(s), tuple(float(f[k, c, b]) for f in found[s][1:])))
    return out


class ManyBoosts:
    """Rows binned once; each level of the next tree of all models is one pass, in which tasks add up histograms and Spark the tasks' sums.

    On the driver are bin edges, and one histogram for each model and node. Rows lie in blocks, a stored row for each. What a row scored so far follows from one table
    for each column while trees have one split; deeper trees are worked out, and written with the rows every ``settle_every`` trees. Rows are drawn for a tree by a hash
    of their key, so a retry draws the same.
    """

    def __init__(self, rows: DataFrame, label: Column, columns: Sequence[str], key: Sequence[str], folds: Sequence[Column] = (), bins: int = 32, settle_every: int = 25):
        self.columns, self.settle_every, self.base = list(columns), settle_every, 0
        values = [ref(c).cast("double") for c in columns]
        places = F.array(*[f.cast("int") for f in folds]) if folds else F.array().cast("array<int>")
        raw = rows.select(label.cast("double").alias("y"), F.xxhash64(*[ref(c) for c in key]).alias("u"), places.alias("f"), F.array(*values).alias("x")).where("y is not null")
        shares = [i / bins for i in range(1, bins)]
        edges = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"e{i}") for i, v in enumerate(values)]).first()
        self.edges = [np.unique([e for e in (edges[f"e{i}"] or []) if e is not None]) for i in range(len(columns))]
        self.bins = 2 + max((len(e) for e in self.edges if len(e)), default=1)
        cuts, width, many = self.edges, len(self.columns), len(folds)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                b = np.stack([np.where(np.isnan(x[:, i]), MISSING, 1 + np.searchsorted(e, x[:, i], "left")) for i, e in enumerate(cuts)], axis=1).astype(np.uint8)
                f = batch.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, many)
                held = [batch.column("y").to_numpy(), batch.column("u").to_numpy(), f, b, np.zeros(0)]
                yield pa.RecordBatch.from_arrays([pa.array([n])] + [pa.array([a.tobytes()], pa.binary()) for a in held], names=["n", "y", "u", "f", "b", "m"])

        self.rows = settled(raw.mapInArrow(place, BLOCK))

    def _read(self, models: Sequence[Boost]):
        """A function from a batch to labels, hashes, folds, bins and, for a model, the margins, for each block; safe to send to tasks."""
        width, base, known = len(self.columns), self.base, {}

        def read(batch: pa.RecordBatch):
            for row in batch.to_pylist():
                n = row["n"]
                y, u, f, bins, held = (np.frombuffer(row[c], t) for c, t in (("y", float), ("u", np.int64), ("f", np.int32), ("b", np.uint8), ("m", float)))
                bins, held = bins.reshape(n, width), held.reshape(n, -1) if base else None

                def margin(i, upto=None, used=slice(None), bins=bins, held=held):
                    m = models[i]
                    if m.depth == 1 and (i, upto) not in known:
                        known[i, upto] = m.table(base, upto)
                    return (held[used, i] if base else 0) + m.margin(bins[used], base, upto, known.get((i, upto)))

                yield y, u, f.reshape(n, -1), bins, margin

        return read

    def _settle(self, models: Sequence[Boost]) -> None:
        read, many = self._read(models), len(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [np.stack([block[4](i) for i in range(many)], axis=1).tobytes() for block in read(batch)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "y", "u", "f", "b")), pa.array(cells, pa.binary())], names=["n", "y", "u", "f", "b", "m"])

        self.rows = settled(self.rows.mapInArrow(run, BLOCK))
        self.base = len(models[0].trees)

    def _histograms(self, models: Sequence[Boost], level: int, allowed: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """(node, column, bin, gradient or curvature) of each model at a level of its last tree; columns that it may not use stay 0."""
        read, bins_, width, nodes = self._read(models), self.bins, len(self.columns), 2**level
        number = len(models[0].trees) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((2, width, nodes * bins_)) if m.depth > level else None for m in models]
            for y, u, f, bins, margin in (block for batch in batches for block in read(batch)):
                for i, m in enumerate(models):
                    if total[i] is None:
                        continue
                    if level:
                        node = m.trees[-1].nodes(bins, level) - (nodes - 1)
                        used = node >= 0  # rows in an earlier leaf have ended
                    else:
                        node, used = None, np.ones(len(y), bool)
                    if m.repeat >= 0:
                        used &= f[:, m.repeat] != m.fold
                    if m.row_share < 1:
                        mixed = (u.view(np.uint64) ^ np.uint64((m.seed << 32) + number)) * np.uint64(0x9E3779B97F4A7C15)
                        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                        used &= (mixed >> np.uint64(11)) / float(1 << 53) < m.row_share
                    at = np.flatnonzero(used)
                    p = 1 / (1 + np.exp(-np.clip(margin(i, number, at) if number else np.zeros(len(at)), -700, 700)))
                    slope, curve = p - y[at], p * (1 - p)
                    start = node[at] * bins_ if level else 0
                    for c in allowed[i]:
                        cell = start + bins[at, c].astype(np.intp)
                        total[i][0, c] += np.bincount(cell, slope, nodes * bins_)
                        total[i][1, c] += np.bincount(cell, curve, nodes * bins_)
            kept = [i for i, t in enumerate(total) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([total[i].ravel().tolist() for i in kept], pa.list_(pa.float64()))], names=["i", "v"])

        parts = self.rows.mapInArrow(run, "i long, v array<double>").select("i", F.posexplode("v").alias("k", "s"))
        sums = parts.groupBy("i", "k").agg(F.sum("s").alias("s")).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("v"))
        out: list = [None] * len(models)
        for r in sums.collect():
            out[r["i"]] = np.array(r["v"]).reshape(2, width, nodes, bins_).transpose(2, 1, 3, 0)
        return out

    def fit(self, models: Sequence[Boost], trees: int) -> Sequence[Boost]:
        """Add ``trees`` trees to each model."""
        for _ in range(trees):
            number = len(models[0].trees)
            if number and number - self.base >= self.settle_every and any(m.depth > 1 for m in models):
                self._settle(models)
            allowed = []
            for m in models:
                m.trees.append(Tree.blank(m.depth))
                rng = np.random.default_rng([m.seed, number])
                take = max(1, round(m.column_share * len(self.columns)))
                allowed.append(sorted(rng.permutation(len(self.columns))[:take].tolist()))
            for level in range(max(m.depth for m in models)):
                for m, columns, hist in zip(models, allowed, self._histograms(models, level, allowed)):
                    if hist is None:
                        continue
                    tree, start = m.trees[-1], 2**level - 1
                    for k, (gain, c, cut, nulls, (lg, lh, rg, rh)) in enumerate(best_splits(hist[..., 0], hist[..., 1], m.penalty, m.min_weight, columns)):
                        node = start + k
                        if level == 0:
                            g, h = hist[0, columns[0], :, 0].sum(), hist[0, columns[0], :, 1].sum()
                            tree.value[0] = -g / (h + m.penalty) if h > 0 else 0.0
                        if gain > m.min_gain:
                            tree.column[node], tree.cut[node], tree.null_left[node] = c, cut, nulls
                            tree.value[2 * node + 1], tree.value[2 * node + 2] = -lg / (lh + m.penalty), -rg / (rh + m.penalty)
        return models

    def staged(self, models: Sequence[Boost], stages: Sequence[int], cut: float = 0.5) -> DataFrame:
        """(i, stage, obs, call, n, loss): calls and log loss of model ``i`` after each stage's trees, on the rows of its fold (on all without one), from one fit."""
        read, base = self._read(models), self.base
        if base:  # margins of earlier stages need all trees
            plain = ManyBoosts.__new__(ManyBoosts)
            plain.columns, plain.base = self.columns, 0
            read = plain._read(models)
        limit = float(np.log(cut / (1 - cut)))
        tables = [[m.table(a, b) if m.depth == 1 else None for a, b in zip([0, *stages], stages)] for m in models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(models), len(stages), 4, 2))
            for y, _, f, bins, _ in (block for batch in batches for block in read(batch)):
                for i, m in enumerate(models):
                    mine = slice(None) if m.repeat < 0 else f[:, m.repeat] == m.fold
                    b, truth, eta, done = bins[mine], y[mine], 0.0, 0
                    for s, stage in enumerate(stages):
                        eta, done = eta + m.margin(b, done, stage, tables[i][s]), stage
                        cell = 2 * (truth > 0).astype(int) + (eta > limit)
                        total[i, s, :, 0] += np.bincount(cell, minlength=4)
                        total[i, s, :, 1] += np.bincount(cell, np.logaddexp(0, eta) - truth * eta, minlength=4)
            i, s, cell = np.nonzero(total[..., 0])
            stage = np.array(list(stages))[s]
            arrays = [pa.array(i), pa.array(stage), pa.array(cell >= 2), pa.array(cell % 2 == 1), pa.array(total[i, s, cell, 0].astype(np.int64)), pa.array(total[i, s, cell, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "stage", "obs", "call", "n", "loss"])

        parts = self.rows.mapInArrow(run, "i long, stage long, obs boolean, call boolean, n long, loss double")
        return parts.groupBy("i", "stage", "obs", "call").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
