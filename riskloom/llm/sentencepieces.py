"""SentencePiece merge models by a table of last tokens.

Merging is a function of the text alone, so every prefix of a text has exactly one encoding, which its last token and
the encoding of the shorter prefix before it make up. A token that matches at the end of a prefix is that
last token if and only if it can stand next to the last token of the prefix before it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from riskloom.llm.base import with_computed

MARK = "▁"


class IntTable:
    """Keys (not negative) to values in flat arrays, looked up for many keys at once."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: list[int], values: list[int]) -> None:
        """New keys."""
        last = len(self.keys) - 1
        for key, place, value in zip(keys, self._place(np.array(keys, np.int64)).tolist(), values):
            while self.keys[place] >= 0:
                place = (place + 1) & last
            self.keys[place], self.values[place] = key, value
        self.held += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not there."""
        out = np.full(len(keys), -1, np.int32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            found = self.keys[place]
            hit = found == keys[left]
            out[left[hit]] = self.values[place[hit]]
            on = ~hit & (found >= 0)
            left, place = left[on], (place[on] + 1) & (len(self.keys) - 1)
        return out


class MergeTable:
    """The pieces of a merge model with byte fallback, identity normalization and a dummy prefix."""

    def __init__(self, path: str, most_known: int = 500_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.encode("", out_type=int) or model.normalize(" a  ﬁ ") != MARK + MARK + "a" + MARK + MARK + "ﬁ" + MARK:
            raise ValueError("only models without normalization and with a dummy prefix can be used")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        #: When a piece is made: the better its score the earlier; characters are there from the start.
        self.order = [-1.0] * n
        for i in plain:
            if len(self.pieces[i]) > 1:
                self.order[i] = -model.get_score(i)
        self.surface = [p.replace(MARK, " ").encode() for p in self.pieces]
        for value, i in self.bytes_of.items():
            self.surface[i] = bytes([value])
        self.chars = {p for p in self.ids if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        reached = [p for p, i in self.ids.items() if len(p) == 1 or self._last_merge(p, i)]
        for piece in reached:
            self.automaton.add_word(piece, (self.ids[piece], len(piece)))
        self.automaton.make_automaton()
        # the same automaton's states in arrays, to follow many words at once: 0 is the start, a step is (state, character)
        steps: dict[tuple[int, str], int] = {}
        ends = {}
        for piece in reached:
            state = 0
            for c in piece:
                state = steps.setdefault((state, c), len(steps) + 1)
            ends[state] = self.ids[piece]
        self.steps = IntTable(max(12, (4 * len(steps)).bit_length()))
        self.steps.put([(state << 21) + ord(c) for state, c in steps], list(steps.values()))
        self.ends = np.full(len(steps) + 1, -1, np.int32)
        self.ends[list(ends)] = list(ends.values())
        self.lengths = np.array([len(p) for p in self.pieces])
        self.pairs = IntTable(21)
        longer = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            self.chunk = re.compile("(?s).+")  # pieces cross white space: no cutting
        elif any("\n" in p for p in longer):
            self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            self.chunk = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.most_known = most_known

    def _last_merge(self, piece: str, i: int) -> bool:
        """Merge the characters of a piece; keep its two halves if it comes out whole."""
        parts, halves = list(piece), None
        while len(parts) > 1:
            made = [(self.order[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids]
            if not made:
                return False
            k = min(made)[1]
            halves = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if any(h not in self.ids for h in halves):
            return False
        self.halves[i] = (self.ids[halves[0]], self.ids[halves[1]])
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can be neighbours: at no time of their making did a pair across their border go first.

        Going back in time, the one made later is undone; of two made by the same merge the right one was later.
        """
        key = left * len(self.pieces) + right
        known = self.compatible.get(key)
        if known is not None:
            return known
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        order, pieces, before, inclusive = self.order, self.pieces, float("inf"), False
        good = True
        while True:
            across = self.ids.get(pieces[left] + pieces[right])
            if across is not None and (order[across] < before or inclusive and order[across] == before):
                good = False
                break
            if order[left] < 0 and order[right] < 0:
                break
            if order[left] > order[right]:
                before, inclusive, left = order[left], False, self.halves[left][1]
            else:
                before, inclusive, right = order[right], True, self.halves[right][0]
        self.compatible[key] = good
        return good

    def _known_characters(self, text: str) -> list[int]:
        last, lengths = [-1] * len(text), [0] * len(text)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(text):
            if last[end] < 0:
                start = end - length
                if start < 0 or last[start] >= 0 and fits(last[start], token):
                    last[end], lengths[end] = token, length
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= lengths[at]
        return ids[::-1]

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk; a character outside the vocabulary is its bytes and parts the text."""
        if self.chars.issuperset(chunk):
            return self._known_characters(chunk)
        ids, held = [], []
        for c in chunk:
            if c in self.chars:
                held.append(c)
            else:
                ids += self._known_characters("".join(held)) if held else []
                ids += [self.bytes_of[b] for b in c.encode("utf-8", "replace")]
                held = []
        return ids + (self._known_characters("".join(held)) if held else [])

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        known = self.pairs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.pairs.held + len(new) > len(self.pairs.keys) // 2:
                self.pairs = IntTable(max(21, (4 * len(new)).bit_length()))
                new = np.unique(keys)
            self.pairs.put(new.tolist(), [self.fits(*divmod(k, len(self.pieces))) for k in new.tolist()])
            known = self.pairs.get(keys)
        return known > 0

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of known characters, one after the other, and how many each has.

        The automaton is followed from every character of every word at once. Then all prefixes of one length get
        their last token together: of the pieces that match at their end the one that fits behind the last token of the prefix before it.
        """
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        end_of, begin_of = np.repeat(begins + sizes, sizes), np.repeat(begins, sizes)
        starts, states, ends, tokens = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], []
        for depth in range(int(sizes.max())):
            states = self.steps.get((states << 21) + codes[starts + depth])
            token = self.ends[states]
            match = (states >= 0) & (token >= 0)
            ends.append(starts[match] + depth)
            tokens.append(token[match])
            on = (states >= 0) & (starts + depth + 1 < end_of[starts])
            starts, states = starts[on], states[on].astype(np.int64)
            if not len(starts):
                break
        ends, tokens = np.concatenate(ends), np.concatenate(tokens)
        place = ends - begin_of[ends]  # matches in order of the prefix's length, shorter pieces first
        order = np.argsort(place, kind="stable")
        ends, tokens, cuts = ends[order], tokens[order], np.searchsorted(place[order], np.arange(int(sizes.max()) + 1))
        last = np.full(len(codes), -1, np.int32)
        for a, b in zip(cuts, cuts[1:]):
            end, token = ends[a:b], tokens[a:b]
            before = end - self.lengths[token]
            inside = before >= begin_of[end]
            previous = np.where(inside, last[np.maximum(before, 0)], -1)
            good = ~inside
            good[inside] = self._fit(previous[inside], token[inside])
            last[end[good]] = token[good]
        at, word, found = begins + sizes - 1, np.arange(len(words)), []
        counts = np.zeros(len(words), np.int64)
        while len(word):
            found.append((word, last[at]))
            counts[word] += 1
            at = at - self.lengths[last[at]]
            on = at >= begins[word]
            at, word = at[on], word[on]
        ids, upto = np.zeros(int(counts.sum()), "<i4"), np.cumsum(counts)
        for back, (word, token) in enumerate(found):
            ids[upto[word] - 1 - back] = token
        return ids, counts

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        together, got = [], {}
        for chunk in chunks:
            if len(chunk) <= 64 and "\0" not in chunk and self.chars.issuperset(chunk):
                together.append(chunk)
            else:
                ids = self.merge(chunk)
                got[chunk] = (np.array(ids, "<i4").tobytes(), b"".join([self.surface[i] for i in ids]))
        for at in range(0, len(together), 50_000):
            words = together[at : at + 50_000]
            ids, counts = self.merge_all(words)
            data, cuts = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
            surfaces = "\0".join(words).replace(MARK, " ").encode().split(b"\0")  # a known character stands for itself
            got.update(zip(words, zip([data[a:b] for a, b in zip(cuts, cuts[1:])], surfaces)))
        return got

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and the bytes that those ids stand for."""
        chunked = [self.chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*chunked).difference(self.known))
        if new:
            learned = self._learn(new)
            if len(self.known) + len(new) > self.most_known:
                self.known = {c: self.known[c] for c in set().union(*chunked).intersection(self.known)}
            self.known.update(learned)
        out = []
        for chunks in chunked:
            ids, surface = zip(*map(self.known.__getitem__, chunks)) if chunks else ((), ())
            out.append((b"".join(ids), b"".join(surface)))
        long = [c for c in new if len(c) > 64]
        for c in long:
            del self.known[c]
        return out


def decoded(surface: bytes) -> str:
    """The text of the bytes that ids stand for, without the space of the dummy prefix."""
    return surface.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def encode_and_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int, as the library encodes the whole text) and ``decoded``, the text of those ids.

    ``model`` is the path of a merge model that every executor can read. Null or empty texts have no ids. The words of a text are
    encoded one by one, which no piece of the model can tell from encoding the whole, and remembered in a bounded table of
    the Python worker. Columns with those names are replaced.
    """

    def make():
        table = merge_table(model)

        def find(texts):
            got = table.encode_all([t or "" for t in texts])
            lengths = np.array([0] + [len(ids) // 4 for ids, _ in got])
            values = pa.array(np.frombuffer(b"".join([ids for ids, _ in got]), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), values)
            return ids, [decoded(surface) for _, surface in got]

        return find

    return with_computed(docs, text, "ids array<int>, decoded string", make)
