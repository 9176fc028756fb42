"""Bounded-space online packing of token sequences into windows of fixed size."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import stored, sub_batches

END = 1
#: White space by Unicode, as the byte-level pre-tokenizer sees it. Its tokens never run on past a letter, number or sign into white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def merge_ranks(model: dict) -> tuple[dict[bytes, int], str] | None:
    """Bytes to rank, and the pattern, of a byte-level model whose merges are in order of their ids; else None."""
    from public_tokenizers import PATTERN

    split, bpe = model.get("pre_tokenizer") or {}, model["model"]
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model.get("normalizer") or not byte_level or bpe.get("type", "BPE") != "BPE" or bpe.get("ignore_merges") or bpe.get("dropout"):
        return None
    # byte-level vocabularies write a byte as itself where it prints in Latin-1, the others in order from code point 256
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    written = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    added = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {bytes(written[c] for c in token): i for token, i in bpe["vocab"].items() if token not in added}
    made = [bpe["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in bpe["merges"]]
    if made != sorted(made) or len(made) + 256 != len(ranks) or any(ranks[bytes([b])] >= made[0] for b in range(256)):
        return None
    return ranks, PATTERN


class Encoder:
    """A text to its 32-bit ids, as the tokenizers library gives them for the whole text.

    Where the file's merges are in order of their ids, tiktoken applies them, which takes a fraction of the time
    (``tests/llm`` compares the two); other files and texts with an added token go to the tokenizers library. A text above ``most`` characters is
    encoded in parts that start with white space behind another character: no token reaches across such a place.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        model = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in model.get("added_tokens", ())]
        found = merge_ranks(model)
        self.merges = tiktoken.Encoding("file", pat_str=found[1], mergeable_ranks=found[0], special_tokens={}) if found else None

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.most and (cut := CUT.search(text, at + self.most)):
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:] if at else text

    def __call__(self, text: str) -> np.ndarray:
        if self.merges is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        parts = [self.merges.encode_to_numpy(part) for part in self.parts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    return Encoder(path)


class Windows:
    """At most ``most`` open windows of ``size`` tokens. A piece goes into the fullest window it fits."""

    def __init__(self, size: int, most: int, close: Callable[[list], None]):
        self.size, self.most, self.close = size, most, close
        self.open: list[tuple[int, int]] = []  # (free, number), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, piece: tuple, length: int) -> None:
        i = bisect_left(self.open, (length, -1))
        if i < len(self.open):
            free, k = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.close(self.held.pop(self.open.pop(0)[1]))  # the fullest
            free, k = self.size, self.made
            self.made += 1
            self.held[k] = []
        self.held[k].append(piece)
        if free > length:
            insort(self.open, (free - length, k))
        else:
            self.close(self.held.pop(k))

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.held[k] for _, k in self.open]


PIECE = "doc {id}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, most_open: int = 64, fan_in: int = 32, end: int = END
) -> DataFrame:
    """Every token of every document in one piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and then ``end``; null text is empty, so it is one token. Full windows are cut off first; the remainder goes
    best-fit into one of ``most_open`` open windows of its partition, and when none fits the fullest is emitted
    and a new one opened. Windows open at the end of a partition are left over: leftovers of ``fan_in`` partitions meet in
    a task that fills windows from the smallest of them, cutting pieces, and this repeats until one task is
    left, so that a single window of the table can end up short. Leftovers carry their ids: less than
    ``most_open`` windows for each partition. Rows with the same id or none are documents of their own. An empty table gives no sequence.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ddl = PIECE.format(id=kind) + ", ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer), []
        number = [TaskContext.get().partitionId() << 32]
        mark = int(end).to_bytes(4, "little")

        def emit(pieces: list, is_open: bool = False) -> None:
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), total, number[0], offset, is_open, ids if is_open else None))
                offset += n
            number[0] += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names)
            out.clear()
            return batch

        windows = Windows(size, most_open, emit)
        for batch in sub_batches(batches, "t"):
            for doc, t in zip(batch.column("doc").to_pylist(), batch.column("t").to_pylist()):
                ids = encode(t).astype("<u4", copy=False).tobytes() + mark
                total, start = len(ids) // 4, 0
                while total - start >= size:
                    emit([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                    start += size
                if start < total:
                    windows.place((doc, start, ids[4 * start :], total), total - start)
            if len(out) > 5000:
                yield flush()
        for pieces in windows.rest():
            emit(pieces, True)
        if out:
            yield flush()

    arrow = arrow_schema(ddl)
    now = stored(rows.mapInArrow(first, ddl), "packed")
    done = [now.where("not open")]
    left = now.where("open")
    parts = 1 + (left.agg(F.max(F.shiftright("window", 32))).first()[0] or 0)
    groups = -(-parts // fan_in)
    level = 1
    while True:
        merged = stored(merge_leftovers(left, ddl, size, groups, level), "packed")
        if groups == 1:
            done.append(merged)
            break
        done.append(merged.where("not open"))
        left, groups, level = merged.where("open"), -(-groups // fan_in), level + 1
    names = [F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset"]
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return whole.select(*names)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def merge_leftovers(left: DataFrame, ddl: str, size: int, groups: int, level: int) -> DataFrame:
    """Windows filled to the brim from left-over pieces; the last of each group stays open."""
    arrow = arrow_schema(ddl)
    fan = F.pmod(F.shiftright("window", 32), F.lit(groups)).cast("int")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                group = row.pop("_group")
                if last is None or group != last[0]:
                    if last:
                        yield from finished(out, True)
                    last, number, offset = (group,), (level << 56) + (group << 32), 0
                ids, start, total = row["ids"], row["start"], row["doc_tokens"]
                while ids:
                    n = min(size - offset, len(ids) // 4)
                    piece = ids[: 4 * n]
                    out.append((row["doc"], start, n, zlib.crc32(piece), total, number, offset, True, piece))
                    ids, start, offset = ids[4 * n :], start + n, offset + n
                    if offset == size:
                        yield from finished(out, False)
                        number, offset = number + 1, 0
        yield from finished(out, True)

    def finished(out: list, is_open: bool) -> Iterator[pa.RecordBatch]:
        if out:
            rows = [(*r[:7], is_open, r[8] if is_open else None) for r in out]
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=arrow.names)

    dealt = left.withColumn("_group", fan).repartition(max(groups, 1), "_group").sortWithinPartitions("_group", "window", "offset")
    return dealt.mapInArrow(fill, ddl)
