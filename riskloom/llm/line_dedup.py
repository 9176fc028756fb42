"""Line dedup against levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from riskloom.llm.base import stored

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column | str) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


class Runs:
    """Sorted runs of ``(h1, h2, doc)``, one row for each line hash, in levels.

    A level that reaches ``fanout`` runs is compacted into one run of the next level, so that after n
    batches there are at most fanout * log(n) runs and a hash was rewritten log(n) times.
    """

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels = fanout, [[]]

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """The rows whose hash no run holds: a merge anti-join with each level."""
        for level in self.levels:
            if level:
                firsts = firsts.join(reduce(DataFrame.union, level), ["h1", "h2"], "left_anti")
        return firsts

    def add(self, rows: DataFrame) -> DataFrame:
        run = stored(rows.sortWithinPartitions("h1", "h2"), "run")
        self.levels[0].append(run)
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                merged = reduce(DataFrame.union, self.levels[i]).repartition("h1", "h2").sortWithinPartitions("h1", "h2")
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(stored(merged, "run"))
        return run


def _cuts(rows: DataFrame, batches: int) -> list:
    """Ids that cut the documents into ``batches``: quantiles of numbers; of other ids, order statistics of a hashed sample of about 10,000."""
    shares = [i / batches for i in range(1, batches)]
    if isinstance(rows.schema["doc"].dataType, IntegralType):
        return sorted({int(c) for c in rows.approxQuantile("doc", shares, 0.01)}) if shares else []
    n = rows.count() if shares else 0
    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(max(1, n // 10_000))) == 0).select(F.sort_array(F.collect_set("doc")).alias("s")).first()["s"] if n else []
    return sorted({some[int(len(some) * s)] for s in shares}) if some else []


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 3, fanout: int = 2
) -> DataFrame:
    """``docs`` with later copies of a line gone from ``text``, and ``n_lines``, ``n_dropped`` (long).

    A line whose key (see ``line_key``) has ``min_chars`` code points or more and was seen in a document
    with a smaller id goes; lines of the first document stay, repeats inside it too. Documents arrive in
    ``batches`` of rising id. The lines of a batch are combined to one row for each hash (128 bits), which is
    anti-joined with the runs of earlier batches and then becomes a run itself; a line stays when its own
    (hash, document) is in the run of its batch. That join holds the document in its key, so a line that
    many documents share is spread over all tasks.

    Null text is an empty text: one empty line. Rows with null id stay as they are and hold no lines for
    others. Rows that share an id are one document; ids are of any type that sorts. Columns of ``docs`` named ``n_lines`` or ``n_dropped``
    are replaced. An empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t")).where("doc is not null")
    edges = [None, *_cuts(rows, batches), None]
    runs, dropped = Runs(fanout), []
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        lines = part.select("doc", "th", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).select("doc", "th", "pos", line_key("line").alias("k"))
        lines = lines.where(F.char_length("k") >= min_chars).select("doc", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))
        run = runs.add(runs.unseen(lines.groupBy("h1", "h2").agg(F.min("doc").alias("doc"))))
        dropped.append(lines.join(run, ["h1", "h2", "doc"], "left_anti").select("doc", "th", "pos"))
    gone = reduce(DataFrame.union, dropped).groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))  # so that no name can clash
    own, own_text = F.col("given").getField(key), F.coalesce(F.col("given").getField(text), F.lit(""))
    joined = held.join(gone, (own == F.col("doc")) & (F.xxhash64(own_text) == F.col("th")), "left")
    lines = F.split(own_text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), own_text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    found = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    same = [kept.alias(c) if c.lower() == text.lower() else F.col("given").getField(c).alias(c) for c in docs.columns if c.lower() not in found]
    return joined.select(*same, *[c.alias(n) for n, c in found.items()])
