"""Line dedup and chat formatting against SQL, brute force and odd input."""

import hashlib
import string

import oracle
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat, line_dedup
from riskloom.llm.base import QUERIES, SQL
from riskloom.llm.queries import op2_chat_prefix_targets, op7_line_dedup_runs  # noqa: F401


@pytest.mark.parametrize("name", ["op2_chat_prefix_targets", "op7_line_dedup_runs"])
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.compare(spark, oracle.duck(sf_dir), name, QUERIES[name], SQL[name], sf_dir) is None


def brute_lines(rows, least=10):
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(table) for x in (t or "").split("\n")]
    first = {}
    for i, t in rows:
        if i is not None:
            for k in keys(t):
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        stay = [x for x, k in zip((t or "").split("\n"), keys(t)) if i is None or len(k) < least or first[k] == i]
        out.append((i, len(keys(t)), len(keys(t)) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_lines_of_odd_rows(spark, tricky, batches, fanout):
    got = line_dedup.dedup_lines(tricky.withColumn("n_lines", F.lit("mine")), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "lang", "score", "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(tricky.limit(0)).count() == 0


def test_lines_ties_and_case(spark):
    rows = [(3, "ÉCOLE SUPÉRIEURE\nsame same same"), (1, "école supérieure\n SAME same same\t"), (2, "short\nshort\nsame same same\nsame same same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: rows[1][1], 2: "short\nshort", 3: "ÉCOLE SUPÉRIEURE"}


def test_lines_with_clashing_names_and_text_ids(spark, tricky):
    """Columns named as the operator's own, in any case, stay; ids may be text."""
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    names = ["_gone", "_doc", "_th", "doc", "th", "gone", "t", "given", "h1", "pos", "k", "line"]
    got = line_dedup.dedup_lines(tricky.select("*", *[F.lit(n).alias(n) for n in names]))
    assert got.columns == ["doc_id", "text", "lang", "score", *names, "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    named = [(None if i is None else f"d{i:03}", t) for i, t in rows]
    got = line_dedup.dedup_lines(spark.createDataFrame(named, "doc_id string, text string"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(named)


def test_defaults_compact(spark, sf_dir, monkeypatch):
    seen = []
    plain = line_dedup.Runs.add
    monkeypatch.setattr(line_dedup.Runs, "add", lambda self, rows: (plain(self, rows), seen.append([len(level) for level in self.levels]))[0])
    line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert [0, 1] in seen and seen[-1] == [1, 1]


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(fanout=2)
    for k in range(4):
        part = spark.range(k * 3, k * 3 + 5).select(F.col("id").alias("h1"), F.lit(0).alias("h2"), F.lit(k).alias("doc"))
        assert runs.unseen(part).count() == (5 if k == 0 else 3)
        runs.add(runs.unseen(part))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.levels[2][0].count() == 14


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\b \\l <\\ [\\", None, "", "a\nb\n", "日本 <s>"]
    rows = [(1, k, ("user", "assistant", "system", None, "x\n[y]\\", "assistant")[k], t) for k, t in enumerate(texts)]
    rows += [(2, 0, "user", "only a question"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "user", "first"), (None, 0, "assistant", "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.prefix_targets(turns)
    got = examples.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("m")).collect()
    by = {(r.conv_id, r.target): r for r in got}
    assert set(by) == {(1, 1), (1, 5), (2, 0), (3, 1), (3, 2), (None, 0)}
    assert [(t.role, t.text) for t in by[1, 5].turns] == [(r[2] or "", r[3] or "") for r in rows[:6]]
    assert [(t.role, t.text) for t in by[1, 1].turns] == [(r[2] or "", r[3] or "") for r in rows[:2]]
    assert (by[1, 1].m, by[1, 5].m, by[2, 0].m, by[2, 0].loss_length) == (texts[1], texts[5], "", 0)
    assert [t.text for t in by[3, 2].turns] == ["first", "a", "b"] and by[3, 2].m == "b"
    assert chat.prefix_targets(turns.limit(0)).count() == 0


def test_digest_of_the_tricky_conversation(spark, sf_dir):
    row = op2_chat_prefix_targets(spark, sf_dir).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
