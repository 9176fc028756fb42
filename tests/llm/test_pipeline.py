"""Each stage of the pipeline on what the one before kept, by brute force."""

import corpus_pipeline
import public_tokenizers
from test_native import brute_lines
from test_near import brute_components
from test_texts import brute_spans

from riskloom.llm import secret_scan


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]
    held = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        held.append(docs.toPandas())
    raw, told, lines, single, clean, packed = held
    for stage in (told, lines, single, clean):
        assert list(stage.columns) == corpus_pipeline.COLUMNS and (stage.text.str.len() == stage.n_chars).all()
    assert set(told.doc_id) <= set(raw.doc_id) and len(told) >= 0.97 * len(raw)
    assert sorted(zip(lines.doc_id, lines.text)) == sorted((i, t) for i, _, _, t in brute_lines(list(zip(told.doc_id, told.text))))
    assert sorted(single.doc_id) == sorted(i for i, _, c in brute_components(list(zip(lines.doc_id, lines.text)), 5) if i == c)
    texts = dict(zip(single.doc_id, single.text))
    assert set(clean.doc_id) == set(texts)
    scan = secret_scan.scanner(secret_scan.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for i, t in zip(clean.doc_id, clean.text):
        assert not brute_spans(t) and t == secret_scan.redacted(texts[i], scan(texts[i]))
    assert set(packed.doc_id) == set(clean.doc_id)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_odd_rows(spark, tricky):
    docs = tricky.selectExpr("doc_id", "text", "lang", "cast(score as string) as source", "score as n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() > 0
        assert stage(spark, docs.limit(0), "").count() == 0
