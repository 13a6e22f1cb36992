"""The pipeline against a plain version of each stage, on the rows that the stage before kept."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from custodia.llm import quality

from .test_near_dup import wanted
from .test_packing import verify
from .test_pii import plain


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_every_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "pii", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        if name == "packing":
            verify(rows, {k: r["text"] for k, r in before.items()}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
            break
        assert docs.columns == names and len({r.doc_id for r in rows}) == len(rows)
        after = {r.doc_id: r.asDict() for r in rows}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            train = sorted(k for k in labels if k in before and __import__("zlib").crc32(str(k).encode()) % 5)
            model = quality.fit(np.array([quality.text_features(before[k]["text"] or "") for k in train]), np.array([labels[k] for k in train]))
            score = model.score(np.array([quality.text_features(r["text"] or "") for r in before.values()]))
            assert after == {k: r for (k, r), s in zip(before.items(), score, strict=True) if s >= 0.3}
            assert 0.7 * len(before) < len(after) < len(before)
        elif name == "exact_dedup":
            last = {}
            for k, r in sorted(before.items()):
                last[low(r["text"])] = k
            assert after == {k: before[k] for k in last.values()}
        elif name == "simhash":
            stay, _ = wanted({k: r["text"] for k, r in before.items()})
            assert after == {k: before[k] for k in stay}
        elif name == "pii":
            assert set(after) == set(before)
            for k, r in before.items():
                spans = plain(r["text"])
                changed = after[k]["text"] != r["text"]
                assert changed or not spans
                assert not changed or "<" in after[k]["text"]
                assert not plain(after[k]["text"])
                assert after[k]["n_chars"] == (len(after[k]["text"]) if changed else r["n_chars"])
        before = after


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
