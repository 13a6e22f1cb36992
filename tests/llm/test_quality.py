"""Quality: held-out accuracy, and what happens at the edges."""

import zlib

import numpy as np
import pytest

from custodia.llm import quality
from custodia.llm.queries import QUERIES


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality"](spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert all(rows.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows.index)
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    test = rows[rows.held_out].join(labels, how="inner")
    ranks = test.score.rank()
    good, bad = (test.quality == 1).sum(), (test.quality == 0).sum()
    area = (ranks[test.quality == 1].sum() - good * (good + 1) / 2) / (good * bad)
    assert area > 0.97 and (test.predicted == test.quality).mean() > 0.95
    assert test.predicted[test.quality == 1].mean() > 0.97


def test_bradley_terry_finds_the_direction():
    rng = np.random.default_rng(0)
    true = np.array([2.0, -1.0, 0.0])
    d = rng.normal(size=(20_000, 3))
    d[rng.random(20_000) > 1 / (1 + np.exp(-d @ true))] *= -1
    w = quality.bradley_terry(d)
    assert np.abs(w - true).max() < 0.1


def test_features_of_odd_texts():
    for t in ("", " \n ", "a", "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "ignore") + "x", "word " * 200_000, "\x00\x01", "é" * 10):
        f = quality.text_features(t)
        assert len(f) == len(quality.NAMES) and np.isfinite(f).all()


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, None), (None, 0)], [(1, 1), (2, 1)]])
def test_without_two_labels_everything_is_accepted(spark, rows):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, None, "y", 6), (None, "", None, None), (1, "a b", "x", 5)], "doc_id long, text string, score string, predicted int")
    model = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    assert [r.predicted for r in out.collect()] == [1] * 4
    assert quality.score(docs.limit(0), model).count() == 0
