"""What workers and the driver hold at once."""

from __future__ import annotations

import pickle
import random
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.llm import bloom_lm, ngram_join, quality
from tidemark.llm.store import BATCH_BYTES


def _prose(rng, n_words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n_words))


def test_quality_and_ngram_workers_hold_a_small_part_of_a_batch():
    rng = random.Random(1)
    texts = [_prose(rng, 500) for _ in range(100)] * 30  # 9 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array(texts)], names=["doc_id", "t", "text"])
    for rows in (quality._vote_rows(quality._word_array(quality.INSULTS)), quality._distinct_words(None), ngram_join._set_rows(80, 5)):
        tracemalloc.start()
        n = sum(out.num_rows for out in rows(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and most < 60 << 20


def test_quality_is_fitted_on_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []
    for name in ("learn_lexicon", "fit_linear"):
        monkeypatch.setattr(quality, name, lambda *a, f=getattr(quality, name): seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or f(*a))
    assert quality.classify(docs, labels).count() == 40
    assert seen == [str(BATCH_BYTES)] * 2 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_bloom_lm_driver_sends_the_filter_in_pieces_and_frees_them(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, _prose(rng, 200)) for i in range(200)], "doc_id long, text string")
    whole = {r.doc_id: r for r in bloom_lm.score_texts(docs).collect()}
    context, sent = spark.sparkContext, []
    send = type(context).broadcast

    def broadcast(self, value):
        sent.append((send(self, value), len(pickle.dumps(value)), type(value)))
        return sent[-1][0]

    monkeypatch.setattr(bloom_lm, "SENT_BYTES", 20_000, raising=False)
    monkeypatch.setattr(type(context), "broadcast", broadcast)
    assert {r.doc_id: r for r in bloom_lm.score_texts(docs).collect()} == whole
    assert max(n for _, n, kind in sent if kind is not bloom_lm.Words) < 40_000 < sum(n for _, n, kind in sent if kind is not bloom_lm.Words)
    for piece, _, _ in sent:
        with pytest.raises(Exception, match="destroyed|No such file"):
            piece._jbroadcast.value()
