"""What a Python worker and the keyed state hold between the stages of a job."""

from __future__ import annotations

import weakref

import numpy as np

from fuzzmill.llm import bpe, exact_dedup, langid
from fuzzmill.llm.util import Shipped, worker_store


def test_worker_lets_go_of_the_last_operator(spark):
    m = bpe.model(bpe.tokenizer_path())
    m.encode("some words of a text")
    assert bpe.model(bpe.tokenizer_path()) is m and len(m.cache) > 3
    gone = weakref.ref(m)
    del m
    model = langid.LanguageModel(["en"], langid.codewords(1), np.zeros((langid.BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    held = Shipped(spark, model, "langid")
    assert held.get().predict("a text")[0] == "en"
    assert gone() is None  # tokenizer and its word cache
    assert held.get() is held.get()  # kept while the operator goes on
    held.get()
    assert list(worker_store("langid")) == ["shipped"] and worker_store("bpe") == {}


def test_worker_store_of_alternating_operators():
    worker_store("a")["x"] = 1
    assert worker_store("a") == {"x": 1}
    assert worker_store("b") == {}
    assert worker_store("a") == {}


def test_state_shares_one_memory_bound(spark):
    rows = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id % 900) AS text")
    seen, put = {}, type(spark.conf).set

    def watch(self, key, value):
        seen[key] = value
        put(self, key, value)

    type(spark.conf).set = watch
    try:
        found = exact_dedup.exact_duplicates(rows).collect()
    finally:
        type(spark.conf).set = put
    prefix = "spark.sql.streaming.stateStore.rocksdb."
    assert seen[prefix + "boundedMemoryUsage"] == "true" and int(seen[prefix + "maxMemoryUsageMB"]) <= 256
    assert all(spark.conf.get(k, None) is None for k in exact_dedup.STATE_CONF)
    assert len(found) == 2000 and sum(r["kept"] for r in found) == 900
    assert all(r["keep_id"] == r["doc_id"] % 900 for r in found)
