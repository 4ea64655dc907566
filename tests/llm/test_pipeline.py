from __future__ import annotations

import os
import re

import corpus_pipeline as cp
import pytest
from llm_fixtures import none, odd, odd_rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fuzzmill.llm import bpe, langid, simhash
from fuzzmill.llm.util import stored

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op7_benchmark_decontamination", "op9_exact_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = sorted(tuple(map(str, r)) for r in got.select(*cols).collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.select(*cols).fetchall())


def brute(rows, model, bench):
    """The stages one after the other in plain Python."""
    from test_text import brute_hits

    rows = [r for r in rows if model.predict(r[1])[0] != langid.UNKNOWN]
    best: dict = {}
    for r in sorted(rows):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    rows = sorted(best.values())
    fps = [simhash.simhash(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3:
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    return [r for r in rows if not brute_hits(r[1], bench)[1]]


def test_pipeline_matches_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = langid.train(langid.learnable(docs))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], model, bench)
    got = {r["doc_id"]: r for r in cp.run(spark, SF).collect()}
    assert sorted(got) == [i for i, _ in want] and 0 < len(want) < docs.count()
    m = bpe.model(bpe.tokenizer_path())
    assert all(list(got[i]["ids"]) == m.encode(t).tolist() for i, t in want)


def test_stages_on_odd_rows(spark, odd, odd_rows, none):
    wide = odd.withColumns({c: F.lit(c) for c in ("score", "kept", "fp", "sig", "ids_extra", "Digest", "spans")})
    for docs, rows in ((wide, len(odd_rows)), (none, 0)):
        for name, stage in cp.STAGES[:-1]:
            out = stored(stage(spark, docs, SF), f"test-{name}")
            assert out.columns == docs.columns and out.count() <= rows
            docs = out
        last = cp.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count()


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert os.path.basename(cp.__file__) == "corpus_pipeline.py"
