"""Periodic runs against a quadratic plain version."""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from fuzzmill.llm import periodic


def plain_runs(words):
    """(start, length, period) of all runs, by checking every period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if rewrite and n and doc_id is not None:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def tile_runs(words):
    """Runs by tiles, fragments and a plain stitch, without Spark."""
    ids = periodic.number_words(" ".join(words), {})
    found = {}
    for _, P, kept in periodic.square_boundaries([ids]):
        for lo, marks, part in periodic.tiles_of(ids, P, kept):
            for q, a, b in periodic.fragments_of(part, marks, P):
                found.setdefault(q, set()).add((lo + a, lo + b))
    out = []
    for q, parts in found.items():
        runs = []
        for a, b in sorted(parts):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out += [(a, b - a + q, q) for a, b in runs if b - a + q >= max(6, 4 * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    """Blocks that repeat, nested and cut, over a small alphabet."""
    words = []
    for _ in range(rng.randint(1, 8)):
        block = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            block = block * rng.randint(1, 4)
        words += (block * rng.randint(1, 9))[: rng.randint(1, 200)]
        words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_plain(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(periodic, "CORE", rng.choice([4, 32, 1024]))
    for _ in range(60):
        words = random_words(rng)
        assert tile_runs(words) == plain_runs(words)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice("ab") for _ in range(rng.randint(1, 40))]
        n = len(s)
        plain = [next((k for k in range(n - i) if s[k] != s[i + k]), n - i) for i in range(n)]
        assert periodic.z_function(s) == plain


def test_long_run_of_one_word_and_of_long_periods():
    assert tile_runs(["a"] * 5000) == [(0, 5000, 1)]
    rng = random.Random(3)
    block = [str(rng.randrange(10**6)) for _ in range(1500)]
    words = ["x"] + block * 5 + block[:700] + ["y"]
    assert tile_runs(words) == [(1, 8200, 1500)]


@pytest.mark.parametrize("rewrite", [False, True])
def test_rows_equal_plain(spark, rewrite, monkeypatch):
    rng = random.Random(5)
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n "), (4, "x " * 50), (4, "x " * 50), (4, "y"), (5, "a b " * 8)]
    rows += [(i, " ".join(random_words(rng))) for i in range(10, 90)]
    rows += [(1000 + i, " ".join(str(rng.randrange(300)) for _ in range(rng.randrange(900)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id LONG, text STRING, key STRING, runs INT").repartition(3)
    monkeypatch.setattr(periodic, "BLOCK", 64)
    got = periodic.periodic_runs(docs, rewrite=periodic.planted if rewrite else periodic.as_given)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(i, t, rewrite) for i, t in rows), key=repr)


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in periodic.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    short = [(i, t) for i, t in docs if len((t or "").split()) < 1200]
    assert len(short) > 100
    for i, t in short:
        assert got[i] == plain_row(i, t, True)
    assert sum(r[1] > 0 for r in got.values()) >= 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert periodic.periodic_runs(docs).collect() == []


def test_numbers_of_words_are_those_of_the_whole_text(monkeypatch):
    text = "a bb  a\tccc a bb"
    monkeypatch.setattr(periodic, "BLOCK", 3)
    assert np.array_equal(periodic.number_words(text, {}), [0, 1, 0, 2, 0, 1])
