"""Vector codes against a plain integer version."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from fuzzmill.llm import vector_codes as vc


def plain(rows, parts=4, rounds=4, entries=256):
    """rows (id, vector, label) -> {(id, vector): (code, error, label_error)}, digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))

    for r in range(rounds + 1):
        found = [[nearest(p, v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in kept]
        if r == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), f in zip(kept, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, y), e in zip(kept, errors):
        by[y] = by.get(y, 0) + e
    out = [(i, "".join(f"{j:02x}" for _, j in f), e, by[y]) for (i, _, y), f, e in zip(kept, found, errors)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    codes, books = vc.compress(df)
    got = vc.label_errors(codes)
    return sorted(((r.id, bytes(r.codes).hex(), r.error, r.label_error) for r in got.collect()), key=repr), books


VEC = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, codes STRING, x INT"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "c", 1) for i, v, y in rows], VEC).repartition(parts)


def f32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_rows_equal_plain(spark):
    rng = random.Random(2)
    mids = [[rng.uniform(-2, 2) for _ in range(8)] for _ in range(30)]
    rows = [(i, f32([m + rng.gauss(0, 0.2) for m in rng.choice(mids)]), rng.choice([1, 2, None])) for i in range(900)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], None), (None, rows[3][1], 2)]
    rows += [(2000 + i, rows[5][1], 3) for i in range(300)]  # one vector many times
    rows += [(3000, None, 1), (3001, [None] * 8, 1), (3002, [float("nan")] * 8, 1), (-5, [float("inf")] + [0.0] * 7, 1)]
    got, books = rows_of(frame(spark, rows))
    want, text = plain(rows)
    assert got == sorted(want, key=repr)
    assert vc.digest(books.last) == text
    assert len(books.history) == 5


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i, [float(i), 0.0, -1.5, 2.0], None) for i in range(n)]
    got, books = rows_of(frame(spark, rows))
    want, text = plain(rows)
    assert got == sorted(want, key=repr)
    assert (vc.digest(books.last) if books else None) == text


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 4)] * 4, 0) for i in range(40)]
    got, _ = rows_of(frame(spark, rows))
    assert got == sorted(plain(rows)[0], key=repr)


def test_bounds_skip_and_never_miss():
    rng = np.random.default_rng(4)
    mids = rng.integers(-3000, 3000, (64, 6))
    x = (mids[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (4000, 6))).astype(np.int32)
    books = [x[:256].astype(np.int64)]
    groups = vc.grouped(books[0])
    assert sorted(np.concatenate(groups).tolist()) == list(range(256)) and len(groups) == vc.GROUPS
    codes, best, bounds, stamps = vc.first_assignment(x, books[0], groups)
    counter = [0, 0]
    for _ in range(6):
        c = books[-1].copy()
        for j in np.unique(codes):
            own = x[codes == j].astype(np.int64)
            c[j] = own.sum(0) // len(own)
        books.append(c)
        codes, best, bounds, stamps = vc.next_assignment(x, books, groups, vc.net_ways(books, groups), codes, bounds, stamps, counter)
        d = vc.distances(x, c)
        assert np.array_equal(codes, d.argmin(1)) and np.array_equal(best, d.min(1))
        d = d.astype(float)
        d[np.arange(len(x)), codes] = np.inf
        net = bounds - vc.net_ways(books, groups)[stamps, np.arange(len(groups))]
        for k, g in enumerate(groups):
            assert (net[:, k] <= np.sqrt(d[:, g].min(1))).all()
    assert counter[0] < 0.5 * counter[1]
    assert len(np.unique(stamps)) > 1  # bounds of several rounds are in use


def test_net_way_is_no_more_than_the_sum_of_moves():
    rng = np.random.default_rng(1)
    books = [rng.integers(-99, 99, (20, 3))]
    for _ in range(5):
        books.append(books[-1] + rng.integers(-9, 9, (20, 3)))
    groups = [np.array([j]) for j in range(20)]
    ways = vc.net_ways(books, groups)
    for then in range(len(books)):
        moves = sum((np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(books[then:], books[then + 1 :])), np.zeros(20))
        assert (ways[then] <= moves * (1 + 1e-5) + 1e-9).all()


def test_large_components_stay_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**27), 2**27, (50, 4)).astype(np.int32)
    c = rng.integers(-(2**27), 2**27, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert vc.distances(x, c).tolist() == want
    with pytest.raises(ValueError, match="after scaling"):
        vc.scaled(np.array([[3e9]]))


def test_widths(spark):
    with pytest.raises(ValueError, match="do not divide"):
        vc.compress(frame(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(ValueError, match="different widths"):
        vc.compress(frame(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, text = plain(rows)
    got = vc.op12_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {text}
