from __future__ import annotations

import hashlib
import random
import re

from llm_fixtures import none, odd, odd_rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from fuzzmill.llm import exact_dedup as ed
from fuzzmill.llm import simhash as sh
from fuzzmill.llm.components import components

KEY = lambda i: (i is None, i or 0)  # noqa: E731  null ids last


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    return sorted(((r[0], min(groups[norm(r[1])], key=KEY), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows), key=str)


def check_exact(df, rows, **how):
    got = ed.exact_duplicates(df, **how).collect()
    want = brute_exact(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == sorted((str(a), str(b), n) for a, b, n, _ in want)
    assert sum(r["kept"] for r in got) == len({x[3] for x in want})
    if not how:
        assert sorted((str(r["doc_id"]), r["digest"]) for r in got) == sorted((str(x[0]), x[3]) for x in want)


def test_exact_matches_brute(odd, odd_rows):
    check_exact(odd, odd_rows)


def test_colliding_digests_are_settled_by_bytes(odd, odd_rows):
    check_exact(odd, odd_rows, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    check_exact(odd, odd_rows, digest=lambda c: F.lit("all"))


def test_exact_empty_table(none):
    assert ed.exact_duplicates(none).collect() == []
    assert ed.drop_exact_duplicates(none).collect() == []


def test_exact_keeps_one_row_and_all_columns(spark, odd, odd_rows):
    wide = odd.withColumns({c: F.lit(c) for c in ("digest", "kept", "keep_id", "sig", "n", "id", "bytes", "_sig", "first")})
    left = ed.drop_exact_duplicates(wide)
    assert left.columns == wide.columns
    texts = [re.sub(r"\s+", " ", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({x[3] for x in brute_exact(odd_rows)})


def test_state_continues_with_later_arrivals(spark, scratch):
    path, state = f"{scratch}/in", f"{scratch}/state"
    for rows in ([(2, "a b"), (3, "c")], [(1, "a  b"), (4, "d")]):
        ed.arrivals(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).write.mode("append").parquet(path)
        schema = "digest STRING, id BIGINT, sig BIGINT"
        ed.ingest(spark.readStream.schema(schema).parquet(path), state)
    got = {(r["keep_id"], r["n"]) for r in ed.state_table(spark, state).collect()}
    assert got == {(1, 2), (3, 1), (4, 1)}


def brute_groups(rows, bits=3):
    fps = [sh.simhash(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= bits:
                up[root(a)] = root(b)
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(root(k), []).append(r[0])
    return sorted(((str(r[0]), fps[k], str(min(ids[root(k)], key=KEY))) for k, r in enumerate(rows)))


def test_simhash_by_hand():
    from xxhash import xxh64_intdigest

    h = [xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d", "c d e")]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert sh.simhash("A b\tC \x0b d\n e") & (2**64 - 1) == want
    assert sh.simhash("One two") & (2**64 - 1) == xxh64_intdigest(b"one two", 42)
    assert sh.simhash("") == sh.simhash(None) == sh.simhash(" \n") == 0
    assert sh.simhash("É x") != sh.simhash("é x")  # only A-Z are lowered


def test_simhash_blocks_do_not_change_the_result(monkeypatch):
    text = " ".join(str(k * k % 977) for k in range(3000))
    whole = sh.simhash(text)
    monkeypatch.setattr(sh, "HASH_BLOCK", 100)
    assert sh.simhash(text) == whole


def test_simhash_groups_match_brute(spark, odd, odd_rows):
    got = sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in sh.near_duplicates(odd).collect())
    assert got == brute_groups(odd_rows)
    left = sh.drop_near_duplicates(odd.withColumns({c: F.lit(1) for c in ("fp", "rep", "component_id", "_n", "w")}))
    assert left.count() == len({x[2] + str(x[1]) * (x[2] == "None") for x in brute_groups(odd_rows)})


def test_ball_search_finds_all_links(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1}
    for b in base:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp BIGINT")
    for bits in (0, 1, 2, 3):
        got = {r["node"]: r["component"] for r in components(sh.near_links(df, bits)).collect()}
        up = {x: x for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in fps:
            for b in fps:
                if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                    ra, rb = root(a), root(b)
                    up[max(ra, rb)] = min(ra, rb)
        assert got == {x: root(x) for x in fps if root(x) != x}


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path[::-1] + star, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 40)}}


def test_simhash_empty_table(none):
    assert sh.near_duplicates(none).collect() == []
    assert sh.drop_near_duplicates(none).collect() == []
