from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import none, odd, odd_rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from fuzzmill.llm import bpe, chat, decontam, token_counts

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- SentencePiece ---------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path())


def test_bpe_equals_the_library(library):
    m, rng = bpe.model(bpe.tokenizer_path()), random.Random(5)
    bits = ["a", "e", "th", "in", "▁", " ", "  ", "\n", "\t", "\r", "é", "中", "文", "😀", "0", "12", ".", "...", "==", "tion", "x", "A", "THE", "\x00", "<s>", "<0x0A>", "ł", "й", "ﬁ", "'s"]
    letters = "abcdefghij" * 3 + "ABC 0123=-_*#.,'\""
    for k in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) if k % 2 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = m.encode(text).tolist()
        assert ids == library.encode(text), text
        assert m.decode(ids) == library.decode(ids), text


def test_bpe_decodes_any_ids(library):
    m, rng = bpe.model(bpe.tokenizer_path()), random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(3, 400) for _ in range(rng.randint(0, 12))]
        assert m.decode(ids) == library.decode(ids), ids


def test_bpe_cache_bound_does_not_change_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 8)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 4)
    m = bpe.PieceModel(bpe.tokenizer_path())
    text = " ".join(f"word{k % 37}ing," for k in range(400))
    assert m.encode(text).tolist() == library.encode(text)
    assert len(m.cache) <= 9


def test_encode_texts_edges(odd, odd_rows, none, library):
    wide = odd.withColumns({"n_tokens": F.lit(1), "extra": F.lit("e")})
    out = bpe.encode_texts(wide, bpe.tokenizer_path(), ["doc_id", "n_tokens", "extra"])
    assert out.columns == ["doc_id", "extra", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in out.collect())
    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), tuple(ids)))
    assert got == sorted(want)
    assert bpe.encode_texts(none, bpe.tokenizer_path(), ["doc_id"]).collect() == []


# ---- chat formatting -------------------------------------------------------

CONV = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "<|im_start|>user\nno"), (1, 3, "assistant", ""),
    (2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "user", "first"), (None, 0, "assistant", "<\\|x<||im_end|>"),
    (3, 0, "a%0A\nb", "t" * 200_000), (3, 1, "assistant", "ends with <"), (4, 0, "assistant", "|im_end|>"),
]


def test_chat_digests(spark):
    got = {r["conv_id"]: r for r in chat.format_digests(spark.createDataFrame(TURNS[::-1], CONV)).collect()}
    for conv in {r[0] for r in TURNS}:
        rows = sorted((r for r in TURNS if r[0] == conv), key=lambda r: [(x is not None, x if x is not None else 0) for x in r[1:2]] + [(x is not None, x or "") for x in r[2:]])
        turns = [(r or "", t or "") for _, _, r, t in rows]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))
        assert g["formatted_chars"] == len(chat.MARKED.render(turns))


def test_chat_turns_rebuild_the_text_and_mask_it(spark):
    out = chat.format_turns(spark.createDataFrame(TURNS, CONV).withColumn("piece", F.lit("clash"))).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: r["n"]):
        text = by.get(r["conv_id"], "")
        assert r["start"] == len(text) and r["end"] == len(text) + len(r["piece"]) and not r["rewrites"]
        by[r["conv_id"]] = text = text + r["piece"]
        if r["role"] == "assistant":
            assert chat.unescape(text[r["mask_start"] : r["mask_end"]]) in {t or "" for *_, t in TURNS}
        else:
            assert r["mask_start"] is None
    assert "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n" in by[1]


def test_chat_escape_is_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "<|im_start|>", "a", "%", "\n", "%0A"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_chat_whole_prefixes_and_windows_agree():
    turns = [("user", f"q{k}") if k % 2 else ("assistant", f"a{k}") for k in range(9)]
    whole = chat.Template(chat.MARKED.render)
    assert list(chat.spans(whole, turns)) == list(chat.spans(chat.MARKED, turns))
    headed = lambda ts: "<s>" + chat.MARKED.render(ts)
    found = list(chat.spans(chat.Template(headed), turns))
    assert "".join(s.piece for s in found) == headed(turns) and not any(s.rewrites for s in found)


def test_chat_rewriting_template_is_detected():
    # keeps only the last assistant text, as templates that drop old thoughts do
    def render(turns):
        last = max((k for k, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}:{t if r != 'assistant' or k == last else ''}]" for k, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "one"), ("user", "r"), ("assistant", "two")]
    text = ""
    flags = []
    for s in chat.spans(chat.Template(render), turns):
        text = text[: s.start] + s.piece
        flags.append(s.rewrites)
    assert flags == [False, False, False, True] and text == render(turns)


def test_chat_false_context_is_refused(spark, monkeypatch):
    """A template that erases assistant turns two turns later, and one that looks
    back two turns: whole prefixes flag the one, a stated context of one
    turn is refused for both - unless it is never looked at."""
    erase = lambda ts: chat.MARKED.render([(r, "" if r == "assistant" and k < len(ts) - 2 else t) for k, (r, t) in enumerate(ts)])
    back = lambda ts: "".join(f"{r}:{t}:{ts[k - 2][1] if k > 1 else ''};" for k, (r, t) in enumerate(ts))
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(9)]
    assert any(s.rewrites for s in chat.spans(chat.Template(erase), turns))
    for render in (erase, back):
        with pytest.raises(ValueError, match="depends on more than"):
            list(chat.spans(chat.Template(render, context=1), turns))
    assert list(chat.spans(chat.Template(back, context=2), turns)) == list(chat.spans(chat.Template(back), turns))
    calls = []
    counted = chat.Template(lambda ts: calls.append(len(ts)) or chat.MARKED.render(ts), context=1)
    list(chat.spans(counted, [("user", str(k)) for k in range(1000)]))
    assert sum(calls) < 12_000  # linear
    monkeypatch.setattr(chat, "VERIFY_CHARS", 100)
    assert len(list(chat.spans(chat.MARKED, turns))) == 9


def test_chat_context_is_verified_at_any_size(monkeypatch):
    """A template that changes what it says about a turn only far into a
    conversation, and one whose ``appends`` is not its rendering; nothing is
    held of a template that says what it appends."""
    monkeypatch.setattr(chat, "VERIFY_CHARS", 100)
    turns = [("user", f"turn {k}") for k in range(60)]
    late = lambda ts: "".join(f"{r}:{t};" for r, t in ts) + ("!" if sum(len(t) for _, t in ts) > 300 else "")
    with pytest.raises(ValueError, match="depends on more than"):
        list(chat.spans(chat.Template(late, context=1), turns))
    plain = chat.Template(chat.MARKED.render, context=1)
    assert list(chat.spans(plain, turns)) == list(chat.spans(chat.MARKED, turns))

    def counted():
        seen = []
        return lambda turn: (seen.append(turn), chat.MARKED.render([turn]) + ("" if len(seen) < 40 else "!"))[1]

    with pytest.raises(ValueError, match="depends on more than"):
        list(chat.spans(chat.Template(chat.MARKED.render, 1, counted), turns))
    claim = chat._Claim(chat.MARKED)
    for turn, span in chat._spans(chat.MARKED, turns):
        claim.turn(turn, span)
    assert not claim.turns and not claim.pieces and claim.size == len(chat.MARKED.render(turns))


def test_chat_empty(spark):
    empty = spark.createDataFrame([], CONV)
    assert chat.format_digests(empty).collect() == [] and chat.format_turns(empty).collect() == []


# ---- token counts ----------------------------------------------------------


def test_long_white_space_is_the_piece_of_the_split():
    enc, rng = token_counts.encoder(token_counts.tokenizer_path()), random.Random(9)
    bits = [" ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "\u2003", "\u200b", "a", "word", "'s", "12", "!?", "中"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        for least in (2, 3):
            assert token_counts.n_tokens(enc, t, least) == len(enc.encode_ordinary(t)), t
    for blank in (" ", "\n"):  # longer than the split alone can take
        one = len(enc._encode_single_piece(blank * 1_499_999))
        assert token_counts.n_tokens(enc, "a" + blank * 1_500_000 + "b") == 1 + one + len(enc.encode_ordinary(blank + "b"))
        assert token_counts.n_tokens(enc, blank * 1_499_999) == one


def test_token_counts_match_brute(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    path = token_counts.tokenizer_path()
    enc = token_counts.encoder(path)
    n = [len(enc.encode_ordinary(t or "")) for _, t, *_ in odd_rows]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(odd, path)))
    for r in sums.collect():
        at = r["n_tokens"]
        assert r["n_docs"] == n.count(at) and r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > at for x in n), sum(x for x in n if x > at))
        assert r["truncated_total"] == sum(min(x, at) for x in n)
        assert r["quantile"] == pytest.approx(sum(x <= at for x in n) / len(n))
    limits = [0, 1, 5, 20, 1000, 10**7]
    got = {r["context_limit"]: (r["docs_longer"], r["tokens_kept"]) for r in token_counts.at_limits(sums, limits).collect()}
    assert got == {x: (sum(y > x for y in n), sum(min(x, y) for y in n)) for x in limits}
    assert token_counts.quantile(sums, 0.5) == sorted(n)[(len(n) + 1) // 2 - 1]


def test_token_counts_limit_below_every_length(spark):
    hist = spark.createDataFrame([(10, 2), (30, 1)], "n_tokens BIGINT, n_docs BIGINT")
    got = token_counts.at_limits(token_counts.suffix_sums(hist), [4]).collect()
    assert [(r["docs_longer"], r["tokens_kept"]) for r in got] == [(3, 12)]


def test_token_counts_empty(none):
    path = token_counts.tokenizer_path()
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(none, path))).collect() == []


# ---- decontamination -------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(text, bench, size=10):
    w, hit, items = fold(text), set(), set()
    for name, item in bench:
        iw = fold(item)
        for k in range(max(1, len(iw) - size + 1) if iw else 0):
            win = iw[k : k + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    items.add("" if name is None else str(name))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_wu_manber_matches_brute(spark, odd_rows, block):
    rng = random.Random(4)
    vocab = ["a", "b", "ab", "Ä", "über", "x1", "the"]
    phrase = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(k, phrase(rng.choice([1, 2, 3, 9, 10, 11, 14]))) for k in range(12)] + [(3, "b the b"), (90, None), (91, " -- "), (None, "the ab über")]
    rows = [(k, phrase(rng.randint(0, 300)) + " - " + bench[k % 12][1].upper() + "," + phrase(4)) for k in range(30)] + [(r[0], r[1]) for r in odd_rows]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({"spans": F.lit(1), "items": F.lit(2), "id": F.lit(3)})
    items = spark.createDataFrame(bench, "item_id BIGINT, text STRING")
    got = decontam.find_benchmark(df, items, block_words=block).collect()
    key = lambda x: (str(x[0]), x[1:])
    have = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got), key=key)
    assert have == sorted(((i, *brute_hits(t, bench)) for i, t in rows), key=key)
    left = decontam.drop_contaminated(df, items, block_words=block)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, t in rows if not brute_hits(t, bench)[1])


def test_wu_manber_blocks(spark):
    """Many blocks, an item longer than a block, repeated items: one Python
    stage over the documents, which walks the blocks more than a worker keeps."""
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(9)]
    phrase = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = phrase(400)
    bench = [(1, long), (2, phrase(30)), (2, phrase(12)), (3, " ".join(long.split()[50:90]))] * 40 + [(k, phrase(15)) for k in range(4, 20)]
    rows = [(k, phrase(40) + " " + " ".join(bench[k % len(bench)][1].split()[k % 7 :]) + " " + phrase(5)) for k in range(60)]
    df, items = spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(bench, "item_id BIGINT, text STRING")
    files = decontam.blocks(items, block_words=80)
    assert len(files) > 6
    found = decontam.find_benchmark(df, items, block_words=80)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    have = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in found.collect())
    assert have == [(i, *brute_hits(t, set(bench))) for i, t in rows]


def test_pieces_hold_each_window_once():
    words = [b"%d" % k for k in range(57)]
    for n in (0, 1, 9, 10, 11, 57):
        for step in (1, 3, 48, 100):
            parts = list(decontam.pieces_of(words[:n], step))
            wins = [tuple(p[k : k + 10]) for p in parts for k in range(max(1, len(p) - 9))]
            assert wins == [tuple(words[k : min(k + 10, n)]) for k in range(max(1, n - 9) if n else 0)]


def test_wu_manber_empty(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontam.drop_contaminated(odd, nothing).count() == odd.count()
    assert decontam.find_benchmark(none, nothing).collect() == []


def test_wu_manber_jumps():
    """Stretches do not hide matches that cross them."""
    win = np.array([[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], np.int32)
    m = decontam.Matcher(win)
    line = np.zeros(3000, np.int32)
    at = list(range(3, 2980, 53))
    for a in at:
        line[a : a + 10] = win[0]
    assert sorted(m.search(line)[0].tolist()) == at
