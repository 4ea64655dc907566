from __future__ import annotations

import random
import textwrap

import numpy as np
import pytest
from llm_fixtures import none, odd, odd_rows  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from fuzzmill.llm import langid, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, found, column):
    x = found.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column), "doc_id").where("held_out").toPandas()
    y, s = x[column].to_numpy(), x["score"].to_numpy()
    ones, zeros = s[y == 1][:, None], s[y == 0][None, :]
    return ((ones > zeros) + 0.5 * (ones == zeros)).mean(), (x["predicted"] == y).mean()


# ---- quality ---------------------------------------------------------------


def test_quality_held_out(spark):
    found = quality.op1_quality_classifier(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 1000
    auc, accuracy = held_out(spark, found, "quality")
    assert auc > 0.95 and accuracy > 0.93


def test_flat_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95
    for row, got in zip(x[:40], forest.margins(x[:40])):
        total = forest.base
        for t in range(20):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(row[forest.feature[t, k]] > forest.above[t, k])
            total += forest.leaf[t, k - 7]
        assert got == pytest.approx(total)


def test_quality_of_one_class_and_none(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert {r["score"] for r in quality.score(odd, quality.train(odd, labels)).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(20)] + [(None, 1), (3, None), (4, 7)], "doc_id BIGINT, quality INT")
    scores = quality.score(odd, quality.train(odd, ones)).collect()
    assert len(scores) == len(odd_rows) and all(r["score"] > 0.5 for r in scores)
    assert quality.score(none, quality.train(none, ones)).collect() == []
    assert np.isfinite([quality.statistics(r[1]) for r in odd_rows]).all()


def test_statistics_of_blocks(monkeypatch):
    """Every statistic of a 3 MB text, whatever the block size."""
    rng = random.Random(4)
    words = [f"w{k}" * rng.randint(1, 3) for k in range(3000)]
    text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\n\n", ". "]) for _ in range(400_000))
    text += "x" * 50_000 + "\n"
    seen = []
    for size in (1 << 30, 1 << 20, 10_007, 64):
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        seen.append(quality.statistics(text))
    assert all(np.array_equal(seen[0], s) for s in seen[1:])
    data = text.encode()
    sizes = np.array([len(w) for w in data.split()])
    lines = [len(x) for x in data.split(b"\n")]
    k = quality.N_CLASSES
    want = [sizes.mean(), sizes.std(), sizes.max() / len(data), (sizes <= 3).mean(), (sizes >= 12).mean(), len(set(data.split())) / len(sizes)]
    assert seen[0][k + 1 : k + 7] == pytest.approx(want)
    want = [len(set(data.split(b"\n"))) / len(lines), np.mean(lines) / len(data), np.std(lines) / len(data), max(lines) / len(data), np.mean(np.array(lines) == 0)]
    assert seen[0][k + 7 : k + 12] == pytest.approx(want)


def test_histogram_splits_match_a_plain_search():
    """The first tree's root split, by trying every bin edge of every column."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)).round(1)
    y = (x[:, 1] > 0.4).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = max(
        ((gain(x[:, j] <= e) + gain(x[:, j] > e), -j, -e) for j in range(3) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])))
    )
    assert (forest.feature[0, 0], forest.above[0, 0]) == (-best[1], -best[2])
    for side, leaf in ((x[:, 1] <= forest.above[0, 0], 0), (x[:, 1] > forest.above[0, 0], 1)):
        assert forest.leaf[0, leaf] == pytest.approx(-quality.RATE * g[side].sum() / (h[side].sum() + quality.RIDGE))


# ---- toxicity --------------------------------------------------------------


def toxic_rows():
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in ("tion", "ing", "ed", "er", "an") for b in ("the", "of", "st", "nd", "wh", "re")]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbolt", "snarkwit", "Vilezzo"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    """All four languages; sf0.1, where each has toxic held-out texts."""
    sf = SF.replace("0.01", "0.1")
    found = toxicity.op4_toxicity(spark, sf).where("held_out")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    x = found.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(lang, "doc_id").toPandas()
    hit = (x["predicted"] == 1) & (x["toxic"] == 1)
    assert hit.sum() / (x["toxic"] == 1).sum() >= 0.85 and hit.sum() / (x["predicted"] == 1).sum() >= 0.95
    for own in ("en", "de", "fr", "es"):
        q = x["lang"] == own
        assert (hit & q).sum() >= 0.75 * ((x["toxic"] == 1) & q).sum()


def test_toxicity_planted(spark, odd, none):
    rows, labels = toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[k] == bool(y) for k, y in labels]) > 0.98
    out = toxicity.score(odd.withColumn("score", F.lit("x")), model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    lowest = model.score("")
    assert model.score(None) == lowest < 0.5
    assert toxicity.score(none, model).collect() == []
    long = " ".join(t for _, t in rows if "grumbolt" not in t and "snark" not in t and "Vile" not in t)
    assert model.score(long * 12 + " grumbolt snarkwit vilezzo grumbolt snarkwit") > model.score(long * 12)


def test_both_dictionaries_have_content(spark):
    """Half of a toxic word is a word of clean texts as well, and clean
    texts have a word of their own."""
    rows, labels = toxic_rows()
    rows = [(k, t + (" grumb lovely" * 4 if k % 4 else "")) for k, t in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    model = toxicity.train(docs, marks)
    entries = lambda d: {d[k : k + 16] for k in range(0, len(d), 16)}
    assert toxicity.code("grumbo") in entries(model.toxic) and toxicity.code("snarkw") in entries(model.toxic)
    assert toxicity.code("grumb$") in entries(model.ordinary) and toxicity.code("lovely") in entries(model.ordinary)
    assert not entries(model.toxic) & entries(model.ordinary)
    assert model.score("a grumb grumb grumb") < model.score("a grumbolt and a snarkwit")


def test_telling_stems_equal_plain(spark):
    """Choice of dictionary entries, and gains, by plain counting."""
    rng = random.Random(6)
    rows = [(int(k % 3 == 0), " ".join(rng.choice(["alpha", "beta", "gam", "delta", "omegas"] + (["vile", "scumming"] if k % 3 == 0 else ["nice"])) for _ in range(rng.randint(5, 60)))) for k in range(300)]
    df = spark.createDataFrame(rows, "y INT, text STRING").repartition(4)
    got = {(r["stem"], r["y"]): r["weight"] for r in toxicity.telling_stems(df).collect()}
    n, texts, size = {}, {}, [0, 0]
    for y, t in rows:
        own = {}
        for w in t.split():
            for s in ([w + "$"] if len(w) < 4 else [w[:4], w + "$"] if len(w) < 6 else [w[:4], w[:6]]):
                own[s] = own.get(s, 0) + 1
        for s, k in own.items():
            n[s, y] = n.get((s, y), 0) + min(k, 4)
            texts[s, y] = texts.get((s, y), 0) + 1
            size[y] += min(k, 4)
    count = [sum(y == c for y, _ in rows) for c in (0, 1)]
    want = {}
    for s in {s for s, _ in n}:
        for y in (0, 1):
            a, b, ta, tb = n.get((s, y), 0), n.get((s, 1 - y), 0), texts.get((s, y), 0), texts.get((s, 1 - y), 0)
            rate = np.log((a + 0.5) / (size[y] + 1)) - np.log((b + 0.5) / (size[1 - y] + 1))
            share = np.log((ta + 0.5) / (count[y] + 1)) - np.log((tb + 0.5) / (count[1 - y] + 1))
            if ta >= 4 and rate > 2.0 and share > 0.5 and share / np.sqrt(1 / (ta + 0.5) + 1 / (tb + 0.5)) > 3.5:
                want[s, y] = rate * a
    assert got.keys() == want.keys() and {("vile", 1), ("nice", 0)} <= got.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    model = toxicity.ToxicityModel(toxicity.dictionary(["vile", "scummi", "scum"]), toxicity.dictionary(["nice"]), np.zeros(5))
    plain = "quick brown fox jumped over"  # nine codes: a window has room for more
    assert model.gains(plain).tolist() == [0]
    assert model.gains(plain + " scum")[0] > 0 > model.gains(plain + " nice")[0]
    assert model.gains(plain + " scumming vile")[0] > model.gains(plain + " vile")[0]


def test_toxicity_without_labels(spark, odd):
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id BIGINT, toxic INT"))
    assert all(r["score"] < 0.5 for r in toxicity.score(odd, model).collect())


def test_windows_hold_every_word_once():
    rows, _ = toxic_rows()
    model = toxicity.ToxicityModel(b"", b"", np.zeros(5))
    text = " ".join(t for _, t in rows[:60])
    codes = b"".join(w[: -len(toxicity.PAD)] for w in model.windows(text))
    assert codes == b"".join(toxicity.code(s) for s in toxicity.stems(text))
    assert {len(w) for w in list(model.windows(text))[:-1]} == {16 * toxicity.WINDOW + len(toxicity.PAD)}


def test_threshold_has_fewest_errors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 1).astype(float)
    w = toxicity.fit_logistic(x, y)
    m = x @ w[:-1]
    errors = lambda cut: ((m > cut) != y).sum()
    assert errors(-w[-1]) == min(errors(c) for c in np.concatenate((m, m - 1e-9, m + 1e-9)))


# ---- language --------------------------------------------------------------


def test_language_held_out(spark):
    found = langid.op6_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    x = found.join(docs, "doc_id").where("held_out").toPandas()
    assert found.count() == 1000 and (x["lang"] == x["lang_pred"]).mean() > 0.97 and x["score"].between(0, 1).all()


def plain_grams(text):
    data = b" " + text.lower().encode() + b" "
    out = []
    for n, k in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        for i in range(len(data) - n + 1):
            out.append((int.from_bytes(data[i : i + n], "big") * k & 0xFFFFFFFF) >> 16)
    return out


def test_language_equals_plain(spark):
    """Counts, log odds, weights and decoding in plain Python."""
    rng = random.Random(2)
    words = {"a": "alba cora nema tolo".split(), "b": "brik stak nemt gort".split(), "c": "chu xiao nemu zhe".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(3, 30))), g) for i in range(90) for g in [rng.choice("abc")]]
    rows += [(100, "alba stak", "a"), (101, None, "b"), (102, "123", "c")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    known = [(g, plain_grams(t)) for _, t, g in rows if t and any(c.isalpha() for c in t)]
    langs = sorted({g for g, _ in known})
    by = {g: [0] * langid.BUCKETS for g in langs}
    for g, grams in known:
        for x in grams:
            by[g][x] += 1
    rate = {g: [(n + 0.5) / (sum(by[g]) + 0.5 * langid.BUCKETS) for n in by[g]] for g in langs}
    code = langid.codewords(len(langs)).tolist()
    bits = range(len(code[0]))
    odds = []
    for b in bits:
        one, two = ([rate[g] for g, c in zip(langs, code) if c[b] == side] for side in (1, -1))
        odds.append([np.float32(np.log(sum(x) / len(x)) - np.log(sum(z) / len(z))) for x, z in zip(zip(*one), zip(*two))])
    margins = lambda grams: [sum(float(odds[b][x]) for x in grams) / len(grams) for b in bits]
    scale = [max(np.mean([abs(sum(r * float(o) for r, o in zip(rate[g], odds[b]))) for g in langs]) / 2, 1e-6) for b in bits]
    weight = []
    for b in bits:
        wrong = sum(margins(x)[b] * code[langs.index(g)][b] <= 0 for g, x in known)
        e = (wrong + 1) / (len(known) + 2)
        weight.append(max(np.log((1 - e) / e), 0.1))
    for i, text, _ in rows[::3] + rows[-3:]:
        if not text or text == "123":
            assert (got[i]["lang_pred"], got[i]["score"]) == (langid.UNKNOWN, 0)
            continue
        z = [min(max(v / s, -4), 4) for v, s in zip(margins(plain_grams(text)), scale)]
        loss = sorted((sum(w * np.exp(-c[b] * z[b]) for b, w in zip(bits, weight)), g) for g, c in zip(langs, code))
        assert got[i]["lang_pred"] == loss[0][1] and got[i]["score"] == pytest.approx(1 - loss[0][0] / loss[1][0], abs=1e-4)


def test_ngrams_of_blocks_are_those_of_the_text(monkeypatch):
    text = "the river runs under the bridge and the people walk by " * 20
    want = sorted(plain_grams(text))
    for size in (1 << 20, 100, 7, 4):
        monkeypatch.setattr(langid, "BLOCK_BYTES", size)
        assert sorted(np.concatenate(list(langid.blocks(text))).tolist()) == want


def test_rare_languages_are_learned(spark):
    """Six texts of a language beside 3,000 of another, whatever the sample."""
    en, de = "the river runs under the old bridge", "der fluss und das wasser ist nicht gruen"
    rows = [(k, f"{en} {k}", "en") for k in range(3000)] + [(9000 + k, f"{de} {k}", "de") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    for size in (300, 7, 2, 20_000):
        model = langid.train(df, sample_rows=size)
        assert model.languages == ["de", "en"]
        assert model.predict("das wasser und der fluss")[0] == "de" and model.predict("under the bridge")[0] == "en"
    assert langid.shares({"a": 6, "b": 3000}, 300) == {"a": 6, "b": 294}
    assert langid.shares({"a": 5, "b": 9, "c": 100}, 2) == {"a": 1, "b": 1, "c": 1}
    assert langid.sample_languages(df, "lang", "doc_id", "text", 300).count() == 300


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    if n > 2:
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (2 ** (n - 2) if n <= 6 else 5)  # corrects wrong bits


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    m = langid.LanguageModel(list("abcd"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]), np.ones(code.shape[1]))
    for k in range(4):
        for bit in range(code.shape[1]):
            z = code[k].astype(float)
            z[bit] = -z[bit]
            lang, score = m.decode(z)
            assert lang == "abcd"[k] and score > langid.AMBIGUOUS
    assert m.decode(np.zeros(code.shape[1]))[1] < langid.AMBIGUOUS


def test_language_edges(spark, odd, odd_rows, none):
    model = langid.train(odd)
    got = langid.predict(odd.withColumns({"score": F.lit("s"), "lang_pred": F.lit("l")}), model).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == langid.UNKNOWN and by[k]["score"] == 0 for k in (1, 2, 3, 4))
    assert by[14]["lang_pred"] == "de"
    left = langid.keep_identified(odd.withColumn("Extra", F.lit(1)), model)
    assert left.count() == len(odd_rows) - 4 and "Extra" in left.columns
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {langid.UNKNOWN}
    one = langid.train(odd.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.predict(odd, one).collect()} == {langid.UNKNOWN, "de"}


# ---- licences --------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def test_license_notices_and_prose(spark, licence_model, odd_rows):
    rng = random.Random(9)
    prose = ["the river runs under the old bridge and people walk by", "permission to be free is a fine thing, said the author of the source", "version 2 of the plan was given to all"]
    rows, want = [], set()
    for k, (family, notices) in enumerate(sorted(licenses.NOTICES.items())):
        for n, notice in enumerate(notices):
            i = 100 * k + n
            rows.append((i, "\n".join([rng.choice(prose), notice.upper() if n % 2 else "  " + notice, rng.choice(prose)])))
            want.add((i, 1, family))
    rows += [(9000 + k, p) for k, p in enumerate(prose)] + [(r[0], r[1]) for r in odd_rows]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("family", F.lit("x")), licence_model).collect()
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]}
    assert want <= found
    assert not {f for f in found if f[0] is None or f[0] >= 9000}


def test_license_scores_match_plain_python(spark, licence_model):
    m = licence_model
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["paragraph"]): (r["family"], round(r["probability"], 9)) for r in licenses.scan(docs, m).collect()}
    at = dict(zip(m.terms, m.weights))
    want = {}
    for r in docs.collect():
        for k, p in enumerate(r["text"].split("\n")):
            w = licenses._notice_words(p)
            own = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} & at.keys()
            z = np.array(m.intercepts) + sum((np.array(at[t]) for t in own), np.zeros(len(m.intercepts)))
            chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if chance.argmax() and chance[1:].max() >= m.least:
                want[r["doc_id"], k] = (m.families[chance.argmax()], round(float(chance[1:].max()), 9))
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)


def test_license_empty_table(spark, none, licence_model):
    assert licenses.scan(none, licence_model).collect() == []
    model = licenses.train(none)
    found = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id BIGINT, text STRING"), model).collect()
    assert [(r["family"], r["confirmed"]) for r in found] == [("mit", True)]


def test_license_training_reads_every_paragraph(spark, monkeypatch):
    """Ordinary paragraphs are counted in all documents and all different
    paragraphs, copies once, notices not; what they say often is no feature."""
    monkeypatch.setattr(licenses, "SAMPLE_DOCUMENTS", 5, raising=False)
    monkeypatch.setattr(licenses, "SAMPLE_PARAGRAPHS", 10, raising=False)
    notice = next(t for t in licenses.NOTICES["mit"] if len(t) > 200)
    rows = [(k, f"the river of the licence house {k}\nthe river\n\n{notice if k % 9 == 0 else ''}") for k in range(6000)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    every = sorted({t for own in licenses.NOTICES.values() for text in own for w in [licenses._notice_words(text)] for t in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:])))})
    found = licenses.ordinary(docs, "text", licenses.NOTICES, every).collect()
    assert len(found) == 6001
    own = {*every}
    want = {p: own & {*p.split(), *(f"{a} {b}" for a, b in zip(p.split(), p.split()[1:]))} for p in (f"the river of the licence house {k}" for k in range(6000))}
    assert sum(len(r["terms"]) for r in found) == sum(map(len, want.values())) + 1  # "the" of the copies
    rare = [(k, f"word {k}" + (" permission" if k < 40 else "")) for k in range(8000)]
    model = licenses.train(spark.createDataFrame(rare, "doc_id BIGINT, text STRING"))
    assert "permission" not in licenses.train(spark.createDataFrame([(k, f"{t} permission") for k, t in rare], "doc_id BIGINT, text STRING")).terms
    assert model.least <= 0.9


def test_license_wrapped_notices(spark, licence_model):
    rows, want = [], set()
    for k, (family, notices) in enumerate(sorted(licenses.NOTICES.items())):
        for n, notice in enumerate(notices):
            lines = textwrap.wrap(notice, 40 if n % 2 else 72, break_on_hyphens=False)
            rows.append((100 * k + n, "\n".join(["a line", "", *((" * " if n % 2 else "") + p for p in lines), "", "the river"])))
            if len(lines) > 1:
                want.add((100 * k + n, 2, family))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), licence_model).collect()
    assert len(want) > 8 and want <= {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]}
    assert len({(r["doc_id"], r["paragraph"], r["family"]) for r in got}) == len(got)


def test_license_two_notices_in_a_line(spark, licence_model):
    some = [(f, own[-2:][0]) for f, own in sorted(licenses.NOTICES.items())]
    pairs = [(a, b) for a, b in zip(some, some[1:] + some[:1])]
    prose = " the river runs slowly past the old bridge" * 100
    rows = [(k, a[1] + prose * (k % 2) + " " + b[1] + prose) for k, (a, b) in enumerate(pairs)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), licence_model).collect()
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]}
    assert {(k, 0, f) for k, pair in enumerate(pairs) for f, _ in pair} == found


def plain_passages(text):
    """Passages by plain loops over the words of a whole text."""
    words = [(w, k) for k, line in enumerate(text.split("\n")) for w in licenses._notice_words(line)]
    pairs = [f"{a[0]} {b[0]}" for a, b in zip(words, words[1:])]
    some = []
    for t, own in enumerate(licenses._templates(licenses.NOTICES)):
        for a in (i for i, p in enumerate(pairs) if p in own.bigrams):
            first = {}
            for i in range(a, min(len(pairs), a + own.width - 1)):
                if pairs[i] in own.bigrams:
                    first.setdefault(pairs[i], i)
            if len(first) >= own.least:
                share, end = len(first) / len(own.bigrams), max(first.values())
                some.append((share * min(1.0, (own.width / 2 - 1) / (end + 1 - a)), share, len(first), a - end - 2, -a, -t, own.family))
    kept = []
    for c in sorted(some, reverse=True):
        shared = sum(max(0, min(-c[4] - c[3], -x[4] - x[3]) - max(-c[4], -x[4])) for x in kept)
        if 2 * shared <= -c[3]:
            kept.append(c)
    return sorted((words[-c[4]][1], words[-c[4] - c[3] - 1][1], " ".join(w for w, _ in words[-c[4] : -c[4] - c[3]]), c[6], round(c[1], 9)) for c in kept)


def test_license_passages_match_plain(spark):
    """Notices whole, cut and altered, in prose and over lines."""
    rng = random.Random(12)
    every = [t for own in licenses.NOTICES.values() for t in own]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(every).split()
            w = w[rng.randint(0, len(w) // 3) :]
            w = [x if rng.random() > 0.05 else "other" for x in w]
            parts += ["the river runs past"] * rng.randint(0, 3) + [" ".join(w)]
        text = " ".join(parts)
        rows.append((k, "\n".join(textwrap.wrap(text, 50)) if k % 2 else text))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: sorted((x["paragraph"], x["last"], x["p"], x["said"], round(x["share"], 9)) for x in r["x"]) for r in df.select("doc_id", licenses.passages("text").alias("x")).collect()}
    want = {k: plain_passages(t) for k, t in rows}
    assert sum(map(len, want.values())) > 60
    assert got == want


def test_license_full_texts(spark, licence_model):
    """Every paragraph of every text is found in a wrapped file, and so are
    lines that no notice gives word for word."""
    rows = [(k, "\n\n".join("\n".join(textwrap.wrap(p, 72, break_on_hyphens=False)) for p in own)) for k, own in enumerate(licenses.NOTICES.values())]
    known = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), licence_model)
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in known.collect() if r["confirmed"]}
    for k, (family, own) in enumerate(licenses.NOTICES.items()):
        at = 0
        for p in own:
            n = len(textwrap.wrap(p, 72, break_on_hyphens=False))
            assert any((k, line, family) in found for line in range(at, at + n)), (family, p)
            at += n + 1
    lines = [
        ("mit", "MIT License"), ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of this Software."),
        ("bsd", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        ("apache-2.0", "    You may obtain a copy of the License at"), ("isc", "# SPDX-License-Identifier: ISC"), ("gpl", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("bsd", "/* SPDX-License-Identifier: BSD-2-Clause */"), ("gpl", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991"), ("apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
        ("boost", "Boost Software License - Version 1.0"), ("epl-2.0", "Eclipse Public License - v 2.0"), ("json", "The Software shall be used for Good, not Evil."),
    ]
    got = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(lines)], "doc_id BIGINT, text STRING"), licence_model).collect()
    sure = {(r["doc_id"], r["family"]) for r in got if r["confirmed"]}
    assert [(k, f) for k, (f, _) in enumerate(lines) if (k, f) not in sure] == []


def test_license_other_texts(spark, none):
    """Further licences come in as texts."""
    own = licenses.templates({"house": "Use of this recipe is free for all cooks of the village.\n\nThe village keeps the name\nof the recipe."}, {"house": ["House-1.0"]})
    assert own["house"][1:] == ["The village keeps the name of the recipe.", "SPDX-License-Identifier: House-1.0"]
    model = licenses.train(none, notices=own)
    rows = [(1, "a\nuse of this recipe is free\nfor all cooks of the village"), (2, "MIT License"), (3, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), model).collect()
    assert [(r["doc_id"], r["family"], r["confirmed"]) for r in got] == [(1, "house", True)]
