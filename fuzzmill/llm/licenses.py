"""License scans with a trained paragraph classifier.

A paragraph is a line of a text, or a passage: a run of words, over line
breaks or inside a line, that holds at least half of a notice's bigrams
(``CONFIRM`` of them for a notice of more than ``LONG``).  So wrapped notices
are scored whole, and each of several notices in a line by itself.  Notices
are titles, header lines, customary notices and the paragraphs of short
licences (licence_texts.py); ``templates`` makes them of any other texts, as
the ``notices`` of ``train``.  A paragraph's features are the word unigrams
and bigrams that occur in the notices and are rare in ordinary paragraphs.  A
sparse (L1) multinomial logistic regression, trained with Spark ML on the
notices, on cut-down variants of them and on all different paragraphs of the
table but a fifth of them held back, gives each paragraph a licence family or
``unknown``.  The
probability from which a family counts is calibrated on paragraphs held back
from training, and never above that of a whole notice.  A prediction is
confirmed by comparing the paragraph with the family's notices: the share of
the best notice's bigrams that the paragraph holds.  A passage that holds
``CONFIRM`` of a notice is of that notice's family where the classifier takes
it for none, or for a family whose notices are less like it.

The main path is DataFrame expressions only.  Model and notices are literals
in the plan (a few hundred terms); a paragraph without any term that speaks
for a family is ``unknown`` by the model's own intercepts, so one regular
expression passes over whole texts and only paragraphs with such a term are
scored.  Passages are looked for in texts that hold one of the bigrams which
no passage can do without, in overlapping blocks of words, so the work grows
with the text's length.  For training, paragraphs are reduced to the terms
that notices have before they are shuffled, and paragraphs alike in the rare
ones of these are one row with their number.

Edge cases: null and empty texts have no paragraphs; a very long line is
scored whole, and its passages are found in blocks; rows that repeat an id, or
have none, are scanned separately; a wording that several licences share is
named by the first that lists it; of families of equal probability the first
counts, of passages alike the earlier and then the first notice; an empty table
trains on the notices alone and finds nothing; further columns, whatever their
names, are left out.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import SPDX, TEXTS
from .util import stored, table

UNKNOWN = "unknown"
#: A term in a larger share of ordinary paragraphs is no feature.
COMMON_SHARE = 0.002
#: Share of a notice's bigrams that confirms a prediction.
CONFIRM = 0.8
#: Share of a notice's bigrams from which a run of words is a passage, and
#: under which a paragraph is ordinary.
NEAR = 0.5
#: A notice of more bigrams has to be held to ``CONFIRM`` by a passage.
LONG = 24
#: Passages are looked for in blocks of so many words (and those around them).
BLOCK = 512
REGULARISATION = 0.002


def templates(texts: dict[str, str], spdx: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Notices by family: the paragraphs of its text (between blank lines),
    and a header line for each of its identifiers."""
    out = {f: [" ".join(p.split()) for p in re.split(r"\n\s*\n", t) if p.strip()] for f, t in texts.items()}
    for f, ids in (spdx or {}).items():
        out.setdefault(f, []).extend(f"SPDX-License-Identifier: {i}" for i in ids)
    return out


NOTICES = templates(TEXTS, SPDX)
Notices = dict[str, list[str]]
_SPLIT = r"[^\p{L}\p{N}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def bigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def terms(text: Column | str) -> Column:
    """Distinct word unigrams and bigrams."""
    return let(words(text), lambda w: F.array_distinct(F.concat(w, bigrams(w))))


def paragraphs(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _literal(texts: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def _notice_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _notice_bigrams(text: str) -> list[str]:
    w = _notice_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def similarity(text: Column | str, notices: list[str]) -> Column:
    """Largest share of a notice's bigrams that a paragraph holds."""
    shares = [(b, float(len(b))) for b in map(_notice_bigrams, notices)]
    own = let(words(text), bigrams)
    return let(own, lambda o: F.greatest(F.lit(0.0), *[F.size(F.array_intersect(o, _literal(b))) / F.lit(n) for b, n in shares]))


def holds(text: Column | str, terms: list[str]) -> Column:
    """Whether a text holds one of the terms (true for some others too).
    The terms are one regular expression that branches letter by letter, so
    that its time hardly grows with their number."""
    if not terms:
        return F.lit(False)
    held = set(terms)
    short = sorted(t for t in held if not (" " in t and held & set(t.split())))
    sep, end = r"[^\p{L}\p{N}]++", r"(?![\p{L}\p{N}])"

    def branch(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for t in rest:
            by.setdefault(t[:1], []).append(t[1:])
        ways = [(sep if c == " " else re.escape(c)) + branch(more) if c else end for c, more in by.items()]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return F.rlike(F.lower(text), F.lit(r"(?<![\p{L}\p{N}])" + branch(short)))


@dataclass
class Template:
    family: str
    bigrams: list[str]
    least: int  # bigrams that a passage holds at least
    width: int  # words that a passage spans at most


def _templates(notices: Notices) -> list[Template]:
    out = []
    for family, own in notices.items():
        for text in own:
            b = _notice_bigrams(text)
            out.append(Template(family, b, math.ceil((CONFIRM if len(b) > LONG else NEAR) * len(b)), 2 * len(_notice_words(text))))
    return out


def _anchors(notices: Notices) -> list[str]:
    """Bigrams of which every passage holds one: of each notice the longest,
    one more than a passage can lack."""
    return _needed([(t.bigrams, t.least) for t in _templates(notices)])


def _needed(held: list[tuple[list[str], int]]) -> list[str]:
    return sorted({b for own, least in held for b in sorted(own, key=lambda b: (-len(b), b))[: len(own) - least + 1]})


def _passages(block: Column, own: list[Template]) -> Column:
    """Passages of a block of (w, k) words, best first, as (share of the
    notice's bigrams, less by as much as the passage is longer than the notice,
    share itself, number of them, -length, -start, -number of the notice): no
    passage has more than half of its words in better ones."""
    kind = "array<struct<rank:double,share:double,held:int,short:int,early:int,first:int>>"
    every = sorted({b for t in own for b in t.bigrams})
    rows = [{"b": t.bigrams, "least": t.least, "width": t.width, "first": -k} for k, t in enumerate(own)]
    notices = F.from_json(F.lit(json.dumps(rows)), "array<struct<b:array<string>,least:int,width:int,first:int>>")
    pairs = let(F.transform(block, lambda x: x["w"]), bigrams)
    hits = F.filter(F.transform(pairs, lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: x["b"].isin(every))

    def at(start: Column, inside: Column, notice: Column) -> Column:
        def cut(held: Column) -> Column:
            found = F.array_distinct(held["b"])
            end = F.array_max(F.transform(found, lambda b: F.element_at(held["i"], F.array_position(held["b"], b).cast("int"))))
            share = F.size(found) / F.size(notice["b"])
            return F.struct(
                (share * F.least(F.lit(1.0), (notice["width"] / 2 - 1) / (end + 1 - start))).alias("rank"), share.alias("share"), F.size(found).alias("held"), (start - end - 2).alias("short"), (-start).alias("early"), notice["first"].alias("first"),
            )

        return let(F.filter(inside, lambda x: (x["i"] >= start) & (x["i"] + 1 < start + notice["width"])), cut)

    def of_notice(h: Column, notice: Column) -> Column:
        inside = F.filter(h, lambda x: F.array_contains(notice["b"], x["b"]))
        return let(inside, lambda own: F.filter(F.transform(own, lambda x: at(x["i"], own, notice)), lambda c: c["held"] >= notice["least"]))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(-a["early"] - a["short"], -b["early"] - b["short"]) - F.greatest(-a["early"], -b["early"]))

    def add(kept: Column, c: Column) -> Column:
        shared = F.aggregate(kept, F.lit(0), lambda n, k: n + overlap(c, k))
        return F.when(2 * shared > -c["short"], kept).otherwise(F.concat(kept, F.array(c)))

    def best(h: Column) -> Column:
        near = F.filter(notices, lambda q: F.size(F.array_intersect(h["b"], q["b"])) >= q["least"])
        found = F.flatten(F.transform(near, lambda q: of_notice(h, q))).cast(kind)
        return F.aggregate(F.sort_array(found, asc=False), F.expr(f"cast(array() as {kind})"), add)

    return let(hits, best)


def passages(text: Column | str, notices: Notices = NOTICES) -> Column:
    """Passages of a text: paragraph (number of the first line), last (of the
    last line), p (the words), said (the family of the notice it is most
    like), share (of that notice's bigrams)."""
    known = _templates(notices)
    lap = max(t.width for t in known)
    lines = F.transform(paragraphs(text), lambda p, k: F.transform(words(p), lambda w: F.struct(w.alias("w"), k.alias("k"))))

    def block(start: Column, own: Column) -> Column:
        low = F.greatest(start - lap, F.lit(0))

        def cut(part: Column) -> Column:
            mine = F.filter(_passages(part, known), lambda c: (low - c["early"] >= start) & (low - c["early"] < start + BLOCK))
            held = F.transform(mine, lambda c: F.struct(F.slice(part, 1 - c["early"], -c["short"]).alias("x"), (1 - c["first"]).alias("said"), c["share"].alias("share")))
            return F.transform(
                held,
                lambda h: F.struct(
                    F.element_at(h["x"], 1)["k"].alias("paragraph"), F.element_at(h["x"], -1)["k"].alias("last"), F.array_join(h["x"]["w"], " ").alias("p"),
                    F.element_at(_literal([t.family for t in known]), h["said"]).alias("said"), h["share"].alias("share"),
                ),
            )

        return let(F.slice(own, low + 1, start - low + BLOCK + lap), cut)

    return let(F.flatten(lines), lambda own: F.flatten(F.transform(F.sequence(F.lit(0), F.size(own), F.lit(BLOCK)), lambda start: block(start, own))))


@dataclass
class LicenceModel:
    terms: list[str]
    weights: list[list[float]]  # by term: one weight for each of the families
    intercepts: list[float]
    least: float  # probability from which a family counts
    notices: Notices

    @property
    def families(self) -> list[str]:
        return [UNKNOWN, *self.notices]

    def cues(self) -> list[str]:
        """Terms that speak for a family against ``unknown``."""
        return [t for t, w in zip(self.terms, self.weights) if max(w[1:]) > w[0]]

    def logits(self, own: Column) -> Column:
        """One logit for each of the families, from a paragraph's terms."""
        rows = F.from_json(F.lit(json.dumps([{"t": t, "w": w} for t, w in zip(self.terms, self.weights)])), "array<struct<t:string,w:array<double>>>")
        held = F.array_intersect(own, F.from_json(F.lit(json.dumps(self.terms)), "array<string>"))
        active = let(held, lambda h: F.filter(rows, lambda x: F.array_contains(h, x["t"])))
        start = F.from_json(F.lit(json.dumps(self.intercepts)), "array<double>")
        return F.aggregate(active, start, lambda acc, x: F.zip_with(acc, x["w"], lambda a, b: a + b))


def _variants(notice: str) -> list[str]:
    """The notice, and it without its first or last words."""
    w = notice.split()
    cut = max(1, len(w) // 4)
    return [notice, *([" ".join(w[cut:]), " ".join(w[:-cut])] if len(w) > 6 else [])]


def _known(text: Column | str, known: list[str]) -> Column:
    """Distinct word unigrams and bigrams of a text that are in ``known``."""
    one, two = [t for t in known if " " not in t], [t for t in known if " " in t]
    return let(words(text), lambda w: F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(one)), F.filter(bigrams(w), lambda x: x.isin(two)))))


def ordinary(docs: DataFrame, text_col: str, notices: Notices, vocabulary: list[str]) -> DataFrame:
    """(terms, held) of every different paragraph that is like no notice:
    its terms that notices have, and whether it is held back from training."""
    pairs = [_notice_bigrams(t) for own in notices.values() for t in own]
    known = sorted({*vocabulary, *(b for own in pairs for b in own)})
    lines = docs.select(F.explode(paragraphs(text_col)).alias("p")).where(F.length("p") > 0)
    lines = lines.select(F.xxhash64(F.lit(5), "p").alias("h"), _known("p", known).alias("terms"))
    lines = lines.groupBy("h").agg(F.first("terms").alias("terms"))
    # a paragraph like a notice holds one of these, so few are compared
    some = _needed([(own, math.ceil(NEAR * len(own))) for own in pairs])
    share = F.greatest(F.lit(0.0), *[F.size(F.array_intersect("terms", _literal(own))) / F.lit(float(len(own))) for own in pairs if own])
    near = F.when(F.exists("terms", lambda t: t.isin(some)), share >= NEAR).otherwise(False)
    return lines.where(~near).select("terms", (F.pmod("h", F.lit(5)) == 0).alias("held"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Notices = NOTICES) -> LicenceModel:
    """A model of the notices against all paragraphs of ``docs``."""
    spark = docs.sparkSession
    examples = [(float(k), v, n == 0) for k, own in enumerate(notices.values(), 1) for text in own for n, v in enumerate(_variants(text))]
    said = spark.createDataFrame(examples, "label DOUBLE, p STRING, whole BOOLEAN")
    said = stored(said.select("label", terms("p").alias("terms"), "whole"), "licence-notices")
    every = CountVectorizer(inputCol="terms", outputCol="x").fit(said).vocabulary
    plain = stored(ordinary(docs, text_col, notices, every), "licence-plain")

    n = plain.count()
    common = plain.select(F.explode("terms").alias("t"))
    common = {r["t"] for r in common.groupBy("t").count().where(F.col("count") > COMMON_SHARE * n).collect()}
    vocabulary = [t for t in every if t not in common]
    rare = F.array_sort(F.filter("terms", lambda t: t.isin(vocabulary)))
    plain = stored(plain.groupBy("held", rare.alias("terms")).agg(F.count(F.lit(1)).cast("double").alias("weight")), "licence-terms")
    count = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="x")
    rows = said.select("label", "terms", F.lit(1.0).alias("weight"))
    share = max(n, 1) / max(len(examples), 1)
    if n:
        rows = rows.withColumn("weight", F.lit(share)).unionByName(plain.where("not held").select(F.lit(0.0).alias("label"), "terms", "weight"))
    else:
        rows = rows.unionByName(spark.createDataFrame([(0.0, [], float(len(examples)))], "label DOUBLE, terms ARRAY<STRING>, weight DOUBLE"))
    fitted = LogisticRegression(featuresCol="x", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=REGULARISATION, maxIter=60, standardization=False).fit(count.transform(rows))
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().copy()
    b[0] = max(b[0], b[1:].max() + 1e-6)  # no term: unknown
    used = [k for k in range(len(vocabulary)) if abs(w[:, k]).max() > 0]
    model = LicenceModel([vocabulary[k] for k in used], [[float(x) for x in w[:, k]] for k in used], [float(x) for x in b], 0.5, notices)

    # calibrate between held-back ordinary paragraphs and whole notices
    def best(df: DataFrame, label: Column):
        return df.select(F.element_at(_softmax(model.logits(F.col("terms"))), label.cast("int") + 1).alias("p"))

    top = plain.where("held").select(F.array_max(F.slice(_softmax(model.logits(F.col("terms"))), 2, len(model.families))).alias("p")).agg(F.max("p")).first()[0]
    low = best(said.where("whole"), F.col("label")).agg(F.min("p")).first()[0]
    model.least = min(max(min(((top or 0.0) + low) / 2, low), 0.2), 0.9)
    return model


def _softmax(logits: Column) -> Column:
    z = let(logits, lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return let(z, lambda own: let(F.aggregate(own, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(own, lambda x: x / total)))


def scan(df: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph and its licence family: id, paragraph
    (number of its line, for a passage of its first line, from 0), family,
    probability, similarity to the family's nearest notice, confirmed.  A
    line has one row for a family; a line that is an unconfirmed part of a
    passage of its family has none."""
    cues, anchors = model.cues(), _anchors(model.notices)
    kind = "array<struct<paragraph:int,last:int,p:string,said:string,share:double>>"
    line = F.transform(paragraphs(text_col), lambda p, k: F.struct(k.alias("paragraph"), k.alias("last"), p.alias("p"), F.lit(UNKNOWN).alias("said"), F.lit(0.0).alias("share")))
    line = F.filter(line, lambda x: holds(x["p"], cues)).cast(kind)
    passage = F.when(holds(text_col, anchors), passages(text_col, model.notices).cast(kind)).otherwise(F.expr(f"cast(array() as {kind})"))

    def scored(x: Column) -> Column:
        def named(chance: Column) -> Column:
            family = F.element_at(_literal(model.families), F.array_position(chance, F.array_max(chance)).cast("int"))
            best = F.array_max(F.slice(chance, 2, len(model.families)))
            family = F.when(best >= model.least, family).otherwise(F.lit(UNKNOWN))
            return F.struct(*[x[c].alias(c) for c in ("paragraph", "last", "p", "said", "share")], family.alias("family"), best.alias("probability"))

        return let(_softmax(model.logits(terms(x["p"]))), named)

    def compared(x: Column) -> Column:
        near = F.lit(0.0)
        for f, own in model.notices.items():
            near = F.when(x["family"] == f, similarity(x["p"], own)).otherwise(near)
        return let(near, lambda s: decided(x, s))

    def decided(x: Column, near: Column) -> Column:
        # a passage that holds a notice is that notice, unless the classifier's family has one as like
        other = (x["share"] >= CONFIRM) & (near < x["share"])
        return F.struct(
            x["paragraph"].alias("paragraph"), x["last"].alias("last"), F.when(other, x["said"]).otherwise(x["family"]).alias("family"),
            x["probability"].alias("probability"), F.when(other, x["share"]).otherwise(near).alias("similarity"),
        )

    def found(units: Column) -> Column:
        return F.transform(F.filter(F.transform(units, scored), lambda x: (x["family"] != UNKNOWN) | (x["share"] >= CONFIRM)), compared)

    def sure(x: Column) -> Column:
        return x["similarity"] >= CONFIRM

    def same(a: Column, b: Column) -> Column:
        return (a["paragraph"] == b["paragraph"]) & (a["family"] == b["family"])

    def joined(own: Column) -> Column:
        lines, runs = own["line"], own["passage"]
        first = F.filter(runs, lambda x, i: ~F.exists(F.slice(runs, 1, i), lambda y: same(x, y)))
        more = F.filter(first, lambda x: ~F.exists(lines, lambda y: same(x, y) & (sure(y) | (x["last"] == x["paragraph"]))))

        def part(x: Column, m: Column) -> Column:
            over = F.exists(m, lambda y: (y["family"] == x["family"]) & (y["last"] > y["paragraph"]) & x["paragraph"].between(y["paragraph"], y["last"]))
            return ~sure(x) & over

        return let(more, lambda m: F.concat(m, F.filter(lines, lambda x: ~part(x, m))))

    rows = df.where(holds(text_col, [*cues, *anchors]))
    both = F.struct(found(passage).alias("passage"), found(line).alias("line"))
    rows = rows.select(F.col(id_col), F.explode(let(both, joined)).alias("x"))
    rows = rows.select(id_col, "x.paragraph", "x.family", "x.probability", "x.similarity")
    return rows.withColumn("confirmed", F.col("similarity") >= CONFIRM)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
