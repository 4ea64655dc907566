"""SentencePiece BPE encoding and decoding with a prefix table.

A BPE encoding is valid exactly when every neighbouring pair of tokens is
*compatible* (the pair's text encodes to that pair), and each prefix of a
text has one encoding, so one unique last token.  ``encode_chunk`` walks
the vocabulary matches of an Aho-Corasick automaton from left to right,
stores for each prefix the match that is compatible with the last token of
the prefix before it, and recovers the ids backwards from the end.

Texts fall into chunks that no vocabulary piece crosses (a blank starts a
new one; a character that is only ever encoded as bytes stands alone), so
chunks are encoded on their own and repeated ones come from a bounded
cache.  Characters without a piece become byte tokens, or the unknown token
in a model without bytes.

Vocabulary and scores come from the model file; nothing is trained here.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import fresh, sliced, table, worker_store

#: Blank marker of the library (U+2581).
MARK = "▁"
#: Chunks kept in a worker's cache; when full it starts anew.
CACHE_CHUNKS = 300_000
#: Pair-compatibility answers kept.
CACHE_PAIRS = 1_500_000
#: Chunks longer than this are not cached.
CACHE_CHARS = 48
#: Ids turned to decimal text at a time.
BLOCK_IDS = 1 << 16


class PieceModel:
    """Tables read from a model file: pieces, scores, byte tokens."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.unk = sp.unk_id()
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.rank = {self.pieces[i]: (-sp.get_score(i), i) for i in ids if i not in special and not sp.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [self._raw(sp, i) for i in ids]
        self.decimal = [str(i).encode() for i in ids]
        # a token that merging never reaches cannot be part of an encoding
        self.reached = {p: i for p, (_, i) in self.rank.items() if self.merged(p) == [p]}
        self.auto = ahocorasick.Automaton()
        for p, i in self.reached.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        joins = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(j[1] == MARK and j[0] != MARK for j in joins):
            raise ValueError("a piece holds a blank after another character; chunks cannot be cut at blanks")
        self.joins = joins
        self.pairs: dict[int, bool] = {}
        self.wide = len(self.pieces)
        self.cache = _Cache(self)
        self.letters = set(self.reached)  # single characters among them are what matters
        self.chunks = re.compile(self._pattern()).findall

    def _pattern(self) -> str:
        """A regular expression for chunks: a blank starts one, and white
        space in no longer piece stands alone."""
        known = {c for j in self.joins for c in j}
        alone = re.escape("".join(c for c in "\n\t\r" if c not in known))
        return "|".join([f"{MARK}*[^{MARK}{alone}]+", f"{MARK}+", *([f"[{alone}]"] if alone else [])])

    def _raw(self, sp, i: int) -> bytes:
        """What a token decodes to (control: nothing)."""
        if sp.is_byte(i):
            return bytes([self.byte_of[i]])
        if sp.is_control(i):
            return b""
        if i == self.unk:
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, leftmost on
        ties.  Used to answer pair tests."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.wide + b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            got = self.pairs[key] = p[-1] + q[0] not in self.joins or self.merged(p + q) == [p, q]
        return got

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text that no merge leaves, by the prefix table."""
        last = [-1] * (len(chunk) + 1)  # last[e]: last token of chunk[:e]
        if not self.letters.issuperset(chunk):  # characters without a piece
            for e, c in enumerate(chunk, 1):
                if c not in self.letters:
                    last[e] = -2
        pairs, wide = self.pairs.get, self.wide
        for end, (tok, n) in self.auto.iter(chunk):
            if last[end + 1] == -1:
                before = last[end + 1 - n]
                if n == end + 1 or before == -2:
                    last[end + 1] = tok
                elif before >= 0:
                    good = pairs(before * wide + tok)
                    if self.compatible(before, tok) if good is None else good:
                        last[end + 1] = tok
        out: list[int] = []
        e = len(chunk)
        while e:
            tok = last[e]
            if tok == -2:
                tail = chunk[e - 1].encode()
                out.extend([self.bytes[x] for x in reversed(tail)] if self.bytes else [self.unk])
                e -= 1
            elif tok == -1:
                raise AssertionError(f"no encoding of {chunk[:e]!r}")
            else:
                out.append(tok)
                e -= len(self.pieces[tok])
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        """Chunks of a text as the library sees it (dummy blank first)."""
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def parts(self, chunk: str) -> list[str]:
        """Finer chunks: cut where two characters meet in no piece."""
        joins, out, a = self.joins, [], 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in joins:
                out.append(chunk[a:k])
                a = k
        out.append(chunk[a:])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        cache = self.cache
        return np.frombuffer(b"".join([cache[c] for c in self.split(text or "")]), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, as the library's decode gives it."""
        return self.decoded(b"".join(map(self.raw.__getitem__, ids)))

    def decoded(self, data: bytes) -> str:
        """Text of token bytes: a first blank is the dummy one; broken
        byte sequences give U+FFFD byte by byte."""
        if data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            out, a = [], 0
            while a < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(data[a : a + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                a += n
            return "".join(out)


class _Cache(dict):
    """chunk -> its ids as int32 bytes."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        m = self.model
        parts = m.parts(chunk)
        value = b"".join([self[p] for p in parts]) if len(parts) > 1 else array("i", m.encode_chunk(chunk)).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:  # make room: the older half goes
                for old in list(islice(self, CACHE_CHUNKS // 2)):
                    del self[old]
            self[chunk] = value
        return value


def model(path: str) -> PieceModel:
    """The model of this worker process, loaded once."""
    store = worker_store("bpe")
    key = ("piece-model", path)
    if key not in store:
        store[key] = PieceModel(path)
    return store[key]


def _digests(m: PieceModel, ids: np.ndarray) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the decoded text."""
    csv, dec = hashlib.sha256(), hashlib.sha256()
    if len(ids) <= BLOCK_IDS:
        ids = ids.tolist()
        csv.update(b",".join(map(m.decimal.__getitem__, ids)))
        dec.update(m.decode(ids).encode())
        return len(ids), csv.hexdigest(), dec.hexdigest()
    for a in range(0, len(ids), BLOCK_IDS):
        csv.update((b"," if a else b"") + b",".join(map(m.decimal.__getitem__, ids[a : a + BLOCK_IDS].tolist())))
    dec.update(m.decode(ids.tolist()).encode())
    return len(ids), csv.hexdigest(), dec.hexdigest()


def encode_texts(df: DataFrame, path: str, keep: list[str], text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the text that the
    ids decode to) and, unless left out, ids ARRAY<INT>.  A null text has
    no ids.  Input columns named like a result are not kept."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    keep = [c for c in keep if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in sliced(batches, len(keep)):
            ids = [m.encode(t) for t in b.column(len(keep)).to_pylist()]
            got = [_digests(m, i) for i in ids]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, *names])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    ids = ", ids ARRAY<INT>" if with_ids else ""
    rows = df.select(*keep, F.col(text_col).alias(fresh(df, "_text")[0]))
    return rows.mapInArrow(run, f"{kept}n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING{ids}")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], with_ids=False)
