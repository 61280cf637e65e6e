"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's likelihood sums over all its
segmentations into pieces (a forward recursion); a text's is the product over its words, each a run of letters behind a
word-start mark.  Piece probabilities come from expectation maximisation over the same segmentations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "piece_bpe_32k.model"
#: About so many labelled documents of each language, picked by a hash of their ids, train it, by at most so many distinct words.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 600_000
ROUNDS, START = 3, "▁"
#: What a character outside the vocabulary weighs, and a piece that the language never used (in expected uses).
UNKNOWN, PRIOR = 1e-7, 0.01
REMEMBERED = 200_000
_LETTERS, _ONLY = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Forward and backward values that are held at once in training.
CELLS = 1 << 19


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str) -> list[str]:
    """The vocabulary's lower-case pieces of letters, of any length, with or without a word start.

    Others never count, as words are of letters alone.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    found = {p.lower() for p in found}
    return sorted(p for p in found if p == START or p.lstrip(START).isalpha())


_B = np.uint64(0x100000001B3)


class PieceIndex:
    """Finds pieces in concatenated words by rolling hashes in an open-addressed table."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.bits = pieces, 18
        self.keys, self.ids = np.zeros((1 << self.bits) + 64, np.uint64), np.full((1 << self.bits) + 64, -1, np.int32)
        self.probes, self.longest = 1, max(map(len, pieces), default=1)
        for i, p in enumerate(pieces):
            h = self._hash(np.array([ord(c) for c in p], np.uint64))
            at = int(self._slot(h)[0])
            k = 0
            while self.ids[at + k] >= 0:
                k += 1
            self.keys[at + k], self.ids[at + k] = h[0], i
            self.probes = max(self.probes, k + 1)
        self.singles = {p: i for i, p in enumerate(pieces) if len(p) == 1}

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(1, np.uint64)
        for c in codes:
            h = (h + c + np.uint64(1)) * _B
        return h ^ np.uint64(len(codes))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """For each length up to the longest piece's: the piece that begins at each place, or -1.  left: characters to the word's end."""
        h, out, n = np.zeros(len(codes), np.uint64), [], len(codes)
        padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(self.longest, np.uint64)])
        for k in range(1, self.longest + 1):
            h = (h + padded[k - 1 : k - 1 + n]) * _B
            key, found = h ^ np.uint64(k), np.full(n, -1, np.int32)
            at = self._slot(key)
            for p in range(self.probes):
                hit = (self.keys[at + p] == key) & (self.ids[at + p] >= 0)
                found[hit] = self.ids[at + p][hit]
            found[left < k] = -1
            out.append(found)
        return out


def _layout(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, code points of the marked words in that order, their starts and lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(-lengths, kind="stable")
    text = "".join([START + words[i] for i in order])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = lengths[order]
    starts = np.cumsum(lengths) - lengths
    return order, codes, starts, lengths


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    table: np.ndarray  # piece by language; the last row, for no piece, is 0

    def __post_init__(self):
        self.index = PieceIndex(self.pieces)

    def __getstate__(self):
        return self.langs, self.pieces, self.table

    def __setstate__(self, state):
        self.langs, self.pieces, self.table = state
        self.__post_init__()

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, one row per word and one column per language."""
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), 8192):
            out[at : at + 8192] = self._score(words[at : at + 8192])
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        order, codes, starts, lengths = _layout(words)
        left = np.repeat(lengths, lengths) - (np.arange(len(codes)) - np.repeat(starts, lengths))
        ids = self.index.find(codes, left)
        w, n = len(words), self.table.shape[1]
        past = [np.ones((w, n))]  # the last forward values, as many as the longest piece has characters, newest first
        scale, done = np.zeros((w, n)), np.zeros((w, n))
        for t in range(1, int(lengths[0]) + 1 if w else 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            now = np.zeros((live, n))
            for k in range(1, min(t, self.index.longest) + 1):
                i = ids[k - 1][starts[:live] + t - k]
                now += past[k - 1][:live] * self.table[i]
                if k == 1:
                    now += past[0][:live] * np.where(i < 0, UNKNOWN, 0.0)[:, None]
            if t % 12 == 0:
                top = now.max(axis=1, keepdims=True)
                top[top == 0] = 1.0
                now /= top
                past = [p[:live] / top for p in past]
                scale[:live] += np.log(top)
            past = [now, *(p[:live] for p in past[: self.index.longest - 1])]
            ended = lengths[:live] == t
            done[:live][ended] = np.log(np.maximum(now[ended], 1e-300)) + scale[:live][ended]
        out = np.empty_like(done)
        out[order] = done
        return out


def expected_uses(index: PieceIndex, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, over all segmentations under piece probabilities p (last entry 0)."""
    total = np.zeros(len(p) - 1)
    longest_first = sorted(range(len(words)), key=lambda i: -len(words[i]))
    at = 0
    while at < len(words):
        own = longest_first[at : at + max(1, CELLS // (len(words[longest_first[at]]) + 2))]
        at += len(own)
        part, weight = [words[i] for i in own], counts[own]
        order, codes, starts, lengths = _layout(part)
        weight, m = weight[order], int(lengths[0])
        left = np.repeat(lengths, lengths) - (np.arange(len(codes)) - np.repeat(starts, lengths))
        ids = index.find(codes, left)
        fore, back = np.zeros((m + 1, len(part))), np.zeros((m + 1, len(part)))
        fore[0] = 1.0
        back[lengths, np.arange(len(part))] = 1.0
        at_ = lambda t, k, live: ids[k - 1][starts[:live] + t - k]
        for t in range(1, m + 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            for k in range(1, min(t, index.longest) + 1):
                i = at_(t, k, live)
                fore[t, :live] += fore[t - k, :live] * (p[i] + (UNKNOWN * (i < 0) if k == 1 else 0))
        for t in range(m, 0, -1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            for k in range(1, min(t, index.longest) + 1):
                i = at_(t, k, live)
                back[t - k, :live] += back[t, :live] * (p[i] + (UNKNOWN * (i < 0) if k == 1 else 0))
        z = weight / np.maximum(fore[lengths, np.arange(len(part))], 1e-300)
        for t in range(1, m + 1):
            live = int(np.searchsorted(-lengths, -t, "right"))
            for k in range(1, min(t, index.longest) + 1):
                i = at_(t, k, live)
                use = fore[t - k, :live] * p[i] * back[t, :live] * z[:live]
                ok = i >= 0
                total += np.bincount(i[ok], use[ok], len(total))
    return total


def letters_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; numbers that are no digits, such as fractions, part them like all else."""
    found = _LETTERS.findall(text.lower())
    return found if not found or "".join(found).isalpha() else [w for x in found for w in _ONLY.findall(x)]


def train(counts: list[tuple[str, str, int]], path: str) -> Model:
    """counts: (language, word, occurrences)."""
    pieces = load_pieces(path)
    index = PieceIndex(pieces)
    langs = sorted({lang for lang, _, _ in counts})
    table_ = np.zeros((len(pieces) + 1, len(langs)))
    for j, lang in enumerate(langs):
        own = sorted((w, n) for k, w, n in counts if k == lang)
        p = np.full(len(pieces) + 1, 1.0 / len(pieces))
        p[-1] = 0
        for _ in range(ROUNDS if own else 0):
            uses = expected_uses(index, p, [w for w, _ in own], np.array([n for _, n in own], float)) + PRIOR
            p[:-1] = uses / uses.sum()
        table_[:, j] = p
    return Model(langs, pieces, table_)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 for held-out documents."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from documents that are not held out and have a language; no other column is read."""
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    counts = {r.lang: r.c for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("c")).collect()}
    cut = F.lit(0)
    for lang, c in counts.items():
        cut = F.when(F.col(lang_col) == lang, int(min(1.0, sample_docs / c) * (1 << 30))).otherwise(cut)
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    picked = known.where((h < cut) & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = picked.mapInArrow(_word_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = words.orderBy(F.xxhash64("word"), "lang").limit(SAMPLE_WORDS).toArrow()
    return train(list(zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)), path or vocabulary_path())


def _word_batches(batches):
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in letters_of(text):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        lang, word = zip(*seen, strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _predict_batches(batches, model: Model):
    ids, scores = _Ids(), np.zeros((0, len(model.langs)))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n = len(texts)
        best, prob = [], []
        for at in range(0, n, 512):
            words = [letters_of(t) if t else [] for t in texts[at : at + 512]]
            codes = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words]
            if len(ids) > len(scores):
                fresh = list(ids)[len(scores) :]
                scores = np.concatenate([scores, model.score(fresh)])
            for c in codes:
                if not len(c) or not model.langs:
                    best.append("und")
                    prob.append(0.0)
                    continue
                z = scores[c].sum(axis=0)
                k = int(z.argmax())
                best.append(model.langs[k])
                prob.append(float(1 / np.exp(z - z[k]).sum()))
            if len(ids) > REMEMBERED:
                ids, scores = _Ids(), scores[:0]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(best, pa.string()), "score": pa.array(prob, pa.float64())})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs.

    lang_pred is `und`, with score 0, for null texts and texts without letters; ties go to the first language by name.
    A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size times the number of languages
    held = F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict_batches(it, shared.value), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
