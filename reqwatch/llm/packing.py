"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens.  Only the histogram of piece lengths, at most `capacity` rows,
comes to the driver.  There bins are filled one after the other: the longest length left seeds a bin, a subset-sum
dynamic program over a bitset of reachable fills finds the fullest feasible combination of the lengths left, and that
combination is removed as often as the counts allow.  Pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table, text_slices, words_of

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; beyond them it begins anew.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: About so many pieces are ranked in one task.
RANKED = 50_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies show bytes as: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts.

    The tokenizer's pieces never cross white space, so a text's ids are its words' ids in a row; each word goes to the
    tokenizer once and is found by its hash from then on.  Words of Latin letters, which the normaliser only lower-cases
    and the pattern never splits, go straight to its model, many at a time.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.room = Tokenizer.from_file(path), remembered
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain, self.letters = pre_tokenizers.WhitespaceSplit(), _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = dict(zip(",.", self._encode([",", "."]), strict=True))
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: rising, of words that are not known."""
        found = self._fresh(words)
        data = [found[w] for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        ids = np.frombuffer(b"".join(data), "<u4")
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.size, self.hashes = np.insert(self.size, at, size), np.insert(self.hashes, at, hashes)
        self.used += len(ids)

    def slice_ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids, joined, and the number of ids of each row."""
        hashes, starts, ends, counts = words_of(raw, offsets)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        if len(self.hashes) > self.room:
            self._forget()
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        fresh = self.hashes[at] != unique if len(self.hashes) else np.ones(len(unique), bool)
        if fresh.any():
            data = raw.tobytes()
            self._learn(unique[fresh], [data[i:j].decode("utf-8", "replace") for i, j in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, unique)
        size = self.size[at][which]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[at][which] - upto + size, size) + np.arange(upto[-1])]
        return ids, np.diff(np.append(0, upto)[np.append(0, np.cumsum(counts))])

    def text_ids(self, text: str) -> np.ndarray:
        """One text's ids from the tokenizer itself."""
        return np.frombuffer(self._encode([text])[0], "<u4")

    def _encode(self, words: list[str]) -> list[bytes]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False) if words else []
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _encode_letters(self, words: list[str]) -> dict[str, bytes]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, self.plain
        groups = [words[i : i + 128] for i in range(0, len(words), 128)]
        out = {}
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            data, ends = ids.tobytes(), [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            out.update((w, data[i:j]) for w, i, j in zip(group, ends, ends[1:], strict=False))
        return out

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        plain, other = [], []
        for w in words:
            base = w[:-1] if w[-1] in ",." else w
            if base.isalpha() and max(base) <= "\xff":
                low = base.lower()
                plain.append((w, low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)))
            else:
                other.append(w)
        ids = self._encode_letters(list({k for _, k in plain}))
        out = {w: ids[k] + self.marks[w[-1]] if w[-1] in ",." else ids[k] for w, k in plain}
        out.update(zip(other, self._encode(other), strict=True))
        return out


def _piece_batches(batches, path: str, capacity: int):
    encode = WordEncoder(path)
    for batch in batches:
        for at, rows, raw, offsets in text_slices(batch.column(0), batch.column(1), SLICE):
            ids, counts = encode.slice_ids(raw, offsets)
            low, ends, out = raw.tobytes().lower(), np.append(0, np.cumsum(counts)), []
            odd = any(t in low for t in encode.special)
            for k, doc in enumerate(batch.column(0).slice(at, rows).to_pylist()):
                own = ids[ends[k] : ends[k + 1]]
                if odd and any(t in low[offsets[k] : offsets[k + 1]] for t in encode.special):
                    own = encode.text_ids(raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
                tokens = np.append(own, np.uint32(END_ID)).astype("<u4").tobytes()
                for piece, lo in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[lo : lo + 4 * capacity]
                    out.append((doc, piece, lo // 4, len(part) // 4, zlib.crc32(part)))
            doc, piece, start, length, crc = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32).  A null text is empty: one piece that holds the end id alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _piece_batches(it, path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Fill:
    """One combination of lengths, made `times` times."""

    uses: list[tuple[int, int]]
    times: int


def fullest(limit: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, copies) of the largest total of at most limit.  Bit s of a bitset says whether the total s can be reached."""
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= limit), reverse=True):
        left, unit = min(counts[length], limit // length), 1
        while left and not reach >> limit & 1:  # copies in powers of two
            take = min(unit, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, unit = left - take, 2 * unit
        if reach >> limit & 1:
            break
    total, uses = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            uses[length] = uses.get(length, 0) + take
    return sorted(uses.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Fill]:
    """Minimum bin slack on a histogram of lengths.  There are at most about as many fills as lengths."""
    left, fills = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        if not left[seed]:
            del left[seed]
        uses = dict(fullest(capacity - seed, left)) if seed < capacity else {}
        left[seed] = left.get(seed, 0) + 1
        uses[seed] = uses.get(seed, 0) + 1
        times = min(left[k] // n for k, n in uses.items())
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        fills.append(Fill(sorted(uses.items(), reverse=True), times))
    return fills


def _places(fills: list[Fill]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, copies in a bin, first bin, offset of the first copy), by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    bin_at = 0
    for f in fills:
        offset = 0
        for length, n in f.uses:
            rows.setdefault(length, []).append((rank.get(length, 0), n, bin_at, offset))
            rank[length] = rank.get(length, 0) + n * f.times
            offset += length * n
        bin_at += f.times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place_batches(batches, places: dict[int, np.ndarray]):
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            row = places[int(k)]
            first, n, base, start = row[np.searchsorted(row[:, 0], rank[at], "right") - 1].T
            bins[at] = base + (rank[at] - first) // n
            offset[at] = start + (rank[at] - first) % n * k
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"sequence_id": bins, "offset": offset})


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; repeated rows are packed each.

    Ranks within a length are counted in salted parts, so one length may hold most pieces.  A null text is empty; null
    and repeated ids are passed on as they are, an empty table has no pieces, and other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.save(pieces(docs, path or tokenizer_path(), capacity, id_col, text_col), "pieces")
    salts = cut.count() // RANKED + 1
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = scratch.save(cut.groupBy("length", "salt").agg(F.count("*").alias("c")), "parts")
    histogram = {r.length: r.c for r in parts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_bins(histogram, capacity)))  # some rows for each length, at most capacity lengths
    before = F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")
    parts = parts.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("own", own).join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    return ranked.mapInArrow(lambda it: _place_batches(it, places.value), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of the documents lies, null and repeated ids included."""
    return pack(docs)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
