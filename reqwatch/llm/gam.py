"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes some twenty shares and counts, each of them a bin.  Cyclic boosting passes over the features again and
again with shallow trees of one feature, whose leaves are added to that feature's lookup table; then the pairs with the
largest gain on what is left get tables of their own, boosted the same way with trees of one cut on either feature.  A
score is the logistic of the sum of the tables' entries at a text's bins: additions of looked-up values, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_parts, table, text_slices, words_of

#: About so many labelled rows, picked by a hash of their ids, train the model.
SAMPLE_LABELS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 16, 8
CYCLES, PAIR_CYCLES, RATE, LEAST_LEAF = 150, 60, 0.1, 4.0
#: Share of the sample that says when to stop; rounds without a better loss on it after which boosting stops.
WATCHED, PATIENCE = 0.2, 20
#: A text counts as good from this score on.
THRESHOLD = 0.3

FEATURES = (
    "words", "word_bytes", "upper_share", "symbols_per_word", "bars_per_word", "marks_per_word", "digit_share", "stops_per_word", "repeats", "longest_repeat", "distinct_words", "repeated_lines", "words_per_line",
    "symbol_words", "shouted_words", "capital_words", "space_share", "high_bytes", "short_lines", "most_symbols_line",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode("latin-1"), np.uint8)] = True
    return out


_UPPER, _LOWER, _SYMBOL, _BAR, _MARK = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("#$%&*<>=~^\\{}[]@+_"), _class("|"), _class("!?")
_DIGIT, _STOP, _SPACE, _LINE = _class("0123456789"), _class(".,;:"), _class(" \t\n\x0b\x0c\r"), _class("\n")
_HIGH = np.arange(256) >= 128


def _at(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of mask lie before each bound."""
    return np.concatenate([[0], np.cumsum(mask)])[bounds]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n) if len(rows) else np.zeros(n)


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[first], minlength=n).astype(float)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; a text without words has zeros."""
    n = len(offsets) - 1
    hashes, starts, ends, words = words_of(raw, offsets)
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), words)
    total = lambda c: np.diff(_at(c[raw], offsets)).astype(float)
    upper, lower, symbols = total(_UPPER), total(_LOWER), total(_SYMBOL)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    # runs of one word: how far each place lies behind the last word that is no repeat
    place = np.arange(len(again))
    run = place - np.maximum.accumulate(np.where(again, 0, place)) if len(again) else place
    longest = np.zeros(n)
    np.maximum.at(longest, owner, run)
    inner = lambda c: np.diff(_at(c[raw], np.column_stack([starts, ends]).ravel()))[::2] if len(starts) else np.zeros(0)
    own_upper, own_lower = inner(_UPPER), inner(_LOWER)
    shouted = (own_upper >= 2) & (own_lower == 0)
    # lines, as runs of words without a line feed between them
    feeds = _at(_LINE[raw], starts) if len(starts) else np.zeros(0, np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = (feeds[1:] != feeds[:-1]) | (owner[1:] != owner[:-1])
    line = np.cumsum(opens) - 1
    lines, line_owner = _per_row(opens, owner, n), owner[opens]
    in_line = np.bincount(line).astype(float) if len(line) else np.zeros(0)
    with np.errstate(over="ignore"):
        key = np.add.reduceat(hashes * (2 * (place - np.flatnonzero(opens)[line]) + 1).astype(np.uint64), np.flatnonzero(opens)) if len(line) else hashes
    marked = inner(_SYMBOL) + inner(_BAR) > 0
    most = np.zeros(n)
    np.maximum.at(most, line_owner, np.bincount(line, marked) / in_line if len(line) else in_line)
    w = words.astype(float)
    return np.column_stack([
        np.log1p(w), _share(size - total(_SPACE), w), _share(upper, upper + lower), _share(symbols, w), _share(total(_BAR), w), _share(total(_MARK), w), _share(total(_DIGIT), size), _share(total(_STOP), w),
        _share(_per_row(again, owner, n), w), _share(longest, w), _share(_distinct(owner, hashes, n), w), 1 - _share(_distinct(line_owner, key, n), lines) * (lines > 0) - (lines == 0), np.log1p(_share(w, lines)),
        _share(_per_row(marked, owner, n), w), _share(_per_row(shouted, owner, n), w), _share(_per_row(_UPPER[raw[starts]] & ~shouted, owner, n), w), _share(total(_SPACE), size), _share(total(_HIGH), size),
        _share(_per_row(in_line < 3, line_owner, n), lines), most,
    ])


def _first_bins(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between at most bins groups of about equal size."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _bin(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, x, "right")


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with up to two cuts of one feature; g, h, c: gradients, curvatures, rows by bin."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            gs, hs, cs = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(c[a:b])
            gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
            gain[(cs[:-1] < LEAST_LEAF) | (cs[-1] - cs[:-1] < LEAST_LEAF)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), (k, a + at + 1))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = leaves.pop(k)
        leaves += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quarters(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each pair of cuts, the sums over the four fields that they part a table into."""
    s = x.cumsum(0).cumsum(1)
    a = s[:-1, :-1]
    b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
    return a, b, c, s[-1, -1] - a - b - c


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain, over no cut, of the best cut on either feature, and the table of its four leaves' values."""
    out = np.zeros(g.shape)
    if min(g.shape) < 2:
        return 0.0, out
    gs, hs = _quarters(g), _quarters(h)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    fields = [(slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for f, a, b in zip(fields, gs, hs, strict=True):
        out[f] = a[i, j] / (b[i, j] + 1.0)
    return float(gain[i, j]), out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(y: np.ndarray, z: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


@dataclass
class Model:
    start: float = 0.0
    cuts: list = field(default_factory=list)  # by feature
    tables: list = field(default_factory=list)  # by feature, one value a bin
    pairs: list = field(default_factory=list)  # (feature, feature, cuts, cuts, table)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        z = np.full(len(x), self.start)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[_bin(x[:, j], cuts)]
        for i, j, a, b, values in self.pairs:
            z += values[_bin(x[:, i], a), _bin(x[:, j], b)]
        return _logistic(z)


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the tables; without rows of both labels the score is the same for all texts."""
    good = float(y.sum())
    model = Model(float(np.log((good + 1) / (len(y) - good + 1))))
    if not 0 < good < len(y):
        return model
    watch = np.random.default_rng(0).random(len(y)) < WATCHED
    x, y, held_x, held_y = x[~watch], y[~watch], x[watch], y[watch]
    model.cuts = [_first_bins(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z, held_z = np.full(len(y), model.start), np.full(len(held_y), model.start)
    bins, held = ([_bin(rows[:, j], c) for j, c in enumerate(model.cuts)] for rows in (x, held_x))
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]

    def one(j: int) -> None:
        nonlocal z, held_z
        p = _logistic(z)
        m = len(model.tables[j])
        step = RATE * _tree(np.bincount(bins[j], y - p, m), np.bincount(bins[j], p * (1 - p), m), rows[j])
        model.tables[j] += step
        z, held_z = z + step[bins[j]], held_z + step[held[j]]

    _boost(lambda: [one(j) for j in range(len(bins))], CYCLES, lambda: _loss(held_y, held_z), model)
    z, held_z = _sum(model, x), _sum(model, held_x)
    p = _logistic(z)
    cuts = [_first_bins(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse, held = ([_bin(rows_[:, j], c) for j, c in enumerate(cuts)] for rows_ in (x, held_x))

    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_cross(*sums(i, j, p))[0], i, j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, cuts[i], cuts[j], np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))) for gain, i, j in gains[:PAIRS] if gain > 0]

    def both() -> None:
        nonlocal z, held_z
        for i, j, _, _, values in model.pairs:
            step = RATE * _cross(*sums(i, j, _logistic(z)))[1]
            values += step
            z, held_z = z + step[coarse[i], coarse[j]], held_z + step[held[i], held[j]]

    _boost(both, PAIR_CYCLES, lambda: _loss(held_y, held_z), model)
    return model


def _sum(model: Model, x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p := model.score(x), 1e-300)) - np.log(np.maximum(1 - p, 1e-300)) if len(x) else np.zeros(0)


def _boost(cycle, cycles: int, loss, model: Model) -> None:
    """Runs cycles until the watched loss has not fallen for some; the tables of its lowest stay."""
    copy = lambda: ([t.copy() for t in model.tables], [(*p[:4], p[4].copy()) for p in model.pairs])
    best, kept, since = loss(), copy(), 0
    for _ in range(cycles):
        cycle()
        if (now := loss()) < best - 1e-6:
            best, kept, since = now, copy(), 0
        elif (since := since + 1) >= PATIENCE:
            break
    model.tables, model.pairs = kept


def _feature_batches(batches):
    for batch in batches:
        for at, rows, raw, offsets in text_slices(batch.column("doc_id"), batch.column("text")):
            x = features(raw, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), batch.column("label").slice(at, rows), lists], ["doc_id", "label", "x"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 for held-out documents."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from the labels of documents that are not held out, by their texts alone.

    labels (doc_id, quality): labels other than 0 and 1 do not count.  About `sample` labelled ids are picked by hash, so
    what the driver trains on is bounded; of rows that repeat an id one trains the model.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(F.col(id_col)) != 0)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    count = known.count()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = known.where(slot < int(min(1.0, sample / max(count, 1)) * (1 << 30))).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # about `sample` rows
    found = rows.select("doc_id", "label", "text").mapInArrow(_feature_batches, "doc_id long, label double, x array<double>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.x", "r.label").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(list_parts(got.column("x"))[0].reshape(-1, len(FEATURES)), got.column("label").to_numpy())


def _score_batches(batches, model: Model, threshold: float):
    for batch in batches:
        parts = [model.score(features(raw, offsets)) for _, _, raw, offsets in text_slices(batch.column("doc_id"), batch.column("text"))]
        p = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def quality_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs; nothing is shuffled.

    A null text is scored as the empty one; a null id is not held out.  Rows that repeat an id are scored each by its
    own text.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features times bins
    held = F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score_batches(it, shared.value, threshold), "doc_id long, held_out boolean, score double, predicted int")


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
