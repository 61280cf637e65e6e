"""Exact substring dedup over suffixes.

Every 100-byte string has an anchor: the place of the smallest hash among its 32-byte strings.  The anchor depends on
the string alone, so equal strings have equal anchors, and the strings of a text fall into windows that share one.
Windows whose anchor's hash occurs once cannot repeat.  The others meet by it in blocks: a block's suffix order gives a
Burrows-Wheeler transform, and intervals of it are extended backwards, breadth first, which derives common prefixes by
increasing length and stops at 100.  What the expansion has not parted by then begins with equal 100-byte strings, of
which the earliest stays.

Equal windows take part twice, as their first two copies; further copies share the verdict on the second and never
travel with their bytes.  An anchor with more windows than a block holds is cut finer: each of its strings becomes a
window of its own that goes by the hash of the whole string, through the same expansion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import without_spans
from .common import Scratch, id_marks, list_parts, marked, mix64, table, text_slices, with_document_keys

LENGTH, GRAM = 100, 32
#: Bytes of windows that one suffix order holds.
BLOCK_BYTES = 1 << 17
#: Windows of wide anchors whose strings are hashed at a time; their arrays take some 8 KB each.
CUT = 2048
#: Windows among which a task folds copies before the shuffle.
FOLDED = 1 << 17
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix64(np.arange(501, 757, dtype=np.uint64))


def rolling(raw: np.ndarray, width: int, start: np.ndarray | None = None, begun: int = 1) -> np.ndarray:
    """Hashes of the width bytes (a power of two) from each place on; the last width - 1 are not whole."""
    h, w = (_BYTE[raw] if start is None else start).copy(), begun
    power = np.uint64(1)
    base = _B
    for _ in range(int(np.log2(begun))):
        base = base * base
    while w < width:
        power = base
        h[:-w] = h[:-w] * power + h[w:]
        base = base * base
        w *= 2
    return h


def windows(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM):
    """Of the slice's texts, the runs of string starts that share an anchor: (row, first start, starts, anchor, hash)."""
    n, own = len(raw), np.diff(offsets)
    many = length - gram + 1
    with np.errstate(over="ignore"):
        h32 = rolling(raw, gram)
        order = mix64(h32)
        key = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        low, w = key, 1
        while 2 * w <= many:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        low = np.minimum(low[: n - many + 1], low[many - w :][: n - many + 1])
    left = np.repeat(offsets[1:], own) - np.arange(n)
    start = np.flatnonzero(left[: len(low)] >= length)
    if not len(start):
        return None
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    starts = np.diff(np.append(at, len(start)))
    return row[at], start[at], starts, anchor[at], order[anchor[at]], h32


def _window_batches(batches, length: int):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for at, rows, raw, offsets in text_slices(batch.column(0), batch.column(1)):
            if len(raw) < length or (got := windows(raw, offsets, length)) is None:
                continue
            row, start, starts, anchor, h, h32 = got
            half = 64 if length >= 64 else GRAM
            with np.errstate(over="ignore"):
                wide = rolling(raw, half, h32, GRAM) if half > GRAM else h32
                size = starts + length - 1
                rel = anchor - start
                g = mix64(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + rel.astype(np.uint64))
                # overlapping fixed-width hashes cover the window, however long
                longest = int(size.max())
                for k in range(-(-longest // half) + 1):
                    place = start + np.minimum(k * half, size - half)
                    g = mix64(g * np.uint64(0x165667B19E3779F9) + wide[place])
            lo = start - offsets[row]
            parts.append(np.stack([h.view(np.int64), g.view(np.int64), ids[at : at + rows][row], lo << 16 | starts << 8 | rel], 1))
            if sum(map(len, parts)) >= FOLDED:
                yield _folded(np.concatenate(parts), length)
                parts = []
        if parts:
            yield _folded(np.concatenate(parts), length)


def _folded(x: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows (h, g, doc_id, packed) less the copies that have two earlier ones here.

    Those go on as spans: h spreads them over partitions, g is a span's start and packed its end, negative.
    """
    order = np.argsort(x[:, 1])
    again = np.zeros(len(x), bool)
    again[1:] = x[order[1:], 1] == x[order[:-1], 1]
    again[:-1] |= again[1:]
    own = order[again]
    if not len(own):
        return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], names=NAMES)
    own = own[np.lexsort(x[own][:, ::-1].T)]
    y = x[own]
    nth, fresh = _counted(y)
    gone = np.zeros(len(x), bool)
    gone[own] = ~fresh | (nth >= 2)
    late = y[fresh & (nth >= 2)]
    s, e = late[:, 3] >> 16, (late[:, 3] >> 16) + (late[:, 3] >> 8 & 255) + length - 1
    order = np.lexsort((s, late[:, 2]))
    d, s, e = late[order, 2], s[order], e[order]
    head = np.ones(len(d), bool)
    head[1:] = (d[1:] != d[:-1]) | (s[1:] > e[:-1])  # windows of a text in order: their ends rise
    at = np.flatnonzero(head)
    if len(at):
        d, s, e = d[at], s[at], np.maximum.reduceat(e, at)
    spans = np.stack([mix64((d * 31 + s).view(np.uint64)).view(np.int64), s, d, -e], 1)
    out = np.concatenate([x[~gone], spans])
    return pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(4)], names=NAMES)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: how many different earlier ones each has in its (h, g), and whether it is not the row before again."""
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]).any(axis=1)
    first = np.ones(len(x), bool)
    first[1:] = (x[1:, :2] != x[:-1, :2]).any(axis=1)
    seen = np.cumsum(fresh)
    return seen - seen[np.flatnonzero(first)][np.cumsum(first) - 1], fresh


NAMES = ["h", "g", "doc_id", "packed"]


def _repeats(batches, length: int):
    """Rows sorted by (h, g, doc_id, packed): of anchors with several, the first two of each window, and all others as
    spans (h null, g start, packed end).  Holds one batch and a row."""
    last, nth, lone = None, 0, False  # the row before, its number in its window, and whether it is an anchor's first, not given yet
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(n).to_numpy() for n in NAMES], 1)
        done = x[x[:, 3] < 0]
        x = x[x[:, 3] >= 0]
        spans = [np.stack([done[:, 1], done[:, 2], -done[:, 3]], 1)]
        out = []
        if len(x):
            y = x if last is None else np.concatenate([last[None, :], x])
            k, fresh = _counted(y)
            if last is not None:
                own = (y[:, :2] == last[:2]).all(axis=1)
                k[own] += nth
            y, k = y[fresh], k[fresh]
            held = last is not None
            head = np.ones(len(y), bool)
            head[1:] = y[1:, 0] != y[:-1, 0]
            give = k < 2
            give[head] = np.append(~head[1:], False)[head]
            if held:
                give[0] &= lone  # it went out, or waits for a second row of its anchor
            out.append(y[give])
            late = y[k >= 2] if not held else y[1:][k[1:] >= 2]
            lo = late[:, 3] >> 16
            spans.append(np.stack([lo, late[:, 2], lo + (late[:, 3] >> 8 & 255) + length - 1], 1))
            lone = bool(head[-1]) and not (held and len(y) == 1 and not lone)
            last, nth = y[-1], int(min(k[-1], 2))
        s = np.concatenate(spans)
        if len(s):
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(s[:, 2])], names=NAMES)
        if out and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0][:, k]) for k in range(4)], names=NAMES)


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places in the order of their suffixes, compared up to depth symbols at least.

    text: symbols 1 to 255, and 0 at the ends of windows; ends differ from each other and come first.  Only windows that
    differ are sorted: the suffixes of a window and its copies stand side by side.  Also gives the length w that the
    sort compares first, less than depth, and for each place whether it shares fewer than w symbols with the one before,
    and whether exactly w - 1.
    """
    starts = np.append(0, ends[:-1] + 1)
    size = ends + 1 - starts
    windows = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)])
    kind = windows.dictionary_encode().indices.to_numpy()
    many = np.bincount(kind)
    if len(many) == len(ends):
        return _distinct_order(text, ends, depth)
    copies = np.argsort(kind, kind="stable")
    head = np.cumsum(many) - many  # of each different window, its first copy
    one = copies[head]
    upto = np.cumsum(size[one])
    own = np.repeat(starts[one] - upto + size[one], size[one]) + np.arange(upto[-1])
    order, parted, barely, w = _distinct_order(text[own], upto - 1, depth)
    k = np.repeat(np.arange(len(one)), size[one])[order]
    times = many[k]
    first = np.cumsum(times) - times
    nth = np.arange(len(text)) - np.repeat(first, times)
    left = np.repeat(upto[k] - 1 - order, times)
    copy = nth > 0  # shares what is left of its window with the place before
    parted, barely = np.repeat(parted, times), np.repeat(barely, times)
    parted[copy], barely[copy] = left[copy] < w, left[copy] == w - 1
    return ends[copies[np.repeat(head[k], times) + nth]] - left, parted, barely, w


def _distinct_order(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """suffix_order by doubling the compared length in each round, among the suffixes that are not yet told apart."""
    n, base, many = len(text), int(text.max()) + 1, len(ends) + 1
    w = min(7 if base**7 * many < 1 << 64 else 6, depth - 1)
    window = np.repeat(np.arange(len(ends)), np.diff(np.append(-1, ends)))
    left = ends[window] - np.arange(n)

    def follow(key: np.ndarray, at: int, part: np.ndarray, size: int) -> np.ndarray:
        """The key of at symbols, and behind it that of the next size ones; nothing follows an end."""
        key = key * np.uint64(base**size)
        key[: n - at] += np.where(left[: n - at] >= at, part[at:], np.uint64(0))
        return key

    one = text.astype(np.uint64)
    parts = {1: one, 2: (two := follow(one, 1, one, 1)), 4: follow(two, 2, two, 2)}
    most, at = np.zeros(n, np.uint64), 0  # the first w - 1 symbols
    for size in (4, 2, 1):
        if w - 1 & size:
            most, at = follow(most, at, parts[size], size), at + size
    key = follow(most, at, one, 1) * np.uint64(many) + np.where(left < w, window + 1, 0).astype(np.uint64)
    order = np.argsort(key)
    key, slots, rank = key[order], np.arange(n), np.empty(n, np.int64)
    parted, barely, most = np.ones(n, bool), np.zeros(n, bool), most[order]
    parted[1:] = key[1:] != key[:-1]
    barely[1:] = parted[1:] & (most[1:] == most[:-1]) & (left[order[1:]] >= w - 1)
    fresh, reach = parted, w
    while True:
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(slots)))
        rank[order[slots]] = np.repeat(slots[heads], size)
        slots = slots[np.repeat(size > 1, size)]
        if reach >= depth or not len(slots):
            return order, parted, barely, w
        at = order[slots]
        key = rank[at] * (n + 1) + rank[at + reach]  # equal so far, so no end lies before at + reach
        sort = np.argsort(key)
        order[slots], key = at[sort], key[sort]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        reach *= 2


def prefix_groups(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether it shares fewer than length symbols with the one before.

    Interval expansion: an interval of suffixes that begin with a string w becomes, by backward extension with each
    symbol c, that of c w.  The place behind it then has a common prefix of len(w), unless a shorter one is known; only
    in that case the interval is extended further.  Ends are told apart, so nothing that reaches one is shared.  The
    intervals of the length that the suffix order compares first are read off it, and the expansion begins with them.
    """
    n = len(text)
    order, parted, barely, begun = suffix_order(text, ends, length + 1)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # where the suffix that begins one symbol earlier stands
    step[by_symbol] = np.arange(n, dtype=np.int32)
    # the places of the same symbol before and after each place of the transform; an end extends to nothing
    before, after, none = np.empty(n, np.int32), np.empty(n, np.int32), len(ends)
    starts = np.cumsum(np.bincount(bwt, minlength=256))[:-1]
    starts = starts[starts < n]
    lower, upper = np.append(np.int32(-1), by_symbol[:-1]), np.append(by_symbol[1:], np.int32(n))
    lower[starts], upper[starts - 1] = -1, n
    lower[:none], upper[:none] = n, -1
    before[by_symbol], after[by_symbol] = lower, upper
    heads = np.flatnonzero(parted).astype(np.int32)
    open_ = barely[heads[1:]]
    low, high = heads[:-1][open_], heads[1:][open_]
    parted = np.append(parted, True)
    for _ in range(begun, length):
        if not len(low):
            break
        size = high - low
        upto = np.cumsum(size, dtype=np.int32)
        at = np.arange(upto[-1], dtype=np.int32) + np.repeat(low - upto + size, size)
        # a symbol's first and last place in an interval give its extension's bounds; extensions do not overlap
        first, last = before[at] < np.repeat(low, size), after[at] >= np.repeat(high, size)
        low, high = np.sort(step[at[first]]), np.sort(step[at[last]]) + np.int32(1)
        fresh = ~parted[high]
        low, high = low[fresh], high[fresh]
        parted[high] = True
    return order, parted[:n]


def _block_spans(doc: np.ndarray, packed: np.ndarray, raw: np.ndarray, bounds: np.ndarray, length: int):
    """Spans (doc_id, s, e) of a block's windows whose strings begin earlier in another of its windows."""
    codes = np.zeros(256, np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    codes[used] = np.arange(1, len(used) + 1)  # UTF-8 has fewer than 255 byte values
    ends = bounds[1:] + np.arange(len(doc))
    text = np.zeros(len(raw) + len(doc), np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes[raw]
    order, parted = prefix_groups(text, ends, length)
    shared = ~parted
    shared[:-1] |= shared[1:]  # places of intervals of two and more
    order, parted = order[shared], parted[shared]
    window = np.searchsorted(ends, order)
    place = order - (bounds[:-1] + np.arange(len(doc)))[window]
    valid = place < (packed >> 8 & 255)[window]
    group, window = (np.cumsum(parted) - 1)[valid], window[valid]
    if not len(group):
        return pa.RecordBatch.from_pydict({n: pa.array([], pa.int64()) for n in ("doc_id", "s", "e")})
    at = (packed >> 16)[window] + place[valid]
    ids, number = np.unique(doc, return_inverse=True)
    when = number[window] << 44 | at  # the order of strings; no text has 2^44 bytes
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    copy = when > np.repeat(np.minimum.reduceat(when, heads), np.diff(np.append(heads, len(group))))
    when = np.unique(when[copy])
    heads = np.flatnonzero(np.append(True, when[1:] > when[:-1] + 1)) if len(when) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(when))[: len(heads)] - 1
    at = when & ((1 << 44) - 1)
    return pa.RecordBatch.from_pydict({"doc_id": ids[when[heads] >> 44], "s": at[heads], "e": at[tails] + length})


def _blocks(batches, length: int):
    """Windows sorted by h: whole anchors together, about BLOCK_BYTES at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def spans(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        raw, bounds = list_parts(t.column("bytes"))
        return _block_spans(t.column("doc_id").to_numpy(), t.column("packed").to_numpy(), raw, bounds, length)

    for batch in batches:
        h = batch.column("h").to_numpy()
        if not len(h):
            continue
        ends = list_parts(batch.column("bytes"))[1]
        cuts = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        if held and held[-1].column("h")[held[-1].num_rows - 1].as_py() != h[0] and size >= BLOCK_BYTES:
            yield spans(held)
            held, size = [], 0
        at = 0
        for cut in cuts[:-1]:
            if size + ends[cut] - ends[at] >= BLOCK_BYTES:
                yield spans([*held, batch.slice(at, cut - at)])
                held, size, at = [], 0, int(cut)
        held.append(batch.slice(at))
        size += int(ends[-1] - ends[at])
    if held:
        yield spans(held)


def _string_batches(batches, length: int):
    """Of windows of wide anchors (h, doc_id, packed, bytes) each string for itself, by its hash and without its bytes."""
    half = 64 if length >= 64 else GRAM
    for batch in batches:
        for part in (batch.slice(k, CUT) for k in range(0, batch.num_rows, CUT)):
            data, upto = list_parts(part.column("bytes"))
            h, doc, packed = (part.column(n).to_numpy() for n in ("h", "doc_id", "packed"))
            many = packed >> 8 & 255
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, key, start = np.repeat(packed >> 16, many) + nth, np.repeat(h, many), np.repeat(upto[:-1], many) + nth
            with np.errstate(over="ignore"):
                spun = rolling(data, half)
                g = mix64(spun[start] * np.uint64(0x165667B19E3779F9) + spun[start + length - half])
                key = mix64(key.view(np.uint64) + mix64(g)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, g.view(np.int64), np.repeat(doc, many), at << 16 | 1 << 8)], names=NAMES)


def _marked_batches(batches, marks: np.ndarray):
    for batch in batches:
        here = marked(marks, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if here.any():
            yield batch.filter(pa.array(here))


#: Windows of one anchor that a block takes; the strings of wider anchors go each by its own hash.
WIDE = 4096


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs.

    Removes each byte that a string of `length` bytes covers which also begins earlier, by (doc_id, place), in the input
    as it is.  Null texts are empty; rows without an id keep everything; rows that repeat an id and its text are one
    document, and rows that repeat an id with another text are documents of their own.  length: from 96 to 255 less GRAM.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    keyed = with_document_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    rows = keyed.where("key is not null").select(F.col("key").alias("doc_id"), "text")  # from here on doc_id is the key
    schema = "h long, g long, doc_id long, packed long"
    repeats = lambda df: df.repartition("h").sortWithinPartitions(*NAMES).mapInArrow(lambda it: _repeats(it, length), schema)
    events = scratch.save(repeats(rows.mapInArrow(lambda it: _window_batches(it, length), schema)), "events")
    shared = events.where("h is not null")
    wide = scratch.save(shared.groupBy("h").agg(F.count("*").alias("c")).where(f"c > {WIDE}").select("h", F.lit(True).alias("wide")), "wide")
    tagged = shared.join(wide, "h", "left").select("h", "doc_id", "packed", F.coalesce("wide", F.lit(False)).alias("wide"))

    def cut(items: DataFrame) -> DataFrame:
        """The windows (h, doc_id, packed, wide) with their bytes, cut from their texts."""
        marks = spark.sparkContext.broadcast(id_marks(items.select("doc_id")))  # of a fixed size
        texts = rows.mapInArrow(lambda it: _marked_batches(it, marks.value), "doc_id long, text string")
        lo, size = F.shiftright("packed", 16), F.shiftright("packed", 8).bitwiseAND(255) + F.lit(length - 1)
        of = texts.select("doc_id", F.col("text").cast("binary").alias("raw")).join(items, "doc_id").where(lo + size <= F.length("raw"))  # else of another row with the same id
        return of.select("h", "doc_id", "packed", "wide", F.substr("raw", (lo + 1).cast("int"), size.cast("int")).alias("bytes"))

    pieces = scratch.save(cut(tagged), "windows")
    blocks, spans = pieces.where("not wide"), [events]
    if wide.limit(1).count():
        strings = pieces.where("wide").select("h", "doc_id", "packed", "bytes").mapInArrow(lambda it: _string_batches(it, length), schema)
        strings = scratch.save(repeats(strings), "strings")
        again = cut(strings.where("h is not null").select("h", "doc_id", "packed", F.lit(False).alias("wide")))
        blocks, spans = blocks.union(scratch.save(again, "cut")), [events, strings]
    blocks = blocks.select("h", "doc_id", "packed", "bytes").repartition("h").sortWithinPartitions("h", "doc_id", "packed")
    found = blocks.mapInArrow(lambda it: _blocks(it, length), "doc_id long, s long, e long")
    for df in spans:
        found = found.union(df.where("h is null").select("doc_id", F.col("g").alias("s"), F.col("packed").alias("e")))
    return without_spans(keyed, found)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
