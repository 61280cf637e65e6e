"""What several training-data operators share: scratch tables, byte-level text views, hashing and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, scratch_dir

WORD_BREAKS = " \t\n\x0b\f\r"
#: Bytes of text that one numpy pass holds; a longer text is still taken whole.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediate tables: they cut the lineage and outlive lost executors.

    They lie in the folder that all executors share.  Those that no reader needs any longer are dropped as a job goes on;
    those that its result reads from go when the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, scratch_dir(spark, tag)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables whose last reader has run; without names, all of them."""
        for place in [f"{self.root}/{name}" for name in names] or [self.root]:
            delete(self.spark, place)


def with_document_keys(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (doc_id, text) with key, by which documents are told apart: in the order of doc_id, null where that is null.

    Where no id has several texts the id is the key.  Else rows of one id and text share a key, and the texts of one id
    are documents of their own, in the order of their hashes: the different (id, hash) pairs are sorted and numbered.
    """
    pairs = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"))
    if pairs.groupBy("doc_id").agg((F.min("tag") != F.max("tag")).alias("many")).where("many").isEmpty():
        return rows.withColumn("key", F.col("doc_id"))
    order = pairs.distinct().repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    numbered = scratch.save(order.withColumn("key", F.monotonically_increasing_id()), "keys")
    return rows.withColumn("tag", F.xxhash64("text")).join(numbered, ["doc_id", "tag"], "left").drop("tag")


def fresh_name(columns: list[str], name: str) -> str:
    """name, or one like it that no column has (Spark compares them without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Adds a key that no two rows share.  It is fixed only once written.  Its low bits are spread over partitions, see id_marks."""
    n = F.monotonically_increasing_id()
    return df.withColumn(name, n.bitwiseXOR(F.xxhash64(F.shiftright(n, 33)).bitwiseAND(F.lit(MARKS - 1))))


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, rows, bytes as uint8, offsets) for runs of whole rows of about limit bytes; a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to - at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def words_of(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of each row: 64-bit hashes (A-Z lower-cased), starts, ends, and the number of words of each row.

    breaks: whether each byte value parts words.
    """
    global _POWERS
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~breaks[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, counts
    longest = int((ends - starts).max())
    if longest > len(_POWERS):
        _POWERS = _powers(longest)
    place = np.zeros(n, np.int64)
    place[starts[0] :] = np.arange(n - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, n)))
    value = _BYTE[_LOWER[raw]]
    value[~inside] = 0
    value *= _POWERS[np.minimum(place, len(_POWERS) - 1)]
    sums = np.add.reduceat(value, starts)
    return mix64(sums + (ends - starts).astype(np.uint64)), starts, ends, counts


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row (A-Z lower-cased), and the number of words of each row."""
    hashes, _, _, counts = words_of(raw, offsets)
    return hashes, counts


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component): for each node of the undirected edges (a, b), the smallest node that links reach.

    Alternating large-star and small-star steps; each is an aggregation and a join on written tables, so no node's
    neighbours are gathered.  Ends when a round changes nothing.
    """
    flat = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen, k = scratch.save(flat(edges), f"{tag}0"), None, 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{tag}m{k}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(flat(large), f"{tag}l{k}")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{tag}s{k}")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = scratch.save(flat(small), f"{tag}{k + 1}")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}{k}", f"{tag}m{k}", f"{tag}l{k}", f"{tag}s{k}")
        now, k = after, k + 1
        if sign == seen:
            break
        seen = sign
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


MARKS = 1 << 25


def id_marks(ids: DataFrame) -> np.ndarray:
    """A fixed 4 MB bitmap of id mod 2^25: a filter with false hits only, whose size does not grow with the data."""
    slot = F.pmod(F.col(ids.columns[0]), F.lit(MARKS)).cast("long")
    parts = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros(MARKS + (1 << 16), bool)
    for b, m in parts.collect():
        at = (b - 1) * 32768 + 1 if b > 0 else 0
        bits = np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").astype(bool)
        out[at : at + len(bits)] |= bits
    return np.packbits(out)


def marked(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the bitmap."""
    slot = ids % MARKS
    return (marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def runs(batches, keys: list[str]):
    """Joins Arrow batches of a partition sorted by keys so that each yielded table holds whole groups."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = _last_group(batch, keys)
        if cut == 0 and held and _same(held[-1], batch, keys):
            held.append(batch)
            continue
        if held and not _same(held[-1], batch, keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in keys)


def _last_group(batch: pa.RecordBatch, keys: list[str]) -> int:
    """Where the batch's last group begins."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    return int(at[-1]) if len(at) else 0


def group_bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups of a sorted table, and its length."""
    change = np.ones(t.num_rows, bool)
    if t.num_rows:
        change[1:] = False
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), t.num_rows)


def list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list or binary column."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
        c = c.cast(pa.large_binary())
        ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None and c.buffers()[2].size else np.zeros(0, np.uint8)
        return data[ends[0] : ends[-1]], ends - ends[0]
    ends = c.offsets.to_numpy()
    return c.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
