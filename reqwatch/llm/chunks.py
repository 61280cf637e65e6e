"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the bytes of a text; a cut falls where the hash is the smallest within REACH places on
either side, so cuts depend on the nearby bytes only and find themselves again after an insertion, and no chunk is
shorter than REACH bytes but the first and the last.  Chunks go by a 128-bit digest; of equal chunks the first, by
doc_id and place, stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, table, text_slices, with_document_keys

GEAR = mix64(np.arange(101, 357, dtype=np.uint64)).astype(np.uint32)
#: Bytes that the rolling hash sees (as many as it has bits); places on either side among which a cut is the smallest, and
#: so the least size of a chunk: below it common phrases of unrelated texts count as copies; the largest size of a chunk.
WINDOW, REACH, LONGEST = 32, 56, 2048


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + GEAR[byte], over its last 32 bytes, by doubling the window."""
    h, w = GEAR[raw].copy(), 1
    while w < WINDOW:
        h[w:] += h[:-w].copy() << np.uint32(w)
        w *= 2
    return h


def cut_points(raw: np.ndarray, offsets: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """Chunk starts over all texts of the slice; every text begins one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(raw)
    # no candidate sees into the text before it
    age = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.where(age >= max(WINDOW - 1, reach), h, np.uint32(0xFFFFFFFF))
    low, w = h.copy(), 1
    padded = np.concatenate([np.full(reach, 0xFFFFFFFF, np.uint32), h, np.full(reach, 0xFFFFFFFF, np.uint32)])
    span, low = 2 * reach + 1, padded
    while 2 * w <= span:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[: n], low[span - w : span - w + n])
    least = np.flatnonzero((h == low) & (h != 0xFFFFFFFF))
    if len(least) > 1:  # of equal smallest hashes close together, the first
        first = np.ones(len(least), bool)
        first[1:] = (np.diff(least) > reach) | (h[least[1:]] != h[least[:-1]])
        least = least[first]
    starts = np.union1d(least + 1, offsets[:-1][np.diff(offsets) > 0])
    starts = starts[starts < n]
    size = np.diff(np.append(starts, n))
    if (size > longest).any():
        starts = np.concatenate([np.arange(s, s + k, longest) if k > longest else [s] for s, k in zip(starts, size, strict=True)]).astype(np.int64)
    return starts


def _chunk_batches(batches, shortest: int):
    for batch in batches:
        ids = batch.column(0)
        for at, rows, raw, offsets in text_slices(ids, batch.column(1)):
            starts = cut_points(raw, offsets)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(raw))
            owner = np.searchsorted(offsets, starts, "right") - 1
            keep = ends - starts >= shortest
            starts, ends, owner = starts[keep], ends[keep], owner[keep]
            data, digest = memoryview(raw), xxhash.xxh3_128_digest
            d = np.frombuffer(b"".join([digest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
            docs = ids.to_numpy(zero_copy_only=False)[at : at + rows][owner].astype(np.int64)
            place = starts - offsets[owner]
            # copies within the slice: the first by (doc_id, place) stands for all of them
            order = np.lexsort((place, docs, d[:, 1], d[:, 0]))
            same = np.zeros(len(order), bool)
            here = np.column_stack([docs, place])[order]
            same[1:] = (d[order[1:]] == d[order[:-1]]).all(axis=1) & (here[1:] != here[:-1]).any(axis=1)
            again = np.zeros(len(order), bool)
            again[order] = same
            yield pa.RecordBatch.from_pydict({"d1": d[:, 0], "d2": d[:, 1], "doc_id": docs, "place": place, "size": (ends - starts).astype(np.int32), "again": again})


def _kept_batches(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans = batch.column("spans").to_pylist()
        rows = []
        for t, cut in zip(texts, spans, strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            if not cut:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in cut):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            kept, at = [], 0
            for s, e in merged:
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            rows.append((len(data), sum(e - s for s, e in merged), len(merged), hashlib.sha256(b"".join(kept)).hexdigest()))
        n, removed, count, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): rows (key, doc_id, text) less the byte spans (doc_id, s, e).

    The spans' doc_id is a key of rows (common.with_document_keys); they may overlap.
    """
    own = spans.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return rows.join(own, "key", "left").select("doc_id", "text", "spans").mapInArrow(_kept_batches, KEPT_SCHEMA)


def chunk_dedup(docs: DataFrame, shortest: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs.

    Chunks of fewer than `shortest` bytes always stay.  Null texts are empty; rows without an id keep everything.
    Rows that repeat an id and its text count as one document, and a chunk at the same place of it is not a copy of
    itself; rows that repeat an id with another text are documents of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "chunks")
    rows = with_document_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), scratch)
    known = rows.where("key is not null").select(F.col("key").alias("doc_id"), "text")
    found = known.mapInArrow(lambda it: _chunk_batches(it, shortest), "d1 long, d2 long, doc_id long, place long, size int, again boolean")
    # copies that a task has already seen never travel to the first ones' side
    found = scratch.save(found, "chunks")
    firsts = found.where("not again").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("c"))
    twice = scratch.save(firsts.where("c > 1").select("d1", "d2", "first"), "twice")
    own = found.where("not again").join(twice, ["d1", "d2"]).where(F.struct("doc_id", "place") != F.col("first"))
    cuts = found.where("again").select("doc_id", "place", "size").union(own.select("doc_id", "place", "size"))
    spans = cuts.select("doc_id", F.col("place").alias("s"), (F.col("place") + F.col("size")).alias("e"))
    return without_spans(rows, spans)


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents"))
