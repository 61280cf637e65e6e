"""Ranked lexical search: WAND over document shards, whose heaps are merged.

The documents are read once into a forward index of the queries' terms, a row a document, next to partial counts for the
collection's statistics.  A task takes its rows of that index shard by shard: it turns a shard into postings sorted by
term and document, with the impact of each (what it adds to a score) and the largest impact of each term.  All queries
then go through the shard side by side, each with a cursor for every term: ordered by the cursors' documents, the largest
impacts are added up until they can reach the heap's least score; the document there is the pivot, and cursors before it
skip to it.  Only when all stand on the pivot is it scored.  Heaps live on from shard to shard of a task, and the tasks'
heaps are merged by two windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, list_parts, table, text_slices, words_of

TOP = 50
#: Query terms that one pass over the documents serves; more queries are taken in blocks of so many terms.
BLOCK_TERMS = 1 << 18
#: Postings that a shard holds, and cursors that are moved at once.
SHARD_POSTINGS, CURSORS = 1 << 20, 1 << 15
#: Groups that the tasks' heaps are first merged in, for each query.
SALTS = 64
NO_ID = np.iinfo(np.int64).max

#: Bytes of terms: digits, letters and all beyond ASCII.
_BREAK = np.ones(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _BREAK[_low : _high + 1] = False

INDEX_SCHEMA = "stat boolean, doc_id long, n long, terms array<int>, counts array<long>"


def _index_batch(stat: bool, ids: pa.Array, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(bounds, pa.int32())
    return pa.RecordBatch.from_pydict({
        "stat": pa.array(np.full(len(n), stat)), "doc_id": ids, "n": pa.array(n, pa.int64()), "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
    })


def _index_batches(batches, known: np.ndarray):
    """Rows of the forward index; of documents without one of the known terms only the task's counts speak.

    A task's last two rows are its counts: documents with terms and their terms, and documents by known term.
    """
    docs, total, df = 0, 0, np.zeros(len(known), np.int64)
    for batch in batches:
        for at, rows, raw, offsets in text_slices(batch.column("doc_id"), batch.column("text")):
            hashes, _, _, n = words_of(raw, offsets, _BREAK)
            docs, total = docs + int(np.count_nonzero(n)), total + len(hashes)
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            row = np.repeat(np.arange(rows), n)[hit]
            keys, counts = np.unique(row * len(known) + place[hit], return_counts=True)
            row, term = keys // len(known), keys % len(known)
            df += np.bincount(term, minlength=len(known))
            own, per = np.unique(row, return_counts=True)
            if len(own):
                yield _index_batch(False, batch.column("doc_id").slice(at, rows).take(pa.array(own)), n[own], np.append(0, np.cumsum(per)), term, counts)
    seen = np.flatnonzero(df)
    yield _index_batch(True, pa.nulls(1, pa.int64()), np.array([docs]), np.array([0, len(seen)]), seen, df[seen])
    yield _index_batch(True, pa.array([0]), np.array([total]), np.array([0, 0]), seen[:0], df[:0])


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct terms, as hashes, of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)
    hashes, _, _, n = words_of(np.frombuffer(b"".join(data), np.uint8), offsets, _BREAK)
    return [np.unique(h) for h in np.split(hashes, np.cumsum(n)[:-1])] if data else []


@dataclass
class Shard:
    """Postings of some documents in order of (term, document), each term's ended by a document that is none."""

    ids: np.ndarray  # of the documents, ascending
    keys: np.ndarray  # term * (documents + 1) + document
    doc: np.ndarray
    impact: np.ndarray
    first: np.ndarray  # of each term of the vocabulary
    most: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, n: np.ndarray, per: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, docs: int, total: int) -> Shard:
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        m = 50 + (50 * n * docs) // max(total, 1)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * np.repeat(m, per)))
        wide, vocabulary = len(ids) + 1, len(weights)
        keys = terms.astype(np.int64) * wide + np.repeat(rank, per)
        ends = np.arange(vocabulary, dtype=np.int64) * wide + len(ids)
        keys, impact = np.concatenate([keys, ends]), np.concatenate([impact, np.zeros(vocabulary, np.int64)])
        by = np.argsort(keys)
        keys, impact = keys[by], impact[by]
        first = np.searchsorted(keys, np.arange(vocabulary, dtype=np.int64) * wide)
        return cls(ids[order], keys, keys % wide, impact, first, np.maximum.reduceat(impact, first))


class Heaps:
    """The best documents of each query so far, those of equal scores by ascending id."""

    def __init__(self, queries: int, top: int):
        self.scores, self.ids = np.zeros((queries, top), np.int64), np.full((queries, top), NO_ID, np.int64)

    def least(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the worst document held of each of the queries q: 0 as long as there is room."""
        scores = self.scores[q]
        low = scores.min(axis=1)
        return low, np.where(scores == low[:, None], self.ids[q], -1 - NO_ID).max(axis=1)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Puts in one document for each of the queries q, where it beats the worst one; says where."""
        low, worst = self.least(q)
        better = (scores > low) | ((scores == low) & (scores > 0) & (ids < worst))
        q, low, worst = q[better], low[better], worst[better]
        at = ((self.scores[q] == low[:, None]) & (self.ids[q] == worst[:, None])).argmax(axis=1)
        self.scores[q, at], self.ids[q, at] = scores[better], ids[better]
        return better


def wand(shard: Shard, queries: list[np.ndarray], heaps: Heaps) -> int:
    """Takes the shard's documents that reach a query's heap into it; says how many were scored.

    queries: the terms of each.  Queries of about as many terms go together, each a row of cursors.
    """
    by_size = sorted((q for q in range(len(queries)) if len(queries[q])), key=lambda q: len(queries[q]))
    scored, at = 0, 0
    while at < len(by_size):
        to = at + 1
        while to < len(by_size) and (to + 1 - at) * len(queries[by_size[to]]) <= CURSORS:
            to += 1
        scored += _wand(shard, queries, np.array(by_size[at:to]), heaps)
        at = to
    return scored


def _wand(shard: Shard, queries: list[np.ndarray], q: np.ndarray, heaps: Heaps) -> int:
    width, none = len(queries[q[-1]]), len(shard.ids)
    present = [t[shard.doc[shard.first[t]] < none] for t in (queries[k] for k in q)]  # terms without postings here never count
    width = max(map(len, present), default=0)
    slot = np.full((len(q), width), -1)
    for row, t in zip(slot, present, strict=True):
        row[: len(t)] = t
    pos, most = np.where(slot < 0, len(shard.doc) - 1, shard.first[slot]), np.where(slot < 0, 0, shard.most[slot])  # the last posting is an end
    ids, scored = np.append(shard.ids, NO_ID), 0
    low, worst = heaps.least(q)
    while len(q) and width:
        doc = shard.doc[pos]
        order = doc.argsort(axis=1)
        sums = np.take_along_axis(most, order, 1).cumsum(axis=1)
        ahead = doc.min(axis=1)
        # a sum that equals the worst score is only enough while smaller ids than the worst one's may come
        need = np.maximum(low + (ids[ahead] >= worst), 1)
        reach = sums >= need[:, None]
        pivot = np.take_along_axis(doc, np.take_along_axis(order, reach.argmax(axis=1)[:, None], 1), 1)[:, 0]
        live = reach[:, -1] & (pivot < none)
        if not live.all():
            q, slot, pos, most, doc, pivot, ahead, low, worst = (x[live] for x in (q, slot, pos, most, doc, pivot, ahead, low, worst))
            if not len(q):
                break
        ready = ahead == pivot
        on = (doc == pivot[:, None]) & ready[:, None]
        rows = np.flatnonzero(ready)
        if len(rows):
            scores = (shard.impact[pos[rows]] * on[rows]).sum(axis=1)
            put = rows[heaps.offer(q[rows], scores, ids[pivot[rows]])]
            low[put], worst[put] = heaps.least(q[put])
            scored += len(rows)
            pos += on
        behind = np.nonzero(doc < pivot[:, None])  # none in rows that are ready
        if len(behind[0]):
            pos[behind] = np.searchsorted(shard.keys, slot[behind] * (none + 1) + pivot[behind[0]])
    return scored


def _shards(batches, weights: np.ndarray, docs: int, total: int, limit: int) -> Iterator[Shard]:
    held, size = [], 0

    def built() -> Shard:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms, bounds = list_parts(whole.column("terms"))
        counts, _ = list_parts(whole.column("counts"))
        ids = whole.column("doc_id").fill_null(NO_ID).to_numpy()
        return Shard.build(ids, whole.column("n").to_numpy(), np.diff(bounds), terms, counts, weights, docs, total)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ends = batch.column("terms").offsets.to_numpy()
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit - size, "right")) - 1)
            held.append(batch.slice(at, to - at))
            size, at = size + int(ends[to] - ends[at]), to
            if size >= limit or at < batch.num_rows:
                yield built()
                held, size = [], 0
    if held:
        yield built()


def _search_batches(batches, queries: list[np.ndarray], weights: np.ndarray, docs: int, total: int, top: int, limit: int):
    heaps = Heaps(len(queries), top)
    for shard in _shards(batches, weights, docs, total, limit):
        wand(shard, queries, heaps)
    q, k = np.nonzero(heaps.scores)
    ids = heaps.ids[q, k]
    yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "score": pa.array(heaps.scores[q, k])})


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, terms) of runs of queries with about limit terms; one run at a time is on the driver."""
    ids, terms, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        terms += terms_of([row.text])
        size += len(terms[-1])
        if size >= limit:
            yield ids, terms
            ids, terms, size = [], [], 0
    if ids:
        yield ids, terms


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the `top` documents of docs with the highest scores above 0.

    Equal scores go by ascending doc_id, null ids last.  Each row of docs is a document and each row of items a query of
    its own, so rows that repeat an item's id are ranked each by itself.  Null and empty texts have no terms: they find
    nothing and are not found.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch, context = Scratch(spark, "lexical"), spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number, (ids, terms) in enumerate(_blocks(items, block_terms)):
        known = np.unique(np.concatenate(terms))
        shared = context.broadcast(known)  # at most block_terms hashes and those of one query
        index = scratch.save(rows.mapInArrow(lambda it, s=shared: _index_batches(it, s.value), INDEX_SCHEMA), f"index{number}")
        stats = index.where("stat")
        sums = stats.groupBy(F.col("doc_id").isNull().alias("docs")).agg(F.sum("n").alias("n")).collect()
        n, total = (next((r.n for r in sums if r.docs == k), 0) for k in (True, False))
        pairs = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).collect()
        df = np.zeros(len(known), np.int64)
        for r in pairs:
            df[r.terms] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        own = context.broadcast(([np.searchsorted(known, t) for t in terms], weights, n, total))
        heaps = index.where("not stat").select("doc_id", "n", "terms", "counts").mapInArrow(lambda it, o=own: _search_batches(it, *o.value, top, shard_postings), "q long, doc_id long, score long")
        heaps = heaps.withColumn("salt", F.spark_partition_id() % SALTS)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["q", "salt"], ["q"]):
            window = F.row_number().over(_window(keys, order))
            heaps = heaps.withColumn("rank", window).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), "q long, item_id long")
        ranked = heaps.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # one block of queries
        found = found.union(scratch.save(ranked, f"ranked{number}"))
        scratch.drop(f"index{number}")
    return found


def _window(keys: list[str], order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _TERM + "')"
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS u FROM documents), q AS (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS u FROM benchmark),
 s AS (SELECT count(*)::BIGINT AS big_n, sum(len(u))::BIGINT AS big_l FROM d WHERE len(u) > 0), t AS (SELECT DISTINCT item, item_id, unnest(u) AS term FROM q),
 p AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(u)::BIGINT AS n, unnest(u) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, big_n),
 i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS impact FROM p JOIN w USING (term), s),
 r AS (SELECT item, item_id, row, doc_id, sum(impact)::BIGINT AS score FROM t JOIN i USING (term) GROUP BY ALL),
 k AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
 SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""
