"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles (as 64-bit hashes).  Each set gets a SetSketch: M registers that hold
exponentially spaced, truncated minima, so that sketches merge by maximum and agree in a register about as often as the
sets are similar.  Bands of registers propose pairs, the joint likelihood of two sketches prunes them, and the full sets
confirm them.  Copies (equal sets) collapse into classes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, group_bounds, id_marks, list_parts, marked, mix64, runs, table, text_slices, word_hashes

M, BASE, RATE, TOP = 256, 1.001, 20.0, 65_534
ROWS, BANDS = 5, 48
#: A pair at the threshold falls more than this below it in its estimate with a chance of about 1e-6.
SLACK = 0.13
_ROW = np.random.default_rng(20240601).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the rows' set sizes.  Fewer words than width: one shingle."""
    words, counts = word_hashes(raw, offsets)
    n = len(words)
    if not n:
        return words, counts
    ends = np.cumsum(counts)
    begin, sizes = ends - counts, np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    row = np.repeat(np.arange(len(counts)), counts)
    last = ends[row]
    sums = np.zeros(n, np.uint64)
    at = np.arange(n)
    for k in range(width):
        term = padded[k : k + n] * (_ROW[k % 8] + np.uint64(2 * (k // 8)))
        sums += np.where(at + k < last, term, np.uint64(0))
    sums += np.minimum(counts, width).astype(np.uint64)[row]
    own = np.arange(n) - begin[row] < sizes[row]
    values, row = mix64(sums[own]), row[own]
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.bincount(row[fresh], minlength=len(counts))


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of M uint16 registers for each set.

    An element's points come in ascending order and go to registers in an order of its own; once they pass the largest
    register minimum of its set, the rest cannot count.
    """
    d = len(sizes)
    least = np.full(d * M, np.inf)
    row = np.repeat(np.arange(d), sizes)
    state, reach = values.copy(), np.zeros(len(values))
    place, step = (values & np.uint64(M - 1)).astype(np.int64), ((values >> np.uint64(8)) & np.uint64(M - 1)).astype(np.int64) | 1
    for j in range(M):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        unit = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        reach = reach - np.log(unit) / (RATE * (M - j))
        np.minimum.at(least, row * M + place, reach)
        bound = least.reshape(d, M).max(axis=1)
        live = np.flatnonzero(reach < bound[row])
        if not len(live):
            break
        row, state, reach, step, place = row[live], state[live], reach[live], step[live], (place[live] + step[live]) & (M - 1)
    with np.errstate(divide="ignore"):
        spaced = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(spaced, 0, TOP).astype(np.uint16).reshape(d, M)


_GRID = np.linspace(0.0, 1.0, 101)


def likeliest_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For rows of registers a and b of sets with sizes na and nb: the similarity of greatest joint likelihood."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return _likeliest(more, less, na, nb)


def _likeliest(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    u = (na / (na + nb))[:, None]
    grid = np.minimum(_GRID[None, :], np.minimum(u, 1 - u) / np.maximum(u, 1 - u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    tiny = 1e-12
    score = more[:, None] * np.log(above + tiny) + less[:, None] * np.log(below + tiny) + (M - more - less)[:, None] * np.log(np.maximum(1 - above - below, 0) + tiny)
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], 1)[:, 0]


def _sketch_batches(batches, width: int):
    for batch in batches:
        ids = batch.column(0)
        for at, rows, raw, offsets in text_slices(ids, batch.column(1)):
            values, sizes = shingle_sets(raw, offsets, width)
            own = ids.slice(at, rows)
            out = {"doc_id": own, "n_shingles": pa.array(sizes, pa.int64())}
            have = np.flatnonzero((sizes > 0) & ~np.asarray(own.is_null()))
            mask = np.ones(rows, bool)
            mask[have] = False
            d1, d2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            if len(values):
                heads = (np.cumsum(sizes) - sizes)[sizes > 0]
                d1[sizes > 0] = np.add.reduceat(values, heads)
                d2[sizes > 0] = np.bitwise_xor.reduceat(mix64(values + np.uint64(0x2545F4914F6CDD1D)), heads)
            keep = np.repeat(~mask, sizes)
            regs = sketches(values[keep], sizes[have]) if len(have) else np.zeros((0, M), np.uint16)
            cells = np.full(rows, None, object)
            cells[have] = [r.tobytes() for r in regs]
            out |= {"d1": pa.array(d1.view(np.int64), mask=mask), "d2": pa.array(d2.view(np.int64), mask=mask), "sketch": pa.array(cells, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)


def sketch_table(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch); the digest pair and the sketch are null for empty sets and null ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _sketch_batches(it, width), "doc_id long, n_shingles long, d1 long, d2 long, sketch binary")


def _joined(labels: np.ndarray, i: int, others: np.ndarray) -> None:
    """Gives i's label and all labels of others one label."""
    old = np.unique(np.append(labels[others], labels[i]))
    labels[np.isin(labels, old)] = old[0]


#: Members of a bucket or cluster that meet in one task; larger ones go out as pairs of blocks, losslessly.
BLOCK = 512
_SMALL = 24


def _bucket_edges(batches, least: float):
    """Buckets of rows sorted by key: (a, b) edges that connect whatever estimates of at least `least` connect."""
    for t in runs(batches, ["key", "part"]):
        bounds = group_bounds(t, ["key", "part"])
        rep, size = t.column("rep").to_numpy(), t.column("n").to_numpy()
        regs = list_parts(t.column("sketch"))[0].view(np.uint16).reshape(-1, M)
        length = np.diff(bounds)
        a, b = [], []
        until = np.repeat(bounds[1:], length)
        small = np.repeat(length <= _SMALL, length)
        for d in range(1, min(_SMALL, int(length.max()))):
            i = np.flatnonzero(small & (np.arange(len(rep)) + d < until))
            for part in np.array_split(i, len(i) // 20_000 + 1):
                if len(part):
                    ok = likeliest_jaccard(regs[part], regs[part + d], size[part], size[part + d]) >= least
                    a.append(rep[part[ok]])
                    b.append(rep[part[ok] + d])
        for lo, hi in zip(bounds[:-1][length > _SMALL], bounds[1:][length > _SMALL], strict=True):
            labels = np.arange(hi - lo)
            for i in range(hi - lo - 1):
                j = i + 1 + np.flatnonzero(labels[i + 1 :] != labels[i])
                if len(j):
                    more, less = (regs[lo + i] > regs[lo + j]).sum(axis=1), (regs[lo + i] < regs[lo + j]).sum(axis=1)
                    j = j[more + less <= M * (1 - least / 2)]  # far from any estimate that counts
                if len(j):
                    na = np.full(len(j), size[lo + i])
                    j = j[likeliest_jaccard(np.broadcast_to(regs[lo + i], (len(j), M)), regs[lo + j], na, size[lo + j]) >= least]
                    if len(j):
                        _joined(labels, i, j)
            own = np.flatnonzero(labels != np.arange(hi - lo))
            a.append(rep[lo + own])
            b.append(rep[lo + labels[own]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})


def _set_batches(batches, width: int, marks: np.ndarray):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(marked(marks, ids))
        if not len(here):
            continue
        batch = batch.take(pa.array(here))
        for at, rows, raw, offsets in text_slices(batch.column(0), batch.column(1)):
            values, sizes = shingle_sets(raw, offsets, width)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, rows), "elements": pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))})


def _cluster_links(batches, percent: int):
    """Clusters of rows sorted by cluster: (a, b) links, confirmed on the full sets, that connect whatever links connect."""
    for t in runs(batches, ["cluster", "part"]):
        bounds = group_bounds(t, ["cluster", "part"])
        rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        values, ends = list_parts(t.column("elements"))
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            sizes = np.diff(ends[lo : hi + 1])
            _, code = np.unique(values[ends[lo] : ends[hi]], return_inverse=True)
            at = ends[lo : hi + 1] - ends[lo]
            labels, seen = np.arange(hi - lo), np.zeros(int(code.max()) + 1, np.int32)
            for i in range(hi - lo - 1):
                j = i + 1 + np.flatnonzero((labels[i + 1 :] != labels[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])))
                if side[lo] >= 0:  # two blocks of a large cluster: within a block only where both are the same
                    j = j[side[lo + j] != side[lo + i]]
                if not len(j):
                    continue
                seen[code[at[i] : at[i + 1]]] = 1
                if len(j) * 3 > hi - lo:
                    both = np.add.reduceat(seen[code[at[i + 1] :]], at[i + 1 : -1] - at[i + 1])[j - i - 1]
                else:
                    both = np.array([seen[code[at[k] : at[k + 1]]].sum() for k in j])
                seen[code[at[i] : at[i + 1]]] = 0
                ok = 100 * both >= percent * (sizes[i] + sizes[j] - both)
                if ok.any():
                    _joined(labels, i, j[ok])
            own = np.flatnonzero(labels != np.arange(hi - lo))
            a.append(rep[lo + own])
            b.append(rep[lo + labels[own]])
        if a and sum(map(len, a)):
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _in_blocks(df: DataFrame, key: str, count: str, item: str) -> DataFrame:
    """Adds part and side: groups of up to BLOCK rows stay whole (part 0, side -1); the others meet as pairs of blocks."""
    blocks = F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64(item), blocks).cast("int")
    other = F.explode(F.when(F.col(count) <= BLOCK, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    out = df.withColumn("_blocks", blocks).withColumn("_mine", mine).withColumn("_other", other)
    lo, hi = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    part = F.when(F.col("_other") < 0, 0).otherwise(lo * F.col("_blocks") + hi + 1).cast("int")
    side = F.when((F.col("_other") < 0) | (F.col("_other") == F.col("_mine")), -1).when(F.col("_mine") == lo, 0).otherwise(1).cast("int")
    return out.withColumn("part", part).withColumn("side", side).drop("_blocks", "_mine", "_other")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Null or empty texts have empty sets and link with nothing.  A null id takes no part: its component is null and it is
    kept.  Rows that repeat an id have each the component of their own text; with one text they are one node.  Other
    columns of docs are not read.  scratch: where the tables go that the result still reads.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    least = percent / 100 - SLACK
    sk = scratch.save(sketch_table(docs, width, id_col, text_col), "sketch")
    classes = sk.where("d1 is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = scratch.save(classes, "classes")
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "sketch")
    wide = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("sketch", k * wide + 1, F.lit(wide)), k))
    bands = classes.select("rep", F.explode(keys).alias("key"))
    shared = scratch.save(bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = scratch.save(bands.join(shared, "key"), "members")
    rows = members.join(reps, "rep")
    rows = _in_blocks(rows, "key", "c", "rep").select("key", "part", "rep", "n", "sketch").repartition("key", "part").sortWithinPartitions("key", "part", "rep")
    edges = scratch.save(rows.mapInArrow(lambda it: _bucket_edges(it, least), "a long, b long"), "edges")
    scratch.drop("shared", "members")
    near = scratch.save(components(edges, scratch, "est"), "near")
    scratch.drop("edges")
    sizes = near.groupBy("component").agg(F.count("*").alias("c"))
    near = scratch.save(near.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "c"), "clusters")
    marks = spark.sparkContext.broadcast(id_marks(near.select("rep")))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = texts.mapInArrow(lambda it: _set_batches(it, width, marks.value), "doc_id long, elements array<long>")
    rows = _in_blocks(near.join(sets, near.rep == sets.doc_id).drop("doc_id"), "cluster", "c", "rep")
    rows = rows.select("cluster", "part", "side", "rep", "elements").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "rep")
    links = scratch.save(rows.mapInArrow(lambda it: _cluster_links(it, percent), "a long, b long"), "links")
    scratch.drop("near", "clusters")
    found = scratch.save(components(links, scratch, "link"), "found")
    ids = classes.select("d1", "d2", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    ids = scratch.save(ids.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component")), "ids")
    scratch.drop("links", "found", "classes")
    out = sk.select("doc_id", "n_shingles", "d1", "d2").join(ids, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
