"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine of at least c lie within squared distance T = 2 - 2 c.  A fixed rotation spreads their energy;
of the blocks of coordinates that it is cut into, at least one then holds at most its proportional part of T.  Each
block is range-joined: cells cut its first coordinate, a vector lives in one cell and visits those below that its ball
touches.  What a block proposes is confirmed by the exact cosine, and a pair counts in its first block only; whether a
block proposes a pair is one comparison, of the same stored numbers wherever it is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, group_bounds, list_parts, mix64, runs, table

COSINE, BLOCK_DIMS, SEED = 0.9, 8, 11
#: Vectors of a cell that live, and that visit, in one task; larger cells go out as pairs of parts.
PART = 32_768
#: Rounding of the rotated vectors, of 32 bits; the last word has the exact cosine.
EPS = 1e-6
#: Vectors of either side that are compared at once.
TILE_A, TILE_B = 1024, 4096


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    return [slice(i, min(i + BLOCK_DIMS, d)) for i in range(0, d, BLOCK_DIMS)]


def shares(d: int, cosine: float) -> list[float]:
    """The most squared distance that each block may hold to propose a pair."""
    return [(2 - 2 * cosine + EPS) * (p.stop - p.start) / d for p in blocks_of(d)]


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in one order, so that every task gets the same bits for a pair."""
    sq = (a.astype(np.float64) - b) ** 2
    total = sq[:, 0]
    for k in range(1, sq.shape[1]):
        total = total + sq[:, k]
    return total


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _by_length(column, kind) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector."""
    raw, ends = list_parts(column)
    values, ends = raw.view(kind), ends // np.dtype(kind).itemsize
    out = []
    for d in np.unique(np.diff(ends)):
        own = np.flatnonzero(np.diff(ends) == d)
        out.append((own, values[(ends[own][:, None] + np.arange(d)).ravel()].reshape(-1, d)))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, brought to a size of about 1 by powers of two, so that no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _turned_batches(batches, kind):
    """Adds y: the rotated unit vector."""
    for batch in batches:
        for own, x in _by_length(batch.column("vec"), kind):
            x = _scaled(x)
            y = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(own)).columns, _binary(y)], names=[*batch.schema.names, "y"])


def _visits(batches, cosine: float, slim: bool):
    """A row for each block and cell that a vector visits; home: it lives there.  slim: cell and home alone."""
    for batch in batches:
        for own, y in _by_length(batch.column("y"), np.float32):
            d, rows = y.shape[1], batch.take(pa.array(own))
            for k, (part, most) in enumerate(zip(blocks_of(d), shares(d, cosine), strict=True)):
                radius, lead = np.sqrt(most) + 1e-9, y[:, part.start].astype(np.float64)
                home, low = (np.floor((lead - r) / (2 * radius)).astype(np.int64) for r in (0, radius))
                for step in range(int((home - low).max()) + 1):
                    ok = np.flatnonzero(home - step >= low)
                    cell = mix64(((home[ok] - step).astype(np.uint64) * np.uint64(1 << 12) + np.uint64(k)) * np.uint64(1 << 20) + np.uint64(d)).view(np.int64)
                    cols = {"cell": pa.array(cell), "home": pa.array(np.full(len(ok), not step))}
                    if not slim:
                        at = pa.array(ok)
                        cols |= {"block": pa.array(np.full(len(ok), k, np.int32))} | {n: rows.column(n).take(at) for n in ("rep", "c", "vec", "y")}
                    yield pa.RecordBatch.from_pydict(cols)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node that connect what the edges (a, b) connect."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


class _Group:
    """The rows of one cell and part: proposes, confirms and counts pairs, and keeps edges that connect what they connect."""

    def __init__(self, rep, weight, x, y, block: int, cosine: float):
        d = y.shape[1]
        self.rep, self.weight, self.x, self.y, self.block, self.cosine = rep, weight, _scaled(x), y, block, cosine
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.parts, self.most = blocks_of(d), shares(d, cosine)
        z = y[:, self.parts[block]]
        half, one = (z * z).sum(axis=1, keepdims=True) / 2, np.ones((len(z), 1), np.float32)
        self.left, self.right = np.hstack([-z, half, one]), np.hstack([z, one, half])  # their product is half the squared distance
        self.gains, self.a, self.b = np.zeros(len(rep)), [], []

    def join(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Pairs of a and b; same: of a with itself."""
        limit = np.float32(self.most[self.block] / 2 + 1e-5)
        for i0 in range(0, len(a), TILE_A):
            own = a[i0 : i0 + TILE_A]
            for j0 in range(i0 if same else 0, len(b), TILE_B):
                other = b[j0 : j0 + TILE_B]
                near = self.left[own] @ self.right[other].T <= limit
                if near.mean() > 0.02:  # the whole product costs less than to gather so many
                    near &= self.y[own] @ self.y[other].T >= self.cosine - 1e-4
                i, j = np.divmod(np.flatnonzero(near.ravel()), len(other))
                if same:
                    ok = i0 + i < j0 + j
                    i, j = i[ok], j[ok]
                for at in range(0, len(i), 1 << 16):
                    self._confirm(own[i[at : at + (1 << 16)]], other[j[at : at + (1 << 16)]])

    def _confirm(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            ok = (self.y[i] * self.y[j]).sum(axis=1) >= self.cosine - 1e-4
            i, j = i[ok], j[ok]
        for m in range(self.block + 1) if len(i) else ():  # proposed here, and by no block before
            p = self.parts[m]
            ok = (block_distances(self.y[i, p], self.y[j, p]) <= self.most[m]) == (m == self.block)
            i, j = i[ok], j[ok]
        if len(i):
            ok = (self.x[i] * self.x[j]).sum(axis=1) / (self.norm[i] * self.norm[j]) >= self.cosine
            i, j = i[ok], j[ok]
        if len(i):
            self.gains += np.bincount(i, self.weight[j], len(self.rep)) + np.bincount(j, self.weight[i], len(self.rep))
            self.a.append(i)
            self.b.append(j)
            if sum(map(len, self.a)) > 1 << 18:
                self._thin()

    def _thin(self) -> None:
        if self.a:
            a, b = _spanning(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b = [a], [b]

    def batches(self):
        has = np.flatnonzero(self.gains)
        yield pa.RecordBatch.from_pydict({"rep": self.rep[has], "other": pa.nulls(len(has), pa.int64()), "links": self.gains[has].astype(np.int64)})
        self._thin()
        for p, q in zip(self.a, self.b, strict=True):
            yield pa.RecordBatch.from_pydict({"rep": self.rep[p], "other": pa.array(self.rep[q], pa.int64()), "links": np.zeros(len(p), np.int64)})


def _links(batches, cosine: float, kind):
    """Rows (rep, other, links): other: a spanning edge, or null; links: how many vectors rep gains as neighbours.

    role 0: compared among themselves and with those of role 2; 1: with those of role 2 only.
    """
    for t in runs(batches, ["cell", "part"]):
        bounds = group_bounds(t, ["cell", "part"])
        role, rep, weight, block = (t.column(n).to_numpy() for n in ("role", "rep", "c", "block"))
        (x, at), (y, by) = list_parts(t.column("vec")), list_parts(t.column("y"))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = np.flatnonzero(role[lo:hi] < 2), np.flatnonzero(role[lo:hi] == 2)
            if not len(a):
                continue
            own = _Group(rep[lo:hi], weight[lo:hi], x[at[lo] : at[hi]].view(kind).reshape(hi - lo, -1), y[by[lo] : by[hi]].view(np.float32).reshape(hi - lo, -1), int(block[lo]), cosine)
            if role[lo + a[0]] == 0:
                own.join(a, a, True)
            own.join(a, b, False)
            yield from own.batches()


def _pack_batches(batches, kind):
    """Valid vectors as bytes; null for all others."""
    for batch in batches:
        out = []
        for v in batch.column("v").to_pylist():
            x = np.array(v, kind) if v and None not in v else np.zeros(0)
            out.append((x + kind(0)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "vec": pa.array(out, pa.binary())})


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing, nor do those without an
    id; vectors of different lengths never link.  Equal vectors collapse into a class before the join.  Rows that repeat
    an id are vectors of their own in n_links, and one node in the components.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    single = "float" in vectors.schema[vector_col].dataType.simpleString()
    kind, element = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    rows = rows.mapInArrow(lambda it: _pack_batches(it, kind), "vec_id long, vec binary")
    rows = scratch.save(rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("vec", 256))), "rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"), F.first("vec").alias("vec"))
    classes = scratch.save(classes.mapInArrow(lambda it: _turned_batches(it, kind), "key string, rep long, c long, vec binary, y binary"), "classes")
    own = classes.select("rep", "c", "vec", "y")
    counted = classes.select("y").mapInArrow(lambda it: _visits(it, cosine, True), "cell long, home boolean")
    home = F.col("home").cast("long")
    sizes = scratch.save(counted.groupBy("cell").agg(F.sum(home).alias("h"), F.sum(1 - home).alias("v")).where("h > 0"), "sizes")
    visits = own.mapInArrow(lambda it: _visits(it, cosine, False), "cell long, home boolean, block int, rep long, c long, vec binary, y binary")
    dealt = visits.join(sizes, "cell").withColumn("to", F.explode(_parts()))
    dealt = dealt.select("cell", "to.part", "to.role", "block", "rep", "c", "vec", "y").repartition("cell", "part").sortWithinPartitions("cell", "part")
    found = scratch.save(dealt.mapInArrow(lambda it: _links(it, cosine, kind), "rep long, other long, links long"), "found")
    groups = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), scratch)
    gains = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = classes.select("key", "rep", "c").join(gains, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per = scratch.save(per.select("key", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")), "per")
    out = rows.select("vec_id", "key").join(per, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _parts():
    """Where a visit goes: its cell as a whole, or, if that is large, every pair of parts that its part is in."""
    nh, nv = F.ceil(F.col("h") / PART), F.ceil(F.col("v") / PART)
    mine_h, mine_v = F.pmod(F.xxhash64("rep"), nh), F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(nv, F.lit(1)))
    to = lambda p, r: F.struct(p.cast("int").alias("part"), r.cast("int").alias("role"))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), n), lambda k: k < n)
    homes = F.transform(upto(nh), lambda k: to(F.least(k, mine_h) * nh + F.greatest(k, mine_h), F.when(k == mine_h, 0).when(mine_h < k, 1).otherwise(2)))
    guests = F.transform(upto(nv), lambda k: to(nh * nh + mine_h * nv + k, F.lit(1)))
    there = F.transform(upto(nh), lambda k: to(nh * nh + k * nv + mine_v, F.lit(2)))
    alone = F.array(to(F.lit(0), F.when(F.col("home"), 0).otherwise(2)))
    return F.when((nh <= 1) & (nv <= 1), alone).otherwise(F.when(F.col("home"), F.concat(homes, guests)).otherwise(there))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
