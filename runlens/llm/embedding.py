"""Near-duplicate embeddings by lattice hashing.

Random projections take a unit vector to groups of eight coordinates, each
decoded to the nearest point of the lattice E8; the points of a table's groups
together are a cell.  A vector lies in one cell a table and also probes cells
in which one or two of its points are replaced by a neighbour.  Two vectors
meet where one lies and the other lies or probes, and every meeting is
verified by the cosine in double precision.

Equal vectors are one node with a count.  A cell with more than ``block``
nodes is dealt as pairs of blocks.  A pair that meets in several cells counts
in the first of them only, so links are counted in the tasks and never
emitted: a group gives one row a node, with its links and the least node of
its local component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lean, read, runs, stars
from .components import components

COSINE = 0.95
TABLES, GROUPS, SCALE = 14, 2, 5.0
BLOCK = 256


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row (n x 8), in half units as integers."""
    def d8(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        e = y - r
        worst = np.abs(e).argmax(1)[odd]
        r[odd, worst] += np.where(e[odd, worst] >= 0, 1, -1)
        return r
    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def neighbours(x: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two neighbours of ``point`` (half units) that lie nearest to ``x``:
    the best by an integer root and the best by a half-integer root, the
    nearer of them first."""
    e = x - point / 2
    size, sign = np.abs(e), np.where(e >= 0, 1, -1)
    rows = np.arange(len(x))
    top = np.argsort(-size, axis=1, kind="stable")[:, :2]
    whole = np.zeros_like(point)
    for k in range(2):
        whole[rows, top[:, k]] = 2 * sign[rows, top[:, k]]
    half = sign.copy()
    odd = np.flatnonzero((half < 0).sum(1) % 2)
    half[odd, size.argmin(1)[odd]] *= -1
    gain = lambda r: (e * r / 2).sum(1)
    first = (gain(whole) >= gain(half))[:, None]
    return point + np.where(first, whole, half), point + np.where(first, half, whole)


@lru_cache(maxsize=8)
def _projection(dims: int, tables: int, groups: int, seed: int = 0) -> np.ndarray:
    """tables x dims x (8 groups) random directions of unit length, orthogonal
    within a table as far as the dimensions go."""
    rng = np.random.default_rng([seed, dims])
    out = []
    for _ in range(tables):
        wide = np.concatenate([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-8 * groups // dims))], axis=1)
        out.append(wide[:, :8 * groups])
    return np.stack(out)


def cells(unit: np.ndarray, tables: int = TABLES, groups: int = GROUPS, scale: float = SCALE) -> np.ndarray:
    """n x tables x (1 + probes) cell ids, the own cell first."""
    n, dims = unit.shape
    scale = scale * np.sqrt(dims / 64)
    rng = np.random.default_rng(7)
    odd = rng.integers(1, 2**63, (tables, groups, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for t, directions in enumerate(_projection(dims, tables, groups)):
        y = unit @ directions * scale
        hashed = []  # groups x kinds x n
        for g in range(groups):
            x = y[:, 8 * g:8 * g + 8]
            own = decode(x)
            kinds = [own, *neighbours(x, own)]
            hashed.append([(p.astype(np.uint64) * odd[t, g]).sum(1, dtype=np.uint64) for p in kinds])
        base = sum(h[0] for h in hashed)
        ids = [base]
        for g in range(groups):
            ids += [base - hashed[g][0] + hashed[g][k] for k in (1, 2)]
        for g in range(groups):
            for f in range(g):
                ids.append(base - hashed[g][0] + hashed[g][1] - hashed[f][0] + hashed[f][1])
        mixed = np.stack(ids, 1)
        mixed ^= mixed >> np.uint64(31)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 0x632BE59BD9B4E019 % 2**64) + np.uint64(dims)
        out.append(mixed ^ mixed >> np.uint64(29))
    return np.stack(out, 1).view(np.int64)


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, zero-padded to the longest, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(dims), int(dims.max(initial=1))))
    row = np.repeat(np.arange(len(dims)), dims)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(dims) - dims, dims)] = flat
    out /= np.abs(out).max(1, keepdims=True)  # neither squares nor sums overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True), dims


def _cells_by_length(unit: np.ndarray, dims: np.ndarray) -> np.ndarray:
    found = None
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        got = cells(np.ascontiguousarray(unit[at, :d]))
        found = np.zeros((len(dims), *got.shape[1:]), np.int64) if found is None else found
        found[at] = got
    return found


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _cells_by_length(*_matrix(batch.column("embedding")))
        n, tables, kinds = ids.shape
        own = np.zeros(ids.shape, bool)
        own[:, :, 0] = True
        node = np.repeat(np.asarray(batch.column("node")), tables * kinds)
        again = np.zeros(ids.shape, bool)
        for k in range(1, kinds):
            again[:, :, k] = (ids[:, :, :k] == ids[:, :, k:k + 1]).any(2)
        new = ~again.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(ids.ravel()[new]), pa.array(node[new]), pa.array(own.ravel()[new])], names=["cell", "node", "own"])


def _verify(least: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cell", "i", "j"]):
            cell, i, j = (group.column(c)[0].as_py() for c in ("cell", "i", "j"))
            unit, dims = _matrix(group.column("embedding"))
            own, block = np.asarray(group.column("own")), np.asarray(group.column("block"))
            node, count = np.asarray(group.column("node")), np.asarray(group.column("n"))
            near = unit @ unit.T >= least
            near &= (own[:, None] | own[None, :]) & (dims[:, None] == dims[None, :])
            near &= ((block[:, None] == i) & (block[None, :] == j)) | ((block[:, None] == j) & (block[None, :] == i))
            a, b = np.nonzero(np.triu(near, 1))
            if not len(a):
                continue
            used, at = np.unique(np.r_[a, b], return_inverse=True)
            a_, b_ = at[:len(a)], at[len(a):]
            ids = _cells_by_length(unit[used], dims[used])
            first = np.zeros(len(a), bool)
            open_ = np.ones(len(a), bool)
            for t in range(ids.shape[1]):
                p = np.flatnonzero(open_)
                if not len(p):
                    break
                x, y = ids[a_[p], t], ids[b_[p], t]
                top = np.iinfo(np.int64).max
                in_x = np.where((y == x[:, :1]).any(1), x[:, 0], top)  # b lies in or probes a's cell
                in_y = np.where((x == y[:, :1]).any(1), y[:, 0], top)
                meet = np.minimum(in_x, in_y)
                met = (in_x != top) | (in_y != top)
                first[p] = met & (meet == cell)
                open_[p[met]] = False
            links = np.bincount(a[first], count[b[first]], len(node)) + np.bincount(b[first], count[a[first]], len(node))
            root = stars(len(node), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(np.rint(links[used]).astype(np.int64)), pa.array(node[root[used]])], names=["node", "links", "root"])
    return each


def near_embeddings(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``vectors``:
    the other vectors with a cosine of ``least`` or more, the smallest id
    reachable by links, and whether that is its own.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null id link with nothing (n_links 0,
    component_id the own id, kept true, or null for a null id).  Vectors of
    different lengths don't link.  Repeated rows are vectors of their own that
    link with each other, and an id that several vectors have names each of
    them: every row has the links of its own vector.  Other columns are
    ignored; an empty table gives an empty table."""
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # a node is a vector, whatever ids it has: its number is given as the table is written
    nodes = cut(rows.where(sound).groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
                .withColumn("node", F.monotonically_increasing_id()), "vectors")
    placed = cut(nodes.select("node", "embedding").mapInArrow(lean(_place), "cell long, node long, own boolean"), "cells")
    size = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("own").alias("lies")).where("size > 1 and lies").select("cell", "size")
    spread = (placed.join(size, "cell").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .select("cell", "node", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("cell", "node", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    dealt = spread.join(nodes, "node").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(dealt.select("cell", "i", "j", "block", "own", "node", "n", "embedding").mapInArrow(lean(_verify(least)), "node long, links long, root long"), "verified")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found, "node", "root").withColumnRenamed("node", "in_class")
    rooted = cut(nodes.join(total, "node", "left").join(classes, F.col("node") == F.col("in_class"), "left")
                 .select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"), "rooted")
    smallest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    known = rooted.join(smallest, "root").select("embedding", "n_links", "component_id", F.xxhash64("embedding").alias("h"))
    probe = rows.withColumn("key", F.when(sound, F.xxhash64("embedding"))).alias("r")
    joined = probe.join(known.alias("k"), F.expr("r.key = k.h and r.embedding = k.embedding"), "left")
    own = F.coalesce(F.col("component_id"), F.col("id"))
    return joined.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"))


def q_op1(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings at cosine 0.95."""
    return near_embeddings(read(spark, sf_dir, "embeddings"))


QUERIES = {"op1_lattice": q_op1}
