"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint pass over whole texts gives 64 bits a row; rows with the same
fingerprint are one node from there on, so a group of exact copies costs one
node.  With radius r the 64 bits are cut into r + 2 segments: two fingerprints
at most r bits apart agree on two segments at least, so every link meets in
one of the C(r + 2, 2) tables keyed by a pair of segments.  A key with more
than ``block`` nodes is dealt as pairs of blocks, each a group of at most
2 x ``block`` nodes; no group grows with the data.

Within a group the fingerprints are stored as 64 bit planes, 64 fingerprints
a machine word.  All distances of a query to the group are kept in vertical
binary counters, one XOR and a carry-save addition a plane; a query's row of
words is abandoned as soon as every lane is beyond the radius.  A group emits
one link from each node to the least node of its local component, so links
are at most as many as nodes, and components over these are the components
over all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, free_name, lean, read, runs, stars, utf8
from .components import components

SEED = 42
BITS = 64
CHUNK = 1 << 14


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of one text: XXH64 of every shingle of ``shingle`` words,
    a bit set where over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    line = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:len(words) - k + 1].tolist()
    ends = (ends[k - 1:] - 1).tolist()
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):
        found = np.array([h(line[s:e], SEED) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], np.uint64)
        bits = np.unpackbits(found.view(np.uint8), bitorder="little").reshape(-1, BITS)
        count += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(count * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, to: str = "fingerprint") -> DataFrame:
    """``docs`` without its text column, plus the fingerprint as a long (its
    64 bits).  A null or blank text has fingerprint zero."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias(to)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(text))
            got = np.array([fingerprint(bytes(data[a:b]), shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got.view(np.int64))], names=[*keep, to])

    return docs.mapInArrow(lean(each), out)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes (64 x words) of 64-bit values, 64 values a word."""
    lanes = -(-len(values) // BITS) * BITS
    bits = np.zeros((BITS, lanes), np.uint8)
    bits[:, :len(values)] = (values[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is over ``radius`` or has overflowed."""
    greater = np.zeros_like(over)
    equal = ~np.zeros_like(over)
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            greater |= equal & counters[i]
            equal &= ~counters[i]
    return greater | over


def close_pairs(values: np.ndarray, radius: int, rows: int = 256, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``values`` (uint64) at most ``radius`` bits apart, each
    value also with itself."""
    plane = planes(values)
    words = plane.shape[1]
    padding = planes(np.full(len(values), 2**64 - 1, np.uint64))[0]
    left, right = [], []
    for first in range(0, len(values), rows):
        at = np.arange(first, min(first + rows, len(values)))
        counters = [np.zeros((len(at), words), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.broadcast_to(~padding, (len(at), words)).copy()
        for bit in range(BITS):
            flip = (values[at] >> np.uint64(bit) & np.uint64(1)) * np.uint64(2**64 - 1)
            carry = plane[bit][None, :] ^ flip[:, None]
            for c in counters:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if bit % step == step - 1:
                done = (beyond(counters, over, radius) == np.uint64(2**64 - 1)).all(1)
                if done.any():
                    at, over, counters = at[~done], over[~done], [c[~done] for c in counters]
                    if not len(at):
                        break
        if len(at):
            near = ~beyond(counters, over, radius)
            row, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            left.append(at[row])
            right.append(lane)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(radius: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["t", "key", "i", "j"]):
            values = np.unique(np.asarray(group.column("node")).view(np.uint64))
            root = stars(len(values), *close_pairs(values, radius))
            linked = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[root[linked]].view(np.int64)), pa.array(values[linked].view(np.int64))], names=["a", "b"])
    return each


def links(nodes: DataFrame, node: str, radius: int = 2, block: int = 512) -> DataFrame:
    """Links (a, b) that join every pair of distinct 64-bit values at most
    ``radius`` bits apart into one component."""
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    segments = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    masks = [a | b for a, b in combinations(segments, 2)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    placed = (nodes.select(F.col(node).alias("node"))
              .select("node", F.posexplode(F.array(*[F.col("node").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key")))
    size = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    spread = (placed.join(size, ["t", "key"])
              .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
              .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .select("t", "key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .select("t", "key", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    dealt = spread.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return dealt.mapInArrow(lean(_compare(radius)), "a long, b long")


def rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (fingerprint, least) with the least fingerprint of each one's
    component."""
    classes = components(links(nodes, "fingerprint", radius), "a", "b")
    return nodes.join(classes, nodes.fingerprint == classes.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the
    smallest id reachable over links of at most ``radius`` differing bits.
    Words are whatever stands between ASCII white space, ASCII letters in
    lower case.  A null, empty or blank text has fingerprint zero and is
    linked like any other.  Repeated rows give repeated result rows; a null id
    keeps its row and never becomes a component id unless the whole component
    has none (then null).  Other columns are ignored, whatever their names;
    an empty table gives an empty table."""
    rows = cut(fingerprints(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")), shingle=shingle), "fingerprints")
    grouped = rooted(cut(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes"), radius)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return (rows.join(grouped.join(least, "root").select("fingerprint", "component_id"), "fingerprint")
            .select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each group: that of the least id, of several
    with this id the one whose columns have the least hash, so that an id
    may stand for several texts, each judged by its own group.  Rows that are
    alike in every column count as one document; rows with a null id stay.
    Texts are dealt once, by id and hash, whatever the size of either side, so
    that a run costs in proportion to its input."""
    names = []
    for base in ("row_hash", "known_id", "known_hash", "times"):
        names.append(free_name([*docs.columns, *names], base))
    hash_, known, known_hash, times = names
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumn(hash_, F.xxhash64(*hashed, *[c.isNull() for c in hashed]))  # nulls alone leave a hash as it was
    rows = fingerprints(keyed.where(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").alias("id"), F.col(hash_).alias("hash"), F.col(f"`{text}`").cast("string").alias("text")), shingle=shingle)
    nodes = cut(rows.groupBy("fingerprint", "id", "hash").agg(F.count("*").alias("times"))
                .groupBy("fingerprint").agg(F.min(F.struct("id", "hash", "times")).alias("least")), "nodes")
    first = cut(rooted(nodes, radius).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.id").alias(known), F.col("least.hash").alias(known_hash), F.col("least.times").alias(times)), "first")
    joined = keyed.join(first.hint("merge"), (F.col(f"`{id}`") == F.col(known)) & (F.col(hash_) == F.col(known_hash)), "left")
    stay = joined.where(F.col(f"`{id}`").isNull() | F.col(known).isNotNull())
    if not first.where(F.col(times) > 1).limit(1).count():  # else texts would be dealt twice
        return stay.select(*own)
    once = stay.where(F.coalesce(F.col(times), F.lit(1)) == 1).select(*own)
    return once.unionByName(stay.where(F.col(times) > 1).select(*own).dropDuplicates())


def q_op2(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, 2 bits."""
    return simhash_groups(read(spark, sf_dir, "documents"), shingle=3, radius=2)


QUERIES = {"op2_simhash": q_op2}
