"""Exact substring deduplication by bucket-pointer refinement.

Every byte is removed that some string of ``length`` bytes covers which also
starts earlier: in a document of smaller id, or earlier in the same one.

The suffixes to sort are the windows of ``length`` bytes.  A window's initial
bucket is a q-gram inside it, the one with the least hash, so neighbouring
windows share their q-gram and a bucket holds segments: runs of windows, a few
bytes each, instead of one row a byte.  Equal windows have equal q-grams at
equal offsets, so only segments in buckets with two members or more go on;
their bytes are fetched from the texts, and the buckets are dealt to tasks.
There the windows are refined by sorting on the bucket identifiers (hashes of
q-grams) found at later offsets, until the whole length is compared; windows
alone in a bucket drop out after each step, and identifiers are computed once
and used by all windows that point at them.  What is left equal is compared
byte by byte before anything is removed.

A document whose whole text stands under a smaller id as well needs none of
this: all of it goes.  A bucket with more than ``block`` segments is not
gathered: its windows are counted one by one by their whole hash, with map-side
minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lean, read, utf8

LENGTH = 100
BLOCK = 20_000
CHUNK = 1 << 20
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_size(length: int) -> int:
    """Bytes of a q-gram: whole words of eight, about a third of a window."""
    return 8 * max(1, length // 25)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` bytes (a multiple of 8) from every place."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    h = np.zeros(n, np.uint64)
    for k in range(q // 8):
        x = words[8 * k:8 * k + n] * ODD[k % len(ODD)]
        x ^= x >> np.uint64(29 + k % 7)
        h = h * ODD[(k + 3) % len(ODD)] + x
    h ^= h >> np.uint64(32)
    h *= ODD[5]
    h ^= h >> np.uint64(29)
    return h


def least_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the hash of the q-gram with the least hash in it (of
    equal ones the first), and where that is."""
    q = gram_size(length)
    h = grams(data, q)
    windows = len(data) - length + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.uint64(2 * CHUNK - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    size, wide = 1, length - q + 1
    while 2 * size <= wide:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < wide:
        key = np.minimum(key[:windows], key[wide - size:wide - size + windows])
    at = (key[:windows] & place).astype(np.int64)
    return h[at], at


def segments(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bucket, document, start, gram offset, windows) of the segments of
    texts that lie one after another in ``data``."""
    out = []
    for base in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[base:base + CHUNK + length - 1]
        h, at = least_grams(part, length)
        if not len(h):
            continue
        edges = np.r_[offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])] - base
        start = np.unique(np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, edges[(edges > 0) & (edges < len(h))]])
        end = np.r_[start[1:], len(h)]
        doc = np.searchsorted(offsets, start + base, side="right") - 1
        ok = start + base + length <= offsets[doc + 1]
        start, end, doc = start[ok], end[ok], doc[ok]
        out.append((h[start], doc, start + base - offsets[doc], at[start] - start, end - start))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.uint64, *[np.int64] * 4))


def packed(start: np.ndarray, gram: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | gram.astype(np.int64) << 16 | windows.astype(np.int64)


def _segments(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
            bucket, doc, start, gram, windows = segments(offsets - offsets[0], flat, length)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.asarray(batch.column("d"))[doc]), pa.array(packed(start, gram, windows))], names=["v", "d", "at"])
    return each


def _contexts(length: int):
    """The bytes under each segment, beside the document they are from."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("text"), batch.column("segments")
            rows = np.repeat(np.arange(batch.num_rows), np.asarray(own.value_lengths()))
            inner = own.flatten()
            at = np.asarray(inner.field("at"))
            offsets, data = utf8(texts)
            start, windows = at >> 32, at & 0xFFFF
            a = offsets[rows] + start
            b = np.minimum(a + windows + length - 1, offsets[rows + 1])
            fits = b - a == windows + length - 1
            take = pa.array(np.flatnonzero(fits))
            a, b, rows = a[fits], b[fits], rows[fits]
            size = b - a
            ends = np.cumsum(size)
            raw = np.frombuffer(data, np.uint8)[np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - ends + size, size)]
            held = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            r = pa.array(rows)
            yield pa.RecordBatch.from_arrays([inner.field("v").take(take), inner.field("big").take(take), batch.column("d").take(r), batch.column("id").take(r), batch.column("tie").take(r),
                                              inner.field("at").take(take), held], names=["v", "big", "d", "id", "tie", "at", "bytes"])
    return each


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A class number for each of the windows that start at ``at``, -1 for
    windows that no other equals.  Buckets of equal q-grams are refined by the
    bucket identifiers at later offsets."""
    q = gram_size(length)
    h = grams(data, q)
    out = np.full(len(at), -1, np.int64)
    live = np.arange(len(at))
    bucket = h[at]
    for step in [0, *range(q, length - q, q), length - q]:
        if step:
            bucket = (bucket ^ h[at[live] + step]) * ODD[0] + h[at[live] + step]
        kinds, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
        more = count[inverse] > 1
        live, bucket = live[more], inverse[more].astype(np.uint64)
    out[live] = bucket.astype(np.int64)
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    order = np.argsort(out[live], kind="stable")
    sorted_ = live[order]
    same = out[sorted_[1:]] == out[sorted_[:-1]]
    differ = np.zeros(max(0, len(sorted_) - 1), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        differ |= words[at[sorted_[1:]] + k] != words[at[sorted_[:-1]] + k]
    if (same & differ).any():  # two strings with one hash: group by the strings
        kinds_: dict[bytes, int] = {}
        for i in live.tolist():
            out[i] = kinds_.setdefault(data[at[i]:at[i] + length].tobytes(), len(kinds_))
    return out


def _refine(length: int):
    """Covered stretches (d, id, tie, start, end) of the segments of whole
    buckets, many buckets at a time."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            at = np.asarray(table.column("at"))
            start, windows = at >> 32, at & 0xFFFF
            coded = _one(table, "bytes").dictionary_encode()
            kind = np.asarray(coded.indices)
            offsets, data = utf8(coded.dictionary)
            flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            size = np.diff(offsets) - length + 1
            ends = np.cumsum(size)
            owner = np.repeat(np.arange(len(size)), size)
            first = np.arange(ends[-1]) - np.repeat(ends - size, size) + offsets[owner]
            classes = equal_windows(flat, first, length)
            # a row for each window of each segment that is not alone
            total = np.cumsum(windows)
            row = np.repeat(np.arange(len(at)), windows)
            nth = np.arange(total[-1]) - np.repeat(total - windows, windows)
            spot = (ends - size)[kind[row]] + nth
            copies = np.bincount(kind, minlength=len(size))
            label = np.where(classes[spot] >= 0, classes[spot], -1 - spot)
            on = (classes[spot] >= 0) | (copies[kind[row]] > 1)
            row, nth, label = row[on], nth[on], label[on]
            ids, tie = np.asarray(table.column("id")), np.asarray(table.column("tie"))
            rank = np.empty(len(at), np.int64)  # of documents, by id and tie
            by = np.lexsort((tie, ids))
            rank[by] = np.cumsum(np.r_[0, (ids[by][1:] != ids[by][:-1]) | (tie[by][1:] != tie[by][:-1])])
            order = np.lexsort((start[row] + nth, rank[row], label))
            r, p, lab = row[order], (start[row] + nth)[order], label[order]
            head = np.r_[True, lab[1:] != lab[:-1]] if len(lab) else np.zeros(0, bool)
            lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(lab) else np.zeros(0, np.int64)
            later = (rank[r] != rank[r[lead]]) | (p != p[lead])
            r, p = r[later], p[later]
            order = np.lexsort((p, r))
            r, p = r[order], p[order]
            new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)] if len(r) else np.zeros(0, bool)
            last = np.r_[new[1:], True] if len(r) else np.zeros(0, bool)
            take = pa.array(r[new])
            yield pa.RecordBatch.from_arrays([_one(table, c).take(take) for c in ("d", "id", "tie")] + [pa.array(p[new]), pa.array(p[last] + length)], names=["d", "id", "tie", "start", "end"])
    return each


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets out of a stream sorted by bucket."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = np.asarray(batch.column("v"))
        last = int(np.searchsorted(v, v[-1], side="left"))
        if last or (kept and kept[-1].column("v")[-1].as_py() != v[0]):
            whole = [*kept, batch.slice(0, last)] if last else kept
            yield pa.Table.from_batches(whole)
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def _windows(length: int):
    """Each window of a segment by two hashes of its bytes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (at, held) in enumerate(zip(batch.column("at").to_pylist(), batch.column("bytes").to_pylist())):
                for i in range(at & 0xFFFF):
                    rows.append((k, (at >> 32) + i, hashlib.blake2b(held[i:i + length], digest_size=16).digest()))
            k, p, h = zip(*rows) if rows else [()] * 3
            take = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), *[batch.column(c).take(take) for c in ("d", "id", "tie")], pa.array(p, pa.int64())], names=["key", "d", "id", "tie", "start"])
    return each


def _cut_out(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            spans, kept = [], []
            key = zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist(), batch.column("covered").to_pylist())
            for k, (id, tie, covered) in enumerate(key):
                text = bytes(data[offsets[k]:offsets[k + 1]])
                merged: list[list[int]] = []
                for a, b in sorted((c["start"], c["end"]) for c in covered or () if c["id"] == id and c["tie"] == tie):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *[x for m in merged for x in m], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([offsets[k + 1] - offsets[k] for k in range(batch.num_rows)], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                             names=["row_id", "n_bytes", "removed", "kept"])
    return each


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, removed array<struct<start,end>>, kept binary), one row
    for each row of ``docs``: the maximal removed byte spans and the bytes that
    stay.  Strings are judged on the input, overlaps count, and matches never
    go over the end of a document.  ``length`` is 16 to 1500.

    Ids are compared as longs.  A null text is empty; texts shorter than
    ``length`` stay whole.  Rows that repeat an id and its text are one
    document, each with its result.  Rows of one id with different texts are
    documents of their own, ordered by a hash of the text; null ids come after
    all others, ordered likewise.  Other columns are ignored; an empty table
    gives an empty table."""
    if not 16 <= length <= 1500:
        raise ValueError("length must be 16 to 1500")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("row_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row_id", F.coalesce("row_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.withColumn("d", F.xxhash64("id", "tie")).select("d", "row_id", "id", "tie", "text")
    # whole copies
    whole = rows.where(F.octet_length("text") >= length).select("d", "id", "tie", F.xxhash64(F.lit("whole"), "text").alias("h"))
    first = whole.groupBy("tie", "h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = cut(whole.join(first, ["tie", "h"]).where(F.col("id") > F.col("first")).select("d").distinct(), "copies")
    own = rows.join(copies, "d", "left_anti").select("d", "row_id", "id", "tie", "text")
    # buckets of two segments or more
    found = own.select("d", "text").mapInArrow(lean(_segments(length)), "v long, d long, at long")
    shared = cut(found.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v", (F.col("n") > block).alias("big")), "buckets")
    some_big = bool(shared.where("big").limit(1).count())
    wanted = found.join(shared, "v").groupBy("d").agg(F.collect_list(F.struct("v", "big", "at")).alias("segments"))
    held = own.join(wanted, "d").select("d", "id", "tie", "text", "segments").mapInArrow(lean(_contexts(length)), "v long, big boolean, d long, id long, tie long, at long, bytes binary")
    held = cut(held, "contexts") if some_big else held
    small = held.where("not big").repartition("v").sortWithinPartitions("v")
    covered = small.select("v", "d", "id", "tie", "at", "bytes").mapInArrow(lean(_refine(length)), "d long, id long, tie long, start long, end long")
    if some_big:
        each = held.where("big").select("d", "id", "tie", "at", "bytes").mapInArrow(lean(_windows(length)), "key binary, d long, id long, tie long, start long")
        # written first: joined straight to the aggregate, a hot window's rows would have to stay together
        least = cut(each.groupBy("key").agg(F.min(F.struct("id", "tie", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "least")
        later = each.join(least, "key").where(F.struct("id", "tie", "start") > F.col("first"))
        covered = covered.unionByName(later.select("d", "id", "tie", "start", (F.col("start") + length).alias("end")))
    spans = covered.groupBy("d").agg(F.collect_list(F.struct("id", "tie", "start", "end")).alias("covered"))
    kind = "row_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    rest = own.join(spans, "d", "left").select("row_id", "id", "tie", "text", "covered").mapInArrow(lean(_cut_out(length)), kind)
    size = F.octet_length("text").cast("long")
    gone = (rows.join(copies, "d", "left_semi")
            .select("row_id", size.alias("n_bytes"), F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).alias("removed"), F.lit(b"").alias("kept")))
    return rest.unionByName(gone).withColumnRenamed("row_id", id)


def q_op8(spark, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier, cut out of all documents."""
    got = dedup_substrings(read(spark, sf_dir, "documents"))
    less = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", less.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substrings": q_op8}
