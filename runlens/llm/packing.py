"""Packing documents into training sequences, shortest pack first over the
histogram of lengths (Krell et al. 2021).

Tokenised documents are cut into full sequences and one remainder; all that
planning needs is how many pieces there are of each length, at most
``capacity`` numbers.  Lengths are placed longest first, each into the pack
with the most room, many pieces at a time, so a pack is a pattern of lengths
with a count.  Patterns come back to the pieces by rank: the k-th piece of a
length takes the k-th slot of that length.  Ranks are counted in buckets, so
no length, however common, is numbered in one task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_BYTES, bounded_batches, cut, free_name, lean, parts, read

CAPACITY = 1024
END_ID = 0
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
MEMORY_WORDS = 300_000
LINE_WORDS, LINES = 500, 16
SPACE = "\u0120"  # how a byte-level vocabulary writes a space
BUCKET_PIECES = 50_000
SLOT_ROWS = 200_000  # slots of at most this many kinds are sent to every executor


class SpacedEncoder:
    """Encodes texts with a byte-level tokenizer, remembering the ids of words.

    A word is a stretch from one single space to the next.  Pre-tokens never
    go over the place before a space that other characters follow, so ids of
    words concatenate to the ids of the text; texts in which white space stands
    beside such a space are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], at: int) -> None:
        """Put the ids of words behind a space at the places from ``at`` on.
        They are encoded many at a time, as one text, in which a word begins
        at every id that begins with a space."""
        if not words:
            return
        found = []
        for i in range(0, len(words), LINES * LINE_WORDS):  # what the tokenizer returns takes a hundred bytes an id
            lines = [" " + " ".join(words[j:j + LINE_WORDS]) for j in range(i, min(i + LINES * LINE_WORDS, len(words)), LINE_WORDS)]
            found += [np.array(line, np.int32) for line in self._encode(lines)]
        ids = np.concatenate(found)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(words):
            raise ValueError("the tokenizer joins words over spaces")
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.sizes[at:at + len(words)] = np.diff(np.r_[begins, len(ids)])
        self.starts[at:at + len(words)] = self.used + begins
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty, as the tokenizer gives them."""
        if len(self.place) > MEMORY_WORDS:
            self.forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(texts, " ")
        words = split.flatten()
        count = np.asarray(split.value_lengths())
        first = np.cumsum(count) - count
        coded = words.dictionary_encode()
        code, kinds = np.asarray(coded.indices), coded.dictionary
        head = pc.utf8_slice_codeunits(kinds, 0, 1).dictionary_encode()
        odd = np.array([not h or h.isspace() for h in head.dictionary.to_pylist()], bool)[np.asarray(head.indices)]
        odd_at = odd[code]
        odd_at[first] = False  # no space stands before a text's first word
        whole = np.logical_or.reduceat(odd_at, first) if len(first) else odd_at
        kinds = kinds.to_pylist()
        at = np.fromiter(map(self.place.get, kinds, repeat(-1)), np.int32, len(kinds))
        # words that come again are remembered, the others only for now
        again = np.bincount(code, minlength=len(kinds)) > 1
        new = np.flatnonzero((at < 0) & ~odd)
        new = np.r_[new[again[new]], new[~again[new]]]
        at[new] = np.arange(len(self.place), len(self.place) + len(new))
        kept = [kinds[i] for i in new[again[new]].tolist()]
        self._learn(kept, len(self.place))
        self.place.update(zip(kept, range(len(self.place), len(self.place) + len(kept))))
        used = self.used
        self._learn([kinds[i] for i in new[len(kept):].tolist()], len(self.place))
        at = at[code]
        sizes = self.sizes[at]
        sizes[first] = 0
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(self.starts[at] - (ends - sizes).astype(np.int32), sizes)]
        self.used = used
        cuts = np.r_[0, ends][np.r_[first, len(at)]].tolist()
        opening = self._encode(words.take(pa.array(first)).to_pylist())
        for k, alone in enumerate(whole.tolist()):
            yield np.array(self._encode([texts[k].as_py()])[0], np.int32) if alone else np.concatenate([np.array(opening[k], np.int32), ids[cuts[k]:cuts[k + 1]]])


_ENCODERS: dict[str, SpacedEncoder] = {}


def encoder(path: str) -> SpacedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpacedEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, ids: bool = True, by: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids][, ``by``]): each
    document's ids, with the end id, cut every ``capacity`` ids.  ``ids_crc32`` is
    over the ids as little-endian 32-bit numbers."""
    bounded_batches(docs.sparkSession)
    group = [F.col(f"`{by}`")] if by else []
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *group)
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")],
                         *([F.lit(None).cast("array<int>").alias("ids")] if ids else []), *group).schema
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            found: list[tuple] = []
            for k, got in enumerate(ids_ for part in parts(batch.column(1), 4 * PART_BYTES) for ids_ in model.encode(part)):
                got = np.append(got, END_ID).astype("<u4")
                for start in range(0, len(got), capacity):
                    piece = got[start:start + capacity]
                    found.append((k, start, len(piece), zlib.crc32(piece), len(got), piece.astype(np.int32) if ids else None))
            k, *rest = zip(*found) if found else [()] * 6
            k = pa.array(k, pa.int64())
            columns = [batch.column(0).take(k), *[pa.array(c, pa.int64()) for c in rest[:4]], *([pa.array(rest[4], pa.list_(pa.int32()))] if ids else [])]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(2).take(k)] if by else []), names=names)

    return rows.mapInArrow(lean(each), schema)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: packs that hold every piece of the histogram.
    Longest lengths first, each into the shortest pack so far that has room;
    equal packs are one pattern, split where only some of them take a piece."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_ if r >= length), default=None)
            if room is None:  # a new pack is the shortest one until it is full
                each = capacity // length
                for count, pieces_ in ((left // each, each), (1, left % each)):
                    if count and pieces_:
                        open_.setdefault(capacity - pieces_ * length, []).append((count, (length,) * pieces_))
                break
            count, pack = open_[room].pop()
            if not open_[room]:
                del open_[room]
            take = min(left, count)
            if count > take:
                open_.setdefault(room, []).append((count - take, pack))
            open_.setdefault(room - length, []).append((take, (*pack, length)))
            left -= take
    return [p for room in sorted(open_) for p in open_[room]]


def ranked(rows: DataFrame, by: str | None = None) -> DataFrame:
    """``rows`` with ``rank``, from 0 among the pieces of its length (and of its
    ``by``).  Pieces are numbered within buckets of a hash; a bucket's first
    number is the sum of the buckets before it."""
    keys = ["length", *([by] if by else [])]
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_PIECES))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(*keys, "bucket", (F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    same = reduce(and_, [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "bucket")])
    return dealt.withColumn("within", within).alias("d").join(before.alias("b"), same).select(
        *[F.col(f"d.{c}") for c in rows.columns], (F.col("b.before") + F.col("d.within")).alias("rank"))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, ids: bool = True,
         by: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``: every id of
    every document, and its end id, lies in one piece; pieces of a sequence
    follow each other from offset 0 and hold at most ``capacity`` ids.  With
    ``by``, a column of few values, a sequence holds documents of one value of
    it (null is one), which follows as a column.

    A null or empty text is its end id alone.  Repeated rows are documents of
    their own; a null id is kept; other columns are ignored; an empty table
    gives an empty table.  ``ids=False`` leaves the ids out (their checksum
    stays)."""
    spark = docs.sparkSession
    own = free_name((*PIECE, "sequence_id", "offset", "bucket", "within", "rank"), by) if by else None
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{by}`").cast("string").alias(own)) if by else docs
    cut_pieces = cut(pieces(rows, "doc_id" if by else id, "text" if by else text, tokenizer, capacity, ids, own), "pieces")
    histograms: dict[str | None, dict[int, int]] = {}
    for r in cut_pieces.groupBy("length", (F.col(own) if own else F.lit(None).cast("string")).alias("group")).agg(F.count("*").alias("n")).collect():
        histograms.setdefault(r["group"], {})[r["length"]] = r["n"]
    slots: list[tuple[str | None, int, int, int, int, int]] = []
    first = 0
    for group in sorted(histograms, key=lambda g: (g is not None, g)):
        taken = dict.fromkeys(histograms[group], 0)
        for count, pack_ in patterns(histograms[group], capacity):
            offset = 0
            for length in pack_:
                slots.append((group, length, taken[length], taken[length] + count, first, offset))
                taken[length] += count
                offset += length
            first += count
    table = spark.createDataFrame(slots, "group string, length long, low long, high long, first long, offset long")
    if len(slots) <= SLOT_ROWS:
        table = F.broadcast(table)
    of = f" and p.`{own}` <=> s.group" if own else ""
    placed = ranked(cut_pieces, own).alias("p").join(table.alias("s"), F.expr("p.length = s.length and p.rank >= s.low and p.rank < s.high" + of))
    last = [F.col(f"p.`{own}`")] if own else []
    return placed.select(*[F.col(f"p.{c}") for c in cut_pieces.columns if c != own], F.expr("s.first + p.rank - s.low").alias("sequence_id"), F.col("s.offset"), *last)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): each packed sequence as one row of
    at most ``capacity`` ids."""
    inner = F.struct("offset", "doc_id", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(inner)).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))


def q_op10(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"), ids=False)


QUERIES = {"op10_packing": q_op10}
