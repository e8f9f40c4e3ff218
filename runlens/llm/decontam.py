"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items form one suffix automaton whose
symbols are word numbers.  Every document's words are streamed through it; the
longest match that ends at a word says whether a window of ``window`` item
words ends there, and the state says which items hold it.

The benchmark is dealt in shards of at most ``shard_bytes`` of words (items
are cut into overlapping pieces first, so that one long item is no exception).
``shards_a_pass`` automata at a time are small enough to hold in every worker.
One pass over the documents splits each text once and streams it through all of
them; with more shards the documents, with the spans found so far, are written
between passes and the shards of the pass before are given up.  So the driver,
a worker and a stage hold one pass's shards however large the benchmark is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, free_name, lean, read, utf8

# Bytes outside words become spaces, A-Z lower case; words are [0-9a-z] and
# whatever is not ASCII.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
PIECE = 4096
SHARDS_A_PASS = 4


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each
    window of words and of each short item."""

    def __init__(self, items: tuple[tuple[str, tuple[bytes, ...], bool], ...], window: int):
        """items: (item id, words of a piece, whether it is a whole item)."""
        self.window = window
        self.word: dict[bytes, int] = {}
        for _, words, _ in items:
            for w in words:
                self.word.setdefault(w, len(self.word))
        self.base = max(1, len(self.word))
        self.go: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]
        numbers = [[self.word[w] for w in words] for _, words, _ in items]
        for seq in numbers:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        del self.out
        self.items: list[str] = sorted({i for i, _, _ in items})
        place = {i: k for k, i in enumerate(self.items)}
        held: dict[int, set[int]] = {}
        short: dict[int, set[tuple[int, int]]] = {}
        self.least = window
        for (item, words, whole), seq in zip(items, numbers):
            if whole and 0 < len(seq) < window:
                state = 0
                for c in seq:
                    state = self.go[state * self.base + c]
                short.setdefault(state, set()).add((len(seq), place[item]))
                self.least = min(self.least, len(seq))
            elif len(seq) >= window:
                for state, n in self.steps(seq):
                    if n >= window:
                        held.setdefault(self.up(state), set()).add(place[item])
        same: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.held = {s: same.setdefault(t, t) for s, t in ((s, tuple(sorted(i))) for s, i in held.items())}
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        if short:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.short[s] = (*self.short[self.link[s]], *sorted(short.get(s, ())))

    def _extend(self, last: int, c: int) -> int:
        go, base, link, length, out = self.go, self.base, self.link, self.length, self.out
        q = go.get(last * base + c)
        if q is not None and length[last] + 1 == length[q]:
            return q
        if q is None:
            new = len(link)
            link.append(0)
            length.append(length[last] + 1)
            out.append([])
            p = last
            while p >= 0 and p * base + c not in go:
                go[p * base + c] = new
                out[p].append(c)
                p = link[p]
            if p < 0:
                return new
            q = go[p * base + c]
            if length[p] + 1 == length[q]:
                link[new] = q
                return new
        else:
            new, p = -1, last
        copy = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        out.append(list(out[q]))
        for d in out[q]:
            go[copy * base + d] = go[q * base + d]
        while p >= 0 and go.get(p * base + c) == q:
            go[p * base + c] = copy
            p = link[p]
        link[q] = copy
        if new >= 0:
            link[new] = copy
            return new
        return copy

    def up(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` holds."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def steps(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each symbol."""
        go, base, link, length = self.go, self.base, self.link, self.length
        state = n = 0
        for c in seq:
            to = go.get(state * base + c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = go.get(state * base + c)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            yield state, n

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of hit words (start, end) and the items found."""
        get = self.word.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(np.diff(np.r_[False, numbers >= 0, False]))
        found: list[list[int]] = []
        items: set[int] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.least:
                continue
            for at, (state, n) in enumerate(self.steps(numbers[a:b].tolist()), a + 1):
                size = 0
                if n >= self.window:
                    at_window = self.held.get(self.up(state))
                    if at_window:
                        items.update(at_window)
                        size = self.window
                for k, item in self.short[state]:
                    if k <= n:
                        items.add(item)
                        size = max(size, k)
                if size:
                    start = at - size
                    while found and found[-1][1] >= start and found[-1][0] >= start:
                        found.pop()
                    if found and found[-1][1] >= start:
                        found[-1][1] = at
                    else:
                        found.append([start, at])
        return [(a, b) for a, b in found], items


@lru_cache(maxsize=1)
def _automata(shards: tuple, window: int) -> list[Automaton]:
    """The automata of a pass; a worker keeps those of the last one."""
    return [Automaton(items, window) for items in shards]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _pieces(window: int):
    """Items as words in pieces that overlap by ``window`` - 1 words."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column("text"))
            for k, item in enumerate(batch.column("item").to_pylist()):
                words = words_of(bytes(data[at[k]:at[k + 1]]))
                cuts = range(0, max(1, len(words) - window + 1), PIECE)
                rows = [(item, i, b" ".join(words[i:i + PIECE + window - 1]).decode(), len(cuts) == 1) for i in cuts if words]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["item", "piece", "words", "whole"])
    return each


def passes(benchmark: DataFrame, id: str, text: str, window: int, shard_bytes: int, shards_a_pass: int) -> Iterator[tuple]:
    """The benchmark's pieces in shards of about ``shard_bytes``, at most
    ``shards_a_pass`` shards at a time; equal pieces of one item come once."""
    pieces = cut(benchmark.select(F.col(f"`{id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
                 .where("item is not null").mapInArrow(lean(_pieces(window)), "item string, piece long, words string, whole boolean")
                 .groupBy("item", "words", "whole").agg(F.min("piece").alias("piece")), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    n = -(-total // shard_bytes)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    for k in range(0, n, shards_a_pass):
        held: dict[int, list[tuple]] = {}
        for r in dealt.where(F.col("shard").between(k, k + shards_a_pass - 1)).collect():
            held.setdefault(r["shard"], []).append((r["item"], tuple(r["words"].encode().split()), r["whole"]))
        if held:
            yield tuple(tuple(sorted(held[shard])) for shard in sorted(held))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 10, shard_bytes: int = 1 << 20, shards_a_pass: int = SHARDS_A_PASS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``n_words`` long, ``hits``
    array<struct<start,end,char_start,char_end>> (spans inside occurrences of
    windows, in words and in code points, maximal, in order) and ``items``
    array<string> (ids of items with an occurring window, sorted); and the
    names these columns got (underscores are appended where ``docs`` has the
    names already).

    A window is ``window`` consecutive words of an item; an item with fewer
    words, but not none, is one window.  Null or empty texts have no words and
    no hits; an item with a null id or no words is never found; repeated items
    and rows do no harm; empty tables give empty results or no hits."""
    bounded_batches(docs.sparkSession)
    names = {k: free_name(docs.columns, k) for k in ("n_words", "hits", "items")}
    columns = [*docs.columns, *names.values()]
    at = docs.columns.index(text)
    fields = ("start", "end", "char_start", "char_end")
    span = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
    out = docs.select("*", F.lit(0).cast("long").alias(names["n_words"]), F.lit(None).cast("array<struct<start:long,end:long,char_start:long,char_end:long>>").alias(names["hits"]),
                      F.lit(None).cast("array<string>").alias(names["items"])).schema

    def scan(shared, first: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = _automata(*shared.value) if shared else []
            for batch in batches:
                offsets, data = utf8(batch.column(at))
                old = [None] * batch.num_rows if first else list(zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist()))
                sizes, hits, items = [], [], []
                for a, b, had in zip(offsets[:-1].tolist(), offsets[1:].tolist(), old):
                    words = words_of(bytes(data[a:b]))
                    got = [(h["start"], h["end"]) for h in had[0]] if had else []
                    names_ = set(had[1]) if had else set()
                    for machine in machines:
                        more, found = machine.spans(words)
                        got = merged([*got, *more]) if got and more else got or more
                        names_.update(machine.items[i] for i in found)
                    sizes.append(len(words))
                    chars = in_code_points(bytes(data[a:b]), got) if got else []
                    hits.append([dict(zip(fields, (*g, *c))) for g, c in zip(got, chars)])
                    items.append(sorted(names_))
                own = batch.columns if first else batch.columns[:-3]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string()))], names=columns)
        return each

    found, shared = docs, None
    for group in passes(benchmark, item_id, item_text, window, shard_bytes, shards_a_pass):
        first = shared is None
        if not first:
            found = cut(found, "decontaminated")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast((group, window))
        found = found.mapInArrow(lean(scan(shared, first)), out)
    return (docs.mapInArrow(lean(scan(None, True)), out) if shared is None else found), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_code_points(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of words begin and end in the text."""
    flags = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    starts, ends = edges[::2], edges[1::2]
    before = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[starts[a]]), int(before[ends[b - 1]])) for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """``docs``, same columns, with every hit span of words cut out of the
    text; a document of which more than ``max_coverage`` of the words is hit
    goes altogether.  Documents without a hit stay as they are, null and empty
    texts included."""
    found, names = find(docs, benchmark, text, item_id, item_text, window)
    hits = F.col(names["hits"])
    covered = F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    stay = found.where(covered <= F.col(names["n_words"]) * max_coverage)
    body = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
    folded = F.aggregate(hits, start, lambda x, h: F.struct(
        h["char_end"].alias("at"), F.concat(x["kept"], body.substr((x["at"] + 1).cast("int"), (h["char_start"] - x["at"]).cast("int"))).alias("kept")))
    left = F.concat(folded["kept"], body.substr((folded["at"] + 1).cast("int"), F.length(body)))
    return stay.select(*[F.when(F.size(hits) > 0, left).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def q_op7(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by 10-word windows of the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = find(docs, read(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


QUERIES = {"op7_decontamination": q_op7}
