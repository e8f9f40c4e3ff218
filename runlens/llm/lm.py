"""Language-model scoring by a hashed maximum-entropy model.

A word's probability has two factors.  The first is the probability of its
class given the history, a softmax over the classes whose weights are looked
up by hashed features: the words before it (n-grams) and words and classes
farther back (skips).  The second is the word's share of its class, add-one
smoothed over the class's known words and one unknown word.  Classes are the
most frequent word endings of the training text.

Corpus statistics are exact and cover all training documents: words are
counted by a shuffle, and each block of documents gets the counts of its own
distinct words back by a join.

Weights are trained by distributed gradient updates.  The gradient of the
likelihood is what each (feature, class) is seen to be less what the model
expects it to be, E - M; both are sums over all training words.  Every update
moves each weight along its own part of the gradient on a logarithmic scale,
by ``RELAX`` (log(E + a) - log(M + a)), as iterative scaling does.  For the
first update M is known from E alone, since without weights the model expects
the classes' shares; each further one of ``rounds`` (one by default) is a pass in
which tasks add up what the model with the weights so far expects.
All sums are of integers (M in units of 2^-20), so the weights are the same
however the documents are dealt and whatever machines there are.  Rows of
weights grow with the training words, up to ``max_rows``.  Documents are scored
in sparse numpy batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lean, read, utf8

CLASSES = 64  # the end, CLASSES - 2 word endings, and all other words
LEAST_ROWS, MAX_ROWS, ROW_WORDS = 1 << 10, 1 << 16, 64  # rows of hashed weights: at least, at most, training words a row
RELAX, SMOOTH = 0.6, 2.0
UNIT = 1 << 20  # expectations are counted in units of 1 / UNIT
PART_ROWS = 1 << 10  # rows of weights that are summed as one value
BATCH, SOFT, PLACES = 1 << 14, 1 << 11, 1 << 16  # places that are scored, whose classes are expected, and added up, at a time
FEW = 64  # lines of a row that are added with those of other rows, at most
WORKER_WORDS = 16_000_000  # words of a worker's share of a pass, at least: each writes sums of all rows
MOST_WORKERS, LANES = 4096, 32
PLACE_BITS = 28  # a block's distinct words; its number has 20 bits of partition and 15 of batch


@dataclass(frozen=True)
class Model:
    """Endings by class, words and known words of each class, weights."""
    endings: dict[str, int]
    class_words: np.ndarray
    class_known: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    train_tokens: int
    known: int
    ends: int


# --- documents as blocks ----------------------------------------------------

def blocks(docs: DataFrame, id: str, text: str, training) -> DataFrame:
    """One row for each batch of documents: their ids, word counts and fold,
    the batch's distinct words, the place of each word among them, and how
    often each stands in training documents.  Written once, so that every
    later pass sees the same blocks."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"block long, ids array<{kind}>, train array<boolean>, sizes array<int>, codes binary, words binary, seen binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(1).cast(pa.large_string()).fill_null("")))
            words = split.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(split.value_lengths()))
            full = np.asarray(pc.binary_length(words)) > 0
            coded = words.filter(pa.array(full)).dictionary_encode()
            owner, code = owner[full], np.asarray(coded.indices).astype(np.int32)
            train = np.asarray(batch.column(2))
            seen = np.bincount(code[train[owner]], minlength=len(coded.dictionary)).astype(np.int32)
            sizes = np.bincount(owner, minlength=batch.num_rows).astype(np.int32)
            one = lambda v, t: pa.array([v], t)
            listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_arrays([
                one(TaskContext.get().partitionId() << 15 | k, pa.int64()), listed(batch.column(0)), listed(batch.column(2)), listed(pa.array(sizes)),
                one(squeezed(code), pa.binary()), one(folded(coded.dictionary), pa.binary()), one(squeezed(seen), pa.binary())],
                names=["block", "ids", "train", "sizes", "codes", "words", "seen"])

    bounded_batches(docs.sparkSession)
    return cut(rows.mapInArrow(lean(each), out), "blocks")


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes: all lowest bytes, then all next ones
    and so on, which are mostly zeros."""
    return zstandard.ZstdCompressor(1).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def folded(words: pa.Array) -> bytes:
    """Words as compressed bytes: how long the first part is, lengths, letters."""
    offsets, letters = utf8(words)
    lengths = squeezed(np.diff(offsets))
    return len(lengths).to_bytes(8, "little") + lengths + zstandard.ZstdCompressor(1).compress(letters[int(offsets[0]):int(offsets[-1])])


def unfolded(data: bytes) -> pa.Array:
    n = 8 + int.from_bytes(data[:8], "little")
    lengths = unsqueezed(data[8:n])
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data[n:]))])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, seen): words of training documents, a row for each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            seen = unsqueezed(batch.column("seen")[k].as_py())
            on = pa.array(seen > 0)
            yield pa.RecordBatch.from_arrays([unfolded(batch.column("words")[k].as_py()).filter(on), pa.array(seen.astype(np.int64)).filter(on)], names=["word", "seen"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spot, word): the distinct words of each block; a spot is the block and
    the place of the word in it, in one number."""
    for batch in batches:
        for k in range(batch.num_rows):
            words = unfolded(batch.column("words")[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array((batch.column("block")[k].as_py() << PLACE_BITS) + np.arange(len(words))), words], names=["spot", "word"])


# --- features -----------------------------------------------------------------

def _mix(*parts: np.ndarray, salt: int, n: int) -> np.ndarray:
    h = np.uint32(salt * 0x9E3779B1 % 2**32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x85EBCA6B)
        h = h ^ (h >> np.uint32(15))
    return (h >> np.uint32(5)) & np.uint32(n - 1)


def _coded(words: pa.Array, endings: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class and hash of each word, and of the end and the start after them."""
    last = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    place = np.array([endings.get(w, CLASSES - 1) for w in last.dictionary.to_pylist()], np.int32)
    classes = np.r_[place[np.asarray(last.indices)] if len(words) else np.zeros(0, np.int32), 0, CLASSES].astype(np.uint32)
    import xxhash
    h = xxhash.xxh32_intdigest
    hashes = np.r_[np.fromiter((h(w) for w in words.to_pylist()), np.uint32, len(words)), np.uint32(1), np.uint32(2)].astype(np.uint32)
    return classes, hashes


def _stream(codes: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """Codes of all documents in a row, an end (code ``n_words``) after each."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(len(codes) + len(sizes), np.int32)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = codes
    out[ends] = n_words
    return out


def _histories(stream: np.ndarray, sizes: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Codes one, two and three before each; the start (code ``n_words`` + 1)
    before a document's first word."""
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = []
    back = stream
    for _ in range(3):
        back = np.r_[n_words + 1, back[:-1]].astype(np.int32)
        back[starts] = n_words + 1
        out.append(back)
    return out


def _features(p: list[np.ndarray], classes: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Rows (of ``n``) of weights of each place: the word before, the two words before,
    the word before that one (skip), the classes farther back (skip)."""
    one, two, three = p
    return [_mix(hashes[one], salt=1, n=n), _mix(hashes[one], hashes[two], salt=2, n=n), _mix(hashes[two], classes[one], salt=3, n=n),
            _mix(classes[two], classes[three], classes[one], salt=4, n=n)]


def _logits(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    out += bias
    return out


def _probabilities(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    p = _logits(bias, weights, rows)
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def _seen(total: np.ndarray, features: list[np.ndarray], gold: np.ndarray) -> None:
    """Add to ``total`` how often each class follows each feature."""
    for f in features:
        cell = f.astype(np.int64) * CLASSES + gold
        if len(cell) > total.size // 8:
            total += np.bincount(cell, minlength=total.size).reshape(total.shape)
            continue
        cell.sort()
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        total.ravel()[cell[first]] += np.diff(np.r_[first, len(cell)])


def _expected(total: np.ndarray, features: list[np.ndarray], bias: np.ndarray, weights: np.ndarray) -> None:
    """Add to ``total`` (row by class) how often the model expects it, in
    units: whole numbers, which doubles add up exactly below 2^53."""
    for a in range(0, len(features[0]), PLACES):
        rows = [f[a:a + PLACES] for f in features]
        p = np.empty((len(rows[0]), CLASSES), np.float32)
        for b in range(0, len(p), SOFT):
            p[b:b + SOFT] = np.rint(_probabilities(bias, weights, [r[b:b + SOFT] for r in rows]) * np.float32(UNIT))
        _add_rows(total, rows, p)


def _add_rows(total: np.ndarray, rows: list[np.ndarray], p: np.ndarray) -> None:
    """Add each line of ``p`` to the rows of ``total`` that ``rows`` name for it.
    Rows are taken by how many lines they get, the most first: the first lines of
    some rows are taken at once, then the second ones are added, and so on; rows
    with more than ``FEW`` lines are sums of their own."""
    cells = np.concatenate(rows)
    order = np.argsort(cells.astype(np.uint16) if len(total) <= 1 << 16 else cells, kind="stable")
    cells = cells[order]
    line = order % len(p)
    start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    n = np.diff(np.r_[start, len(cells)])
    by = np.argsort(-n, kind="stable")
    start, n = start[by], n[by]
    row = cells[start]
    many = int((n > FEW).sum())
    for i in range(many):
        total[row[i]] += p[line[start[i]:start[i] + n[i]]].sum(0, dtype=np.float64)
    for a in range(many, len(start), SOFT):
        at, left = start[a:a + SOFT], n[a:a + SOFT]
        sums = p[line[at]].astype(np.float64)
        for k in range(1, int(left[0])):
            m = int(np.searchsorted(-left, -k))  # rows with more than k lines
            sums[:m] += p[line[at[:m] + k]]
        total[row[a:a + SOFT]] += sums


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes, by place."""
    return zstandard.ZstdCompressor(1).compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def _worker(shared):
    """(part, lane, data): the sums of a task over its training words, seen or,
    where there are weights, expected, ``PART_ROWS`` rows at a time."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, n_rows, bias, weights = shared.value
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes").slice(k, 1).flatten()).astype(np.int64)
                train = np.asarray(batch.column("train").slice(k, 1).flatten())
                if not train.any():
                    continue
                codes = unsqueezed(batch.column("codes")[k].as_py())[np.repeat(train, sizes)]
                words, sizes = unfolded(batch.column("words")[k].as_py()), sizes[train]
                classes, hashes = _coded(words, endings)
                stream = _stream(codes, sizes, len(words))
                features = _features(_histories(stream, sizes, len(words)), classes, hashes, n_rows)
                if weights is None:
                    total = np.zeros((n_rows, CLASSES), np.int64) if total is None else total
                    _seen(total, features, classes[stream].astype(np.int64))
                else:
                    total = np.zeros((n_rows, CLASSES)) if total is None else total
                    _expected(total, features, bias, weights)
        if total is not None:
            lane = TaskContext.get().partitionId() % LANES
            for part in range(0, n_rows, PART_ROWS):
                rows = total[part:part + PART_ROWS].astype(np.int64)
                if rows.any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lane], pa.int32()), pa.array([packed(rows.ravel())], pa.binary())], names=["part", "lane", "data"])
    return each


def _added(group: pa.Table) -> pa.Table:
    total = None
    for data in group["data"]:
        numbers = unpacked(data.as_py())
        total = numbers if total is None else total + numbers
    return pa.table({"part": group["part"].slice(0, 1), "lane": group["lane"].slice(0, 1), "data": pa.array([packed(total)], pa.binary())})


# --- training -------------------------------------------------------------------

def _summed(share: DataFrame, shared, n_rows: int, workers: int) -> np.ndarray:
    """The sums of all tasks, added up in two steps where they are many."""
    schema = "part int, lane int, data binary"
    lanes = share.mapInArrow(lean(_worker(shared)), schema)
    if workers > LANES:
        lanes = lanes.groupBy("part", "lane").applyInArrow(_added, schema)
    got = lanes.groupBy("part").applyInArrow(_added, schema).toArrow()  # one value for PART_ROWS rows
    total = np.zeros((n_rows, CLASSES), np.int64)
    for part, data in zip(got["part"].to_pylist(), got["data"].to_pylist()):
        rows = unpacked(data).reshape(-1, CLASSES)
        total[part:part + len(rows)] = rows
    return total


def train(parts: DataFrame, rounds: int = 1, max_rows: int = MAX_ROWS) -> tuple[Model, DataFrame]:
    """The model after one update and ``rounds`` more, and the counts (word, n)
    of all words of training documents."""
    spark = parts.sparkSession
    counts = cut(parts.select("words", "seen").mapInArrow(lean(_counts), "word string, seen long").groupBy("word").agg(F.sum("seen").alias("n")), "counts")
    ends = parts.agg(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    endings = (counts.groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("known")).orderBy(F.desc("n"), "ending"))
    top = endings.limit(CLASSES - 2).collect()
    whole = endings.agg(F.sum("n").alias("n"), F.sum("known").alias("known")).first()
    words, known = np.zeros(CLASSES), np.zeros(CLASSES)
    words[0], known[0] = ends, ends > 0
    place = {}
    for k, r in enumerate(top):
        place[r["ending"]] = k + 1
        words[k + 1], known[k + 1] = r["n"], r["known"]
    words[-1], known[-1] = (whole["n"] or 0) - words[1:-1].sum(), (whole["known"] or 0) - known[1:-1].sum()
    total = int(words.sum())
    prior = (words + 1) / (total + CLASSES)
    bias = np.log(prior).astype(np.float32)
    n_rows = min(max(LEAST_ROWS, 1 << max(0, (total // ROW_WORDS).bit_length())), max_rows)
    weights = np.zeros((n_rows, CLASSES))
    workers = min(max(spark.sparkContext.defaultParallelism, total // WORKER_WORDS), MOST_WORKERS)
    share = parts.select("train", "sizes", "codes", "words").coalesce(workers)
    if total:
        seen = _summed(share, spark.sparkContext.broadcast((place, n_rows, None, None)), n_rows, workers)
        expected = seen.sum(1, keepdims=True) * prior
        for k in range(rounds + 1):
            weights += RELAX * (np.log(seen + SMOOTH) - np.log(expected + SMOOTH))
            if k < rounds:
                expected = _summed(share, spark.sparkContext.broadcast((place, n_rows, bias, weights.astype(np.float32))), n_rows, workers) / UNIT
    return Model(place, words, known, bias, weights.astype(np.float32), total, int(known.sum()), int(ends)), counts


# --- scoring --------------------------------------------------------------------

def score_block(model: Model, codes: np.ndarray, sizes: np.ndarray, words: pa.Array, count: np.ndarray) -> dict[str, np.ndarray]:
    """Base and model log10 probabilities, tokens and known tokens of each
    document; ``count`` is the training count of each of ``words``."""
    classes, hashes = _coded(words, model.endings)
    stream = _stream(codes, sizes, len(words))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    count = np.r_[count, model.ends].astype(np.float64)
    base = np.log10((count + 1) / (model.train_tokens + model.known + 1))
    of = classes[:-1].astype(np.int64)
    within = np.log10((count + 1) / (model.class_words[of] + model.class_known[of] + 1))
    features = _features(_histories(stream, sizes, len(words)), classes, hashes, len(model.weights))
    gold = classes[stream].astype(np.int64)
    chosen = np.empty(len(stream))
    for a in range(0, len(stream), BATCH):
        x = _logits(model.bias, model.weights, [f[a:a + BATCH] for f in features])
        x -= x.max(1, keepdims=True)
        picked = x[np.arange(len(x)), gold[a:a + len(x)]].astype(np.float64)
        np.exp(x, out=x)
        chosen[a:a + len(x)] = picked - np.log(x.sum(1))
    total = lambda v: np.bincount(owner, v, len(sizes))
    return {"n_tokens": sizes + 1, "n_known": np.rint(total((count > 0)[stream].astype(float))).astype(np.int64),
            "base_score": total(base[stream]), "score": total(within[stream] + chosen / np.log(10))}


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", training=None, rounds: int = 1, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row
    of ``docs``, learned from the rows where ``training`` (a boolean column;
    default: all) is true.  The scores depend on the table alone, not on how it
    is dealt.  ``max_rows`` (a power of two) bounds the rows of weights: with
    more than ``max_rows`` x 64 training words, features share rows more.

    Words are what stands between ASCII white space, A-Z in lower case; every
    document ends with one more token.  A null, empty or blank text is its end
    alone.  Repeated rows are documents of their own; null ids are kept; if
    nothing is learned from, every word is unknown and score and base_score
    are those of empty counts; an empty table gives an empty table."""
    parts = blocks(docs, id, text, F.lit(True) if training is None else training)
    model, counts = train(parts, rounds, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = (parts.select("block", "words").mapInArrow(lean(_words), "spot long, word string").join(counts, "word")
            .select(F.shiftright("spot", PLACE_BITS).alias("block"), F.col("spot").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("place"), "n"))
    kind = parts.schema["ids"].dataType.elementType.simpleString()
    out = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        tables = []
        for k in range(left.num_rows):
            row = left.slice(k, 1).combine_chunks()
            words = unfolded(row.column("words")[0].as_py())
            sizes = np.asarray(row.column("sizes").combine_chunks().flatten()).astype(np.int64)
            count = np.zeros(len(words), np.int64)
            count[np.asarray(right.column("place"))] = np.asarray(right.column("n"))
            got = score_block(shared.value, unsqueezed(row.column("codes")[0].as_py()), sizes, words, count)
            tables.append(pa.table({"id": row.column("ids").combine_chunks().flatten(), "n_tokens": got["n_tokens"], "n_known": got["n_known"],
                                    "train_tokens": np.full(len(sizes), shared.value.train_tokens, np.int64), "base_score": got["base_score"], "score": got["score"]}))
        return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], t) for n, t in zip(
            ("id", "n_tokens", "n_known", "train_tokens", "base_score", "score"), (left.schema.field("ids").type.value_type, *[pa.int64()] * 3, *[pa.float64()] * 2))})

    return (parts.select("block", "ids", "sizes", "codes", "words").groupBy("block").cogroup(held.groupBy("block")).applyInArrow(each, out)
            .withColumnRenamed("id", id))


def held_out(id: str):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 7 == 2, F.lit(False))


def q_op4(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the six folds not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, training=~held_out("doc_id"))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_maxent": q_op4}
