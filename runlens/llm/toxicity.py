"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Known are some toxic texts (P) and any texts (U), not which of U are clean.
With the share of toxic texts among all (the class prior) the risk of a
classifier g on clean texts is its risk on U as if all were clean, less the
prior times its risk on P as if they were; estimated from samples that can
fall below zero, which only overfitting does, so then its gradient is climbed
and not descended.

Features are the terms of a text and the byte strings of 4 to 8 bytes in its
terms (with their ends marked), present or not, hashed to 64 bits.  Strings of
up to 8 bytes are read straight from the bytes of all distinct terms of a few
MB.  Several classifiers learn from all of P and a part of U each, one a task;
their logits are averaged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, bounded_batches, cut, free_name, lean, read
from .words import flat, pieces, terms

SIZES = (4, 5, 6, 7, 8)
BEGIN, END = ord("^"), ord("$")  # no letters, so no term has them
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
STEPS, RATE, SHRINK = 400, 0.05, 1e-3


@dataclass(frozen=True, eq=False)
class Model:
    """Hashes of the features in order, a weight for each, the weight of every
    text, and the share of toxic texts among all."""
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * ODD
    return (x ^ (x >> np.uint64(29))) * ODD


def _hashes(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, hash) of the features of distinct terms, by kind."""
    data, offsets = flat(words)
    size = np.diff(offsets)
    held = np.full(len(data) + 2 * len(size) + 8, END, np.uint8)
    start = offsets[:-1] + 2 * np.arange(len(size))
    held[start] = BEGIN
    owner = np.repeat(np.arange(len(size)), size)
    held[np.arange(len(data)) + 2 * owner + 1] = data
    within = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max(initial=1)), BASE, np.uint64)])
    summed = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[within])]
    yield np.arange(len(size)), _mixed(summed[offsets[1:]] - summed[offsets[:-1]], 1)
    eight = np.zeros(len(held) - 8, np.uint64)
    for k in range(8):
        eight |= held[k:len(held) - 8 + k].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(size)), size + 2)
    left = np.repeat(start + size + 2, size + 2) - np.arange(len(eight))
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        yield owner[at], _mixed(eight[at] & np.uint64((1 << 8 * n) - 1), n)


def present(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every feature of every text, once, in order.
    Features are hashes, or places in ``known`` (sorted hashes), all others
    being left out.  Texts are worked on a few MB at a time, one long text
    too."""
    data, offsets = flat(pc.utf8_lower(texts.fill_null("")))
    if known is not None:
        sieve = np.zeros(1 << 20, bool)
        sieve[known.view(np.uint64) >> np.uint64(44)] = True
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pieces(data, PART_BYTES):
        words, row = terms(data[a:b], np.clip(offsets - a, 0, b - a))
        codes = words.dictionary_encode()
        count = max(len(codes.dictionary), 1)
        row, code = np.divmod(np.unique(row * count + np.asarray(codes.indices)), count)
        word, feature = [], []
        for w, h in _hashes(codes.dictionary):
            if known is not None:
                hit = np.flatnonzero(sieve[h >> np.uint64(44)])
                w, h = w[hit], h[hit].view(np.int64)
                place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                w, h = w[hit], place[hit]
            word.append(w)
            feature.append(h.view(np.int64))
        word, feature = np.concatenate(word), np.concatenate(feature)
        order = np.argsort(word, kind="stable")
        feature = feature[order]
        first = np.searchsorted(word[order], np.arange(count + 1))
        times = np.diff(first)[code]
        ends = np.cumsum(times)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[code] - ends + times, times)
        row, feature = np.repeat(row, times), feature[at]
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
        rows.append(row[new])
        found.append(feature[new])
    row, feature = np.concatenate(rows), np.concatenate(found)
    if len(rows) > 2:
        order = np.lexsort((feature, row))
        row, feature = row[order], feature[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
        row, feature = row[new], feature[new]
    return row, feature


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """What the logits of P and U cost, and the direction to go against for
    each of them.  Log loss; the part for clean texts counts as zero below
    zero, and there its gradient is reversed."""
    clean = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    toxic = prior * np.logaddexp(0, -positive).mean()
    on_p, on_u = _sigmoid(positive) / len(positive), _sigmoid(unlabelled) / len(unlabelled)
    if clean < 0:
        return toxic, prior * on_p, -on_u
    return toxic + clean, -prior / len(positive) * np.ones_like(positive), on_u


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float,
        steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier from the features of the texts of P
    and U; the mean over the later half of the steps."""
    sets = []
    for rows in (positive, unlabelled):
        sets.append((np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), len(rows)))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logits = [np.bincount(row, w[ix], n) + w[-1] for ix, row, n in sets]
        _, *ways = risk(*logits, prior)
        gradient = shrink * np.r_[w[:-1], 0.0]
        for (ix, row, _), way in zip(sets, ways):
            gradient[:-1] += np.bincount(ix, way[row], n_features)
            gradient[-1] += way.sum()
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient ** 2 - square)
        w -= rate * mean / (1 - 0.9 ** step) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        if step > steps // 2:
            total += w
    total /= steps - steps // 2
    return total[:-1], float(total[-1])


def _useful(toxic: np.ndarray, any_: np.ndarray, n_toxic: int, n_any: int, prior: float) -> np.ndarray:
    """How many times likelier a feature is in toxic than in clean texts, from
    its texts in P and in U; half a text at least among the clean ones."""
    p, u = toxic / max(n_toxic, 1), any_ / max(n_any, 1)
    return p / np.maximum((u - prior * p) / (1 - prior), 0.5 / max(n_any, 1))


def _counts(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(feature, n): texts of ``rows`` (column text) that hold each feature."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, n = np.unique(present(batch.column(0), shared.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(n)], names=["feature", "n"])

    return rows.select("text").mapInArrow(lean(each), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None,
          positives: int = 4000, unlabelled: int = 12000, classifiers: int = 3, min_documents: int = 5, min_ratio: float = 2.0,
          features: int = 1 << 14, candidates: int = 1 << 18) -> Model:
    """Learn from the rows of ``docs`` whose key ``labels`` marks 1 (P), and
    from rows whatever their label (U).

    The sample is bounded: about ``positives`` keys marked 1 and about
    ``unlabelled`` rows, drawn by hashes of their keys; both use whole texts.
    Of the ``candidates`` features most frequent in P and in
    ``min_documents`` of its texts, the ``features`` with the largest ratio
    over clean texts, ``min_ratio`` at least, are learned.  ``prior`` is the
    share of keys marked 1 among the labelled ones if not given.  A key with
    several labels has the largest; null keys and labels teach nothing, null
    texts count as empty.  Without any key marked 1 the model has no feature
    and scores everything zero."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = (labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")).where("key is not null and label is not null")
              .groupBy("key").agg(F.max("label").alias("label")))
    known, n_toxic = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    prior = min(max(prior if prior is not None else n_toxic / known, 1e-4), 1 - 1e-4)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("key is not null")
    total = rows.count()

    def drawn(salt: str, wanted: int, of: int) -> Column:
        return F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, wanted / max(of, 1)) * (1 << 30))

    toxic = marked.where("label = 1").where(drawn("toxic", positives, n_toxic)).select("key", F.lit(True).alias("toxic"))
    sample = cut(rows.join(F.broadcast(toxic), "key", "left").withColumn("any", drawn("any", unlabelled, total))
                 .where("toxic or any").select("key", "text", F.coalesce("toxic", F.lit(False)).alias("toxic"), "any"), "sample")
    n_toxic, n_any = sample.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("any").cast("long")), F.lit(0))).first()
    if not n_toxic or not n_any:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    in_toxic = (_counts(sample.where("toxic")).where(F.col("n") >= min_documents).orderBy(F.desc("n"), "feature").limit(candidates)
                .toArrow().sort_by("feature"))
    keys = np.asarray(in_toxic["feature"])
    seen = _counts(sample.where("any"), keys).toArrow()
    in_any = np.zeros(len(keys), np.int64)
    in_any[np.asarray(seen["feature"])] = np.asarray(seen["n"])
    ratio = _useful(np.asarray(in_toxic["n"]), in_any, n_toxic, n_any, prior)
    best = np.lexsort((keys, -np.asarray(in_toxic["n"]), -ratio))[:features]
    keys = np.sort(keys[best[ratio[best] >= min_ratio]])
    shared = spark.sparkContext.broadcast(keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = present(batch.column(2), shared.value)
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(starts), pa.array(feature))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), held], names=["draw", "toxic", "any", "features"])

    held = (sample.select(F.xxhash64("key", "text").alias("draw"), "toxic", "text", "any").mapInArrow(lean(each), "draw long, toxic boolean, any boolean, features array<long>"))
    part = F.pmod(F.xxhash64("draw"), F.lit(classifiers))
    turns = F.when(F.col("toxic"), F.sequence(F.lit(0), F.lit(classifiers - 1)).cast("array<long>")).otherwise(F.array(part))
    dealt = held.withColumn("part", part).withColumn("classifier", F.explode(turns)).withColumn("any", F.col("any") & (F.col("classifier") == F.col("part"))).drop("part")

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("draw")
        texts = [np.asarray(x, np.int64) for x in group["features"].to_pylist()]
        pick = lambda flags: [x for x, f in zip(texts, flags) if f]
        p, u = pick(group["toxic"].to_pylist()), pick(group["any"].to_pylist())
        if not p or not u:
            return pa.table({"weights": pa.array([], pa.list_(pa.float64())), "bias": pa.array([], pa.float64())})
        weights, bias = fit(p, u, len(shared.value), prior)
        return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "bias": [bias]})

    learned = dealt.groupBy("classifier").applyInArrow(learn, "weights array<double>, bias double").orderBy("bias").collect()
    if not learned:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)
    return Model(keys, np.mean([r["weights"] for r in learned], axis=0), float(np.mean([r["bias"] for r in learned])), prior)


def scored_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """The chance that each text is toxic."""
    if not model.prior:
        return np.zeros(len(texts))
    row, feature = present(texts, model.features)
    return _sigmoid(np.bincount(row, model.weights[feature] if len(feature) else None, len(texts)) + model.bias)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "toxicity") -> DataFrame:
    """``docs`` with ``to`` (double, 0 to 1).  Null, empty and letterless
    texts get what the model gives a text without features; equal texts get
    equal scores; an empty table gives an empty table; if ``docs`` has a
    column named ``to``, the new one gets underscores appended."""
    bounded_batches(docs.sparkSession)
    to = free_name(docs.columns, to)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scored_texts(shared.value, batch.column(at)))], names=[*batch.schema.names, to])

    return docs.mapInArrow(lean(each), docs.withColumn(to, F.lit(0.0)).schema)


def held_out(key: str) -> Column:
    """Rows that no label is learned from; a null key is one of them."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def q_op11(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    out = score(docs.select("doc_id", "text"), model, to="score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": q_op11}
