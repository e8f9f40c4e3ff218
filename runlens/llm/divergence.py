"""How far the sources of a language differ in their words, exactly.

Terms are counted by task and summed by shuffle.  Of each language the terms of
enough documents are kept; with a count of every source each is a row of a
matrix whose columns are the sources.  Terms with equal rows are one row with a
length.  A language's rows are dealt into blocks; in a block they are sorted
row by row, the largest source first, so that equal counts lie together, and
every column is run-length encoded.  Two columns are compared at the union of
their run boundaries only: the difference of the two shares, times the length
of the run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_BYTES, bounded_batches, cut, lean, parts, read
from .words import flat, pieces, terms

MIN_DOCUMENTS, TOP = 30, 50
UNIT, PRIOR = 1_000_000_000, 5  # shares are in parts of UNIT, counts are raised by PRIOR
BLOCK, LEAST, CELLS = 4096, 512, 1 << 22  # rows of a block: at most, at least, and times its sources


def _long(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms of one text of any length and how often each occurs."""
    data, _ = flat(text)
    got = []
    for a, b in pieces(data, 2 * PART_BYTES):
        found, _ = terms(data[a:b], np.array([0, b - a]))
        counts = found.value_counts()
        got.append(pa.table({"term": counts.field("values"), "n": counts.field("counts")}))
        if len(got) > 8:
            got = [pa.concat_tables(got).group_by("term").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
    whole = pa.concat_tables(got).group_by("term").aggregate([("n", "sum")]).combine_chunks()
    return pa.concat_arrays(whole["term"].chunks or [pa.array([], pa.large_string())]), np.asarray(whole["n_sum"])


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents."""
    if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > 4 * PART_BYTES:
        words, n = _long(texts)
        same = lambda a: a.take(pa.array(np.zeros(len(words), np.int64)))
        return pa.RecordBatch.from_arrays([same(langs), same(sources), words.cast(pa.string()), pa.array(n, pa.int64()), pa.array(np.ones(len(words), np.int64))],
                                          names=["lang", "source", "term", "n", "docs"])
    found, row = terms(*flat(texts))
    codes = found.dictionary_encode()
    code, words = np.asarray(codes.indices).astype(np.int64), codes.dictionary
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
    each, times = np.unique(row * max(len(words), 1) + code, return_counts=True)
    row, code = np.divmod(each, max(len(words), 1))
    each, back = np.unique(group[row] * max(len(words), 1) + code, return_inverse=True)
    group, code = np.divmod(each, max(len(words), 1))
    n = np.bincount(back, times, len(each)).astype(np.int64)
    docs = np.bincount(back, minlength=len(each)).astype(np.int64)
    at_lang, at_source = np.divmod(group, max(len(source.dictionary), 1))
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(at_lang)), source.dictionary.take(pa.array(at_source)),
         words.take(pa.array(code)).cast(pa.string()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each source
    of each language, and documents that hold it.  ``docs`` has lang, source
    and text without nulls.  A task counts the documents of a few MB at a
    time, so what it hands on is combined already."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts(batch.column(2), 2 * PART_BYTES):
                yield _counted(batch.column(0).slice(done, len(part)), batch.column(1).slice(done, len(part)), part)
                done += len(part)

    counted = docs.select("lang", "source", "text").mapInArrow(lean(each), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(UNIT).cast("decimal(11,0)") * wide(n + PRIOR), wide(total + PRIOR * kept))
    return whole.cast("long") + 1


def _shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """``share`` of a column, once for each count that occurs."""
    values, back = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (v + PRIOR) // (total + PRIOR * kept) for v in values.tolist()], np.int64)[back]


def _block(lang, vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, value): what a block adds to every pair of sources."""
    names, totals, kept = groups["source"].to_pylist(), groups["total"].to_pylist(), groups["kept"].to_pylist()
    by = sorted(range(len(names)), key=lambda k: (-totals[k], names[k].encode()))
    names, totals, kept = [names[k] for k in by], [totals[k] for k in by], [kept[k] for k in by]
    column = {s: k for k, s in enumerate(names)}
    cells = vectors["cells"].combine_chunks()
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], cells.type)
    flat = cells.flatten()
    matrix = np.zeros((len(cells), len(names)), np.int64)
    row = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()).astype(np.int64))
    source = flat.field("source").dictionary_encode()
    place = np.array([column[s] for s in source.dictionary.to_pylist()], np.int64)
    matrix[row, place[np.asarray(source.indices)]] = np.asarray(flat.field("n"))
    order = np.lexsort(matrix.T[::-1]) if len(matrix) else np.zeros(0, np.int64)
    matrix = matrix[order]
    length = np.r_[0, np.cumsum(np.asarray(vectors["length"].combine_chunks())[order], dtype=np.int64)]
    change = np.ones_like(matrix, bool).T.copy()
    change[:, 1:] = (matrix[1:] != matrix[:-1]).T
    shares = [_shares(matrix[:, k], totals[k], kept[k]) if len(matrix) else np.zeros(0, np.int64) for k in range(len(names))]
    first, second, value = [], [], []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            run = np.flatnonzero(change[a] | change[b])
            size = np.diff(np.r_[length[run], length[-1]])
            first.append(names[a])
            second.append(names[b])
            value.append(int(np.abs(shares[a][run] - shares[b][run]) @ size))
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "a": pa.array(first, pa.string()),
                     "b": pa.array(second, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               min_documents: int = MIN_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language
    its distance to each other source of it (part ``pair``) and the ``top``
    terms it uses beyond the language as a whole (part ``term``).

    A language's terms in at least ``min_documents`` of its rows are kept; a
    share is 1 + floor(10^9 (n + 5) / (N + 5 V)) for n occurrences among N of
    kept terms, V terms being kept.  A pair's value is the sum over all kept
    terms of the absolute difference of the two shares, 0 if none is kept.  A
    term's value is what its share in the source exceeds that in the language
    by; only terms that occur there and do exceed it are listed.  Ranks go by
    value, then item.

    Null lang, source and text are empty strings; repeated rows are documents
    of their own; a source alone in its language has no pairs; an empty table
    gives an empty table.  Other columns of ``docs`` are not looked at.
    ``block`` bounds the rows a task holds at a time (less where a language has
    many sources), not what is counted."""
    as_text = lambda c, to: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to)
    rows = docs.select(as_text(lang, "lang"), as_text(source, "source"), as_text(text, "text"))
    found = term_counts(rows).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    vocabulary = cut(found.where(F.col("docs") >= min_documents).select("lang", "term", "n", F.array_sort("cells").alias("cells")), "terms")

    occurs = vocabulary.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = cut(rows.select("lang", "source").distinct().join(occurs, ["lang", "source"], "left").join(langs, "lang", "left")
                 .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")]), "groups")

    vectors = cut(vocabulary.groupBy("lang", "cells").agg(F.count("*").alias("length")), "vectors")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("columns")).join(vectors.groupBy("lang").agg(F.count("*").alias("rows")), "lang", "left")
    held = F.least(F.lit(block), F.greatest(F.lit(CELLS) / F.col("columns"), F.lit(LEAST)))
    blocks = cut(sizes.select("lang", F.greatest(F.ceil(F.coalesce("rows", F.lit(0)) / held), F.lit(1)).cast("long").alias("blocks")), "blocks")
    dealt = vectors.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("cells"), F.col("blocks")).alias("block"), "cells", "length")
    held = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    added = (dealt.groupBy("lang", "block").cogroup(held.groupBy("lang", "block"))
             .applyInArrow(lambda key, left, right: _block(key[0].as_py(), left, right), "lang string, a string, b string, value long"))
    pairs = added.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    p, q = share(F.col("c.n"), F.col("total"), F.col("kept")), share(F.col("n"), F.col("lang_total"), F.col("kept"))
    own = (vocabulary.select("lang", "term", "n", F.explode("cells").alias("c")).withColumn("source", F.col("c.source")).join(groups, ["lang", "source"])
           .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(both, "pair").unionByName(ranked(own, "term").where(F.col("rank") <= top))


def q_op13(spark, sf_dir: str) -> DataFrame:
    """How the sources of all documents differ within each language."""
    return divergence(read(spark, sf_dir, "documents"))


ORACLE = {"op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.n + {PRIOR} * l.v) AS p,
             1 + ({UNIT}::HUGEINT * (k.n + {PRIOR})) // (l.n + {PRIOR} * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM x QUALIFY part = 'pair' OR rank <= {TOP}"""}
QUERIES = {"op13_divergence": q_op13}
