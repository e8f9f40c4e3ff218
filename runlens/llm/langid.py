"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text.
A text is parsed greedily into the longest phrases that occur in a language's
sample: m phrases against a sample of n characters cost m log2(n) bits, and
the language with the fewest bits a character wins.

Texts are read as lower-case letters with every run of other characters as
one space, and cut at fixed steps of ``SPAN`` characters, so that many pieces
of many texts advance through one transition table at once in numpy.

Every letter of the samples is a symbol of its own.  A language's table has
the symbols of its own sample and one for all it lacks, on which no phrase
goes on.  With more than ``DENSE`` symbols (Chinese, Japanese, Korean) only
the transitions there are stand in the table, in order of state and symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, lean, parts, read

SPAN = 512
DENSE = 64  # symbols of a sample up to which its transitions are a full table
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Labelled sample text of each language, languages in order of name."""
    samples: tuple[tuple[str, str], ...]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id",
          chars_per_language: int = 30_000, total_chars: int = 400_000, piece_chars: int = 600,
          pieces_per_language: int = 300, max_languages: int = 400) -> LanguageModel:
    """A bounded sample of the labelled rows of ``docs``: at most
    ``pieces_per_language`` rows or so of each language, drawn by a hash of
    ``order``, give one piece of at most ``piece_chars`` characters each;
    equal pieces count once, up to ``chars_per_language`` characters (less if
    ``total_chars`` divided by the number of languages is less).  The
    ``max_languages`` most frequent labels are learned.  Rows with a null label
    or text teach nothing."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.col(f"`{order}`").cast("string").alias("order")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    seen = {r["lang"]: r["count"] for r in sizes.collect()}
    if not seen:
        return LanguageModel(())
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, pieces_per_language / n)) for k, n in seen.items()], "lang string, share double")
    draw = F.xxhash64("order", F.lit("draw"))
    room = F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1
    pieces = (rows.join(F.broadcast(shares), "lang")
              .where(F.pmod(draw, F.lit(1 << 30)) < F.col("share") * (1 << 30))
              .select("lang", draw.alias("draw"), F.col("text").substr(F.pmod(F.xxhash64("order", F.lit("from")), room).cast("int") + 1, F.lit(piece_chars)).alias("piece")))
    most = min(chars_per_language, total_chars // len(seen))
    chosen: dict[str, dict[str, None]] = {}
    size: dict[str, int] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["draw"], r["piece"])):
        got = chosen.setdefault(r["lang"], {})
        if r["piece"] not in got and size.get(r["lang"], 0) + len(r["piece"]) <= most:
            got[r["piece"]] = None
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["piece"])
    samples = tuple((k, "\n".join(chosen[k])) for k in sorted(chosen) if any(map(str.isalpha, "".join(chosen[k]))))
    return LanguageModel(samples)


@dataclass(frozen=True)
class _Parser:
    """The suffix automaton of a sample.  ``local`` has the sample's own number
    of each symbol, ``width`` - 1 for those it lacks; a state is ``width``
    times its number, and ``start`` is where no phrase is open.  An entry is
    twice the next state, plus one where a new phrase starts.  If ``keys`` is
    None ``entries`` has one for every state + symbol; else ``keys`` has the
    sums from which a phrase goes on, in order, and ``fresh`` the entry of
    each symbol for all others."""
    local: np.ndarray
    width: int
    start: int
    size: int
    entries: np.ndarray
    keys: np.ndarray | None
    fresh: np.ndarray

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = state + symbols
        if self.keys is None:
            return self.entries[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.entries[at], self.fresh[symbols])


def _parser(symbols: list[int], n_symbols: int) -> _Parser:
    """The parser of a sample of symbols under ``n_symbols``."""
    own = sorted(set(symbols))
    width = len(own) + 1
    local = np.full(n_symbols, len(own), np.int64)
    local[own] = np.arange(len(own))
    symbols = local[symbols].tolist()
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    between = len(go)  # after a symbol that the sample lacks, and at the start
    keys = np.array([s * width + c for s, out in enumerate(go) for c in sorted(out)], np.int64)
    entries = np.array([out[c] * width * 2 for out in go for c in sorted(out)], np.int64)
    fresh = np.full(width, between * width * 2, np.int64)
    fresh[keys[keys < width]] = entries[keys < width]
    fresh += 1
    if width > DENSE:  # the last key is larger than any state + symbol
        return _Parser(local, width, between * width, len(symbols), np.r_[entries, 0], np.r_[keys, (between + 1) * width], fresh)
    table = np.tile(fresh.astype(np.int32), between + 1)
    table[keys] = entries
    return _Parser(local.astype(np.int32), width, between * width, len(symbols), table, None, fresh)


@lru_cache(maxsize=1)
def _parsers(model: LanguageModel):
    """(symbol of each code point, parser of each language).  Symbol 0 is all
    that is no letter, 1 every letter that no sample has."""
    code = np.zeros(0x110000, np.int32)
    for start in range(0, 0x110000, 0x10000):
        code[start:start + 0x10000] = [1 if chr(c).isalpha() else 0 for c in range(start, start + 0x10000)]
    letters = sorted({c for _, sample in model.samples for c in sample.lower() if c.isalpha()})
    code[list(map(ord, letters))] = np.arange(len(letters)) + 2
    return code, [_parser(_symbols(code, [sample])[0].tolist(), len(letters) + 2) for _, sample in model.samples]


def _symbols(code: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, runs of non-letters as one 0, and where
    each text ends."""
    flat = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(x) for x in flat])
    all_ = code[np.concatenate(flat)] if flat else np.zeros(0, np.int32)
    keep = all_ > 0
    keep[1:] |= all_[:-1] > 0
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    inside = starts[starts < len(all_)]
    keep[inside] = all_[inside] > 0  # no space before a text's first letter
    kept = np.r_[0, np.cumsum(keep)]
    return all_[keep], kept[ends] if len(ends) else ends


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text.  Confidence is 1 - best / second
    best cost (0 where nothing is known or two languages tie, 1 where only one
    language was learned).  Ties go to the first language by name."""
    if not model.samples or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    code, parsers = _parsers(model)
    symbols, ends = _symbols(code, [t or "" for t in texts])
    size = np.diff(np.r_[0, ends])
    pieces = -(-size // SPAN)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (ends - size)[owner] + nth * SPAN
    length = np.minimum(SPAN, size[owner] - nth * SPAN)
    by = np.argsort(-length, kind="stable")
    owner, start, length = owner[by], start[by], length[by]
    active = np.searchsorted(-length, -np.arange(SPAN), side="left") if len(length) else np.zeros(SPAN, np.int64)
    bits = np.zeros((len(parsers), len(texts)))
    for k, parser in enumerate(parsers):
        own = parser.local[symbols]
        state = np.full(len(start), parser.start, own.dtype)
        phrases = np.zeros(len(start), np.int32)
        for step in range(int(length[0]) if len(length) else 0):
            m = active[step]
            got = parser.step(state[:m], own[start[:m] + step])
            phrases[:m] += (got & 1).astype(np.int32)
            state[:m] = got >> 1
        bits[k] = np.bincount(owner, phrases, len(texts)) * np.log2(max(parser.size, 2))
    known = np.bincount(owner, minlength=len(texts)) > 0
    best = bits.argmin(0)
    ranked = np.sort(bits, axis=0)
    second = ranked[1] if len(parsers) > 1 else np.full(len(texts), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(known, 1 - ranked[0] / second, 0.0)
    return [model.samples[b][0] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())], np.clip(score, 0, 1)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", to: str = "lang_pred", score: str = "score", letter: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its confidence, and, if
    ``letter`` is given, a column of that name that tells whether the text has
    a letter, whatever the model has learned.

    Only the text is looked at, and all of it.  A null text or one without a
    letter is ``und`` with score 0; so is every text if the model has learned
    nothing.  Repeated rows get the same answer; an empty table gives an empty
    table.  If ``docs`` has columns named like the new ones, the new ones get
    underscores appended."""
    bounded_batches(docs.sparkSession)
    to, score = free_name(docs.columns, to), free_name(docs.columns, score)
    out = docs.withColumn(to, F.lit("")).withColumn(score, F.lit(0.0))
    if letter:
        letter = free_name(out.columns, letter)
        out = out.withColumn(letter, F.lit(True))
    out = out.schema
    at = docs.columns.index(text)
    names = out.names
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lettered = [], []
            for part in parts(batch.column(at)):
                texts = part.to_pylist()
                found.append(score_texts(shipped.value, texts))
                lettered += [any(map(str.isalpha, t or "")) for t in texts] if letter else []
            langs = pa.array([x for langs, _ in found for x in langs], pa.string())
            sure = pa.array(np.concatenate([s for _, s in found]) if found else [], pa.float64())
            has = [pa.array(lettered, pa.bool_())] if letter else []
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, sure, *has], names=names)

    return docs.mapInArrow(lean(each), out)


def held_out(id: str):
    return F.crc32(F.col(id).cast("string")) % 4 == 2


def accepted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", relabel: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has a language: texts that are null or
    have no letter go, all others stay as they are, also where no row has a
    label or ``und`` is one of the labels.  With ``relabel`` their ``lang`` is the
    predicted language."""
    model = train(docs, lang, text, id)
    letter, found = free_name(docs.columns, "has_letter"), free_name(docs.columns, "lang_pred")
    kept = identify(docs, model, text, to=found, letter=letter).where(F.col(letter))
    new = F.col(found).cast(docs.schema[lang].dataType).alias(lang)
    return kept.select(*[new if relabel and c == lang else F.col(f"`{c}`") for c in docs.columns])


def q_op3(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three folds not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~F.coalesce(held_out("doc_id"), F.lit(False))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language": q_op3}
