"""Fill-in-the-middle by word-parallel search in UTF-8.

A text is cut at two drawn code points into prefix, middle and suffix, which
are written out of order behind marks.  Where a code point ends in bytes is
found without decoding.  The bytes of many texts are viewed as 64-bit words;
in each word the bytes that end a code point (the next byte does not continue
one) are marked by shifts and masks, counted by ``bitwise_count`` and summed
up.  The k-th code point lies in the word found by a search in those sums; in
the word one multiplication gives the running count at every byte, and one
addition tells how many bytes come before the k-th mark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, lean, parts, read
from .words import flat

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # percent, of the third and the fourth draw
ONES = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)
FIM = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


class Units:
    """The code points of many UTF-8 texts that lie one behind the other:
    ``offsets`` (from 0) in ``data``.  A stray continuation byte belongs to the
    code point before it, at a text's start it is part of the first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        room = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
        room[:len(data)] = data
        words = room.view("<u8")
        starts = (~words | (words << np.uint64(1))) & TOPS
        ends = starts >> np.uint64(8)
        ends[:-1] |= starts[1:] << np.uint64(56)
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends.view(np.uint8)[last] |= 0x80
        self.ends = ends
        self.upto = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
        before = self.rank(offsets)
        self.before, self.sizes = before[:-1], np.diff(before)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end in the bytes before each of ``at``."""
        word = at >> 3
        below = (np.uint64(1) << (at & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        whole = np.r_[np.int64(0), self.upto][word]
        return whole + np.bitwise_count(self.ends[word] & below)

    def byte_after(self, k: np.ndarray) -> np.ndarray:
        """For each text the byte offset behind its first ``k`` code points."""
        target = self.before + np.maximum(k, 1)
        word = np.minimum(np.searchsorted(self.upto, target), len(self.ends) - 1)
        mark = self.ends[word]
        nth = (target - self.upto[word] + np.bitwise_count(mark)).astype(np.uint64)
        running = (mark >> np.uint64(7)) * ONES
        reached = (running + (np.uint64(128) - nth) * ONES) & TOPS
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), self.offsets[:-1])


def draws(key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of ``key``."""
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def _formed(part: pa.Array, keys: list[str], plain_from: int, spm_below: int) -> pa.StructArray:
    data, offsets = flat(part)
    units = Units(data, offsets)
    h = np.array([draws(k) for k in keys], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (units.sizes + 1), h[:, 1] % (units.sizes + 1)
    one, two = np.minimum(one, two), np.maximum(one, two)
    cuts = zip(offsets.tolist(), units.byte_after(one).tolist(), units.byte_after(two).tolist(), offsets[1:].tolist())
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    forms, outputs = [], []
    for (a, b, c, d), third, fourth in zip(cuts, (h[:, 2] % 100).tolist(), (h[:, 3] % 100).tolist()):
        text = data[a:d].tobytes()
        if not text or p in text or s in text or m in text or third >= plain_from:
            forms.append("plain")
            outputs.append(text)
            continue
        head, middle, tail = text[:b - a], text[b - a:c - a], text[c - a:]
        spm = fourth < spm_below
        forms.append("spm" if spm else "psm")
        outputs.append(b"".join([s, tail, p, head, m, middle] if spm else [p, head, s, tail, m, middle]))
    forms = np.array(forms, object)
    plain = forms == "plain"
    return pa.StructArray.from_arrays(
        [pa.array(units.sizes), pa.array(forms, pa.string()), pa.array(one, mask=plain), pa.array(two - one, mask=plain),
         pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)], ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", to: str = "fim", seed: int = 1,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with ``to`` struct<n, form, prefix_chars, middle_chars, output>:
    code points of the text; plain, psm (prefix, suffix, middle) or spm (suffix,
    prefix, middle); lengths in code points, null if plain; the written form.

    All draws come from the seed and the row's key (a null key: empty), so
    equal rows get equal forms and a rerun changes nothing.  Empty and null
    texts and texts that hold a mark stay plain (null as empty).  An empty
    table gives an empty table; if ``docs`` has a column named ``to``, the new
    one gets underscores appended."""
    bounded_batches(docs.sparkSession)
    to = free_name(docs.columns, to)
    keyed = free_name([*docs.columns, to], "fim_key")
    rows = docs.withColumn(keyed, F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts(batch.column(at)):
                rows = batch.slice(done, len(part))
                done += len(part)
                formed = _formed(part, rows.column(rows.num_columns - 1).to_pylist(), plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], formed], names=[*rows.schema.names[:-1], to])

    return rows.mapInArrow(lean(each), docs.withColumn(to, F.lit(None).cast(FIM)).schema)


def restored(fim: str = "fim") -> Column:
    """The text of a row, read back from its form and output alone.  No part
    holds a mark and a mark cannot overlap another, so the first one met is
    the one written."""
    output = F.col(f"`{fim}`")["output"]

    def upto(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def behind(text: Column, head: Column) -> Column:
        return text.substr(F.length(head) + len(PREFIX) + 1, F.length(text))

    body = output.substr(F.lit(len(PREFIX) + 1), F.length(output))
    spm = F.col(f"`{fim}`")["form"] == "spm"
    first = F.when(spm, upto(body, PREFIX)).otherwise(upto(body, SUFFIX))
    rest = behind(body, first)
    second = upto(rest, MIDDLE)
    middle = behind(rest, second)
    return (F.when(F.col(f"`{fim}`")["form"] == "plain", output)
            .when(spm, F.concat(second, middle, first)).otherwise(F.concat(first, middle, second)))


def q_op12(spark, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-the-middle form."""
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE = {"op12_fim": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, n, ('0x' || h[1:8])::UBIGINT % (n + 1) AS a, ('0x' || h[9:16])::UBIGINT % (n + 1) AS b,
             ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS e FROM d),
y AS (SELECT doc_id, t, n, least(a, b)::BIGINT AS lo, greatest(a, b)::BIGINT AS hi,
             CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR c >= {PLAIN_FROM} THEN 'plain'
                  WHEN e < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM z"""}
QUERIES = {"op12_fim": q_op12}
