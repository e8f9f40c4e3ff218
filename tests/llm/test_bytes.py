"""Suffix-array deduplication, chat formatting, packing and the pipeline."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from runlens.llm import chat, packing, substring
from runlens.llm.common import read

from . import brute
from .conftest import SF


def kept_of(df, **options):
    return {r["doc_id"]: (bytes(r["kept"]), [(s["start"], s["end"]) for s in r["removed"]]) for r in substring.dedup_substrings(df, **options).collect()}


@pytest.mark.parametrize("block", [substring.BLOCK, 3])
def test_substrings_against_brute_force(spark, rows, block):
    docs = rows("documents", "doc_id, text", "doc_id")
    line = "A line of boilerplate text that many documents hold, and which is of some hundred and twenty bytes or so, é."
    docs = docs[:80] + [(1000 + i, f"{i} own start {i * 7919} " + line + f" own end {i * 104729}") for i in range(12)] + [(2000, "ab" * 400), (2001, "x" * 99), (2002, "x" * 99), (2003, None), (2004, ""), (2005, "ab" * 300 + line)]
    docs += [(3000, docs[3][1]), (3001, docs[3][1])]
    assert kept_of(spark.createDataFrame(docs, "doc_id long, text string"), block=block) == brute.uncovered(docs)


@pytest.mark.parametrize("length", [16, 40, 256])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9))) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    docs += [(100 + i, docs[i][1][5:] + docs[i + 1][1]) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert kept_of(df, length=length) == brute.uncovered(docs, length)


def test_long_texts_go_over_chunks():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3 * substring.CHUNK, dtype=np.uint8)
    offsets = np.array([0, 1000, 1050, len(data)])
    bucket, doc, start, gram, windows = substring.segments(offsets, data, 100)
    per = {d: int(windows[doc == d].sum()) for d in range(3)}
    assert per == {0: 901, 1: 0, 2: len(data) - 1050 - 99}
    assert ((gram >= 0) & (gram <= 68) & (windows <= 69)).all()


def test_hash_collisions_are_compared(monkeypatch):
    data = np.frombuffer(b"".join(bytes([c]) * 100 for c in (1, 2, 1, 3)), np.uint8)
    monkeypatch.setattr(substring, "grams", lambda d, q: np.zeros(len(d) - q + 1, np.uint64))
    got = substring.equal_windows(data, np.array([0, 100, 200, 300]), 100)
    assert got[0] == got[2] and len({got[0], got[1], got[3]}) == 3


def test_substrings_awkward_rows(spark, odd_docs):
    got = substring.dedup_substrings(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert bytes(by[2]["kept"]) == b"" and by[1]["removed"] != by[2]["removed"] and bytes(by[7]["kept"]) == b"x"
    assert by[5]["n_bytes"] == 0 and len(by[8]["kept"]) < 300
    assert substring.dedup_substrings(odd_docs.where("false")).collect() == []
    same = spark.createDataFrame([(1, "q" * 150), (1, "r" * 150), (None, "q" * 150), (None, "q" * 150)], "doc_id long, text string")
    lens = sorted((r["doc_id"] or 0, len(r["kept"])) for r in substring.dedup_substrings(same).collect())
    assert [d for d, _ in lens] == [0, 0, 1, 1] and lens[0][1] == lens[1][1] == 0 and all(n == 1 for _, n in lens[2:])  # a repeated byte stays once


def conversations(spark):
    said = "a \\e b <|im_end|> <\\p|x \\n\n<|im_start|>assistant no"
    return {1: [("user", said), ("assistant", "ok \\ \\\\ <|<|"), ("assistant", "")], 2: [("assistant", "é😀"), ("we\nird", "x")], 3: [("user", "")]}


def test_round_trip(spark):
    talks = conversations(spark)
    flat = spark.createDataFrame([(i, k, r, t) for i, turns in talks.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    back = chat.read_back(chat.format_chat([(flat, "conv_id")])).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back} == talks
    for r in back:
        mine = [t for who, t in talks[r["conv_id"]] if who == "assistant"]
        assert r["learned"] == "".join(mine) and len(r["loss"]) == len(mine)
        for s, t in zip(r["loss"], mine):
            cut = r["formatted"][s["start"] - 1:s["start"] - 1 + s["length"]]
            assert cut.replace("\\p", "|").replace("\\e", "\\") == t


def test_layouts(spark):
    rows = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}]
    bad = ["", "not json", "{}", json.dumps({"other": 1}), None]
    df = spark.createDataFrame([(i, json.dumps(r), 1) for i, r in enumerate(rows)] + [(100 + i, b, 2) for i, b in enumerate(bad)], "conv_id long, body string, parsed int")
    good, other = chat.turns_of_json(df, "conv_id", "body")
    got = {}
    for r in good.orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {i: [("user", "q"), ("assistant", "a")] for i in range(len(rows))}
    assert sorted(r["conv_id"] for r in other.collect()) == [100, 101, 102, 103, 104] and other.columns == df.columns
    for r in rows:
        table = spark.read.json(spark.createDataFrame([(json.dumps(r | {"conv_id": 1, "extra": 2}),)], "value string").rdd.map(lambda x: x[0]))
        assert [(t["role"], t["text"]) for t in chat.turns(table, "conv_id").orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.turns(spark.range(1), "id")


def test_chat_awkward_rows(spark):
    flat = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "first"), (None, 0, "user", "x"), (2, 1, "assistant", "y" * 100_000)], "conv_id long, turn int, role string, text string")
    flat = flat.selectExpr("*", "1 AS head", "2 AS body", "3 AS turns", "4 AS formatted")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chat([(flat, "conv_id")])).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("assistant", "first"), ("", ""), ("", "")]
    assert set(back) == {1, 2, None} and back[1]["learned"] == "first" and len(back[2]["learned"]) == 100_000
    assert chat.read_back(chat.format_chat([(flat.where("false"), "conv_id")])).collect() == []
    plan = chat.format_chat([(flat, "conv_id")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_encoder_matches_the_tokenizer(rows):
    import pyarrow as pa
    model = packing.SpacedEncoder(packing.tokenizer_path())
    texts = [t for _, t in rows("documents", "doc_id, text", "doc_id")][:60]
    texts += ["", " ", "  a  b", "a \n b", "x\n\ny z ", None, "é  ü", "a  b 　c", "don't  we'll I've", "<|endoftext|> a <|endoftext|>b", "tab\t tab", " lead", "a" * 300 + " " + "b " * 50, "\x1c x \x1c", "漢字 😀 ok"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(" \n\tab,.'12é漢\u00a0") for _ in range(60)) for _ in range(300)]
    for t, got in zip(texts, model.encode(pa.array(texts))):
        assert got.tolist() == model.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(0, 30))}
        packs = packing.patterns(histogram, 64)
        held = {}
        for count, lengths in packs:
            assert count > 0 and sum(lengths) <= 64
            for x in lengths:
                held[x] = held.get(x, 0) + count
        assert held == histogram
        total = sum(c for c, _ in packs)
        # a pack is opened only if none has room: all but one are over half full
        assert sum(c for c, x in packs if sum(x) * 2 <= 64) <= 1 and total >= 0


@pytest.mark.parametrize("bucket", [packing.BUCKET_PIECES, 7])
def test_packing(spark, rows, odd_docs, monkeypatch, bucket):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "BUCKET_PIECES", bucket)
    model = Tokenizer.from_file(packing.tokenizer_path())
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + i, t) for i, t in rows("documents", "doc_id, text", "doc_id")]
    df = odd_docs.select("doc_id", "text", "rank", "bucket").unionByName(spark.createDataFrame(docs[odd_docs.count():], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(df).collect()
    ids = sorted(tuple([*model.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in docs)
    parts, spots = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 1024
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in spots.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(x) for x in ids) == sum(r["length"] for r in got)
    for i, t in docs[odd_docs.count():]:
        whole = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for _, p in sorted(parts[(i, len(whole))]) for x in p] == whole
    padding = sum(1024 - sum(n for _, n in f) for f in spots.values())
    assert padding <= 0.05 * sum(len(x) for x in ids) + 1024
    rows_ = packing.sequences(packing.pack(df)).collect()
    assert len(rows_) == len(spots) and sum(len(r["ids"]) for r in rows_) == sum(len(x) for x in ids)
    assert packing.pack(df.where("false")).collect() == []


def test_pipeline_stages(spark, odd_docs):
    """Every stage keeps the columns, also on awkward rows and empty tables."""
    for docs in (odd_docs, odd_docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd_docs.columns, name
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns


def test_pipeline_against_brute_force(spark, rows):
    from tokenizers import Tokenizer
    docs = rows("documents", "doc_id, text, source", "doc_id")
    items = rows("benchmark", "item_id, text", "item_id")
    docs = [(i, t, s) for i, t, s in docs if t and any(c.isalpha() for c in t)]
    pages, held = {}, {}
    for i, t, s in docs:
        pages[s] = pages.get(s, 0) + 1
        for x in set(t.split("\n")):
            if x.strip(" "):
                held[s, x] = held.get((s, x), 0) + 1
    bad = {k for k, n in held.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    docs = [(i, "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for i, t, s in docs]
    keep = brute.simhash_components(docs)
    docs = [(i, t) for i, t in docs if keep[i][1] == i]
    model = Tokenizer.from_file(packing.tokenizer_path())
    expect = {}
    for i, t in docs:
        w, hit, _ = brute.contamination(t, items)
        if sum(hit) <= 0.8 * len(w):
            if any(hit):
                spans = [m.span() for m in __import__("re").finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
                out, at, k = [], 0, 0
                while k < len(w):
                    if hit[k]:
                        e = k
                        while e < len(w) and hit[e]:
                            e += 1
                        out.append(t[at:spans[k][0]])
                        at, k = spans[e - 1][1], e
                    else:
                        k += 1
                t = "".join([*out, t[at:]])
            expect[i] = [*model.encode(t, add_special_tokens=False).ids, 0]
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(got) == set(expect)
    for i, pieces in got.items():
        want = expect[i]
        assert sorted(pieces) == [(s, len(want[s:s + 1024]), zlib.crc32(np.array(want[s:s + 1024], "<u4").tobytes()), len(want)) for s in range(0, len(want), 1024)]


def test_registered_queries_have_their_columns(spark):
    columns = {"op1_lattice": "vec_id n_links component_id kept", "op2_simhash": "doc_id fingerprint component_id", "op3_language": "doc_id held_out lang_pred score",
               "op4_maxent": "doc_id held_out n_tokens n_known train_tokens base_score score", "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
               "op6_site_lines": "page_id host text n_lines n_dropped", "op7_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
               "op8_substrings": "doc_id n_bytes n_removed n_spans kept_sha256", "op9_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
               "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset"}
    queries = entry.queries()
    assert set(columns) | {"pipeline"} <= set(queries)
    for name, want in columns.items():
        got = queries[name](spark, SF)
        assert got.columns == want.split()


def test_substring_query_digest(spark):
    got = {r["doc_id"]: r for r in substring.q_op8(spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    for i, (kept, spans) in brute.uncovered(docs).items():
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[i]["n_spans"] == len(spans)
        assert got[i]["n_removed"] == got[i]["n_bytes"] - len(kept) and isinstance(got[i]["n_spans"], int)
    assert F.col is not None


def test_chat_extra_columns_of_other_layouts(spark):
    """Turn rows stay turn rows whatever columns of other layouts come along,
    alone, in pairs, and all at once."""
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn int, role string, text string")
    want = [tuple(r) for r in chat.format_chat([(rows, "conv_id")]).collect()]
    listed = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"), F.lit("y").alias("from"), F.lit("z").alias("value")))
    names = ["input", "output", "prompt", "completion", "question", "answer", "instruction", "messages", "conversations"]
    for some in [[n] for n in names] + [["prompt", "completion"], ["instruction", "input", "output"], names]:
        wide = rows.select("*", *[(listed if n in ("messages", "conversations") else F.lit("x")).alias(n) for n in some])
        assert [tuple(r) for r in chat.format_chat([(wide, "conv_id")]).collect()] == want, some
    both = spark.createDataFrame([(1, "do", "this", "done", "q")], "id long, instruction string, input string, output string, prompt string")
    assert chat.layout_of(both.schema)[0] == "instruction"
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1, "x")], "id long, prompt string").schema)


def test_sequences_hold_one_language(spark):
    """The language stage decides what is packed together."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))  # a third without a label
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language ID"](spark, docs, SF)
    assert found.where("lang is null").isEmpty() and found.columns == docs.columns
    langs = {r["doc_id"]: r["lang"] for r in found.collect()}
    got = stages["packing"](spark, found, SF).collect()
    assert len(set(langs.values())) > 1 and {r["doc_id"] for r in got} == set(langs)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], set()).add(langs[r["doc_id"]])
    assert all(len(x) == 1 for x in by.values())


def test_pack_by_a_column_with_nulls(spark):
    df = spark.createDataFrame([(k, "word " * (k % 40), [None, "", "a", "b"][k % 4]) for k in range(200)] + [(None, "x", None)], "doc_id long, text string, rank string")
    got = packing.pack(df, by="rank").collect()
    plain = packing.pack(df).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got), key=str) == sorted(map(key, plain), key=str)
    of, spots = {}, {}
    for r in got:
        of.setdefault(r["sequence_id"], set()).add(r["rank_"])
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(len(x) == 1 for x in of.values()) and {v for x in of.values() for v in x} == {None, "", "a", "b"}
    for f in spots.values():
        f.sort()
        assert [o for o, _ in f] == [sum(n for _, n in f[:k]) for k in range(len(f))] and sum(n for _, n in f) <= 1024
