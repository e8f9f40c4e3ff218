"""Toxicity, fill-in-the-middle and source divergence."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import divergence, fim, toxicity, words

# ---------------------------------------------------------------- fill in the middle


def plain_fim(doc_id, text):
    """The contract, read code point by code point."""
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé漢😀\n\0<S>P"), max_size=40), min_size=1, max_size=12))
def test_units_are_code_points(texts):
    units = fim.Units(*words.flat(pa.array(texts)))
    assert units.sizes.tolist() == [len(t) for t in texts]
    for share in (0, 1, 2, 3):
        k = np.array([len(t) * share // 3 for t in texts])
        ends = units.byte_after(k) - units.offsets[:-1]
        assert ends.tolist() == [len(t[:i].encode()) for t, i in zip(texts, k.tolist())]


def test_units_of_a_broken_text_stay_in_it():
    data = np.frombuffer(b"\x80\x80a" + "é".encode() + b"b", np.uint8)
    units = fim.Units(data, np.array([0, 3, 5, 6]))  # the first text starts with stray bytes
    assert units.sizes.tolist()[1:] == [1, 1] and units.byte_after(np.array([0, 1, 1])).tolist() == [0, 5, 6]


def test_fim_matches_brute_force(spark, rows):
    data = rows("documents", "doc_id, text", "doc_id") + [(10**6 + k, t) for k, t in enumerate(["", None, "a<S>b", "<P", "<<S>", "漢字" * 9, "😀", "<S<P<M"])]
    got = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string")).withColumn("back", fim.restored()).collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r["fim"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_joins_make_no_mark(spark):
    """A part that ends in the start of a mark does not hide the mark written."""
    texts = ["<" * 30, "<S" * 20, "<P" * 20 + "<M" * 20, "S><" * 20, "M><P" * 20]
    data = [(k, t) for k in range(60) for t in texts]
    made = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string"), plain_from=100)
    assert made.where(fim.restored() != F.col("text")).count() == 0


def test_fim_awkward_rows(spark, odd_docs):
    docs = odd_docs.withColumn("fim", F.lit(1)).withColumn("fim_key", F.lit("k"))
    got = fim.fill_in_middle(docs)
    assert got.columns == [*docs.columns, "fim_"]
    for r in got.collect():
        assert tuple(r["fim_"]) == plain_fim(r["doc_id"], r["text"])
    assert got.where(fim.restored("fim_") != F.coalesce("text", F.lit(""))).count() == 0
    assert fim.fill_in_middle(docs.where("false")).collect() == []


# ---------------------------------------------------------------- source divergence


def plain_divergence(docs, least):
    """The contract, term by term."""
    docs = [(x or "", y or "", z or "") for x, y, z in docs]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        found = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        seen[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang in {x for x, _, _ in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: seen[g, s] for g, s in seen if g == lang}
        whole = sum(own.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            words_ = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", words_, 50)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.mark.parametrize("block", [divergence.BLOCK, 3])
def test_divergence_matches_brute_force(spark, rows, block):
    data = rows("documents", "lang, source, text", "doc_id")
    docs = spark.createDataFrame(data, "lang string, source string, text string")
    got = sorted(map(tuple, divergence.divergence(docs, min_documents=8, block=block).collect()))
    assert got == plain_divergence(data, 8) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_awkward_rows(spark, odd_docs):
    data = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    for least in (1, 2, 30):  # with 30 no term is kept and all pairs are zero
        got = sorted(map(tuple, divergence.divergence(odd_docs, min_documents=least).collect()))
        assert got == plain_divergence(data, least)
    assert divergence.divergence(odd_docs.where("false")).collect() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 64)
    text = " ".join(f"Wort{chr(97 + k % 7)}é" for k in range(400)) + " x" * 900 + "y" * 500
    got = divergence._counted(pa.array(["l"]), pa.array(["s"]), pa.array([text])).to_pydict()
    lower = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("W", "w"))
    assert dict(zip(got["term"], got["n"])) == Counter(lower) and set(got["docs"]) == {1}


def test_share_is_exact_beyond_64_bits(spark):
    n, total, kept = 7 * 10**13, 9 * 10**14 + 1, 10**7
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * kept) == divergence._shares(np.array([n]), total, kept)[0]


# ---------------------------------------------------------------- toxicity


def plain_features(text):
    out = set()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").lower().encode()):
        out.add((0, w))
        s = b"^" + w + b"$"
        out |= {(n, s[k:k + n]) for n in toxicity.SIZES for k in range(len(s) - n + 1)}
    return out


def test_features_match_brute_force(monkeypatch):
    texts = ["An idiot is an IDIOT!", "", None, "Über çà 漢字 😀x", "a" * 30 + " b", "the the cat", "12 - 7"]
    row, feature = toxicity.present(pa.array(texts))
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(plain_features(t)) for t in texts]
    known = np.unique(feature)[::3]
    one = toxicity.present(pa.array(texts), known)
    assert set(zip(one[0].tolist(), known[one[1]].tolist())) == {(r, f) for r, f in zip(row.tolist(), feature.tolist()) if f in known}
    monkeypatch.setattr(toxicity, "PART_BYTES", 4)  # every text in pieces
    again = toxicity.present(pa.array(texts))
    assert again[0].tolist() == row.tolist() and again[1].tolist() == feature.tolist()


def test_risk_is_the_gradient_of_its_loss():
    rng = np.random.default_rng(3)
    for prior, shift in ((0.1, 0.0), (0.6, 0.0), (0.9, 4.0)):
        p, u = rng.normal(shift, 1, 9), rng.normal(-shift, 1, 14)
        clean = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        cost, on_p, on_u = toxicity.risk(p, u, prior)
        assert abs(cost - prior * np.logaddexp(0, -p).mean() - max(clean, 0)) < 1e-12
        sign = 1 if clean >= 0 else -1  # below zero the clean part is climbed alone
        loss = lambda p, u: sign * (np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()) + (prior * np.logaddexp(0, -p).mean() if sign > 0 else 0)
        for at, got, move in ((p, on_p, lambda d: (p + d, u)), (u, on_u, lambda d: (p, u + d))):
            for k in range(len(at)):
                d = np.zeros(len(at))
                d[k] = 1e-6
                assert abs((loss(*move(d)) - loss(*move(-d))) / 2e-6 - got[k]) < 1e-6
    assert toxicity.risk(np.full(3, 9.0), np.full(5, -9.0), 0.5)[0] >= 0


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    own = ~toxicity.held_out("doc_id")
    model = toxicity.train(docs.where(own), labels.where(own), min_documents=4)
    got = toxicity.score(docs.where(~own), model).join(labels, "doc_id").collect()
    toxic = np.array([r["toxic"] for r in got]) == 1
    scores = np.array([r["toxicity"] for r in got])
    above = (scores[toxic][:, None] > scores[~toxic]).mean() + (scores[toxic][:, None] == scores[~toxic]).mean() / 2
    assert above > 0.75 and ((scores >= 0) & (scores <= 1)).all() and (scores[~toxic] >= 0.5).mean() < 0.1
    assert toxicity.train(docs.where(own).repartition(7), labels.where(own).repartition(3), min_documents=4).weights == pytest.approx(model.weights, abs=1e-9)
    for r in got[:20]:  # a plain sum over the features that are there
        have = np.isin(model.features, toxicity.present(pa.array([r["text"]]))[1])
        assert abs(r["toxicity"] - 1 / (1 + np.exp(-model.weights[have].sum() - model.bias))) < 1e-9


def test_toxicity_awkward_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (7, 1), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    docs = odd_docs.withColumn("toxicity", F.lit("x")).withColumn("key", F.lit(1)).withColumn("any", F.lit(1)).withColumn("toxic", F.lit(0))
    model = toxicity.train(docs, labels, min_documents=1, min_ratio=0.1)
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "toxicity_"] and got.count() == docs.count()
    by = {r["doc_id"]: r["toxicity_"] for r in got.collect()}
    assert by[4] == by[5] == by[6] and all(0 <= x <= 1 for x in by.values()) and by[1] == by[2]
    assert toxicity.score(docs.where("false"), model).collect() == []
    for nothing in (labels.where("false"), labels.where("toxic = 0"), labels.where("doc_id = 99")):
        none = toxicity.train(docs, nothing)
        assert {r["toxicity_"] for r in toxicity.score(docs, none).collect()} <= {0.0}
    assert toxicity.train(docs.where("false"), labels).features.size == 0
