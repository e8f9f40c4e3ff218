"""Embedding and SimHash near-duplicates, and components, against brute
force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import embedding, simhash
from runlens.llm.common import stars
from runlens.llm.components import components

from . import brute


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(3000, 3100)] + [(7, 7)]
    df = spark.createDataFrame(links + [(None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    names = sorted({x for a, b in links if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    expect = brute.roots(len(names), [(at[a], at[b]) for a, b in links if a != b])
    assert got == {x: names[r] for x, r in zip(names, expect)}
    assert components(df.where("false"), "a", "b").collect() == []


def test_stars():
    a, b = np.array([3, 4, 1]), np.array([4, 5, 0])
    assert stars(7, a, b).tolist() == [0, 0, 2, 3, 3, 3, 6]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    values = base[rng.integers(0, 5, 300)]
    for _ in range(4):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) * rng.integers(0, 2, 300).astype(np.uint64)
    a, b = simhash.close_pairs(values, radius, rows=64)
    expect = {(i, j) for i in range(300) for j in range(300) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
    assert set(zip(a.tolist(), b.tolist())) == expect


@pytest.mark.parametrize("block", [512, 4])
def test_simhash_links_are_whole(spark, block):
    rng = np.random.default_rng(1)
    values = [0]
    for _ in range(60):
        v = values[-1]
        for b in rng.choice(64, 2, replace=False):
            v ^= 1 << int(b)
        values.append(v)
    values += [int(x) for x in rng.integers(0, 2**63, 100)]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "v long"), "v", 2, block), "a", "b")
    sizes = sorted(r["count"] for r in got.groupBy("root").count().collect())
    assert sizes == [61]


def test_simhash_query(spark, rows):
    docs = rows("documents", "doc_id, text", "doc_id")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.simhash_components(docs)


def test_simhash_awkward_rows(spark, odd_docs):
    got = simhash.simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[7]) == 2 and by[2][0]["component_id"] == 1
    assert {r["doc_id"] for r in got if r["fingerprint"] == "0" * 16} == {4, 5, 6}
    assert by[5][0]["component_id"] == by[6][0]["component_id"] == 4
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and 2 not in ids and 1 in ids and 4 in ids and 5 not in ids
    assert simhash.simhash_groups(odd_docs.where("false")).collect() == [] and simhash.keep_one(odd_docs.where("false")).collect() == []


def test_lattice_points():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    p = embedding.decode(x)
    whole, half = (p % 2 == 0).all(1), (p % 2 != 0).all(1)
    assert (whole | half).all() and ((p.sum(1) // 2) % 2 == 0).all()
    assert (((x - p / 2) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius
    for n in embedding.neighbours(x, p):
        assert (((n - p) ** 2).sum(1) == 8).all()  # a minimal vector away, in half units
        assert (embedding.decode(n / 2) == n).all()


def vectors(spark, block=False):
    rng = np.random.default_rng(3)
    out, d = [], 32
    for c in range(30):
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 12))):
            out.append((centre + rng.normal(size=d) * 0.12).tolist())
    out += [out[0], out[0], [2 * x for x in out[1]]]
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_embeddings_against_brute_force(spark, block):
    data = vectors(spark)
    m = np.array(data)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    expect_links = int(near.sum() - len(data))
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [math.nan] * 32), (1004, [math.inf] + [0.0] * 31), (1005, [None] + [1.0] * 31), (None, data[0]), (1006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(data)] + [(i, v, "y", 2) for i, v in odd], "vec_id long, embedding array<double>, label string, n int")
    got = {r["vec_id"]: r for r in embedding.near_embeddings(df, block=block).collect()}
    assert len(got) == len(data) + len(odd)
    links = sum(got[i]["n_links"] for i in range(len(data)))
    assert 0.9 * expect_links <= links <= expect_links
    for i in range(len(data)):
        assert got[i]["n_links"] <= near[i].sum() - 1
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    at = brute.roots(len(data), [tuple(p) for p in np.argwhere(near)])
    assert sum(got[i]["component_id"] == at[i] for i in range(len(data))) >= 0.95 * len(data)
    for i, _ in odd:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] == (True if i is not None else None)
    assert embedding.near_embeddings(df.where("false")).collect() == []


def test_embedding_recall_at_the_threshold():
    """Pairs at cosine 0.95 exactly meet in some cell."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    x, y = embedding.cells(a), embedding.cells(0.95 * a + np.sqrt(1 - 0.95**2) * n)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() >= 0.98


def test_groups_are_not_expanded(spark):
    """Copies cost one node, whatever their number."""
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("embedding"))
    got = embedding.near_embeddings(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(499, 0)} and sum(r["kept"] for r in got) == 1


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_embeddings(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_one_row_of_each_group_where_ids_repeat(spark):
    """An id with several texts: each row is judged by its own group."""
    text = {k: " ".join(f"{k}{i * i % 101}" for i in range(80)) for k in "abc"}
    data = [(1, text["a"], "x"), (5, text["a"], "x"), (5, text["b"], "x"), (6, text["b"], "x"),  # b's group has ids 5 and 6
            (3, text["c"], "x"), (3, text["c"], "y"), (3, text["c"], None), (3, text["c"], "x"), (4, text["c"], "x"), (None, text["c"], "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert [r for r in got if r[0] is None] == [data[-1]]
    assert sorted((r[0], r[1][0]) for r in got if r[0] is not None) == [(1, "a"), (3, "c"), (5, "b")]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in simhash.keep_one(docs.repartition(5)).collect())


def test_an_id_with_two_vectors(spark):
    """Each row has the links of its own vector, and both vectors' classes
    stay apart."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    data = [(5, a), (5, b), (7, near(a)), (9, near(b)), (3, near(b)), (5, a)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, n_links string")
    got = sorted(tuple(r) for r in embedding.near_embeddings(df).select("vec_id", "n_links", "component_id").collect())
    # of a there are two rows, of b one, and one and two near vectors
    assert got == sorted([(5, 2, 5), (5, 2, 5), (7, 2, 5), (5, 2, 3), (9, 2, 3), (3, 2, 3)])
    again = sorted(tuple(r) for r in embedding.near_embeddings(df.repartition(4)).select("vec_id", "n_links", "component_id").collect())
    assert again == got
