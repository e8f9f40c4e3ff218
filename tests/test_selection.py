"""Candidate selection goldens and properties."""

from pyspark.sql import functions as F

from runlens.operators import candidates as C
from runlens.operators import stats as S
from runlens.operators.votes import majority_vote


def _votes(spark, ballots):
    rows = [(b, i, v, n) for b, (n, vs) in ballots.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "ballot string, vote_idx long, voted string, n long")


def test_majority_vote_golden(spark):
    v = _votes(spark, {"x": (5, list("abbba")), "y": (4, list("baab")), "z": (1, ["a"])})
    got = {r.ballot: (r.winner, r.votes_cast) for r in majority_vote(v).collect()}
    assert got == {"x": ("b", 4), "y": ("b", 4), "z": ("a", 1)}


def test_majority_vote_ignores_votes_after_stop(spark):
    base = {"x": (5, list("abbb")), "y": (3, list("cc"))}
    more = {"x": (5, list("abbbc")), "y": (3, list("ccd"))}
    a = {r.ballot: (r.winner, r.votes_cast) for r in majority_vote(_votes(spark, base)).collect()}
    b = {r.ballot: (r.winner, r.votes_cast) for r in majority_vote(_votes(spark, more)).collect()}
    assert a == b


def test_label_short_circuit_golden(spark):
    sets = {"s": [1, 1], "f": [0, 0], "m": [0, 1], "u": [-1, -1], "fu": [0, -1], "su": [1, -1]}
    rows = [(k, 0, i, v) for k, vs in sets.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "instance_id string, grp long, idx long, success_id long")
    got = {r.instance_id: (r.skip, r.all_success) for r in C.label_short_circuit(df).collect()}
    assert got["s"] == (True, True)
    assert got["f"] == (True, False)
    assert got["m"][0] is False and got["u"][0] is False and got["su"][0] is False
    assert got["fu"] == (True, False)


def test_prune_or_keep_all_golden_and_never_empties(spark):
    rows = [("a", 0, 0, False), ("a", 0, 1, True), ("a", 0, 2, True), ("b", 0, 0, False), ("b", 0, 1, False)]
    df = spark.createDataFrame(rows, "instance_id string, grp long, idx long, ok boolean")
    got = sorted((r.instance_id, r.idx) for r in C.prune_or_keep_all(df).collect())
    assert got == [("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [("a", 0, 2, "k1"), ("a", 0, 0, "k1"), ("a", 0, 1, "k2"), ("b", 0, 5, "k1")]
    df = spark.createDataFrame(rows, "instance_id string, grp long, idx long, cleaned string")
    once = C.dedup_candidates(df)
    twice = C.dedup_candidates(once)
    got = sorted((r.instance_id, r.idx) for r in once.collect())
    assert got == [("a", 0), ("a", 1), ("b", 5)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_explode_candidates_keeps_indexes(spark):
    df = spark.createDataFrame(
        [("i1", ["p0", "  \n", "p2", "p3"], [1, 0, 0, 1], None)],
        "instance_id string, patches array<string>, success_id array<int>, regressions array<array<string>>")
    got = [(r.idx, r.ok) for r in C.explode_candidates(df, num_candidate=3).orderBy("idx").collect()]
    assert got == [(0, True), (2, True)]


def test_group_statistics_zero_denominators(spark):
    df = spark.createDataFrame([("g", 1, 1, True, False)],
                               "group_id string, instance_id long, is_success long, "
                               "is_all_success boolean, is_all_failed boolean")
    r = S.group_statistics(df).collect()[0]
    assert r.need_to_select == 0 and r.success_rate_in_need_to_select == 0.0
    assert r.success_rate_among_all == 1.0 and r.completion_rate == 1 / 500


def test_seeded_sample_size_and_repeatability(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("item"))
    a = C.seeded_sample(df, "k", "item", 40, seed="x")
    b = C.seeded_sample(df, "k", "item", 40, seed="x")
    counts = {r.k: r["count"] for r in a.groupBy("k").count().collect()}
    assert counts == {0: 40, 1: 40, 2: 40}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    small = C.seeded_sample(df.where("k = 0").limit(7), "k", "item", 50)
    assert small.count() == 7


def test_select_regression_tests(spark):
    tests = spark.createDataFrame([("i", f"t{j:02d}") for j in range(8)] + [("z", "only")],
                                  "instance_id string, test string")
    batched = C.batch_and_stride(tests, "instance_id", "test", batch_size=3)
    replies = spark.createDataFrame([("i", 0, "[2, 0, 2, 7"), ("i", 1, "[9, 42"), ("z", 0, "[0]")],
                                    "instance_id string, batch long, reply string")
    got = C.select_regression_tests(batched, replies, k=2, cap=100).collect()
    by = {}
    for r in got:
        by.setdefault((r.instance_id, r.batch, r.source), []).append(r.test)
    assert sorted(by[("i", 0, "reply")]) == ["t00", "t02"]           # in-range, deduplicated
    assert len(by[("i", 1, "fallback")]) == 2                        # nothing in range -> sample of k
    assert set(by[("i", 1, "fallback")]) <= {"t03", "t04", "t05"}
    assert len(by[("i", 2, "fallback")]) == 2                        # no reply at all -> sample
    assert by[("z", 0, "reply")] == ["only"]
    capped = C.select_regression_tests(batched, replies, k=2, cap=3).collect()
    assert sum(1 for r in capped if r.instance_id == "i") == 3
