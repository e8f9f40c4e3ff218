"""Property checks on generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import patch as P
from runlens.operators import candidates as C

_ident = st.text(alphabet="abcxyz_", min_size=1, max_size=6)
_line = st.tuples(st.sampled_from(["+", "-", " "]), _ident, st.integers(0, 9),
                  st.sampled_from(["", "  # c", "\t", " ", "#x"]))


def _diff(lines):
    body = "\n".join(f"{s}{a} = {n}{tail}" for s, a, n, tail in lines)
    return f"diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,9 +1,9 @@\n{body}\n"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_line, min_size=1, max_size=8), min_size=1, max_size=6))
def test_clean_patch_keeps_the_changed_code(spark, diffs):
    """The key is the changed lines' sign and code, whatever trails them."""
    texts = [_diff(d) for d in diffs]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, patch string")
    got = {r.id: r.cleaned for r in P.with_clean_patch(df).collect()}
    assert got == {i: "".join(f"{s}{a}={n}" for s, a, n, _ in d if s != " ") for i, d in enumerate(diffs)}


@settings(max_examples=15, deadline=None)
@given(st.lists(_line, min_size=1, max_size=8), st.sampled_from(["  ", "\t", "   # note"]))
def test_clean_patch_ignores_whitespace_and_comments(spark, lines, noise):
    a = _diff(lines)
    b = "\n".join(ln + noise if ln[:1] in "+-" and not ln.startswith(("+++", "---")) else ln
                  for ln in a.split("\n"))
    df = spark.createDataFrame([(0, a), (1, b)], "id int, patch string")
    keys = {r.id: r.cleaned for r in P.with_clean_patch(df).collect()}
    assert keys[0] == keys[1]


def test_propagate_keeps_row_count(spark):
    from conftest import SF
    from runlens.sources.fixtures import fx_candidates
    c = fx_candidates(spark, SF)
    reps = C.dedup_candidates(c, ["instance_id"]).select("instance_id", "cleaned", F.col("idx").alias("rep"))
    assert C.propagate_to_duplicates(c, reps, value_cols=["rep"]).count() == c.count()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 9))), min_size=1,
                max_size=60), st.integers(1, 16), st.integers(1, 5))
def test_running_scan_equals_windows(spark, rows, chunk, gap):
    from pyspark.sql import Window
    from runlens.operators.scan import running
    data = [(k, i * gap, v) for i, (k, v) in enumerate(rows)]   # positions with gaps
    df = spark.createDataFrame(data, "k string, n long, v long")
    got = running(df, "k", "n", {"s": ("sum", "v"), "c": ("count", "v"), "l": ("last", "v"),
                                 "p": ("lag", "v")}, chunk=chunk)
    w = Window.partitionBy("k").orderBy("n")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "n", F.coalesce(F.sum("v").over(wr), F.lit(0)).alias("s"), F.count("v").over(wr).alias("c"),
                    F.last("v", True).over(wr).alias("l"), F.lag("v").over(w).alias("p"))
    assert sorted(map(tuple, got.select("k", "n", "s", "c", "l", "p").collect())) == \
        sorted(map(tuple, ref.collect()))
