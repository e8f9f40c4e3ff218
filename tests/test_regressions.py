"""Golden values, worked out by hand, for input that the fixture views lack."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from runlens.functions import jsonpath as J
from runlens.functions import patch as P
from runlens.operators import candidates as C
from runlens.operators import symbols as Y
from runlens.operators import testlogs as T
from runlens.operators import usage as U
from runlens.operators.scan import positions
from runlens.sinks import writers as W
from runlens.sources import readers as R
from runlens.streaming import live as L


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- JSON paths ----------------------------------------------------------------
def test_descent_goes_node_first_then_children_in_order():
    doc = '{"a":{"b":{"k":1}},"c":{"k":2}}'
    assert J.edit(doc, "$..k", "view", None, pretty=False)[1] == "[1, 2]"
    nested = '{"k":{"k":1,"z":{"k":2}},"y":[{"k":3},{"k":4}]}'
    assert J.edit(nested, "$..k", "view", None, pretty=False)[1] == '[{"k": 1, "z": {"k": 2}}, 1, 2, 3, 4]'


def test_star_on_objects_and_lists():
    assert J.edit('{"a":{"x":1,"y":2}}', "$.a.*", "view", None, pretty=False)[1] == "[1, 2]"
    assert J.edit('{"a":{"x":1}}', "$.a[*]", "view", None, pretty=False)[1] == '{"x": 1}'
    assert J.edit('{"a":[5,6,7]}', "$.a[1:]", "view", None, pretty=False)[1] == "[6, 7]"


def test_edits():
    assert J.edit('{"a":[1,2,3]}', "$.a[*]", "remove", None, pretty=False) == ('{"a": []}', None, 3, None)
    assert J.edit('{"a":1}', "$", "set", "[2]", pretty=False) == ("[2]", None, 1, None)
    assert J.edit('{"a":[1]}', "$.a[0]", "add", "9", pretty=False)[0] == '{"a": [9, 1]}'
    assert J.edit('{"a":{"b":1}}', "$.a.b.c", "add", "1")[3] == "Cannot add key to non-object at path: $.a.b"
    assert J.edit('{"a":{"b":1}}', "$.a[0]", "add", "1")[3] == "Cannot add element to non-array at path: $.a"
    assert J.edit('{"a":1}', "$.x.y", "add", "1")[3] == "Parent path not found: $.x"


def test_a_bad_value_is_an_error_row(spark):
    df = spark.createDataFrame([('{"a":1}', "$.a", "not json"), ('{"a":1}', "$.a", "2")], "doc string, path string, value string")
    got = df.select(J.json_set(F.col("doc"), F.col("path"), F.col("value"), pretty=False).alias("r")).select("r.*").collect()
    assert got[0].doc == '{"a":1}' and got[0].error.startswith("Invalid JSON value") and got[1].doc == '{"a": 2}'


# -- logs ----------------------------------------------------------------------
def test_both_log_modes_end_lines_where_python_does(spark, tmp):
    texts = {"a": "one\rtwo\r\nthree\n\nfour five\x0bsix", "b": "", "c": "\n", "d": "x\r", "e": "p\n\rq\r\r\n"}
    os.makedirs(f"{tmp}/logs")
    for k, t in texts.items():
        with open(f"{tmp}/logs/{k}.log", "w", newline="") as f:
            f.write(t)
    for whole in (True, False):
        got = {}
        for r in T.read_log_lines(spark, f"{tmp}/logs", whole_text=whole).collect():
            got.setdefault(os.path.basename(r.log_id)[0], {})[r.line_no] = r.line
        expect = {k: dict(enumerate(t.splitlines(), 1)) for k, t in texts.items() if t.splitlines()}
        assert got == expect, whole


def test_names_outside_ascii_keep_their_credit(spark):
    lines = spark.createDataFrame([("l", 1, "test_été (m.Café)"), ("l", 2, "Doc text ... ok"), ("l", 3, " test_x (m.C) ... FAIL ")], "log_id string, line_no long, line string")
    assert _rows(T.parse_docstring_log(lines)) == [("l", "Doc text", "PASSED"), ("l", "test_x (m.C)", "FAILED"), ("l", "test_été (m.Café)", "PASSED")]
    grouped = spark.createDataFrame([("l", 1, "sympy/café.py[1]"), ("l", 2, "test_é ok")], "log_id string, line_no long, line string")
    assert _rows(T.parse_grouped_log(grouped)) == [("l", "sympy/café.py::test_é", "PASSED")]


def test_one_pass_equals_the_parsers(spark):
    rows = [("s", 1, "sympy/a.py[2]"), ("s", 2, "test_a ok"), ("s", 3, "test_a F"), ("d", 1, "test_b (m.C)"), ("d", 2, "Words ... ok"), ("d", 3, ""),
            ("d", 4, "More ... ERROR"), ("d", 5, "FAIL: test_c (m.C)"), ("p", 1, "PASSED t::x"), ("p", 2, "FAILED t::x"), ("p", 3, "noise")]
    repo = {"s": "sympy/sympy", "d": "django/django", "p": "a/b"}
    df = spark.createDataFrame([(*r, repo[r[0]]) for r in rows], "log_id string, line_no long, line string, repo string")
    parts = [T.parse_grouped_log(df.where("log_id = 's'")), T.parse_docstring_log(df.where("log_id = 'd'")), T.parse_status_lines(df.where("log_id = 'p'"))]
    assert _rows(T.parse_logs(df)) == _rows(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# -- patches and candidates ----------------------------------------------------
PLAIN = """--- a/x.py
+++ b/x.py
@@ -1,2 +1,2 @@
-a = 1
+a = 2
 ctx
--- a/y.py
+++ b/y.py
@@ -1 +1 @@
-b = 1
+b = "# not a comment"  # one
"""


def test_file_headers_of_plain_diffs_are_no_changes(spark):
    # a removed and an added line that look like a file header, by the counts
    tricky = "--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1,2 @@\n x\n--- old\n+++ new\n"
    df = spark.createDataFrame([(1, PLAIN), (2, tricky), (3, "no diff at all"), (4, "")], "id int, patch string")
    got = {r.id: r.cleaned for r in P.with_clean_patch(df).collect()}
    assert got == {1: '-a=1+a=2-b=1+b="#notacomment"', 2: "-old+new", 3: None, 4: ""}


def test_candidates_without_a_key_are_classes_of_their_own(spark):
    c = spark.createDataFrame([("i", 0, 0, "k"), ("i", 0, 1, None), ("i", 0, 2, None), ("i", 0, 3, "k")], "instance_id string, grp int, idx int, cleaned string")
    reps = C.dedup_candidates(c, ["instance_id"])
    assert sorted(r.idx for r in reps.collect()) == [0, 1, 2]
    done = reps.select("instance_id", "idx", "cleaned", (F.col("idx") * 10).alias("failed"))
    assert sorted((r.idx, r.failed) for r in C.propagate_to_duplicates(c, done).collect()) == [(0, 0), (1, 10), (2, 20), (3, 0)]


def test_two_summaries_of_a_step_do_not_double_it(spark):
    steps = spark.createDataFrame([("r", 1, 0), ("r", 2, 1)], "run_id string, step_number int, pos int")
    notes = spark.createDataFrame([("r", 1, "first", 1), ("r", 1, "last", 2)], "run_id string, step_number int, lakeview_summary string, n int")
    got = U.attach_step_summary(steps, notes, seq="n").collect()
    assert sorted((r.step_number, r.lakeview_summary) for r in got) == [(1, "last"), (2, None)]


def test_limits_say_what_they_drop(spark):
    items = spark.createDataFrame([("a", f"t{i}") for i in range(7)] + [("b", "t")], "k string, test string")
    assert {(r.k, r.dropped) for r in C.seeded_sample(items, "k", "test", 3, dropped="dropped").collect()} == {("a", 4), ("b", 0)}
    assert {(r.k, r.dropped) for r in T.first_n_per_instance(items, 3, "k", dropped="dropped").collect()} == {("a", 4), ("b", 0)}


def test_building_a_query_runs_no_job(spark):
    sc = spark.sparkContext
    df = spark.createDataFrame([("a", i) for i in range(50)], "k string, o int")
    sc.setJobGroup(group := uuid.uuid4().hex, "build")
    out = C.batch_and_stride(df, "k", "o", batch_size=10, shards=3)
    assert sc.statusTracker().getJobIdsForGroup(group) == []
    assert sorted(r.pos for r in out.collect()) == list(range(50))


def test_positions_of_a_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).cast("string").alias("k"), F.xxhash64("id").alias("o"), "id")
    got = positions(df, "k", ["o", "id"]).collect()
    for key in (None, "hot"):
        mine = sorted((r.o, r.id, r.pos) for r in got if r.k == key)
        assert [p for _, _, p in mine] == list(range(len(mine)))


# -- files ---------------------------------------------------------------------
def test_extensions_are_compared_as_they_are(spark):
    df = spark.createDataFrame([("/r/a.py",), ("/r/A.PY",)], "path string")
    assert [r.path for r in Y.visible_files(df).collect()] == ["/r/a.py"]


def test_oversized_files_are_listed_not_read(spark, tmp):
    os.makedirs(f"{tmp}/src")
    for name, text in (("a.py", "x = 1\n"), ("big.py", "y = 2\n" * 100), ("n.txt", "no")):
        with open(f"{tmp}/src/{name}", "w") as f:
            f.write(text)
    got = Y.scan_source_files(spark, f"{tmp}/src", max_bytes=50).collect()
    assert [os.path.basename(r.path) for r in got] == ["a.py"]
    assert [(os.path.basename(r.path), r.size) for r in Y.oversized_files(spark, f"{tmp}/src", 50).collect()] == [("big.py", 600)]


def test_malformed_lines_are_kept_apart(spark, tmp):
    with open(f"{tmp}/c.jsonl", "w") as f:
        f.write('{"instance_id": "a", "patches": ["p"]}\n\n{"instance_id": "a", "patches": ["q", "r"]}\n{"instance_id": "b", "pat\n')
    got = {r.instance_id: (r.patches, r.regressions, r._bad) for r in R.read_candidates(spark, f"{tmp}/c.jsonl").collect()}
    assert got == {"a": (["q", "r"], [[], []], None), None: (None, None, '{"instance_id": "b", "pat')}
    assert [r._bad for r in R.read_instances(spark, f"{tmp}/c.jsonl").where("_bad is not null").collect()] == ['{"instance_id": "b", "pat']


def test_an_output_that_cannot_be_read_is_an_error(spark, tmp):
    sel = spark.createDataFrame([("g", "i", 0, "p")], "group_id string, instance_id string, idx int, patch string")
    assert [r.trial for r in W.write_selected_patches(spark, sel, f"{tmp}/out").collect()] == [1]
    spark.createDataFrame([("g", "i")], "group_id string, instance_id string").write.parquet(f"{tmp}/other")
    with pytest.raises(Exception):
        W.write_selected_patches(spark, sel, f"{tmp}/other")


# -- streams -------------------------------------------------------------------
def _stream(spark, path):
    return spark.readStream.schema("instance_id string").option("maxFilesPerTrigger", 1).parquet(path)


def test_two_outputs_under_one_name(spark, tmp):
    spark.createDataFrame([(x,) for x in "abcde"], "instance_id string").coalesce(1).write.parquet(f"{tmp}/in")
    name = "p" + uuid.uuid4().hex[:8]
    for out in ("one", "two"):
        L.stream_pending(spark, _stream(spark, f"{tmp}/in"), f"{tmp}/{out}", name=name).awaitTermination()
        assert sorted(r.instance_id for r in spark.read.parquet(f"{tmp}/{out}").collect()) == list("abcde")


def test_many_epochs_are_folded(spark, tmp, monkeypatch):
    monkeypatch.setattr(L, "COMPACT_EVERY", 3)
    for i in range(7):
        spark.createDataFrame([(f"k{i}",), (f"k{i // 2}",)], "instance_id string").coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    out = f"{tmp}/out"
    L.stream_pending(spark, _stream(spark, f"{tmp}/in"), out, name="p" + uuid.uuid4().hex[:8]).awaitTermination()
    got = sorted(r.instance_id for r in spark.read.parquet(out).collect())
    assert got == sorted({f"k{i}" for i in range(7)})
    epochs = [d for d in os.listdir(out) if d.startswith("epoch=")]
    assert len(epochs) <= 4 and not os.path.exists(out + ".compact")


def test_a_batch_reads_the_buckets_it_touches(spark, tmp):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    L._write_epoch(rows, f"{tmp}/log", 0, ["k"])
    touched = spark.createDataFrame([("7",)], "k string")
    part = L._read_log(spark, f"{tmp}/log", touched=touched, keys=["k"])
    assert part.count() < 50 and part.where("k = '7'").count() == 1
    assert "PartitionFilters: [" in part._jdf.queryExecution().executedPlan().toString()


def test_equal_spans_are_not_paired(spark):
    spans = spark.range(6000).select(F.lit("min.js").alias("file_path"), F.col("id").alias("sid"), F.concat(F.lit("f"), "id").alias("name"),
                                     F.when(F.col("id") == 7, "class").otherwise("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    got = Y.enclosing_symbol(spans)
    assert got.count() == 5999
    by = {r.sid: (r.parent_function, r.parent_class) for r in got.where("sid < 3").collect()}
    assert by == {0: ("f1", None), 1: ("f0", None), 2: ("f0", None)}


def test_log_lines_read_by_tasks(spark, tmp, monkeypatch):
    """Listed and dealt by tasks (F8): the lines of the other modes, whatever
    ends them and wherever a piece is cut."""
    import os

    from runlens.operators import testlogs as T
    from runlens.sources import named as N
    ends = ["\n", "\r\n", "\r", "\u2028", "\x85", "\x0b", "\x1d"]
    logs = {"a": "".join(f"line {k} é{ends[k % 7]}" for k in range(500)) + "last", "b": "", "c": "\n\n\nx\r\n", "d": "one" * 50, "e": "x\r\n" * 40 + "\r"}
    for name, text in logs.items():
        os.makedirs(f"{tmp}/logs/log_id={name}")
        open(f"{tmp}/logs/log_id={name}/record.json", "w", newline="", encoding="utf-8").write(text)
    want = [(n, k + 1, x) for n, t in logs.items() for k, x in enumerate(t.splitlines())]
    got = T.read_log_lines(spark, f"{tmp}/logs", listing="tasks").collect()
    assert sorted((r.log_id.split("/log_id=")[1][0], r.line_no, r.line) for r in got) == want
    monkeypatch.setattr(N, "HELD_BYTES", 64)
    files = __import__("pyarrow").RecordBatch.from_pydict({"path": [f"{tmp}/logs/log_id={n}/record.json" for n in logs]})
    pieces = [r for b in N._pieces(T.LINE_END_BYTES)(iter([files])) for r in b.to_pylist()]
    assert len(pieces) > 50
    lines = [(r["path"].split("/log_id=")[1][0], r["before"] + k + 1, x) for r in pieces for k, x in enumerate(r["piece"].decode().splitlines())]
    assert sorted(lines) == want
