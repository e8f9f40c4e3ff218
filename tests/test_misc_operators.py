"""Smaller operators not reached by the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.operators import candidates as C
from runlens.operators import messages as M
from runlens.operators import symbols as Y
from runlens.operators import testlogs as T


def test_scan_source_files_and_changes(spark, tmp):
    layout = {"a/x.py": "def f(): pass\n", "a/.hidden.py": "x", ".git/y.py": "x", "a/b/z.ts": "let a",
              "a/readme.md": "hi", "a/c.cc": "int x;"}
    for rel, body in layout.items():
        p = os.path.join(tmp, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(body)
    got = {os.path.relpath(r.path.replace("file:", ""), tmp): r.language
           for r in Y.scan_source_files(spark, tmp).collect()}
    assert got == {"a/x.py": "python", "a/b/z.ts": "typescript", "a/c.cc": "cpp"}
    old = Y.scan_source_files(spark, tmp).withColumn("root", F.lit("r"))
    new = old.withColumn("size", F.when(F.col("path").endswith("x.py"), F.col("size") + 1).otherwise(F.col("size")))
    assert [r.path.endswith("x.py") for r in Y.changed_files(old, new).collect()] == [True]
    fa = Y.snapshot_fingerprint(old).collect()[0].fingerprint
    fb = Y.snapshot_fingerprint(new).collect()[0].fingerprint
    assert fa != fb and Y.snapshot_fingerprint(old.orderBy(F.desc("path"))).collect()[0].fingerprint == fa


def test_status_events_and_retry_lines(spark):
    ev = spark.createDataFrame([("call", "passed"), ("call", "failed"), ("setup", "skipped"),
                                ("setup", "failed"), ("teardown", "failed"), ("setup", "passed")],
                               "when string, outcome string")
    got = [r[0] for r in ev.select(T.report_status(F.col("when"), F.col("outcome"))).collect()]
    assert got == ["PASSED", "FAILED", "SKIPPED", "ERROR", None, None]
    lines = spark.createDataFrame([("L", 1, "RPASS::t1"), ("L", 2, "noise"), ("L", 3, "RPASS::t3")],
                                  "log_id string, line_no long, line string")
    req = spark.createDataFrame([("L", "t1"), ("L", "t2")], "log_id string, test string")
    got = {r.test: r.passed for r in T.retry_passes(lines, req).collect()}
    assert got == {"t1": True, "t2": False}


def test_prompt_prefix_without_history_and_system(spark):
    rows = [("r", 0, "system", "S1"), ("r", 1, "user", "hello"), ("r", 2, "system", "S22"),
            ("r", 3, "assistant", "ok")]
    df = spark.createDataFrame(rows, "run_id string, step long, role string, content string")
    got = {r.step: (r.prompt_messages, r.prompt_chars, r.system_chars)
           for r in M.prompt_prefix(df, reuse_history=False).collect()}
    assert got == {0: (1, 2, 2), 1: (1, 5, 2), 2: (1, 3, 3), 3: (1, 2, 3)}
    full = {r.step: (r.prompt_messages, r.prompt_chars) for r in M.prompt_prefix(df).collect()}
    assert full[3] == (4, 12)
    assert M.system_prompt(df).collect()[0].system == "S22"


def test_missing_candidates(spark):
    inst = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    cands = spark.createDataFrame([("a", 0)], "instance_id string, idx long")
    assert [r.instance_id for r in C.missing_candidates(inst, cands).collect()] == ["b"]


def test_snapshot_key_and_digest(spark):
    import hashlib
    df = spark.createDataFrame([("abc", "", "fp"), ("abc", " M x.py\n", "fp"), (None, None, "fp")],
                               "commit string, status string, fp string")
    got = [r[0] for r in df.select(Y.snapshot_key(F.col("commit"), F.col("status"), F.col("fp"))).collect()]
    assert got == ["git-clean-abc", "git-dirty-abc-" + hashlib.md5(b" M x.py\n").hexdigest()[:8], "metadata-fp"]
    d = spark.createDataFrame([("héllo",)], "t string").select(Y.output_digest(F.col("t"))).collect()[0][0]
    assert d == hashlib.sha256("héllo".encode()).hexdigest()


def test_create_if_absent_messages(spark):
    from runlens.operators import docedit as E
    docs = spark.createDataFrame([("a", "x")], "path string, content string")
    creates = spark.createDataFrame([("a", "y"), ("b", "new content")], "path string, content string")
    got = {r.path: r for r in E.create_if_absent(docs, creates).collect()}
    assert got["b"].created and "created successfully" in got["b"].message
    assert not got["a"].created and got["a"].error.startswith("File already exists at: a.")


def test_trial_numbers_refill_gaps(spark):
    from runlens.operators.instances import next_trial_numbers
    sel = spark.createDataFrame([("g", "i", 5), ("g", "i", 7), ("g", "j", 1)],
                                "group_id string, instance_id string, idx long")
    ex = spark.createDataFrame([("g", "i", 1), ("g", "i", 3)], "group_id string, instance_id string, trial long")
    got = sorted((r.instance_id, r.idx, r.trial) for r in next_trial_numbers(sel, ex).collect())
    assert got == [("i", 5, 2), ("i", 7, 4), ("j", 1, 1)]


def test_chat_errors_per_provider_order(spark):
    df = spark.createDataFrame([("user", ""), ("bogus", ""), ("", "x"), ("bogus", "x")], "role string, content string")
    o = [r.error for r in M.to_chat_messages(df, "openai").collect()]
    assert o == ["Message content is required", "Message content is required", "Invalid message role: ",
                 "Invalid message role: bogus"]
    c = M.to_chat_messages(df, "compatible").collect()
    assert [r.error for r in c] == ["User message content is required", "Invalid message role: bogus", None,
                                    "Invalid message role: bogus"]
    assert c[2].chat_role is None


def test_checkpoint_dir_fallback_and_cluster_setting():
    from runlens.session import checkpoint_path, ensure_checkpoint_dir

    class Conf:
        def __init__(self, v):
            self.v = v

        def get(self, k, default=None):
            return self.v

    class Ctx:
        def __init__(self, master="local[2]"):
            self.d, self.master = None, master

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d + "/uuid"

    class Fake:
        def __init__(self, v):
            self.conf, self.sparkContext = Conf(v), Ctx()

    shared = Fake("hdfs://cluster/ckpt")
    assert ensure_checkpoint_dir(shared) == "hdfs://cluster/ckpt"
    assert checkpoint_path(shared, "s") == "hdfs://cluster/ckpt/s"
    local = Fake(None)
    d = ensure_checkpoint_dir(local)
    assert d.endswith("/uuid") and ensure_checkpoint_dir(local) == d
    cluster = Fake(None)
    cluster.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)


def test_refresh_index_and_sorted_writer(spark, tmp):
    from runlens.sinks.writers import write_symbol_index
    old = spark.createDataFrame([("a.py", 1, 10, "def f():\n    pass\n"), ("b.py", 1, 10, "def g():\n    pass\n"),
                                 ("c.py", 1, 10, "def h():\n    pass\n")],
                                "path string, mtime long, size long, content string")
    new = spark.createDataFrame([("a.py", 1, 10, "def f():\n    pass\n"), ("b.py", 2, 12, "def g2():\n    pass\n"),
                                 ("d.py", 1, 5, "class K:\n    pass\n")],
                                "path string, mtime long, size long, content string")
    index = Y.extract_symbols(old)
    fresh = Y.refresh_symbol_index(index, old, new)
    assert sorted((r.file_path, r.name) for r in fresh.collect()) == [("a.py", "f"), ("b.py", "g2"), ("d.py", "K")]
    out = os.path.join(tmp, "index")
    write_symbol_index(fresh, out)
    q = spark.read.parquet(out).where(F.col("name") == "g2")
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,g2)]" in q._jdf.queryExecution().executedPlan().toString()
    assert [r.file_path for r in q.collect()] == ["b.py"]


def test_normalize_usage_per_provider(spark):
    from runlens.operators.usage import normalize_usage
    raw = (7, 3, 2, 5, 1)
    rows = [(p, raw) for p in ["anthropic", "openai", "google", "compatible", "ollama"]] + [("openai", None)]
    df = spark.createDataFrame(rows, "provider string, raw_usage struct<input:long,output:long,"
                                     "cache_creation:long,cache_read:long,reasoning:long>")
    cols = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
            "reasoning_tokens"]
    got = [tuple(r[c] for c in cols) for r in normalize_usage(df).collect()]
    assert got == [(7, 3, 2, 5, 0), (7, 3, 0, 5, 1), (7, 3, 0, 5, 0), (7, 3, 0, 0, 0),
                   (0, 0, None, None, None), (0, 0, None, None, None)]


def test_parse_logs_from_repo_partitioned_store(spark, tmp):
    from runlens.sinks.writers import write_log_lines
    rows = [("s1", 1, "sympy/a/test_x.py[1]", "sympy/sympy"), ("s1", 2, "test_a ok", "sympy/sympy"),
            ("d1", 1, "test_b (m.C) ... FAIL", "django/django"), ("p1", 1, "PASSED t.py::c", "other/repo")]
    df = spark.createDataFrame(rows, "log_id string, line_no long, line string, repo string")
    out = os.path.join(tmp, "logs")
    write_log_lines(df, out)
    stored = spark.read.parquet(out)
    got = sorted((r.log_id, r.test, r.status) for r in T.parse_logs(stored).collect())
    assert got == [("d1", "test_b (m.C)", "FAILED"), ("p1", "t.py::c", "PASSED"),
                   ("s1", "sympy/a/test_x.py::test_a", "PASSED")]
    plan = stored.where(F.col("repo") == "sympy/sympy")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan


def test_replace_unique_empty_old(spark):
    from runlens.operators import docedit as E
    docs = spark.createDataFrame([("p", "ab\ncd")], "path string, content string")
    edits = spark.createDataFrame([("p", "", "x")], "path string, old string, new string")
    r = E.replace_unique(docs, edits).collect()[0]
    assert r.error.startswith("No replacement was performed. Multiple occurrences of old_str ``")
    assert r.content == "ab\ncd"


def test_enclosing_symbol_tolerates_bad_spans(spark):
    rows = [("f", 1, "A", "class", 1, 100), ("f", 2, "m", "function", 10, 20), ("f", 3, "bad", "function", 50, 40)]
    spans = spark.createDataFrame(rows, "file_path string, sid long, name string, kind string, "
                                        "start_line long, end_line long")
    got = {r.name: (r.parent_function, r.parent_class) for r in Y.enclosing_symbol(spans).collect()}
    assert got["m"] == (None, "A") and got["bad"] == (None, "A")
