"""Readers, flattening, sinks and streaming: round trips on files written
by the test itself."""

import json
import os

from pyspark.sql import functions as F

from runlens.operators import symbols as Y
from runlens.operators.flatten import flatten_trajectories
from runlens.operators.testlogs import parse_grouped_log
from runlens.sinks import writers as W
from runlens.sources import readers as R
from runlens.sources.tables import table
from runlens.streaming import live as L

TRAJ = {
    "task": "task", "start_time": "2025-01-01T10:00:00.000001", "end_time": "", "provider": "vllm",
    "model": "model", "max_steps": 3,
    "llm_interactions": [{
        "timestamp": "2025-01-01T10:00:01", "provider": "vllm", "model": "model",
        "input_messages": [{"role": "user", "content": "hello"}],
        "response": {"content": "done", "model": "model", "finish_reason": "length",
                     "usage": {"input_tokens": 7, "output_tokens": 3, "cache_creation_input_tokens": 0,
                               "cache_read_input_tokens": 0, "reasoning_tokens": 0}, "tool_calls": None},
        "wire_request": {"endpoint_api": "responses",
                         "body": {"input": [{"role": "user", "content": "hello"}], "max_output_tokens": 10},
                         "started_at_ns": 100, "ended_at_ns": 200, "attempt_count": 1}}],
    "agent_steps": [{
        "step_number": 1, "timestamp": "2025-01-01T10:00:02", "state": "tool",
        "tool_results": [{"call_id": "call-1", "success": True, "result": "ok", "error": None, "id": None,
                          "exit_code": 0, "executed_command": "printf ok", "executor": "docker",
                          "started_at_ns": 210, "ended_at_ns": 220}]}],
    "success": False, "final_result": None, "execution_time": 0.0}


def test_trajectories_good_and_truncated(spark, tmp):
    good = json.dumps(TRAJ, indent=2)
    with open(os.path.join(tmp, "a.json"), "w") as f:
        f.write(good)
    with open(os.path.join(tmp, "b.json"), "w") as f:
        f.write(good[: len(good) // 2])
    t = R.read_trajectories(spark, tmp)
    assert t.count() == 2 and R.corrupt_records(t, "task").count() == 1
    flat = flatten_trajectories(t)
    i = flat["interactions"].collect()[0]
    assert i.wire_request.endpoint_api == "responses" and i.wire_request.attempt_count == 1
    assert i.input_tokens == 7 and i.output_tokens == 3
    r = flat["step_tool_results"].collect()[0]
    assert (r.exit_code, r.started_at_ns, r.executed_command) == (0, 210, "printf ok")
    assert abs(r.duration_s - 1e-8) < 1e-15
    assert flat["messages"].collect()[0].content == "hello"
    assert flat["runs"].collect()[0].end_time is None


def test_candidates_last_line_wins(spark, tmp):
    p = os.path.join(tmp, "c.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"instance_id": "i1", "issue": "x", "patches": ["a", "b"], "success_id": [1, 0]}) + "\n\n")
        f.write(json.dumps({"instance_id": "i2", "issue": "y", "patches": ["c"], "success_id": [0],
                            "regressions": [["t1"]]}) + "\n")
        f.write(json.dumps({"instance_id": "i1", "issue": "x2", "patches": ["d"], "success_id": [1]}) + "\n")
    got = {r.instance_id: r for r in R.read_candidates(spark, p).collect()}
    assert got["i1"].issue == "x2" and got["i1"].regressions == [[]]
    assert got["i2"].regressions == [["t1"]]


def test_selection_stats_groups_and_corrupt(spark, tmp):
    for g, inst, rec in [("group_0", "a", {"instance_id": "a", "patch_id": 0, "is_success": 1,
                                           "is_all_success": True, "is_all_failed": False}),
                         ("group_1", "b", {"instance_id": "b", "patch_id": 1, "is_success": 0,
                                           "is_all_success": False, "is_all_failed": False})]:
        os.makedirs(os.path.join(tmp, g), exist_ok=True)
        with open(os.path.join(tmp, g, inst + ".json"), "w") as f:
            json.dump(rec, f, indent=2)
    with open(os.path.join(tmp, "group_1", "bad.json"), "w") as f:
        f.write('{"instance_id": "c", ')
    s = R.read_selection_stats(spark, tmp)
    assert sorted(r.group_id for r in R.valid_stats(s).collect()) == ["group_0", "group_1"]
    assert R.corrupt_records(s, "instance_id").count() == 1
    only = R.read_selection_stats(spark, tmp, group="0")
    assert [r.instance_id for r in only.collect()] == ["a"]


def test_collect_patches_and_predictions_round_trip(spark, tmp):
    pdir = os.path.join(tmp, "patches")
    os.makedirs(pdir)
    for i in ["x__1", "y__2"]:
        with open(os.path.join(pdir, i + ".patch"), "w") as f:
            f.write(f"diff for {i}\n")
    wanted = spark.createDataFrame([("x__1",), ("z__9",)], "instance_id string")
    preds = R.collect_patches(spark, pdir, wanted, "m")
    assert [(r.instance_id, r.model_patch) for r in preds.collect()] == [("x__1", "diff for x__1\n")]
    out = os.path.join(tmp, "preds")
    W.write_predictions(preds, out)
    back = R.read_instances(spark, out, fmt="jsonl")
    assert back.count() == 1


def test_append_new_resumes(spark, tmp):
    out = os.path.join(tmp, "out")
    schema = "instance_id string, regression_done boolean"
    new = spark.createDataFrame([("a", True), ("b", False)], schema)
    W.append_new(spark, new, out, schema, complete=F.col("regression_done"))
    again = spark.createDataFrame([("a", True), ("b", True), ("c", True)], schema)
    added = W.append_new(spark, again, out, schema, complete=F.col("regression_done"))
    assert sorted(r.instance_id for r in added.collect()) == ["b", "c"]


def test_selected_patch_trials(spark, tmp):
    out = os.path.join(tmp, "sel")
    sel = spark.createDataFrame([("g0", "i", 0, "p"), ("g0", "i", 1, "q")],
                                "group_id string, instance_id string, idx long, patch string")
    W.write_selected_patches(spark, sel, out)
    W.write_selected_patches(spark, sel.limit(1), out)
    got = sorted(r.trial for r in spark.read.parquet(out).collect())
    assert got == [1, 2, 3]


def test_group_report_csv(spark, tmp):
    from runlens.operators.stats import group_statistics
    from runlens.sources.fixtures import fx_stats
    from conftest import SF
    out = os.path.join(tmp, "report")
    W.write_group_report(group_statistics(fx_stats(spark, SF)), out)
    df = spark.read.option("header", True).csv(out)
    assert df.columns[0] == "group_id" and len(df.columns) == 10


def test_log_lines_and_parse(spark, tmp):
    p = os.path.join(tmp, "sympy.log")
    with open(p, "w") as f:
        f.write("noise\nsympy/a/test_x.py[2]\ntest_a ok\r\ntest_b E\n")
    from runlens.operators.testlogs import read_log_lines
    got = {r.test: r.status for r in parse_grouped_log(read_log_lines(spark, p)).collect()}
    assert got == {"sympy/a/test_x.py::test_a": "PASSED", "sympy/a/test_x.py::test_b": "FAILED"}


def test_extract_symbols_and_parents(spark):
    src = '''class A:
    @staticmethod
    def m(x: int) -> int:
        def inner():
            return 1
        return x

    def n(self, y) -> str:
        return ""


def top():
    class B:
        def b(self):
            pass
    return B
'''
    files = spark.createDataFrame([("f.py", src), ("bad.py", "def (:")], "path string, content string")
    sym = Y.extract_symbols(files)
    rows = sym.collect()
    assert any(r.kind == "error" and r.file_path == "bad.py" for r in rows)
    a = [r for r in rows if r.kind == "class" and r.name == "A"][0]
    assert a.methods == "- m(x: int)\n- n(self, y) -> str"
    spans = (sym.where(F.col("kind") != "error")
             .withColumn("sid", F.row_number().over(
                 __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("file_path").orderBy("start_line", "name")))
             .select("file_path", "sid", "name", "kind", "start_line", "end_line"))
    par = {r.name: (r.parent_function, r.parent_class) for r in Y.enclosing_symbol(spans).collect()}
    assert par == {"m": (None, "A"), "inner": ("m", None), "n": (None, "A"), "top": (None, None),
                   "b": (None, "B")}


def test_stream_pending_survives_restart(spark, tmp):
    src = os.path.join(tmp, "in")
    os.makedirs(src)
    out = os.path.join(tmp, "done")
    spark.createDataFrame([("a",), ("b",)], "instance_id string").write.parquet(os.path.join(src, "1"))
    schema = "instance_id string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    name = "pending_restart_" + __import__("uuid").uuid4().hex[:8]
    L.stream_pending(spark, stream, out, name=name).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "instance_id string").write.parquet(os.path.join(src, "2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    L.stream_pending(spark, stream, out, name=name).awaitTermination()
    assert sorted(r.instance_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    # replaying an epoch (a retried micro-batch) rewrites only that epoch's folder
    assert sorted(os.listdir(out))[:2] == ["epoch=0", "epoch=1"]


def test_stream_vote_equals_batch(spark):
    from conftest import SF
    from runlens.operators.votes import majority_vote
    from runlens.plans.live import q_stream_majority_vote
    from runlens.sources.fixtures import fx_votes
    s = {r.ballot: r.winner for r in q_stream_majority_vote(spark, SF).collect()}
    b = {r.ballot: r.winner for r in majority_vote(fx_votes(spark, SF)).collect()}
    assert s == b and len(s) == table(spark, SF, "orders").select("o_custkey").distinct().count()


def test_run_timings_and_instances_array(spark, tmp):
    p = os.path.join(tmp, "timings.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"ts_start": 1.0, "ts_end": 3.5, "wall_s": 2.5, "cpu_s": None, "phase": "validate",
                            "instance_id": "i", "n_tests": 4, "command": "pytest", "exit_code": 0,
                            "stdout_sha256": "ab", "image_id": "x", "image_ref": "y"}) + "\n")
        f.write(json.dumps({"ts_start": 0.0, "ts_end": 1.0, "wall_s": 1.0, "stage": "select",
                            "instance_id": "i", "kind": "setup"}) + "\n")
    t = {r.record: r for r in R.read_run_timings(spark, p).collect()}
    assert t["test_run"].wall_s == 2.5 and t["test_run"].cpu_s is None and t["container"].stage == "select"
    a = os.path.join(tmp, "inst.json")
    with open(a, "w") as f:
        json.dump([{"instance_id": "x", "repo": "r", "PASS_TO_PASS": '["t1", "t2"]'},
                   {"repo": "no id"}], f)
    inst = R.read_instances(spark, a, fmt="json")
    assert inst.count() == 1
    assert sorted(r.test for r in R.pass_to_pass(inst).collect()) == ["t1", "t2"]


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "success_rate_among_all" in df.columns


def test_stream_vote_multi_epoch(spark, tmp):
    import uuid
    src = os.path.join(tmp, "votes")
    out = os.path.join(tmp, "decisions")
    schema = "ballot string, voted string, vote_idx long"
    # ballot x (n=3): a, a decided in epoch 0 (2 > 1.5); its late vote b is ignored
    # ballot y (n=3): a, b in epoch 0 (undecided), b in epoch 1 -> b wins by majority
    spark.createDataFrame([("x", "a", 0), ("x", "a", 1), ("y", "a", 0), ("y", "b", 1)], schema) \
        .coalesce(1).write.parquet(os.path.join(src, "p1"))
    spark.createDataFrame([("x", "b", 2), ("y", "b", 2)], schema).coalesce(1).write.parquet(os.path.join(src, "p2"))
    ballots = spark.createDataFrame([("x", 3), ("y", 3)], "ballot string, n long")
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(src))
    q = L.stream_majority_vote(spark, stream, ballots, out, name="votes_" + uuid.uuid4().hex[:8])
    q.awaitTermination()
    dec = spark.read.parquet(os.path.join(out, "decisions"))
    got = sorted((r.ballot, r.winner, r.epoch) for r in dec.collect())
    assert got == [("x", "a", 0), ("y", "b", 1)]


def test_log_lines_line_mode_matches_whole_text(spark, tmp):
    from runlens.operators.testlogs import parse_docstring_log, read_log_lines
    p = os.path.join(tmp, "django.log")
    lines = []
    for i in range(3000):
        lines += [f"test_{i} (m.C)", f"Doc {i} ... ok" if i % 2 else f"test_{i} (m.C) ... FAIL", ""]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    a = read_log_lines(spark, p)
    b = read_log_lines(spark, p, whole_text=False)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    pa = sorted(map(tuple, parse_docstring_log(a).collect()))
    assert pa == sorted(map(tuple, parse_docstring_log(b).collect())) and len(pa) > 3000


def test_status_from_lines(spark):
    lines = spark.createDataFrame([("L", "PASSED a::t", 1), ("L", "noise", 2), ("L", "FAILED a::u", 3)],
                                  "log_id string, line string, seq long")
    got = sorted((r.test, r.status) for r in L.status_from_lines(lines).collect())
    assert got == [("a::t", "PASSED"), ("a::u", "FAILED")]


def test_trajectory_reports(spark, tmp):
    from runlens.operators.flatten import trajectory_reports
    t = json.loads(json.dumps(TRAJ))
    t["agent_steps"][0]["tool_calls"] = [{"call_id": "call-1", "name": "bash", "arguments": "{}", "id": None},
                                         {"call_id": "call-2", "name": "str_replace_based_edit_tool",
                                          "arguments": "{}", "id": None}]
    t["task"] = "x" * 60
    with open(os.path.join(tmp, "r.json"), "w") as f:
        json.dump(t, f, indent=2)
    rep = trajectory_reports(flatten_trajectories(R.read_trajectories(spark, tmp)))
    s = rep["summary"].collect()[0]
    assert s.task_preview == "x" * 50 + "..." and s.steps == 1 and s.total_tokens == 10
    calls = {r.call_id: r.result for r in rep["calls_with_results"].collect()}
    assert calls == {"call-1": "ok", "call-2": ""}
    tools = {r.tool: (r.calls, r.succeeded) for r in rep["tool_usage"].collect()}
    assert tools == {"bash": (1, 1), "strreplacebasededittool": (1, 0)}
    assert rep["model_comparison"].collect()[0].tokens == 10
