"""Golden values for patch, reply, log, JSON and document functions."""

from pyspark.sql import functions as F

from runlens.functions import jsonpath as J
from runlens.functions import patch as P
from runlens.functions import replies as R
from runlens.operators import docedit as E
from runlens.operators import instances as I
from runlens.operators import testlogs as T

DIFF_A = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,2 +1,2 @@
 ctx = 0
-x = 1
+x  =  2   # tweak
+
+# whole-line comment
+s = "#not a comment"
"""
DIFF_B = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,2 +1,2 @@
 ctx = 0
-x = 1
+x = 2
+s = "#not a comment"  # trailing
"""


def _one(spark, col, *vals, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in vals], schema).select(col).collect()]


def test_clean_patch_equal_up_to_whitespace_and_comments(spark):
    df = spark.createDataFrame([(1, DIFF_A), (2, DIFF_B)], "id int, patch string")
    keys = {r.id: r.cleaned for r in P.with_clean_patch(df).collect()}
    assert keys[1] == keys[2] == '-x=1+x=2+s="#notacomment"'


def test_drop_test_files_golden(spark):
    diff = ("diff --git a/tests/test_example.py b/tests/test_example.py\n--- a/tests/test_example.py\n"
            "+++ b/tests/test_example.py\n@@ -1 +1 @@\n-a\n+b\n")
    kept, = _one(spark, P.drop_test_files(F.col("v")), diff)
    assert kept == ""
    mixed = "preamble\n" + diff.replace("tests/test_example.py", "src/app.py") + diff
    kept, = _one(spark, P.drop_test_files(F.col("v")), mixed)
    assert kept == "preamble\n" + diff.replace("tests/test_example.py", "src/app.py")


def test_index_selection_golden(spark):
    got, = _one(spark, R.parse_index_selection(F.col("v"), 20), "[0, 17, 42, 17, 99")
    assert got == [0, 17]
    got, = _one(spark, R.parse_index_selection(F.col("v"), 20), "[3, 99999999999999")
    assert got == [3]


def test_selection_reply(spark):
    vals = ["### Status: succeed\n### Result: Patch-2\n### Analysis: fine",
            "Status: success\nResult: Patch-9\nAnalysis: x", "no decision",
            "Status: successful\nResult: Patch-2\nmore words\nAnalysis: split"]
    got = _one(spark, R.selection_choice(F.col("v"), 3), *vals)
    assert got == [2, 1, None, None]


def test_split_tool_output(spark):
    got, = _one(spark, R.split_tool_output(F.col("v")), "a\nTool Call Status: -1\nb")
    assert (got.content, got.success) == ("a\nb", False)
    # the status line is found after stripping but compared raw
    got, = _one(spark, R.split_tool_output(F.col("v")), "a\n  Tool Call Status: -1\nb")
    assert (got.content, got.success) == ("a\nb", True)
    got, = _one(spark, R.split_tool_output(F.col("v")), "a\nb")
    assert (got.content, got.success) == ("a\nb", True)
    codes = _one(spark, R.exit_code(F.col("v")), " 12 \nx\n3", "none")
    assert codes == [3, None]


def test_step_tags(spark):
    got = _one(spark, R.step_label(R.step_tags(F.col("v"))),
               "<tags>WRITE_FIX, VERIFY_FIX</tags>", "<tags>THINK,BOGUS</tags>", "nothing")
    assert got == ["📝WRITE_FIX · 🔥VERIFY_FIX", "", ""]
    d, = _one(spark, R.task_description(F.col("v")), "fix it</task><details>why</details>")
    assert (d.task, d.details) == ("fix it", "[italic]why[/italic]")


def test_sympy_log_golden(spark):
    lines = ["sympy/a/test_x.py[3]", "test_a ok", "test_b F", "sympy/b/test_y.py[1]", "test_a s"]
    df = spark.createDataFrame([("L", i + 1, l) for i, l in enumerate(lines)], "log_id string, line_no long, line string")
    got = {r.test: r.status for r in T.parse_grouped_log(df).collect()}
    assert got == {"sympy/a/test_x.py::test_a": "PASSED", "sympy/a/test_x.py::test_b": "FAILED",
                   "sympy/b/test_y.py::test_a": "SKIPPED"}


def test_django_log_golden(spark):
    lines = ["test_a (m.C) ... ok", "test_b (m.C)", "Doc text ... ok", "", "Orphan doc ... FAIL",
             "Applying x...test_c (m.C) ... ok", "test_d (m.C) ... skipped 'r'", "FAIL: test_a (m.C)"]
    df = spark.createDataFrame([("L", i + 1, l) for i, l in enumerate(lines)], "log_id string, line_no long, line string")
    got = {r.test: r.status for r in T.parse_docstring_log(df).collect()}
    assert got == {"test_a (m.C)": "FAILED", "test_b (m.C)": "PASSED", "Doc text": "PASSED",
                   "Orphan doc": "FAILED", "test_c (m.C)": "PASSED", "test_d (m.C)": "SKIPPED"}


def test_forward_fill_across_chunks(spark):
    rows = [("L", i, f"h{i}" if i % 7 == 0 else None) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    got = {r.n: r.f for r in T.forward_fill(df, "k", "n", "v", "f", chunk=10).collect()}
    for i in range(1, 200):
        assert got[i] == (None if i < 7 else f"h{7 * (i // 7)}")


def test_test_selector_golden(spark):
    rows = [("i", "django/django", 1, "test_x (a.b.C)"), ("i", "django/django", 2, "--version is equivalent"),
            ("j", "pylint-dev/pylint", 1, "t.py::f[/c]"), ("j", "pylint-dev/pylint", 2, "t.py::f[/d]")]
    df = spark.createDataFrame(rows, "instance_id string, repo string, pos long, name string")
    got = sorted((r.instance_id, r.ord, r.directive) for r in T.test_selector(df).collect())
    assert got == [("i", 1, "a.b.C.test_x"), ("i", 2, "--version is equivalent"), ("j", 1, "t.py::f")]


def test_join_issue_text_golden(spark):
    df = spark.createDataFrame([([("T1", "B1"), ("T2", None)],)], "issues array<struct<title:string,body:string>>")
    got = df.select(I.join_issue_text(F.col("issues"))).collect()[0][0]
    assert got == "T1\nB1\nT2\n"


DOC = '{"users":[{"id":1,"name":"Alice"},{"id":2,"name":"Bob"}],"config":{"enabled":true}}'


def test_json_edits_golden():
    import json
    d, _, n, e = J.edit(DOC, "$.config.enabled", "set", "false")
    assert e is None and json.loads(d)["config"]["enabled"] is False
    d, _, _, _ = J.edit(DOC, "$.users[0].name", "set", '"Alicia"')
    assert json.loads(d)["users"][0]["name"] == "Alicia"
    d, _, _, _ = J.edit(DOC, "$.users[2]", "add", '{"id":3,"name":"Cy"}')
    assert len(json.loads(d)["users"]) == 3
    d, _, _, _ = J.edit(DOC, "$.config.version", "add", '"1.0"')
    assert json.loads(d)["config"]["version"] == "1.0"
    d, _, _, _ = J.edit(DOC, "$.users[0]", "remove", None)
    assert json.loads(d)["users"][0]["name"] == "Bob"
    d, _, _, _ = J.edit(DOC, "$.config.enabled", "remove", None)
    assert "enabled" not in json.loads(d)["config"]
    _, v, _, _ = J.edit(DOC, "$.users[0]", "view", None)
    assert json.loads(v) == {"id": 1, "name": "Alice"}
    _, v, n, _ = J.edit(DOC, "$..name", "view", None)
    assert json.loads(v) == ["Alice", "Bob"] and n == 2
    _, v, _, _ = J.edit(DOC, "$.users[0:1]", "view", None)
    assert json.loads(v) == {"id": 1, "name": "Alice"}
    d, _, _, e = J.edit(DOC, "$.nope", "set", "1")
    assert e == "No matches found for JSONPath: $.nope" and d == DOC


def test_json_udf_on_spark(spark):
    df = spark.createDataFrame([(DOC,)], "doc string")
    r = df.select(J.json_remove(F.col("doc"), F.lit("$.users[*]")).alias("r")).collect()[0].r
    assert r.matches == 2 and '"users": []' in r.doc


def _docs(spark, *contents):
    return spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(contents)], "path string, content string")


def test_replace_unique_golden(spark):
    docs = _docs(spark, "dup\ndup\nline3", "old_content\nline2")
    edits = spark.createDataFrame([("p0", "dup", "x"), ("p1", "old_content", "new_content")],
                                  "path string, old string, new string")
    got = {r.path: r for r in E.replace_unique(docs, edits).collect()}
    assert "in lines [1, 2]" in got["p0"].error and got["p0"].content == "dup\ndup\nline3"
    assert got["p1"].error is None and got["p1"].content == "new_content\nline2"
    assert got["p1"].snippet.startswith("     1\tnew_content")
    assert got["p1"].message.startswith("The file p1 has been edited. Here's the result of running `cat -n` on "
                                        "a snippet of p1:\n     1\tnew_content")


def test_insert_and_view_golden(spark):
    docs = _docs(spark, "line1\nline3")
    ins = spark.createDataFrame([("p0", 1, "line2")], "path string, line int, text string")
    r = E.insert_lines(docs, ins).collect()[0]
    assert r.content == "line1\nline2\nline3" and r.error is None
    views = spark.createDataFrame([("p0", None, None), ("p0", 0, 1)], "path string, start int, end int")
    got = E.view_lines(_docs(spark, "line1\nline2\nline3"), views).collect()
    whole = [g for g in got if g.start is None][0]
    assert whole.output == ("Here's the result of running `cat -n` on p0:\n"
                            "     1\tline1\n     2\tline2\n     3\tline3\n")
    bad = [g for g in got if g.start == 0][0]
    assert bad.error.startswith("Invalid `view_range`: [0, 1]. Its first element `0`")


def test_expand_tabs_matches_python(spark):
    vals = ["a\tb", "\t\tx", "abcdefgh\ti", "no tabs", "x\ty\n\tz"]
    got = _one(spark, E.expand_tabs(F.col("v")), *vals)
    assert got == [v.expandtabs() for v in vals]


def test_running_scan_matches_windows(spark):
    from pyspark.sql import Window
    from runlens.operators.scan import running
    rows = [("A" if i % 3 else "B", i, (None if i % 4 == 0 else f"v{i}"), i % 5) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "k string, n long, v string, x long")
    got = running(df, "k", "n", {"lag": ("lag", "v"), "last": ("last", "v"), "s": ("sum", "x"),
                                 "c": ("count", "v")}, chunk=7)
    w = Window.partitionBy("k").orderBy("n")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "n", F.lag("v").over(w).alias("lag"), F.last("v", True).over(wr).alias("last"),
                    F.sum("x").over(wr).alias("s"), F.count("v").over(wr).alias("c"))
    a = sorted(tuple(r) for r in got.select("k", "n", "lag", "last", "s", "c").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_tool_result_rendering_per_provider(spark):
    from runlens.operators import messages as M
    schema = ("role string, content string, "
              "tool_call struct<call_id:string,name:string,arguments:string>, "
              "tool_result struct<call_id:string,success:boolean,result:string,error:string>")
    rows = [("user", None, None, ("c1", False, "ok", "boom")),
            ("user", None, None, ("c2", False, "", None)),
            ("assistant", "", None, None),
            ("tool", "x", None, None)]
    df = spark.createDataFrame(rows, schema)
    compat = [r.chat_content for r in M.to_chat_messages(df, "compatible").collect()]
    assert compat[0] == "ok\nTool call failed with error:\nboom" and compat[1] == ""
    openai = [r.chat_content for r in M.to_chat_messages(df, "openai").collect()]
    assert openai[0] == "ok\nError: boom"
    anth = M.to_chat_messages(df, "anthropic").collect()
    assert anth[1].chat_content == "Tool execution failed without providing error details."
    assert anth[1].chat_role == "user" and anth[2].error == "Message content is required"
    assert anth[3].error == "Invalid message role: tool"
    google = M.to_chat_messages(df, "google").collect()
    assert [g.chat_role for g in google] == ["tool", "tool", "model", "model"]


def test_step_text_with_tool_calls(spark):
    from runlens.operators import messages as M
    df = spark.createDataFrame(
        [("  thinking  ", [("bash", '{"cmd": "ls"}'), ("task_done", "{}")]), ("plain", None)],
        "content string, calls array<struct<name:string,arguments:string>>")
    got = [r[0] for r in df.select(M.step_text(F.col("content"), F.col("calls"))).collect()]
    assert got == ['thinking\n\nTool calls:\n[`bash`] `{"cmd": "ls"}`\n[`task_done`] `{}`', "plain"]
    done = [r[0] for r in df.select(M.completion_task_done(F.col("calls"))).collect()]
    assert done == [True, False]


def test_budget_report_clips(spark):
    rows = [("k", i, "x" * 30) for i in range(1, 8)] + [("j", 1, "short")]
    df = spark.createDataFrame(rows, "key string, i0 long, body string")
    entry = F.concat(F.col("body"), F.lit("\n"))
    header = lambda n: F.concat(F.lit("Found "), n.cast("string"), F.lit(":\n"))
    got = {r.key: r for r in E.budget_report(df, "key", ["i0"], entry, header, budget=100,
                                             min_entry_len=4, payload=["body"]).collect()}
    full = "Found 7:\n" + "".join(f"{i}. {'x' * 30}\n" for i in range(1, 8))
    # entries 1..3 end at 9 + 3*34 = 111 > 100: the third is the crossing one, 4 remain
    assert got["k"].output == full[:100] + "\n<response clipped> 4 more entries not shown"
    assert got["k"].remaining == 4 and got["j"].output == "Found 1:\n1. short\n"
    assert got["k"].report_chars == 111  # up to and with the crossing entry


def test_budget_numbers_without_texts_and_without_a_window_over_the_key(spark):
    df = spark.createDataFrame([("k", 1, "x")], "key string, i0 long, body string")
    out = E.char_budget(df, "key", ["i0"], F.col("body"), lambda n: F.lit("h"), budget=100, payload=["body"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert windows and all("body#" not in ln for ln in windows)
    numbering = [ln for ln in windows if "row_number" in ln]
    assert numbering and all("_range" in ln for ln in numbering)


def test_json_view_prints_like_the_tool(spark):
    df = spark.createDataFrame([(1, DOC)], "id int, doc string")
    r = J.with_json_view(df, "doc", "$.users[0]", "v").collect()[0]
    assert '"id": 1' in r.v and '"name": "Alice"' in r.v and r.v.startswith("{\n  ")
    r = J.with_json_view(df, "doc", "$.users[1].name", "v").collect()[0]
    assert r.v == '"Bob"'
    r = J.with_json_view(df, "doc", "$.nope", "v").collect()[0]
    assert r.v == "No matches found for JSONPath: $.nope"


def test_assemble_step_text_matches_python(spark):
    from runlens.operators import messages as M
    texts = [f" step {i} " + "x" * (i % 7) for i in range(120)]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, step long, step_text string")
    got = {r.step: (r.block, r.context_chars) for r in M.assemble_step_text(df, limit=10).collect()}
    blocks = [f'<step id="{i + 1}">\n{t.strip()}\n</step>' for i, t in enumerate(texts)]
    for i in range(120):
        assert got[i] == (blocks[i], len("\n\n".join(blocks[: i + 1])))


def test_positions_match_row_number(spark):
    from pyspark.sql import Window
    from runlens.operators.scan import positions
    # one hot key with most rows, spread over many partitions
    df = spark.range(0, 5000, numPartitions=7).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 13).cast("string")).alias("k"),
        (F.col("id") * 7919 % 5003).alias("o"), F.col("id"))
    got = positions(df, "k", ["o", "id"], chunk=64).select("k", "id", "pos")
    ref = df.select("k", "id", (F.row_number().over(Window.partitionBy("k").orderBy("o", "id")) - 1).alias("pos"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_json_view_matches_json_dumps(spark):
    import json
    docs = ['{"a": "héllo"}', '{"a": 1.0}', '{"a": 1e20}', '{"a": 12345678901234567890}', '{"a": "q\\"x"}',
            '{"a": 0.1}', '{"a": -0.0}', '{"a": true}', '{"a": null}', '{"b": 1}', '{"a": [1, {"c": 2}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {r.id: r.v for r in J.with_json_view(df, "doc", "$.a", "v").collect()}
    for i, d in enumerate(docs):
        o = json.loads(d)
        exp = json.dumps(o["a"], indent=2, ensure_ascii=False) if "a" in o else "No matches found for JSONPath: $.a"
        assert got[i] == exp, (d, got[i], exp)


def test_strip_comment_cases():
    assert P.strip_comment('x = 1  # c') == "x = 1"
    assert P.strip_comment('s = "#not"  # yes') == 's = "#not"'
    assert P.strip_comment('f("#", x  # c') == 'f("#", x'      # comment found before the open bracket ends
    assert P.strip_comment("t = 'abc # x") == "t = 'abc"       # does not tokenize: cut at the first '#'
    assert P.strip_comment("t = 'abc ") == "t = 'abc "         # does not tokenize, no '#': unchanged


def test_with_step_text_prints_python_dicts(spark):
    from runlens.operators import messages as M
    df = spark.createDataFrame(
        [(1, " go ", [("bash", '{"cmd": "ls", "n": 1, "ok": true, "x": null}'), ("t", "not json")]),
         (2, "plain", None)],
        "id int, content string, tool_calls array<struct<name:string,arguments:string>>")
    got = {r.id: r.step_text for r in M.with_step_text(df).collect()}
    assert got[1] == "go\n\nTool calls:\n[`bash`] `{'cmd': 'ls', 'n': 1, 'ok': True, 'x': None}`\n[`t`] `not json`"
    assert got[2] == "plain"


def test_tool_call_rows_serialised_like_the_clients(spark):
    from runlens.operators import messages as M
    schema = ("role string, content string, tool_call struct<call_id:string,name:string,arguments:string>, "
              "tool_result struct<call_id:string,success:boolean,result:string,error:string>")
    df = spark.createDataFrame([("assistant", None, ("c", "bash", '{"cmd":"ls","n":1}'), None),
                                ("user", "hi", None, None)], schema)
    compat = {r.role: r.chat_content for r in M.to_chat_messages(df, "compatible").collect()}
    assert compat["assistant"] == '{"name": "bash", "arguments": {"cmd": "ls", "n": 1}}'
    assert compat["user"] == "hi"
    anth = {r.role: r.chat_content for r in M.to_chat_messages(df, "anthropic").collect()}
    assert anth["assistant"] == '{"cmd": "ls", "n": 1}'


def test_lines_cut_in_spark_are_cut_where_the_tokenizer_does(spark):
    """Random lines of quotes, marks, braces and backslashes: a line that is
    not left to the tokenizer gives what the tokenizer gives, and most lines
    with closed strings are not left to it."""
    import random
    rng = random.Random(11)
    parts = ["'", '"', "#", "\\", "{", "}", "a", " ", "=", "(", ")", "f", "r", "b", "$", "1_", "'s'", '"t u"', "'#'", '"#"', "'''", '"""', "x['k']", "é"]
    lines = ["".join(rng.choices(parts, k=rng.randint(1, 9))).rstrip() for _ in range(6000)] + ["x = " + "'a' " * 20_000 + "# c", "'" * 50_001 + "# c"]
    lines = sorted({x for x in lines if "#" in x})
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", P._needs_tokenizer(F.col("line")).alias("left"), P._cut_at_hash(F.col("line")).alias("cut"))
    rows = df.collect()
    for r in rows:
        assert r["left"] or r["cut"] == P.strip_comment(r["line"]), r["line"]
    assert not next(r["left"] for r in rows if r["line"].startswith("x = 'a' 'a'")) and sum(not r["left"] for r in rows) > 500
    one = spark.createDataFrame([("s = 'b' # c",), ('d["k"] = "v"  # c',), ("s = '#' # c",), ("u = f'{a}' # c",)], "line string").select(P._needs_tokenizer(F.col("line"))).collect()
    assert [r[0] for r in one] == [False, False, True, True]
