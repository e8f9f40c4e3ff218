"""Sequences of edits (F11-F13, W09 in turn), character budgets and dyadic
containment, each against a plain version."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import docedit, edit_chain, symbols

EDITS = "path string, seq long, command string, old string, new string, line long, text string"


class PlainTool:
    """The edit tool with a history of whole texts."""

    def __init__(self, files):
        self.files, self.history = dict(files), defaultdict(list)

    def run(self, path, command, old, new, line, text):
        """True if the edit was applied."""
        have = self.files.get(path)
        if (have is None) != (command == "create"):
            return False
        if command == "create":
            if text is None:
                return False
            self.files[path] = text
            self.history[path].append(text)
        elif command == "str_replace":
            if old is None:
                return False
            have, old = have.expandtabs(), old.expandtabs()
            if have.count(old) != 1:
                return False
            self.files[path] = have.replace(old, (new or "").expandtabs())
            self.history[path].append(have)
        elif command == "insert":
            if line is None or new is None:
                return False
            have = have.expandtabs()
            lines = have.split("\n")
            if not 0 <= line <= len(lines):
                return False
            self.files[path] = "\n".join(lines[:line] + new.expandtabs().split("\n") + lines[line:])
            self.history[path].append(have)
        elif command == "undo_edit":
            if not self.history[path]:
                return False
            self.files[path] = self.history[path].pop()
        return command in ("create", "str_replace", "insert", "undo_edit", "view")


text = st.text(st.sampled_from("ab\t\n é"), max_size=12)
edit = st.tuples(st.sampled_from(["create", "str_replace", "insert", "undo_edit", "undo_edit", "view", "nonsense", None]), st.one_of(st.none(), text),
                 st.one_of(st.none(), text), st.one_of(st.none(), st.integers(-1, 6)), st.one_of(st.none(), text))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), text), st.lists(edit, max_size=25))
def test_history_of_splices_is_a_history_of_texts(start, edits):
    plain = PlainTool({} if start is None else {"p": start})
    doc = edit_chain.Document(start)
    for command, old, new, line, body in edits:
        status, *_ = doc.apply(command, old, new, line, body)
        done = plain.run("p", command, old, new, line, body)
        assert done == (status in ("created", "replaced", "inserted", "undone", "viewed"))
        assert doc.text == plain.files.get("p") and len(doc.history) == len(plain.history["p"])


def test_single_edits_say_what_the_single_edit_operators_say(spark):
    docs = spark.createDataFrame([("a", "one\ttwo\nthree\none"), ("b", "\n".join(f"line {k}" for k in range(30)) + "\n\tlast")], "path string, content string")
    swaps = spark.createDataFrame([("a", "three", "3\t3\nx"), ("b", "line 17", None), ("a", "one", "x"), ("a", "zzz", "x")], "path string, old string, new string")
    want = {(r["path"], r["error"], r["message"], r["content"]) for r in docedit.replace_unique(docs, swaps).collect() if r["error"] is None}
    for k in range(2):
        one = swaps.limit(2).where(F.col("path") == "ab"[k]).withColumn("seq", F.lit(1)).withColumn("command", F.lit("str_replace"))
        (r,) = edit_chain.edit_sequence(docs, one).collect()
        assert (r["path"], r["error"], r["message"], r["content"]) in want
    failed = swaps.where("new = 'x'").withColumn("seq", F.length("old")).withColumn("command", F.lit("str_replace"))
    errors = {r["error"] for r in docedit.replace_unique(docs, swaps).collect()} - {None}
    assert {r["error"] for r in edit_chain.edit_sequence(docs, failed).collect()} == errors and len(errors) == 2
    inserts = spark.createDataFrame([("a", 1, "new\tline"), ("b", 31, "end"), ("b", 99, "x")], "path string, line int, text string")
    want = {(r["path"], r["error"], r["message"]) for r in docedit.insert_lines(docs, inserts).collect()}
    got = set()
    for row in inserts.collect():
        one = spark.createDataFrame([(row["path"], 1, "insert", None, row["text"], row["line"], None)], EDITS)
        (r,) = edit_chain.edit_sequence(docs, one).collect()
        got.add((r["path"], r["error"], r["message"]))
    assert got == want


def test_each_edit_sees_the_text_before_it(spark):
    docs = spark.createDataFrame([("a", "x = 1\ny = 2"), ("still", "here")], "path string, content string")
    rows = [("a", 2, "str_replace", "x = 1\nz", "w", None, None), ("a", 1, "insert", None, "z = 3", 1, None), ("a", 3, "str_replace", "nowhere", "w", None, None),
            ("a", 4, "undo_edit", None, None, None, None), ("a", 5, "insert", None, "end", 3, None), ("new", 1, "create", None, None, None, "n"), ("new", 2, "create", None, None, None, "m"), ("none", 1, "view", None, None, None, None)]
    got = {(r["path"], r["seq"]): r for r in edit_chain.edit_sequence(docs, spark.createDataFrame(rows, EDITS).repartition(3), versions=True).collect()}
    assert [got["a", k]["content"] for k in range(1, 6)] == ["x = 1\nz = 3\ny = 2", "w = 3\ny = 2", "w = 3\ny = 2", "x = 1\nz = 3\ny = 2", "x = 1\nz = 3\ny = 2\nend"]
    assert [got["a", k]["depth"] for k in range(1, 6)] == [1, 2, 2, 1, 2] and [got["a", k]["error"] is None for k in range(1, 6)] == [True, True, False, True, True]
    assert got["new", 2]["error"].startswith("File already exists at: new") and got["none", 1]["error"].startswith("The path none does not exist")
    ends = {r["path"]: tuple(r)[1:] for r in edit_chain.edited_documents(docs, spark.createDataFrame(rows, EDITS)).collect()}
    assert ends == {"a": ("x = 1\nz = 3\ny = 2\nend", 4, 1, 2), "new": ("n", 1, 1, 1), "still": ("here", 0, 0, 0)}


def test_a_document_with_many_edits_streams_through(spark):
    """40 000 edits of one document, dealt over many partitions."""
    n = 40_000
    edits = spark.range(n, numPartitions=16).select(
        F.lit("log").alias("path"), F.col("id").alias("seq"), F.when(F.col("id") % 5 == 4, "undo_edit").otherwise("str_replace").alias("command"),
        F.lit("@").alias("old"), F.concat(F.lit("@"), (F.col("id") % 10).cast("string")).alias("new"))
    docs = spark.createDataFrame([("log", "start @")], "path string, content string")
    (r,) = edit_chain.edited_documents(docs, edits).collect()
    body = []
    for k in range(n):
        if k % 5 == 4:
            body.pop()
        else:
            body.append(str(k % 10))
    assert (r["edits"], r["failed"], r["depth"]) == (n, 0, len(body)) and r["content"] == "start @" + "".join(reversed(body))


def test_versions_of_one_document_are_made_by_many_tasks(spark, monkeypatch):
    """A log that 4000 edits write to at its top (F2): its versions, 100 MB, are
    made by many tasks, and are what a plain tool makes of them."""
    monkeypatch.setattr(edit_chain, "SEGMENT_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(edit_chain, "SEGMENT_VERSIONS", 64, raising=False)
    rows = [("log", -1, "create", None, None, None, "end\tof log")] + [("log", k, "undo_edit" if k % 7 == 3 else "insert", None, f"entry {k} \u00e9", 0, None) for k in range(4000)]
    docs = spark.createDataFrame([("a", "x")], "path string, content string")
    edits = spark.createDataFrame([*rows, ("a", 1, "view", None, None, None, None)], EDITS).repartition(5)
    done = edit_chain.edit_sequence(docs, edits, versions=True).select("path", "seq", "depth", "last", F.md5("content").alias("md5"), F.spark_partition_id().alias("task"))
    got = {r["seq"]: r for r in done.where("path = 'log'").collect()}
    assert len({r["task"] for r in got.values()}) > 8
    plain = PlainTool({})
    for _, seq, *edit_ in rows:
        plain.run("log", *edit_)
        assert (got[seq]["md5"], got[seq]["depth"], got[seq]["last"]) == (hashlib.md5(plain.files["log"].encode()).hexdigest(), len(plain.history["log"]), seq == 3999)
    assert len(got) == len(rows) and done.where("path = 'a'").count() == 1


def test_segments_have_what_one_pass_has(spark, monkeypatch):
    """Random edits of many documents, in one pass and in segments of some
    edits, with all versions or their MD5; a path may be null."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab\t\n \u00e9") for _ in range(rng.randrange(6)))
    docs = [(f"p{k}", "".join(word() for _ in range(6))) for k in range(12)] + [("p1", "a"), ("none", None)]
    rows = [(rng.choice([None, "none", *[f"p{k}" for k in range(16)]]), k, rng.choice(["create", "str_replace", "insert", "insert", "undo_edit", "view", None]), rng.choice("ab\t\n \u00e9"),
             rng.choice([None, word()]), rng.randrange(-1, 6), rng.choice([None, word()])) for k in range(700)]
    docs, edits = spark.createDataFrame(docs, "path string, content string").withColumn("many", F.lit("p1")), spark.createDataFrame(rows, EDITS).repartition(3)
    monkeypatch.setattr(edit_chain, "SEGMENT_BYTES", 40 << 10)
    monkeypatch.setattr(edit_chain, "SEGMENT_VERSIONS", 1)
    got = {}
    for many in (-1, 1 << 40):  # all paths, none
        monkeypatch.setattr(edit_chain, "MANY_BYTES", many)
        for digest in (False, True):
            out = edit_chain.edit_sequence(docs, edits, versions=True, digest=digest)
            got[many, digest] = sorted(map(tuple, (out if digest else out.withColumn("content", F.md5("content"))).collect()), key=lambda r: r[1])
    assert len(got[-1, False]) == len(rows) and all(x == got[-1, False] for x in got.values())
    assert len({r[7] for r in got[-1, True]}) > 50 and sum(r[4] is not None for r in got[-1, True]) > 100


def test_lines_are_numbered_as_by_the_single_edit_operators(spark):
    """Also with tabs behind a carriage return, and cut at the tool's limit."""
    texts = ["", "a\tb\n\t\tc\r\td\n", "\u00e9\t" * 9000, "x" * 16000, "x\n" * 8000 + "y", "line\n" * 20_000]
    rows = spark.createDataFrame([(k, x, first) for k, x in enumerate(texts) for first in (1, 999_990)], "k int, x string, first int")
    for r in rows.withColumn("want", docedit.numbered(F.col("x"), F.col("first"))).collect():
        assert edit_chain._numbered(edit_chain.Text(r["x"].encode()).shown(), r["first"]) == r["want"]


def test_an_edit_copies_the_pieces_it_is_in():
    """A long text is not copied by an edit, wherever it is (F2)."""
    rng = random.Random(3)
    plain = "".join(rng.choice(["line \u00e9\n", "x", "\n"]) for _ in range(100_000))
    doc = edit_chain.Document(plain)
    for k in range(120):
        lines = doc.now.lines
        old = list(map(id, doc.now.pieces))
        line = [0, lines, rng.randrange(lines)][k % 3]
        status, _, first, shown = doc.insert(line, "new\nlines" if k % 5 else "y" * 100_000)
        assert status == "inserted" and len(set(map(id, doc.now.pieces)) & set(old)) >= len(old) - 1
        parts = plain.split("\n")
        parts[line:line] = ["new", "lines"] if k % 5 else ["y" * 100_000]
        plain = "\n".join(parts)
        assert shown == "\n".join(parts[max(0, line - 4):line + (6 if k % 5 else 5)])[:16001] and first == max(1, line - 3)
        if k % 4 == 3:
            before = doc.history[-2:]
            for _ in before:
                assert doc.undo()[3] == doc.text[:16001]
            plain = doc.text
        assert doc.text == plain and doc.now.size == len(plain.encode()) and doc.now.lines == plain.count("\n") + 1
    assert doc.now.digest() == hashlib.md5(plain.encode()).hexdigest() and max(map(len, doc.now.pieces)) <= 2 * edit_chain.PIECE


def test_awkward_edits(spark):
    docs = spark.createDataFrame([(None, "no path"), ("n", None), ("twice", "b"), ("twice", "a")], "path string, content string")
    rows = [(None, 1, "view", None, None, None, None), ("n", None, "insert", None, "x", 0, None), ("twice", 1, "str_replace", "a", None, None, None),
            ("twice", 1, "str_replace", "a", None, None, None), ("twice", 0, None, None, None, None, None), ("twice", 2, "insert", None, None, 1, None)]
    edits = spark.createDataFrame(rows, EDITS).withColumn("content", F.lit("clash")).withColumn("is_edit", F.lit(0))
    got = edit_chain.edit_sequence(docs, edits).orderBy("path", "seq").collect()
    assert [(r["path"], r["error"] is None, r["last"], r["content"]) for r in got] == [
        (None, False, True, None), ("n", True, True, "x\n"), ("twice", False, False, None), ("twice", True, False, None), ("twice", False, False, None), ("twice", False, True, "")]
    assert edit_chain.edit_sequence(docs, edits.where("false")).collect() == [] and edit_chain.edit_sequence(docs.where("false"), edits).count() == 6
    only = edits.where("path = 'n'").select("path", "seq", "command", "new", "line")  # columns of other commands may be missing
    assert edit_chain.edited_documents(docs.where("path = 'n'"), only).first()["content"] == "x\n"


@pytest.mark.parametrize("least", [1, 5])
def test_budget_matches_a_plain_sum(spark, least):
    """Keys of very different sizes, one with half of all entries, ties in
    length, and empty bodies."""
    rows = [(k, i, "b" * ((i * 7 + k) % 9 if k else i % 3)) for k, size in enumerate([4000, 1, 40, 900]) for i in range(size)]
    rows = [(k, i, b if least == 1 else b + "xx") for k, i, b in rows]
    df = spark.createDataFrame(rows, "k long, i_ long, b string").repartition(7)
    for budget in (0, 10, 300, 100_000):
        got = {(r["k"], r["i_"]): (r["i"], r["cum_chars"], r["remaining"], r["clipped"])
               for r in docedit.char_budget(df, "k", ["i_"], F.col("b"), lambda n: F.concat(F.lit("h"), n.cast("string")), budget, least, ["b"]).collect()}
        want = {}
        for k in range(4):
            own = [(i, b) for q, i, b in rows if q == k]
            spent, shown = 1 + len(str(len(own))), []
            for at, (i, b) in enumerate(own, 1):
                if spent > budget:
                    break
                spent += len(str(at)) + 2 + len(b)
                shown.append((i, at, spent))
            for i, at, upto in shown:
                want[k, i] = (at, upto, len(own) - len(shown) if spent > budget else 0, spent > budget)
        assert got == want


def test_dyadic_ranges_make_up_the_whole(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a, 40)] + [(0, 10**6), (12345, 9876543), (2**40 - 1, 2**41)]
    df = spark.createDataFrame(pairs, "low long, high long").withColumn("r", symbols.dyadic_ranges(F.col("low"), F.col("high")))
    for r in df.collect():
        parts = sorted((x["index"] << x["level"], (x["index"] + 1) << x["level"]) for x in r["r"])
        assert parts[0][0] == r["low"] and parts[-1][1] == r["high"] + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) <= 2 * max(1, (r["high"] - r["low"] + 1).bit_length())


def test_a_huge_container_is_copied_a_few_times(spark):
    """One file of a million lines: a class over all of it, a class over its
    second half, and many functions; the join reads a few rows a container."""
    lines = 1_000_000
    big = [("f", 0, "Big", "class", 1, lines), ("f", 1, "Half", "class", lines // 2, lines)]
    small = spark.range(20_000).select(F.lit("f").alias("file_path"), (F.col("id") + 2).alias("sid"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"),
                                       F.lit("function").alias("kind"), (F.col("id") * 50 + 1).alias("start_line"), (F.col("id") * 50 + 9).alias("end_line"))
    spans = spark.createDataFrame(big, "file_path string, sid long, name string, kind string, start_line long, end_line long").unionByName(small)
    got = symbols.enclosing_symbol(spans).groupBy("parent_class").count().collect()
    assert {r["parent_class"]: r["count"] for r in got} == {"Big": 10_000, "Half": 10_000}
    copies = spans.where("kind = 'class'").select(F.size(symbols.dyadic_ranges(F.floor(F.col("start_line") / 64), F.floor(F.col("end_line") / 64))).alias("n")).collect()
    assert max(r["n"] for r in copies) <= 2 * 14


def plain_parents(spans):
    """(file, sid) -> names of the innermost function and class, by loops."""
    out = {}
    for f, sid, _, kind, s, e in spans:
        if kind == "function" and None not in (f, s, e):
            best = {}
            for pf, psid, pname, pkind, ps, pe in spans:
                if pf == f and psid != sid and None not in (ps, pe) and ps <= s and pe >= e:
                    best[pkind] = max(best.get(pkind, ((-1,),)), ((ps, -pe, -psid), pname, ps, pe))
            fn, c = best.get("function"), best.get("class")
            inside = fn and c and fn[2] >= c[2] and fn[3] <= c[3]
            out[f, sid] = (fn[1] if fn and (not c or inside) else None, c[1] if c and (not fn or not inside) else None)
    return out


def test_parents_come_from_one_shuffle_of_the_spans(spark, monkeypatch):
    """Spans that are equal, nested, crossed and over many blocks of lines
    (F6, F7), whatever rows are solved at a time; nothing is joined unless a
    container goes over the end of its block."""
    rng = random.Random(6)
    schema = "file_path string, sid long, name string, kind string, start_line long, end_line long"
    spans = []
    for f, lines in (("a", 40), ("b", 900), ("c", 6000), ("d", 200_000), ("e", 12)):
        for sid in range(60):
            s = rng.randrange(1, lines)
            spans.append((f, sid, f"{f}{sid}", rng.choice(["function", "function", "class"]), s, min(lines, s + int(rng.paretovariate(0.4)))))
    spans += [(None, 1, "x", "function", 1, 2), ("e", 90, "x", "function", None, 2), ("e", 91, "x", "class", 1, None)]
    df = spark.createDataFrame(spans, schema).repartition(5)
    want = plain_parents(spans)
    for rows in (1, 1 << 15):
        monkeypatch.setattr(symbols, "BLOCK_ROWS", rows)
        got = {(r.file_path, r.sid): (r.parent_function, r.parent_class) for r in symbols.enclosing_symbol(df).collect()}
        assert got == want and len({p for p in got.values()}) > 20
    some = symbols.enclosing_symbol(df, functions=df.where("kind = 'function' and sid % 3 = 0")).collect()
    assert {(r.file_path, r.sid): (r.parent_function, r.parent_class) for r in some} == {k: v for k, v in want.items() if k[1] % 3 == 0}
    plan = symbols.enclosing_symbol(df.where("file_path in ('a', 'b', 'e')"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_entries_without_text_are_counted_and_not_shown(spark):
    """What is left out counts all entries of a key (F7), also those of no
    text, from one pass over the entries."""
    rows = [("a", i, None if i % 3 == 0 else "x" * 40) for i in range(200)] + [("b", 1, None), (None, 1, "x")]
    df = spark.createDataFrame(rows, "k string, o long, t string")
    kept = docedit.char_budget(df, "k", ["o"], F.col("t"), lambda n: n.cast("string"), budget=400)
    got = sorted((r.k, r.o, r.i, r.n, r.remaining) for r in kept.collect())
    assert [x[1] for x in got] == [i for i in range(200) if i % 3][:len(got)] and [x[2] for x in got] == list(range(1, len(got) + 1))
    assert {(x[0], x[3], x[4]) for x in got} == {("a", 200, 200 - len(got))} and len(got) == 10
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
