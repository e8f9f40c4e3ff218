"""The atomic append (K02) and lookups from the stored index."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.operators import symbols as Y
from runlens.sinks import manifest as M
from runlens.sources import symbol_index as I

SCHEMA = "instance_id string, regression_done boolean, tag string"


def rows(spark, ids, tag, done=True):
    return spark.createDataFrame([(i, done, tag) for i in ids], SCHEMA)


def seen(spark, path):
    return sorted((r["instance_id"], r["tag"]) for r in M.read_committed(spark, path, SCHEMA).collect())


def test_an_attempt_is_visible_whole_and_once(spark, tmp_path):
    path = str(tmp_path)
    assert seen(spark, path) == [] and M.committed(spark, path) == []
    got = M.append_attempt(spark, rows(spark, "ab", "1"), path, SCHEMA, "one")
    assert sorted(r["instance_id"] for r in got.collect()) == ["a", "b"]
    M.append_attempt(spark, rows(spark, "bc", "2"), path, SCHEMA, "two")
    assert seen(spark, path) == [("a", "1"), ("b", "1"), ("c", "2")]
    again = M.append_attempt(spark, rows(spark, "xyz", "3"), path, SCHEMA, "two")  # the same attempt adds nothing
    assert [r["instance_id"] for r in again.collect()] == ["c"] and seen(spark, path) == [("a", "1"), ("b", "1"), ("c", "2")]
    M.append_attempt(spark, rows(spark, "abc", "4"), path, SCHEMA, "empty")
    assert M.committed(spark, path) == ["empty", "one", "two"] and len(seen(spark, path)) == 3
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            M.append_attempt(spark, rows(spark, "a", "1"), path, SCHEMA, bad)


def test_a_task_that_fails_leaves_what_was_visible(spark, tmp_path):
    path = str(tmp_path)
    M.append_attempt(spark, rows(spark, "a", "1"), path, SCHEMA, "one")
    broken = spark.range(100, numPartitions=5).select(
        F.concat(F.lit("n"), "id").alias("instance_id"), F.lit(True).alias("regression_done"), F.when(F.col("id") == 77, F.raise_error(F.lit("task dies"))).otherwise("2").alias("tag"))
    with pytest.raises(Exception, match="task dies"):
        M.append_attempt(spark, broken, path, SCHEMA, "two")
    assert seen(spark, path) == [("a", "1")] and M.committed(spark, path) == ["one"]
    M.append_attempt(spark, rows(spark, "ab", "3"), path, SCHEMA, "two")  # the same attempt, run again
    assert seen(spark, path) == [("a", "1"), ("b", "3")]


def test_death_between_rows_and_manifest(spark, tmp_path, monkeypatch):
    """Rows are all written, the line is not: nobody sees them, another attempt
    does not count them, and the attempt run again replaces them."""
    path = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(M, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            M.append_attempt(spark, rows(spark, "ab", "dead"), path, SCHEMA, "one")
    assert os.path.isdir(f"{path}/{M.ROWS}/one") and seen(spark, path) == []
    M.append_attempt(spark, rows(spark, "a", "2"), path, SCHEMA, "two")
    M.append_attempt(spark, rows(spark, "ab", "1"), path, SCHEMA, "one")
    assert seen(spark, path) == [("a", "2"), ("b", "1")]
    rows(spark, "q", "dead").write.json(f"{path}/{M.ROWS}/three")
    M.remove_uncommitted(spark, path, ["one", "two", "three"])
    assert sorted(os.listdir(f"{path}/{M.ROWS}")) == ["one", "two"] and len(seen(spark, path)) == 2


def test_two_jobs_of_one_attempt(spark, tmp_path):
    path = str(tmp_path)
    M.append_attempt(spark, rows(spark, "a", "1"), path, SCHEMA, "one")
    with pytest.raises(FileExistsError):  # the other job reaches the manifest later
        M._commit(spark, path, "one", [])
    assert M.committed(spark, path) == ["one"] and [f for f in os.listdir(f"{path}/{M.MANIFEST}") if not f.endswith(".crc")] == ["one.json"]


def test_unfinished_keys_are_appended_again(spark, tmp_path):
    path = str(tmp_path)
    M.append_attempt(spark, rows(spark, "a", "1", done=False).union(rows(spark, "b", "1")), path, SCHEMA, "one", complete=F.col("regression_done"))
    M.append_attempt(spark, rows(spark, "ab", "2"), path, SCHEMA, "two", complete=F.col("regression_done"))
    assert seen(spark, path) == [("a", "1"), ("a", "2"), ("b", "1")]


def scanned(df):
    """Files, folders, and rows of the row groups that the scans of an executed
    plan did not skip."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = dict.fromkeys(("numFiles", "numPartitions", "numOutputRows"), 0), [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            for name in out:
                metric = node.metrics().get(name)
                out[name] += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


@pytest.fixture(scope="module")
def spans(spark):
    """A hundred thousand functions in classes of files; one name is in every
    third of them."""
    i = F.col("id")
    inner = spark.range(100_000).select(F.concat(F.lit("f"), (i / 20).cast("long")).alias("file_path"), (i % 20 + 1).alias("sid"), F.when(i % 3 == 0, "__init__").otherwise(F.concat(F.lit("name"), i)).alias("name"),
                                        F.lit("function").alias("kind"), ((i % 20) * 10 + 2).alias("start_line"), ((i % 20) * 10 + 9).alias("end_line"))
    outer = inner.select("file_path").distinct().select("file_path", F.lit(0).cast("long").alias("sid"), F.concat(F.lit("C"), "file_path").alias("name"), F.lit("class").alias("kind"),
                                                       F.lit(1).cast("long").alias("start_line"), F.lit(120).cast("long").alias("end_line"))
    return inner.unionByName(outer).withColumn("fields", F.when(F.col("kind") == "class", "- x"))


def test_stored_lookups_equal_lookups_in_spans(spark, spans, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(spans, path)
    lookups = spark.createDataFrame([("name7", "function"), ("name7", "class_method"), ("name16", "function"), ("Cf5", "class"), ("__init__", "function"), ("nothing", "class")], "identifier string, entry_type string")
    want = sorted(map(str, Y.lookup_in_spans(spans, lookups).collect()))
    got = I.lookup(spark, path, lookups)
    assert sorted(map(str, got.collect())) == want and len(want) > 10_000


def test_a_lookup_reads_the_row_groups_of_its_names(spark, spans, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(spans, path, row_group_bytes=1 << 16)
    whole = spark.read.parquet(path)
    whole.write.format("noop").mode("overwrite").save()
    everything = whole.count()
    one = I.lookup_names(spark, path, ["name77777"], "class_method")
    assert one.select("file_path", "parent_class").collect() == []
    one = I.lookup_names(spark, path, ["name77776"], "function")
    (r,) = one.collect()
    read = scanned(one)
    assert r["file_path"] == "f3888" and read["numPartitions"] == 1 and read["numOutputRows"] < everything / 20
    pushed = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in pushed and "identifier" in pushed.split("PushedFilters")[1].split("]")[0]
    few = I.lookup(spark, path, spark.createDataFrame([("name1", "class_method"), ("name2", "class_method")], "identifier string, entry_type string"))
    assert len(few.collect()) == 2 and scanned(few)["numPartitions"] <= 2
    none = I.lookup(spark, path, spark.createDataFrame([], "identifier string, entry_type string"))
    assert none.collect() == [] and scanned(none)["numFiles"] == 0
