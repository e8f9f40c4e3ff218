"""K02 as an atomic, repeatable append.

A run of a job that resumes is an attempt with a name.  Its rows are written to
a folder of that name, which no reader looks into; one small file in the
manifest then makes the folder visible, all of it or nothing.  An attempt that
died before that leaves rows nobody sees and is written anew under its name; an
attempt that is in the manifest adds nothing when it is run again."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.candidates import pending_instances

ROWS, MANIFEST = "attempts", "manifest"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the attempts that are visible, in order of name."""
    files, make = _files(spark, path)
    folder = make(f"{path}/{MANIFEST}")
    if not files.exists(folder):
        return []
    return sorted(s.getPath().getName().removesuffix(".json") for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))


def read_committed(spark: SparkSession, path: str, schema: str, attempts: list[str] | None = None) -> DataFrame:
    """Rows of the visible attempts (or of some of them).  Malformed rows
    raise (FAILFAST), like the reference refusing to resume over a corrupt
    file."""
    names = committed(spark, path) if attempts is None else attempts
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path}/{ROWS}/{n}" for n in names])


def append_attempt(spark: SparkSession, new: DataFrame, path: str, schema: str, attempt: str,
                   key: str = "instance_id", complete: Column | None = None) -> DataFrame:
    """Append the rows of ``new`` whose ``key`` no visible attempt has
    (completely, by ``complete``).  Returns the rows of the attempt.

    The same attempt again, after it became visible, adds nothing, whatever
    ``new`` is then.  A failure at any moment leaves the visible rows as they
    were.  Two jobs with different attempts may both append a key that neither
    sees of the other; with one attempt the later to commit fails."""
    if not NAME.fullmatch(attempt):
        raise ValueError(f"not the name of an attempt: {attempt!r}")
    done = committed(spark, path)
    if attempt not in done:
        old = read_committed(spark, path, schema, done) if done else None
        todo = new if old is None else pending_instances(new, old, key, complete)
        todo.write.mode("overwrite").json(f"{path}/{ROWS}/{attempt}")
        _commit(spark, path, attempt, done)
    return read_committed(spark, path, schema, [attempt])


def _commit(spark: SparkSession, path: str, attempt: str, seen: list[str]) -> None:
    """Put the attempt into the manifest: its line is written aside and
    renamed, which succeeds once."""
    files, make = _files(spark, path)
    aside, target = make(f"{path}/{MANIFEST}/.{attempt}-{uuid.uuid4().hex}"), make(f"{path}/{MANIFEST}/{attempt}.json")
    line = files.create(aside, False)
    line.write(bytearray(json.dumps({"attempt": attempt, "after": seen}).encode()))
    line.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise FileExistsError(f"attempt {attempt} is in the manifest already")


def remove_uncommitted(spark: SparkSession, path: str, attempts: list[str]) -> None:
    """Delete the rows of ``attempts`` that never became visible; visible ones
    stay.  (Only whoever named an attempt knows that it is not running.)"""
    files, make = _files(spark, path)
    for name in set(attempts) - set(committed(spark, path)):
        if NAME.fullmatch(name):
            files.delete(make(f"{path}/{ROWS}/{name}"), True)
