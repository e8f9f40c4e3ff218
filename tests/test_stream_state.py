"""Streams whose earlier keys live in the log: no state that grows with the
keys, late rows, replayed epochs, folds, bounded state with an event time."""

import datetime as dt
import os
import uuid

import pytest

from runlens.streaming import live as L

KEYS = ["instance_id", "phase", "test"]
STATUS = "instance_id string, phase string, test string, status string, seq long"


def _files(spark, path, batches, schema):
    """One file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        for f in os.listdir(f"{path}/{i:03d}"):
            if f.endswith(".parquet"):
                os.utime(f"{path}/{i:03d}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))


def _stream(spark, path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(path))


def _done(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


def _name():
    return "s" + uuid.uuid4().hex[:8]


def _statuses(n):
    """Batches in which a key's newest row often comes before older ones."""
    return [[(f"i{(7 * b + k) % 5}" if k else None, "validate", f"t{k % 4}", "PASSED" if (b + k) % 3 else "FAILED", (b * 13 + k * 7) % 31 * 100 + b)
             for k in range(12)] for b in range(n)]


def _latest(batches):
    best = {}
    for i, p, t, s, q in (r for b in batches for r in b):
        best[i, p, t] = max(best.get((i, p, t), (-1, "")), (q, s))
    return {(*k, v[1]) for k, v in best.items()}


@pytest.mark.parametrize("every", [50, 3])
def test_latest_status_needs_no_state(spark, tmp, monkeypatch, every):
    monkeypatch.setattr(L, "COMPACT_EVERY", every)
    batches = _statuses(8)
    _files(spark, f"{tmp}/in", batches, STATUS)
    q = _done(L.stream_test_status(spark, _stream(spark, f"{tmp}/in", STATUS), f"{tmp}/out", name=_name()))
    assert q.lastProgress["stateOperators"] == []
    got = [tuple(r) for r in L.status_view(spark, f"{tmp}/out", KEYS).select(*KEYS, "status").collect()]
    assert len(got) == len(set(got)) and set(got) == _latest(batches)


def test_status_of_a_replayed_epoch_and_a_fold_seen_half_way(spark, tmp):
    batches = _statuses(4)
    _files(spark, f"{tmp}/in", batches, STATUS)
    out = f"{tmp}/out"
    _done(L.stream_test_status(spark, _stream(spark, f"{tmp}/in", STATUS), out, name=_name()))
    again = spark.createDataFrame(batches[2], STATUS)
    L._write_epoch(L._latest_status(again, KEYS), out, 2, KEYS)
    view = lambda: {tuple(r) for r in L.status_view(spark, out).select(*KEYS, "status").collect()}
    assert view() == _latest(batches)
    # a fold that is in its place while the epochs it holds are still there
    L._write_epoch(L._latest_status(L._read_log(spark, out, 3), KEYS), out, 2, KEYS)
    assert view() == _latest(batches)


def test_pending_keeps_no_key_in_state(spark, tmp):
    batches = [[("a", 1), ("a", 2), (None, 3)], [("b", 4), ("a", 5), (None, 6)], [("b", 7)], [("c", 8), ("c", 9)]]
    _files(spark, f"{tmp}/in", batches, "instance_id string, n long")
    out = f"{tmp}/out"
    q = _done(L.stream_pending(spark, _stream(spark, f"{tmp}/in", "instance_id string, n long"), out, name=_name()))
    assert q.lastProgress["stateOperators"] == []
    rows = spark.read.parquet(out).collect()
    assert sorted(r.instance_id or "" for r in rows) == ["", "a", "b", "c"]
    assert {r.instance_id: r.epoch for r in rows} == {"a": 0, None: 0, "b": 1, "c": 3}


def test_pending_by_event_time_forgets_old_keys_but_the_log_does_not(spark, tmp):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "instance_id string, at timestamp"
    # within two days of lateness: "late" comes with batch 2, one day behind
    batches = [[("a", day(0)), ("a", day(0)), ("b", day(0))], [("c", day(5)), ("a", day(4))], [("d", day(10)), ("late", day(4))],
               [("e", day(20)), ("a", day(19)), ("b", day(20))], [("f", day(30)), ("c", day(30))]]
    _files(spark, f"{tmp}/in", batches, schema)
    out = f"{tmp}/out"
    q = _done(L.stream_pending(spark, _stream(spark, f"{tmp}/in", schema), out, name=_name(), event_time="at", lateness="2 days"))
    rows = spark.read.parquet(out).collect()
    assert sorted(r.instance_id for r in rows) == ["a", "b", "c", "d", "e", "f", "late"]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    with pytest.raises(ValueError):
        L.stream_pending(spark, _stream(spark, f"{tmp}/in", schema), out, event_time="at")
