"""Live versions of the main aggregates on Structured Streaming.

Streams read files as they land (status lines, usage records, votes,
candidate sets).  Each micro-batch writes only the keys it changed, through
``foreachBatch``, into a change log: one ``epoch=<id>`` folder per micro-batch
under the output, partitioned by a hash of the keys; a batch reads the buckets
it touches only, and old epochs are folded into one now and then.  A stream's
checkpoint, under the shared ``spark.checkpoint.dir``, belongs to its name and
output.

What a key's earlier rows say is kept in one place.  Results that may be
merged twice without harm (latest status R01, keys done R04) live in the log
alone: a batch adds its own partial result, the view merges them, and the
state store is empty however old the stream is, with no limit on late rows.
Sums and counts (R02, R03) would be doubled by a fold seen half way, so they
stay in the state store and run in ``update`` mode; of their log the newest
row per key counts (:func:`latest_view`, a partial aggregate).  No result is
collected to the driver, no trigger rewrites the whole result, and a retried
micro-batch overwrites its own epoch folder, so the sinks are idempotent; the
query checkpoint makes restarts resume without double counting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.testlogs import STATUS_LINE_RE
from ..session import checkpoint_path, has_data


BUCKETS = 64
COMPACT_EVERY = 50


def _epoch_dir(out: str, epoch: int) -> str:
    return f"{out.rstrip('/')}/epoch={epoch}"


def _bucket(keys: Sequence[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _write_epoch(batch: DataFrame, out: str, epoch: int, keys: Sequence[str]) -> None:
    """One epoch of a change log, partitioned by a hash of its keys, so that a
    later batch reads the buckets it touches and no others."""
    rows = batch.withColumn("bucket", _bucket(keys))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_epoch_dir(out, epoch))
    # a file without rows keeps the schema of a log that has none
    batch.where(F.lit(False)).coalesce(1).write.mode("overwrite").parquet(f"{_epoch_dir(out, epoch)}/bucket=-1")


def _read_log(spark: SparkSession, out: str, before: int | None = None, touched: DataFrame | None = None,
              keys: Sequence[str] = ()) -> DataFrame | None:
    """The change log written so far (optionally only epochs < ``before``, and
    only the buckets that the rows of ``touched`` fall into)."""
    if not has_data(spark, out):
        return None
    df = spark.read.parquet(out)
    if before is not None:
        df = df.where(F.col("epoch") < before)
    if touched is not None:  # at most BUCKETS numbers
        hit = [r["b"] for r in touched.select(_bucket(keys).alias("b")).distinct().collect()]
        df = df.where(F.col("bucket").isin(hit) if hit else F.lit(False))
    return df.drop("bucket")


def latest_view(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Current result of an update-mode stream: the newest row per key."""
    return _newest(_read_log(spark, out), keys)


def status_view(spark: SparkSession, out: str, keys: Sequence[str] = ("instance_id", "phase", "test")) -> DataFrame:
    """Current result of :func:`stream_test_status`: the status of the
    greatest ``seq`` per key, whatever batch it came with."""
    return _latest_status(_read_log(spark, out), keys).drop("seq")


def _newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    vals = [c for c in log.columns if c not in keys and c != "epoch"]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("epoch")).alias("_v"))
            .select(*keys, "_v.*"))


def _latest_status(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merging merged rows again changes nothing; of equal ``seq`` the
    greatest status counts, a null ``seq`` is the least."""
    return rows.groupBy(*keys).agg(F.max(F.struct("seq", "status")).alias("_v")).select(*keys, "_v.*")


def compact(spark: SparkSession, out: str, epoch: int, keys: Sequence[str], merge=_newest,
            bucket_keys: Sequence[str] | None = None) -> None:
    """Fold all epochs up to ``epoch`` into that one, so that a log is read in
    a bounded number of folders however old the stream is.  ``epoch`` must be
    one that is never written again (an earlier one than the running one).  The
    fold (``merge`` of the log and ``keys``) is written beside the log first; :func:`finish_compaction` moves it in,
    also after a crash half way."""
    log = _read_log(spark, out, before=epoch + 1)
    if log is None:
        return
    _write_epoch(merge(log, keys), _beside(out), epoch, bucket_keys or keys)
    finish_compaction(spark, out)


def _distinct(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.drop("epoch").distinct()


def _beside(out: str) -> str:
    return f"{out.rstrip('/')}.compact"


def finish_compaction(spark: SparkSession, out: str) -> None:
    """Move a completely written fold into its place and remove the epochs it
    holds.  Every step can be repeated."""
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = _beside(out)
    if not fs.exists(path(beside)):
        return
    for fold in [s.getPath() for s in fs.listStatus(path(beside))]:
        if fs.exists(path(f"{fold}/_SUCCESS")):
            epoch = int(fold.getName().split("=")[1])
            fs.delete(path(_epoch_dir(out, epoch)), True)
            fs.rename(fold, path(_epoch_dir(out, epoch)))
            for p in [s.getPath() for s in fs.listStatus(path(out))]:
                if p.getName().startswith("epoch=") and int(p.getName().split("=")[1]) < epoch:
                    fs.delete(p, True)
    fs.delete(path(beside), True)


def _compact_now(epoch: int) -> bool:
    return epoch % COMPACT_EVERY == COMPACT_EVERY - 1


def _log_writer(out: str, keys: Sequence[str]):
    def write(batch: DataFrame, epoch: int) -> None:
        finish_compaction(batch.sparkSession, out)
        _write_epoch(batch, out, epoch, keys)
        if _compact_now(epoch):
            compact(batch.sparkSession, out, epoch - 1, keys)
    return write


def _start(df: DataFrame, name: str, mode: str, fn, available_now: bool, out: str) -> StreamingQuery:
    """The checkpoint belongs to the output: two streams of one name with two
    outputs do not share what they have seen."""
    where = hashlib.sha256(out.rstrip("/").encode()).hexdigest()[:16]
    w = (df.writeStream.outputMode(mode).foreachBatch(fn).queryName(f"{name}-{where}")
         .option("checkpointLocation", checkpoint_path(df.sparkSession, f"stream-{name}-{where}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# -- R01 ---------------------------------------------------------------------
def status_from_lines(lines: DataFrame, log_id: str = "log_id") -> DataFrame:
    st = F.regexp_extract("line", STATUS_LINE_RE, 1)
    return lines.where(st != "").select(
        log_id, st.alias("status"), F.regexp_extract("line", STATUS_LINE_RE, 2).alias("test"), "seq")


def stream_test_status(spark: SparkSession, stream: DataFrame, out: str, name: str = "test_status",
                       keys=("instance_id", "phase", "test"), available_now: bool = True) -> StreamingQuery:
    """Latest status per (instance, phase, test) from status rows carrying a
    ``seq``; a run killed half way still yields its passes so far.  Read
    the result with ``status_view(spark, out, keys)``.

    A batch logs the latest status of each key among its own rows.  Nothing is
    held between batches, so rows may come as late as they like, and state
    does not grow with the keys.  Null keys are keys like any other."""
    keys = list(keys)

    def write(batch: DataFrame, epoch: int) -> None:
        finish_compaction(batch.sparkSession, out)
        _write_epoch(_latest_status(batch, keys), out, epoch, keys)
        if _compact_now(epoch):
            compact(batch.sparkSession, out, epoch - 1, keys, merge=_latest_status)

    return _start(stream, name, "append", write, available_now, out)


# -- R02 ---------------------------------------------------------------------
def stream_token_totals(spark: SparkSession, stream: DataFrame, out: str, run: str = "run_id",
                        fields=("input_tokens", "output_tokens"), name: str = "token_totals",
                        available_now: bool = True) -> StreamingQuery:
    """Running token totals per run (read with ``latest_view(spark, out, [run])``)."""
    agg = stream.groupBy(run).agg(*[F.sum(f).cast("bigint").alias(f) for f in fields])
    return _start(agg, name, "update", _log_writer(out, [run]), available_now, out)


# -- R03 ---------------------------------------------------------------------
def decide_winners(counts: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """Winner rule of A04 on (ballot, voted, cnt, first_idx) counts: an id
    past n/2 wins; otherwise, once all n votes are in, most votes with ties
    to the first seen.  ``n`` per ballot defaults to the votes counted."""
    tot = counts.groupBy("ballot").agg(F.sum("cnt").alias("n_cast"))
    c = counts.join(tot, "ballot")
    c = c.join(n, "ballot") if n is not None else c.withColumn("n", F.col("n_cast"))
    best = c.groupBy("ballot").agg(
        F.max_by(F.struct("voted", "cnt"), F.struct("cnt", -F.col("first_idx"))).alias("w"),
        F.max("n").alias("n"), F.max("n_cast").alias("n_cast"))
    decided = (F.col("w.cnt") * 2 > F.col("n")) | (F.col("n_cast") >= F.col("n"))
    return best.where(decided).select("ballot", F.col("w.voted").alias("winner"))


def stream_majority_vote(spark: SparkSession, votes: DataFrame, ballots: DataFrame, out: str,
                         name: str = "majority_vote", available_now: bool = True) -> StreamingQuery:
    """Emit one decision per ballot once an id passes n/2 or all n votes are
    in; later votes are ignored.  ``ballots`` is a static (ballot, n) table.

    Each micro-batch logs the (ballot, id) counts it changed under
    ``out/counts``, re-decides only the ballots it touched (their full counts
    come from the count log), and appends decisions for ballots not decided
    in an earlier epoch under ``out/decisions``.  The winner does not depend
    on vote order (see A04), so late or unordered votes are safe."""
    counts = votes.groupBy("ballot", "voted").agg(F.count(F.lit(1)).alias("cnt"),
                                                 F.min("vote_idx").alias("first_idx"))
    count_log, decision_log = f"{out.rstrip('/')}/counts", f"{out.rstrip('/')}/decisions"

    def write(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        for log in (count_log, decision_log):
            finish_compaction(s, log)
        _write_epoch(batch, count_log, epoch, ["ballot"])
        touched = batch.select("ballot").distinct()
        log = _read_log(s, count_log, touched=touched, keys=["ballot"])
        if log is None:
            return
        full = _newest(log, ["ballot", "voted"]).join(touched, "ballot", "left_semi")
        dec = decide_winners(full, ballots.join(touched, "ballot", "left_semi"))
        done = _read_log(s, decision_log, epoch, touched, ["ballot"])
        if done is not None:
            dec = dec.join(done.select("ballot"), "ballot", "left_anti")
        _write_epoch(dec, decision_log, epoch, ["ballot"])
        if _compact_now(epoch):
            compact(s, count_log, epoch - 1, ["ballot", "voted"], bucket_keys=["ballot"])
            compact(s, decision_log, epoch - 1, ["ballot"], merge=_distinct)

    return _start(counts, name, "update", write, available_now, out)


def vote_decisions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/decisions").select("ballot", "winner")


# -- R04 ---------------------------------------------------------------------
def stream_pending(spark: SparkSession, stream: DataFrame, out: str, key: str = "instance_id",
                   name: str = "pending", available_now: bool = True, event_time: str | None = None,
                   lateness: str | None = None) -> StreamingQuery:
    """Process each instance once across restarts: a batch writes the keys
    that no earlier epoch holds, one row each, so the output holds every key
    exactly once (a null key too).  The log answers for all earlier keys, at
    any age; no key is kept in state.

    With ``event_time`` and ``lateness`` (an interval such as ``"1 hour"``)
    repeats are dropped in the state store first while their key is that
    recent, and only the others are looked up in the log.  State then holds
    the keys of the last ``lateness`` of event time.  Rows further behind the
    newest event time of earlier batches than ``lateness`` are late to Spark
    and not processed; without the two parameters there are no such rows."""
    if (event_time is None) != (lateness is None):
        raise ValueError("event_time and lateness belong together")
    if event_time is not None:
        stream = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        finish_compaction(s, out)
        batch = batch.dropDuplicates([key]).persist()
        try:
            fresh, seen = batch, _read_log(s, out, epoch, batch, [key])
            if seen is not None:
                # the log's rows of this batch's keys first: the small side is
                # the batch there, which an anti join could not broadcast
                mine = batch.select(F.col(key).alias("_key"))
                seen = seen.select(F.col(key).alias("_seen"))
                seen = seen.join(mine, F.col("_seen").eqNullSafe(F.col("_key")), "left_semi")
                fresh = batch.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
            _write_epoch(fresh, out, epoch, [key])
        finally:
            batch.unpersist()
        if _compact_now(epoch):
            compact(s, out, epoch - 1, [key], merge=_distinct)

    return _start(stream, name, "append", write, available_now, out)
