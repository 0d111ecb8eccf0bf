"""Structured Streaming over audit and review events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; works on a stream and on a table. ``late`` None: the stream has its watermark already."""
    base = events.withWatermark(ts, late) if events.isStreaming and late else events
    return base.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def once_each(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


#: Batches of a stream after which its tables are written together.
COMPACT = 16


def upsert_latest(decisions: DataFrame, path: str, checkpoint: str, compact: int = COMPACT):
    """Keep the last decision of each case and finding. A batch adds one small table of its own, named by its stream and number,
    so a replayed batch writes the same table again and a stream with a new checkpoint adds to what is there; ``current`` reads
    them as one. Every ``compact`` batches what the stream has is written together as one table, so a reader meets at most
    ``compact`` tables and one, however old the stream; tables that the one before has made obsolete go."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, DECISION, LAST).write.mode("overwrite").parquet(f"{path}/{stream}-{number:012d}")
        if (number + 1) % compact == 0:
            old = [f for f in live(spark, path) if f.startswith(stream) and int(f[-12:]) <= number]
            whole = latest(spark.read.parquet(*(f"{path}/{f}" for f in old)), DECISION, LAST)
            whole.coalesce(max(1, spark.sparkContext.defaultParallelism // 2)).write.mode("overwrite").parquet(f"{path}/{stream}-upto-{number:012d}")
            before = number - compact
            for f in folders(spark, path):
                # a reader that began before this compaction may still read what the last one left
                if f.startswith(stream) and (int(f[-12:]) < before if "-upto-" in f else int(f[-12:]) <= before):
                    _delete(spark, f"{path}/{f}")

    return decisions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The finished tables below a folder, by any file system that Spark reads."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if n[-12:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def live(spark: SparkSession, path: str) -> list[str]:
    """The tables that count: of each stream the newest that was written together, and the batches after it."""
    names = folders(spark, path)
    upto: dict[str, int] = {}
    for n in names:
        if "-upto-" in n:
            upto[n.split("-")[0]] = max(upto.get(n.split("-")[0], -1), int(n[-12:]))
    return [n for n in names if (int(n[-12:]) == upto[n.split("-")[0]] if "-upto-" in n else int(n[-12:]) > upto.get(n.split("-")[0], -1))]


DECISION, LAST = ["case_id", "finding_id"], ["updated_at", "status"]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of each case and finding in what ``upsert_latest`` has written."""
    return latest(spark.read.parquet(*(f"{path}/{f}" for f in live(spark, path))), DECISION, LAST)


def with_decisions(findings: DataFrame, decisions: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``case_id, finding_id, found_at, status, decided_at``: each finding of a stream with the decisions made on it within ``wait``.

    ``findings(case_id, finding_id, found_at)``, ``decisions(case_id, finding_id, status, decided_at)``. Both streams carry watermarks and the
    join a time range, so state is dropped once no decision can come any more; a finding without one is PENDING then. A decision
    before its finding or after ``wait`` doesn't count; several within it are a row each. Works on tables too.
    """
    marked = lambda df, ts: df.withWatermark(ts, late) if df.isStreaming else df
    f = marked(findings.select("case_id", "finding_id", "found_at"), "found_at")
    d = marked(decisions.select(F.col("case_id").alias("_case"), F.col("finding_id").alias("_finding"), "status", "decided_at"), "decided_at")
    within = (F.col("case_id") == F.col("_case")) & (F.col("finding_id") == F.col("_finding")) & (F.col("decided_at") >= F.col("found_at")) & (F.col("decided_at") <= F.col("found_at") + F.expr(f"INTERVAL {wait}"))
    return f.join(d, within, "leftOuter").select("case_id", "finding_id", "found_at", F.coalesce("status", F.lit("PENDING")).alias("status"), "decided_at")


def complete_cases(documents: DataFrame, expected: int = 3, wait_ms: int = 3_600_000) -> DataFrame:
    """``case_id, n_docs, complete`` when a case's documents have all come, or when it has waited too long.

    ``documents(case_id string, doc_id string, ts timestamp)`` is a stream with a watermark on ``ts``. A finished case is
    remembered for as long as it might have waited, so documents that come late for it don't report it again.
    """
    done = "\0"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split("\n")) if state.exists else set()
        out = lambda done: pd.DataFrame({"case_id": [key[0]], "n_docs": [len(seen)], "complete": [done]})
        if state.hasTimedOut:
            state.remove()
            if done not in seen:
                yield out(False)
            return
        if done not in seen:
            for pdf in batches:
                seen |= set(pdf.doc_id)
            if len(seen) >= expected:
                yield out(True)
                seen = {done}
        state.update(("\n".join(sorted(seen)),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + wait_ms)

    return documents.groupBy("case_id").applyInPandasWithState(step, "case_id string, n_docs long, complete boolean", "seen string", "append", "EventTimeTimeout")
