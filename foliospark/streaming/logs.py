"""Log streams: lines until a job's terminal one, its last step, and the batch twins of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lines that end a job's log.
TIMED_OUT = "__TIMEOUT__"
TERMINAL = ("__DONE__", "__ERROR__", TIMED_OUT)
#: Fixed value: how a log line announces a step.
STEP = r"(?i)\bSTEP\s+(\d+)"


def log_stream(spark: SparkSession, path: str, schema: str = "job_id string, ts timestamp, line string, received_at timestamp", files_per_trigger: int = 4) -> DataFrame:
    """Log events from Parquet files as they arrive, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow_job(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    """The lines to show of one job's part of a batch, given whether it had ended. A job that had ended, by a line or by time, stays so."""
    if state.hasTimedOut:
        ended = state.exists and state.get[0]
        state.update((True,))  # a late line of an ended job is not shown, whenever it comes
        yield pd.DataFrame({"job_id": [] if ended else [key[0]], "line": [] if ended else [TIMED_OUT]})
        return
    ended = state.exists and state.get[0]
    rows = pd.concat(list(batches)).sort_values(["ts", "received_at"], kind="stable")
    out = []
    for line in rows["line"] if not ended else ():
        out.append(line)
        if line in TERMINAL:
            ended = True
            break
    state.update((bool(ended),))
    if not ended:
        state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame({"job_id": [key[0]] * len(out), "line": out})


def until_terminal(events: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """(job_id, line) of a stream, up to and with each job's terminal line; a job that is silent for too long ends with TIMED_OUT.

    Timeouts fire in batches without data, so a run that is to end with the available data has
    spark.sql.streaming.noDataMicroBatches.enabled off. State is one flag for each job, kept when it ended; lines are ordered within a batch by ts and received_at, and a
    batch is bounded by log_stream's files per trigger. Null jobs and lines are dropped.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return follow_job(key, batches, state, timeout_ms)

    kept = events.where("job_id is not null and line is not null").select("job_id", "ts", "received_at", "line")
    return kept.groupBy("job_id").applyInPandasWithState(follow, "job_id string, line string", "ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def last_steps(events: DataFrame) -> DataFrame:
    """(job_id, step, last_ts): highest step announced by each job; works on a stream (update mode) and on a table alike. Partial maxima are taken before the shuffle."""
    step = F.try_to_number(F.nullif(F.regexp_extract("line", STEP, 1), F.lit("")), F.lit("999999")).cast("int")
    return events.where("job_id is not null").groupBy("job_id").agg(F.coalesce(F.max(step), F.lit(0)).alias("step"), F.max("ts").alias("last_ts"))


def steps_alive(steps: DataFrame, now, hours: int = 24) -> DataFrame:
    """Steps whose last event isn't older than their time to live."""
    return steps.where(F.col("last_ts") >= now - F.expr(f"interval {hours} hours"))


def until_terminal_table(events: DataFrame) -> DataFrame:
    """The same as until_terminal for a table: lines by ts and received_at up to the first terminal one of each job.

    Only the time of the first terminal line is found by job (a partial minimum), then joined: no job's lines are sorted in one task.
    """
    kept = events.where("job_id is not null and line is not null").dropDuplicates(["job_id", "ts", "line", "received_at"])
    place = F.struct("ts", "received_at", "line")
    ends = kept.where(F.col("line").isin(*TERMINAL)).groupBy("job_id").agg(F.min(place).alias("_end"))
    return kept.join(ends, "job_id", "left").where(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run work on each micro-batch; the checkpoint makes a restart go on where it stopped (a queue's worker)."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's lines to files that others may read as a stream."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
