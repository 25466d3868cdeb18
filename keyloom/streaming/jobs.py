"""Job events as a stream: one summary per finished job, from keyed state in append mode.

Events are rows of EVENT: a task is registered by RECEIVED, with the number of tasks of its job, and ended by
a final status. Messages arrive at least once and in any order; nothing is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.operators.jobs import DONE, job_status
from keyloom.workers import ready

EVENT = "job_id string, task_id string, status string, submitted long, ts timestamp"
SUMMARY = "job_id string, submitted long, cached long, succeeded long, failed long, status string, finished_at timestamp"
CACHED, RECEIVED = "COMPLETED_CACHED", "RECEIVED"
#: How long a finished job, or one that was never registered, is remembered, in milliseconds.
REMEMBER = 14 * 24 * 3600 * 1000
#: State of keyed operators lives in RocksDB, not in executor heaps.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Timers fire with the next batch that has messages. Batches without any would follow each other without end, as there is always a clock to look at.
IDLE = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, per_trigger: int = 10) -> DataFrame:
    """Messages from a folder of JSON files, at most ``per_trigger`` files at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).json(folder)


def keyed(df: DataFrame) -> DataFrame:
    """Let keyed state of this session live in RocksDB, and workers find this package."""
    for setting in (STORE, IDLE):
        df.sparkSession.conf.set(*setting)
    _ = df.sparkSession.streams  # starts the registry of state stores, which tables need as well
    return ready(df)


def ended(status: str | None) -> bool:
    return status in DONE or (status or "").startswith("FAILED")


class JobCloser(StatefulProcessor):
    """Counts the tasks of a job and gives its summary when the last registered one has ended, once.

    State of a job: the latest status of each task (a map, so an event costs two look-ups however many tasks there are) and running counts.
    Of several final statuses of a task the latest counts; events of tasks that were not registered wait for their registration, and
    never count without it. When the job is done its tasks go; a mark remains until a timer takes it, so redelivered events start nothing.
    """

    def __init__(self, remember: int = REMEMBER):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", "status string, at long, known boolean")
        self.counts = handle.getValueState("counts", "submitted long, known long, cached long, succeeded long, failed long, closed boolean, timer long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        submitted, known, cached, succeeded, failed, closed, timer, last = self.counts.get() or (None, 0, 0, 0, 0, False, None, None)
        if closed:
            return
        tally = {"cached": cached, "succeeded": succeeded, "failed": failed}

        def count(status: str | None, step: int) -> None:
            if status in DONE:
                tally["succeeded"] += step
                tally["cached"] += step * (status == CACHED)
            elif ended(status):
                tally["failed"] += step

        for r in rows:
            if r.task_id is None or r.at is None or not (r.status == RECEIVED or ended(r.status)):
                continue
            last = r.at if last is None else max(last, r.at)
            status, since, registered = self.tasks.getValue((r.task_id,)) or (None, None, False) if self.tasks.containsKey((r.task_id,)) else (None, None, False)
            if r.status == RECEIVED:
                submitted = max(submitted or 0, r.submitted or 0)
                if not registered:
                    known += 1
                    count(status, 1)
                    self.tasks.updateValue((r.task_id,), (status, since, True))
            elif since is None or (since, status) < (r.at, r.status):
                if registered:
                    count(status, -1)
                    count(r.status, 1)
                self.tasks.updateValue((r.task_id,), (r.status, r.at, registered))
        done = tally["succeeded"] + tally["failed"]
        closed = bool(known) and known >= (submitted or 0) and done == known
        if closed:
            self.tasks.clear()
            status = "PARTIAL_COMPLETED" if tally["succeeded"] and tally["failed"] else "COMPLETED" if tally["succeeded"] else "FAILED"
            yield Row(job_id=key[0], submitted=known, cached=tally["cached"], succeeded=tally["succeeded"], failed=tally["failed"], status=status, finished_at=last)
        if closed or not known:  # open jobs are never forgotten
            timer = self._again(timer, timerValues)
        elif timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        self.counts.update((submitted, known, tally["cached"], tally["succeeded"], tally["failed"], closed, timer, last))

    def _again(self, timer: int | None, now: Any) -> int:
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(now.getCurrentProcessingTimeInMs()) + self.remember
        self.handle.registerTimer(timer)
        return timer

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self.counts.get()
        if state and state[6] == expiredTimerInfo.getExpiryTimeInMs():
            self.tasks.clear()
            self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def finished(events: DataFrame, remember: int = REMEMBER) -> DataFrame:
    """One row (SUMMARY) per finished job of a stream of events (EVENT), given once; on a plain table, the jobs that are finished in it."""
    if not events.isStreaming:
        return _finished(events)
    asked = keyed(events).where(F.col("job_id").isNotNull()).select("job_id", "task_id", "status", "submitted", F.unix_micros("ts").alias("at"))
    out = asked.groupBy("job_id").transformWithState(JobCloser(remember), SUMMARY.replace("timestamp", "long"), "append", "processingTime")
    return out.withColumn("finished_at", F.timestamp_micros("finished_at"))


def _finished(events: DataFrame) -> DataFrame:
    """The rules of ``JobCloser`` over a table, where all events of a job are there at once: one aggregation by task, one by job."""
    received = F.col("status") == RECEIVED
    final = F.col("status").isin(*DONE) | F.col("status").startswith("FAILED")
    valid = events.where(F.col("job_id").isNotNull() & F.col("task_id").isNotNull() & F.col("ts").isNotNull() & (received | final))
    tasks = valid.groupBy("job_id", "task_id").agg(
        F.coalesce(F.bool_or(received), F.lit(False)).alias("known"),
        F.max(F.when(received, F.coalesce("submitted", F.lit(0)))).alias("submitted"),
        F.max(F.when(final, F.struct("ts", "status")))["status"].alias("ended"),
        F.max("ts").alias("last"),
    )
    of = lambda c: F.count_if(F.col("known") & F.coalesce(c, F.lit(False)))
    ended = F.col("ended")
    counts = tasks.groupBy("job_id").agg(F.count_if("known").alias("known"), F.max("submitted").alias("stated"), of(ended == CACHED).alias("cached"), of(ended.isin(*DONE)).alias("succeeded"), of(ended.startswith("FAILED")).alias("failed"), F.max("last").alias("finished_at"))
    out = counts.where((F.col("known") > 0) & (F.col("known") >= F.col("stated")) & (F.col("succeeded") + F.col("failed") == F.col("known")))
    return out.select("job_id", F.col("known").alias("submitted"), "cached", "succeeded", "failed", job_status(F.col("succeeded"), F.col("failed")).alias("status"), "finished_at")


class FirstOnly(StatefulProcessor):
    """The first message of a key; later ones are dropped for as long as keys are remembered."""

    def __init__(self, fields: list[str], remember: int = REMEMBER):
        self.fields, self.remember = fields, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.remember)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda r: tuple((r[f] is not None, str(r[f])) for f in self.fields))  # whichever comes first, the same

    def close(self) -> None:
        pass


def first_of_key(messages: DataFrame, keys: list[str], remember: int = REMEMBER) -> DataFrame:
    """One message for each key of a stream, however often it is delivered; messages without a whole key go."""
    whole = keyed(messages).dropna(subset=keys)
    return whole.groupBy(*keys).transformWithState(FirstOnly(whole.columns, remember), whole.schema, "append", "processingTime")
