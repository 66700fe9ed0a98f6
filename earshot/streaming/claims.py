"""Claims of episodes as keyed state of a stream.

The log of a queue is a table of events of episodes. Each episode's status is state under its id, and only the task that holds
the id changes it, so a claim is the compare-and-set of one row: a pending episode becomes processing, and a claim with the
number of the attempt comes out. Whoever takes the claim appends ``done`` or ``failed`` with that number. A timer gives a claim a lease;
when it ends with the episode still processing, the episode is claimed anew under the next number, and the late worker's event, of an old
number, is ignored. What the checkpoint replays after a crash gives the same claims again, as state and timers are of the
checkpoint too.

Events (``event``): ``ready`` makes a new episode pending; ``retry`` a failed one; ``reindex`` one that is done; ``done`` and
``failed`` end the attempt they name. Any other event, and one that doesn't fit the status, changes nothing. Of one batch,
events of an episode count in the order of ``seq``; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

EVENT = "episode_id long, event string, attempt int, seq long"
CLAIM = StructType([StructField("episode_id", LongType()), StructField("attempt", IntegerType())])
_STATE = StructType([StructField("status", StringType()), StructField("attempt", IntegerType())])
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: From a status to another, by event; those of an attempt name it.
STEPS = {("new", "ready"): "pending", ("failed", "retry"): "pending", ("done", "reindex"): "pending"}
ENDS = ("done", "failed")


def step(status: str, attempt: int, event: str | None, of: int | None) -> str:
    """The status after an event."""
    if event in ENDS:
        return event if status == "processing" and of == attempt else status
    return STEPS.get((status, event), status)


class Claims(StatefulProcessor):
    def __init__(self, lease_seconds: float) -> None:
        self.lease = int(lease_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", _STATE)

    def _held(self) -> tuple[str, int]:
        got = self.state.get() if self.state.exists() else None
        return (got[0], got[1]) if got else ("new", 0)

    def _claimed(self, key: tuple, attempt: int, timers) -> Iterator[Row]:
        self.state.update(("processing", attempt))
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.lease)
        yield Row(episode_id=key[0], attempt=attempt)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        status, attempt = self._held()
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)):
            status = step(status, attempt, r.event, r.attempt)
        if status == "pending":
            yield from self._claimed(key, attempt + 1, timerValues)
        elif status != "new":
            self.state.update((status, attempt))
            if status in ENDS:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, attempt = self._held()
        if status == "processing":
            yield from self._claimed(key, attempt + 1, timerValues)

    def close(self) -> None:
        pass


def claims(events: DataFrame, lease_seconds: float) -> DataFrame:
    """episode_id and attempt of each claim that a stream of ``events`` (EVENT) gives."""
    events.sparkSession.conf.set(*_PROVIDER)
    return events.where("episode_id is not null").groupBy("episode_id").transformWithState(Claims(lease_seconds), CLAIM, "Append", "ProcessingTime")


def run_claims(
    spark: SparkSession, log: str, work: Callable[[DataFrame, str], DataFrame], checkpoint: str, lease_seconds: float = 3600.0, once: bool = True, seconds: float = 10.0,
) -> StreamingQuery:
    """Work on what the events in ``log`` (Parquet folders below it) make due. ``work`` gets each batch of claims and a name that is the same
    when the batch is tried again; what it returns (episode_id, attempt, event) is appended to the log under that name, once."""
    arriving = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(log)

    def each(batch: DataFrame, n: int) -> None:
        ended = work(batch, f"batch-{n:09d}").select("episode_id", "event", "attempt", F.lit(n).cast("long").alias("seq"))
        ended.write.mode("overwrite").parquet(f"{log}/ended-{n:09d}")

    writer = claims(arriving, lease_seconds).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    # One batch takes all there is. ``availableNow`` would not end, as a stream with timers always has another batch to run.
    writer = writer.trigger(once=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
