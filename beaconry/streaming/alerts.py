"""Alert batches with their items, by count and by processing-time timer.

High items of a channel are dealt over lanes, so a channel that sends a third of
all rows is many tasks' work. A lane keeps its waiting items in list state (fewer
than ``size`` after every trigger) and the time of its timer; a batch leaves when
``size`` items have gathered, or when ``seconds`` have passed since the lane began
to wait after its last batch. Timer leftovers of a channel's lanes that leave in
the same trigger are merged into one batch (at most lanes x (size - 1) items).
"""
from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "channel string, reason string, items array<string>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Lane(StatefulProcessor):
    """State of one (channel, lane)."""

    def __init__(self, size: int, seconds: float):
        self.size, self.wait = size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "item string")
        self.timer = handle.getValueState("timer", "at long")

    def _stop_timer(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [row[0] for row in self.waiting.get()] if self.waiting.exists() else []
        sent = False
        for chunk in rows:
            held += chunk["item"].tolist()
            full = len(held) // self.size
            if full:
                sent = True
                batches = [held[i * self.size : (i + 1) * self.size] for i in range(full)]
                held = held[full * self.size :]
                yield pd.DataFrame({"channel": [key[0]] * full, "reason": ["full"] * full, "items": batches})
        if held:
            self.waiting.put([(item,) for item in held])
        elif self.waiting.exists():
            self.waiting.clear()
        if sent or not held:
            self._stop_timer()
        if held and not self.timer.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [row[0] for row in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        self.timer.clear()
        if held:
            yield pd.DataFrame({"channel": [key[0]], "reason": ["timer"], "items": [held]})

    def close(self) -> None:
        pass


def alerts(rows: DataFrame, lane: Column, size: int = 10, seconds: float = 600) -> DataFrame:
    """channel, reason, items of a stream of channel, severity, item; ``lane`` deals a channel's items."""
    high = rows.where((F.col("severity") == "High") & F.col("item").isNotNull())
    keyed = high.select(F.coalesce("channel", F.lit("unknown")).alias("channel"), lane.cast("int").alias("lane"), F.col("item").cast("string").alias("item"))
    return keyed.groupBy("channel", "lane").transformWithStateInPandas(Lane(size, seconds), SCHEMA, "Append", "ProcessingTime")


def merged(batch: DataFrame) -> DataFrame:
    """A trigger's batches, with the lanes' timer leftovers as one batch a channel."""
    rest = batch.where("reason = 'timer'").groupBy("channel", "reason").agg(F.flatten(F.collect_list("items")).alias("items"))
    return batch.where("reason = 'full'").unionByName(rest)


@contextmanager
def timed_state(spark: SparkSession):
    """List state and timers need the RocksDB state store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_until_quiet(stream: DataFrame, folder: str, seconds: float, most: float = 600) -> DataFrame:
    """Drive ``alerts`` over what has arrived and until the timers behind it have fired; the
    batches are read back. Each trigger writes a folder of its own, so one that is run again replaces its rows.

    A timer is due ``seconds`` after the start of the trigger that set it at the latest; the stream rests once a
    trigger that began after the last of these times is finished, however long triggers take."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        merged(batch).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    with timed_state(spark):
        query = stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(keep).start()
        try:
            began = time.time()
            due, seen, rests = float("inf"), -1, False
            while not rests:
                if query.exception() is not None:
                    raise query.exception()
                if time.time() - began > most:
                    raise TimeoutError(f"the stream did not come to rest within {most} seconds")
                for progress in query.recentProgress:
                    start = datetime.fromisoformat(progress["timestamp"]).timestamp()
                    if progress["numInputRows"]:
                        if progress["batchId"] > seen:
                            end = start + progress["durationMs"].get("triggerExecution", 0) / 1000
                            seen, due = progress["batchId"], end + seconds
                    elif "addBatch" in progress["durationMs"] and start > due:
                        rests = True
                time.sleep(0.5)
        finally:
            query.stop()
    return spark.read.schema(SCHEMA + ", epoch int").parquet(f"{folder}/out").drop("epoch")
