"""File events as streams: debounce, the dirty set, and three freshness strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.policy import hard_denied
from ..operators.state import dirty_set

QUIET = "500 milliseconds"
GIT_QUIET = "2 seconds"


def source(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Event files (path, op, seq, ts) as they arrive; a bounded number to a micro-batch."""
    return spark.readStream.schema(schema.EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def allowed(events: DataFrame) -> DataFrame:
    return events.where(~hard_denied(F.col("path")))


def debounced(events: DataFrame, quiet: str = QUIET, late: str = "10 seconds", stream: bool = True) -> DataFrame:
    """(path, op, events, first_ts, last_ts): one row per run of events of a path with no
    pause as long as ``quiet``; the last operation wins. A session window: state is kept
    per path until the watermark passes, and an event beyond it is late."""
    rows = events.withWatermark("ts", late) if stream else events
    by = rows.groupBy("path", F.session_window("ts", quiet))
    return by.agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def latest(events: DataFrame) -> DataFrame:
    """(path, seq, op): what a pause holds back to replay, each path's latest event. Partial
    aggregation keeps a row per task and path."""
    return events.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))


Handler = Callable[[DataFrame], None]


def realtime(events: DataFrame, apply: Handler, checkpoint: str, quiet: str = QUIET, trigger: str = "1 second"):
    """Debounced changes go to ``apply`` as they settle; at least once, by the checkpoint."""
    return debounced(allowed(events), quiet).writeStream.outputMode("append").foreachBatch(lambda df, _: apply(df.select("path", "op"))).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def lazy(events: DataFrame, apply: Handler, checkpoint: str):
    """What is new since the last call goes to ``apply`` once; called before a search. A
    failed call's events come again with the next."""

    def batch(df: DataFrame, _: int) -> None:
        apply(dirty_set(df))

    return allowed(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def git(log: DataFrame, reconcile: Callable[[], None], checkpoint: str, quiet: str = GIT_QUIET):
    """Any new row of the control table runs a whole reconcile once, however many they are."""

    def batch(df: DataFrame, _: int) -> None:
        if df.limit(1).count():
            reconcile()

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=quiet).start()


class Strategies:
    """One active strategy; switching flushes the old one before the new one starts."""

    def __init__(self) -> None:
        self.name, self.query = None, None

    def switch(self, name: str, start: Callable[[], object]) -> bool:
        """False if ``name`` is active already."""
        if name == self.name and self.query is not None and self.query.isActive:
            return False
        self.stop()
        self.name, self.query = name, start()
        return True

    def stop(self) -> None:
        if self.query is not None:
            if self.query.isActive:
                self.query.processAllAvailable()
                self.query.stop()
            self.name = self.query = None
