"""Streams of events: deduplication, running bests, windows, and last-write-wins tables.

Each function takes a streaming (or batch) DataFrame of (event_id, ts, user_id, event_type, value)
and stays lazy; `drain` runs a stream to the end of what is there. State has a bound in time by its
watermark where the rows it keeps would grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def identity() -> Column:
    """The source's own identity where it has one, else a hash of what makes a record the same."""
    hashed = F.concat(F.lit("h-"), F.substring(F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string"))), 1, 16))
    return F.when(F.pmod("user_id", F.lit(3)) == 0, F.concat_ws("-", F.lit("fd"), F.col("user_id").cast("string"), "event_type")).otherwise(hashed)


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The first event of each identity inside the watermark."""
    return events.withColumn("identity", identity()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["identity"])


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; an extension of what batch plans offer."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select("window.start", "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def improvements(events: DataFrame) -> DataFrame:
    """Events that are strictly better (less) than all of their user's before, as they arrive.

    State is one number for each user. Rows of a batch are taken in the order of their time; what
    arrives in a later batch never changes what an earlier one said.
    """

    def per_user(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("inf")
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = rows["value"].cummin().shift(fill_value=float("inf")).clip(upper=best)
        better = rows[rows["value"] < before]
        state.update((float(min(best, rows["value"].min())),))
        yield better[["user_id", "event_id", "value"]]

    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(
        per_user, "user_id bigint, event_id bigint, value double", "best double", "append", "NoTimeout")


#: Days after a user's first event at which the incumbent is sealed.
MARKS = [1, 3, 7, 14, 28]
DAY_US = 86_400_000_000


class Seals(StatefulProcessor):
    """A user's incumbent at marks after the first event. A mark is sealed when the watermark has passed it: an event
    of before that arrives later changes nothing any more.

    Events wait until the watermark has passed them too and are then taken in the order of their time, so
    the order in which files bring them makes no difference. A timer stands on the next thing to do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us long")
        self.best = handle.getValueState("best", "us long, event_id long, value double")
        self.sealed = handle.getValueState("sealed", "n int")
        self.waiting = handle.getListState("waiting", "us long, event_id long, value double")

    def _settled(self, user: int, until: int) -> list[tuple]:
        """Take what waits up to `until` and seal the marks up to there."""
        waiting = sorted(self.waiting.get())
        if not waiting and not self.first.exists():
            return []
        ripe = [r for r in waiting if r[0] <= until]
        if ripe and not self.first.exists():
            self.first.update((ripe[0][0],))
        best, done, out = (self.best.get() if self.best.exists() else None), (self.sealed.get()[0] if self.sealed.exists() else 0), []
        if self.first.exists():
            start = self.first.get()[0]
            marks = [start + day * DAY_US for day in MARKS]
            for row in [*ripe, (until + 1, None, None)]:
                while done < len(MARKS) and marks[done] < row[0]:
                    out.append((user, MARKS[done], best and best[1], best and best[2]))
                    done += 1
                if row[1] is not None and row[2] == row[2] and (best is None or row[2] < best[2]):
                    best = tuple(row)
            self.sealed.update((done,))
            if best:
                self.best.update(best)
            if left := [tuple(r) for r in waiting if r[0] > until]:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            due = [*(r[0] for r in left), *(m for m in marks[done:])]
        else:
            due = [r[0] for r in waiting]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        return out

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(rows, columns=["user_id", "day", "event_id", "value"]).astype({"user_id": "int64", "day": "int32", "event_id": "Int64", "value": "Float64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            for us, event_id, value in frame[["us", "event_id", "value"]].itertuples(index=False):
                if us > passed:  # what comes behind the watermark is too late
                    self.waiting.appendValue((int(us), int(event_id), float(value)))
        yield from self._out(self._settled(key[0], passed))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._out(self._settled(key[0], timerValues.getCurrentWatermarkInMs() * 1000))

    def close(self) -> None:
        pass


def sealed(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, day, event_id, value) of each mark once it is sealed; the stream form of as-of checkpoints."""
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Seals(), outputStructType="user_id long, day int, event_id long, value double", outputMode="Append", timeMode="EventTime")


def latest_table(events: DataFrame, path: str, checkpoint: str) -> Any:
    """Last-write-wins by (user, type): each batch is reduced to its last records and added to a log
    from which `read_latest` takes the last of all; batch numbers make a repeated batch harmless."""

    def add(batch: DataFrame, number: int) -> None:
        rest = F.struct("ts", "event_id", "value")
        last = batch.groupBy("user_id", "event_type").agg(F.max(rest).alias("r")).select("user_id", "event_type", "r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    rest = F.struct("ts", "event_id", "value")
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.max(rest).alias("r")).select("user_id", "event_type", "r.*")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet, and read that."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
