"""Structured Streaming over the events table, run to its end and returned as a DataFrame.

Every stream reads the table with ``trigger(availableNow=True)``, keeps its
checkpoint in the shared folder and writes Parquet there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.shared import shared_path
from ..sources import table

STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with ``ts`` as a timestamp that watermarks accept."""
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(build: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, mode: str = "append", keyed_state: bool = False) -> DataFrame:
    """Run ``build`` on the events until all are read. In ``complete`` mode the last table of results.

    Both sinks survive a repeated batch: appended rows go to the file sink, which lists the
    files of each batch once; a complete result replaces the one before. ``keyed_state``
    keeps state in the store that transformWithState needs, for this stream only.
    """
    root = shared_path(spark, "stream")
    frame = build(events_stream(spark, sf_dir))
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{root}/out")
    else:
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out"))
    before = spark.conf.get(STORE)
    if keyed_state:
        spark.conf.set(STORE, KEYED_STORE)
    try:
        writer.start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(frame.schema).parquet(f"{root}/out")


def records(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows, by event id, whose value is above all before them."""
    rows = rows.sort_values("event_id")
    return rows[rows["value"] > rows["value"].cummax().shift(1, fill_value=float("-inf"))]


def changes(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows at which the best value so far of a user improves; the best is kept as state.

    A record of all rows is a record of its Arrow batch too, so only records are held from one batch to the next.
    """
    best = state.get[0] if state.exists else float("-inf")
    out = None
    for rows in batches:
        rows = rows[rows["value"] > best]
        out = records(rows if out is None else pd.concat([out, rows]))
    if len(out):
        best = float(out["value"].iloc[-1])
    state.update((best,))
    yield pd.DataFrame({"user_id": out["user_id"], "event_id": out["event_id"], "value": out["value"]})


def change_events(stream: DataFrame) -> DataFrame:
    rows = stream.select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(changes, "user_id long, event_id long, value double", "best double", "append", GroupStateTimeout.NoTimeout)


class RecentCache(StatefulProcessor):
    """The latest ``size`` events of a user as state; what is pushed out leaves oldest first.

    The state is one list of at most ``size`` rows. An event older than all that are held
    is pushed out at once, so in the end the same events are out in whatever order they came.
    """

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ts timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.held.get()), columns=["ts", "event_id"])
        for frame in rows:
            new = frame[["ts", "event_id"]]
            kept = (new if kept.empty else pd.concat([kept, new])).sort_values(["ts", "event_id"], ignore_index=True)
            out, kept = kept.iloc[: -self.size], kept.iloc[-self.size :]
            if len(out):
                yield pd.DataFrame({"user_id": key[0], "event_id": out["event_id"].to_numpy()})
        self.held.put([(r.ts.to_pydatetime(), int(r.event_id)) for r in kept.itertuples()])

    def close(self) -> None:
        pass


class FrameFold(StatefulProcessor):
    """Folds the daily frames of a user in order, each once it and the ``ahead`` frames after it are complete.

    Rows are added up by day in a map; a timer for each day fires when the watermark has passed
    the last day that the frame looks ahead to. Complete frames are then taken in order: the flow carried from
    frame to frame is two parts of the flow before and one of the step, and the frame's residual is
    what the last position and flow did not predict. Days without events are no frames. A frame that
    has been folded is evicted; only as many days stay as the watermark still leaves open.
    """

    def __init__(self, ahead: int):
        self.ahead = ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "day long", "total double, n long")
        self.carried = handle.getValueState("carried", "position double, flow double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, part in frame.groupby("day")["value"]:
                at = (int(day),)
                total, n = self.frames.getValue(at) if self.frames.containsKey(at) else (0.0, 0)
                self.frames.updateValue(at, (total + float(part.sum()), n + len(part)))
                self.handle.registerTimer((int(day) + 1 + self.ahead) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        held = {d[0]: v for d, v in self.frames.iterator()}
        mean = {d: total / n for d, (total, n) in held.items()}
        position, flow = self.carried.get() if self.carried.exists() else (None, 0.0)
        out = []
        for day in sorted(held):
            if day + 1 + self.ahead > passed:
                break
            step = 0.0 if position is None else mean[day] - position
            out.append((key[0], day, held[day][1], mean[day], step - flow, *(mean.get(day + k) if k <= self.ahead else None for k in (1, 2))))
            position, flow = mean[day], (2 * flow + step) / 3
            self.frames.removeKey((day,))
        if out:
            self.carried.update((position, flow))
            yield pd.DataFrame(out, columns=["user_id", "day", "n", "position", "residual", "next1", "next2"])

    def close(self) -> None:
        pass


def bounded_cache(stream: DataFrame, size: int) -> DataFrame:
    """(user_id, event_id) of events pushed out of the cache of their user."""
    rows = stream.select("user_id", "event_id", "ts").groupBy("user_id")
    return rows.transformWithStateInPandas(RecentCache(size), "user_id long, event_id long", "Append", "None")


def folded_frames(stream: DataFrame, ahead: int, late: str = "1 day") -> DataFrame:
    """(user_id, day, n, position, residual, next1, next2) of complete frames; ``next*`` need a look ahead."""
    day = F.floor(F.unix_millis("ts") / DAY_MS).alias("day")
    rows = stream.withWatermark("ts", late).select("user_id", "ts", "value", day).groupBy("user_id")
    schema = "user_id long, day long, n long, position double, residual double, next1 double, next2 double"
    return rows.transformWithStateInPandas(FrameFold(ahead), schema, "Append", "EventTime")
