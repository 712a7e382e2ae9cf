"""Structured Streaming: traversals and their metrics, appended contact, moving statistics, camera sets, pulses, tracker events.

Frames carry an event time. A synthetic clock of one second per frame keeps frame gaps exact at any frame rate. Rows
later than the watermark are dropped; :class:`LateRows` counts them.
"""
from __future__ import annotations

import bisect
import pickle
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from treadline.operators.contact import frames_of_traversals
from treadline.operators.sync import role_sets, twice_median
from treadline.sources.readers import tracker_events

WATERMARK = "2 seconds"


def frame_clock(frame: Column) -> Column:
    """Event time of a frame: one second per frame since the epoch."""
    return F.timestamp_seconds(frame)


def stream_traversals(frames: DataFrame, active: Column, keys: Sequence[str] = ("trial_id",), min_frames: int = 20,
                      empty_frames: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Traversals as session windows over the frames with contact; a session emits once the watermark has passed it.

    The window merges steps of exactly ``empty_frames`` and splits beyond. What is still open when the stream ends is
    closed by :func:`open_traversals` on the stored frames.
    """
    d = frames.withColumn("_t", frame_clock(F.col("frame"))).withWatermark("_t", watermark).where(active)
    g = d.groupBy(*keys, F.session_window("_t", f"{empty_frames} seconds")).agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    return (g.where(F.col("_b") - F.col("_a") >= min_frames)
            .select(*keys, (F.col("_a") + 1).alias("start"), (F.col("_b") + 1).alias("end")))


def open_traversals(frames: DataFrame, emitted: DataFrame, active: Column, keys: Sequence[str] = ("trial_id",),
                    min_frames: int = 20, empty_frames: int = 30) -> DataFrame:
    """Traversals that a stream had still open when it ended: the same sessions over the stored frames that come after the
    last traversal emitted for their key. With ``emitted`` they are all traversals of the recording."""
    last = emitted.groupBy(*keys).agg(F.max("end").alias("_end"))
    rest = frames.where(active).join(last, list(keys), "left").where(F.col("_end").isNull() | (F.col("frame") >= F.col("_end")))
    return stream_traversals(rest.drop("_end"), active, keys, min_frames, empty_frames)


class LateRows:
    """Counts the rows that a query drops for arriving after the watermark.

    Spark keeps only the latest progress entries of a query, so :meth:`update` adds up those that are new since the last
    call. Where entries were lost between two calls it fails instead of giving too low a number.
    """

    def __init__(self, query, first_batch: int = 0):
        self.query, self.rows, self._next, self._times = query, 0, first_batch, set()

    def update(self) -> int:
        new = [p for p in self.query.recentProgress if p["batchId"] >= self._next - 1 and p["timestamp"] not in self._times]
        for p in new:
            if p["batchId"] > self._next:
                raise ValueError("progress entries were lost; update more often or keep more of them")
            self._next = max(self._next, p["batchId"] + 1)
            self.rows += sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
        self._times = {p["timestamp"] for p in self.query.recentProgress}
        return self.rows


def metrics_per_traversal(traversals: DataFrame, contact_path: str, sink: Callable[[DataFrame, int], None],
                          suite: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict):
    """Run a metric suite on the contact frames of every closed traversal of a micro-batch.

    Each traversal becomes a trial of its own (``<trial>#<start>``) with frames counted from its start.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.sparkSession.read.parquet(contact_path)
        sink(suite(frames_of_traversals(rows, df)), epoch)
    return traversals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_camera_sets(frames: DataFrame, timeout: str, n_roles: int = 4, watermark: str = WATERMARK) -> DataFrame:
    """Complete sets of frames of all roles per frame number, with their spread in ms.

    ``frames`` has ``role, frame_number, ts, timestamp_ns``. A set is closed once no frame with its number has come for
    ``timeout``. A role contributes its latest timestamp; the deviation is measured from the median of the set.
    :func:`open_camera_sets` gives the sets that are still open when the stream ends.
    """
    g = (frames.withWatermark("ts", watermark).groupBy("frame_number", F.session_window("ts", timeout))
         .agg(F.collect_set(F.struct("role", "timestamp_ns")).alias("r")))
    roles = F.array_distinct(F.col("r.role"))
    newest = F.transform(roles, lambda o: F.array_max(F.transform(
        F.filter("r", lambda x: x["role"] == o), lambda x: x["timestamp_ns"])))
    g = g.select("frame_number", F.array_sort(newest).alias("t")).where(F.size("t") >= n_roles)
    t = F.col("t")
    worst = F.array_max(F.transform(t, lambda x: F.abs(2 * x - twice_median(t)))) / 2e6
    return g.select("frame_number", F.size(t).alias("n_roles"), worst.alias("worst_ms"))


def open_camera_sets(frames: DataFrame, emitted: DataFrame, n_roles: int = 4) -> DataFrame:
    """Complete sets among the stored frames whose number the stream had not emitted when it ended."""
    rest = frames.join(emitted.select("frame_number"), "frame_number", "left_anti")
    return role_sets(rest, n_roles=n_roles).select("frame_number", F.col("n_roles").cast("int").alias("n_roles"), "worst_ms")


def stream_events(lines: DataFrame) -> DataFrame:
    """Tracker events of a stream of log lines."""
    return tracker_events(lines)


def stream_liveness(pulses: DataFrame, hz: float, key: str = "source") -> DataFrame:
    """Pulse liveness per source: a heartbeat per micro-batch with pulses, and one ``alive = false`` record once no pulse
    has come for two periods. ``pulses`` has ``source, ts``."""
    quiet_ms = max(int(2000.0 / float(hz)), 1)

    def step(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            count, last = state.get
            state.remove()
            yield pd.DataFrame({key: [ids[0]], "count": [count], "last_pulse": [pd.Timestamp(last, unit="us")], "alive": [False]})
            return
        count, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            count += len(pdf)
            last = max(last, int(pdf["ts"].max().value // 1000))
        state.update((count, last))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({key: [ids[0]], "count": [count], "last_pulse": [pd.Timestamp(last, unit="us")], "alive": [count > 0]})

    kind = dict(pulses.dtypes)[key]
    return pulses.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, count long, last_pulse timestamp, alive boolean", "count long, last long", "update", "ProcessingTimeTimeout")


def append_contact(frames: DataFrame, path: str, checkpoint: str, trigger: dict, keys: Sequence[str] = ("trial_id", "limb"), watermark: str = "1 hour"):
    """Append the frames of a stream to a table of contact, each frame of a channel once.

    Frames that are sent again within the ``watermark`` of the frame clock are dropped. Each micro-batch is a folder of the table named by its number and ordered by channel and frame; one
    that is run again after a failure replaces its folder, so nothing is lost or doubled. The table is read back with ``spark.read.parquet(path)``; its column ``batch`` tells the folder.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        df.sortWithinPartitions(*keys, "frame").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    # The first watermark is the epoch, and a row at it would be late.
    once = (frames.withColumn("_t", frame_clock(F.col("frame") + 1)).withWatermark("_t", watermark)
            .dropDuplicatesWithinWatermark([*keys, "frame"]).drop("_t"))
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class SlidingRanks:
    """The last ``window`` values in the order of their ranks: a value that comes or goes shifts the middle by one place at most, and nothing is sorted again. Missing values take a place in the window and no rank."""

    def __init__(self, window: int) -> None:
        self.window, self.values, self.ranked = window, deque(), []

    def push(self, value: float | None) -> None:
        self.values.append(value)
        if value is not None:
            bisect.insort(self.ranked, value)
        if len(self.values) > self.window:
            gone = self.values.popleft()
            if gone is not None:
                del self.ranked[bisect.bisect_left(self.ranked, gone)]

    def median(self) -> float | None:
        n = len(self.ranked)
        return (self.ranked[(n - 1) // 2] * 0.5 + self.ranked[n // 2] * 0.5) if n else None

    def save(self) -> list:
        return list(self.values)

    def load(self, values: list) -> None:
        self.values, self.ranked = deque(values), sorted(x for x in values if x is not None)


class BackgroundState:
    """Moving-median background of one channel, refreshed and held as in ``series.rolling_background``."""

    def __init__(self, window: int, warmup: int, every: int) -> None:
        self.ranks, self.warmup, self.every, self.seen, self.latest = SlidingRanks(window), warmup, every, 0, deque(maxlen=every)

    def step(self, value: float | None) -> float | None:
        self.ranks.push(value)
        self.seen += 1
        due = self.seen >= 2 and (self.seen <= self.warmup or self.seen % self.every == 0)
        self.latest.append(self.ranks.median() if due else None)
        return next((x for x in reversed(self.latest) if x is not None), None)

    def save(self) -> tuple:
        return self.ranks.save(), self.seen, list(self.latest)

    def load(self, saved: tuple) -> None:
        self.ranks.load(saved[0])
        self.seen = saved[1]
        self.latest.extend(saved[2])


class RateState:
    """Frames per second over the last ``window`` timestamps, as in ``series.frame_rate``."""

    def __init__(self, window: int) -> None:
        self.times: deque = deque(maxlen=window)

    def step(self, seconds: float) -> float | None:
        self.times.append(seconds)
        passed = seconds - self.times[0]
        return (len(self.times) - 1) / passed if len(self.times) >= 2 and passed > 0 else None

    def save(self) -> list:
        return list(self.times)

    def load(self, saved: list) -> None:
        self.times.extend(saved)


def _stream_in_order(frames: DataFrame, keys: Sequence[str], value: str, name: str, start: Callable[[], BackgroundState | RateState]) -> DataFrame:
    """Feed the values of each channel to a stateful step in the order of their frames, which count from 0 without gaps: a row per frame, once.

    A frame that comes early waits in the state for those before it, and one that came already is dropped, so the result doesn't depend on how rows fall into
    micro-batches. The state of a channel is its step and the frames that wait; it is kept in the state store, so a restart goes on from there.
    """
    cols, kinds = list(keys), dict(frames.dtypes)

    def run(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting, step = 0, {}, start()
        if state.exists:
            due, waiting, saved = pickle.loads(state.get[0])
            step.load(saved)
        for pdf in batches:
            values = pdf[value].astype(object).where(pdf[value].notna(), None)
            for frame, x in zip(pdf["frame"].tolist(), values.tolist()):
                if frame >= due:
                    waiting.setdefault(frame, x)
        first, results = due, []
        while due in waiting:
            results.append(step.step(waiting.pop(due)))
            due += 1
        state.update((pickle.dumps((due, waiting, step.save())),))
        out = pd.DataFrame({c: [i] * len(results) for c, i in zip(cols, ids)})
        yield out.assign(frame=range(first, due), **{name: pd.Series(results, dtype="float64")})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + f", frame {kinds['frame']}, `{name}` double"
    return frames.select(*cols, "frame", value).groupBy(*cols).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def stream_background(frames: DataFrame, keys: Sequence[str], value: str, window: int = 50, warmup: int = 30, every: int = 5) -> DataFrame:
    """``series.rolling_background`` over a stream, with one keyed state per pixel: the ranks of its last ``window`` values."""
    return _stream_in_order(frames, keys, value, "background", lambda: BackgroundState(window, warmup, every))


def stream_frame_rate(frames: DataFrame, keys: Sequence[str], seconds: str, window: int = 30) -> DataFrame:
    """``series.frame_rate`` over a stream; ``seconds`` is a column of timestamps in seconds."""
    return _stream_in_order(frames, keys, seconds, "fps", lambda: RateState(window))
