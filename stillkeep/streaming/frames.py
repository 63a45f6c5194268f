"""Streams of frames: sampling and running means."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stillkeep.storage import shared_path

RUN = 64  # buckets of time whose scenes share a state
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_scenes(frames: DataFrame, scenes: DataFrame, bucket: float) -> DataFrame:
    """Arriving frames with scene_id, start_time and end_time of the scene that they are in.

    Scenes stand in each ``bucket`` seconds of time that they touch, so that a frame is joined by video and bucket with the few scenes there,
    however many its video has.
    """
    at = lambda t: F.floor(F.col(t) / F.lit(bucket))
    own = scenes.where("end_time > start_time").select("video_id", "scene_id", "start_time", "end_time", F.explode(F.sequence(at("start_time"), at("end_time"))).alias("_b"))
    return frames.withColumn("_b", at("t")).join(own, ["video_id", "_b"]).where((F.col("start_time") <= F.col("t")) & (F.col("t") < F.col("end_time"))).drop("_b")


def sampled_keys(frames: DataFrame, scenes: DataFrame, fps: float, delay: str = "31 days", bucket: float = 60.0) -> DataFrame:
    """(video_id, scene_id, cell) as frames arrive: a cell goes out with the first frame that reaches it.

    frames is a stream with ts (timestamp), video_id and t; scenes is a static table. The watermark bounds the state; frames
    later than ``delay`` are dropped, and of a cell the frame that arrives first stands for it.
    """
    return (
        in_scenes(frames.withWatermark("ts", delay), scenes, bucket)
        .withColumn("cell", F.floor((F.col("t") - F.col("start_time")) * F.lit(fps)))
        .dropDuplicatesWithinWatermark(["video_id", "scene_id", "cell"])
        .select("video_id", "scene_id", "cell")
    )


def next_point(point: float, t: float, interval: float) -> float:
    """The first time after ``t`` of the grid point, point + interval, ..., each the sum of the one before, in blocks of a bounded size."""
    while point <= t:
        steps = min(1 << 16, int((t - point) / interval) + 2)
        grid = np.cumsum(np.concatenate(([point], np.full(steps, interval))))  # one addition after the other
        point = float(grid[min(len(grid) - 1, int(np.searchsorted(grid, t, side="right")))])
    return point


class GridSampler(StatefulProcessor):
    """The state of a run of scenes of one video is the next time of each scene's grid.

    A scene is dropped when no frame of it has come for ``wait`` milliseconds of event time: by a timer that drops the run with its last scene, or
    when another scene of the run gets frames after that. One read and one write of the state serve all scenes of a batch.
    """

    def __init__(self, interval: float, wait: int):
        self.interval, self.wait = interval, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grids = handle.getValueState("grids", "scenes array<string>, points array<double>, ends array<bigint>, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = pd.concat(list(rows)).sort_values(["t", "frame_index"], kind="stable")
        state = self.grids.get()
        grids = {s: (p, e) for s, p, e in zip(state[0], state[1], state[2], strict=True)} if state else {}
        mark = timerValues.getCurrentWatermarkInMs()
        scenes, at = frames["scene_id"].astype(str).tolist(), frames["t"].to_numpy()
        starts, ms = frames["start_time"].tolist(), (frames["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        taken, latest = [], {}
        for k, (scene, t, start, ts) in enumerate(zip(scenes, at.tolist(), starts, ms, strict=True)):
            point = grids[scene][0] if scene in grids else start
            if t >= point:
                taken.append(k)
                point = next_point(point, t, self.interval)
            latest[scene] = max(ts, latest.get(scene, mark))
            grids[scene] = (point, latest[scene] + self.wait)
        grids = {s: g for s, g in grids.items() if g[1] > mark}
        timer = max(e for _, e in grids.values())
        if not state or state[3] != timer:
            if state:
                self.handle.deleteTimer(state[3])
            self.handle.registerTimer(timer)
        self.grids.update((list(grids), [p for p, _ in grids.values()], [e for _, e in grids.values()], timer))
        out = frames.iloc[taken]
        yield pd.DataFrame({"video_id": key[0], "scene_id": out["scene_id"], "frame_index": out["frame_index"], "t": out["t"]})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.grids.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def sampled_frames(frames: DataFrame, scenes: DataFrame, fps: float, delay: str = "1 day", bucket: float = 60.0) -> DataFrame:
    """The frames (video_id, scene_id, frame_index, t) of the exact grid, each as soon as it has arrived.

    frames is a stream with ts (timestamp), video_id, frame_index and t; scenes is a static table without overlaps. A scene's state is
    the next time of its grid: start, start + 1/fps, ..., summed up. Frames of a video are expected in the order of t from batch to
    batch, inside a batch they are sorted; one that comes after a later frame of its cell is no longer taken. State that the
    watermark has left by ``delay`` is dropped by a timer. The session needs the state store of ``state_store``.
    """
    run = F.floor(F.col("start_time") / F.lit(RUN * bucket)).alias("run")  # so that a long video spreads over the tasks
    inside = in_scenes(frames.withWatermark("ts", delay), scenes, bucket).select("video_id", run, "scene_id", "start_time", "ts", "frame_index", "t")
    kinds = dict(inside.dtypes)
    shape = f"video_id {kinds['video_id']}, scene_id {kinds['scene_id']}, frame_index {kinds['frame_index']}, t double"
    sampler = GridSampler(1.0 / fps, int(pd.Timedelta(delay).total_seconds() * 1000))
    return inside.groupBy("video_id", "run").transformWithStateInPandas(sampler, shape, "append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers and large states need; the session's own choice comes back."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def running_means(frames: DataFrame) -> DataFrame:
    """Count and mean technical score of each scene so far, without keeping frames."""
    return frames.groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.avg("technical").alias("mean_technical"))


def run_available(spark: SparkSession, stream: DataFrame, tag: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and read its result table. key: in update mode, the last row of each key counts."""
    out, state = shared_path(spark, tag), shared_path(spark, f"{tag}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)

    def run(started: Any) -> None:
        with state_store(spark):
            started.start().awaitTermination()

    if key:

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

        run(writer.outputMode("update").foreachBatch(save))
        rows = spark.read.parquet(f"{out}/n=*")
        values = [c for c in rows.columns if c not in (*key, "_batch")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
        return last.select(*key, "v.*")
    run(writer.outputMode("append").format("parquet").option("path", out))
    return spark.read.schema(stream.schema).parquet(out)


def read_stream(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A Parquet table as a stream with its own schema."""
    schema = spark.read.parquet(path).schema
    return shape(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path))
