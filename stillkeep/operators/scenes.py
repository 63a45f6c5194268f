"""Scenes from a series of content changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillkeep.storage import shuffled


def content_change(frames: DataFrame, signature: Column) -> DataFrame:
    """Mean absolute difference of each frame's small signature (array of int) to the frame before; null for the first.

    Only signatures enter the window, never previews.
    """
    order = Window.partitionBy("video_id").orderBy("frame_index")
    slim = frames.select("video_id", "frame_index", signature.alias("_s")).withColumn("_p", F.lag("_s").over(order))
    total = F.aggregate(F.zip_with("_s", "_p", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    return slim.select("video_id", "frame_index", F.when(F.col("_p").isNotNull(), total / F.size("_s")).alias("change"))


def adaptive_cuts(series: DataFrame, value: str, threshold: float, window: int, least: float) -> DataFrame:
    """Frames whose value is at least ``least`` and ``threshold`` times the mean of the ``window`` neighbours on each side.

    Decided without a division, so integers stay exact. The first frame starts a scene anyway and is no cut. A frame
    without neighbours cuts on ``least`` alone.
    """
    order = Window.partitionBy("video_id").orderBy("frame_index")
    around = order.rowsBetween(-window, window)
    v = F.col(value)
    others = F.coalesce(F.sum(v).over(around) - v, F.lit(0))
    n = F.count(v).over(around) - 1
    marked = series.withColumn("_cut", (v >= least) & (v * n >= F.lit(threshold) * others) & (F.row_number().over(order) > 1))
    return marked.where("_cut").drop("_cut")


def min_scene_length(cuts: DataFrame, frames: int) -> DataFrame:
    """(video_id, frame_index) of the accepted cuts: greedily, each at least ``frames`` after the last accepted; frame 0 counts as one.

    One ordered pass: a task reads its videos' cuts in frame order and holds the last accepted number and nothing else.
    """

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = object(), 0
        for batch in batches:
            keep = []
            for own, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != video:
                    video, last = own, 0
                keep.append(frame is not None and frame - last >= frames)
                if keep[-1]:
                    last = frame
            yield batch.filter(pa.array(keep, pa.bool_()))

    slim = cuts.select("video_id", F.col("frame_index").cast("bigint").alias("frame_index"))
    return slim.repartition("video_id").sortWithinPartitions("video_id", "frame_index").mapInArrow(accepted, slim.schema)


def boundaries_to_scenes(videos: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Scenes of each video (video_id, duration) from its cuts (video_id, t): scene_id from 1, start_time, end_time, duration.

    Without cuts there is one scene [0, duration) if the duration is positive, else none.
    """
    starts = videos.where("duration > 0").select("video_id", F.lit(0.0).alias("start_time")).unionByName(
        boundaries.select("video_id", F.col("t").alias("start_time"))
    )
    order = Window.partitionBy("video_id").orderBy("start_time")
    return (
        starts.join(videos, "video_id")
        .select(
            "video_id",
            F.row_number().over(order).alias("scene_id"),
            "start_time",
            F.coalesce(F.lead("start_time").over(order), F.col("duration")).alias("end_time"),
        )
        .withColumn("duration", F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")))
    )


def detect_scenes(frames: DataFrame, value: str, threshold: float, window: int, least: float, min_frames: int) -> DataFrame:
    """All steps from a value per frame (video_id, frame_index, t) to scenes; a video ends a second after its last frame."""
    cuts = min_scene_length(adaptive_cuts(frames, value, threshold, window, least), min_frames)
    at = cuts.join(shuffled(frames.select("video_id", "frame_index", "t")), ["video_id", "frame_index"])
    ends = frames.groupBy("video_id").agg((F.max("t") + 1.0).alias("duration"))
    return boundaries_to_scenes(ends, at)
