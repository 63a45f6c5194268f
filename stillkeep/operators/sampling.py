"""Frames to scenes, and frames on a time grid."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillkeep.storage import tasks

RANGE = 86_400.0  # seconds of a video that one task passes over at least


def assign_scene(frames: DataFrame, scenes: DataFrame, width: float = RANGE) -> DataFrame:
    """Frames with the scene_id, start and end of the first scene by start with start <= t < end; other frames drop.

    Where scenes overlap the earliest start wins. One ordered pass over the frames and scene starts of each ``width`` seconds of a video, the
    last start running, so no frame meets more than one scene; frames should be slim. A scene that goes on into a range stands at
    the range's begin, so ranges need nothing from each other and one long video spreads over all tasks. A null time drops.
    """
    earlier = Window.partitionBy("video_id").orderBy("start_time", "scene_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(F.col("scene_id").alias("id"), F.col("start_time").alias("a"), F.col("end_time").alias("b"))
    # a scene is reached where all earlier ones have ended; from there to its end no other one counts
    reached = scenes.select("video_id", own.alias("_s"), F.greatest("start_time", F.max("end_time").over(earlier)).alias("t")).where(F.col("t") < F.col("_s.b"))
    at = lambda t: F.floor(t / F.lit(width))
    starts = reached.withColumn("_part", F.explode(F.sequence(at(F.col("t")), at(F.col("_s.b"))))).withColumn("t", F.greatest("t", F.col("_part") * F.lit(width)))
    both = frames.where("t IS NOT NULL").withColumns({"_kind": F.lit(1), "_part": at(F.col("t"))}).unionByName(starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy("video_id", "_part").orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_s", F.last("_s", ignorenulls=True).over(run)).where((F.col("_kind") == 1) & (F.col("t") < F.col("_s.b")))
    return last.select(*frames.columns, F.col("_s.id").alias("scene_id"), F.col("_s.a").alias("scene_start"), F.col("_s.b").alias("scene_end"))


def _first_of_cell(celled: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id", "scene_id", "cell").orderBy("t", "frame_index")
    return celled.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sample_fast(frames_in_scene: DataFrame, fps: float) -> DataFrame:
    """The first frame of each grid cell, the cell by division. Timestamps that lie exactly on the grid may differ from ``sample_exact``."""
    return _first_of_cell(frames_in_scene.withColumn("cell", F.floor((F.col("t") - F.col("scene_start")) * F.lit(fps))))


def _grid_points(interval: float, width: float, block: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The points of each scene's grid with the range that each is in; the last point before a range stands in that range too.

    Points of many short scenes leave together, some ``block`` at a time.
    """

    def made(batch: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        scene, *rest = (pa.array(np.concatenate(x)) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(scene) for c in ("video_id", "scene_id")), *rest], ["video_id", "scene_id", "cell", "t", "_part"])

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, (start, end) in enumerate(zip(batch.column("start_time").to_pylist(), batch.column("end_time").to_pylist(), strict=True)):
                point, cell = start, 0
                while point is not None:
                    # summed up one after the other, as a sequential sampler does
                    t = np.cumsum(np.concatenate(([point], np.full(min(block, max(1, int((end - point) / interval) + 2)), interval))))
                    own = int(np.searchsorted(t[:-1], end))
                    part = np.floor(t / width).astype(np.int64)
                    # a point is asked for in all ranges up to that of the next one, or of the scene's end
                    until = np.minimum(part[1 : own + 1], math.floor(end / width))
                    n = np.maximum(until - part[:own], 0) + 1
                    which = np.repeat(np.arange(own), n)
                    parts = part[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    held.append((np.full(len(which), k), which + cell, t[which], parts))
                    size += len(which)
                    if size >= block:
                        yield made(batch, held)
                        held, size = [], 0
                    cell += own
                    point = float(t[own]) if own == len(t) - 1 and t[own] < end else None
            if held:
                yield made(batch, held)

    return points


def sample_exact(frames_in_scene: DataFrame, scenes: DataFrame, fps: float, width: float = RANGE) -> DataFrame:
    """The first frame at or after each point of the grid start, start + 1/fps, ... summed up as a sequential sampler does.

    The points are bit-equal to repeated addition: a task sums up its scenes' grids in blocks; scenes are dealt to all tasks. Frames find their cell by an as-of pass over
    each ``width`` seconds of a scene, the last point running, so a long scene spreads over all tasks; the first frames of cells of
    two ranges meet in a second, small step.
    """
    kinds = dict(scenes.dtypes)
    shape = f"video_id {kinds['video_id']}, scene_id {kinds['scene_id']}, cell bigint, t double, _part bigint"
    grids = scenes.where("end_time > start_time").select("video_id", "scene_id", "start_time", "end_time")
    # few bytes, so that all scenes may lie in one file, but many points
    points = grids.repartition(tasks(scenes.sparkSession), "video_id", "scene_id").mapInArrow(_grid_points(1.0 / fps, width), shape)
    both = frames_in_scene.withColumns({"_kind": F.lit(1), "_part": F.floor(F.col("t") / F.lit(width))}).unionByName(points.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("video_id", "scene_id", "_part").orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    celled = both.withColumn("cell", F.last("cell", ignorenulls=True).over(order)).where("_kind = 1")
    inside = Window.partitionBy("video_id", "scene_id", "_part", "cell").orderBy("t", "frame_index")
    first = celled.withColumn("_n", F.row_number().over(inside)).where("_n = 1").drop("_n", "_kind", "_part")
    return _first_of_cell(first)


def known_scenes(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    return candidates.join(scenes.select("video_id", "scene_id").distinct(), ["video_id", "scene_id"], "left_semi")


def unknown_scenes(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    return candidates.join(scenes.select("video_id", "scene_id").distinct(), ["video_id", "scene_id"], "left_anti")


def scene_counts(scenes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each scene, 0 where there is none."""
    n = candidates.groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("_n"))
    return scenes.join(n, ["video_id", "scene_id"], "left").withColumn("n_candidates", F.coalesce("_n", F.lit(0))).drop("_n")


def band_pairs(left: DataFrame, right: DataFrame, window: float) -> DataFrame:
    """Pairs (l, r) of one video with abs(l.t - r.t) <= window, as two struct columns.

    A time bucket makes it an equi-join: left rows stand in their bucket and both neighbours, right rows in
    theirs. Buckets are a little wider than the window, so rounding cannot put a pair two apart.
    """
    width = F.lit(window * 1.001)
    l = left.select(  # noqa: E741
        F.col("video_id").alias("_v"), F.struct("*").alias("l"), F.explode(F.sequence(F.floor(F.col("t") / width) - 1, F.floor(F.col("t") / width) + 1)).alias("_b")
    )
    r = right.select(F.col("video_id").alias("_v"), F.floor(F.col("t") / width).alias("_b"), F.struct("*").alias("r"))
    return l.join(r, ["_v", "_b"]).where(F.abs(F.col("l.t") - F.col("r.t")) <= window).select("l", "r")


def top_per_scene(ranked: DataFrame, k: int) -> DataFrame:
    """The k best of each scene with rank_in_scene, equal scores in frame order."""
    order = Window.partitionBy("video_id", "scene_id").orderBy(F.col("final_score").desc(), "frame_index")
    return ranked.withColumn("rank_in_scene", F.row_number().over(order)).where(F.col("rank_in_scene") <= k)


def refine(frames: DataFrame, ranked: DataFrame, window: float, per_scene: int) -> DataFrame:
    """For each target (the best of each scene) the best frame within the window: score, then nearness, then frame order.

    frames: video_id, frame_index, t, final_score. Targets without a frame drop. The chosen frame carries the scene of the
    first target that reaches it; targets are ordered by the first frame of their scene, then by rank.
    """
    first = ranked.groupBy("video_id", "scene_id").agg(F.min("frame_index").alias("scene_first"))
    targets = top_per_scene(ranked, per_scene).join(first, ["video_id", "scene_id"])
    keys = ["video_id", "frame_index", "t", "scene_id", "scene_first", "rank_in_scene"]
    pairs = band_pairs(targets.select(*keys), frames.select("video_id", "frame_index", "t", "final_score"), window)
    flat = pairs.select(
        F.col("l.video_id").alias("video_id"),
        F.col("l.frame_index").alias("target_frame"),
        F.col("r.frame_index").alias("frame_index"),
        F.col("r.final_score").alias("final_score"),
        F.abs(F.col("l.t") - F.col("r.t")).alias("distance"),
        F.struct("l.scene_first", "l.rank_in_scene", "l.scene_id").alias("place"),
    )
    by_frame = Window.partitionBy("video_id", "frame_index")
    by_target = Window.partitionBy("video_id", "target_frame").orderBy(F.col("final_score").desc(), "distance", "frame_index")
    return (
        flat.withColumn("scene_id", F.min("place").over(by_frame)["scene_id"])
        .withColumn("_n", F.row_number().over(by_target))
        .where("_n = 1")
        .select("video_id", "target_frame", "frame_index", "scene_id", "final_score", "distance")
    )
