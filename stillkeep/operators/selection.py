"""Diverse selection with a reason for every rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillkeep.settings import SelectionSettings


def decide(candidates: DataFrame, settings: SelectionSettings) -> DataFrame:
    """Every candidate with round (its rank in the scene), selection_rank and reason (null where selected).

    candidates: video_id, frame_index, scene_id, final_score, and the booleans is_duplicate and is_known. Eligible candidates
    are ranked in their scene; the rounds go over all scenes, in a round the best score first, equal ones by the
    scene's first eligible frame.
    """
    c = F.col
    eligible = ~c("is_duplicate") & c("is_known") & (c("final_score") >= settings.minimum_score)
    marked = candidates.withColumn("_ok", eligible)
    scene = Window.partitionBy("video_id", "scene_id", "_ok")
    in_scene = scene.orderBy(c("final_score").desc(), "frame_index")
    inside = (c("_ok")) & (c("round") <= settings.max_per_scene)
    order = Window.partitionBy("video_id", "_in").orderBy("round", c("final_score").desc(), "_first", "frame_index")
    limit = F.lit(settings.count) if settings.count is not None else F.lit(2**31 - 1)
    reason = (
        F.when(c("is_duplicate"), "near duplicate")
        .when(~c("is_known"), "unknown scene")
        .when(c("final_score") < settings.minimum_score, "score below minimum")
        .when(c("round") > settings.max_per_scene, "maximum per scene reached")
        .when(c("_place") > limit, "requested count reached")
    )
    return (
        marked.withColumn("round", F.when(c("_ok"), F.row_number().over(in_scene)))
        .withColumn("_first", F.min("frame_index").over(scene))
        .withColumn("_in", F.coalesce(inside, F.lit(False)))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("reason", reason)
        .withColumn("selection_rank", F.when(c("reason").isNull(), c("_place")))
        .drop("_ok", "_first", "_in", "_place")
    )


def selected(decided: DataFrame) -> DataFrame:
    return decided.where("reason IS NULL")


def rejections(decided: DataFrame) -> DataFrame:
    return decided.where("reason IS NOT NULL")
