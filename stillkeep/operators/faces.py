"""Face measures and group scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillkeep.functions.expr import clamp01, linear_score, weighted_average
from stillkeep.settings import FaceSettings

MEASURES = ("detection_confidence", "size", "orientation", "eyes_open", "positive_expression", "sharpness", "crop")
BLENDS = ("eyeBlinkLeft", "eyeBlinkRight", "mouthSmileLeft", "mouthSmileRight")


def landmarks_to_faces(landmarks: DataFrame, keys: list[str], settings: FaceSettings) -> DataFrame:
    """keys, landmark_index, x, y -> size, yaw and whether the face is cut off. Landmark 1 is the nose, else the middle.

    The box is limited to the picture. A face always has a landmark here, since it is known by its rows only.
    """
    box = landmarks.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.min("x")).alias("x0"),
        F.least(F.lit(1.0), F.max("x")).alias("x1"),
        F.greatest(F.lit(0.0), F.min("y")).alias("y0"),
        F.least(F.lit(1.0), F.max("y")).alias("y1"),
        F.max(F.when(F.col("landmark_index") == 1, F.col("x"))).alias("nose"),
    )
    c, m = F.col, settings.cut_off_margin
    width = c("x1") - c("x0")
    middle = c("x0") + width / 2
    yaw = F.when(width == 0, F.lit(0.0)).otherwise((F.coalesce("nose", middle) - middle) / F.nullif(width / 2, F.lit(0.0)) * settings.yaw_scale_degrees)
    return box.select(
        *keys,
        (width * (c("y1") - c("y0"))).alias("relative_size"),
        yaw.alias("yaw_degrees"),
        ((c("x0") <= m) | (c("y0") <= m) | (c("x1") >= 1 - m) | (c("y1") >= 1 - m)).alias("is_cut_off"),
    )


def blendshapes(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category_name, score -> eyes_open and positive_expression; null where one of a pair is missing."""
    one = lambda name: F.max(F.when(F.col("category_name") == name, F.col("score")))
    wide = entries.groupBy(*keys).agg(*(one(n).alias(n) for n in BLENDS))
    return wide.select(
        *keys,
        clamp01(1 - (F.col(BLENDS[0]) + F.col(BLENDS[1])) / 2).alias("eyes_open"),
        clamp01((F.col(BLENDS[2]) + F.col(BLENDS[3])) / 2).alias("positive_expression"),
    )


def at_most(faces: DataFrame, most: int) -> DataFrame:
    """The first ``most`` faces of each frame by face_no."""
    order = Window.partitionBy("frame_index").orderBy("face_no")
    return faces.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def measures(settings: FaceSettings) -> dict[str, Column]:
    c = F.col
    return {
        "detection_confidence": c("detection_confidence"),
        "size": linear_score(c("relative_size"), settings.size_min_relative_area, settings.size_good_relative_area),
        "orientation": clamp01(1 - F.abs(c("yaw_degrees")) / settings.max_yaw_degrees),
        "eyes_open": c("eyes_open"),
        "positive_expression": c("positive_expression"),
        "sharpness": linear_score(c("sharpness_variance"), settings.sharpness_min_variance, settings.sharpness_good_variance),
        "crop": F.when(c("is_cut_off"), 0.0).otherwise(1.0),
    }


ANALYSIS = ("detection_confidence", "relative_size", "yaw_degrees", "eyes_open", "positive_expression", "sharpness_variance", "is_cut_off")


def group_face_score(faces: DataFrame, settings: FaceSettings, keys: tuple[str, ...] = ("frame_index",), analyses: bool = False) -> DataFrame:
    """Per frame the worst of each measure over its faces (nulls skipped) and their weighted mean, n_faces too.

    analyses: also the faces themselves, an array as long as a frame has faces.
    """
    more = [F.sort_array(F.collect_list(F.struct(*ANALYSIS))).alias("analyses")] if analyses else []
    worst = faces.groupBy(*keys).agg(*(F.min(e).alias(n) for n, e in measures(settings).items()), F.count(F.lit(1)).alias("n_faces"), *more)
    return worst.withColumn("global_score", weighted_average([(F.col(n), settings.weights[n]) for n in MEASURES]))


def with_face_score(frames: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ("frame_index",)) -> DataFrame:
    """Every frame; one without faces has null scores and 0 faces."""
    return frames.join(scores, list(keys), "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)))
