"""From videos to scored candidates, with every part that a user may bring as a function between tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillkeep.functions.pixels_arrow import MEASURES, Scorer, apply_scorers, scored_frames
from stillkeep.operators.composite import composite_score
from stillkeep.operators.faces import MEASURES as FACE_MEASURES
from stillkeep.operators.faces import group_face_score
from stillkeep.settings import CompositeSettings, FaceSettings, TechnicalSettings

KEYS = ("video_id", "frame_index")


@dataclass(frozen=True)
class Providers:
    """What a user may replace.

    frames: videos, or the frames wanted of them -> video_id, frame_index, width, height, rgb and what the other providers read. faces: frames -> a row per
    face with the keys and the face measures. aesthetic, composition: frames -> keys, score, and status where there is
    one; a null score is neutral. scorers: further columns by name. What is left out has no faces or is neutral.
    """

    frames: Callable[[DataFrame], DataFrame]
    faces: Scorer | None = None
    aesthetic: Scorer | None = None
    composition: Scorer | None = None
    scorers: dict[str, Scorer] = field(default_factory=dict)


def score_videos(
    videos: DataFrame,
    providers: Providers,
    technical: TechnicalSettings,
    face: FaceSettings,
    composite: CompositeSettings,
    hash_size: int = 8,
    reduce_factor: int = 4,
) -> DataFrame:
    """keys, technical, face, aesthetic, composition, n_faces, hash, error, the scorers' columns, profile, final_score and reasons.

    technical_scores and face_scores hold all measures behind the two scores (the latter null without a face), aesthetic_status what the provider says.

    Pixels leave the plan in the technical pass and in the providers, joins carry keys and scores. A frame in error has null scores.
    """
    frames = providers.frames(videos)
    tech = scored_frames(frames, technical, hash_size, reduce_factor)
    measures = F.struct(*MEASURES)
    rows = tech.select(*KEYS, F.col("global_score").alias("technical"), F.when(F.col("error").isNull(), measures).alias("technical_scores"), "hash", "error")
    if providers.faces:
        worst = group_face_score(providers.faces(frames), face, KEYS, analyses=True)
        scores = F.struct("analyses", *FACE_MEASURES, "global_score").alias("face_scores")
        rows = rows.join(worst.select(*KEYS, F.col("global_score").alias("face"), scores, "n_faces"), list(KEYS), "left")
    else:
        none = F.lit(None)
        rows = rows.withColumns({"face": none.cast("double"), "face_scores": none.cast("struct<global_score:double>"), "n_faces": none.cast("bigint")})
    rows = rows.withColumn("n_faces", F.coalesce("n_faces", F.lit(0).cast("bigint")))
    for name, provider in (("aesthetic", providers.aesthetic), ("composition", providers.composition)):
        if provider:
            given = provider(frames)
            status = F.col("status") if "status" in given.columns else F.lit("computed")
            own = given.select(*KEYS, F.col("score").alias(name), status.alias(f"{name}_status"))
            rows = rows.join(own, list(KEYS), "left")
        else:
            rows = rows.withColumns({name: F.lit(None).cast("double"), f"{name}_status": F.lit(None).cast("string")})
    if providers.scorers:
        more = apply_scorers(frames, providers.scorers).select(*KEYS, *providers.scorers)
        rows = rows.join(more, list(KEYS), "left")
    return composite_score(rows, composite)
