"""Composite score with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillkeep.functions.expr import clamp01
from stillkeep.settings import CompositeSettings

CRITERIA = ("technical", "aesthetic", "composition", "face")


def composite_score(frames: DataFrame, settings: CompositeSettings) -> DataFrame:
    """Adds profile, final_score and reasons to frames with technical, face, aesthetic and composition (all but the first nullable).

    With a face score the profile is people, else no_people, without the face. A missing aesthetic or composition counts as
    neutral. Reasons are ordered by abs(score - neutral) * weight, falling; equal ones in the order of CRITERIA.
    """
    people = F.col("face").isNotNull()

    def reason(place: int, name: str) -> Column:
        weight = F.when(people, F.lit(float(settings.people[name]))).otherwise(F.lit(float(settings.no_people.get(name, 0.0))))
        optional = name in ("aesthetic", "composition")
        score = F.coalesce(name, F.lit(settings.neutral_score)) if optional else F.col(name)
        neutral = F.col(name).isNull() & F.lit(optional)
        return F.struct(
            F.lit(name).alias("criterion"),
            score.alias("score"),
            weight.alias("weight"),
            (score * weight).alias("contribution"),
            F.when(neutral, "neutral value").otherwise("computed score").alias("detail"),
            (-F.abs(score - settings.neutral_score) * weight).alias("_key"),
            F.lit(place).alias("_place"),
        )

    entries = F.filter(F.array(*(reason(k, n) for k, n in enumerate(CRITERIA))), lambda r: (r["criterion"] != "face") | people)
    total = lambda field: F.aggregate("_entries", F.lit(0.0), lambda s, r: s + r[field])
    by_key = F.array_sort(F.transform("_entries", lambda r: F.struct(r["_key"].alias("k"), r["_place"].alias("p"), r.alias("r"))))
    fields = ("criterion", "score", "weight", "contribution", "detail")
    return (
        frames.withColumn("_entries", entries)
        .withColumn("profile", F.when(people, "people").otherwise("no_people"))
        .withColumn("final_score", total("contribution") / total("weight"))
        .withColumn("reasons", F.transform(by_key, lambda x: F.struct(*(x["r"][f].alias(f) for f in fields))))
        .drop("_entries")
    )


def aesthetic_head(embedding: Column, weights: list[float], bias: float, low: float, high: float) -> Column:
    """A linear layer on an embedding, its raw value scaled from [low, high] to [0, 1]."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    raw = F.aggregate(F.zip_with(embedding, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) + bias
    return clamp01((raw - low) / (high - low))


def neutral_provider(score: float = 0.5, status: str = "model not available") -> Column:
    """What a criterion without a model gives for every frame."""
    return F.struct(
        F.lit(score).alias("global_score"),
        F.lit(True).alias("is_neutral"),
        F.lit(None).cast("string").alias("model_name"),
        F.lit(None).cast("double").alias("inference_ms"),
        F.lit(status).alias("status"),
    )


def score_object(neutral_score: float = 0.5) -> Column:
    """The full scores of a frame of ``score_videos`` as one object: technical, face, aesthetic, composition, profile and reasons."""

    def optional(name: str, *more: Column) -> Column:
        return F.struct(F.coalesce(name, F.lit(neutral_score)).alias("global_score"), F.col(name).isNull().alias("is_neutral"), *more)

    none = F.lit(None)
    model = (none.cast("string").alias("model_name"), none.cast("double").alias("inference_ms"), F.coalesce("aesthetic_status", F.lit("model not available")).alias("status"))
    return F.struct(
        F.col("technical_scores").alias("technical"),
        F.col("face_scores").alias("face"),
        optional("aesthetic", *model).alias("aesthetic"),
        optional("composition").alias("composition"),
        "profile",
        "reasons",
    )
