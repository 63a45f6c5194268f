"""Summaries and their text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def _thousandths(name: str) -> Column:
    """Rounded half up to three digits before it is printed, so the text does not hang on how a formatter breaks ties."""
    return F.floor(F.col(name) * 1000 + 0.5) / 1000


def technical_means(scenes: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates and mean technical score of each scene, 0 for an empty one; candidates of unknown scenes are ignored."""
    n = scored.groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("technical").alias("_m"))
    return scenes.select("video_id", "scene_id").join(n, ["video_id", "scene_id"], "left").select(
        "video_id", "scene_id", F.coalesce("_n", F.lit(0)).alias("n_candidates"), F.coalesce("_m", F.lit(0.0)).alias("mean_technical")
    )


def aesthetic_summary(scored: DataFrame) -> DataFrame:
    """Per video of (video_id, frame_index, aesthetic, inference_ms, status): mean, total time (null is 0), status of the first frame."""
    return scored.groupBy("video_id").agg(
        F.avg("aesthetic").alias("mean_aesthetic"),
        F.sum(F.coalesce("inference_ms", F.lit(0.0))).alias("inference_ms"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.min_by("status", "frame_index").alias("status"),
    )


def _totals() -> list[Column]:
    return [
        F.count_if(F.col("error").isNull()).alias("successes"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.coalesce(F.sum(F.coalesce("selected_count", F.lit(0))), F.lit(0)).alias("selected"),
        F.coalesce(F.sum(F.coalesce("exported_count", F.lit(0))), F.lit(0)).alias("exported"),
    ]


def batch_totals(results: DataFrame) -> DataFrame:
    """Of per-video results (error, selected_count, exported_count): successes, failures and sums, null counts as 0."""
    return results.agg(*_totals())


def write_with_totals(results: DataFrame, path: str) -> dict[str, int]:
    """Write per-video results and return their totals, observed by the writing job itself: nothing is read a second time."""
    seen = Observation("totals")
    results.observe(seen, *_totals()).write.mode("overwrite").parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def observed(results: DataFrame) -> DataFrame:
    """A stream of per-video results whose progress reports carry the totals of each batch; ``progress_so_far`` adds them up."""
    return results.observe("totals", *_totals())


def progress_so_far(query: StreamingQuery) -> dict[str, int]:
    """The totals of an ``observed`` stream over the batches that its progress reports hold."""
    out = dict.fromkeys(("successes", "failures", "selected", "exported"), 0)
    for report in query.recentProgress:
        row = report.observedMetrics.get("totals")
        for name in out if row is not None else ():
            out[name] += int(row[name] or 0)
    return out


def selection_summary(decided: DataFrame, requested: int | None) -> DataFrame:
    """Per video: selected, requested ("no quota" without one), rejected, and the selected lines in order."""
    line = F.format_string("scene %d - %.3fs - score %.3f", F.col("scene_id").cast("int"), _thousandths("t"), _thousandths("final_score"))
    lines = F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("selection_rank", line.alias("line")))))
    return decided.groupBy("video_id").agg(
        F.count_if(F.col("reason").isNull()).alias("n_selected"),
        F.lit("no quota" if requested is None else str(requested)).alias("requested"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"),
    )


def scene_lines(scenes: DataFrame) -> DataFrame:
    text = F.format_string("scene %d: %.3fs -> %.3fs (%.3fs)", F.col("scene_id").cast("int"), *map(_thousandths, ("start_time", "end_time", "duration")))
    return scenes.select("video_id", "scene_id", text.alias("line"))


def video_lines(info: DataFrame) -> DataFrame:
    """One text per video with all that is known of it; what is null reads "unavailable". Times are in UTC."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unavailable"))
    created = F.date_format(F.to_utc_timestamp("creation_time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    parts = [
        F.concat(F.lit("file: "), F.col("path").cast("string")),
        F.concat(F.lit("codec: "), shown("codec")),
        F.concat(F.lit("size: "), F.coalesce(size, F.lit("unavailable"))),
        F.concat(F.lit("fps: "), F.when(F.col("fps").isNull(), "unavailable").otherwise(F.format_string("%.3f", "fps"))),
        F.concat(F.lit("frames: "), shown("approximate_frame_count")),
        F.concat(F.lit("duration: "), F.when(F.col("duration_seconds").isNull(), "unavailable").otherwise(F.format_string("%.3f", "duration_seconds"))),
        F.concat(F.lit("bitrate: "), shown("bitrate")),
        F.concat(F.lit("orientation: "), shown("orientation_degrees")),
        F.concat(F.lit("created: "), F.coalesce(created, F.lit("unavailable"))),
    ]
    return info.select("path", F.concat_ws("; ", *parts).alias("line"))


def progress_totals(events: DataFrame) -> DataFrame:
    """Progress events (video_id, seq, state, selected, exported) with running totals inside each video."""
    run = Window.partitionBy("video_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("selected_total", F.sum("selected").over(run)).withColumn("exported_total", F.sum("exported").over(run))


def progress_events(results: DataFrame) -> DataFrame:
    """The events of each result: started; then failed, or selected, one exported for each image, completed."""
    def event(seq, state, chosen=0, done=0):  # noqa: ANN001, ANN202
        as_long = lambda x: x.cast("bigint") if hasattr(x, "cast") else F.lit(x).cast("bigint")
        return F.struct(as_long(seq).alias("seq"), F.lit(state).alias("state"), as_long(chosen).alias("selected"), as_long(done).alias("exported"))

    n = F.coalesce("exported_count", F.lit(0)).cast("bigint")
    exported = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))), lambda k: event(k + 1, "exported", 0, 1)))
    good = F.concat(
        F.array(event(0, "started"), event(1, "selected", F.col("selected_count"))),
        F.coalesce(exported, F.array().cast("array<struct<seq:bigint,state:string,selected:bigint,exported:bigint>>")),
        F.array(event(n + 2, "completed")),
    )
    bad = F.array(event(0, "started"), event(1, "failed"))
    return results.select("video_id", F.explode(F.when(F.col("error").isNull(), good).otherwise(bad)).alias("e")).select("video_id", "e.*")
