"""Manifests, export plans and preview stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillkeep.settings import ExportSettings
from stillkeep.storage import tasks

FRAMES_PER_FILE = 10_000  # of one video in a preview store

_NULLS = {"ignoreNullFields": "false"}  # an unknown value is written as null


def candidate_file(scene_id: Column, frame_index: Column) -> Column:
    return F.format_string("scene_%03d_frame_%08d.jpg", scene_id, frame_index)


def candidate_rows(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("file", candidate_file(F.col("scene_id"), F.col("frame_index")))


def candidate_items(candidates: DataFrame) -> DataFrame:
    """video_id, position (the frame) and item, the JSON of each candidate, for ``write_manifests``."""
    fields = ("file", "scene_id", F.col("t").alias("timestamp"), "frame_index", "source_width", "source_height", "preview_width", "preview_height")
    return candidate_rows(candidates).select("video_id", F.col("frame_index").alias("position"), F.to_json(F.struct(*fields), _NULLS).alias("item"))


def _image_file(settings: ExportSettings) -> Column:
    return F.format_string("%s_%04d.%s", F.col("video_id").cast("string"), F.col("selection_rank").cast("int"), F.lit(settings.extension))


def export_plan(selected: DataFrame, settings: ExportSettings) -> DataFrame:
    """The native frames wanted: video_id, selection_rank, t, file, format, quality. The settings are checked when made."""
    return selected.select("video_id", "selection_rank", "frame_index", "t", _image_file(settings).alias("file"), F.lit(settings.extension).alias("format"), F.lit(settings.jpeg_quality).alias("quality"))


def selection_items(selected: DataFrame, settings: ExportSettings, scores: Column | None = None) -> DataFrame:
    """video_id, position (the rank) and item, the JSON of each selected image, for ``write_manifests``. scores: see ``composite.score_object``."""
    image = F.struct(
        _image_file(settings).alias("file"),
        F.col("video_id").alias("source_video"),
        F.col("t").alias("timestamp"),
        F.col("frame_index").alias("frame"),
        F.col("final_score").alias("score_final"),
        (scores if scores is not None else F.lit(None).cast("string")).alias("scores"),
        F.col("scene_id").alias("scene_source"),
    )
    return selected.select("video_id", F.col("selection_rank").alias("position"), F.to_json(image, _NULLS).alias("item"))


RECORD = "\x1e"  # stands before each JSON text of a sequence (RFC 7464), inside one it is always escaped


def write_manifests(items: DataFrame, path: str, name: str, videos: DataFrame | None = None, bundled: bool = False) -> None:
    """One JSON text for each video, ``{"source_video": ..., name: [the items by position]}``, as a file in the folder of the video.

    A task writes its videos' items line by line in order and holds none of them, however many a video has. Making a file costs more than
    its few lines, so videos are dealt to all tasks (see ``tasks``). The job's commit publishes all
    files at once; a job that fails leaves none, and a video that is written again replaces its own file only. Videos of ``videos``
    (video_id) without items get an empty list, null ids are left out.

    bundled: the same texts, those of a task's videos in one file as a sequence of JSON texts, for so many videos that a file and a folder for
    each would cost more than all else (some 24 ms to make, as much to list and read). ``path`` must be new: no video in it can be replaced.
    """
    rows = items.select("video_id", "position", "item")
    if videos is not None:
        rows = rows.unionByName(videos.select("video_id").distinct().join(rows.select("video_id"), "video_id", "left_anti"), allowMissingColumns=True)
    source = F.expr("substring(to_json(array(video_id)), 2, length(to_json(array(video_id))) - 2)")
    # a text that is never null, so that the sorted rows are written as they come
    rows = rows.where("video_id IS NOT NULL").select("*", source.alias("source"), F.coalesce(F.col("video_id").cast("string"), F.lit("")).alias("key"))
    rows = rows.repartition(tasks(rows.sparkSession), "key")
    order = Window.partitionBy("key").orderBy("position")
    first, last = F.lag("key").over(order).isNull(), F.lead("key").over(order).isNull()
    head = F.concat(F.lit((RECORD if bundled else "") + '{"source_video": '), "source", F.lit(f', "{name}": [\n'))
    line = F.concat(F.when(first, head).otherwise(""), F.coalesce("item", F.lit("")), F.when(last, "\n]}").otherwise(","))
    lines = rows.select(F.col("key").alias("video_id"), line.alias("value"))
    if bundled:
        lines.select("value").write.text(path)
        return
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").text(path)


def read_manifests(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """(value, video_id): each video's manifest as one text; of ``bundled`` ones the value alone."""
    if bundled:
        return spark.read.text(path, lineSep=RECORD).where("value <> ''")  # nothing stands before a file's first record
    return spark.read.text(path, wholetext=True)


def store_previews(previews: DataFrame, path: str) -> None:
    """Previews by video; a video that is written again replaces its own partition only.

    Rows are dealt by video first, so that a video has few files; a large one is split, small ones are spread over all tasks (see ``tasks``).
    """
    rows = previews.repartition(tasks(previews.sparkSession), *_split(previews))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def _split(previews: DataFrame) -> list[Column]:
    """The video and, where frames are numbered, the run of ``FRAMES_PER_FILE`` frames that a row is in."""
    runs = [F.expr(f"frame_index div {FRAMES_PER_FILE}")] if "frame_index" in previews.columns else []
    return [F.col("video_id"), *runs]


def preview_counts(previews: DataFrame) -> DataFrame:
    """(video_id, n_previews, scene_counts): the counts of each scene as a map."""
    n = previews.groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("scene_id", "n")))
    return n.groupBy("video_id").agg(F.sum("n").alias("n_previews"), F.map_from_entries(pairs).alias("scene_counts"))
