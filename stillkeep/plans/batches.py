"""Long batches of videos in chunks, each with a commit of its own: what an interrupted run finished stays and is not done again."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.storage import stored


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """(video_id, part) of the videos whose chunk was committed under ``path``; None before the first commit."""
    try:
        return spark.read.parquet(f"{path}/done")
    except AnalysisException:
        return None


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed chunks. Parts that a stopped run left without a commit are not opened. There is one part for each job."""
    done = finished(spark, path)
    if done is None:
        return None
    parts = sorted(r["part"] for r in done.select("part").distinct().collect())
    return spark.read.option("basePath", f"{path}/results").parquet(*(f"{path}/results/part={p}" for p in parts)).drop("part")


def run_in_chunks(videos: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, per_chunk: int = 1000) -> int:
    """``work`` on the videos (video_id) that ``path`` has not finished, about ``per_chunk`` in a job; the number of chunks that ran.

    A chunk's rows are written as a part of their own, then its videos are appended to the table of finished ones, which is the commit. A failure in
    ``work`` stops the run there and loses its chunk only. A chunk should be large enough to fill the cluster. Repeated ids count
    once, null ids are left out, a video without rows is finished too.
    """
    spark = videos.sparkSession
    ids = videos.select("video_id").where("video_id IS NOT NULL").distinct()
    done = finished(spark, path)
    if done is not None:
        ids = ids.join(done.select("video_id"), "video_id", "left_anti")
    todo = stored(ids, "todo")
    chunks = math.ceil(todo.count() / per_chunk)
    chunk = F.pmod(F.xxhash64("video_id"), F.lit(max(1, chunks)))
    for k in range(chunks):
        part = uuid.uuid4().hex
        own = todo.where(chunk == k)
        work(own).write.parquet(f"{path}/results/part={part}")
        own.withColumn("part", F.lit(part)).write.mode("append").parquet(f"{path}/done")
    return chunks
