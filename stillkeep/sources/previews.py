"""A store of previews that is read for the wanted frames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_WANTED = 2_000_000  # frames whose keys (some 30 MB) are broadcast to choose the partitions to open


def _slot(frames_per_slot: int) -> Column:
    """A run of frames of one video, as one value: partitions are chosen by each column for itself."""
    return F.concat_ws("-", F.col("video_id").cast("string"), F.expr(f"frame_index div {frames_per_slot}").cast("string")).alias("slot")


def write_previews(previews: DataFrame, path: str, frames_per_slot: int = 1) -> None:
    """Previews by video and slot, a run of ``frames_per_slot`` frames. A slot is the least that is read, so it should be about the sampling step."""
    slots = previews.select("*", _slot(frames_per_slot))
    slots.hint("rebalance", "video_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id", "slot").parquet(path)


def fetch_previews(spark: SparkSession, path: str, wanted: DataFrame, frames_per_slot: int = 1, schema: StructType | None = None) -> DataFrame:
    """The stored previews of the wanted frames (video_id, frame_index), each once; frames that the store lacks are left out.

    The wanted keys choose the partitions at run time, so no file of a slot without a wanted frame is opened. They are counted
    first: more than ``MOST_WANTED`` are joined without a broadcast, which reads all slots of the store; run such a batch in chunks.
    """
    keys = wanted.where("frame_index >= 0").select("video_id", "frame_index", _slot(frames_per_slot)).distinct()
    if keys.count() <= MOST_WANTED:
        keys = F.broadcast(keys)
    store = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return store.join(keys, ["video_id", "slot", "frame_index"], "left_semi").drop("slot")
