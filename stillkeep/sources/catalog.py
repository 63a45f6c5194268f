"""Where videos and frames come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillkeep.storage import stored

# A fixed list: suffixes of video files.
VIDEO_SUFFIXES = (".avi", ".m4v", ".mkv", ".mov", ".mp4")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The files directly in a folder (name, is_file), their content unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit(True).alias("is_file"))


def catalog(files: DataFrame) -> DataFrame:
    """Video files by name, case folded; name and position (from 1, in name order)."""
    low = F.lower("name")
    videos = files.where(F.col("is_file") & F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(*VIDEO_SUFFIXES)).select("name", low.alias("low"))
    # ranges of names, each numbered by itself; what goes before a range is added up over one row for each range
    ranged = stored(videos.repartitionByRange("low", "name").withColumn("part", F.spark_partition_id()), "names")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("part").orderBy("low", "name")
    return ranged.withColumn("n", F.row_number().over(order)).join(offset, "part").select("name", (F.col("n") + F.col("offset")).alias("position"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames; those without a time drop, and the stored frame_index is kept as numbered before."""
    return spark.read.parquet(path).where("t IS NOT NULL")


_TAGS = "struct<rotate:string,creation_time:string>"
PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:string,height:string,avg_frame_rate:string,nb_frames:string,bit_rate:string,"
    f"side_data_list:array<struct<rotation:string>>,tags:{_TAGS}>>, format struct<duration:string,bit_rate:string,tags:{_TAGS}>"
)


def probe_to_info(probes: DataFrame) -> DataFrame:
    """path, json -> one row per video with codec, size, rate, counts, orientation, time, or probe_error.

    The first stream of type video counts. Checks go streams, frame rate, codec, width, height, and the first that fails is
    probe_error; such a row has only its path.
    """
    c = F.col
    integer = lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x)).try_cast("bigint")
    parsed = probes.select("path", F.from_json("json", PROBE).alias("p"))
    video = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    v = parsed.select("path", "p", video.alias("v"))
    rate = c("v.avg_frame_rate")
    whole = F.when(F.instr(rate, "/") > 0, F.try_divide(integer(F.split_part(rate, F.lit("/"), F.lit(1))).cast("double"), integer(F.split_part(rate, F.lit("/"), F.lit(2))).cast("double")))
    turn = F.get(F.filter(F.transform("v.side_data_list", lambda d: integer(d["rotation"])), lambda x: x.isNotNull()), F.lit(0))
    own = v.select(
        "path",
        F.when(c("p.streams").isNull(), "no_streams")
        .when(c("v").isNull(), "no_video_stream")
        .when(~F.coalesce(whole > 0, F.lit(False)), "invalid:fps")
        .when(F.coalesce(c("v.codec_name"), F.lit("")) == "", "missing:codec_name")
        .when(~F.coalesce(integer(c("v.width")) > 0, F.lit(False)), "invalid:width")
        .when(~F.coalesce(integer(c("v.height")) > 0, F.lit(False)), "invalid:height")
        .alias("probe_error"),
        c("v.codec_name").alias("codec"),
        integer(c("v.width")).cast("int").alias("width"),
        integer(c("v.height")).cast("int").alias("height"),
        whole.alias("fps"),
        c("p.format.duration").try_cast("double").alias("duration_seconds"),
        integer(c("v.nb_frames")).alias("exact"),
        F.coalesce(F.nullif(integer(c("v.bit_rate")), F.lit(0)), integer(c("p.format.bit_rate"))).alias("bitrate"),
        F.pmod(F.coalesce(turn, integer(c("v.tags.rotate")), F.lit(0)), F.lit(360)).cast("int").alias("orientation_degrees"),
        c("p.format.tags.creation_time").try_cast("timestamp").alias("creation_time"),
    )
    count = F.coalesce("exact", F.bround(c("duration_seconds") * c("fps"), 0).cast("bigint"))
    values = {n: c(n) for n in ("codec", "width", "height", "fps")} | {"approximate_frame_count": count}
    values |= {n: c(n) for n in ("duration_seconds", "bitrate", "orientation_degrees", "creation_time")}
    return own.select("path", *(F.when(c("probe_error").isNull(), e).alias(n) for n, e in values.items()), "probe_error")
