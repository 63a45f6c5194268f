"""Views of the driver's tables with the columns of the video model, in Spark and, for oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillkeep.functions.pixels import let
from stillkeep.storage import table

START_US = 1_704_067_200_000_000
DAY = 86_400.0


def sign_hash(embedding: Column, bits: int = 64) -> Column:
    """Bit i is set where element i is positive."""
    bit = lambda i: F.when(F.get(embedding, i) > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(bit(F.lit(i)), i))
    return out


def event_frames(spark: SparkSession, sf_dir: str, hashes: bool = False) -> DataFrame:
    """frames with scores: video_id, frame_index, t, content_cents, final_score, event_type (and hash)."""
    e = table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(START_US)) / F.lit(1e6)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("frame_index"),
        t.alias("t"),
        F.round(F.col("value") * 100).cast("bigint").alias("content_cents"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("final_score"),
        "event_type",
        "event_id",
    )
    if hashes:
        vectors = table(spark, sf_dir, "embeddings")
        own = vectors.select(F.col("vec_id").alias("_vec"), sign_hash(F.col("embedding")).alias("hash"))
        out = out.withColumn("_vec", F.col("event_id") % F.lit(max(1, vectors.count()))).join(own, "_vec").drop("_vec")
    return out


EVENTS_SQL = f"""ev AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
         (epoch_us(ts) - {START_US}) / 1e6::DOUBLE AS t, CAST(round(value * 100) AS BIGINT) AS content_cents,
         least(1.0::DOUBLE, value / 100.0::DOUBLE) AS final_score, event_type, event_id
  FROM events)"""

#: The vector of an event: every vector is some event's.
VECTOR_SQL = "event_id % (SELECT count(*) FROM embeddings)"


def sign_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slim rows for dedup: video_id, frame_index, t, hash, final_score."""
    h = sign_hash(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"),
        F.col("vec_id").alias("frame_index"),
        (F.col("vec_id") * F.lit(0.1)).alias("t"),
        h.alias("hash"),
        (F.bit_count(h) / 64.0).alias("final_score"),
    )


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 grey previews: frame_index, video_id, width, height, luma (array), rgb (binary)."""
    level = F.transform(
        "embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.25) * 510).cast("int")))
    )
    hexes = F.transform("luma", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3))
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"), F.lit(8).alias("width"), F.lit(8).alias("height"), level.alias("luma"))
        .withColumn("rgb", F.unhex(F.array_join(hexes, "")))
    )


def large_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x64 grey previews: each of the 8x8 values as a block with some grain."""
    small = pixel_frames(spark, sf_dir).select("video_id", "frame_index", "luma")

    def one(luma: Column, i: Column) -> Column:
        y, x = F.shiftright(i, 6), i % 64
        grain = (x * 7 + y * 13 + x * y) % 11
        return F.least(F.lit(255), F.get(luma, F.shiftright(y, 3) * 8 + F.shiftright(x, 3)) + grain)

    cells = lambda luma: F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.repeat(F.lpad(F.hex(one(luma, i)), 2, "0"), 3))
    rgb = F.unhex(F.array_join(let(F.col("luma"), cells), ""))
    return small.select("video_id", "frame_index", F.lit(64).alias("width"), F.lit(64).alias("height"), rgb.alias("rgb"))


def event_previews(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    """The 8x8 previews of the wanted events (video_id, frame_index, event_id): every vector is some event's, and only theirs are made into pixels."""
    vectors = pixel_frames(spark, sf_dir).select(F.col("frame_index").alias("_vec"), "width", "height", "rgb")
    n = F.lit(max(1, table(spark, sf_dir, "embeddings").count()))
    return wanted.select("video_id", "frame_index", (F.col("event_id") % n).alias("_vec")).join(vectors, "_vec").drop("_vec")


#: Thresholds of the 256-bit hashes of ``sign_words``, a word of 64 bits for each.
LEVELS = (0.1, 0.15, 0.2, 0.25)


def sign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slim rows for dedup with hashes of 256 bits: bit i of word k is set where element i is above level k."""
    word = lambda level: sign_hash(F.transform("embedding", lambda x: x.cast("double") - F.lit(level)))
    slim = sign_frames(spark, sf_dir).drop("hash")
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), F.array(*map(word, LEVELS)).alias("hash"))
    return slim.join(own, "frame_index")


PIXELS_SQL = """px AS (
  SELECT label AS video_id, vec_id AS frame_index,
         list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 0.25::DOUBLE) * 510) AS INTEGER)))) AS luma
  FROM embeddings)"""


def face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per face: frame_index (order), face_no and the seven measures."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_index"),
        F.row_number().over(order).alias("face_no"),
        F.lit(None).cast("double").alias("detection_confidence"),
        (F.col("l_quantity") / 400).alias("relative_size"),
        ((F.col("l_tax") * 100 - 4) * 10).alias("yaw_degrees"),
        F.when(F.col("l_returnflag") != "R", 1 - F.col("l_discount") * 10).alias("eyes_open"),
        F.when(F.col("l_linestatus") != "O", F.col("l_discount") * 10).alias("positive_expression"),
        (F.col("l_extendedprice") / 500).alias("sharpness_variance"),
        (F.col("l_linenumber") == 1).alias("is_cut_off"),
        (F.col("l_discount") * 10).alias("entry_score"),
        ((F.col("l_extendedprice") % 1000) / 1000).alias("x"),
        (F.col("l_quantity") / 50).alias("y"),
    )


FACES_SQL = """fc AS (
  SELECT l_orderkey AS frame_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS face_no,
         CAST(NULL AS DOUBLE) AS detection_confidence, l_quantity / 400 AS relative_size, (l_tax * 100 - 4) * 10 AS yaw_degrees,
         CASE WHEN l_returnflag <> 'R' THEN 1 - l_discount * 10 END AS eyes_open,
         CASE WHEN l_linestatus <> 'O' THEN l_discount * 10 END AS positive_expression,
         l_extendedprice / 500 AS sharpness_variance, l_linenumber = 1 AS is_cut_off, l_discount * 10 AS entry_score,
         (l_extendedprice % 1000) / 1000 AS x, l_quantity / 50 AS y
  FROM lineitem)"""
