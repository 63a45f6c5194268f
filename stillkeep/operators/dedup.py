"""Greedy near-duplicate removal as a fix-point on the better-to-worse graph."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stillkeep.storage import shuffled, stored


@dataclass(frozen=True)
class Similarity:
    """A similarity: the column it compares, and the expression on two of them. bits: of a hash compared by Hamming distance."""

    column: str
    of: Callable[[Column, Column], Column]
    bits: int | None = None


def hamming(bits: int = 64, words: bool | None = None) -> Similarity:
    """The share of equal bits of the column hash: one bigint, or (``words``, the rule for more than 64 bits) an array of them, as scoring gives it."""
    if words or words is None and bits > 64:
        different = lambda a, b: sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(-(-bits // 64))), F.lit(0))
    else:
        different = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    return Similarity("hash", lambda a, b: 1 - different(a, b) / F.lit(float(bits)), bits)


def cosine(column: str = "embedding") -> Similarity:
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    return Similarity(column, lambda a, b: dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def ranked(candidates: DataFrame) -> DataFrame:
    """With rank: best first in each video, equal scores in frame order."""
    order = Window.partitionBy("video_id").orderBy(F.col("final_score").desc(), "frame_index")
    return candidates.withColumn("rank", F.row_number().over(order))


def hash_bands(bits: int, threshold: float) -> list[tuple[int, int]] | None:
    """Ranges of bits of which one at least is equal in every pair at the threshold: one more than bits may differ.

    None where ranges are so short that unlike hashes would often share one, and comparing all pairs is cheaper.
    """
    differ = max((d for d in range(bits + 1) if 1 - d / bits >= threshold), default=-1)
    n = differ + 1
    if n < 1 or n > bits or n >= 2 ** (bits // n):
        return None
    return [(bits * k // n, bits * (k + 1) // n) for k in range(n)]


def _band_value(words: Column, low: int, high: int) -> Column:
    """The bits from ``low`` to ``high`` of a hash in words of 64 bits; a range over several words is hashed."""
    parts = []
    while low < high:
        word, at = divmod(low, 64)
        n = min(high - low, 64 - at)
        own = F.shiftrightunsigned(F.get(words, F.lit(word)), at)
        parts.append(own if n == 64 else own.bitwiseAND(F.lit((1 << n) - 1)))
        low += n
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def duplicate_pairs(candidates: DataFrame, similarity: Similarity, window: float, threshold: float, dense: int = 64) -> DataFrame:
    """Pairs of one video within the time window and at the similarity or more, both inclusive, better to worse.

    Buckets of time, a little wider than the window, make it an equi-join: a frame meets those of its own bucket and of the next. In a bucket
    of more than ``dense`` frames hashes must share a band too (see ``hash_bands``), which loses no pair: a pair is
    made at the first band that it shares. Results do not depend on ``dense``.
    """
    column = similarity.column
    slim = candidates.select("video_id", "frame_index", "t", "rank", column, F.floor(F.col("t") / F.lit(window * 1.001)).alias("_b"))
    bands = hash_bands(similarity.bits, threshold) if similarity.bits else None
    keys = ["video_id", "_b"]
    if bands:
        words = F.col(column) if isinstance(slim.schema[column].dataType, ArrayType) else F.array(column)
        slim = slim.withColumn("_values", F.array(*(_band_value(words, *x) for x in bands)))
        crowded = slim.groupBy("video_id", "_b").count().where(F.col("count") > dense).select("video_id", "_b", F.lit(True).alias("_crowded"))
        keys += ["_band", "_value"]

    def placed(rows: DataFrame, name: str) -> DataFrame:
        """A row in its bucket, and there under each band where the bucket is crowded."""
        inside = F.struct("frame_index", "t", "rank", column, "_own", *(["_values"] if bands else []))
        if not bands:
            return rows.select("video_id", "_b", inside.alias(name))
        one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("bigint").alias("value")))
        several = F.transform("_values", lambda v, k: F.struct(k.alias("band"), v.alias("value")))
        marked = rows.join(crowded, ["video_id", "_b"], "left").withColumn("_k", F.explode(F.when(F.col("_crowded"), several).otherwise(one)))
        return marked.select("video_id", "_b", F.col("_k.band").alias("_band"), F.col("_k.value").alias("_value"), inside.alias(name))

    near = slim.withColumn("_own", F.col("_b")).withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    pairs = placed(near, "l").join(shuffled(placed(slim.withColumn("_own", F.col("_b")), "r")), keys)
    once = (F.col("l._own") < F.col("r._own")) | (F.col("l.rank") < F.col("r.rank"))
    if bands:
        shared = F.zip_with("l._values", "r._values", lambda a, b: a == b)
        once &= (F.col("_band") < 0) | (F.array_position(shared, True) == F.col("_band") + 1)
    first = F.col("l.rank") < F.col("r.rank")
    better, worse = (F.when(first, F.col(a)).otherwise(F.col(b)) for a, b in (("l", "r"), ("r", "l")))
    return (
        pairs.where(F.abs(F.col("l.t") - F.col("r.t")) <= window)
        .where(once)
        .withColumn("similarity", similarity.of(F.col(f"l.{column}"), F.col(f"r.{column}")))
        .where(F.col("similarity") >= threshold)
        .select("video_id", better.alias("b"), worse.alias("w"), "similarity", F.abs(F.col("l.t") - F.col("r.t")).alias("time_delta_seconds"))
        .select(
            "video_id",
            F.col("b.frame_index").alias("better"),
            F.col("w.frame_index").alias("worse"),
            F.col("b.rank").alias("better_rank"),
            F.col("w.rank").alias("worse_rank"),
            F.col("b.t").alias("better_t"),
            F.col("w.t").alias("worse_t"),
            "similarity",
            "time_delta_seconds",
        )
    )


_EDGE = ("better", "worse", "better_rank", "worse_rank", "better_here", "worse_here", "better_kept")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by video and part: the frames of each part, best first, with kept true, false or (not known yet) null."""
    start = next(batches, None)
    if start is None:
        return
    types = {"video_id": start.schema.field("video_id").type, "frame_index": start.schema.field("better").type, "kept": pa.bool_()}
    for _, own in itertools.groupby(_edges(itertools.chain([start], batches)), key=lambda e: (e[0], e[1])):
        rank: dict[int, int] = {}
        above: dict[int, list[int]] = {}
        kept: dict[int, bool | None] = {}
        video = None
        for video, _, better, worse, better_rank, worse_rank, better_here, worse_here, known in own:  # noqa: B007
            if known is not None:
                kept[better] = known
            elif better_here:
                rank[better] = better_rank
            if worse_here:
                rank[worse] = worse_rank
                above.setdefault(worse, []).append(better)
        frames = sorted(rank, key=rank.__getitem__)
        for frame in frames:
            states = [kept.get(b) for b in above.get(frame, ())]
            kept[frame] = False if any(states) else True if all(x is False for x in states) else None
        out = {"video_id": [video] * len(frames), "frame_index": frames, "kept": [kept[f] for f in frames]}
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], list(types))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("video_id", "part", *_EDGE)), strict=True)


def deduplicate(candidates: DataFrame, similarity: Similarity, window: float, threshold: float, stretch: int = 500, dense: int = 64) -> DataFrame:
    """Candidates with state kept or duplicate; duplicates with the best kept one that they repeat.

    A round decides all frames that it can inside stretches of ``stretch`` windows of time, best first: kept, if every better
    neighbour is a duplicate; duplicate, if one is kept; else open until a neighbour from another stretch is decided. Only the edges
    of open frames go to the next round, in which stretches are moved by half, so rounds grow with the number of stretches that a
    chain of falling scores goes through. A task reads its edges in one ordered pass and holds those of one stretch.
    """
    rows = stored(ranked(candidates), "ranked")
    edges = stored(duplicate_pairs(rows, similarity, window, threshold, dense), "edges")
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("video_id", "better")}
    live = edges.withColumn("better_kept", F.lit(None).cast("boolean"))
    kept, turn = None, 0
    while True:
        part = lambda t: F.floor(F.col(t) / F.lit(window * stretch) + F.lit(turn % 2 / 2))  # noqa: B023, E731
        here = live.withColumn("part", F.explode(F.array_distinct(F.array(part("better_t"), part("worse_t")))))
        ends = here.withColumns({"better_here": part("better_t") == F.col("part"), "worse_here": part("worse_t") == F.col("part")})
        ordered = ends.select("video_id", "part", *_EDGE).repartition("video_id", "part").sortWithinPartitions("video_id", "part")
        state = stored(ordered.mapInArrow(_decided, f"video_id {kinds['video_id']}, frame_index {kinds['better']}, kept boolean"), "decided")
        own = state.where("kept").select("video_id", "frame_index")
        kept = own if kept is None else kept.unionByName(own)
        turn += 1
        left = state.where("kept IS NULL")
        if left.isEmpty():
            break
        # a frame that is not in this state was decided before; edges from duplicates no longer count
        known = state.select("video_id", F.col("frame_index").alias("better"), F.col("kept").alias("_new"))
        live = live.join(left.select("video_id", F.col("frame_index").alias("worse")), ["video_id", "worse"], "left_semi").join(known, ["video_id", "better"], "left")
        live = stored(live.withColumn("better_kept", F.coalesce("better_kept", "_new")).drop("_new"), "live")
    found = (
        edges.join(kept.withColumnRenamed("frame_index", "better"), ["video_id", "better"])  # whoever has a better kept neighbour is a duplicate
        .groupBy("video_id", F.col("worse").alias("frame_index"))
        .agg(F.min_by(F.struct("better", "similarity", "time_delta_seconds"), "better_rank").alias("k"))
        .select(
            "video_id",
            "frame_index",
            F.lit("duplicate").alias("state"),
            F.col("k.better").alias("retained_frame_index"),
            F.col("k.similarity").alias("similarity"),
            F.col("k.time_delta_seconds").alias("time_delta_seconds"),
        )
    )
    return rows.join(found, ["video_id", "frame_index"], "left").withColumn("state", F.coalesce("state", F.lit("kept")))


def deduplicate_by_group(candidates: DataFrame, window: float, threshold: float, bits: int = 64) -> DataFrame:
    """The same as ``deduplicate`` on 64-bit hashes, one task per video: for many short videos. (video_id, frame_index, state)

    Kept frames lie in the order of time, so a frame is compared with those of its window only.
    """

    def walk(video: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, int]] = []
        states = []
        time = lambda k: k[0]
        for row in video.sort_values(["final_score", "frame_index"], ascending=[False, True]).itertuples():
            # a little wider than the window, whose exact bound is the difference below
            a, b = bisect_left(kept, row.t - window * 1.001, key=time), bisect_right(kept, row.t + window * 1.001, key=time)
            again = any(
                abs(row.t - t) <= window and 1 - ((row.hash ^ h) & (2**64 - 1)).bit_count() / bits >= threshold for t, h in kept[a:b]
            )
            if not again:
                insort(kept, (row.t, row.hash))
            states.append((row.video_id, row.frame_index, "duplicate" if again else "kept"))
        return pd.DataFrame(states, columns=["video_id", "frame_index", "state"])

    slim = candidates.select("video_id", "frame_index", "t", "hash", "final_score")
    kinds = dict(slim.dtypes)
    return slim.groupBy("video_id").applyInPandas(walk, f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, state string")
