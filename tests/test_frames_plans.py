"""Selection from previews, chunks of videos, hashes of any size in crowded windows, the length of scenes."""

import os
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from stillkeep.functions import pixels_arrow
from stillkeep.operators import dedup, reports, sampling, scenes
from stillkeep.plans.batches import finished, results, run_in_chunks
from stillkeep.plans.scoring import Providers
from stillkeep.plans.select_best import select_from_previews
from stillkeep.settings import CompositeSettings, DedupSettings, FaceSettings, SamplingSettings, SceneSettings, SelectionSettings, TechnicalSettings
from stillkeep.sources.previews import fetch_previews, write_previews
from stillkeep.storage import stored
from stillkeep.streaming import frames as streams


def plain_dedup(rows, similarity, window, threshold):
    """frame -> the frame that it repeats, or None; rows: (video, frame, t, hash, score)."""
    out, kept = {}, []
    for v, f, t, h, s in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        best = next((g for w, g, u, k in kept if w == v and abs(u - t) <= window and similarity(h, k) >= threshold), None)
        out[v, f] = best
        if best is None:
            kept.append((v, f, t, h))
    return out


def bits_alike(a, b, bits):
    return 1 - sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)) / bits


def hashes(rng, n, bits, flips):
    """Hashes as words of 64 bits, many of them near copies of an earlier one."""
    made = []
    for _ in range(n):
        x = rng.getrandbits(bits)
        if made and rng.random() < 0.6:
            x = rng.choice(made)
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(bits)
        made.append(x)
    words = -(-bits // 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [[signed(x >> 64 * k & (2**64 - 1)) for k in range(words)] for x in made]


@pytest.mark.parametrize("size,threshold", [(16, 0.9), (8, 0.9), (5, 0.95), (12, 0.93), (16, 0.5)])
@pytest.mark.parametrize("dense", [3, 1000])
def test_dedup_of_hashes_of_any_size(spark, size, threshold, dense):
    bits, rng = size * size, random.Random(size)
    own = hashes(rng, 90, bits, int(bits * (1 - threshold)) + 2)
    rows = [(v, k, round(rng.uniform(0, 12), 1), h, round(rng.random(), 1)) for v in (1, 2) for k, h in enumerate(own[v * 40 : v * 40 + 45])]
    df = spark.createDataFrame(rows, "video_id int, frame_index long, t double, hash array<long>, final_score double")
    similarity = dedup.hamming(bits, words=True)
    want = plain_dedup(rows, lambda a, b: bits_alike(a, b, bits), 2.0, threshold)
    got = {(r["video_id"], r["frame_index"]): r["retained_frame_index"] for r in dedup.deduplicate(df, similarity, 2.0, threshold, stretch=2, dense=dense).collect()}
    assert got == want and any(v is not None for v in want.values())


def test_pairs_made_in_a_crowded_window(spark):
    """A thousand frames in one window: candidates by bands stay near the pairs that are kept."""
    rng = random.Random(3)
    own = hashes(rng, 1000, 256, 20)
    df = spark.createDataFrame([(1, k, k / 1000, h, rng.random()) for k, h in enumerate(own)], "video_id int, frame_index long, t double, hash array<long>, final_score double")
    rows = dedup.ranked(df)
    bands = dedup.hash_bands(256, 0.9)
    assert len(bands) == 26 and bands[0][0] == 0 and bands[-1][1] == 256
    values = [[sum((h[b // 64] >> b % 64 & 1) << (b - low) for b in range(low, high)) for low, high in bands] for h in own]
    same = sum(any(x == y for x, y in zip(values[a], values[b], strict=True)) for a in range(0, 1000, 10) for b in range(1000) if a != b)
    kept = dedup.duplicate_pairs(rows, dedup.hamming(256), 5.0, 0.9)
    n = kept.count()
    assert n == dedup.duplicate_pairs(rows, dedup.hamming(256), 5.0, 0.9, dense=10**6).count() > 300
    assert same < 0.12 * 100 * 999  # of all pairs, those that share a band


def test_bands_lose_no_pair():
    rng = random.Random(4)
    for bits, threshold in ((64, 0.9), (256, 0.9), (144, 0.95), (256, 1.0), (25, 0.9)):
        bands = dedup.hash_bands(bits, threshold)
        differ = max(d for d in range(bits + 1) if 1 - d / bits >= threshold)
        assert sum(b - a for a, b in bands) == bits
        for _ in range(200):
            flipped = set(rng.sample(range(bits), differ))
            assert any(not flipped & set(range(a, b)) for a, b in bands)
    assert dedup.hash_bands(64, 0.6) is None and dedup.hash_bands(64, 1.5) is None


def test_scene_length_in_one_ordered_pass(spark):
    rng = random.Random(5)
    cuts = [(v, f) for v in range(6) for f in rng.sample(range(400), 80 * v)] + [(None, 30), (9, 5), (9, 12)]
    want = set()
    for v in {v for v, _ in cuts}:
        last = 0
        for f in sorted(f for w, f in cuts if w == v):
            if f - last >= 10:
                want.add((v, f))
                last = f
    got = scenes.min_scene_length(spark.createDataFrame(cuts, "video_id int, frame_index int").repartition(5), 10).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert not scenes.min_scene_length(spark.createDataFrame([], "video_id int, frame_index int"), 10).collect()


def previews(spark, videos, n, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(v, k, 8, 8, bytearray(np.repeat(rng.integers(0, 256, 64, dtype=np.uint8), 3).tobytes())) for v in range(videos) for k in range(n)]
    return spark.createDataFrame(rows, "video_id int, frame_index long, width int, height int, rgb binary")


def test_files_of_frames_that_are_not_wanted_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "store")
    made = previews(spark, 2, 12)
    write_previews(made, path, frames_per_slot=2)
    wanted = stored(spark.createDataFrame([(0, 3), (0, 9), (1, 0), (1, 0), (1, 99), (7, 1)], "video_id int, frame_index long"), "wanted")
    schema = spark.read.parquet(path).schema
    for folder, _, names in os.walk(path):
        if "slot=" in folder and not any(folder.endswith(f"video_id={v}/slot={v}-{k}") for v, k in ((0, 1), (0, 4), (1, 0))):
            for name in names:
                if name.endswith(".parquet"):
                    with open(f"{folder}/{name}", "wb") as f:
                        f.write(b"not parquet")
    got = fetch_previews(spark, path, wanted, 2, schema)
    want = made.join(wanted.distinct(), ["video_id", "frame_index"]).select("video_id", "frame_index", "rgb")
    assert sorted(map(tuple, got.select("video_id", "frame_index", "rgb").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="(?i)parquet"):  # the broken ones are really broken
        spark.read.schema(schema).parquet(path).select(F.max("rgb")).collect()


def test_only_sampled_frames_are_scored(spark, tmp_path):
    """From a preview store to selection, compared with scoring all frames and selecting afterwards."""
    path, asked = str(tmp_path / "store"), []
    made = previews(spark, 3, 40).withColumn("rgb", F.when((F.col("video_id") == 1) & (F.col("frame_index") == 10), F.lit(b"broken")).otherwise(F.col("rgb")))
    write_previews(made, path)
    frames = made.select("video_id", "frame_index", (F.col("frame_index") / 10).alias("t"), F.when(F.col("frame_index").isin(13, 27), 90).otherwise(1).alias("change"))

    def fetch(wanted):
        asked.append(wanted)
        return fetch_previews(spark, path, wanted)

    technical, hash_size = TechnicalSettings(luma_scale=255.0, sharpness_good_variance=90_000.0), 8
    settings = SceneSettings(3.0, 2, 2, 10), SamplingSettings(2.0), technical, FaceSettings(), CompositeSettings(), DedupSettings(0.7, 1.0, hash_size), SelectionSettings(2, 0.4, 3)
    out = select_from_previews(frames, "change", Providers(frames=fetch), *settings, reduce_factor=1)
    got = {(r["video_id"], r["frame_index"]): (r["scene_id"], r["reason"], r["selection_rank"]) for r in out.collect()}
    sc = scenes.detect_scenes(frames, "change", 3.0, 2, 10, 2)
    want = {tuple(r) for r in sampling.sample_exact(sampling.assign_scene(frames, sc), sc, 2.0).select("video_id", "frame_index").collect()}
    assert set(got) == want - {(1, 10)} and (1, 10) in want and len(want) < 40
    assert {(r[0], r[1]) for r in asked[0].select("video_id", "frame_index").collect()} == want
    scored = pixels_arrow.scored_frames(made, technical, hash_size, 1).where("error IS NULL").select("video_id", "frame_index", "global_score", "hash").collect()
    kept = [(r[0], r[1], r[1] / 10, r[3], r[2] * 0.4 + 0.3) for r in scored if (r[0], r[1]) in want]
    repeats = plain_dedup(kept, lambda a, b: bits_alike(a, b, 64), 1.0, 0.7)
    assert {k for k, v in got.items() if v[1] == "near duplicate"} == {k for k, v in repeats.items() if v is not None}
    assert sorted(v[2] for k, v in got.items() if v[2] and k[0] == 0) == [1, 2, 3]


def test_an_interrupted_run_keeps_its_finished_videos(spark, tmp_path):
    path = str(tmp_path / "batch")
    frames = spark.range(60).select((F.col("id") % 20).cast("int").alias("video_id"), F.col("id").alias("frame_index"))
    videos = frames.select("video_id").unionByName(spark.createDataFrame([(None,), (99,)], "video_id int"))  # 99 has no frames
    seen = []

    def work(own, broken=None):
        seen.append({r["video_id"] for r in own.collect()})
        rows = frames.join(own, "video_id", "left_semi")
        if broken is not None and len(seen) > broken:  # a task is lost in the middle of this chunk's job

            def killed(batches):
                yield from batches
                raise RuntimeError("executor lost")

            rows = rows.mapInArrow(killed, rows.schema)
        return rows

    assert finished(spark, path) is None and results(spark, path) is None
    with pytest.raises(PythonException, match="executor lost"):
        run_in_chunks(videos, lambda own: work(own, 2), path, per_chunk=5)
    first = set().union(*seen[:2])
    assert {r["video_id"] for r in finished(spark, path).collect()} == first and first
    assert results(spark, path).count() == 3 * len(first - {99})
    lost, before = seen[2], len(seen)
    run_in_chunks(videos, work, path, per_chunk=5)
    again = seen[before:]
    assert not first & set().union(*again) and lost <= set().union(*again)
    assert sorted(map(tuple, results(spark, path).collect())) == sorted(map(tuple, frames.collect()))
    assert {r["video_id"] for r in finished(spark, path).collect()} == {*range(20), 99}
    assert run_in_chunks(videos, work, path, per_chunk=5) == 0


def test_grid_points_are_those_of_repeated_addition():
    rng = random.Random(7)
    for _ in range(300):
        interval, point = rng.choice([1 / 3, 0.1, 1 / 24, 1.0, 2.5]), round(rng.uniform(0, 50), 2)
        t = point + rng.choice([-1, 0, 0.05, 1, 17.3, 900, interval, 3 * interval])
        slow = point
        while slow <= t:
            slow += interval
        assert streams.next_point(point, t, interval) == slow
    assert streams.next_point(0.0, 365 * 86_400.0, 1 / 3) > 365 * 86_400.0  # a camera that comes back after a year


def test_stream_of_many_scenes_with_late_frames(spark, tmp_path):
    """A scene for every half second of a video; frames come in two batches, some of them after a later frame of their cell."""
    sc = spark.createDataFrame([(v, k, k / 2, (k + 1) / 2) for v in range(3) for k in range(200)], "video_id int, scene_id int, start_time double, end_time double")
    order = [k for k in range(900) if k % 7] + [k for k in range(900) if k % 7 == 0]  # every seventh frame is late
    rows = [(v, k, k / 10) for v in range(3) for k in order]
    late = {k for k in range(900) if k % 7 == 0}
    for name, own in (("a", [r for r in rows if r[1] not in late]), ("b", [r for r in rows if r[1] in late])):
        part = spark.createDataFrame(own, "video_id int, frame_index long, t double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    schema = spark.read.parquet(str(tmp_path / "a")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    got = {(r["video_id"], r["scene_id"], r["frame_index"]) for r in streams.run_available(spark, streams.sampled_frames(stream, sc, 5.0, bucket=4.0), "late").collect()}
    want, point = set(), {}
    for batch in (sorted(r for r in rows if r[1] not in late), sorted(r for r in rows if r[1] in late)):
        for v, k, t in batch:
            scene = int(t * 2)
            at = point.get((v, scene), scene / 2)
            if t >= at:
                want.add((v, scene, k))
                while at <= t:
                    at += 0.2
                point[v, scene] = at
    assert got == want and len({s for _, s, _ in got}) == 180
    plan = streams.in_scenes(spark.read.parquet(str(tmp_path / "*")), sc, 4.0)._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.split("\n") if "Join" in line)
    assert join.count("_b#") >= 2 and join.count("video_id#") >= 2 and "NestedLoop" not in plan  # by video and bucket, not by time alone


def test_one_long_video_in_ranges(spark):
    """Scenes, gaps and grids over many ranges of time: the same as in one range, and as a loop."""
    rng = random.Random(8)
    sc, t = [], 0.3
    for k in range(12):
        length = rng.choice([0.2, 3.7, 11.0, 25.5])
        sc.append((1, k, t, t + length))
        t += length + rng.choice([0.0, 0.0, 6.4])
    sc.append((1, 99, 20.0, 60.0))  # over others
    times = sorted({round(rng.uniform(0, t + 5), 1) for _ in range(600)})
    frames = spark.createDataFrame([(1, k, x) for k, x in enumerate(times)], "video_id int, frame_index long, t double")
    scene_rows = spark.createDataFrame(sc, "video_id int, scene_id int, start_time double, end_time double")
    own = {k: min((s for s in sc if s[2] <= x < s[3]), key=lambda s: s[2], default=None) for k, x in enumerate(times)}
    for fps in (3.0, 0.13):
        want, point = set(), {s[1]: s[2] for s in sc}
        for k, x in enumerate(times):
            if own[k] and x >= point[own[k][1]]:
                want.add((own[k][1], k))
                while point[own[k][1]] <= x:
                    point[own[k][1]] += 1.0 / fps
        for width in (1.0, 7.0, 1e6):
            assigned = sampling.assign_scene(frames, scene_rows, width)
            assert {(r["frame_index"], r["scene_id"]) for r in assigned.collect()} == {(k, s[1]) for k, s in own.items() if s}
            got = sampling.sample_exact(assigned, scene_rows, fps, width)
            assert sorted((r["scene_id"], r["frame_index"]) for r in got.collect()) == sorted(want)


def test_totals_are_observed_while_results_are_written(spark, tmp_path):
    rows = [(1, None, 3, 2), (2, "broken", None, None), (3, None, None, 5), (4, None, 1, None)]
    df = spark.createDataFrame(rows, "video_id int, error string, selected_count int, exported_count int")
    want = reports.batch_totals(df).first().asDict()
    assert reports.write_with_totals(df, str(tmp_path / "r")) == want == {"successes": 3, "failures": 1, "selected": 4, "exported": 7}
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    assert reports.write_with_totals(df.where("false"), str(tmp_path / "e")) == dict.fromkeys(want, 0)
    for k in range(3):
        df.where(f"video_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    query = reports.observed(stream).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert reports.progress_so_far(query) == want
