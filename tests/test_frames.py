"""Worked examples and sequential restatements of the frame operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillkeep.functions import pixels, pixels_arrow
from stillkeep.operators import composite, dedup, faces, sampling, scenes, selection
from stillkeep.settings import CompositeSettings, ExportSettings, FaceSettings, SelectionSettings, TechnicalSettings
from stillkeep.sources import catalog


def test_catalog(spark):
    files = spark.createDataFrame([("B.MOV", True), ("a.mp4", True), ("notes.txt", True), ("dir.mp4", False)], "name string, is_file boolean")
    assert [r["name"] for r in catalog.catalog(files).orderBy("position").collect()] == ["a.mp4", "B.MOV"]


def test_probe(spark):
    good = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"30000/1001","nb_frames":"300","side_data_list":[{"rotation":-90}]}],"format":{"bit_rate":"5","tags":{"creation_time":"2024-06-01T12:30:00Z"}}}'
    half = '{"streams":[{"codec_type":"video","codec_name":"hevc","width":"640","height":"480","avg_frame_rate":"24/1","nb_frames":"N/A","tags":{"rotate":"90"}}],"format":{"duration":"2.5"}}'
    rows = {r["path"]: r for r in catalog.probe_to_info(spark.createDataFrame([("a", good), ("b", half), ("c", '{"streams":[]}'), ("d", "no json")], "path string, json string")).collect()}
    assert (rows["a"]["approximate_frame_count"], rows["a"]["orientation_degrees"], rows["a"]["bitrate"]) == (300, 270, 5)
    assert (rows["b"]["approximate_frame_count"], rows["b"]["orientation_degrees"], rows["b"]["width"]) == (60, 90, 640)
    assert (rows["c"]["probe_error"], rows["d"]["probe_error"]) == ("no_video_stream", "no_streams")


def test_sampler(spark):
    frames = spark.createDataFrame([(1, i, t) for i, t in ((0, 0.0), (10, 0.34), (20, 0.67), (30, 1.0), (40, 1.34))], "video_id int, frame_index long, t double")
    sc = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 2.0)], "video_id int, scene_id int, start_time double, end_time double")
    out = sampling.sample_exact(sampling.assign_scene(frames, sc), sc, 3.0).orderBy("frame_index").collect()
    assert [(r["scene_id"], r["t"]) for r in out] == [(1, 0.0), (1, 0.34), (1, 0.67), (2, 1.0), (2, 1.34)]


def test_exact_grid_equals_repeated_addition(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for video in range(20):
        start, fps = rng.choice([0.0, rng.random()]), 3.0
        times = [start + k / 30 for k in range(120)]
        rows += [(video, k, t) for k, t in enumerate(times)]
        nxt = start
        for k, t in enumerate(times):
            if t >= nxt and t < 5.0:
                want.add((video, k))
                while nxt <= t:
                    nxt += 1.0 / fps
    frames = spark.createDataFrame(rows, "video_id int, frame_index long, t double")
    first = frames.groupBy("video_id").agg(F.min("t").alias("start_time"))
    sc = first.select("video_id", F.lit(1).alias("scene_id"), "start_time", F.lit(5.0).alias("end_time"))
    got = sampling.sample_exact(sampling.assign_scene(frames, sc), sc, 3.0).collect()
    assert {(r["video_id"], r["frame_index"]) for r in got} == want


def test_scenes_without_cuts(spark):
    videos = spark.createDataFrame([(1, 4.0), (2, 0.0)], "video_id int, duration double")
    none = spark.createDataFrame([], "video_id int, t double")
    assert [tuple(r) for r in scenes.boundaries_to_scenes(videos, none).collect()] == [(1, 1, 0.0, 4.0, 4.0)]


def test_refine(spark):
    frames = spark.createDataFrame([(1, 8, 0.8, 0.5), (1, 10, 1.0, 0.9), (1, 12, 1.2, 0.8)], "video_id int, frame_index long, t double, final_score double")
    ranked = spark.createDataFrame([(1, 10, 1.0, 1, 0.9), (1, 12, 1.2, 1, 0.8)], "video_id int, frame_index long, t double, scene_id int, final_score double")
    assert {(r["target_frame"], r["frame_index"]) for r in sampling.refine(frames, ranked, 0.5, 2).collect()} == {(10, 10), (12, 10)}


def test_dedup_against_greedy(spark):
    rng = random.Random(2)
    rows = [(v, k, round(rng.random() * 20, 2), rng.getrandbits(63), rng.choice([0.5, 0.7, rng.random()])) for v in range(4) for k in range(40)]
    want = {}
    for v in range(4):
        kept = []
        for _, k, t, h, _s in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[4], r[1])):
            hit = next((q for q in kept if abs(q[1] - t) <= 5 and 1 - (q[2] ^ h).bit_count() / 64 >= 0.55), None)
            want[v, k] = hit[0] if hit else None
            if not hit:
                kept.append((k, t, h))
    df = spark.createDataFrame(rows, "video_id int, frame_index long, t double, hash long, final_score double")
    got = dedup.deduplicate(df, dedup.hamming(), 5.0, 0.55).collect()
    assert {(r["video_id"], r["frame_index"]): r["retained_frame_index"] for r in got} == want
    groups = dedup.deduplicate_by_group(df, 5.0, 0.55).collect()
    assert {(r["video_id"], r["frame_index"]): r["state"] == "kept" for r in groups} == {k: v is None for k, v in want.items()}


def _decide(spark, rows, **settings):
    df = spark.createDataFrame([(1, k, s, x, d, True) for k, (s, x, d) in enumerate(rows)], "video_id int, frame_index long, scene_id int, final_score double, is_duplicate boolean, is_known boolean")
    return selection.decide(df, SelectionSettings(**settings)).collect()


def test_round_robin(spark):
    out = _decide(spark, [(1, 0.90, False), (1, 0.89, False), (2, 0.80, False), (2, 0.70, False)], count=4)
    assert [r["scene_id"] for r in sorted(out, key=lambda r: r["selection_rank"])] == [1, 2, 1, 2]


def test_rejections(spark):
    out = _decide(spark, [(1, 0.9, False), (1, 0.8, False), (1, 0.7, False), (1, 0.6, False), (2, 0.4, False), (1, 0.95, True)], count=20)
    assert [r["reason"] for r in sorted(out, key=lambda r: r["frame_index"])] == [None, None, None, "maximum per scene reached", "score below minimum", "near duplicate"]


def test_composite(spark):
    df = spark.createDataFrame([(1, 0.8, None, None, None), (2, 0.8, 0.9, None, None), (3, 0.8, None, 0.9, 0.1)], "frame_index int, technical double, face double, aesthetic double, composition double")
    out = {r["frame_index"]: r for r in composite.composite_score(df, CompositeSettings()).collect()}
    assert [round(out[k]["final_score"], 6) for k in (1, 2, 3)] == [0.62, 0.75, 0.66]
    assert out[2]["reasons"][0]["criterion"] == "face"


def test_faces(spark):
    rows = [(1, 1, 0.9, 0.15, 0.0, 1.0, 0.8, 250.0, False), (1, 2, 0.9, 0.15, 45.0, 0.0, 0.8, 0.0, True)]
    df = spark.createDataFrame(rows, "frame_index int, face_no int, detection_confidence double, relative_size double, yaw_degrees double, eyes_open double, positive_expression double, sharpness_variance double, is_cut_off boolean")
    r = faces.group_face_score(df, FaceSettings()).first()
    assert (r["orientation"], r["eyes_open"], r["sharpness"], r["crop"]) == (0, 0, 0, 0) and r["global_score"] < 0.5
    frames = spark.createDataFrame([(2,)], "frame_index int")
    assert faces.with_face_score(frames, faces.group_face_score(df, FaceSettings())).first()["global_score"] is None


def test_technical_relations():
    s = TechnicalSettings(sharpness_min_variance=0.001, sharpness_good_variance=0.05)
    board = (np.indices((64, 64)).sum(axis=0) // 8 % 2 * 255).astype(float)
    blurred = board.copy()
    for _ in range(4):
        p = np.pad(blurred, 1, mode="edge")
        blurred = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + p[1:-1, 1:-1]) / 5
    sharp, soft = pixels_arrow.technical(board, s), pixels_arrow.technical(blurred, s)
    assert pixels_arrow.laplacian(board).var() > pixels_arrow.laplacian(blurred).var()
    assert all(0 <= v <= 1 for m in (sharp, soft) for v in m.values())
    dark, grey = pixels_arrow.technical(np.full((64, 64), 5.0), s), pixels_arrow.technical(np.full((64, 64), 128.0), s)
    assert dark["exposure"] < grey["exposure"] and dark["underexposed_pixels"] == 0


def test_pixel_paths_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(1, k, 8, 8, [int(x) for x in rng.integers(0, 256, 64)]) for k in range(20)]
    df = spark.createDataFrame(rows, "video_id int, frame_index long, width int, height int, luma array<int>")
    hexes = F.transform("luma", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3))
    df = df.withColumn("rgb", F.unhex(F.array_join(hexes, "")))
    s = TechnicalSettings(luma_scale=255.0)
    m = pixels.technical_measures(F.col("luma"), 8, 8, s)
    native = {r["frame_index"]: r for r in df.select("frame_index", *(c.alias(n) for n, c in m.items())).collect()}
    for r in pixels_arrow.scored_frames(df, s, 8, 1).collect():
        assert all(math.isclose(r[k], native[r["frame_index"]][k], abs_tol=1e-9) for k in pixels_arrow.MEASURES)


def test_phash_of_equal_pictures_and_odd_sizes():
    board = (np.indices((32, 32)).sum(axis=0) // 4 % 2 * 255).astype(float)
    assert (pixels_arrow.phash(board, 8, 4) == pixels_arrow.phash(board.copy(), 8, 4)).all()
    assert pixels_arrow.phash(board[:, :20], 8, 4).shape == (64,)


def test_settings_are_checked():
    for make in (lambda: ExportSettings("gif"), lambda: ExportSettings(jpeg_quality=0), lambda: SelectionSettings(count=0), lambda: SelectionSettings(minimum_score=2.0)):
        with pytest.raises(ValueError):
            make()
