"""Overlaps, chains, streams in several batches, sinks, reports and providers."""

import json
import random
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stillkeep import queries
from stillkeep.functions import pixels_arrow
from stillkeep.operators import dedup, reports, sampling
from stillkeep.plans.scoring import Providers, score_videos
from stillkeep.plans.select_best import resume
from stillkeep.queries import ORACLES, QUERIES
from stillkeep.settings import CompositeSettings, ExportSettings, FaceSettings, TechnicalSettings
from stillkeep.sources import catalog, sinks
from stillkeep.streaming import frames as streams


def test_overlapping_scenes_by_earliest_start(spark):
    rng = random.Random(4)
    scenes = [(v, k, round(a, 1), round(a + rng.choice([0.0, 0.5, 2.0, 5.0]), 1)) for v in range(3) for k, a in enumerate(rng.uniform(0, 10) for _ in range(8))]
    frames = [(v, k, k / 10) for v in range(3) for k in range(150)]
    want = {}
    for v, k, t in frames:
        own = min(((a, s) for w, s, a, b in scenes if w == v and a <= t < b), default=None)
        if own:
            want[v, k] = own[::-1]
    f = spark.createDataFrame([*frames, (0, 999, None)], "video_id int, frame_index long, t double")
    s = spark.createDataFrame(scenes, "video_id int, scene_id int, start_time double, end_time double")
    got = {(r["video_id"], r["frame_index"]): (r["scene_id"], r["scene_start"]) for r in sampling.assign_scene(f, s).collect()}
    assert got == want
    assert sampling.assign_scene(f, s.where("false")).count() == 0


def test_dedup_of_a_fading_shot(spark):
    """Scores fall along a chain of like frames over many stretches; rounds follow stretches, not frames."""
    rows = [(1, k, k * 1.0, 0, 1 - k / 1000) for k in range(300)] + [(2, k, 0.0, k % 3, 0.5) for k in range(9)]
    df = spark.createDataFrame(rows, "video_id int, frame_index long, t double, hash long, final_score double")
    out = dedup.deduplicate(df, dedup.hamming(), 1.0, 0.99, stretch=60).collect()
    kept = sorted((r["video_id"], r["frame_index"]) for r in out if r["state"] == "kept")
    assert kept == [(1, k) for k in range(0, 300, 2)] + [(2, 0), (2, 1), (2, 2)]
    assert all(r["retained_frame_index"] == r["frame_index"] - 1 for r in out if r["video_id"] == 1 and r["state"] == "duplicate")


def test_stream_in_several_batches(spark, tmp_path):
    scenes = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 9.0)], "video_id int, scene_id int, start_time double, end_time double")
    times = [0.0, 0.2, 0.34, 0.5, 0.67, 0.9, 1.0, 1.99, 2.1, 2.2, 2.5, 8.9, 9.5]
    rows = [(1, k, t) for k, t in enumerate(times)]
    for n in range(3):
        part = spark.createDataFrame(rows[n * 5 : n * 5 + 5], "video_id int, frame_index long, t double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = streams.read_stream(spark, str(tmp_path), lambda s: s)
    frames = spark.readStream.schema(spark.read.parquet(str(tmp_path)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    static = spark.read.parquet(str(tmp_path))
    want = {tuple(r) for r in sampling.sample_exact(sampling.assign_scene(static, scenes), scenes, 3.0).select("scene_id", "frame_index").collect()}
    for stream in (source, frames):
        got = {(r["scene_id"], r["frame_index"]) for r in streams.run_available(spark, streams.sampled_frames(stream, scenes, 3.0), "t").collect()}
        assert got == want


def test_running_means_in_several_batches(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(1, 1, 0.5 * n), (1, 2, 1.0)], "video_id int, scene_id int, technical double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("video_id int, scene_id int, technical double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    out = streams.run_available(spark, streams.running_means(stream), "m", ["video_id", "scene_id"]).collect()
    assert {(r["scene_id"], r["n_candidates"], r["mean_technical"]) for r in out} == {(1, 2, 0.25), (2, 2, 1.0)}


def test_listing_of_a_folder(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "d.mp4").write_bytes(b"x")
    rows = catalog.catalog(catalog.listing(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r["name"], r["position"]) for r in rows] == [("a.mkv", 1), ("b.MP4", 2)]


def test_positions_over_many_ranges(spark):
    names = [f"IMG_{k:04d}.mp4" for k in range(500)]
    random.Random(1).shuffle(names)
    files = spark.createDataFrame([(n, True) for n in names], "name string, is_file boolean").repartition(7)
    assert {r["name"]: r["position"] for r in catalog.catalog(files).collect()} == {n: k + 1 for k, n in enumerate(sorted(names))}


def test_manifests(spark, tmp_path):
    rows = [(v, f, 1 + f % 2, f / 4, 0.9 - f / 10_000, 3000 - f, 1920, 1080, 960, 540) for v in ("a", 'b "c"', "d=e") for f in range(2 if v != "a" else 2500)]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, scene_id int, t double, final_score double, selection_rank int, source_width int, source_height int, preview_width int, preview_height int")
    df = df.withColumn("source_height", F.when(F.col("frame_index") != 1, F.col("source_height"))).repartition(7)
    path, videos = str(tmp_path / "c"), spark.createDataFrame([("a",), ("empty",), ("empty",), (None,)], "video_id string")
    sinks.write_manifests(sinks.candidate_items(df), path, "candidates", videos)
    made = {m["source_video"]: m["candidates"] for m in (json.loads(r["value"]) for r in sinks.read_manifests(spark, path).collect())}
    assert {v: [c["frame_index"] for c in m] for v, m in made.items()} == {"a": list(range(2500)), 'b "c"': [0, 1], "d=e": [0, 1], "empty": []}
    assert made["a"][1]["file"] == "scene_002_frame_00000001.jpg" and made["a"][1]["source_height"] is None and made["a"][0]["preview_height"] == 540
    path = str(tmp_path / "s")
    items = sinks.selection_items(df, ExportSettings("png", 5), F.struct(F.col("final_score").alias("technical")))
    sinks.write_manifests(items, path, "images")
    sinks.write_manifests(items.where("video_id = 'a' AND position > 2990"), path, "images")  # replaces that video only
    best = {m["source_video"]: m["images"] for m in (json.loads(r["value"]) for r in sinks.read_manifests(spark, path).collect())}
    assert [(i["frame"], i["file"]) for i in best["a"]] == [(f, f"a_{3000 - f:04d}.png") for f in range(9, -1, -1)]
    assert [(i["frame"], i["scores"]["technical"]) for i in best['b "c"']] == [(1, 0.9 - 1 / 10_000), (0, 0.9)]
    sinks.write_manifests(items.where("false"), str(tmp_path / "none"), "images")
    assert {r["format"] for r in sinks.export_plan(df, ExportSettings("png")).collect()} == {"png"}


def test_previews_replace_their_video_only_and_a_run_resumes(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1)], "video_id int, frame_index long, scene_id int")
    resume(rows.where("video_id = 1"), path)
    resume(rows.withColumn("frame_index", F.col("frame_index") + 100), path)  # video 1 is done already
    got = {(r["video_id"], r["frame_index"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 1), (1, 2), (2, 103)}
    sinks.store_previews(rows.where("video_id = 2"), path)
    assert {(r["video_id"], r["frame_index"]) for r in spark.read.parquet(path).collect()} == {(1, 1), (1, 2), (2, 3)}
    counts = {r["video_id"]: (r["n_previews"], r["scene_counts"]) for r in sinks.preview_counts(spark.read.parquet(path)).collect()}
    assert counts == {1: (2, {1: 1, 2: 1}), 2: (1, {1: 1})}


def test_reports(spark):
    info = catalog.probe_to_info(spark.createDataFrame([("a", "{}"), ("b", '{"streams":[{"codec_type":"video","codec_name":"h264","width":64,"height":48,"avg_frame_rate":"25/1"}],"format":{"duration":"2","tags":{"creation_time":"2024-01-02T03:04:05Z"}}}')], "path string, json string"))
    lines = {r["path"]: r["line"] for r in reports.video_lines(info).collect()}
    assert lines["b"] == "file: b; codec: h264; size: 64x48; fps: 25.000; frames: 50; duration: 2.000; bitrate: unavailable; orientation: 0; created: 2024-01-02T03:04:05Z"
    assert lines["a"].startswith("file: a; codec: unavailable; size: unavailable")
    results = spark.createDataFrame([(1, None, 2, 2), (2, "bad", None, None), (3, None, 1, None)], "video_id int, error string, selected_count int, exported_count int")
    assert tuple(reports.batch_totals(results).first()) == (2, 1, 3, 2)
    states = [(r["video_id"], r["state"]) for r in reports.progress_totals(reports.progress_events(results)).orderBy("video_id", "seq").collect()]
    assert states == [(1, "started"), (1, "selected"), (1, "exported"), (1, "exported"), (1, "completed"), (2, "started"), (2, "failed"), (3, "started"), (3, "selected"), (3, "completed")]


def test_face_boxes_are_rounded_half_to_even_and_may_be_empty(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (7, 10)).astype(float)
    assert pixels_arrow.box_sharpness(g, (0.05, 0.0, 0.55, 1.0)) == float(pixels_arrow.laplacian(g[:, 0:6]).var())  # 0.5 -> 0, 5.5 -> 6
    assert pixels_arrow.box_sharpness(g, (0.5, 0.5, 0.5, 0.9)) == 0 and pixels_arrow.box_sharpness(g, (0.9, 0.9, 0.1, 0.1)) == 0
    assert pixels_arrow.box_sharpness(g, (0.2, 0.3, 0.31, 0.4)) >= 0  # one pixel
    face = "faces array<struct<face_no:int,min_x:double,min_y:double,max_x:double,max_y:double>>"
    rgb = bytes(rng.integers(0, 256, 10 * 7 * 3).astype(np.uint8))
    rows = [(1, 1, 10, 7, rgb, [(1, 0.0, 0.0, 1.0, 1.0), (2, None, 0.0, 1.0, 1.0)]), (1, 2, 10, 7, rgb[1:], [(1, 0.0, 0.0, 1.0, 1.0)]), (1, 3, 10, 7, rgb, None), (1, 4, 10, 7, rgb, [])]
    out = pixels_arrow.face_sharpness(spark.createDataFrame(rows, f"video_id int, frame_index long, width int, height int, rgb binary, {face}")).collect()
    assert [(r["frame_index"], r["face_no"], r["sharpness_variance"] is None) for r in out] == [(1, 1, False), (1, 2, True), (2, 1, True)]


def test_providers(spark):
    rgb = bytes(8 * 8 * 3)
    frames = spark.createDataFrame([(1, 1, 8, 8, rgb), (1, 2, 8, 8, rgb[1:]), (2, 1, 8, 8, rgb)], "video_id int, frame_index long, width int, height int, rgb binary")
    videos = spark.createDataFrame([(1,)], "video_id int")
    args = (TechnicalSettings(), FaceSettings(), CompositeSettings(), 8, 1)
    bare = {r["frame_index"]: r for r in score_videos(videos, Providers(lambda v: frames.join(v, "video_id", "left_semi")), *args).collect()}
    assert set(bare) == {1, 2} and bare[2]["error"] == "invalid_preview" and bare[1]["profile"] == "no_people" and bare[1]["n_faces"] == 0
    face = lambda f: f.select("video_id", "frame_index", *(F.lit(None).cast("double").alias(n) for n in ("detection_confidence", "yaw_degrees", "eyes_open", "positive_expression", "sharpness_variance")), F.lit(0.12).alias("relative_size"), F.lit(False).alias("is_cut_off"))
    half = lambda f: f.select("video_id", "frame_index", F.lit(0.9).alias("score"))
    full = score_videos(videos, Providers(lambda v: frames.join(v, "video_id", "left_semi"), face, half, half, {"mine": half}), *args).where("frame_index = 1").first()
    assert full["profile"] == "people" and full["n_faces"] == 1 and full["mine"] == 0.9 and full["aesthetic"] == 0.9 and full["face"] == 1.0


def test_hashes_of_flat_and_symmetric_pictures_are_those_of_the_sql(spark, tmp_path):
    """Frequencies that are equal but for rounding: all sums must run in one order."""
    rng = np.random.default_rng(1)
    half = [rng.integers(0, 128, (8, 8)) for _ in range(60)]
    pictures = [*(h + h.T for h in half), *(np.full((8, 8), v) for v in range(0, 256, 5)), *(np.repeat(h[:, :1], 8, 1) for h in half)]
    rows = [(k, [float(v + 0.5) / 510 - 0.25 for v in p.ravel()], k % 7) for k, p in enumerate(pictures)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("ph1_phash", "ph1_phash_arrow", "ph1_phash_reduced"):
        got = {r["frame_index"]: r["hash"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(db.execute(ORACLES[name]).fetchall()), name


def test_many_small_files_are_written_by_all_tasks(spark, tmp_path):
    """However few bytes they are; a video still has one file."""
    rows = spark.createDataFrame([(v, k, f"{k}") for v in range(40) for k in range(3)], "video_id long, position long, item string")
    sinks.write_manifests(rows, str(tmp_path / "m"), "images")
    sinks.store_previews(rows.withColumnRenamed("position", "frame_index"), str(tmp_path / "p"))
    for folder, end in (("m", "txt"), ("p", "parquet")):
        files = list((tmp_path / folder).glob(f"video_id=*/*.{end}"))
        assert len(files) == 40 and len({f.name[:10] for f in files}) == 2, folder
    assert {json.loads(r["value"])["source_video"] for r in sinks.read_manifests(spark, str(tmp_path / "m")).collect()} == set(range(40))


def test_scenes_of_a_video_share_one_state():
    """One read and one write of the state in a batch; a scene that the watermark has left by the wait goes, the others stay."""
    calls, kept, timers = [], [], []

    class Value:
        get = staticmethod(lambda: calls.append("get") or (kept[-1] if kept else None))
        update = staticmethod(lambda v: calls.append("update") or kept.append(v))

    class Handle:
        getValueState = staticmethod(lambda *_: Value())  # noqa: N815
        registerTimer, deleteTimer = staticmethod(timers.append), staticmethod(timers.remove)  # noqa: N815

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: mark)  # noqa: N815

    def batch(*rows):
        frames = pd.DataFrame(rows, columns=["scene_id", "start_time", "frame_index", "t"])
        frames["ts"] = pd.to_datetime(frames["t"], unit="s")
        return [(r.scene_id, r.frame_index) for out in sampler.handleInputRows((1, 0), iter([frames]), Times()) for r in out.itertuples()]

    sampler, mark = streams.GridSampler(1.0, 10_000), 0
    sampler.init(Handle())
    assert batch((2, 5.0, 8, 6.5), (1, 0.0, 1, 0.0), (1, 0.0, 2, 0.5), (2, 5.0, 7, 5.0)) == [(1, 1), (2, 7), (2, 8)]
    assert calls == ["get", "update"] and kept[-1][0] == ["1", "2"] and timers == [16_500]
    mark = 12_000
    assert batch((2, 5.0, 9, 6.9), (2, 5.0, 10, 7.0)) == [(2, 10)]
    assert kept[-1][0] == ["2"] and timers == [22_000]


def test_bundled_manifests_hold_the_same_texts_in_few_files(spark, tmp_path):
    """A file for each task instead of one for each video, whatever stands in a text; what is there is not overwritten."""
    rows = [(v, k, json.dumps({"k": k, "note": f'a\n]}}\n\x1e"{v}'}, indent=k)) for v in ("a", 'b "c"', "d=e\x1e", *map(str, range(40))) for k in range(3)]
    items = spark.createDataFrame(rows, "video_id string, position long, item string").repartition(5)
    videos = spark.createDataFrame([("a",), ("empty",), (None,)], "video_id string")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    sinks.write_manifests(items, many, "images", videos)
    sinks.write_manifests(items, one, "images", videos, bundled=True)
    texts = lambda df: sorted(r["value"].rstrip() for r in df.collect())
    assert texts(sinks.read_manifests(spark, one, bundled=True)) == texts(sinks.read_manifests(spark, many))
    made = {m["source_video"]: m["images"] for m in map(json.loads, texts(sinks.read_manifests(spark, one, bundled=True)))}
    assert len(made) == 44 and made["empty"] == [] and [x["k"] for x in made["d=e\x1e"]] == [0, 1, 2]
    assert len(list((tmp_path / "one").glob("*.txt"))) == 2 and len(list((tmp_path / "many").glob("*/*.txt"))) == 44
    with pytest.raises(AnalysisException):
        sinks.write_manifests(items, one, "images", bundled=True)
    sinks.write_manifests(items.where("false"), str(tmp_path / "none"), "images", bundled=True)
    assert sinks.read_manifests(spark, str(tmp_path / "none"), bundled=True).count() == 0


def test_queries_of_manifests_make_no_file_for_each_video(spark, tmp_path, monkeypatch):
    paths = []
    path = queries.shared_path
    monkeypatch.setattr(queries, "shared_path", lambda *a: paths.append(path(*a)) or paths[-1])
    d = "/root/testdata/sf0.001"
    for name in ("snk1_candidate_manifest", "snk2_selection_manifest", "snk2_scores_from_previews"):
        assert QUERIES[name](spark, d).count() > 0
        folder = Path(paths[-1].removeprefix("file:"))
        assert len(list(folder.rglob("*.txt"))) == 2, name  # as many as there are shuffle partitions


def test_grids_of_short_scenes_leave_together():
    scenes = [(v, s, float(s), s + 2.5) for v in range(100) for s in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*scenes, strict=True)], ["video_id", "scene_id", "start_time", "end_time"])
    out = list(sampling._grid_points(1.0, 5.0)(iter([batch])))
    assert len(out) == 1
    small = list(sampling._grid_points(1.0, 5.0, block=4)(iter([batch])))
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [tuple(r.values()) for b in small for r in b.to_pylist()]
    want = [(v, s, c, s + float(c), p) for v, s, a, b in scenes for c in range(3) for p in range(int((a + c) // 5), int(min(a + c + 1, b) // 5) + 1)]
    assert rows == want


def test_previews_are_measured_together_as_each_alone(spark, monkeypatch):
    """Stacks of one size give what each picture gives, bit for bit; one that is not whole costs the others nothing."""
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        w, h = ((8, 8), (11, 5), (1, 4), (20, 16))[k % 4]
        rgb = bytearray(rng.integers(0, int(rng.integers(2, 257)), (h, w, 3), dtype=np.uint8).tobytes())
        rows.append((1, k, w, h, None if k == 9 else rgb[:-1] if k == 13 else rgb))
    s, calls = TechnicalSettings(), []
    whole = pixels_arrow.technicals
    monkeypatch.setattr(pixels_arrow, "technicals", lambda g, s: calls.append(len(g)) or whole(g, s))
    schema = "video_id int, frame_index long, width int, height int, rgb binary"
    batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("video_id", "frame_index", "width", "height", "rgb"))})]
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema: list(f(iter(batches))))
    out = [r for b in pixels_arrow.scored_frames(spark.createDataFrame([], schema), s) for r in b.to_pylist()]
    assert sorted(calls) == [13, 15, 15, 15]
    for (_, k, w, h, rgb), r in zip(rows, out, strict=True):
        if k in (9, 13):
            assert r["error"] == "invalid_preview" and r["hash"] is None and r["global_score"] is None
            continue
        g = pixels_arrow.grey(bytes(rgb), w, h)
        assert {m: r[m] for m in pixels_arrow.MEASURES} == whole(g[None], s)[0] and r["error"] is None
        bits = np.packbits(pixels_arrow.phash(g, 8, 4), bitorder="little")
        assert r["hash"] == bits.view("<i8").tolist()
