"""The composed plans: from frames to the best frames, for all videos at once; and resumable batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillkeep.operators.dedup import Similarity, deduplicate, hamming
from stillkeep.operators.sampling import assign_scene, sample_exact
from stillkeep.operators.scenes import detect_scenes
from stillkeep.operators.selection import decide
from stillkeep.plans.scoring import Providers, score_videos
from stillkeep.settings import CompositeSettings, DedupSettings, FaceSettings, SamplingSettings, SceneSettings, SelectionSettings, TechnicalSettings
from stillkeep.sources.sinks import store_previews
from stillkeep.storage import shuffled, stored


def with_known(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    """Adds is_known: whether the candidate's scene is in the scene table."""
    own = scenes.select("video_id", "scene_id").distinct().withColumn("_k", F.lit(True))
    return candidates.join(own, ["video_id", "scene_id"], "left").withColumn("is_known", F.coalesce("_k", F.lit(False))).drop("_k")


def select_candidates(
    candidates: DataFrame, scenes: DataFrame, similarity: Similarity, dedup: DedupSettings, selection: SelectionSettings
) -> DataFrame:
    """Dedup across scenes first, then known scenes, minimum score, cap and quota; every candidate with its reason."""
    state = deduplicate(candidates, similarity, dedup.window_seconds, dedup.similarity_threshold)
    marked = with_known(state.withColumn("is_duplicate", F.col("state") == "duplicate"), scenes)
    return decide(marked, selection)


def select_best(
    frames: DataFrame,
    content: str,
    similarity: Similarity,
    scene: SceneSettings,
    sampling: SamplingSettings,
    dedup: DedupSettings,
    selection: SelectionSettings,
) -> DataFrame:
    """Scenes, sampling on the exact grid, dedup and selection of scored frames (video_id, frame_index, t, final_score, ...)."""
    found = detect_scenes(frames, content, scene.adaptive_threshold, scene.window_width, scene.min_content_val, scene.min_scene_len_frames)
    scenes = stored(found, "scenes")
    slim = frames.select("video_id", "frame_index", "t", "final_score", similarity.column)
    candidates = sample_exact(assign_scene(slim, scenes), scenes, sampling.fps)
    return select_candidates(candidates, scenes, similarity, dedup, selection)


def select_from_previews(
    frames: DataFrame,
    content: str,
    providers: Providers,
    scene: SceneSettings,
    sampling: SamplingSettings,
    technical: TechnicalSettings,
    face: FaceSettings,
    composite: CompositeSettings,
    dedup: DedupSettings,
    selection: SelectionSettings,
    reduce_factor: int = 4,
) -> DataFrame:
    """The whole way from frames to selection: scenes and sampling on slim rows, then pixels of the sampled frames alone.

    frames: video_id, frame_index, t, the content value and what the providers need to find a frame, but no pixels.
    ``providers.frames`` gets the sampled rows and returns their previews, so what was not sampled is neither read, decoded nor scored. Hashes of
    ``dedup.hash_size`` squared bits go from scoring to dedup as they are. A frame whose preview is not whole is no candidate.
    Columns: those of the candidates, technical, face, aesthetic, composition, profile, reasons, final_score, state, reason, selection_rank and the rest of ``decide``.
    """
    found = detect_scenes(frames, content, scene.adaptive_threshold, scene.window_width, scene.min_content_val, scene.min_scene_len_frames)
    scenes = stored(found, "scenes")
    sampled = sample_exact(assign_scene(frames.drop(content), scenes), scenes, sampling.fps)
    wanted = stored(sampled.drop("scene_start", "scene_end", "cell"), "sampled")
    scored = score_videos(wanted, providers, technical, face, composite, dedup.hash_size, reduce_factor).where("error IS NULL").drop("error", "n_faces")
    candidates = wanted.join(shuffled(stored(scored, "scored")), ["video_id", "frame_index"])
    return select_candidates(candidates, scenes, hamming(dedup.hash_size**2, words=True), dedup, selection)


def resume(rows: DataFrame, path: str) -> None:
    """Write the videos that ``path`` does not hold yet, a partition for each; what an interrupted run finished stays."""
    try:
        done = rows.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing is there yet
        done = None
    if done is not None:
        ids = done.select(F.col("video_id").cast(rows.schema["video_id"].dataType).alias("video_id")).distinct()
        rows = rows.join(stored(ids, "done"), "video_id", "left_anti")
    store_previews(rows, path)
