"""The same pixel measures on full previews: NumPy in Arrow batches, one pass, no pixel ever shuffled.

A frame whose bytes do not fit its size gives an error instead of scores; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillkeep.functions.pixels import cosine_matrix
from stillkeep.settings import TechnicalSettings

MEASURES = ("sharpness", "exposure", "burned_pixels", "underexposed_pixels", "contrast", "motion_blur", "global_score")


PIXELS_AT_ONCE = 1 << 18  # pictures of one size are measured together up to so many pixels


def grey(rgb: bytes, width: int, height: int) -> np.ndarray:
    """The grey picture of one preview, or those of several of this size whose bytes follow each other as a stack."""
    p = np.frombuffer(rgb, np.uint8).reshape(-1, height, width, 3).astype(np.float64)
    g = np.floor(p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114 + 0.5)
    return g if len(g) > 1 else g[0]


def _score(x: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


def _bordered(g: np.ndarray) -> np.ndarray:
    return np.pad(g, [(0, 0)] * (g.ndim - 2) + [(1, 1)] * 2, mode="reflect")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _bordered(g)
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * g


def technical(g: np.ndarray, s: TechnicalSettings) -> dict[str, float]:
    return technicals(g[None], s)[0]


def technicals(g: np.ndarray, s: TechnicalSettings) -> list[dict[str, float]]:
    """The measures of each picture of a stack; each picture's sums run as they would for it alone."""
    flat = lambda x: x.reshape(len(x), -1)
    unit = g / 255
    p = _bordered(unit)
    across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    down = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    sums = (
        flat(laplacian(g)).var(1) * (s.luma_scale / 255) ** 2,
        flat(unit).mean(1),
        flat(unit >= s.burned_pixel_threshold).mean(1),
        flat(unit <= s.underexposed_pixel_threshold).mean(1),
        flat(unit).std(1),
        flat(np.abs(across[:, :, 2:] - across[:, :, :-2])).mean(1),
        flat(np.abs(down[:, 2:] - down[:, :-2])).mean(1),
    )
    made = []
    for sharpness, mean, burned, under, contrast, mx, my in zip(*(x.tolist() for x in sums), strict=True):
        out = {
            "sharpness": _score(sharpness, s.sharpness_min_variance, s.sharpness_good_variance),
            "exposure": min(1.0, max(0.0, 1 - abs(mean - s.exposure_target) / s.exposure_max_deviation)),
            "burned_pixels": 1 - _score(burned, 0, s.burned_pixels_max_fraction),
            "underexposed_pixels": 1 - _score(under, 0, s.underexposed_pixels_max_fraction),
            "contrast": _score(contrast, s.contrast_min_stddev, s.contrast_good_stddev),
            "motion_blur": 0.0 if mx + my <= s.motion_blur_min_gradient else 1 - _score(abs(mx - my) / (mx + my), 0, s.motion_blur_max_anisotropy),
        }
        weighted = 0.0
        for k, v in out.items():  # one after the other, as in SQL; sum() would carry what rounding loses
            weighted += v * s.weights[k]
        made.append(out | {"global_score": weighted / sum(s.weights[k] for k in out)})
    return made


def box_sharpness(g: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Variance of the Laplacian inside a box (min_x, min_y, max_x, max_y in shares of the picture); 0 where it holds no pixel.

    The box's edges are rounded half to even; the picture is cut before it is filtered.
    """
    height, width = g.shape
    left, top, right, bottom = (round(v * n) for v, n in zip(box, (width, height, width, height), strict=True))
    cut = g[max(0, top) : max(0, bottom), max(0, left) : max(0, right)]
    return float(laplacian(cut).var()) if cut.size else 0.0


def face_sharpness(frames: DataFrame) -> DataFrame:
    """video_id, frame_index, width, height, rgb, faces (an array of face_no and the box) -> a row per face with sharpness_variance.

    The faces come with the preview, so pixels are read once and never shuffled. Null where the preview or the box is not whole.
    """
    kinds = dict(frames.dtypes)
    box = ("min_x", "min_y", "max_x", "max_y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, values = [], [], []
            for k, (w, h, rgb, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgb", "faces")), strict=True)):
                whole = bool(w and h and w > 0 and h > 0 and rgb is not None and len(rgb) == w * h * 3)
                g = grey(rgb, w, h) if whole and found else None
                for face in found or ():
                    edges = tuple(face[c] for c in box)
                    at.append(k)
                    numbers.append(face["face_no"])
                    values.append(box_sharpness(g, edges) if whole and None not in edges else None)
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("video_id", "frame_index")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), pa.array(values, pa.float64())], ["video_id", "frame_index", "face_no", "sharpness_variance"])

    schema = f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, face_no int, sharpness_variance double"
    return frames.select("video_id", "frame_index", "width", "height", "rgb", "faces").mapInArrow(measure, schema)


def area_matrix(source: int, target: int) -> np.ndarray:
    """target x source weights of an area average."""
    edges = np.arange(target + 1) * source / target
    cells = np.arange(source)
    return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * target / source


def resized(g: np.ndarray, width: int, height: int) -> np.ndarray:
    return area_matrix(g.shape[0], height) @ g @ area_matrix(g.shape[1], width).T


def phash(g: np.ndarray, size: int, factor: int) -> np.ndarray:
    return phashes(g[None], size, factor)[0]


def phashes(g: np.ndarray, size: int, factor: int) -> np.ndarray:
    """size x size bits of each picture of a stack, row-major: reduce to factor * size, DCT, low frequencies against their median without the first.

    The sums run in order, along the rows and then down the columns, as in ``pixels.dct`` and in SQL: of frequencies that are equal but for
    rounding, a matrix product would put others above the median, and others again on another machine.
    """
    n = size * factor
    m = np.array(cosine_matrix(n))[:size]
    small = np.stack([np.rint(resized(x, n, n)) for x in g]) if g.shape[1:] != (n, n) else g
    rows, low = np.zeros((len(g), n, size)), np.zeros((len(g), size, size))
    for x in range(n):
        rows += small[:, :, x, None] * m[:, x]
    for y in range(n):
        low += m[:, y, None] * rows[:, y, None]
    low = low.reshape(len(g), -1)
    return low > (np.median(low[:, 1:], axis=1, keepdims=True) if low.shape[1] > 1 else 0.0)


def scored_frames(frames: DataFrame, settings: TechnicalSettings, hash_size: int = 8, reduce_factor: int = 4) -> DataFrame:
    """video_id, frame_index, width, height, rgb -> the measures, the hash as words of 64 bits, error.

    Only scores and hashes leave; pixels are dropped at once. error is null or invalid_preview, with null scores. Previews of one
    size in a batch are measured together, in stacks of about ``PIXELS_AT_ONCE`` pixels.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out: dict[str, list] = {k: [None] * n for k in (*MEASURES, "hash")} | {"error": ["invalid_preview"] * n}
            pictures = batch.column("rgb").to_pylist()
            sizes: dict[tuple[int, int], list[int]] = {}
            for k, (w, h, rgb) in enumerate(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), pictures, strict=True)):
                if w and h and w > 0 and h > 0 and rgb is not None and len(rgb) == w * h * 3:
                    sizes.setdefault((w, h), []).append(k)
            for (w, h), rows in sizes.items():
                step = max(1, PIXELS_AT_ONCE // (w * h))
                for own in (rows[a : a + step] for a in range(0, len(rows), step)):
                    g = grey(b"".join(pictures[k] for k in own), w, h).reshape(-1, h, w)
                    bits = np.packbits(phashes(g, hash_size, reduce_factor), axis=1, bitorder="little")
                    words = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<i8").tolist()
                    for k, measures, word in zip(own, technicals(g, settings), words, strict=True):
                        for name, v in measures.items():
                            out[name][k] = v
                        out["hash"][k], out["error"][k] = word, None
            arrays = [pa.array(out[k], pa.float64()) for k in MEASURES]
            arrays += [pa.array(out["hash"], pa.list_(pa.int64())), pa.array(out["error"], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["video_id", "frame_index", *MEASURES, "hash", "error"])

    kinds = dict(frames.dtypes)
    schema = f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, " + ", ".join(f"{m} double" for m in MEASURES) + ", hash array<bigint>, error string"
    return frames.select("video_id", "frame_index", "width", "height", "rgb").mapInArrow(score, schema)


def reduced_frames(frames: DataFrame, most: int) -> DataFrame:
    """Previews at most ``most`` wide by area average; the height rounded half to even. Invalid ones become null."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for w, h, rgb in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgb")), strict=True):
                if not w or not h or rgb is None or len(rgb) != w * h * 3:
                    out.append((None, None, None))
                elif w <= most:
                    out.append((w, h, rgb))
                else:
                    height = round(h * most / w)
                    p = np.frombuffer(rgb, np.uint8).reshape(h, w, 3).astype(np.float64)
                    small = np.stack([resized(p[:, :, k], most, height) for k in range(3)], axis=2)
                    out.append((most, height, np.floor(small + 0.5).astype(np.uint8).tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["video_id", "frame_index", "width", "height", "rgb"])

    kinds = dict(frames.dtypes)
    schema = f"video_id {kinds['video_id']}, frame_index {kinds['frame_index']}, width int, height int, rgb binary"
    return frames.select("video_id", "frame_index", "width", "height", "rgb").mapInArrow(reduce, schema)


def failed_videos(scored: DataFrame) -> DataFrame:
    """Videos with a frame in error: (video_id)."""
    return scored.groupBy("video_id").agg(F.bool_or(F.col("error").isNotNull()).alias("_e")).where("_e").select("video_id")


Scorer = Callable[[DataFrame], DataFrame]


def apply_scorers(frames: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """The extension point: each scorer maps frames to (video_id, frame_index, score); its column takes its name."""
    out = frames
    for name, scorer in scorers.items():
        own = scorer(frames).select("video_id", "frame_index", F.col("score").alias(name))
        out = out.join(own, ["video_id", "frame_index"], "left")
    return out
