"""Settings, checked on the driver before a plan is built. The defaults are fixed values of the product."""

from __future__ import annotations

from dataclasses import dataclass, field


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SceneSettings:
    adaptive_threshold: float = 3.0
    min_scene_len_frames: int = 15
    window_width: int = 2
    min_content_val: float = 15.0

    def __post_init__(self) -> None:
        _require(self.adaptive_threshold > 0, "adaptive_threshold must be positive")
        _require(self.min_scene_len_frames > 0, "min_scene_len_frames must be positive")
        _require(self.window_width > 0, "window_width must be positive")
        _require(self.min_content_val >= 0, "min_content_val must not be negative")


@dataclass(frozen=True)
class SamplingSettings:
    fps: float = 3.0
    analysis_max_width: int = 960

    def __post_init__(self) -> None:
        _require(self.fps > 0, "fps must be positive")
        _require(self.analysis_max_width > 0, "analysis_max_width must be positive")


def _weights(**values: float) -> dict[str, float]:
    return values


@dataclass(frozen=True)
class TechnicalSettings:
    sharpness_min_variance: float = 15.0
    sharpness_good_variance: float = 200.0
    exposure_target: float = 0.5
    exposure_max_deviation: float = 0.35
    burned_pixel_threshold: float = 0.98
    burned_pixels_max_fraction: float = 0.02
    underexposed_pixel_threshold: float = 0.05
    underexposed_pixels_max_fraction: float = 0.10
    contrast_min_stddev: float = 0.04
    contrast_good_stddev: float = 0.20
    motion_blur_min_gradient: float = 0.01
    motion_blur_max_anisotropy: float = 0.60
    #: Grey is scaled to [0, luma_scale] for sharpness; 255 gives thresholds in 8-bit units a meaning.
    luma_scale: float = 1.0
    weights: dict[str, float] = field(
        default_factory=lambda: _weights(
            sharpness=1.0, exposure=1.0, burned_pixels=1.0, underexposed_pixels=1.0, contrast=1.0, motion_blur=1.0
        )
    )

    def __post_init__(self) -> None:
        _require(self.sharpness_good_variance > self.sharpness_min_variance, "sharpness bounds must ascend")
        _require(self.contrast_good_stddev > self.contrast_min_stddev, "contrast bounds must ascend")
        _require(sum(self.weights.values()) > 0, "the sum of technical weights must be positive")


@dataclass(frozen=True)
class FaceSettings:
    max_faces: int = 10
    yaw_scale_degrees: float = 45.0
    cut_off_margin: float = 0.02
    size_min_relative_area: float = 0.02
    size_good_relative_area: float = 0.12
    max_yaw_degrees: float = 35.0
    sharpness_min_variance: float = 15.0
    sharpness_good_variance: float = 200.0
    weights: dict[str, float] = field(
        default_factory=lambda: _weights(
            detection_confidence=1.0, size=1.0, orientation=1.0, eyes_open=1.5, positive_expression=0.5, sharpness=1.5, crop=1.5
        )
    )

    def __post_init__(self) -> None:
        _require(self.max_faces > 0, "max_faces must be positive")
        _require(self.size_good_relative_area > self.size_min_relative_area, "size bounds must ascend")
        _require(self.sharpness_good_variance > self.sharpness_min_variance, "sharpness bounds must ascend")
        _require(self.max_yaw_degrees > 0, "max_yaw_degrees must be positive")


@dataclass(frozen=True)
class CompositeSettings:
    neutral_score: float = 0.5
    people: dict[str, float] = field(default_factory=lambda: _weights(technical=0.30, face=0.40, aesthetic=0.20, composition=0.10))
    no_people: dict[str, float] = field(default_factory=lambda: _weights(technical=0.40, aesthetic=0.35, composition=0.25))

    def __post_init__(self) -> None:
        _require(0 <= self.neutral_score <= 1, "neutral_score must lie between 0 and 1")
        _require(sum(self.people.values()) > 0 and sum(self.no_people.values()) > 0, "composite weights must be positive")


@dataclass(frozen=True)
class RefinementSettings:
    window_seconds: float = 0.5
    candidates_per_scene: int = 3

    def __post_init__(self) -> None:
        _require(self.window_seconds > 0 and self.candidates_per_scene > 0, "refinement parameters must be positive")


@dataclass(frozen=True)
class DedupSettings:
    similarity_threshold: float = 0.90
    window_seconds: float = 1.0
    hash_size: int = 8

    def __post_init__(self) -> None:
        _require(0 <= self.similarity_threshold <= 1, "similarity_threshold must lie between 0 and 1")
        _require(self.window_seconds > 0 and self.hash_size > 0, "window and hash size must be positive")


@dataclass(frozen=True)
class SelectionSettings:
    max_per_scene: int = 3
    minimum_score: float = 0.55
    count: int | None = None

    def __post_init__(self) -> None:
        _require(self.max_per_scene > 0, "max_per_scene must be positive")
        _require(0 <= self.minimum_score <= 1, "minimum_score must lie between 0 and 1")
        _require(self.count is None or self.count > 0, "count must be positive if given")


@dataclass(frozen=True)
class ExportSettings:
    image_format: str = "jpeg"
    jpeg_quality: int = 2

    def __post_init__(self) -> None:
        _require(self.image_format.lower() in ("jpeg", "jpg", "png"), "image_format must be jpeg or png")
        _require(1 <= self.jpeg_quality <= 31, "jpeg_quality must lie between 1 and 31")

    @property
    def extension(self) -> str:
        return "png" if self.image_format.lower() == "png" else "jpg"
