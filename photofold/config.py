"""Settings objects and the fixed values every operator agrees on."""

from __future__ import annotations

from dataclasses import dataclass

# Status codes of an asset.
PENDING, DONE, ERROR = 0, 1, 2

# Report and detector limits.
BLUR_REPORT_ROWS = 50
SCAN_BATCH_ROWS = 20
PHOTO_SOURCE_CAP = 500
VIDEO_SOURCE_CAP = 200
MAX_LABELS = 5
LABEL_CONFIDENCE = 0.4
RERANK_BELOW = 0.8
FACE_CONFIDENCE = 0.85
MIN_FACE_RATIO = 0.1
DEFAULT_IMAGE_WIDTH = 1000
FAILURES_TO_TRIP = 4


@dataclass(frozen=True)
class BlurConfig:
    """Sharpness threshold, lowered for very dark and very bright images."""

    base_threshold: float = 100.0
    dark_multiplier: float = 0.7
    dark_threshold: float = 40.0
    bright_multiplier: float = 0.7
    bright_threshold: float = 220.0


@dataclass(frozen=True)
class SimilarityConfig:
    """Time window, candidate count and hash distance for near-duplicates."""

    time_window_seconds: float = 120
    max_compare_count: int = 10
    similar_threshold: int = 15

    @property
    def window_ms(self) -> int:
        return int(self.time_window_seconds * 1000)
