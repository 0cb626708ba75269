"""Options of a curation run, their defaults and their checks (made before any work starts)."""

from __future__ import annotations

from dataclasses import dataclass, fields

POLICIES = ("sharpest", "largest", "newest", "oldest", "first")
#: Image suffixes, compared in lower case.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff", ".gif", ".heic", ".heif")
#: Reasons for a rejection, in order of precedence.
REASONS = ("blurry", "grayscale", "bordered", "person", "face", "duplicate_exact", "duplicate_near")


@dataclass(frozen=True)
class Config:
    copy_instead: bool = True
    overwrite_unkept: bool = False
    person_conf: float = 0.25
    person_batch: int = 32
    face_backend: str = "auto"
    similarity: float = 0.90
    phash_hamming: int = 30
    embed_batch: int = 256
    embed_max_size: int = 512
    use_vectors: bool = False
    #: Links are taken from each vector's nearest so many; None: from all pairs that are similar enough.
    neighbours: int | None = 50
    neighbour_method: str = "auto"
    rep_policy: str = "sharpest"
    kept_side: int = 300
    jpeg_quality: int = 92
    clean_kept: bool = True
    skip_detect: bool = False
    min_sharpness: float = 0.0
    drop_grayscale: bool = False
    drop_bordered: bool = False
    grayscale_max_saturation: float = 10.0
    border_min_frac: float = 0.03
    no_cache: bool = False
    unsafe_threshold: float = 0.5
    fail_open: bool = False
    strict_edges: bool = False

    def __post_init__(self) -> None:
        if self.rep_policy not in POLICIES:
            raise ValueError(f"unknown representative policy {self.rep_policy!r}; one of {', '.join(POLICIES)}")
        if not 0 <= self.phash_hamming <= 256:
            raise ValueError("phash_hamming must lie between 0 and 256")
        if self.neighbour_method not in ("auto", "exact", "lsh"):
            raise ValueError("neighbour_method must be auto, exact or lsh")
        for name in ("similarity", "unsafe_threshold", "person_conf"):
            if not -1 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between -1 and 1")
        for name in ("neighbours", "kept_side", "jpeg_quality", "person_batch", "embed_batch", "embed_max_size"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def quality_on(self) -> bool:
        """The quality stage runs only when one of its checks is on."""
        return self.min_sharpness > 0 or self.drop_grayscale or self.drop_bordered

    def fingerprint(self) -> str:
        """The options that change computed features; stored beside them, so other options don't reuse them."""
        return f"person={self.person_conf};face={self.face_backend};embed={self.embed_max_size}"

    @classmethod
    def of(cls, **options) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in options.items() if k in known and v is not None})
