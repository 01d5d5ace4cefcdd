"""Settings with their published defaults, checked on construction."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Ranking:
    """BM25, feedback and passage settings."""

    k1: float = 0.7
    b: float = 0.3
    feedback_docs: int = 5
    expansion_terms: int = 6
    expansion_weight: float = 0.45
    max_query_terms: int = 6
    expansion_only: bool = False
    rerank_docs: int = 25
    rerank_window: int = 16
    rerank_weight: float = 0.20
    results: int = 1000

    def __post_init__(self) -> None:
        for f in fields(self):
            _require(getattr(self, f.name) >= 0, f"{f.name} must not be negative")


@dataclass(frozen=True)
class Source:
    """One ranking of a fusion: its weight and how many entries count (0: all)."""

    label: str
    weight: float
    depth: int

    def __post_init__(self) -> None:
        _require(self.weight >= 0 and self.depth >= 0, f"{self.label}: weight and depth must not be negative")


# Default fusion weights and depths.
SOURCES = (
    Source("bm25", 0.05, 250), Source("rm3", 0.55, 250), Source("rm3exp", 0.10, 250),
    Source("rewrite", 0.08, 150), Source("rwexp", 0.05, 150), Source("dense", 0.40, 250),
)
RRF_K = 60


@dataclass(frozen=True)
class Models:
    """Limits of the model-backed stages."""

    mono_docs: int = 85
    duo_docs: int = 10
    doc_words: int = 220
    rewrite_query_terms: int = 3
    rewrite_output_terms: int = 8
    dimensions: int = 512
    batch: int = 64
    mode: str = "mono"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            _require(isinstance(value, str) or value > 0, f"{f.name} must be positive")
        _require(self.mode in ("off", "mono", "mono_duo"), f"unknown mode {self.mode}")
        _require(self.duo_docs <= self.mono_docs, "duo_docs must not exceed mono_docs")


def settings(*files: str, names: tuple[str, ...] = ()) -> dict[str, str]:
    """``KEY=value`` lines of the files; the process environment, then the first file wins.

    Settings in ``names`` are also taken from the environment alone.
    """
    found: dict[str, str] = {}
    for name in files:
        for line in Path(name).read_text().splitlines() if Path(name).exists() else []:
            key, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not key.startswith("#"):
                found.setdefault(key.strip(), value.strip().strip("\"'"))
    return found | {k: v for k, v in os.environ.items() if k in found or k in names}
