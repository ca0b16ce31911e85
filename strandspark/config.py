"""Checked settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Ranges are checked once, before any plan is built."""

    scope: tuple[str, ...] = ()
    top_k: int = 5
    candidates: int = 30
    cutoff: float = 0.5370554072220923
    context: str = "threads"
    mode: str = "vector"
    depth: int = 100
    chunk_tokens: int = 700
    chunk_overlap: int = 100

    def __post_init__(self):
        for name, low, high in (("top_k", 1, 100), ("candidates", 1, 1000), ("depth", 1, 1000), ("chunk_tokens", 1, 100_000), ("chunk_overlap", 0, self.chunk_tokens - 1)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")
        if not 0 <= self.cutoff <= 1:
            raise ValueError("cutoff must be from 0 to 1")
        if self.context not in ("chunks", "threads"):
            raise ValueError("context must be chunks or threads")
        if self.mode not in ("vector", "hybrid"):
            raise ValueError("mode must be vector or hybrid")
        if any(not isinstance(x, str) or not x.strip() for x in self.scope):
            raise ValueError("scope must be names that aren't blank")
        if len(set(self.scope)) != len(self.scope):
            raise ValueError("scope has a repeated name")
