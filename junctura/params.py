"""Options of the engine and their defaults."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field


@dataclass(frozen=True)
class Scoring:
    """Alignment scores; penalties are positive."""

    match: int = 3
    mismatch: int = 4
    gap_open: int = 12
    gap_extend: int = 2
    gap_open_long: int = 32
    gap_extend_long: int = 1
    ambiguous: int = 1

    def to_tuple(self) -> tuple[int, ...]:
        return astuple(self)


@dataclass(frozen=True)
class Params:
    overhang: int = 50
    anchor: int = 7
    min_duplicate_exon_length: int = 27
    min_junc_score: int = 1
    k_hits: int = 10
    min_score: int = 25
    min_span: int = 15
    probe_half: int = 15
    anchor_mismatches: int = 2
    mismatches: int = 3
    seed_salts: int = 8
    tile: int = 1000
    tile_overlap: int = 200
    scan_tile: int = 10_000_000
    scoring: Scoring = field(default_factory=Scoring)


DEFAULT = Params()
KEYS = ["chrom", "start", "end", "strand"]
VERSION = "0.1.0"
