"""Settings of an extraction as one frozen object, with its profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Switches and thresholds that plans read when they are built; a changed copy makes another plan."""

    fix_spacing: bool = True
    remove_headers: bool = True
    remove_page_numbers: bool = True
    join_lines: bool = True
    fix_punctuation: bool = True
    column_gap: float = 50.0
    line_gap: float = 15.0
    top_margin: float = 0.05
    bottom_margin: float = 0.10
    chunk_size: int = 5000
    chunk_least: int = 1000
    overlap: int = 500
    quality_least: float = 70.0
    legacy_margins: bool = False

    def __post_init__(self) -> None:
        if self.column_gap <= 0 or self.line_gap <= 0:
            raise ValueError("gaps must be positive")
        if not 0 <= self.top_margin < 0.5 or not 0 <= self.bottom_margin < 0.5:
            raise ValueError("margins are shares of the page below a half")
        if not 0 < self.chunk_least <= self.chunk_size or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("a chunk's least size and overlap must fit its size")
        if not 0 <= self.quality_least <= 100:
            raise ValueError("quality is within 0 and 100")


DEFAULT = Settings()
PROFILES = {
    "default": DEFAULT,
    "optimized": replace(DEFAULT, column_gap=40.0, quality_least=80.0),
    "legacy": replace(DEFAULT, top_margin=0.05, bottom_margin=0.05, join_lines=False, legacy_margins=True),
    "bare": replace(DEFAULT, remove_headers=False, fix_spacing=False, fix_punctuation=False),
}
