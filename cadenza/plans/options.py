"""The analysis' parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """What can be set about an analysis. centre_bpm and width_octaves weight the tempo ranking; an analysis sets them
    from each track's energy. A floor or snap of 0 turns it off; tuning_cents None means measured."""

    window: int = 2048
    hop: int = 512
    bands: int = 8
    low_hz: float = 30.0
    high_hz: float = 16000.0
    gamma: float = 1000.0
    local_mean_seconds: float = 0.5
    min_bpm: float = 60.0
    max_bpm: float = 220.0
    resolution: float = 0.1
    pulses: int = 4
    penalty: float = 0.0
    floor_bpm: float = 80.0
    floor_ratio: float = 0.5
    snap_bpm: float = 0.25
    profile: str = "temperley"
    tuning_cents: float | None = None
    trim_lead_in: bool = True
    memory_offset_bars: int = 16
    loop_bars: int = 4
    drop_after_fraction: float = 0.2
    start_seconds: float = 0.0
    duration_seconds: float | None = None
    centre_bpm: float | None = None
    width_octaves: float = 0.7

    def weighted(self, centre_bpm: float | None) -> Options:
        return replace(self, centre_bpm=centre_bpm)

    def unweighted(self) -> Options:
        return replace(self, centre_bpm=None)
