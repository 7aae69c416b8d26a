"""Engine configuration: what the reference data model fixes at build time is a parameter here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Bands of a frame, bins and range of a histogram, and hop framing of a sample stream. bands=0 is a band for each bin of a window's spectrum."""

    bands: int = 24
    bins: int = 128
    low: float = 0.0
    high: float = 1.0
    window: int = 2048
    step: int = 1024
    #: Non-silent frames that a stream needs, eight seconds at 44.1 kHz.
    min_frames: int = 44100 * 8 // 1024
    scale: str = "mel"

    def __post_init__(self) -> None:
        if self.bands == 0:
            object.__setattr__(self, "bands", self.window // 2 + 1)
        if not 0 < self.step <= self.window:
            raise ValueError("step must be positive and no larger than window")
        if not 1 <= self.bands <= 20000 or self.bins < 1 or not self.low < self.high:
            raise ValueError("bands must be 1 to 20000, bins positive, low below high")


DEFAULT = EngineConfig()
#: The stand-ins of the driver's tables: 4 bands of 16 bins, windows of 16 samples every 8.
SMALL = EngineConfig(bands=4, bins=16, window=16, step=8, min_frames=5)
