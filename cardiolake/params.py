"""Operator parameters. They are plan-time arguments, never data."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLING_RATE = 4.0

# Samples per processing chunk: two hours at 4 Hz. A chunk is the unit of distribution, so a
# series of any length is spread over many tasks. It is a multiple of every default step
# (40, 120, 240) and window (480, 240, 2400).
CHUNK = 28_800


@dataclass(frozen=True)
class CleanParams:
    sampling_rate: float = SAMPLING_RATE
    low: float = 50.0
    high: float = 240.0
    max_gap_seconds: float = 10.0
    smoothing_window: int = 5
    spike_threshold: float = 30.0

    def __post_init__(self) -> None:
        problems = {
            "sampling rate is not above zero": self.sampling_rate <= 0,
            "low bound is not below the high bound": self.low >= self.high,
            "gap limit is below zero": self.max_gap_seconds < 0,
        }
        found = [text for text, holds in problems.items() if holds]
        if found:
            raise ValueError(f"{'; '.join(found)}: {self}")

    @property
    def max_gap_samples(self) -> int:
        return int(self.max_gap_seconds * self.sampling_rate)

    @property
    def smoothing_reach(self) -> int:
        """Samples on each side of the centred median frame (even windows grow by one)."""
        return self.smoothing_window // 2 if self.smoothing_window >= 2 else 0


@dataclass(frozen=True)
class BaselineParams:
    sampling_rate: float = SAMPLING_RATE
    window_minutes: float = 2.0
    max_range: float = 25.0
    step_seconds: float = 10.0
    min_valid_ratio: float = 0.8

    @property
    def window(self) -> int:
        return int(self.window_minutes * 60 * self.sampling_rate)

    @property
    def step(self) -> int:
        return int(self.step_seconds * self.sampling_rate)


@dataclass(frozen=True)
class VariabilityParams:
    sampling_rate: float = SAMPLING_RATE
    window_seconds: float = 60.0
    overlap_ratio: float = 0.5
    min_valid_ratio: float = 0.5

    @property
    def window(self) -> int:
        return int(self.window_seconds * self.sampling_rate)

    @property
    def step(self) -> int:
        return int(self.window * (1 - self.overlap_ratio))


@dataclass(frozen=True)
class DecelParams:
    sampling_rate: float = SAMPLING_RATE
    min_depth: float = 15.0
    min_duration_seconds: float = 15.0
    prolonged_seconds: float = 120.0
    contraction_before_seconds: float = 120.0
    contraction_after_seconds: float = 60.0
    recovery_seconds: float = 60.0

    def samples(self, seconds: float) -> int:
        return int(seconds * self.sampling_rate)


@dataclass(frozen=True)
class TachysystoleParams:
    sampling_rate: float = SAMPLING_RATE
    window_minutes: float = 30.0
    threshold_per_10min: float = 5.0
    min_distance_seconds: float = 60.0

    @property
    def window(self) -> int:
        return int(self.window_minutes * 60 * self.sampling_rate)

    @property
    def distance(self) -> int:
        return int(self.min_distance_seconds * self.sampling_rate)


@dataclass(frozen=True)
class SinusoidalParams:
    sampling_rate: float = SAMPLING_RATE
    min_duration_minutes: float = 20.0
    min_cycles_per_minute: float = 3.0
    max_cycles_per_minute: float = 5.0
    min_amplitude: float = 5.0
    max_amplitude: float = 15.0
    dominance_threshold: float = 0.3

    @property
    def window(self) -> int:
        return int(self.min_duration_minutes * 60 * self.sampling_rate)


@dataclass(frozen=True)
class WindowParams:
    sampling_rate: float = SAMPLING_RATE
    window_minutes: float = 10.0
    step_minutes: float = 1.0

    @property
    def window(self) -> int:
        return int(self.window_minutes * 60 * self.sampling_rate)

    @property
    def step(self) -> int:
        return int(self.step_minutes * 60 * self.sampling_rate)
