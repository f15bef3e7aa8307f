
from __future__ import annotations

from dataclasses import dataclass


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class QualityPolicy:
    v_min: float = 0.0
    v_max: float = 5.0
    noise_scale: float = 20.0
    snr_divisor: float = 5.0
    trend_scale: float = 1000.0
    weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)
    clamp: tuple[float, float] = (0.0, 10.0)
    min_samples: int = 10
    max_pct_out: float = 0.1
    min_channels: int = 4
    threshold_pass: float = 7.0

    def validate(self) -> QualityPolicy:
        if self.v_max <= self.v_min or self.clamp[1] <= self.clamp[0]:
            raise ConfigError("ranges must not be empty")
        if abs(sum(self.weights) - 1) > 1e-6:
            raise ConfigError("weights must sum to 1")
        if self.min_samples < 2 or self.min_channels < 1 or min(self.snr_divisor, self.noise_scale, self.trend_scale) <= 0:
            raise ConfigError("minimums and scales must be positive")
        return self


@dataclass(frozen=True)
class ProfilePolicy:
    aggregate_mode: str = "mean"
    corr_method: str = "pearson"
    expected_lasers: int = 6
    min_measurements: int = 3

    def validate(self) -> ProfilePolicy:
        if self.aggregate_mode not in ("mean", "median"):
            raise ConfigError("aggregate_mode is mean or median")
        if self.corr_method not in ("pearson", "spearman"):
            raise ConfigError("corr_method is pearson or spearman")
        if self.expected_lasers < 1 or self.min_measurements < 1:
            raise ConfigError("counts must be positive")
        return self


@dataclass(frozen=True)
class BinsPolicy:
    support_q: float = 5e-4
    min_bins: int = 32
    max_bins: int = 256
    width_sigma: float = 0.25
    epsilon: float = 1e-12
    increment_q: float = 0.999
    coupling: tuple[int, int, float] = (4, 16, 25.0)

    def validate(self) -> BinsPolicy:
        if not 0 <= self.support_q < 0.5:
            raise ConfigError("support_q must be in [0, 0.5)")
        if self.min_bins < 2 or self.max_bins < self.min_bins:
            raise ConfigError("bin limits")
        return self
