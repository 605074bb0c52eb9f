"""Experiment parameters."""

from __future__ import annotations

from dataclasses import dataclass

from barloom.operators.labels import Barrier
from barloom.operators.trades import (
    BINARY_GRID,
    MULTICLASS_GRID,
    REGRESSION_GRID,
    round_trip_cost,
    threshold_grid,
)

TIMEFRAMES = ("4h", "1h")


@dataclass(frozen=True)
class Formulation:
    """What a model predicts and the thresholds tried on its score."""

    name: str
    label: str
    grid: tuple[float, float, float]

    @property
    def thresholds(self) -> list[float]:
        return threshold_grid(*self.grid)


FORMULATIONS = {
    f.name: f
    for f in (
        Formulation("binary_homerun", "target", BINARY_GRID),
        Formulation("multiclass_3", "target", MULTICLASS_GRID),
        Formulation("regression_return", "target_ret", REGRESSION_GRID),
    )
}


@dataclass(frozen=True)
class ExperimentConfig:
    """Defaults shared by baseline, A/B and sweep jobs."""

    swing_period: int = 10
    tp_multi: float = 1.5
    sl_multi: float = 1.0
    window_months: int = 6
    step_months: int = 6
    fee_rate: float = 0.0
    slippage: float = 0.0
    n_bootstrap: int = 1000
    n_blocks: int = 8
    random_state: int = 42
    embargo_days: int | None = None
    embargo_bars: int | None = None

    @property
    def barrier(self) -> Barrier:
        return Barrier(self.swing_period, self.tp_multi, self.sl_multi)

    @property
    def cost(self) -> float:
        return round_trip_cost(self.fee_rate, self.slippage)
