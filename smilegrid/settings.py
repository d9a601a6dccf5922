"""Study parameters.

Every threshold is a plain field, so a caller can run the same operators on a
different market or a shorter history.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- fixed values: these must equal the published study for results to agree ---
TENOR_COLUMNS = ("1M", "2M", "3M", "4M", "6M", "12M")
TENOR_MONTHS = (1, 2, 3, 4, 6, 12)
RATE_DATE = "Calendar Date"
DIVIDEND = "Dividend Yield (Value-Weighted)"
FORECAST_MODELS = ("persistence", "arima", "ridge", "xgboost")
TRADED_MODELS = ("arima", "ridge", "xgboost")
GREEKS = ("Delta", "Gamma", "Vega", "Theta")
STATES = ("ORIGINAL", "DELTA_NEUTRAL", "VEGA_BALANCED", "VEGA_BALANCED_DELTA_NEUTRAL")
STATE_PAIRS = (
    ("DELTA_NEUTRAL", "ORIGINAL"),
    ("VEGA_BALANCED", "ORIGINAL"),
    ("VEGA_BALANCED_DELTA_NEUTRAL", "ORIGINAL"),
    ("VEGA_BALANCED_DELTA_NEUTRAL", "DELTA_NEUTRAL"),
)
IMPLEMENTATIONS = (("MID", "mid"), ("BID_ASK", "exec"))
PROCESSED = "PROCESSED_1545"
RECOVERED = "RAW_1545_RECOVERED"
NO_QUOTE = "NO_VALID_1545_QUOTE"
FEATURE_LAGS = (1, 2, 3, 5, 10)
ARMA_ORDERS = ((1, 0, 0), (2, 0, 0), (1, 1, 0), (1, 0, 1), (2, 0, 1))
RIDGE_PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)
HEDGE_COST_BPS = (0.5, 1.0, 2.0, 5.0)
HAC_LAGS = (1, 5, 10)
# --- end of fixed values ---


@dataclass(frozen=True)
class Cleaning:
    t_min_days: int = 14
    t_max_years: float = 1.0
    moneyness_min: float = 0.8
    moneyness_max: float = 1.2
    spread_rel_max: float = 0.2
    bound_tolerance: float = 1e-4
    days_per_year: float = 365.0
    trading_days: float = 252.0


@dataclass(frozen=True)
class Grid:
    x_min: float = -0.22
    x_max: float = 0.18
    x_points: int = 25
    t_min: float = 0.08
    t_max: float = 1.0
    t_points: int = 20
    min_points_day: int = 10
    min_coverage: float = 0.0

    def x_at(self, i: int) -> float:
        return self.x_min + i * ((self.x_max - self.x_min) / (self.x_points - 1))

    def t_at(self, i: int) -> float:
        return self.t_min + i * ((self.t_max - self.t_min) / (self.t_points - 1))


@dataclass(frozen=True)
class Splits:
    train_end: dt.date = dt.date(2021, 8, 12)
    fit_end: dt.date = dt.date(2023, 4, 21)
    min_train: int = 80
    min_validation: int = 20
    min_arma_train: int = 60


@dataclass(frozen=True)
class Signals:
    threshold: float = 0.5
    per_side: int = 10
    x_scale: float = 0.02
    t_scale: float = 0.05
    tie_tolerance: float = 1e-12
    side_budget: float = 0.5
    min_ic_nodes: int = 20


@dataclass(frozen=True)
class Inference:
    hac_lag: int = 5
    seed: int = 42
    reps: int = 4000
    forecast_reps: int = 2000
    blocks: tuple = (5, 10)
    alpha: float = 0.05


@dataclass(frozen=True)
class Study:
    cleaning: Cleaning = field(default_factory=Cleaning)
    grid: Grid = field(default_factory=Grid)
    splits: Splits = field(default_factory=Splits)
    signals: Signals = field(default_factory=Signals)
    inference: Inference = field(default_factory=Inference)
