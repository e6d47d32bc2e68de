"""Run settings and the fixed values every stage shares."""

from __future__ import annotations

from dataclasses import dataclass

# The published parameters of the analysis.
VOLUME_QUANTILE = 0.95
WINSOR_QUANTILE = 0.999
FETCH_ROWS = 50_000
TARGET_LEAD_ROWS = 30
MAX_PRICE_LAG = 250
MAX_RELATIVE_SPREAD = 0.5
DELTA_RANGE = (0.05, 0.95)
TENOR_DAYS = (25, 90)
WING_DELTA = 0.25
EWMA_ALPHA = 0.3
KEPT_PRICE_DIFFS = ["price_diff_1d", "price_diff_8d", "price_diff_13d", "price_diff_21d"]
SCALED_FEATURES = [
    "atm_iv", "skew", "curvature", "iv_std", "avg_delta", "avg_vega", "avg_theta",
] + KEPT_PRICE_DIFFS
ROW_GROUP_ROWS = 100_000

# Rows one window task should own before its halo is added; see operators/chunks.py.
CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of one extract run."""

    from_date: str
    to_date: str
    output_dir: str | None = None
    volume_quantile: float = VOLUME_QUANTILE
    fetch_rows: int = FETCH_ROWS
    lead_rows: int = TARGET_LEAD_ROWS
    max_price_lag: int = MAX_PRICE_LAG
    chunk_rows: int = CHUNK_ROWS
    dedupe_names: bool = False
