"""Every threshold the operators use, with its published default.

``as_of`` replaces "today": results must not depend on the day a job runs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    as_of: dt.date = field(default_factory=dt.date.today)

    # Component weights of the overall score and its bands.
    weight_cost: float = 0.25
    weight_delay: float = 0.25
    weight_duplicate: float = 0.20
    weight_agency: float = 0.15
    weight_compliance: float = 0.15
    medium_from: float = 40.0
    high_from: float = 70.0

    # Peer comparison, delay, duplication.
    min_peers: int = 8
    late_days: int = 60
    delay_full_days: int = 180
    similarity_floor: float = 0.94
    reason_above: float = 40.0

    # Vendor concentration and payment ageing.
    hhi_floor: float = 0.10
    hhi_ceiling: float = 0.60
    min_transactions: int = 20
    pending_floor_days: int = 90
    pending_ceiling_days: int = 730
    paid_status: str = "Payment Success"

    # D-01 year-end burst.
    burst_min_payments: int = 30
    burst_floor: float = 25.0
    burst_ceiling: float = 75.0
    # D-02 first digits.
    digit_min_payments: int = 150
    digit_floor: float = 9.0
    digit_ceiling: float = 15.5
    # D-03 idle allocation.
    idle_min_allocation: float = 10_000_000.0
    idle_min_works: int = 17
    idle_floor: float = 35.0
    idle_ceiling: float = 75.0
    # D-04 uniform amounts.
    uniform_min_works: int = 25
    uniform_floor: float = 40.0
    uniform_ceiling: float = 95.0

    # Ingest.
    duration_days: int = 365
    min_amount: float = 1000.0
    max_other_share: float = 0.40

    # Forecast and silence.
    forecast_days: int = 90
    forecast_min_open: int = 20
    forecast_quantile: float = 0.75
    quiet_days: int = 180
    quiet_min_open: int = 20

    # Rankings.
    agency_min_works: int = 10

    # The term that sits now.
    current_term: int = 18
    # Upper-house records whose term ended earlier are of no interest.
    upper_from_year: int = 2019

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
