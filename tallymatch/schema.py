"""Tables and tunables of the reconciliation engine. Money is BIGINT in minor units everywhere."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

LEDGER = "order_id string, merchant_id string, customer_ref string, amount_minor bigint, currency string, booked_at timestamp_ntz, status string, ord bigint"
SETTLEMENTS = "settlement_id string, merchant_id string, utr string, settled_on date, gross_minor bigint, fee_minor bigint, tax_minor bigint, adjustments_minor bigint, net_minor bigint, ord bigint"
PAYMENTS = "payment_id string, settlement_id string, order_ref_raw string, order_ref string, amount_minor bigint, captured_at timestamp_ntz, pos int, ord bigint"
BANK = "txn_id string, value_date date, narration string, narration_normalized string, utr string, merchant string, credit_minor bigint, debit_minor bigint, balance_minor bigint, ord bigint"
QUARANTINE = "source string, ord bigint, code string, field string, raw string"

STATUSES = ("CAPTURED", "REFUNDED", "PARTIAL_REFUND")
LINK_TYPES = ("ORDER_PAID_BY", "PAYMENT_SETTLED_IN", "SETTLEMENT_CREDITED_AS", "PAYMENT_CREDITED_AS")


@dataclass(frozen=True)
class Config:
    """The defaults that results depend on."""

    band_floor_minor: int = 100
    band_bps: int = 50
    band_days: int = 3
    subset_epsilon_minor: int = 300
    subset_most: int = 40
    half_most: int = 16
    duplicate_days: int = 7
    name_score: float = 0.90
    name_margin: float = 0.05
    name_days: int = 7
    sibling_support: float = 0.80
    ring_events: int = 3
    ring_merchants: int = 2
    residual_passes: int = 4
    tau_high: float = 0.95
    tau_low: float = 0.60
    target_precision: float = 0.99
    severe_minor: tuple[int, int, int] = (10_000_000, 1_000_000, 100_000)
    escalate_days: int = 14
    rounding_each_minor: int = 500
    rounding_run_minor: int = 50_000
    timing_days: int = 5
    fee_bps: int = 200
    tax_bps: int = 1800

    @property
    def digest(self) -> str:
        """sha256 of the canonical JSON, its first 16 hexadecimal digits."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


DEFAULTS = Config()
