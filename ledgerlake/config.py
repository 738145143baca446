"""Run parameters.

Every business constant the pipeline needs lives here, in one frozen dataclass,
so a job is fully described by (input tables, Settings).  Values under
"fixed values" must equal the behaviour being reproduced; do not tune them.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


# ---------------------------------------------------------------------------
# fixed values (business rules reproduced as-is)
# ---------------------------------------------------------------------------
TERMS_DAYS = {"NET15": 15, "NET30": 30, "NET45": 45, "NET60": 60, "NET90": 90}
DEFAULT_TERMS_DAYS = 30

ESCALATION_RANK = {
    "INVOICE_VIEWED": 0, "PARTIAL_PAYMENT": 0,
    "REMINDER": 1, "CALL": 1, "PTP": 1,
    "DISPUTE": 2, "ESCALATION": 3,
}
ESCALATION_LABEL = {0: "NONE", 1: "REMINDER", 2: "FORMAL", 3: "LEGAL"}

SCORE_WEIGHTS = {"late": 0.30, "volatility": 0.20, "dispute": 0.15, "ptp": 0.20, "trend": 0.15}

STAGE_PROBABILITY = {
    "Prospecting": 0.10, "Qualification": 0.25, "Proposal": 0.50,
    "Negotiation": 0.75, "Verbal Commit": 0.90, "Closed Won": 1.00,
}
PIPELINE_WEIGHTS = (0.30, 0.40, 0.30)
PIPELINE_OFFSETS = (0, 30, 60)

INFLOW_CONFIDENCE = {"COMMITTED": "HIGH", "APPROVED": "MEDIUM", "PENDING": "LOW", "CONTINGENT": "LOW"}
EXPENSE_CONFIDENCE = {
    "Salary": "HIGH", "Statutory Tax": "HIGH", "Renewal": "MEDIUM",
    "PO-based": "MEDIUM", "Seasonal": "LOW", "One-time": "LOW",
}
SOURCE_CONFIDENCE = {"S1": "MEDIUM", "S2": "MEDIUM", "S3": "LOW", "S4": "LOW", "S5": "LOW", "S6": "MEDIUM"}
# (loser, winner, reason) in the order the rules are applied; a later rule overwrites the reason
DEDUP_RULES = (
    ("S4", "S1", "DEDUP_S4_TO_S1"),
    ("S3", "S1", "DEDUP_S3_TO_S1"),
    ("S6", "S2", "DEDUP_S6_TO_S2"),
)

RECOMMENDATION_WEIGHTS = {"cash": 0.40, "risk": 0.30, "target": 0.20, "feasibility": 0.10}

S1_ORDINAL = {
    "invoice_amount_bucket": {"SMALL": 0, "MEDIUM": 1, "LARGE": 2},
    "risk_segment": {"LOW": 0, "MEDIUM": 1, "HIGH": 2},
    "escalation_status": {"NONE": 0, "REMINDER": 1, "FORMAL": 2, "LEGAL": 3},
}
RISK_CLASS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


# fixed values: the defaults below, too
@dataclass(frozen=True)
class Settings:
    reference_date: dt.date = dt.date(2001, 8, 2)
    horizon_days: int = 180
    wip_horizon_days: int = 90
    opening_balance: float = 5_000_000.0
    feature_version: str = "v1.0.0"
    score_model_version: str = "cbm-v1.0"
    run_id: str = "run-0001"
    # S3 rules
    completion_threshold: float = 0.80
    lookforward_days: int = 30
    wip_statuses: tuple = ("ACTIVE",)
    invoice_lag_days: int = 7
    fallback_delay_days: int = 30
    # recommendation levers
    accel_days: int = 5
    collections_top: int = 10
    vendor_defer_days: int = 10
    vendor_window_days: int = 14
    vendor_top: int = 5
    expense_defer_days: int = 21
    expense_categories: tuple = ("Seasonal", "One-time")
    expense_top: int = 3
    top_n: int = 10
    # training
    test_size: float = 0.2
    seed: int = 42
    s1_target_range: tuple = (0, 365)
    s2_target_range: tuple = (-60, 60)
    s1_divergence_threshold: int = 10
    s2_divergence_threshold: int = 8
    s1_error_buckets: tuple = (3, 7, 14, 30)
    s2_error_buckets: tuple = (3, 5, 10, 15)
    thin_vendor_invoices: int = 10
    overfit_threshold: float = 1.5
    extra: dict = field(default_factory=dict)

    @property
    def horizon_end(self) -> dt.date:
        return self.reference_date + dt.timedelta(days=self.horizon_days)

    @property
    def wip_horizon_end(self) -> dt.date:
        return self.reference_date + dt.timedelta(days=self.wip_horizon_days)


DEFAULT = Settings()
