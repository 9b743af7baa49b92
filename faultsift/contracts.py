"""Schemas and thresholds shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

WIRE_SCHEMA = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("exceptionType", T.StringType()),
    T.StructField("stacktrace", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("receivedAt", T.TimestampType()),
])

# The same record as columns; ``seq`` orders arrivals that share an instant.
EVENT_COLUMNS = [
    "event_id", "received_at", "seq", "service", "level", "message", "platform",
    "exception_type", "stacktrace", "release", "payload",
]

STATUSES = ("open", "resolved", "ignored", "regressed")
DETECTORS = ("ewma", "zscore", "poisson")
ALERT_KINDS = ("spike", "new_group", "regression", "silence")


@dataclass(frozen=True)
class Params:
    hourly_cap: int = 200
    fingerprint_version: int = 1
    # detection
    history_hours: int = 24
    min_history_hours: int = 6
    min_observed: int = 5
    ewma_alpha: float = 0.3
    ewma_multiplier: float = 3.0
    ewma_floor: float = 0.5
    z_threshold: float = 3.0
    z_sigma_floor: float = 1.0
    poisson_probability: float = 0.001
    poisson_lambda_floor: float = 0.1
    poisson_max_terms: int | None = None  # 200 stops the sum as the original does
    active_detector: str = "ewma"
    # hindsight
    score_after_hours: int = 3
    oracle_lookback_hours: int = 24
    oracle_multiplier: float = 4.0
    # rules without statistics
    new_group_window_hours: int = 2
    new_group_threshold: int = 10
    silence_window_hours: int = 24
    silence_quiet_hours: int = 3
    silence_min_busy_hours: int = 6
    # alerting
    cooldown_minutes: int = 60
    silence_cooldown_minutes: int = 1440
    max_attempts: int = 5
    # retention
    retention_days: int = 14
    pressure_days: int = 7
    critical_days: int = 3
    pressure_bytes: int = 300 * 1024 * 1024
    critical_bytes: int = 400 * 1024 * 1024

    def cooldown_for(self, kind: str) -> int:
        return self.silence_cooldown_minutes if kind == "silence" else self.cooldown_minutes


DEFAULTS = Params()
