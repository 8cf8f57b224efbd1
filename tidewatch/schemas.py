"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

LOADS = """
  load_id STRING, institution STRING, external_id STRING, received_at TIMESTAMP, content_hash STRING,
  slot_hint STRING, record_count BIGINT, total_amount DECIMAL(20,2), customer_count BIGINT,
  zero_amount_count BIGINT, negative_amount_count BIGINT, duplicate_record_count BIGINT,
  max_amount DECIMAL(20,2), source STRING, file_name STRING, ingested_at TIMESTAMP
"""

SLOT = (
    "STRUCT<key: STRING, label: STRING, cadence: STRING, weekdays: ARRAY<INT>, month_days: ARRAY<INT>, "
    "last_business_day: BOOLEAN, holiday_shift: STRING, window_start_min: INT, deadline_min: INT, grace_minutes: INT>"
)
WATCH = "STRUCT<metric: STRING, sensitivity: STRING, direction: STRING>"
LIMIT = "STRUCT<id: STRING, metric: STRING, min: DOUBLE, max: DOUBLE, severity: STRING, note: STRING>"
QUALITY = (
    "STRUCT<detect_duplicate_file: BOOLEAN, detect_stale_data: BOOLEAN, detect_unit_scale: BOOLEAN, "
    "max_zero_amount_ratio: DOUBLE, max_duplicate_record_ratio: DOUBLE, forbid_negative_amounts: BOOLEAN, "
    "unexpected_delivery: STRING>"
)
LEARNING = "STRUCT<lookback_days: INT, min_history: INT>"

CONTRACTS = f"""
  institution STRING, version INT, status STRING, effective_from DATE, timezone STRING, calendar STRING,
  slots ARRAY<{SLOT}>, metrics ARRAY<{WATCH}>, limits ARRAY<{LIMIT}>, quality {QUALITY}, learning {LEARNING}
"""

DEFAULT_QUALITY_SQL = (
    "named_struct('detect_duplicate_file', true, 'detect_stale_data', true, 'detect_unit_scale', true, "
    "'max_zero_amount_ratio', 0.05D, 'max_duplicate_record_ratio', 0.01D, 'forbid_negative_amounts', true, "
    "'unexpected_delivery', 'INFO')"
)
DEFAULT_LEARNING_SQL = "named_struct('lookback_days', 180, 'min_history', 8)"

FINDING = (
    "STRUCT<code: STRING, category: STRING, severity: STRING, metric: STRING, observed: DOUBLE, "
    "expected: DOUBLE, lower: DOUBLE, upper: DOUBLE, score: DOUBLE, evidence: STRING>"
)
