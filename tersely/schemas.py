"""Fixed record schemas."""

from __future__ import annotations

AUDIT = (
    "ts string, version string, tool string, action string, reason string, "
    "estimator string, input_hash string, input_tokens_est long, "
    "output_tokens_est long, delta_tokens long, duration_ms long, session_id string"
)
EVENT = (
    "ts string, type string, action string, reason string, input_tokens long, "
    "output_tokens long, prompt_hash string, segment_types array<string>, transformed boolean"
)
BLOCK = "struct<attempted:long,applied:long,pass_through:long,delta:long>"
SNAPSHOT = (
    "schema_version long, transforms_attempted long, transforms_applied long, "
    "pass_through long, estimated_token_delta_total long, "
    f"pass_through_reasons map<string,long>, by_tool map<string,{BLOCK}>, "
    f"daily map<string,{BLOCK}>"
)
BASELINE = "name string, input_tokens double, output_tokens double, delta_pct double"
SNAPSHOT_VERSION = 2
