"""Scalar column functions. All are built-in Spark expressions (codegen-able)."""

from shipfold.functions.text import (
    blank_default,
    blank_to_null,
    canonical_key,
    collapse_ws,
    first_int,
    html_escape,
    is_missing_key,
    lower_strip,
    strip,
    tag_join,
    tag_split,
    token_clean_bulk,
    token_clean_scrape,
)
from shipfold.functions.milestone import (
    RULE_DIRECT,
    RULE_ROLLBACK,
    RULE_SCHEDULED,
    captured_seed,
    date_part,
    join_datetime,
    milestone_status,
    time_part,
    time_rule,
    time_rule_ts,
)

__all__ = [
    "blank_default", "blank_to_null", "canonical_key", "collapse_ws", "first_int",
    "html_escape", "is_missing_key", "lower_strip", "strip", "tag_join", "tag_split",
    "token_clean_bulk", "token_clean_scrape", "RULE_DIRECT", "RULE_ROLLBACK",
    "RULE_SCHEDULED", "captured_seed", "date_part", "join_datetime",
    "milestone_status", "time_part", "time_rule", "time_rule_ts",
]
