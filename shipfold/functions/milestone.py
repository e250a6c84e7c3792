"""Milestone helpers: derived status, suggested times, date/time parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipfold.functions.text import ColumnLike, _c, blank_to_null

# FIXED VALUES: the three rule labels of the suggested-time calculator.
RULE_DIRECT = "3-Hour Rule (use actual time directly)"
RULE_ROLLBACK = "2.5-Hour Rollback (now - 2.5h)"
RULE_SCHEDULED = "Scheduled (actual not yet reached)"

# FIXED VALUES: window of the direct rule and the rollback distance.
DIRECT_PAST = "INTERVAL 3 HOURS"
DIRECT_FUTURE = "INTERVAL 24 HOURS"
ROLLBACK = "INTERVAL 150 MINUTES"

MINUTE_FORMAT = "yyyy-MM-dd HH:mm:00"


def milestone_status(atd: ColumnLike, ata: ColumnLike) -> Column:
    """ata set -> Completed, else atd set -> Pending Arrival, else Pending
    Depart; a blank counts as absent (X5)."""
    return (F.when(blank_to_null(ata).isNotNull(), F.lit("Completed"))
            .when(blank_to_null(atd).isNotNull(), F.lit("Pending Arrival"))
            .otherwise(F.lit("Pending Depart")))


def _fmt_minute(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_FORMAT)


def time_rule_ts(captured: ColumnLike, now: ColumnLike) -> Column:
    """Suggested time for a captured NTZ timestamp at time ``now``.

    Returns ``struct(value string, rule string)``, NULL when captured is NULL.
    Both edges of the direct window are inclusive; the value keeps minute
    precision.
    """
    cap, nw = _c(captured), _c(now)
    rollback = cap < nw - F.expr(DIRECT_PAST)
    scheduled = cap > nw + F.expr(DIRECT_FUTURE)
    value = F.when(rollback, _fmt_minute(nw - F.expr(ROLLBACK))).otherwise(_fmt_minute(cap))
    rule = (F.when(rollback, F.lit(RULE_ROLLBACK))
            .when(scheduled, F.lit(RULE_SCHEDULED))
            .otherwise(F.lit(RULE_DIRECT)))
    return F.when(cap.isNull(), F.lit(None).cast("struct<value:string,rule:string>")) \
        .otherwise(F.struct(value.alias("value"), rule.alias("rule")))


def parse_date_time(date_str: ColumnLike, time_str: ColumnLike) -> Column:
    """'yyyy-MM-dd' + 'HH:mm[:ss]' -> NTZ timestamp, NULL when blank or bad."""
    d, t = _c(date_str), _c(time_str)
    joined = F.concat(d, F.lit("T"), t)
    parsed = F.coalesce(
        F.try_to_timestamp(joined, F.lit("yyyy-MM-dd'T'HH:mm")),
        F.try_to_timestamp(joined, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    ).cast("timestamp_ntz")
    return F.when(blank_to_null(d).isNull() | blank_to_null(t).isNull(),
                  F.lit(None).cast("timestamp_ntz")).otherwise(parsed)


def time_rule(date_str: ColumnLike, time_str: ColumnLike, now: ColumnLike) -> Column:
    """``calcRule(date, time)`` with ``now`` as a parameter."""
    return time_rule_ts(parse_date_time(date_str, time_str), now)


def captured_seed(existing: ColumnLike, scheduled: ColumnLike) -> Column:
    """Existing value, else the scheduled one, else '' (X7)."""
    return F.coalesce(blank_to_null(existing), blank_to_null(scheduled), F.lit(""))


def date_part(seed: ColumnLike) -> Column:
    """Text before the first space, '' when absent."""
    return F.coalesce(F.try_element_at(F.split(_c(seed), " "), F.lit(1)), F.lit(""))


def time_part(seed: ColumnLike) -> Column:
    """First five characters after the first space (HH:mm), '' when absent."""
    t = F.coalesce(F.try_element_at(F.split(_c(seed), " "), F.lit(2)), F.lit(""))
    return F.substring(t, 1, 5)


def join_datetime(date_str: ColumnLike, time_str: ColumnLike) -> Column:
    """``d + ' ' + t + ':00'``."""
    return F.concat(_c(date_str), F.lit(" "), _c(time_str), F.lit(":00"))
