"""The scalar rules as Spark SQL functions, for users of ``spark.sql``.

``register_sql_functions(spark)`` creates temporary SQL-bodied functions
(``CREATE TEMPORARY FUNCTION ... RETURN``). Catalyst inlines them, so they
stay JVM-side and inside whole-stage codegen like the Column functions they
mirror; ``tests/test_sql_functions.py`` checks each against its twin.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from shipfold.functions.milestone import (DIRECT_FUTURE, DIRECT_PAST, MINUTE_FORMAT, ROLLBACK,
                                          RULE_DIRECT, RULE_ROLLBACK, RULE_SCHEDULED)
from shipfold.functions.text import (BROWSER_RUN_RE, BROWSER_WS_CHARS, MISSING_KEY_TOKENS,
                                     SCRAPE_NULL_TOKENS, WS_CHARS)


def _sql_str(s: str) -> str:
    """A SQL string literal; non-printing characters as \\uXXXX escapes."""
    out = []
    for ch in s:
        if ch == "'" or ch == "\\" or not ch.isprintable() or ch.isspace():
            out.append("\\u%04x" % ord(ch))
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _in(tokens) -> str:
    return ", ".join(_sql_str(t) for t in tokens)


def _strip(x: str) -> str:
    # Inlined rather than calling sf_strip: SQL functions cannot be nested
    # inside a lambda of another SQL function.
    return f"btrim({x}, {_sql_str(WS_CHARS)})"


FUNCTIONS = {
    "sf_strip": ("s STRING", "STRING", _strip("s")),
    "sf_collapse_ws": ("s STRING", "STRING",
                       f"trim(regexp_replace(s, {_sql_str(BROWSER_RUN_RE)}, ' '))"),
    "sf_blank_default": ("s STRING, d STRING", "STRING", "coalesce(nullif(s, ''), d)"),
    "sf_is_missing_key": ("k STRING", "BOOLEAN",
                          f"k IS NULL OR {_strip('k')} IN ({_in(MISSING_KEY_TOKENS)})"),
    "sf_clean_bulk": ("v STRING", "STRING",
                      f"CASE WHEN v IS NULL OR {_strip('v')} IN ({_in(MISSING_KEY_TOKENS)}) THEN NULL "
                      f"ELSE {_strip('v')} END"),
    "sf_clean_scrape": ("v STRING", "STRING",
                        f"CASE WHEN lower({_strip('coalesce(v, ' + chr(39) * 2 + ')')}) "
                        f"IN ({_in(SCRAPE_NULL_TOKENS)}) "
                        f"THEN NULL ELSE {_strip('coalesce(v, ' + chr(39) * 2 + ')')} END"),
    "sf_tag_split": ("s STRING", "ARRAY<STRING>",
                     "CASE WHEN s IS NULL OR s = '' THEN CAST(array() AS ARRAY<STRING>) "
                     f"ELSE transform(split(s, ','), t -> btrim(t, {_sql_str(BROWSER_WS_CHARS)})) END"),
    "sf_first_int": ("s STRING", "BIGINT",
                     "try_cast(nullif(regexp_extract(s, '(\\\\d+)', 1), '') AS BIGINT)"),
    "sf_html_escape": ("s STRING", "STRING",
                       "replace(replace(replace(replace(coalesce(s, ''), '&', '&amp;'), '<', '&lt;'), "
                       "'>', '&gt;'), '\"', '&quot;')"),
    "sf_milestone_status": ("atd STRING, ata STRING", "STRING",
                            "CASE WHEN nullif(ata, '') IS NOT NULL THEN 'Completed' "
                            "WHEN nullif(atd, '') IS NOT NULL THEN 'Pending Arrival' "
                            "ELSE 'Pending Depart' END"),
    "sf_time_rule": ("cap TIMESTAMP_NTZ, now TIMESTAMP_NTZ", "STRUCT<value: STRING, rule: STRING>",
                     f"CASE WHEN cap IS NULL THEN NULL ELSE named_struct("
                     f"'value', CASE WHEN cap < now - {DIRECT_PAST} "
                     f"THEN date_format(now - {ROLLBACK}, '{MINUTE_FORMAT}') "
                     f"ELSE date_format(cap, '{MINUTE_FORMAT}') END, "
                     f"'rule', CASE WHEN cap < now - {DIRECT_PAST} THEN '{RULE_ROLLBACK}' "
                     f"WHEN cap > now + {DIRECT_FUTURE} THEN '{RULE_SCHEDULED}' "
                     f"ELSE '{RULE_DIRECT}' END) END"),
    "sf_contains": ("have STRING, want STRING", "BOOLEAN",
                    "contains(lower(coalesce(have, '')), lower(want))"),
    "sf_in_range": ("have STRING, lo STRING, hi STRING", "BOOLEAN",
                    "(lo IS NULL OR lo = '' OR coalesce(have, '') >= lo) AND "
                    "(hi IS NULL OR hi = '' OR coalesce(have, '') <= concat(hi, '\\uffff'))"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
