"""Row filters and predicates.

Every filter is a ``Column`` predicate or a ``DataFrame -> DataFrame`` call so
Catalyst can push it into the scan; equality reaches Parquet as
``PushedFilters``. Substring and range predicates on expressions stay in the
scan's filter node.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import is_missing_key, lower_ascii, strip

ALL_SENTINEL = "All"
# U+FFFF appended to an upper bound so a bare date covers its whole day.
RANGE_CEILING = "￿"


def _and(preds: Iterable[Column]) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def eq_predicate(params: Mapping[str, str | None]) -> Column:
    """Optional equality conjunction: a given, non-empty value adds ``col = v``
    (case-sensitive); empty or None adds nothing (F1)."""
    return _and(F.col(c) == F.lit(v) for c, v in params.items() if v)


def eq_filter(df: DataFrame, params: Mapping[str, str | None]) -> DataFrame:
    return df.filter(eq_predicate(params))


def sentinel_predicate(params: Mapping[str, str | None], sentinel: str = ALL_SENTINEL) -> Column:
    """As F1, with the ``All`` sentinel meaning no filter (F2)."""
    return eq_predicate({c: v for c, v in params.items() if v and v != sentinel})


def sentinel_filter(df: DataFrame, params: Mapping[str, str | None],
                    sentinel: str = ALL_SENTINEL) -> DataFrame:
    return df.filter(sentinel_predicate(params, sentinel))


def like_predicate(col: str, value: str) -> Column:
    """SQL ``LIKE '%v%'`` without escaping; ``%``/``_`` in ``v`` stay
    wildcards, a backslash is a character like any other; A-Z match a-z and
    no other letters are folded (F3)."""
    pattern = value.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    return lower_ascii(col).like(f"%{pattern}%")


def like_filter(df: DataFrame, col: str, value: str | None) -> DataFrame:
    return df.filter(like_predicate(col, value)) if value else df


def contains_predicate(col: str, value: str) -> Column:
    """Literal, case-insensitive substring; a NULL cell is '' (F4)."""
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lower(F.lit(value)))


def contains_filter(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.filter(contains_predicate(col, value))


def select_predicate(col: str, value: str, exact: bool = False) -> Column:
    """The grid's select filter: a substring match as coded; ``exact=True`` gives
    the documented equality (F5)."""
    return (F.col(col) == F.lit(value)) if exact else contains_predicate(col, value)


def select_filter(df: DataFrame, col: str, value: str, exact: bool = False) -> DataFrame:
    return df.filter(select_predicate(col, value, exact))


def date_range_predicate(col: str, start: str | None, end: str | None) -> Column:
    """Inclusive lexical range; the upper bound gets U+FFFF appended; a NULL
    cell is '' (fails a lower bound, passes an upper-only bound) (F6)."""
    have = F.coalesce(F.col(col), F.lit(""))
    preds = []
    if start:
        preds.append(have >= F.lit(start))
    if end:
        preds.append(have <= F.lit(end + RANGE_CEILING))
    return _and(preds)


def date_range_filter(df: DataFrame, col: str, start: str | None, end: str | None) -> DataFrame:
    return df.filter(date_range_predicate(col, start, end))


def grid_predicate(filters: Mapping[str, object]) -> Column:
    """Conjunction of column filters as the grid collects them.

    A value that is a mapping/tuple is a date range ``{start, end}``; a string
    is a substring filter. Strings are trimmed; empty and ``All`` are ignored.
    """
    preds = []
    for col, want in filters.items():
        if isinstance(want, Mapping) or isinstance(want, tuple):
            start, end = (want.get("start"), want.get("end")) if isinstance(want, Mapping) else want
            start, end = (start or "").strip(), (end or "").strip()
            if start or end:
                preds.append(date_range_predicate(col, start, end))
            continue
        value = (want or "").strip()
        if value and value != ALL_SENTINEL:
            preds.append(contains_predicate(col, value))
    return _and(preds)


def grid_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    return df.filter(grid_predicate(filters))


def point_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """Row by key; an empty result is the not-found case (F8)."""
    return df.filter(F.col(key) == F.lit(value))


def multi_lookup(df: DataFrame, key: str, keys: DataFrame, keys_col: str | None = None) -> DataFrame:
    """Rows for a set of keys held in a DataFrame: a left-semi join, so the key
    set may be as large as the table (F8)."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    return df.join(k, on=key, how="left_semi")


def flag_missing_key(df: DataFrame, key: str, flag: str = "key_missing") -> DataFrame:
    """Adds a boolean: key NULL or strip(key) in '', 'nan', 'None' (F9)."""
    return df.withColumn(flag, is_missing_key(key))


def split_missing_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept with stripped key, rejected)."""
    kept = df.filter(~is_missing_key(key)).withColumn(key, strip(key))
    rejected = df.filter(is_missing_key(key))
    return kept, rejected


def unknown_columns(fields: Column, known: Iterable[str]) -> Column:
    """Names in a change's field map that the table lacks, sorted."""
    known_arr = F.array(*[F.lit(k) for k in sorted(set(known))])
    return F.array_sort(F.array_except(F.map_keys(fields), known_arr))
