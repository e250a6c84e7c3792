"""Folding the change log into one current row per key.

Rules (each needed for equality with request-at-a-time application):

1. An upsert sets only the columns it carries.
2. A replace drops everything older; the row's order key becomes its seq.
3. Upsert defaults (``bot_status = pending``) are added when the change is
   built (see ``changes.py``).
4. A patch needs an existing row: it counts only after the key's first
   replace/upsert; earlier patches are ``not_found``.
5. An empty patch is ``skipped`` and changes nothing (not even the stamp).
6. Milestone tables: the last applied patch writes its own status, else the
   status derived from the final ``atd``/``ata``.
7. ``last_updated`` is the ts of the last applied change.

Closed form, one aggregation per key: for each column take the latest change
that carries it; it is valid only if its seq is at or after
``coalesce(last_replace_seq, first_insert_seq)``. A later replace without the
column, or no insert before it, means the column is NULL. No earlier change
can win once the latest is invalid, so no join and no per-key window is
needed, and the aggregate has a partial (map-side) step: a key holding a
third of all rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.milestone import milestone_status
from shipfold.operators.changes import PATCH, REPLACE, UPSERT

INSERT_KINDS = (REPLACE, UPSERT)


def _applicable() -> Column:
    """Changes that can take effect: inserts always, patches when non-empty."""
    return (F.col("kind") != F.lit(PATCH)) | (F.size("fields") > 0)


def _state(columns: Sequence[str]) -> dict[str, tuple]:
    """Per state entry: how it merges, and what one change gives it."""
    kind, seq = F.col("kind"), F.col("seq")
    entries = {
        "_first_insert": (F.min, F.when(kind.isin(*INSERT_KINDS), seq)),
        "_last_replace": (F.max, F.when(kind == F.lit(REPLACE), seq)),
        "_last": (F.max, F.when(_applicable(), F.struct(
            seq.alias("seq"), F.col("ts").alias("ts"), kind.alias("kind"),
            F.map_contains_key("fields", F.lit("status")).alias("has_status"),
            F.try_element_at("fields", F.lit("status")).alias("status"),
        ))),
    }
    for c in columns:
        entries[f"_c_{c}"] = (F.max, F.when(F.map_contains_key("fields", F.lit(c)), F.struct(
            seq.alias("seq"), F.try_element_at("fields", F.lit(c)).alias("v"))))
    return entries


def state_aggregates(columns: Sequence[str]) -> list[Column]:
    """The per-key aggregate state of the fold. Every entry is a min or max,
    so states of two slices of the log merge by the same aggregate: batch
    and stream folds agree, and replaying a slice changes nothing."""
    return [merge(e).alias(name) for name, (merge, e) in _state(columns).items()]


def fold_state(changes: DataFrame, columns: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """Per-key state of ``changes`` on top of ``base``, the state of all earlier
    ones. One aggregation: each change enters as a state of its own."""
    if base is None:
        return changes.groupBy("key").agg(*state_aggregates(columns))
    entries = _state(columns)
    one = changes.select("key", *[e.alias(name) for name, (_, e) in entries.items()])
    return base.unionByName(one).groupBy("key").agg(*[merge(name).alias(name) for name, (merge, _) in entries.items()])


def finish(state: DataFrame, columns: Sequence[str], milestone: bool = False,
           key_name: str = "key", stamp: str | None = "last_updated") -> DataFrame:
    """Current rows from per-key fold state (see ``state_aggregates``)."""
    floor = F.coalesce(F.col("_last_replace"), F.col("_first_insert"))
    values = {c: F.when(F.col(f"_c_{c}.seq") >= floor, F.col(f"_c_{c}.v")) for c in columns}
    if milestone and "status" in values:
        last = F.col("_last")
        derived = milestone_status(values.get("atd", F.lit(None)), values.get("ata", F.lit(None)))
        values["status"] = F.when(
            last["kind"] == F.lit(PATCH),
            F.when(last["has_status"], last["status"]).otherwise(derived),
        ).otherwise(values["status"])
    out = [F.col("key").alias(key_name)]
    out += [v.cast("string").alias(c) for c, v in values.items()]
    out.append(floor.alias("row_seq"))
    if stamp:
        out.append(F.col("_last.ts").alias(stamp))
    return state.filter(F.col("_first_insert").isNotNull()).select(*out)


def fold(changes: DataFrame, columns: Sequence[str], milestone: bool = False,
         key_name: str = "key", stamp: str | None = "last_updated") -> DataFrame:
    """Current row per key from a change log.

    Output: ``key_name``, one string column per entry of ``columns``,
    ``row_seq`` (order of the row's id) and, if ``stamp``, the stamp column.
    Keys never inserted produce no row.
    """
    return finish(fold_state(changes, columns), columns, milestone, key_name, stamp)


def key_stats(changes: DataFrame) -> DataFrame:
    """Per key: first insert seq (NULL if never inserted)."""
    return changes.groupBy("key").agg(
        F.min(F.when(F.col("kind").isin(*INSERT_KINDS), F.col("seq"))).alias("first_insert"))


def dispositions(changes: DataFrame, stats: DataFrame | None = None, *keep: str) -> DataFrame:
    """Outcome of every change (J1): inserts ``upserted``; patches ``ok`` when
    a row existed before them, ``not_found`` otherwise, ``skipped`` when empty.

    ``stats`` (``key_stats`` of the whole log) lets a caller judge a slice of
    the log; by default it comes from ``changes`` itself. The per-key table
    has one small row per key; AQE broadcasts it when its measured size is
    under the threshold, else sort-merge joins with skew splitting for hot
    keys.
    """
    stats = key_stats(changes) if stats is None else stats
    j = changes.join(stats, "key", "left")
    seq = F.col("seq")
    disp = (F.when(F.col("kind") != F.lit(PATCH), F.lit("upserted"))
            .when(F.size("fields") == 0, F.lit("skipped"))
            .when(F.col("first_insert").isNotNull() & (seq > F.col("first_insert")), F.lit("ok"))
            .otherwise(F.lit("not_found")))
    return j.select("key", "seq", "kind", disp.alias("disposition"), *keep)


def not_found_keys(patches: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """Distinct patch keys with no current row (J2): a left-anti join."""
    return (patches.select(F.col(key)).distinct()
            .join(current.select(F.col(key)), key, "left_anti"))
