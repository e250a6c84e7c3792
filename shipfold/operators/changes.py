"""The append-only change log and its builders.

A change row is::

    key STRING, seq <orderable>, kind STRING, fields MAP<STRING,STRING>,
    ts TIMESTAMP_NTZ

``kind`` is ``replace`` (seed / insert-or-replace), ``upsert`` (upload, bulk)
or ``patch`` (write-back). ``fields`` holds only the columns the change
carries: an absent key means "untouched", a present NULL value means "set to
NULL". ``seq`` is a total order over the log (source batch, then position).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import (ColumnLike, _c, is_missing_key, strip,
                                     token_clean_bulk)
from shipfold.operators.normalise import literal_map, patch_fields
from shipfold.profiles import TableProfile

REPLACE, UPSERT, PATCH = "replace", "upsert", "patch"
CHANGE_COLUMNS = ("key", "seq", "kind", "fields", "ts")


def _with_defaults(fields: Column, defaults: Mapping[str, str]) -> Column:
    """Add each default whose key the change does not carry (a present NULL
    stays NULL)."""
    for k, v in defaults.items():
        fields = F.when(F.map_contains_key(fields, F.lit(k)), fields).otherwise(
            F.map_concat(fields, literal_map({k: v})))
    return fields


def change_frame(df: DataFrame, key: ColumnLike, seq: ColumnLike, kind: ColumnLike,
                 fields: ColumnLike, ts: ColumnLike, *extra: str) -> DataFrame:
    return df.select(_c(key).cast("string").alias("key"), _c(seq).alias("seq"),
                     _c(kind).alias("kind"), _c(fields).alias("fields"),
                     _c(ts).cast("timestamp_ntz").alias("ts"), *extra)


def upload_changes(rows: DataFrame, profile: TableProfile, seq: ColumnLike,
                   ts: ColumnLike, apply_defaults: bool = True) -> tuple[DataFrame, DataFrame]:
    """File-upload rows (``fields`` map, NULL cells already absent) to upserts.

    The key is stripped and must not be blank/'nan'/'None' (F9); values other
    than the key are kept as read. Returns ``(changes, rejected)``.
    """
    k = F.element_at("fields", F.lit(profile.key))
    keyed = rows.withColumn("_missing", is_missing_key(k))
    good = keyed.filter(~F.col("_missing"))
    fields = F.map_concat(
        F.map_filter("fields", lambda a, b: a != F.lit(profile.key)),
        F.create_map(F.lit(profile.key), strip(k)))
    if apply_defaults and profile.upsert_defaults:
        fields = _with_defaults(fields, profile.upsert_defaults)
    changes = change_frame(good, strip(k), seq, F.lit(UPSERT), fields, ts)
    rejected = keyed.filter(F.col("_missing")).drop("_missing")
    return changes, rejected


def bulk_changes(rows: DataFrame, profile: TableProfile, seq: ColumnLike, ts: ColumnLike,
                 apply_defaults: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bulk JSON rows (``fields`` map of every given key) to upserts.

    Every given key is kept and its value stripped; '', 'nan', 'None' become
    NULL, so a blank in bulk *does* overwrite with NULL (F10). Returns
    ``(changes, rejected)``; rejected rows have a missing key.
    """
    k = strip(F.coalesce(F.element_at("fields", F.lit(profile.key)), F.lit("")))
    keyed = rows.withColumn("_missing", k.isin("", "nan", "None"))
    good = keyed.filter(~F.col("_missing"))
    cleaned = F.transform_values("fields", lambda _, v: token_clean_bulk(v))
    fields = F.map_concat(F.map_filter(cleaned, lambda a, b: a != F.lit(profile.key)),
                          F.create_map(F.lit(profile.key), k))
    if apply_defaults and profile.upsert_defaults:
        fields = _with_defaults(fields, profile.upsert_defaults)
    changes = change_frame(good, k, seq, F.lit(UPSERT), fields, ts)
    rejected = keyed.filter(F.col("_missing")).drop("_missing")
    return changes, rejected


def patch_changes(rows: DataFrame, key: ColumnLike, payload: ColumnLike, seq: ColumnLike,
                  ts: ColumnLike) -> DataFrame:
    """Write-back payloads to patches; NULL fields are dropped (P10). An empty
    patch stays in the log and is reported as ``skipped``."""
    return change_frame(rows, key, seq, F.lit(PATCH), patch_fields(payload), ts)


def seed_changes(rows: DataFrame, key: ColumnLike, payload: ColumnLike,
                 mapping: Mapping[str, str], seq: ColumnLike, ts: ColumnLike,
                 defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Seed rows to replaces: source key -> column, missing -> '' (P6, S12)."""
    p = _c(payload)
    pairs = []
    for src, dst in mapping.items():
        pairs += [F.lit(dst), F.coalesce(F.try_element_at(p, F.lit(src)), F.lit(""))]
    fields = F.create_map(*pairs)
    if defaults:
        fields = F.map_concat(fields, literal_map(defaults))
    keyed = rows.withColumn("_k", F.coalesce(F.try_element_at(p, F.lit(_dst_src(mapping, key))), F.lit("")))
    return change_frame(keyed.filter(F.col("_k") != ""), F.col("_k"), seq, F.lit(REPLACE), fields, ts)


def _dst_src(mapping: Mapping[str, str], key) -> str:
    for src, dst in mapping.items():
        if dst == key:
            return src
    return key


def table_spelling(fields: ColumnLike, profile: TableProfile) -> Column:
    """Field names folded to the table's spelling: names are SQL identifiers,
    which match without case. A name given in two spellings keeps its last value."""
    from shipfold.sources.json import last_entries
    names = literal_map({c.lower(): c for c in profile.columns})
    folded = F.transform(F.map_entries(_c(fields)), lambda e: F.struct(
        F.coalesce(F.try_element_at(names, F.lower(e["key"])), e["key"]).alias("key"), e["value"].alias("value")))
    return F.transform(F.array(folded), last_entries)[0]


def unknown_column_split(changes: DataFrame, profile: TableProfile,
                         extra_known: tuple[str, ...] = ("last_updated", "id")) -> tuple[DataFrame, DataFrame]:
    """A change naming a column the table lacks fails alone (F13):
    ``(valid, errors)``; errors carry the sorted unknown names as the reason.
    Names match without case, and valid changes carry the table's spelling."""
    known = F.array(*[F.lit(c.lower()) for c in sorted(set(profile.columns) | set(extra_known))])
    bad = F.array_sort(F.filter(F.map_keys("fields"), lambda k: ~F.array_contains(known, F.lower(k))))
    tagged = changes.withColumn("unknown", bad)
    valid = tagged.filter(F.size("unknown") == 0).drop("unknown").withColumn("fields", table_spelling("fields", profile))
    errors = tagged.filter(F.size("unknown") > 0).withColumn(
        "error", F.concat(F.lit("no such column: "), F.array_join("unknown", ", ")))
    return valid, errors


# Spark's increasing row id is ``partition << 33 | row in partition``.
_ROW_ID_BITS = 33


def dense_positions(df: DataFrame, name: str = "_pos") -> DataFrame:
    """``df`` written once, with ``name``: dense row positions from 0 in partition order, then
    row order.

    Spark's increasing id keeps that order but is sparse: with many partitions it would
    outgrow the position bits of a batch ``seq``. Rows per partition (one small row
    each), a running sum over them and each row's offset inside its partition give the
    dense one. The ids are written first, so that they are the same in both reads.
    """
    from pyspark.sql import Window

    from shipfold.operators.joins import join_checked
    from shipfold.session import scratch_dir

    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "positions")
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    tagged.write.parquet(path)
    tagged = spark.read.schema(tagged.schema).parquet(path).withColumn("_part", F.shiftright("_mid", _ROW_ID_BITS))
    counts = tagged.groupBy("_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row of three longs per partition.
    j = join_checked(tagged, offsets, "_part", row_bytes=64)
    return j.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_mid", "_part", "_off", "_first")
