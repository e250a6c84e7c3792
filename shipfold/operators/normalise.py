"""Header and value normalisation.

Alias maps are small, fixed metadata: they are inlined as literal map
expressions (``create_map``), so no join and no broadcast is needed to apply
them, and their size never grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import (ColumnLike, _c, blank_default, lower_strip,
                                     token_clean_scrape)
from shipfold.profiles import TableProfile


def literal_map(mapping: Mapping[str, str | None]) -> Column:
    """A ``map<string,string>`` literal built from a fixed dict."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    args = []
    for k, v in mapping.items():
        args += [F.lit(k), F.lit(v).cast("string")]
    return F.create_map(*args)


def header_normalise(c: ColumnLike) -> Column:
    """``norm_header``: lower case and strip."""
    return lower_strip(c)


def header_targets(headers: ColumnLike, aliases: Mapping[str, str]) -> Column:
    """For an array of raw header cells, the target column per position.

    A raw header repeated later in the row is renamed by the reader (``M#`` ->
    ``M#.1``) and so no longer matches an alias: only its first occurrence
    maps. Unknown headers give NULL (dropped).
    """
    h = _c(headers)
    amap = literal_map(aliases)
    return F.transform(h, lambda x, i: F.when(
        F.array_position(F.slice(h, F.lit(1), i), x) > 0, F.lit(None).cast("string")
    ).otherwise(F.element_at(amap, lower_strip(x))))


def header_keep(targets: ColumnLike) -> Column:
    """Per position: true when no later position has the same target, so two
    aliases of one column resolve to the last one (P2)."""
    t = _c(targets)
    return F.transform(t, lambda x, i: x.isNotNull() & ~F.exists(
        F.slice(t, i + 2, F.greatest(F.size(t), F.lit(1))), lambda y: y.eqNullSafe(x)))


def cells_to_fields(targets: ColumnLike, keep: ColumnLike, cells: ColumnLike) -> Column:
    """Zip header targets with a row's cells into a field map. Only kept
    positions with a non-NULL value enter the map: a blank cell leaves the
    column absent, so an upload never overwrites with a blank (P2, P8)."""
    z = F.arrays_zip(_c(targets).alias("t"), _c(keep).alias("k"), _c(cells).alias("v"))
    kept = F.filter(z, lambda e: e["k"] & e["v"].isNotNull())
    return F.map_from_arrays(F.transform(kept, lambda e: e["t"]),
                             F.transform(kept, lambda e: e["v"]))


def alias_rename(df: DataFrame, profile: TableProfile) -> DataFrame:
    """Rename a wide DataFrame's columns through the alias map and drop unknown
    columns (P2). Headers are known on the driver here (schema metadata)."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        target = profile.aliases.get(c.lower().strip())
        if target:
            chosen[target] = c  # last one wins
    return df.select(*[F.col(f"`{src}`").alias(t) for t, src in chosen.items()])


def require_column(df: DataFrame, column: str) -> None:
    """Fail before any job when the key column is absent (P5)."""
    if column not in df.columns:
        raise ValueError(f"could not find a {column!r} column in the input")


def label_map(cells: DataFrame, aliases: Mapping[str, str], key: str,
              row_cols: Sequence[str] = ("page_id", "row_no")) -> DataFrame:
    """Long scraped cells ``(row..., col_no, label, value)`` to one field map
    per row (P3): label -> column through the alias map, value stripped,
    values ``'' nan none -`` (any case) dropped, rows without a key dropped.

    A label seen twice in a row keeps its last cell (even when blank); then
    blanks drop out and, per column, the label that first appears last wins.

    Skew-safe: cells are first reduced per (row, label) with a partial
    aggregate, so the per-row collect holds at most one entry per alias
    label, however many cells a row has.
    """
    amap = literal_map(aliases)
    mapped = cells.select(
        *row_cols, "col_no", "label",
        F.element_at(amap, lower_strip("label")).alias("column"),
        token_clean_scrape("value").alias("value"),
    ).filter(F.col("column").isNotNull())
    per_label = mapped.groupBy(*row_cols, "label").agg(
        F.min("col_no").alias("first"), F.max(F.struct("col_no", "column", "value")).alias("c"))
    per_label = per_label.withColumn("c", F.struct("first", "c.column", "c.value"))
    grouped = (per_label.filter(F.col("c.value").isNotNull())
               .groupBy(*row_cols).agg(F.array_sort(F.collect_list("c")).alias("cells")))
    cells_col = F.col("cells")
    last = F.filter(cells_col, lambda e, i: ~F.exists(
        F.slice(cells_col, i + 2, F.greatest(F.size(cells_col), F.lit(1))),
        lambda y: y["column"].eqNullSafe(e["column"])))
    rows = grouped.select(*row_cols, F.map_from_arrays(
        F.transform(last, lambda e: e["column"]),
        F.transform(last, lambda e: e["value"])).alias("fields"))
    return rows.filter(F.element_at("fields", F.lit(key)).isNotNull())


def unmapped_labels(cells: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Distinct labels without an alias, sorted."""
    amap = literal_map(aliases)
    return (cells.filter(F.element_at(amap, lower_strip("label")).isNull())
            .select(F.col("label")).distinct().orderBy("label"))


def rename_default(m: ColumnLike, mapping: Mapping[str, str]) -> list[Column]:
    """``{db: row.get(js, '')}``: source key -> column, missing -> '' (P6)."""
    return [F.coalesce(F.try_element_at(_c(m), F.lit(src)), F.lit("")).alias(dst)
            for src, dst in mapping.items()]


def view_rows(df: DataFrame, keys: Mapping[str, str], defaults: Mapping[str, str]) -> DataFrame:
    """Rows under their view names (P7): each column that ``keys`` (view name -> column) names,
    null or blank as the column's default, else ''. A column that the rows lack is blank."""
    has = set(df.columns)
    return df.select(*[(blank_default(c, defaults.get(c, "")) if c in has else F.lit(defaults.get(c, ""))).alias(name)
                       for name, c in keys.items()])


def view_defaults(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, str]) -> DataFrame:
    """Null or blank -> the column's default, else '' (P7)."""
    return df.select(*[blank_default(c, defaults.get(c, "")).alias(c) for c in columns])


def patch_fields(m: ColumnLike) -> Column:
    """Keep only non-NULL fields of a patch payload (P10)."""
    return F.map_filter(_c(m), lambda k, v: v.isNotNull())


def changed_columns(m: ColumnLike, stamped: Sequence[str] = ("last_updated",)) -> Column:
    """Sorted names a change sets, plus the stamped columns."""
    extra = F.array(*[F.lit(s) for s in stamped]) if stamped else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.map_keys(_c(m)), extra)))


def update_type_column(update_type: ColumnLike, mapping: Mapping[str, str | None]) -> Column:
    """Update type -> target column; NULL for refused or unknown types."""
    return F.element_at(literal_map(mapping), _c(update_type))
