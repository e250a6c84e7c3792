"""What changed between two published versions of a table.

Rows are compared by the fingerprint of their columns, so a change that left a row as it
was is no change. The first step moves keys and fingerprints only; values are
fetched afterwards, for the keys whose row differs.

Each version holds one row per key, as the fold gives it; a key that is null is a key
like any other. An empty version makes every row inserted or deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import canonical_key

INSERTED, UPDATED, UNCHANGED, DELETED = "inserted", "updated", "unchanged", "deleted"


def row_fingerprint(columns: Sequence[str]) -> Column:
    """Digest of the named columns as text; null and '' differ, the columns' order does not matter."""
    cells = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return F.sha2(canonical_key(cells), 256)


def version_changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, change`` for every key of either version."""
    fp, none = row_fingerprint(columns), F.lit(None).cast("string")
    both = (old.select(key, fp.alias("was"), none.alias("now"))
            .unionByName(new.select(key, none.alias("was"), fp.alias("now"))))
    per = both.groupBy(key).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    change = (F.when(F.col("was").isNull(), INSERTED).when(F.col("now").isNull(), DELETED)
              .when(F.col("was") == F.col("now"), UNCHANGED).otherwise(UPDATED))
    return per.select(key, change.alias("change"))


def change_feed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, change`` and the new values of every row that differs; a deleted row's are null."""
    kinds = version_changes(old, new, key, columns).filter(F.col("change") != UNCHANGED)
    n, k = new.select(key, *columns).alias("n"), kinds.alias("k")
    joined = k.join(n, F.col(f"k.{key}").eqNullSafe(F.col(f"n.{key}")), "left")
    return joined.select(F.col(f"k.{key}").alias(key), "change", *[F.col(f"n.{c}").alias(c) for c in columns])
