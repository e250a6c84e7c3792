"""Row selections as bitmaps over the row number.

A selection is a table ``selection, bucket, bits``: one bitmap of 4 KB for each 32,768
row numbers it has rows in. Selections are united, intersected and counted
on their bitmaps; no key is shuffled. The row number is unique (``row_seq``); rows
without one are in no selection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768


def selection_bitmaps(df: DataFrame, row_col: str, selections: Mapping[str, Column]) -> DataFrame:
    """The bitmaps of several named predicates, from one scan."""
    n = F.col(row_col)
    hits = F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in selections.items()]), lambda x: x.isNotNull())
    each = df.filter(n.isNotNull()).select(
        F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("pos"), F.explode(hits).alias("selection"))
    return each.groupBy("selection", "bucket").agg(F.bitmap_construct_agg("pos").alias("bits"))


def united(bitmaps: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Rows in any of the named selections, as a selection ``label``."""
    some = bitmaps.filter(F.col("selection").isin(*names)).groupBy("bucket")
    return some.agg(F.bitmap_or_agg("bits").alias("bits")).select(F.lit(label).alias("selection"), "bucket", "bits")


def common(bitmaps: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Rows in all the named selections, as a selection ``label``."""
    per = bitmaps.filter(F.col("selection").isin(*names)).groupBy("bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    whole = per.filter(F.col("n") == len(set(names)))  # a bucket that one of them lacks has no common row
    return whole.select(F.lit(label).alias("selection"), "bucket", "bits")


def row_counts(bitmaps: DataFrame) -> DataFrame:
    """``selection, row_count``; a selection without a row has no bitmap and no line here."""
    return bitmaps.groupBy("selection").agg(F.sum(F.bitmap_count("bits")).alias("row_count"))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def selected_rows(df: DataFrame, row_col: str, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``df`` in one selection: joined by bucket, then by their bit. A bucket
    has at most 32,768 rows, so no bucket is hot; a selection whose measured size is small
    is broadcast at run time, and then ``df`` is not shuffled at all."""
    one = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    n = F.col(row_col)
    pos = F.bitmap_bit_position(n).cast("int")
    held = F.getbit(_byte(F.col("__bits"), F.floor(pos / 8).cast("int")), pos % 8) == 1
    return df.join(one, F.bitmap_bucket_number(n) == F.col("__bucket")).filter(held).drop("__bucket", "__bits")


def row_numbers(bitmaps: DataFrame) -> DataFrame:
    """``selection, row_number`` of every row: the bitmaps taken apart."""
    octets = bitmaps.select("selection", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS // 8 - 1))).alias("at"))
    some = octets.select("selection", "bucket", "at", _byte(F.col("bits"), F.col("at")).alias("v")).filter("v <> 0")
    bit = some.select("selection", "bucket", "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    pos, b = F.col("at") * 8 + F.col("b"), F.col("bucket")
    # Positive numbers count up from bucket 1, the others down from bucket 0.
    number = F.when(b > 0, (b - 1) * BITS + pos + 1).otherwise(b * BITS - pos)
    return bit.filter(F.getbit("v", F.col("b")) == 1).select("selection", number.cast("bigint").alias("row_number"))
