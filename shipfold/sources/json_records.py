"""One large JSON array file read by many tasks (S3).

An array file may be a single line, so it is cut at every ``}`` instead. A piece's
meaning depends on what stands before it: whether it begins inside a string and how
deep it is nested. Both add up: quotes turn the one over, brackets outside strings move
the other. So each split reports its quote parity and its change of depth for both
start states; a window over the splits of each file gives every split its start, and a
running sum inside the split gives every piece its own. A piece that brings the depth
back to one ends an element of the array. Elements of one piece pass straight on; others
are put together per element. Positions are those of the whole array.

A file that is not one array of objects is refused whole, as a request body is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipfold.operators.joins import join_checked
from shipfold.session import partition_count, scratch_dir
from shipfold.sources.json import MALFORMED, parse_row_array


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _steps(value: Column) -> tuple[Column, Column, Column]:
    """(odd number of quotes?, change of depth if it begins outside, inside a string) of a
    piece and the brace that ends it."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")  # backslashes only stand in strings
    parts = F.split(plain, '"', -1)
    odd = F.size(parts) % 2 == 0

    def moved(first: int, closes: Column) -> Column:
        text = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
        up = _count(text, "{") + _count(text, "[")
        return up - _count(text, "]") - closes.cast("int")

    return odd, moved(0, ~odd), moved(1, odd)


def read_json_arrays(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """``(rows, refused)``: ``file_path, pos, fields`` of every object, and
    ``file_path, reason`` of every file that is no array of objects."""
    pieces = spark.read.option("lineSep", "}").text(paths)
    bound = partition_count(pieces)
    odd, outside, inside = _steps(F.col("value"))
    by = Window.partitionBy("file_path", "block").orderBy("line")
    before, so_far = (by.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    pieces = pieces.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", odd.alias("odd"), outside.alias("outside"), inside.alias("inside"))
    pieces = pieces.withColumn("turned", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    depth = lambda turned: F.sum(F.when(turned, F.col("inside")).otherwise(F.col("outside"))).over(so_far)
    pieces = _written(pieces.withColumn("depth_out", depth(F.col("turned"))).withColumn("depth_in", depth(~F.col("turned"))),
                      "json_pieces")

    splits = pieces.groupBy("file_path", "block").agg(
        F.max("line").alias("last"), (F.count_if("odd") % 2).alias("odd"), F.max_by("depth_out", "line").alias("depth_out"),
        F.max_by("depth_in", "line").alias("depth_in"))
    by_file = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    splits = (splits.withColumn("enters", F.coalesce(F.sum("odd").over(by_file), F.lit(0)) % 2 == 1)
              .withColumn("depth", F.when(F.col("enters"), F.col("depth_in")).otherwise(F.col("depth_out")))
              .withColumn("depth", F.coalesce(F.sum("depth").over(by_file), F.lit(0)))
              .withColumn("last", F.when(F.col("block") == F.max("block").over(whole), F.col("last")))
              .select("file_path", "block", "enters", F.col("depth").alias("start"), "last"))
    splits = _written(splits, "json_splits")

    placed = join_checked(pieces, splits, ["file_path", "block"], row_bound=bound)
    begins_in = F.col("turned") != F.col("enters")
    ends_in = begins_in != F.col("odd")
    depth = F.col("start") + F.when(F.col("enters"), F.col("depth_in")).otherwise(F.col("depth_out"))
    placed = placed.select("file_path", "block", "line", "value", begins_in.alias("begins_in"), ends_in.alias("ends_in"),
                           depth.alias("depth"), F.when(begins_in, F.col("inside")).otherwise(F.col("outside")).alias("step"),
                           F.coalesce(F.col("line") == F.col("last"), F.lit(False)).alias("tail"))
    placed = placed.withColumn("ends", ~F.col("ends_in") & (F.col("depth") == 1) & ~F.col("tail"))
    placed = _written(placed.withColumn("n", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0))), "json_placed")
    firsts = (placed.groupBy("file_path", "block").agg(F.count_if("ends").alias("n"))
              .withColumn("first", F.coalesce(F.sum("n").over(by_file), F.lit(0))).drop("n"))
    placed = join_checked(placed, firsts, ["file_path", "block"], row_bound=bound).withColumn("pos", F.col("first") + F.col("n"))

    # The rest of a file after its last object: the end of the array, and nothing open.
    closed = ~F.col("ends_in") & (F.col("depth") == -1)  # the brace that a tail lacks counts as one less
    shape = F.when(F.col("pos") == 0, F.col("value").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("value").rlike(r"^\s*\]\s*$"))
    bad_ends = placed.filter(F.col("tail") & ~(closed & shape)).select("file_path")

    body = placed.filter(~F.col("tail"))
    starts = ~F.col("begins_in") & (F.col("depth") - F.col("step") <= 1)
    alone = body.filter(starts & F.col("ends")).select("file_path", "pos", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = (body.filter(~(starts & F.col("ends"))).join(bad_ends, "file_path", "left_anti").groupBy("file_path", "pos")
              .agg(F.array_join(parts["value"], "}").alias("value")))
    mark = F.when(F.col("pos") == 0, r"^\s*\[").otherwise(r"^\s*,")
    text = F.when(F.regexp_like("value", mark), F.concat(F.lit("["), F.regexp_replace("value", r"^\s*[\[,]", ""), F.lit("}]")))
    rows = _written(alone.unionByName(joined).select("file_path", "pos", parse_row_array(text).alias("parsed")), "json_rows")
    good = (F.size("parsed") == 1) & F.col("parsed")[0].isNotNull()
    refused = bad_ends.unionByName(rows.filter(~F.coalesce(good, F.lit(False))).select("file_path")).distinct()
    refused = _written(refused, "json_refused")
    fine = rows.join(refused, "file_path", "left_anti").select("file_path", "pos", F.col("parsed")[0].alias("fields"))
    return fine, refused.withColumn("reason", F.lit(MALFORMED))
