"""Records of CSV files whose quoted cells may span lines, read in splits.

A file's lines say nothing alone about where its records end: that depends on whether
the line begins inside a quoted cell. So each line is first reduced to two facts, whether
it ends inside a cell if it began outside one, and if it began inside one. Within a run of
a split's lines (at most ``2 ** RUN_BITS``) a running window composes them; each run then
reports its end state and its number of records under both start states. A second, small
window over the runs of each file picks the true start states and gives every run its
first record's number.
Joined back, every line knows its record. Lines that are whole records pass straight on;
the others are put together per record, so no file is ever one task.

A file that ends inside a quoted cell is refused whole before any of its lines are put
together.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipfold.operators.joins import join_checked
from shipfold.session import scratch_dir

# Reader options that shape how one line parses; they are handed to
# ``from_csv`` too, so a header line parses exactly as the reader parses it.
READ_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}

RUN_BITS = 16  # a run of lines is this many bits of a line's number

# Lines the reader skips: empty after trimming every character up to U+0020.
BLANK = "^[\\x00-\\x20]*$"

# FIXED VALUES: encodings whose line ends are the bytes of ASCII, so that files can be cut there.
_CUT_CHARSETS = {"utf8": None, "usascii": None, "iso88591": "ISO-8859-1", "latin1": "ISO-8859-1"}


def record_shape(text: Column, options: dict | None = None) -> Column:
    """``struct(cells, open)`` of a record's text: how many cells it has, and
    whether it ends inside a quoted cell.

    A quote opens a cell only at its start; elsewhere it is plain text. The text
    is cut at its quotes, and one walk over the pieces counts the separators
    outside quoted cells. Text without a quote is only counted."""
    options = options or {}
    opts = {**READ_OPTIONS, **options}
    sep, quote, escape = opts.get("sep", opts.get("delimiter", ",")), opts["quote"], opts["escape"]
    seps = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))) / len(sep)).cast("int")
    plain = F.struct((seps(text) + 1).alias("cells"), F.lit(False).alias("open"))
    if not quote:
        return plain
    if escape and escape != quote:
        text = F.replace(text, F.lit(escape + quote), F.lit(""))
    pieces = F.split(text, re.escape(quote), -1)
    ends = lambda c: F.endswith(c, F.lit(sep))

    def step(acc, piece):
        opens = ~acc["open"] & acc["start"]
        return F.struct(
            (acc["cells"] + F.when(opens, F.lit(0)).otherwise(seps(piece))).alias("cells"), opens.alias("open"),
            # Right after a closing quote another quote opens again: a doubled quote.
            (~opens & (ends(piece) | (acc["open"] & (piece == "")))).alias("start"))

    first = pieces[0]
    walked = F.aggregate(
        F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
        F.struct((seps(first) + 1).alias("cells"), F.lit(False).alias("open"),
                 ((first == "") | ends(first)).alias("start")), step)
    return F.when(F.contains(text, F.lit(quote)), F.struct(walked["cells"].alias("cells"), walked["open"].alias("open"))
                  ).otherwise(plain)


def charset(options: dict) -> str:
    name = str(options.get("encoding", options.get("charset", "utf-8"))).lower()
    return re.sub("[-_ ]", "", name)


def _lines(spark: SparkSession, paths: Sequence[str], options: dict) -> DataFrame:
    """``file_path, block, line, value``: text between line feeds, a carriage return kept."""
    known = charset(options)
    if known not in _CUT_CHARSETS:
        raise ValueError(f"files in {known} cannot be read in splits; accepted: {', '.join(sorted(_CUT_CHARSETS))}")
    value = F.col("value")
    if _CUT_CHARSETS[known]:
        value = F.decode(value.cast("binary"), _CUT_CHARSETS[known])
    text = (spark.read.option("pathGlobFilter", "*.csv").option("lineSep", options.get("lineSep", "\n"))
            .text(list(paths)))
    return text.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("line"), value.alias("value"))


def _ends(value: Column, options: dict) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it began (outside, inside) one."""
    quote = options.get("quote", READ_OPTIONS["quote"])
    if not quote:
        return F.lit(False), F.lit(False)
    has = F.contains(value, F.lit(quote))
    outside = has & record_shape(value, options)["open"]
    if options.get("comment"):  # a comment line's quotes open nothing
        outside = outside & ~F.startswith(value, F.lit(options["comment"]))
    return outside, ~has | record_shape(F.concat(F.lit(quote), value), options)["open"]


def _running(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``fixed`` and ``odd``: the state before a row is ``fixed``, or if null the
    start state, turned over if ``odd``. Rows have ``out`` and ``in``, their end states
    after beginning outside and inside."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("out") & ~F.col("in")
    df = (df.withColumn("sets", F.when(F.col("out") == F.col("in"), F.col("out"))).withColumn("turns", turns.cast("int"))
          .withColumn("turned", F.sum("turns").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    since = F.coalesce(F.last(F.when(F.col("sets").isNotNull(), F.col("turned")), ignorenulls=True).over(before), F.lit(0))
    return (df.withColumn("fixed", F.last("sets", ignorenulls=True).over(before))
            .withColumn("odd", F.pmod(F.col("turned") - F.col("turns") - since, F.lit(2)) == 1).drop("turns", "turned", "sets"))


def _before(start: Column) -> Column:
    return F.coalesce("fixed", start) != F.col("odd")


def _after(start: Column) -> Column:
    return F.when(_before(start), F.col("in")).otherwise(F.col("out"))


def read_records(spark: SparkSession, paths: Sequence[str], options: dict) -> tuple[DataFrame, DataFrame]:
    """``(records, files)``: ``file_path, record, text`` of every record that is not blank,
    numbered from 0 in each file, and ``file_path, unclosed`` of every file with a line. Both written."""
    lines = _lines(spark, paths, options)
    outside, inside = _ends(F.col("value"), options)
    blank = F.col("value").rlike(BLANK)
    if options.get("comment"):
        blank = blank | F.startswith("value", F.lit(options["comment"]))
    # A window's group is a run of a split's lines, so that groups are small and spread evenly over tasks.
    lines = lines.withColumn("run", F.shiftright("line", RUN_BITS))
    marked = _running(lines.withColumn("out", outside).withColumn("in", inside).withColumn("blank", blank), ["file_path", "block", "run"], "line")
    so_far = Window.partitionBy("file_path", "block", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    starts = lambda state: F.sum((~_before(F.lit(state)) & ~F.col("blank")).cast("long")).over(so_far)
    path = scratch_dir(spark, "csv_lines")
    marked.withColumn("n_out", starts(False)).withColumn("n_in", starts(True)).write.parquet(path)
    marked = spark.read.parquet(path)

    run = ["file_path", "block", "run"]
    splits = marked.groupBy(*run).agg(
        F.max_by(_after(F.lit(False)), "line").alias("out"), F.max_by(_after(F.lit(True)), "line").alias("in"),
        F.max("n_out").alias("n_out"), F.max("n_in").alias("n_in")).withColumn("place", F.struct("block", "run"))
    by_file = Window.partitionBy("file_path").orderBy("place")
    whole = Window.partitionBy("file_path")
    splits = (_running(splits, ["file_path"], "place").withColumn("enters", _before(F.lit(False)))
              .withColumn("ends", _after(F.lit(False)))
              .withColumn("n", F.when(F.col("enters"), F.col("n_in")).otherwise(F.col("n_out")))
              .withColumn("first", F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("unclosed", F.max_by("ends", "place").over(whole))
              .select(*run, "enters", "first", "unclosed"))
    path = scratch_dir(spark, "csv_splits")
    splits.write.parquet(path)
    splits = spark.read.parquet(path)

    placed = join_checked(marked, splits, run).filter(~F.col("unclosed"))
    state, after = _before(F.col("enters")), _after(F.col("enters"))
    number = F.col("first") + F.when(F.col("enters"), F.col("n_in")).otherwise(F.col("n_out")) - 1
    placed = (placed.filter(state | ~F.col("blank"))
              .select("file_path", "block", "line", number.alias("record"), state.alias("goes_on"), after.alias("open"),
                      F.when(after, F.col("value")).otherwise(F.regexp_replace("value", "\\r$", "")).alias("text")))
    alone = placed.filter(~F.col("goes_on") & ~F.col("open")).select("file_path", "record", "text")
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    joined = (placed.filter(F.col("goes_on") | F.col("open")).groupBy("file_path", "record")
              .agg(F.array_join(pieces["text"], options.get("lineSep", "\n")).alias("text")))
    path = scratch_dir(spark, "csv_records")
    alone.unionByName(joined).write.parquet(path)
    return spark.read.parquet(path), splits.select("file_path", "unclosed").distinct()
