"""CSV uploads read as all-string cells.

Each file carries its own header row, so files with different layouts are read
in one job: Spark's reader is run with ``header=False`` and an all-string
schema, and the mapping from header cells to columns is done by expressions.

A text pass gives one row per file: its header line, the cells of its widest
line, and whether a quoted cell runs on past a line's end. All files are read in
splits: by the CSV reader, or, where a cell does, as records put together by
their quotes (``csv_records``), with the text inside cells byte for byte. A file
with a row wider than its header, without the key column, without any line but
blank ones, or that ends inside a quoted cell, is refused whole with a reason.

Line numbers are exact per file: rows are counted per split, a prefix sum
over the (small) split table gives each split's first line, and a row's line
is that plus its position inside the split. The same sum over all splits
gives ``row_index``, dense over the whole upload in (file, line) order;
``seq`` is derived from it, so the change log keeps the files' row order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipfold.operators.joins import join_checked
from shipfold.operators.normalise import cells_to_fields, header_keep, header_targets
from shipfold.profiles import TableProfile
from shipfold.sources.csv_records import BLANK, READ_OPTIONS, charset, read_records, record_shape
from shipfold.session import partition_count, scratch_dir

# FIXED VALUES: cell texts a CSV upload treats as missing (the default NA
# tokens of the common Python CSV reader), compared exactly.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# FIXED VALUES: accepted upload file extensions.
UPLOAD_EXTENSIONS = (".xlsx", ".xls", ".csv")

# Why a file is refused whole.
WIDER_ROW = "a row is wider than the header"
NO_KEY_COLUMN = "no key column"
UNCLOSED = "a quoted cell is never closed"
EMPTY = "no header line"


def accepted_path(path: str) -> bool:
    """File-type gate."""
    return path.endswith(UPLOAD_EXTENSIONS)


def _gate(paths: Sequence[str], ext: str) -> list[str]:
    """Files must carry the extension; anything else given is a folder,
    whose files are filtered by ``pathGlobFilter`` on the reader."""
    out = []
    for p in paths:
        name = p.rstrip("/").rsplit("/", 1)[-1]
        if "." in name and not name.endswith(ext):
            raise ValueError(f"only {', '.join(UPLOAD_EXTENSIONS)} files are accepted: {p}")
        out.append(p)
    return out


_PARSE_KEYS = ("sep", "delimiter", "quote", "escape", "charToEscapeQuoteEscaping", "comment",
               "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "nullValue", "emptyValue",
               "unescapedQuoteHandling", "maxCharsPerColumn")


def _text_ok(options: dict) -> bool:
    """Files can be looked at line by line first, unless the caller says that any
    record may span lines or the files are not UTF-8."""
    multi = str(options.get("multiLine", options.get("multiline", "false"))).lower() == "true"
    return not multi and charset(options) == "utf8"


def _reader_path(uri: str) -> str:
    """A file's URI as a reader path: unescaped, its glob characters taken literally."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(uri))


def _record_files(spark: SparkSession, paths: Sequence[str], options: dict) -> tuple[DataFrame, DataFrame]:
    """``(records, files)`` of files whose records may span lines; a file's row is
    ``file_path, line, cells, widest, unclosed``, with an empty line if it is not closed."""
    records, files = read_records(spark, paths, options)
    shaped = records.select("file_path", "record", "text", record_shape(F.col("text"), options)["cells"].alias("cells"))
    # Records are numbered from 0: the texts are not aggregated, which would sort them all.
    heads = shaped.filter(F.col("record") == 0).select("file_path", F.col("text").alias("line"), "cells")
    widest = shaped.groupBy("file_path").agg(F.max("cells").alias("widest"))
    # Files whose lines are all blank have no record and no row, as in the line by line pass.
    files = files.join(heads.join(widest, "file_path"), "file_path", "left").filter("unclosed OR line IS NOT NULL").select(
        "file_path", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("cells", F.lit(1)).alias("cells"),
        F.coalesce("widest", F.lit(1)).alias("widest"), "unclosed")
    return records, files


def file_table(spark: SparkSession, paths: Sequence[str], options: dict | None = None) -> tuple[DataFrame, list[str] | None]:
    """One row per file, ``file_path, line, cells, widest, spans``: the header line, its
    cells, the cells of the file's widest line and whether a cell spans lines. Also
    the paths of the files where one does (None: all files may, see ``_text_ok``); they
    go back to the reader, so they come to the driver like any list of inputs.

    The CSV reader skips lines that are empty after trimming every character
    up to U+0020 (and comment lines, if a comment prefix is set), so the header
    is the first line it does not skip. The table is written under the shared
    checkpoint folder, so the pass runs once."""
    options = options or {}
    out = scratch_dir(spark, "csv_files")
    reader = spark.read.option("pathGlobFilter", "*.csv")
    if "lineSep" in options:
        reader = reader.option("lineSep", options["lineSep"])
    kept = ~F.col("value").rlike(BLANK)
    if options.get("comment"):
        kept = kept & ~F.col("value").startswith(options["comment"])
    lines = reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("r"), "value")
    # The texts are not aggregated, which would sort them all: numbers alone are, and the header
    # lines are picked out by theirs from a second scan, which parses nothing.
    shaped = lines.filter(kept).select("file_path", "b", "r", record_shape(F.col("value"), options).alias("s"))
    files = shaped.groupBy("file_path").agg(
        F.min(F.when(F.col("b") == 0, F.col("r"))).alias("r"), F.max("s.cells").alias("widest"), F.bool_or("s.open").alias("spans"))
    numbers = scratch_dir(spark, "csv_files")
    files.write.parquet(numbers)
    files = spark.read.parquet(numbers)
    heads = join_checked(lines.filter(F.col("b") == 0).select("r", F.col("value").alias("line")),
                         files.filter("r IS NOT NULL").select("r", "file_path"), "r").select("file_path", "line")
    files = files.select("file_path", "widest", "spans").join(heads, "file_path", "left")
    files.withColumn("cells", record_shape(F.col("line"), options)["cells"]).write.parquet(out)
    files = spark.read.parquet(out)
    return files, [r[0] for r in files.filter("spans").select("file_path").collect()]


def header_width(files: DataFrame) -> int:
    """Cells of the widest header. One number to the driver."""
    return int(files.agg(F.max("cells")).first()[0] or 1)


def _parsed(text: str, width: int, options: dict) -> Column:
    """A record's text parsed by the reader's own CSV parser: a struct of ``width`` cells."""
    opts = {k: str(v) for k, v in {**READ_OPTIONS, **options}.items() if k in _PARSE_KEYS or k == "mode"}
    return F.from_csv(F.col(text), ", ".join(f"_c{i} STRING" for i in range(width)), opts)


def _parse_header(line: str, width: int, options: dict) -> Column:
    """A header line's cells, as ``raw_cells``."""
    h = _parsed(line, width, options)
    return F.array(*[F.coalesce(h[f"_c{i}"], F.lit("")) for i in range(width)])


def _reader(spark: SparkSession, width: int, options: dict):
    # Doubled quotes inside a quoted field are one quote, as uploads write them.
    reader = spark.read.option("header", False).option("pathGlobFilter", "*.csv")
    for k, v in {**READ_OPTIONS, **options}.items():
        reader = reader.option(k, v)
    return reader.schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)]))


def _cells(width: int, cell) -> list[Column]:
    """``cells`` (NA tokens as NULL) and ``raw_cells`` ('' for empty) of one record."""
    return [F.array(*[F.when(cell(i).isin(*NA_TOKENS), F.lit(None)).otherwise(cell(i)) for i in range(width)]).alias("cells"),
            F.array(*[F.coalesce(cell(i), F.lit("")) for i in range(width)]).alias("raw_cells")]


def _rows(raw: DataFrame, width: int) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("_rid"),
        *_cells(width, lambda i: F.col(f"_c{i}")),
    )


def _record_rows(records: DataFrame, width: int, options: dict) -> DataFrame:
    """Rows like ``_rows`` from whole records' texts, parsed by the reader's own parser."""
    parsed = records.select("file_path", F.col("record").alias("_rid"), _parsed("text", width, options).alias("p"))
    return parsed.select("file_path", F.lit(0).cast("bigint").alias("block_start"), "_rid",
                         *_cells(width, lambda i: F.col("p")[f"_c{i}"]))


def _scan(spark: SparkSession, paths: Sequence[str], options: dict) -> _Scan:
    """The raw scan, the per-split table and the table of files.

    Per split: first row id and row count, from a scan that parses no column.
    The data is parsed in full once, by the main scan. Files whose records span
    lines are read in splits too, as written records (``csv_records``)."""
    paths = _gate(list(paths), ".csv")
    fields = ["file_path", "line", "cells", "widest", "unclosed"]
    closed = F.lit(False).alias("unclosed")
    # The listing writes file:///x where the rows' metadata has file:/x.
    names = [re.sub("^([a-z0-9+.-]+):///", r"\1:/", n) for n in _reader(spark, 1, options).csv(paths).inputFiles()]
    if _text_ok(options):
        files, spanning = file_table(spark, paths, options)
        files = files.filter("NOT spans").select(*fields[:-1], closed)
        plain_paths = paths
        if spanning:
            plain_paths = [_reader_path(n) for n in names if n not in set(spanning)]
        record_paths = [_reader_path(n) for n in spanning]
    else:
        files, plain_paths, record_paths = None, [], paths
    records = None
    if record_paths:
        records, more = _record_files(spark, record_paths, options)
        out = scratch_dir(spark, "csv_files")
        (more if files is None else files.unionByName(more.select(*fields))).write.parquet(out)
        files = spark.read.parquet(out)
    width = header_width(files)
    base, n_parts = None, 0
    if plain_paths:
        split = _reader(spark, width, options).csv(plain_paths)
        base, n_parts = _rows(split, width), partition_count(split)
    if records is not None:
        spans = _record_rows(records, width, options)
        base = spans if base is None else base.unionByName(spans)
    per_split = base.groupBy("file_path", "block_start").agg(
        F.min("_rid").alias("_rid0"), F.count(F.lit(1)).alias("_n"))
    wide = F.when(F.col("widest") > F.col("cells"), F.concat(
        F.lit(WIDER_ROW), F.lit(" ("), F.col("widest").cast("string"), F.lit(" cells, header "),
        F.col("cells").cast("string"), F.lit(")")))
    why = F.coalesce(F.when(F.col("unclosed"), F.lit(UNCLOSED)), wide)
    headers = files.select("file_path", _parse_header("line", width, options).alias("_header"), why.alias("_refused"))
    # Planning facts bound the split table: splits <= files + scan partitions.
    split_bound = None if n_parts is None else len(names) + n_parts
    max_path = max((len(f.encode("utf-8")) for f in names), default=0)
    return _Scan(base, per_split, headers, names, split_bound, width, max_path)


class _Scan(NamedTuple):
    base: DataFrame
    per_split: DataFrame
    headers: DataFrame       # one row per file: header cells, why its rows are refused
    names: list[str]         # the files' paths, as planned
    split_bound: int | None   # rows of the split table, from planning facts
    width: int                # cells per row
    max_path: int             # bytes of the longest file path


# Bytes a row of a small table may take beyond its strings (fixed-width
# fields, offsets, row header), for the broadcast byte bound.
_ROW_OVERHEAD = 64
_CELL_OVERHEAD = 16


def _number_lines(base: DataFrame, per_split: DataFrame, split_bound: int | None,
                  max_path: int | None = None) -> DataFrame:
    # The split table is small and ordered without a partition key; it is
    # broadcast when its bound allows, so the data is never shuffled just to
    # number its lines.
    # Lines before a split in its file, and rows before it in the whole
    # upload (files in path order): ``line_no`` and a dense ``row_index``.
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1)
    before_all = Window.orderBy("file_path", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (per_split.select("file_path", "block_start", "_rid0", "_n")
              .withColumn("_first_line", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .withColumn("_first_row", F.coalesce(F.sum("_n").over(before_all), F.lit(0)))
              .withColumn("file_index", F.dense_rank().over(Window.orderBy("file_path")) - 1)
              .drop("_n"))
    # A split row is its path and five numbers.
    row_bytes = None if max_path is None else max_path + _ROW_OVERHEAD
    in_split = F.col("_rid") - F.col("_rid0")
    return (join_checked(base, splits, ["file_path", "block_start"], row_bound=split_bound,
                         row_bytes=row_bytes)
            .withColumn("line_no", F.col("_first_line") + in_split)
            .withColumn("row_index", F.col("_first_row") + in_split)
            .drop("_rid", "_rid0", "_first_line", "_first_row", "block_start"))


def read_csv_cells(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Raw cells of CSV files: ``file_path, cells, raw_cells, file_index,
    line_no, row_index``.

    ``cells`` is ``array<string>`` as wide as the widest header, with NA tokens
    as NULL; ``raw_cells`` keeps the text ('' for empty). Line 0 of each file is
    its header. Files are ordered by path (``file_index``); ``row_index`` numbers
    the rows of all files densely in (file, line) order. Files with a row wider
    than their own header are left out (``csv_upload`` names them).
    """
    sc = _scan(spark, paths, options)
    rows = _number_lines(sc.base, sc.per_split, sc.split_bound, sc.max_path)
    fine = sc.headers.filter(F.col("_refused").isNull()).select("file_path")
    return join_checked(rows, fine, "file_path", row_bound=len(sc.names), row_bytes=sc.max_path + _ROW_OVERHEAD)


def csv_upload(spark: SparkSession, paths: Sequence[str], profile: TableProfile,
               **options) -> tuple[DataFrame, DataFrame]:
    """``(rows, refused)`` of CSV files for a profile: upload rows ``file_path,
    file_index, line_no, row_index, fields, has_key_column, refused`` (see
    ``upload_rows_from_cells``), and one row ``file_path, reason`` per refused file.

    Three passes over the data in all, one of them a full parse: a text
    pass for the table of files, one aggregation per split that parses
    no column (line counts), then the main scan joined with the two small
    tables."""
    sc = _scan(spark, paths, options)
    # A header row is its path, one target name (or NULL) and one flag per cell, and a reason.
    longest = max((len(t.encode("utf-8")) for t in profile.aliases.values()), default=0)
    row_bytes = sc.max_path + 2 * _ROW_OVERHEAD + sc.width * (longest + _CELL_OVERHEAD)
    rows = upload_rows_from_cells(_number_lines(sc.base, sc.per_split, sc.split_bound, sc.max_path),
                                  profile, n_files=len(sc.names), headers=sc.headers,
                                  header_row_bytes=row_bytes)
    refused = _mapped_headers(sc.headers, profile).filter(F.col("_refused").isNotNull())
    refused = refused.select("file_path", F.col("_refused").alias("reason"))
    # A planned file without a row in the table of files holds no line but blank ones.
    named = spark.createDataFrame([(n,) for n in sc.names], "file_path string")
    empty = named.join(sc.headers.select("file_path"), "file_path", "left_anti").select("file_path", F.lit(EMPTY).alias("reason"))
    return rows, refused.unionByName(empty)


def cells_upload(cells: DataFrame, profile: TableProfile) -> tuple[DataFrame, DataFrame]:
    """``csv_upload``'s two results from cells already read (workbooks). ``cells``
    is read twice, so it should be a written table."""
    headers = _header_table(cells)
    refused = _mapped_headers(headers, profile).filter(F.col("_refused").isNotNull())
    return (upload_rows_from_cells(cells, profile, headers=headers),
            refused.select("file_path", F.col("_refused").alias("reason")))


def csv_upload_rows(spark: SparkSession, paths: Sequence[str], profile: TableProfile, **options) -> DataFrame:
    """The upload rows of ``csv_upload``."""
    return csv_upload(spark, paths, profile, **options)[0]


def _header_table(cells: DataFrame) -> DataFrame:
    # One row per file; the aggregate is also a barrier: the header mapping
    # (and any filter on it) runs on header rows only, never on data.
    refused = F.col("unreadable") if "unreadable" in cells.columns else F.lit(None).cast("string")
    return (cells.filter((F.col("line_no") == 0) | refused.isNotNull()).groupBy("file_path")
            .agg(F.min_by("raw_cells", "line_no").alias("_header"), F.max(refused).alias("_refused")))


def _mapped_headers(headers: DataFrame, profile: TableProfile) -> DataFrame:
    """Per file: target column per cell, which cells count, and why it is refused, if it is."""
    headers = headers.withColumn("_targets", header_targets("_header", profile.aliases))
    headers = headers.withColumn("_keep", header_keep("_targets"))
    headers = headers.withColumn("_has_key", F.coalesce(
        F.exists("_targets", lambda t: t == F.lit(profile.key)), F.lit(False)))
    why = F.coalesce("_refused", F.when(~F.col("_has_key"), F.lit(NO_KEY_COLUMN)))
    return headers.select("file_path", "_targets", "_keep", "_has_key", why.alias("_refused"))


def upload_rows_from_cells(cells: DataFrame, profile: TableProfile,
                           n_files: int | None = None, headers: DataFrame | None = None,
                           header_row_bytes: int | None = None) -> DataFrame:
    """Header row + body rows of uploaded files to field maps.

    Header cells are normalised and renamed by alias; unknown columns drop;
    a repeated raw header maps only the first time; two aliases of one column
    resolve to the last (a blank there leaves the column absent); NULL cells
    are absent from ``fields``. Rows of a refused file (a row wider than its
    header, no key column) have ``fields`` NULL and the reason in ``refused``;
    the caller rejects them whole, as the original rejects such a file.

    The header table has one row per file; it is broadcast when the file
    count (``n_files``, else a count job) and, if given, the file count times
    ``header_row_bytes`` are small (``join_checked``).
    """
    headers = _header_table(cells) if headers is None else headers
    headers = _mapped_headers(headers, profile)
    body = join_checked(cells.filter(F.col("line_no") > 0), headers, "file_path",
                        row_bound=n_files, row_bytes=header_row_bytes)
    fields = cells_to_fields("_targets", "_keep", F.slice("cells", 1, F.size("_targets")))
    order = [c for c in ("file_index", "line_no", "row_index") if c in cells.columns]
    return body.select(
        "file_path", *order,
        F.when(F.col("_refused").isNull(), fields).alias("fields"),
        F.col("_has_key").alias("has_key_column"), F.col("_refused").alias("refused"),
    )
