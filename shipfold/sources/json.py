"""JSON payload sources.

Payloads are parsed with ``from_json`` into ``map<string,string>`` rows, never
with schema inference: a map keeps an absent key apart from a NULL value.
``posexplode`` keeps each record's position inside its payload, which is the
order the changes are applied in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.functions.text import ColumnLike, _c, strip

ROW_ARRAY = "array<map<string,string>>"
NESTED_BATCH = "struct<items:array<struct<mawb:string,result:map<string,string>>>>"
FLAT_BATCH = "struct<mawbs:array<string>,field:string,value:string>"
# FIXED VALUES: the only fields a flat milestone batch may set.
FLAT_BATCH_FIELDS = ("atd", "ata")


MALFORMED = "malformed JSON body"


def last_wins(m: ColumnLike) -> Column:
    """A map whose repeated keys keep their last value."""
    return F.transform(F.array(F.map_entries(_c(m))), last_entries)[0]


def last_entries(entries: Column) -> Column:
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last))


def parse_row_array(text: ColumnLike) -> Column:
    """JSON array of objects -> ``array<map<string,string>>``; non-string
    values keep their JSON text (numbers, true/false); a key given twice keeps its
    last value; NULL, and a body that is not such an array, give NULL."""
    return F.transform(F.from_json(_c(text), ROW_ARRAY), last_wins)


def json_rejects(df: DataFrame, text: ColumnLike, *keep: str) -> DataFrame:
    """Bodies that are refused whole because they do not parse: ``*keep, reason``.
    A NULL body is one that was not sent, and is no reject."""
    return (df.filter(_c(text).isNotNull() & F.from_json(_c(text), ROW_ARRAY).isNull())
            .select(*keep, F.lit(MALFORMED).alias("reason")))


def nested_batch_rejects(df: DataFrame, payload: ColumnLike, *keep: str) -> DataFrame:
    """Nested batches that are refused whole, with the reason."""
    return (df.filter(_c(payload).isNotNull() & nested_batch_items(payload).isNull())
            .select(*keep, F.lit(MALFORMED).alias("reason")))


def explode_rows(df: DataFrame, text: ColumnLike, *keep: str) -> DataFrame:
    """One row per record: ``*keep, pos, fields`` (S3)."""
    return df.select(*keep, F.posexplode(parse_row_array(text)).alias("pos", "fields"))


def read_json_array_files(spark: SparkSession, paths) -> DataFrame:
    """Whole JSON array files (one per bulk request): ``file_path, pos,
    fields``. A file is one task; many files read in parallel (S3)."""
    raw = spark.read.text(paths, wholetext=True)
    return explode_rows(raw.select(F.col("_metadata.file_path").alias("file_path"), "value"),
                        "value", "file_path")


def read_json_lines(spark: SparkSession, paths) -> DataFrame:
    """JSON Lines, one record per line, splittable for large inputs (S3)."""
    raw = spark.read.text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file_path"),
                      F.from_json("value", "map<string,string>").alias("fields"))


def embedded_array(text: ColumnLike, name: str) -> Column:
    """Slice ``var NAME = [ ... \\n  ];`` out of a script text and parse it;
    missing or malformed gives an empty array (S4)."""
    pattern = r"(?s)var " + name + r" = (\[.*?\n  \]);"
    body = F.regexp_extract(_c(text), pattern, 1)
    parsed = F.from_json(F.when(body != "", body), ROW_ARRAY)
    return F.coalesce(parsed, F.array().cast(ROW_ARRAY))


def nested_batch_items(payload: ColumnLike) -> Column:
    """``{items: [{mawb, result}]}`` -> array of items."""
    return F.from_json(_c(payload), NESTED_BATCH)["items"]


def explode_nested_batch(df: DataFrame, payload: ColumnLike, *keep: str) -> DataFrame:
    """One row per item: ``*keep, pos, key, result``; ``result`` keeps only
    non-NULL fields (S7, P10)."""
    ex = df.select(*keep, F.posexplode(nested_batch_items(payload)).alias("pos", "item"))
    return ex.select(*keep, "pos", F.col("item.mawb").alias("key"),
                     F.map_filter(last_wins(F.coalesce(F.col("item.result"), F.create_map().cast("map<string,string>"))),
                                  lambda k, v: v.isNotNull()).alias("result"))


def flat_batch(payload: ColumnLike) -> Column:
    return F.from_json(_c(payload), FLAT_BATCH)


def flat_batch_reject_reason(batch: ColumnLike) -> Column:
    """Why a flat batch is refused whole, NULL when valid (F12): field not
    atd/ata, value missing, or no usable key."""
    b = _c(batch)
    field = F.lower(strip(F.coalesce(b["field"], F.lit(""))))
    keys = F.filter(F.transform(F.coalesce(b["mawbs"], F.array().cast("array<string>")),
                                lambda k: strip(k)), lambda k: k.isNotNull() & (k != ""))
    return (F.when(~field.isin(*FLAT_BATCH_FIELDS), F.lit("field must be 'atd' or 'ata'"))
            .when(F.coalesce(b["value"], F.lit("")) == "", F.lit("value is required"))
            .when(F.size(keys) == 0, F.lit("mawbs is required")))


def explode_flat_batch(df: DataFrame, payload: ColumnLike, *keep: str) -> DataFrame:
    """Valid flat batches to one patch row per key: ``*keep, pos, key,
    result`` with ``result = {field: value}`` (S8). Keys are trimmed and
    blanks dropped; the field is lower-cased."""
    b = df.select(*keep, flat_batch(payload).alias("_b"))
    ok = b.filter(flat_batch_reject_reason("_b").isNull())
    field = F.lower(strip(F.col("_b.field")))
    keys = F.filter(F.transform(F.col("_b.mawbs"), lambda k: strip(k)),
                    lambda k: k.isNotNull() & (k != ""))
    ex = ok.select(*keep, field.alias("_f"), F.col("_b.value").alias("_v"),
                   F.posexplode(keys).alias("pos", "key"))
    return ex.select(*keep, "pos", "key", F.create_map(F.col("_f"), F.col("_v")).alias("result"))
