"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor and the driver share; a lost executor only re-reads them.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.session import scratch_dir

#: Bytes and rows of text that one Python step holds at a time.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 2000
#: Rows and bytes of an Arrow batch: whole texts travel in it.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Where the public vocabulary files are, unless a caller names another folder.
TOKENIZERS = "/opt/tokenizers"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once under the shared folder and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for helper columns that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A top-level column, also when its name holds dots or back-ticks."""
    return df["`" + name.replace("`", "``") + "`"]


def with_row_id(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a row number, so that repeated rows stay apart.

    The number is assigned while writing; readers see one fixed value per row
    whatever is recomputed later.
    """
    rid = fresh(df, "row_id")[0]
    return write_scratch(df.withColumn(rid, F.monotonically_increasing_id()), name), rid


def once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without(docs: DataFrame, keys: list[Column], drop: DataFrame) -> DataFrame:
    """``docs`` without the rows whose null-safe keys are in ``drop`` (one column a key).

    ``drop`` is a written table: its measured size decides between a broadcast and
    a shuffle of both sides.
    """
    return _on_keys(docs, keys, drop, "left_anti")


def only(docs: DataFrame, keys: list[Column], these: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose null-safe keys are in ``these``."""
    return _on_keys(docs, keys, these, "left_semi")


def _on_keys(docs: DataFrame, keys: list[Column], other: DataFrame, how: str) -> DataFrame:
    names = fresh(docs, *[f"key_{k}" for k in range(len(keys))])
    right = other.toDF(*names)
    on = [k.eqNullSafe(right[n]) for k, n in zip(keys, names, strict=True)]
    return docs.join(right, on, how)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``.

    The bounds are session settings, so they are lowered there and never raised.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(conf.get(key)).lower().removesuffix("b")
        now = int(now) if now.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def text_slices(batch, column_no: int, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of an Arrow batch, bounded in rows and bytes."""
    col = batch.column(column_no)
    n, start = batch.num_rows, 0
    while start < n:
        step = min(SLICE_ROWS, n - start)
        while step > 1 and col.slice(start, step).nbytes > most_bytes:
            step = max(1, step // 2)
        yield start, col.slice(start, step).to_pylist()
        start += step


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.modules.setdefault("_shipfold_llm_cache", types.ModuleType("_shipfold_llm_cache")).__dict__


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file; the folder is the same on every executor."""
    return os.path.join(folder or TOKENIZERS, name)
