"""A shipment table kept as a change log with folded snapshots.

``ShipmentStore`` offers the record service's calls as DataFrame methods:
uploads, bulk ingest, single and batch write-backs, listing with filters and
pages, point lookups, statistics, reset. Every write appends one batch to the
log (``root/log/batch=N``). ``publish`` writes the fold state per key as a snapshot;
reads merge the newest snapshot with the batches after it, so neither reads nor
the next snapshot go back over the log.
Nothing passes through the driver except batch numbers and counts.

``seq`` of a change is ``batch << 40 | position in the batch``, so batches
apply in order and rows inside a batch in their file/payload order: up to
2^23 batches of up to 2^40 rows each, both checked. The position is the
upload's dense row index (files in order, then lines; ``file << 20 | line``
for workbooks, whose sheets hold at most 2^20 rows) and, for payloads, a
dense position in partition order (``dense_positions``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shipfold.operators import aggregates as A
from shipfold.operators import changes as C
from shipfold.operators import filters as FL
from shipfold.operators import fold as FO
from shipfold.operators import paging as P
from shipfold.operators import tables as TB
from shipfold.functions.text import is_missing_key
from shipfold.profiles import (BOT_STATUS_FACET_DEFAULT, DEFAULT_PAGE_SIZE,
                               STATUS_FACET_DEFAULT, TableProfile)
from shipfold.session import scratch_dir
from shipfold.sources import csv as CSV
from shipfold.sources import json as J
from shipfold.sources import workbook as WB

BATCH_SHIFT = 40                 # position bits of seq
MAX_BATCH = (1 << 23) - 1        # seq stays a positive BIGINT
SHEET_ROW_BITS = 20              # an .xlsx sheet holds at most 2^20 rows


class ShipmentStore:
    def __init__(self, spark: SparkSession, root: str, profile: TableProfile):
        self.spark = spark
        self.root = root.rstrip("/")
        self.profile = profile

    # -- log ---------------------------------------------------------------
    @property
    def base(self) -> str:
        """Where the table lives: the root, or the newest reset's folder."""
        n = TB.committed_version(self.spark, f"{self.root}/resets")
        return f"{self.root}/reset={n}" if n else self.root

    @property
    def log_path(self) -> str:
        return f"{self.base}/log"

    @property
    def snapshot_path(self) -> str:
        return f"{self.base}/snapshot"

    def changes(self) -> DataFrame:
        try:
            return TB.read_changes(self.spark, self.log_path)
        except AnalysisException:
            return self.spark.createDataFrame(
                [], "key string, seq bigint, kind string, fields map<string,string>, "
                    "ts timestamp_ntz, batch int")

    def next_batch(self) -> int:
        last = TB.newest_partition(self.spark, self.log_path, "batch")
        batch = 1 if last is None else last + 1
        if batch > MAX_BATCH:
            raise ValueError(f"the change log holds {MAX_BATCH} batches; compact it into a new store")
        return batch

    def _batch_rows(self, batch: int) -> int:
        return self.changes().filter(F.col("batch") == F.lit(batch)).count()

    def _seq(self, batch: int, position: Column) -> Column:
        """``batch << 40 | position``; a position past 40 bits fails the job
        rather than reorder batches."""
        pos = position.cast("bigint")
        return F.when(pos < F.lit(1 << BATCH_SHIFT),
                      F.shiftleft(F.lit(batch).cast("bigint"), BATCH_SHIFT) + pos).otherwise(
            F.raise_error(F.lit(f"more than 2^{BATCH_SHIFT} rows in one batch")).cast("bigint"))

    def _append(self, changes: DataFrame, batch: int) -> None:
        TB.append_changes(changes.select(*C.CHANGE_COLUMNS), self.log_path, batch, replace=False)

    # -- reads ---------------------------------------------------------------
    def state(self) -> DataFrame:
        """Fold state per key: the newest snapshot's, merged with the batches
        after it. A filter on the key reaches both scans."""
        done = TB.committed_version(self.spark, self.snapshot_path)
        changes = self.changes()
        base = None
        if done is not None:
            changes = changes.filter(F.col("batch") > F.lit(done))
            base = TB.read_snapshot(self.spark, self.snapshot_path)
        return FO.fold_state(changes.drop("batch"), self.profile.value_columns, base)

    def _finish(self, state: DataFrame) -> DataFrame:
        return FO.finish(state, self.profile.value_columns, milestone=self.profile.milestone,
                         key_name=self.profile.key, stamp=self.profile.stamp_column or None)

    def current(self) -> DataFrame:
        """The current table."""
        return self._finish(self.state())

    def publish(self) -> int:
        """Write the fold state as a snapshot version (write-new-then-swap); only
        batches after the last snapshot are folded."""
        version = self.next_batch() - 1
        if version != TB.committed_version(self.spark, self.snapshot_path):
            TB.publish_snapshot(self.spark, self.state(), self.snapshot_path, version, cluster_key="key")
        return version

    def snapshot(self) -> DataFrame:
        """The current table as of the newest snapshot."""
        return self._finish(TB.read_snapshot(self.spark, self.snapshot_path))

    def list(self, equals: Mapping[str, str | None] | None = None, page: int = 1,
             page_size: int = DEFAULT_PAGE_SIZE, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Filtered list, newest first: ``(envelope, items)``."""
        cur = FL.eq_filter(table if table is not None else self.current(), equals or {})
        return P.page_envelope(cur, page, page_size), P.page_desc(cur, "row_seq", page, page_size)

    def list_all(self, equals: Mapping[str, str | None] | None = None, key_like: str | None = None,
                 table: DataFrame | None = None) -> DataFrame:
        """Oldest-first full list with ``All`` sentinels and a LIKE on the key."""
        cur = FL.sentinel_filter(table if table is not None else self.current(), equals or {})
        return P.list_asc(FL.like_filter(cur, self.profile.key, key_like), "row_seq")

    def get(self, key: str, table: DataFrame | None = None) -> DataFrame:
        return FL.point_lookup(table if table is not None else self.current(), self.profile.key, key)

    def stats(self, top: Mapping[str, str] | None = None, table: DataFrame | None = None) -> DataFrame:
        """Total, status and bot-status facets and top-10 categories, one scan."""
        cur = table if table is not None else self.current()
        labelled = {}
        if "status" in cur.columns:
            labelled["by_status"] = ("status", STATUS_FACET_DEFAULT)
        if "bot_status" in cur.columns:
            labelled["by_bot_status"] = ("bot_status", BOT_STATUS_FACET_DEFAULT)
        top = top if top is not None else {
            f"by_{c}": c for c in ("airline", "firm_code") if c in cur.columns}
        return A.facet_report(cur, labelled, top)

    # -- writes --------------------------------------------------------------
    def _upload(self, rows: DataFrame, refused: DataFrame, ts) -> tuple[DataFrame, DataFrame]:
        batch = self.next_batch()
        pos = (F.col("row_index") if "row_index" in rows.columns else
               F.shiftleft(F.col("file_index").cast("bigint"), SHEET_ROW_BITS) + F.col("line_no"))
        # Rows are counted as they are written and read back, so the files are parsed once.
        seen = Observation()
        counted = rows.observe(seen, F.count_if(F.col("refused").isNull() & is_missing_key(
            F.element_at("fields", F.lit(self.profile.key)))).alias("skipped"))
        changes, _ = C.upload_changes(counted.filter(F.col("refused").isNull()), self.profile,
                                      self._seq(batch, pos), F.lit(ts).cast("timestamp_ntz"))
        self._append(changes, batch)
        tally = self.spark.createDataFrame(
            [(self._batch_rows(batch), int(seen.get["skipped"]))], "upserted long, skipped long")
        return tally, refused

    def upload_csv(self, paths, ts) -> tuple[DataFrame, DataFrame]:
        """Upload CSV files. Returns ``(tally, refused)``: ``upserted, skipped`` rows,
        and the files refused whole, ``file_path, reason``."""
        rows, refused = CSV.csv_upload(self.spark, list(paths), self.profile)
        return self._upload(rows, refused, ts)

    def upload_workbook(self, paths, ts) -> tuple[DataFrame, DataFrame]:
        """Upload workbooks; returns as ``upload_csv``. The parsed cells are written
        once, so that headers, rows and refusals need one parse."""
        out = scratch_dir(self.spark, "workbook_cells")
        WB.read_workbook_cells(self.spark, list(paths)).write.parquet(out)
        rows, refused = CSV.cells_upload(self.spark.read.parquet(out), self.profile)
        return self._upload(rows, refused, ts)

    @staticmethod
    def _ordered(df: DataFrame, order_col: str | None) -> DataFrame:
        """Rows in ``order_col``'s order (a file path, a request number); without one
        in Spark's partition order, which for files follows their sizes."""
        return df.orderBy(order_col) if order_col else df

    def bulk(self, payloads: DataFrame, text_col: str, ts,
             order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Bulk JSON arrays (one per row of ``payloads``): blanks overwrite with
        NULL; rows naming unknown columns fail alone; a body that does not parse is
        refused whole. Returns ``(tally, errors)``, a refused body without a key; the tally counts rows (``upserted``, ``skipped``)."""
        batch = self.next_batch()
        rows = C.dense_positions(
            self._ordered(payloads, order_col).select(F.posexplode(J.parse_row_array(text_col)).alias("_p", "fields")), "_pos")
        changes, rejected = C.bulk_changes(rows, self.profile, self._seq(batch, F.col("_pos")),
                                           F.lit(ts).cast("timestamp_ntz"))
        valid, errors = C.unknown_column_split(changes, self.profile)
        self._append(valid, batch)
        # Two passes over the payloads in all: the write, and one row count.
        # The written batch is counted from its files (partition-pruned).
        n_ok = self._batch_rows(batch)
        n_bad = rows.count() - n_ok
        tally = self.spark.createDataFrame([(n_ok, n_bad)], "upserted long, skipped long")
        refused = J.json_rejects(payloads, text_col).select(
            F.lit(None).cast("string").alias(self.profile.key), F.col("reason").alias("error"))
        return tally, errors.select(F.col("key").alias(self.profile.key), "error").unionByName(refused)

    def patch(self, patches: DataFrame, key_col: str, payload_col: str, ts,
              position_col: str | None = None) -> DataFrame:
        """Write-back patches (NULL fields dropped); returns each patch's
        outcome: ok / not_found / skipped."""
        batch = self.next_batch()
        if not position_col:
            patches, position_col = C.dense_positions(patches, "_pos"), "_pos"
        pos = F.col(position_col)
        payload = F.col(payload_col)
        if self.profile.patch_columns:
            allowed = F.array(*[F.lit(c) for c in self.profile.patch_columns])
            payload = F.map_filter(payload, lambda k, v: F.array_contains(allowed, k))
        changes = C.patch_changes(patches, F.col(key_col), payload, self._seq(batch, pos),
                                  F.lit(ts).cast("timestamp_ntz"))
        self._append(changes, batch)
        return self._outcomes(batch)

    def batch_update(self, payloads: DataFrame, text_col: str, ts,
                     order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
        """``{items: [{mawb, result}]}`` batches, one patch per item. Returns
        ``(outcomes, refused)``: ``updated`` is the count of outcomes ``ok``; a body
        that does not parse is refused whole, with a reason."""
        items = J.explode_nested_batch(self._ordered(payloads, order_col), text_col)
        return self.patch(items, "key", "result", ts), J.nested_batch_rejects(payloads, text_col)

    def flat_batch(self, payloads: DataFrame, text_col: str, ts,
                   order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
        """``{mawbs, field, value}`` batches: refused whole when invalid,
        else one patch per key. Returns ``(outcomes, refused)``."""
        batch = self.next_batch()
        tagged = self._ordered(payloads, order_col).select(F.monotonically_increasing_id().alias("_p"), text_col,
                                 J.flat_batch_reject_reason(J.flat_batch(text_col)).alias("reason"))
        refused = tagged.filter(F.col("reason").isNotNull()).select(text_col, "reason")
        rows = C.dense_positions(J.explode_flat_batch(tagged, text_col, "_p"), "_pos")
        changes = C.patch_changes(rows, F.col("key"), F.col("result"), self._seq(batch, F.col("_pos")),
                                  F.lit(ts).cast("timestamp_ntz"))
        self._append(changes, batch)
        return self._outcomes(batch), refused

    def _outcomes(self, batch: int) -> DataFrame:
        """Outcome of each change of one batch, with the columns it names. The batch
        is read by partition pruning; first inserts come from the snapshot and the
        batches after it, for the keys this batch touches (a semi join)."""
        mine = self.changes().filter(F.col("batch") == F.lit(batch)).drop("batch")
        first = self.state().select("key", F.col("_first_insert").alias("first_insert"))
        d = FO.dispositions(mine, first.join(mine.select("key").distinct(), "key", "left_semi"), "fields")
        return d.select(F.col("key").alias(self.profile.key), "seq", "disposition",
                        F.when(F.col("disposition") == "ok", F.array_sort(F.map_keys("fields"))).alias("changed"))

    def seed(self, rows: DataFrame, payload_col: str, mapping: Mapping[str, str], ts,
             defaults: Mapping[str, str] | None = None, order_col: str | None = None) -> None:
        """Insert-or-replace seed rows (source key -> column, missing -> '')."""
        self._append(*self._seeding(rows, payload_col, mapping, ts, defaults, order_col, self.next_batch()))

    def _seeding(self, rows, payload_col, mapping, ts, defaults, order_col, batch) -> tuple[DataFrame, int]:
        rows = C.dense_positions(self._ordered(rows, order_col), "_pos")
        changes = C.seed_changes(rows, self.profile.key, F.col(payload_col), mapping,
                                 self._seq(batch, F.col("_pos")),
                                 F.lit(ts).cast("timestamp_ntz"), defaults)
        return changes, batch

    def reset(self, ts, rows: DataFrame | None = None, payload_col: str | None = None,
              mapping: Mapping[str, str] | None = None, defaults: Mapping[str, str] | None = None,
              order_col: str | None = None) -> DataFrame:
        """Clear the table and seed it again (S12); without ``rows`` it is left
        empty. Returns ``table_name, cleared, reseeded``. The new log is written
        beside the old one and named by a commit record, so readers see the old
        table or the new one whole."""
        cleared = self.current().count()
        n = (TB.committed_version(self.spark, f"{self.root}/resets") or 0) + 1
        new = f"{self.root}/reset={n}/log"
        if rows is None:
            changes, batch = self.changes().drop("batch").limit(0), 1
        else:
            changes, batch = self._seeding(rows, payload_col, mapping, ts, defaults, order_col, 1)
        # A reset that failed before its commit left a folder of no version: written over.
        TB.append_changes(changes.select(*C.CHANGE_COLUMNS), new, batch)
        TB.commit_version(self.spark, f"{self.root}/resets", n)
        return self.spark.createDataFrame([(self.profile.name, cleared, self.current().count())],
                                          "table_name string, cleared long, reseeded long")
