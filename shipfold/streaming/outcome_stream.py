"""Outcomes of changes as they arrive (T1 + J1).

Keyed state holds each key's first insert. A change's outcome is decided once, when it
arrives, and appended to the sink: a patch after its key's first insert is ``ok``, one
before it, or of a key that has none yet, is ``not_found``. The state store is checkpointed
with the stream, and the file sink commits whole batches, so a restarted job neither
loses nor repeats an outcome.

The log must arrive in ``seq`` order from batch to batch, as requests do; inside a batch
any order will do. Keys are grouped into ``BUCKETS`` by their hash, and a bucket's rows come
in chunks: what is decided at once passes straight through, and only the patches still
waiting for an insert of the same batch are held. State is read for the keys of the batch
alone, and written where a first insert is new.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shipfold.operators.fold import INSERT_KINDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "key string, seq bigint, kind string, disposition string"


BUCKETS = 512  # groups of keys; fixed for the life of a checkpoint
_NEVER = np.iinfo("int64").max  # the first insert of a key that has none


class FirstInserts(StatefulProcessor):
    """Judges each key's changes by the ``seq`` of its first insert, a bucket of keys at a
    time: a call per key costs far more than the few changes that most keys have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first_inserts", "key string", "seq bigint")

    def handleInputRows(self, key, rows, timer_values):
        first, new, waiting = {}, set(), []  # of the keys of this batch
        for pdf in rows:
            for k in pdf["key"].unique():
                if k not in first:
                    known = self.first.getValue((k,))
                    first[k] = known[0] if known else _NEVER
            inserts = pdf["kind"].isin(INSERT_KINDS)
            for k, seq in zip(pdf.loc[inserts, "key"], pdf.loc[inserts, "seq"]):
                if seq < first[k]:
                    first[k] = int(seq)
                    new.add(k)
            ok = self._after(first, pdf)
            later = ~ok & ~inserts & ~pdf["empty"]  # an insert before these may still come
            waiting.append(pdf.loc[later, ["key", "seq", "kind"]])
            done = pdf[~later]
            out = pd.Series("ok", index=done.index)
            out[done["empty"]] = "skipped"
            out[inserts[~later]] = "upserted"
            yield self._rows(done, out)
        for pdf in waiting:
            yield self._rows(pdf, self._after(first, pdf).map({True: "ok", False: "not_found"}))
        for k in new:
            self.first.updateValue((k,), (first[k],))

    @staticmethod
    def _after(first: dict, pdf: pd.DataFrame) -> pd.Series:
        """Which changes come after their key's first insert, as far as it is known."""
        return pdf["seq"] > np.fromiter((first[k] for k in pdf["key"]), "int64", len(pdf))

    @staticmethod
    def _rows(pdf: pd.DataFrame, disposition: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "kind": pdf["kind"], "disposition": disposition})

    def close(self) -> None:
        pass


def outcomes(changes_stream: DataFrame) -> DataFrame:
    """A streaming change log's outcomes, each emitted once: ``key, seq, kind, disposition``."""
    empty = (~F.col("kind").isin(*INSERT_KINDS)) & (F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    return (changes_stream.select(bucket, "key", "seq", "kind", empty.alias("empty")).groupBy("bucket")
            .transformWithStateInPandas(statefulProcessor=FirstInserts(), outputStructType=OUTCOMES,
                                        outputMode="Append", timeMode="None"))


def start_outcome_stream(changes_stream: DataFrame, sink_dir: str, checkpoint_dir: str,
                         available_now: bool = True) -> StreamingQuery:
    """Start appending outcomes to Parquet files under ``sink_dir``. Keyed state of this kind
    needs the RocksDB state store, so the session is set to it, with checkpoints of what changed."""
    conf = changes_stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    writer = (outcomes(changes_stream).writeStream.outputMode("append").format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
