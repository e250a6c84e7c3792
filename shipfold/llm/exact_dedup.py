"""Exact dedup by a heavy-hitter split.

1. Every text is digested (SHA-256) once; the small table (id, digest, row id)
   is written to the shared folder.
2. A Misra-Gries summary (Spark's frequent-items sketch, merged in two levels)
   names at most ``max_heavy`` digests that may be frequent.
3. One partial aggregation over these digests counts them exactly and finds
   each one's winner. That table has at most ``max_heavy`` rows of about 100
   bytes, so it is broadcast: rows of a frequent digest are decided map-side.
4. Every other digest is rare (the summary misses none above its error), so an
   ordinary shuffle on the digest decides the rest without a hot partition.

Defined cases: a null text counts as empty; a null id is below every other id;
of rows that repeat both id and text exactly one is kept; an empty table gives
an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shipfold.llm.common import column, fresh, write_scratch

#: Digests tracked by the summary: every digest above rows * 3.5 / TRACKED shows.
TRACKED = 4096
#: Most digests that are broadcast.
MAX_HEAVY = 1024
#: Partial summaries are merged in this many groups before the last merge.
MERGE_GROUPS = 64


def digest_of(text: F.Column) -> F.Column:
    """SHA-256 of the text's UTF-8 bytes, null as empty, lowercase hex."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, rid), written once; ``rid`` tells repeated rows apart."""
    return write_scratch(
        docs.select(column(docs, id_col).alias("id"), digest_of(column(docs, text_col)).alias("digest"))
        .withColumn("rid", F.monotonically_increasing_id()), "exact-digests")


def heavy_winners(digests: DataFrame, tracked: int = TRACKED, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """(digest, keep, n) of frequent digests, exact; at most ``max_heavy`` rows."""
    partial = (digests.groupBy(F.pmod(F.shiftright("rid", 33), F.lit(MERGE_GROUPS)).alias("g"))
               .agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("state")))
    # A grouping key, though constant: partitions without summaries then give no empty ones.
    named = (partial.groupBy((F.col("g") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
             .select(F.explode(F.expr(f"approx_top_k_estimate(state, {max_heavy})")).alias("e"))
             .where(F.col("e.count") > 1).select(F.col("e.item").alias("digest")))
    return (digests.join(F.broadcast(named), "digest", "left_semi")
            .groupBy("digest").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("n")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                tracked: int = TRACKED, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    d = digest_table(docs, id_col, text_col)
    winners = write_scratch(heavy_winners(d, tracked, max_heavy), "exact-winners")
    hot = d.join(F.broadcast(winners), "digest")
    by = Window.partitionBy("digest")
    rest = (d.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
            .withColumn("keep", F.max(F.struct("id", "rid")).over(by))
            .withColumn("n", F.count(F.lit(1)).over(by)))
    return (hot.unionByName(rest)
            .select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("rid") == F.col("keep.rid")).alias("kept"), F.col("digest").alias("text_sha256")))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      tracked: int = TRACKED, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one for each text.

    Losing rows of frequent digests go map-side; the row limit on the window
    then leaves at most one row per digest and task to the shuffle of texts.
    """
    d = digest_table(docs, id_col, text_col)
    winners = write_scratch(heavy_winners(d, tracked, max_heavy), "exact-winners")
    digest, rn, win = fresh(docs, "digest", "copy_no", "winner")
    marked = docs.withColumn(digest, digest_of(column(docs, text_col)))
    small = winners.select(F.col("digest").alias(digest), F.col("keep").alias(win))
    ours = column(marked, id_col)
    left = (marked.join(F.broadcast(small), digest, "left")
            .where(F.col(win).isNull() | ours.eqNullSafe(F.col(f"{win}.id"))))
    first = Window.partitionBy(digest).orderBy(column(left, id_col).desc_nulls_last())
    return (left.withColumn(rn, F.row_number().over(first)).where(F.col(rn) == 1)
            .select(*[column(left, c) for c in docs.columns]))
