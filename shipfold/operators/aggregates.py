"""Counts, facets, top-k and tallies.

Every aggregate is a ``groupBy``/``agg`` with a partial (map-side) step before
the one shuffle, so a key that holds a third of all rows only costs one
pre-aggregated row per input partition. Top-k uses ``orderBy().limit()``,
planned as ``TakeOrderedAndProject``: k rows per partition, never a whole
group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipfold.functions.text import blank_default, first_int
from shipfold.profiles import BOT_STATUS_FACET_DEFAULT, STATUS_FACET_DEFAULT, TOP_K


def filtered_count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """``COUNT(*) [WHERE p]`` as a one-row frame (A1)."""
    src = df if predicate is None else df.filter(predicate)
    return src.agg(F.count(F.lit(1)).alias("total"))


def facet(df: DataFrame, col: str, default: str, label: str = "label") -> DataFrame:
    """Counts per value, NULL and '' reported under ``default``; groups sharing
    a label are summed (A2, A3)."""
    return (df.groupBy(blank_default(col, default).alias(label))
            .agg(F.count(F.lit(1)).alias("cnt")))


def facet_status(df: DataFrame, col: str = "status") -> DataFrame:
    return facet(df, col, STATUS_FACET_DEFAULT)


def facet_bot_status(df: DataFrame, col: str = "bot_status") -> DataFrame:
    return facet(df, col, BOT_STATUS_FACET_DEFAULT)


def top_k(df: DataFrame, col: str, k: int = TOP_K, label: str = "label") -> DataFrame:
    """``WHERE c IS NOT NULL GROUP BY c ORDER BY cnt DESC LIMIT k``; ties are
    broken by the value ascending so the result is deterministic (A4)."""
    counts = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(label))
              .agg(F.count(F.lit(1)).alias("cnt")))
    return counts.orderBy(F.col("cnt").desc(), F.col(label).asc()).limit(k)


def facet_report(df: DataFrame,
                 labelled: Mapping[str, tuple[str, str]],
                 top: Mapping[str, str],
                 k: int = TOP_K,
                 total_name: str = "total") -> DataFrame:
    """All facets of a table from one scan (A5).

    ``labelled`` maps a facet name to ``(column, default label)``; ``top`` maps a
    facet name to a category column reported as top-k (NULL excluded).
    Output rows ``(facet, label, cnt)``; the total row has a NULL label.

    Plan: one scan, ``Expand`` for the grouping sets, partial aggregate, one
    shuffle, final aggregate; the per-facet branches read that one exchange
    (``ReusedExchange``) and the top-k branches are ``TakeOrderedAndProject``.
    """
    names = list(labelled) + list(top)
    cols = [blank_default(c, d).alias(n) for n, (c, d) in labelled.items()]
    cols += [F.col(c).alias(n) for n, c in top.items()]
    src = df.select(*cols)
    sets = [[]] + [[n] for n in names]
    agg = (src.groupingSets(sets, *names)
           .agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid")))
    width = len(names)

    def gid_for(i: int) -> int:
        return (1 << width) - 1 - (1 << (width - 1 - i))

    def of_set(gid: int) -> Column:
        # The predicate reads the aggregate's output (cnt), so Catalyst keeps it
        # above the aggregate: every branch then reads the same exchange
        # (ReusedExchange) instead of scanning the table once per facet.
        return F.when(F.col("cnt") > 0, F.col("gid")) == F.lit(gid)

    parts = [agg.filter(of_set((1 << width) - 1)).select(
        F.lit(total_name).alias("facet"), F.lit(None).cast("string").alias("label"), "cnt")]
    for i, n in enumerate(names):
        one = agg.filter(of_set(gid_for(i))).select(
            F.lit(n).alias("facet"), F.col(n).cast("string").alias("label"), "cnt")
        if n in top:
            one = (one.filter(F.when(F.col("cnt") > 0, F.col("label")).isNotNull())
                   .orderBy(F.col("cnt").desc(), F.col("label").asc()).limit(k))
        parts.append(one)
    return reduce(DataFrame.unionByName, parts)


def dashboard_cards(shipments: DataFrame, pickups: DataFrame,
                    bot_col: str = "bot_status") -> DataFrame:
    """Total, bot-pending, bot-arrived and pickup total in one row; absent
    counts are 0 (A6). Bot status NULL or '' counts as pending.

    Both tables feed one global aggregate over their union (partial counts
    per partition, then one tiny final step): no join of the two counts.
    """
    bot = blank_default(bot_col, BOT_STATUS_FACET_DEFAULT)
    a = shipments.select(F.lit(1).alias("_ic"), (bot == F.lit("pending")).alias("_p"),
                         (bot == F.lit("arrived")).alias("_a"), F.lit(0).alias("_pr"))
    b = pickups.select(F.lit(0).alias("_ic"), F.lit(False).alias("_p"),
                       F.lit(False).alias("_a"), F.lit(1).alias("_pr"))
    return a.unionByName(b).agg(
        F.coalesce(F.sum("_ic"), F.lit(0)).cast("bigint").alias("total"),
        F.count_if("_p").alias("bot_pending"),
        F.count_if("_a").alias("bot_arrived"),
        F.coalesce(F.sum("_pr"), F.lit(0)).cast("bigint").alias("pickup_total"),
    )


def disposition_tally(results: DataFrame, status_col: str = "disposition") -> DataFrame:
    """Count per disposition (ok / skipped / not_found)."""
    return results.groupBy(status_col).agg(F.count(F.lit(1)).alias("cnt"))


def ingest_tally(results: DataFrame, source_col: str = "source",
                 status_col: str = "disposition") -> DataFrame:
    """Upserted / skipped / errors per source; upserted counts rows, not keys
    (A8)."""
    s = F.col(status_col)
    return results.groupBy(source_col).agg(
        F.count_if(s == F.lit("upserted")).alias("upserted"),
        F.count_if(s == F.lit("skipped")).alias("skipped"),
        F.count_if(s == F.lit("error")).alias("errors"),
    )


def distinct_options(df: DataFrame, col: str, sentinel: str = "All") -> DataFrame:
    """Distinct non-blank values, sorted, the sentinel first.
    Output ``(value, is_sentinel)``, ordered sentinel first, then by value."""
    values = (df.filter(F.col(col).isNotNull() & (F.col(col) != F.lit("")))
              .select(F.col(col).alias("value")).distinct())
    first = df.sparkSession.range(1).select(F.lit(sentinel).alias("value"))
    both = first.withColumn("is_sentinel", F.lit(True)).unionByName(
        values.withColumn("is_sentinel", F.lit(False)))
    return both.orderBy(F.col("is_sentinel").desc(), F.col("value").asc())


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One ``(table_name, row_count)`` row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def copy_check(pages: DataFrame) -> DataFrame:
    """Per page: all grid rows vs rows inside the body wrapper; the fixed clone
    doubles the count (A12). Input: the scan's page rows."""
    return pages.select("page_id", "dom_rows", "body_rows",
                        (F.col("dom_rows") == F.col("body_rows") * 2).alias("clone_doubles"))


def count_reconcile(pages: DataFrame) -> DataFrame:
    """Extracted row count vs the total that the page states (J6, X10): both come
    from the scan's one parse, so there is no join. ``matches`` flags agreement; a
    page that states no number does not match."""
    reported = first_int("reported_total")
    return pages.select("page_id", F.col("body_rows").cast("bigint").alias("extracted"), reported.alias("reported"),
                        F.coalesce(F.col("body_rows") == reported, F.lit(False)).alias("matches"))


def union_distinct(a: DataFrame, b: DataFrame, col: str = "value") -> DataFrame:
    """Union of two selections, distinct, ascending."""
    return a.select(col).union(b.select(col)).distinct().orderBy(F.col(col).asc())
