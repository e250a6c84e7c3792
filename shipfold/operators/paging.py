"""Sorting, paging and limits.

Pages use ``orderBy(...).offset(o).limit(n)``, which Spark plans as a
``TakeOrderedAndProject`` (per-partition top-(o+n), then a merge of those):
no full sort and no shuffle of the table, whatever its size. The order must be
total, so every order carries the unique key as its last term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.profiles import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be within 1..{MAX_PAGE_SIZE}")


def page_desc(df: DataFrame, order_col: str, page: int = 1,
              page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Newest first: ``ORDER BY order_col DESC LIMIT size OFFSET (page-1)*size``
    (L1); rows without an order value come last. ``order_col`` must be unique.

    One plan at every offset. Walking far into a large table is cheaper
    page by page with ``page_after``, which reads from the last key on.
    """
    check_page(page, page_size)
    offset = (page - 1) * page_size
    ordered = df.orderBy(F.col(order_col).desc())
    return (ordered.offset(offset) if offset else ordered).limit(page_size)


def page_after(df: DataFrame, order_col: str, last_seen, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Keyset page for deep paging: rows older than the last one seen (L1)."""
    check_page(1, page_size)
    return df.filter(F.col(order_col) < F.lit(last_seen)).orderBy(F.col(order_col).desc()).limit(page_size)


def list_asc(df: DataFrame, order_col: str) -> DataFrame:
    """Oldest-first full list (L2); a range-partitioned sort at scale."""
    return df.orderBy(F.col(order_col).asc())


def page_count(total, page_size: int):
    """``max(1, ceil(total / size))`` (L3)."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / F.lit(page_size)).cast("bigint"))


def page_envelope(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row ``total, page, page_size, pages, items_on_page`` for a filtered
    frame (S10, L3). One aggregate pass; the page's rows come from
    ``page_desc``."""
    check_page(page, page_size)
    offset = (page - 1) * page_size
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        F.col("total"),
        F.lit(page).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        page_count(F.col("total"), page_size).alias("pages"),
        F.greatest(F.lit(0).cast("bigint"),
                   F.least(F.lit(page_size).cast("bigint"), F.col("total") - F.lit(offset))
                   ).alias("items_on_page"),
    )


def envelope_json(df: DataFrame, order_col: str, page: int = 1,
                  page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The wire form ``{total, page, page_size, pages, items}`` as one JSON
    string, built only at the edge. The total is one scalar job; the items are
    bounded by the page size (<= 500 rows), so packing them is safe."""
    total = df.count()
    items = page_desc(df, order_col, page, page_size)
    packed = items.agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    pages = max(1, -(-total // page_size))
    return packed.select(F.to_json(F.struct(
        F.lit(total).alias("total"), F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"), F.lit(pages).alias("pages"),
        F.col("items"))).alias("json"))


def first_n(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by a total order."""
    return df.orderBy(*[F.col(c).asc() for c in order_cols]).limit(n)
