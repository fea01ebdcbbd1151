"""Pages of a table in a stable order, page facts, and page envelopes.

All pages of a table share one order: the given keys, then all other columns that have an order. Pages near the start are
cut from a top-k; for others rows are numbered by range partitions. ``directory.PageDirectory`` keeps the numbering, so that
further pages read only the files that hold them. No column of the table is lost, whatever its name: what is needed on the
way takes names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.names import free_names, quote_name
from siltstone.session import Settled, settle

DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000

# Pages that end within so many rows come from a top-k.
NEAR_ROWS = 10_000

# Fixed value: bits that monotonically_increasing_id gives to the row within its partition.
ROW_BITS = 33


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size must be 1 to {MAX_PAGE_SIZE}")


def row_order(df: DataFrame, order_by: list[str]) -> list[Column]:
    """The given keys, then all other columns that can be ordered, so that only equal rows tie."""
    if not order_by:
        raise ValueError("paging needs an order")
    return [F.col(quote_name(c)) for c in order_by] + [
        F.col(quote_name(f.name)) for f in df.schema.fields
        if f.name not in order_by and f.dataType.typeName() not in ("map", "variant")]


def numbered(df: DataFrame, order_by: list[str], number: str) -> DataFrame:
    """``df`` in row order by range partitions, with ``number``: the partition in the high bits, and below them the rank
    of the row within its partition. The input partition decides between equal rows, so that even many copies of one row
    spread."""
    part, = free_names(df, "part")
    order = [*row_order(df, order_by), F.col(part)]
    return (df.withColumn(part, F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
            .drop(part).withColumn(number, F.monotonically_increasing_id()))


def positions(df: DataFrame, order_by: list[str], name: str = "position") -> Settled:
    """``df`` with ``name``, the zero-based rank of each row by ``order_by``, without a global sort in one task, and how
    many rows there are.

    The numbered rows are written once, so that the per-partition counts, which shift them to global positions, describe
    the same partitions. The counts have one row per partition.
    """
    if free_names(df, name) != [name]:
        raise ValueError(f"the table has a column {name}")
    number, part, rows, shift = free_names(df, *(f"{name}_{w}" for w in ("number", "part", "rows", "shift")))
    stored = settle(numbered(df, order_by, number), "positions")
    place = F.shiftright(number, ROW_BITS)
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shifts = (stored.frame.groupBy(place.alias(part)).agg(F.count(F.lit(1)).alias(rows))
              .select(part, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(shift)))
    within = F.col(number).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row per partition, as many as the write had tasks; Spark broadcasts it by its own threshold.
    placed = stored.frame.withColumn(part, place).join(shifts, part).withColumn(name, F.col(shift) + within)
    return stored.narrowed(placed.select(*[F.col(quote_name(c)) for c in df.columns], name))


def with_positions(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """The frame of ``positions``."""
    return positions(df, order_by, name).frame


def page_of(page_size: int, position: str = "position") -> Column:
    """The page of a row from its position."""
    return F.expr(f"CAST({quote_name(position)} DIV {int(page_size)} + 1 AS INT)")


def pages(df: DataFrame, order_by: list[str], wanted: list[int], page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Rows of the wanted pages with their ``page`` (``page_`` if the table has that column, and so on). Repeated keys
    neither lose nor repeat rows."""
    for number in wanted:
        check_page(number, page_size)
    position, page = free_names(df, "position", "page")
    order = row_order(df, order_by)
    if wanted and max(wanted) * page_size <= NEAR_ROWS:
        # So few rows that one task numbers them.
        top = settle(df.orderBy(*order).limit(max(wanted) * page_size), "top").frame.coalesce(1)
        placed = top.withColumn(position, (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))
    else:
        placed = with_positions(df, order_by, position)
    return placed.withColumn(page, page_of(page_size, position)).where(F.col(page).isin(list(wanted))).drop(position)


def page(df: DataFrame, order_by: list[str], page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Rows of one page; see ``pages``."""
    check_page(page, page_size)
    if page * page_size <= NEAR_ROWS:
        return df.orderBy(*row_order(df, order_by)).offset((page - 1) * page_size).limit(page_size)
    name, = free_names(df, "page")
    return pages(df, order_by, [page], page_size).drop(name)


def total_pages(total: Column, page_size: int) -> Column:
    return F.ceil(total / F.lit(page_size))


def facts(total: Column, page: Column, page_size: int) -> list[Column]:
    """Page, page size, totals, and whether pages follow or precede."""
    pages = total_pages(total, page_size)
    return [page.cast("int").alias("page"), F.lit(page_size).alias("page_size"), total.alias("total_records"),
            pages.cast("int").alias("total_pages"), (page < pages).alias("has_next"),
            (page > 1).alias("has_previous")]


def page_facts(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: the page, its size, record and page totals, and whether pages follow or precede."""
    check_page(page, page_size)
    counted = df.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(*facts(F.col("total"), F.lit(page), page_size))


def envelopes(df: DataFrame, table_name: str, order_by: list[str],
              page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Every page of ``df`` as one envelope row: status, table, pagination, rows, timestamp.

    A page holds at most ``MAX_PAGE_SIZE`` rows, which bounds each group.
    """
    check_page(1, page_size)
    position, page = free_names(df, "position", "page")
    located = positions(df, order_by, position)
    whole = F.struct(*[F.col(quote_name(c)) for c in df.columns]).alias("row")
    grouped = (located.frame.select(page_of(page_size, position).alias(page), F.struct(F.col(position), whole).alias("held"))
               .groupBy(page).agg(F.array_sort(F.collect_list("held")).alias("held")))
    return enveloped(grouped.select(F.col(page).alias("number"), F.transform("held", lambda r: r["row"]).alias("data")),
                     table_name, located.rows, page_size)


def enveloped(pages: DataFrame, table_name: str, total: int, page_size: int) -> DataFrame:
    """Envelopes of pages given by their ``number`` and ``data``."""
    return pages.select(
        F.lit("success").alias("status"), F.lit(table_name).alias("table_name"),
        F.struct(*facts(F.lit(total).cast("bigint"), F.col("number"), page_size)).alias("pagination"), "data",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))
