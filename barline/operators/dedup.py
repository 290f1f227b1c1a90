"""Ordered de-duplication: exactly one row per key, chosen by an explicit order.

``row_number() = 1`` lets Spark keep one row per key before the shuffle
(``WindowGroupLimit``), so a key with very many copies costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(ranked)).where("_nth = 1").drop("_nth")


def keep_last(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    backwards = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    return keep_first(df, keys, backwards)


#: Rows that a task sorts, about, where their number is known.
ROWS_PER_TASK = 250_000


def parts_of(rows: int) -> int:
    """Tasks among which so many rows are dealt, so that the memory of one doesn't grow with the table."""
    return max(1, -(-rows // ROWS_PER_TASK))


def keep_first_dealt(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], rows: int) -> DataFrame:
    """``keep_first`` of about so many rows, in tasks of bounded size.

    Rows are dealt by their place and limited to one for each key and share, then dealt by key; so
    a key with very many copies costs few rows in its task.  ``order`` tells rows apart.
    """
    parts = parts_of(rows)
    if parts == 1:
        return keep_first(df, keys, order)
    made = {f"_key{k}": c for k, c in enumerate(keys) if not isinstance(c, str)}
    named, own = df.withColumns(made), [c if isinstance(c, str) else f"_key{k}" for k, c in enumerate(keys)]
    dealt = named.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(16 * parts)))
    few = keep_first(dealt.repartition(parts, "_share"), [*own, "_share"], order).drop("_share")
    return keep_first(few.repartition(parts, *own), own, order).drop(*made)


# A row per file is well under 1 KB, so this many stay below 100 MB.
MAX_BROADCAST_FILES = 100_000


def per_file(table: DataFrame, files: int | None) -> DataFrame:
    """A table with one row per file: broadcast where the number of files is known and small."""
    return F.broadcast(table) if files is not None and files <= MAX_BROADCAST_FILES else table


def dedup_trades(
    trades: DataFrame,
    source: str = "source_file",
    order: Sequence[str] = ("position",),
    files: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """First row per trade within each source file, in tasks of bounded size where ``rows``, about, is given.

    A file with any trade id is keyed by the id (rows without one count as one
    trade), a file without ids by time, price, quantity and side.
    """
    has_ids = trades.groupBy(source).agg(
        F.bool_or(F.col("trade_id").isNotNull()).alias("_has_ids")
    )
    keyed = trades.join(per_file(has_ids, files), source)
    by_content = F.when(
        ~F.col("_has_ids"), F.struct("time", "price", "qty", "isBuyerMaker")
    )
    keys = [source, "trade_id", by_content]
    kept = keep_first(keyed, keys, order) if rows is None else keep_first_dealt(keyed, keys, [source, *order], rows)
    return kept.drop("_has_ids")
