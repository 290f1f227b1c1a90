"""Forward-looking drawdown labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MINUTE_MS, div, drawdown_names, ratio
from .ordered import (
    DIRECT_WIDTH,
    ROWS_PER_CHUNK,
    with_halo,
    with_row_index,
    without_halo,
)


def drawdown_labels(
    features: DataFrame,
    horizons: Sequence[int],
    thresholds: Sequence[float],
    order: Sequence[str] = ("open_time",),
    step_ms: int = MINUTE_MS,
    strict_grid: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per horizon H the minimum close of the next H rows, the drawdown to it, and labels.

    The last H rows of a symbol have no full future and get NULL.  Horizons count
    rows; on a strict grid the row number follows from the time, otherwise rows
    are counted first.
    """
    if strict_grid:
        numbered = features.withColumn("_row", div("open_time", step_ms))
    else:
        numbered = with_row_index(
            features, ["symbol"], order, rows_per_chunk * step_ms, name="_row"
        )
    work = with_halo(numbered, "_row", ahead=max(horizons), size=rows_per_chunk)
    for h in horizons:
        work = work.withColumn(f"_ahead{h}", _least_ahead(h)) if h <= DIRECT_WIDTH else (
            _least_ahead_by_blocks(work, h)
        )

    out = {}
    for h, (future, drawdown, labels) in drawdown_names(horizons, thresholds).items():
        low = F.col(f"_ahead{h}")
        change = ratio(low, F.col("close")) - 1.0
        out[future] = low
        out[drawdown] = change
        for name, threshold in labels.items():
            out[name] = F.when(change.isNotNull(), (change <= -threshold).cast("double"))
    columns = [F.col(c) for c in features.columns]
    return without_halo(work).select(*columns, *[v.alias(k) for k, v in out.items()])


def _least_ahead(h: int):
    frame = Window.partitionBy("symbol", "_chunk").orderBy("_row").rowsBetween(1, h)
    return F.when(F.count("close").over(frame) >= h, F.min("close").over(frame))


def _least_ahead_by_blocks(work: DataFrame, h: int) -> DataFrame:
    """The minimum over a wide frame, from the tail and head of the two blocks it meets."""
    block = div("_row", h)
    keys = ["symbol", "_chunk"]
    blocks = Window.partitionBy(*keys, "_block")
    grown = (Window.unboundedPreceding, 0)
    tail = blocks.orderBy(F.col("_row").desc()).rowsBetween(*grown)
    head = blocks.orderBy("_row").rowsBetween(*grown)
    walk = Window.partitionBy(*keys).orderBy("_block", "_row")
    state = F.struct(F.min("close").over(tail).alias("low"), F.count("close").over(tail).alias("n"))
    work = work.withColumn("_block", block).withColumn("_tail", state)
    state = F.struct(F.min("close").over(head).alias("low"), F.count("close").over(head).alias("n"))
    work = work.withColumn("_head", state)
    work = work.withColumn("_from", F.lead("_tail", 1).over(walk)).withColumn(
        "_to", F.lead("_head", h).over(walk)
    )
    one_block = F.pmod(F.col("_row") + 1, F.lit(h)) == 0
    seen = F.when(one_block, F.col("_to")["n"]).otherwise(F.col("_from")["n"] + F.col("_to")["n"])
    low = F.when(one_block, F.col("_to")["low"]).otherwise(
        F.least(F.col("_from")["low"], F.col("_to")["low"])
    )
    return work.withColumn(f"_ahead{h}", F.when(seen >= h, low)).drop(
        "_block", "_tail", "_head", "_from", "_to"
    )
