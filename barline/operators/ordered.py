"""Scans over long ordered series, cut into chunks.

A window partitioned by the series alone puts the whole series into one task.
The functions here cut the order key into chunks of bounded length, work inside
each chunk, and pass what a chunk needs from its neighbours in one of two ways:

* a *carry*: each chunk is aggregated to one row, a window over those few rows
  gives every chunk what came before it, and a join brings that back;
* a *halo*: rows near the edge of a chunk are also sent to the next one.

``series`` columns must not be NULL.  The first ``order`` column is an integer
that is (nearly) unique within a series, so a chunk of ``span`` key units holds
about ``span / spacing`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import div
from ..session import written

ROWS_PER_CHUNK = 20_000
# Frames up to this width are cheaper evaluated directly than by blocks.
DIRECT_WIDTH = 60
# Ranges one exchange is cut into at most; beyond it a range grows, and running windows stream it.
MOST_RANGES = 100_000


def _earlier(series: Sequence[str]) -> WindowSpec:
    """Over chunk rows: everything in the chunks before this one."""
    return (
        Window.partitionBy(*series)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def chunked(df: DataFrame, order: Sequence[str], span: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add the chunk column, unless an earlier scan over the same order left it.

    Scans that share the column also share one shuffle and one sort.
    """
    return df if "_chunk" in df.columns else df.withColumn("_chunk", div(order[0], span))


def even_span(df: DataFrame, key: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> int:
    """Key units that hold about ``rows_per_chunk`` rows on average; a small job over one column.

    However far apart the keys lie, there are about as many chunks as rows fill.
    """
    n, low, high = df.agg(F.count(key), F.min(key), F.max(key)).first()
    return max(1, (high - low + 1) * rows_per_chunk // n) if n else rows_per_chunk


def chunked_by_rows(
    df: DataFrame, order: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK, name: str = "ranges"
) -> DataFrame:
    """The rows cut into ranges of the whole ``order`` that hold about equal numbers of rows.

    For series with many rows per key or an uneven density, where a fixed span
    could hold any number of rows.  The rows are written, since the bounds of an
    exchange are sampled: while the plan is built, this runs jobs.
    """
    rows = written(df, name)
    ranges = min(max(1, math.ceil(rows.count() / rows_per_chunk)), MOST_RANGES)
    dealt = rows.repartitionByRange(ranges, *order).withColumn("_chunk", F.spark_partition_id())
    return written(dealt, name)


def with_row_index(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    span: int = ROWS_PER_CHUNK,
    name: str = "row_index",
) -> DataFrame:
    """Number the rows of each series from 0 in ``order``."""
    keyed = chunked(df, order, span)
    starts = (
        keyed.groupBy(*series, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *series,
            "_chunk",
            F.coalesce(F.sum("_rows").over(_earlier(series)), F.lit(0)).alias("_start"),
        )
    )
    inside = Window.partitionBy(*series, "_chunk").orderBy(*order)
    return (
        keyed.join(starts, [*series, "_chunk"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .select(*[c for c in df.columns if c != "_chunk"], name)
    )


def with_previous(
    df: DataFrame,
    value: str,
    names: Sequence[str],
    series: Sequence[str],
    order: Sequence[str],
    span: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``value`` of the previous row and, with two names, of the row before it."""
    if not 1 <= len(names) <= 2:
        raise ValueError("one or two names are needed")
    inside = Window.partitionBy(*series, "_chunk").orderBy(*order)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    local = chunked(df, order, span).select(
        "*",
        F.row_number().over(inside).alias("_nth"),
        F.lag(value, 1).over(inside).alias("_lag1"),
        F.lag(value, 2).over(inside).alias("_lag2"),
    )
    chunks = Window.partitionBy(*series).orderBy("_chunk")
    carried = (
        local.groupBy(*series, "_chunk")
        .agg(
            F.max("_nth").alias("_rows"),
            F.max_by(value, place).alias("_last"),
            F.max_by("_lag1", place).alias("_second"),
        )
        .select(
            *series,
            "_chunk",
            F.lag("_last", 1).over(chunks).alias("_carry1"),
            F.when(F.lag("_rows", 1).over(chunks) >= 2, F.lag("_second", 1).over(chunks))
            .otherwise(F.lag("_last", 2).over(chunks))
            .alias("_carry2"),
        )
    )
    nth = F.col("_nth")
    first = F.when(nth == 1, F.col("_carry1")).otherwise(F.col("_lag1"))
    second = (
        F.when(nth == 1, F.col("_carry2"))
        .when(nth == 2, F.col("_carry1"))
        .otherwise(F.col("_lag2"))
    )
    return (
        local.join(carried, [*series, "_chunk"])
        .withColumns(dict(zip(names, (first, second))))
        .select(*df.columns, *names)
    )


def with_running_total(
    df: DataFrame,
    value: str,
    total: str,
    series: Sequence[str],
    order: Sequence[str],
    span: int = ROWS_PER_CHUNK,
    peak: str | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` and, if named, the running peak of that sum."""
    so_far = (
        Window.partitionBy(*series, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = (
        chunked(df, order, span)
        .withColumn("_sum", F.sum(value).over(so_far))
        .withColumn("_max", F.max("_sum").over(so_far))
    )
    earlier = _earlier(series)
    carried = (
        local.groupBy(*series, "_chunk")
        .agg(F.sum(value).alias("_total"), F.max("_max").alias("_top"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
        .withColumn("_before", F.max(F.col("_base") + F.col("_top")).over(earlier))
        .select(*series, "_chunk", "_base", "_before")
    )
    new = {total: F.col("_base") + F.col("_sum")}
    if peak:
        new[peak] = F.greatest(F.col("_before"), F.col("_base") + F.col("_max"))
    return (
        local.join(carried, [*series, "_chunk"])
        .withColumns(new)
        .select(*df.columns, *new)
    )


def with_halo(
    df: DataFrame, index: str, back: int = 0, ahead: int = 0, size: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Cut a gapless ``index`` into chunks that also hold their neighbours' edge rows.

    ``_chunk`` is the chunk a copy of the row belongs to and ``_own`` tells whether
    it is the row's own chunk; after the windows keep only the rows that are.
    A chunk is never shorter than a frame, so a row has at most three copies.
    """
    size = max(size, back, ahead)
    own = div(index, size)
    later = div(F.col(index) + back, size)
    sooner = div(F.col(index) - ahead, size)
    homes = F.array_compact(
        F.array(
            own,
            F.when(later != own, later),
            F.when(sooner != own, sooner),
        )
    )
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_own", F.col("_chunk") == own)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")


# Moments of a frame are five plain columns that share a prefix: the number of
# known values, their mean, the sum of squared distances from it (m2), and the
# least and greatest value.  Equal values then have exactly that mean and spread 0,
# free of rounding, which matters where a score divides by a tiny spread.
# They are written as SQL text: a table has dozens of them, and one text is far
# cheaper to hand to Spark than a tree of column calls.
MOMENTS = ("n", "mean", "m2", "lo", "hi")


def _over(keys: Sequence[str], order: Sequence[str], rows: str) -> str:
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"OVER ({by}ORDER BY {', '.join(order)} ROWS BETWEEN {rows})"


def _moments(value: str, over: str, prefix: str) -> list[str]:
    return [
        f"count({value}) {over} AS {prefix}_n",
        f"avg({value}) {over} AS {prefix}_mean",
        f"var_pop({value}) {over} AS {prefix}_var",
        f"min({value}) {over} AS {prefix}_lo",
        f"max({value}) {over} AS {prefix}_hi",
    ]


def _m2(prefix: str) -> str:
    return f"{prefix}_var * {prefix}_n AS {prefix}_m2"


def _merged(a: str, b: str, prefix: str) -> list[str]:
    """Moments of two disjoint sets of rows (pairwise formula); either may be empty."""
    na, nb = f"coalesce({a}_n, 0)", f"coalesce({b}_n, 0)"
    gap = f"({b}_mean - {a}_mean)"
    return [
        f"{na} + {nb} AS {prefix}_n",
        f"CASE WHEN {na} = 0 THEN {b}_mean WHEN {nb} = 0 THEN {a}_mean"
        f" ELSE {a}_mean + {gap} * {nb} / ({na} + {nb}) END AS {prefix}_mean",
        f"CASE WHEN {na} = 0 THEN {b}_m2 WHEN {nb} = 0 THEN {a}_m2"
        f" ELSE {a}_m2 + {b}_m2 + {gap} * {gap} * {na} * {nb} / ({na} + {nb}) END AS {prefix}_m2",
        f"least({a}_lo, {b}_lo) AS {prefix}_lo",
        f"greatest({a}_hi, {b}_hi) AS {prefix}_hi",
    ]


def mean_of(prefix: str) -> str:
    return f"CASE WHEN {prefix}_lo = {prefix}_hi THEN {prefix}_lo ELSE {prefix}_mean END"


def std_of(prefix: str) -> str:
    """Population standard deviation."""
    return (
        f"CASE WHEN {prefix}_lo = {prefix}_hi THEN 0.0D"
        f" WHEN {prefix}_n > 0 THEN sqrt({prefix}_m2 / {prefix}_n) END"
    )


def _names(prefixes: Sequence[str], parts: Sequence[str] = MOMENTS) -> list[str]:
    return [f"{p}_{m}" for p in prefixes for m in parts]


def rolling_moments(
    df: DataFrame, columns: dict[str, str], series: Sequence[str], index: str, width: int
) -> DataFrame:
    """Moments of the ``width`` rows that end with the current one.

    ``df`` comes from ``with_halo`` with ``back >= width - 1``; ``columns`` maps
    each value column to the prefix of its moments.  Spark evaluates a sliding
    frame anew for every row, so a wide frame is put together from two growing
    ones: the tail of the block it starts in and the head of the block it ends
    in.  That makes the cost per row independent of the width.
    """
    keys = [*series, "_chunk"]
    new = list(columns.values())
    if width <= DIRECT_WIDTH:
        over = _over(keys, [index], f"{width - 1} PRECEDING AND CURRENT ROW")
        found = [e for c, prefix in columns.items() for e in _moments(c, over, prefix)]
        out = df.selectExpr("*", *found).selectExpr("*", *map(_m2, new))
        return out.drop(*_names(new, ["var"]))

    # blocks are counted from the first row of the chunk: a frame that reaches
    # back beyond it lies in the first block, and its head alone is complete
    grown = "UNBOUNDED PRECEDING AND CURRENT ROW"
    tail = _over([*keys, "_block"], [f"{index} DESC"], grown)
    head = _over([*keys, "_block"], [index], grown)
    step = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _block, {index})"
    tails = {c: f"_tail{k}" for k, c in enumerate(columns)}
    heads = {c: f"_head{k}" for k, c in enumerate(columns)}
    parts = ("n", "mean", "var", "lo", "hi")
    moved = _names(list(tails.values()), parts)
    # a frame that starts on a block edge is one whole block: its tail is left out
    two_blocks = f"pmod(_place + 1, {width}) <> 0"

    place = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {index}) - 1 AS _place"
    out = df.selectExpr("*", place).selectExpr("*", f"_place div {width} AS _block")
    out = out.selectExpr("*", *[e for c, t in tails.items() for e in _moments(c, tail, t)])
    out = out.selectExpr("*", *[e for c, h in heads.items() for e in _moments(c, head, h)])
    out = out.selectExpr("*", *[f"lag({n}, {width - 1}) {step} AS _far{n}" for n in moved])
    out = out.selectExpr("*", *[f"CASE WHEN {two_blocks} THEN _far{n} END AS _cut{n}" for n in moved])
    cut = [f"_cut{t}" for t in tails.values()]
    out = out.selectExpr("*", *map(_m2, [*cut, *heads.values()]))
    out = out.selectExpr(
        "*", *[e for c, p in columns.items() for e in _merged(f"_cut{tails[c]}", heads[c], p)]
    )
    return out.select(*df.columns, *_names(new))


def expanding_moments(
    df: DataFrame,
    columns: dict[str, str],
    series: Sequence[str],
    order: Sequence[str],
    span: int = ROWS_PER_CHUNK,
    seen: str = "_seen",
) -> DataFrame:
    """Moments of all earlier rows of the series, and the number of them, ``seen``."""
    keyed = chunked(df, order, span)
    values = dict(enumerate(columns))
    keys = [*series, "_chunk"]

    totals = ["count(1) AS _rows"]
    for k, c in values.items():
        totals += [
            f"count({c}) AS _n{k}",
            f"avg({c}) AS _mean{k}",
            f"var_pop({c}) AS _var{k}",
            f"min({c}) AS _lo{k}",
            f"max({c}) AS _hi{k}",
        ]
    chunks = keyed.groupBy(*keys).agg(*[F.expr(t) for t in totals])
    # squares are taken from the mean of the series' first chunk to keep them small
    every = _over(series, ["_chunk"], "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    earlier = _over(series, ["_chunk"], "UNBOUNDED PRECEDING AND 1 PRECEDING")
    chunks = chunks.selectExpr("*", *[f"first(_mean{k}, true) {every} AS _origin{k}" for k in values])
    chunks = chunks.selectExpr("*", *[f"_mean{k} - _origin{k} AS _shift{k}" for k in values])
    so_far = [f"coalesce(sum(_rows) {earlier}, 0) AS _rows_before"]
    finished = []
    for k in values:
        so_far += [
            f"sum(_n{k}) {earlier} AS _carry{k}_n",
            f"min(_lo{k}) {earlier} AS _carry{k}_lo",
            f"max(_hi{k}) {earlier} AS _carry{k}_hi",
            f"sum(_n{k} * _shift{k}) {earlier} AS _total{k}",
            f"sum(_n{k} * (_var{k} + _shift{k} * _shift{k})) {earlier} AS _squares{k}",
        ]
        finished += [
            f"CASE WHEN _carry{k}_n > 0 THEN _origin{k} + _total{k} / _carry{k}_n END AS _carry{k}_mean",
            f"CASE WHEN _carry{k}_n > 0 THEN greatest(_squares{k} - _total{k} * _total{k} / _carry{k}_n, 0.0D)"
            f" END AS _carry{k}_m2",
        ]
    carries = [f"_carry{k}" for k in values]
    carried = chunks.selectExpr("*", *so_far).selectExpr("*", *finished)
    carried = carried.select(*keys, "_rows_before", *_names(carries))

    before = _over(keys, order, "UNBOUNDED PRECEDING AND 1 PRECEDING")
    nth = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS _nth"
    local = [e for k, c in values.items() for e in _moments(c, before, f"_here{k}")]
    out = keyed.selectExpr("*", nth, *local).join(carried, keys)
    out = out.selectExpr("*", *[_m2(f"_here{k}") for k in values])
    merged = [
        e for k, p in enumerate(columns.values()) for e in _merged(f"_carry{k}", f"_here{k}", p)
    ]
    out = out.selectExpr("*", f"_rows_before + _nth - 1 AS {seen}", *merged)
    kept = [c for c in df.columns if c != "_chunk"]
    return out.select(*kept, seen, *_names(list(columns.values())))


def with_sums_below(
    counts: DataFrame,
    series: Sequence[str],
    value: str | Sequence[str],
    sums: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``<s>_below``: the sum of ``s`` over all smaller values of the series.

    ``counts`` holds one row per series and value, neither NULL nor NaN; several
    value columns are compared one after the other.  The rows are written in
    ranges first, so jobs run while the plan is built.
    """
    order = [value] if isinstance(value, str) else list(value)
    keyed = chunked_by_rows(counts, [*series, *order], rows_per_chunk, "counts")
    earlier = _earlier(series)
    carried = (
        keyed.groupBy(*series, "_chunk")
        .agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
        .select(
            *series,
            "_chunk",
            *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums],
        )
    )
    inside = Window.partitionBy(*series, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(carried, [*series, "_chunk"])
        .withColumns(
            {
                f"{s}_below": F.col(f"_base_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))
                for s in sums
            }
        )
        .select(*counts.columns, *[f"{s}_below" for s in sums])
    )


def quantiles(
    ranked: DataFrame, series: Sequence[str], value: str, rows: str, probs: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per series, ``quantiles`` array.

    ``ranked`` has one row per series and value with its number of ``rows`` and
    ``<rows>_below``, as ``with_sums_below`` gives it, and ``_n``, the rows of the series.
    """
    start, end = F.col(f"{rows}_below"), F.col(f"{rows}_below") + F.col(rows)

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col(value)))

    picked = []
    for k, q in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(q))
        low = F.floor(place)
        picked += [
            at(low).alias(f"_low{k}"),
            at(F.least(low + 1, F.col("_n") - 1)).alias(f"_high{k}"),
            F.max(place - low).alias(f"_part{k}"),
        ]
    found = ranked.groupBy(*series).agg(*picked)
    return found.select(
        *series,
        F.array(
            *[
                F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_part{k}")
                for k in range(len(probs))
            ]
        ).alias("quantiles"),
    )
