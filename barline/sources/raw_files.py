"""Raw trade and candle files: discovery, reading, normalising, merging.

Lines come from the data source in ``line_source``, which cuts large files over tasks.  A line's
place in its file is the start of its part and its order within it, which does not depend on how
parts are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import (
    clean_name,
    clean_name_text,
    epoch_ms_of,
    finite,
    to_bool,
    to_double,
    to_long,
    utc_timestamp,
)
from ..operators.dedup import dedup_trades, keep_first_dealt, per_file
from ..session import written
from .line_source import scan_lines

# Column order of headerless candle files.
KLINE_COLUMNS = (
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_asset_volume",
    "number_of_trades",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "ignore",
)
# Column order of the merged candle table.
KLINE_OUTPUT = (
    "open_time_raw",
    "open_time",
    "open_time_utc",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time_raw",
    "close_time",
    "close_time_utc",
    "quote_asset_volume",
    "number_of_trades",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "ignore",
)
KLINE_INTEGERS = ("number_of_trades", "ignore")
# Column names of headerless trade files by their width.
TRADE_COLUMNS = {
    7: ("tradeId", "price", "qty", "quoteQty", "time", "isBuyerMaker", "isBestMatch"),
    6: ("tradeId", "price", "qty", "time", "isBuyerMaker", "isBestMatch"),
    5: ("tradeId", "price", "qty", "time", "isBuyerMaker"),
    4: ("price", "qty", "time", "isBuyerMaker"),
    3: ("price", "qty", "time"),
}
# Names accepted for each trade column, best first.
TRADE_ALIASES = {
    "trade_id": ("tradeId", "id", "a"),
    "price": ("price", "p"),
    "qty": ("qty", "quantity", "q"),
    "time": ("time", "timestamp", "transactTime", "t"),
    "isBuyerMaker": ("isBuyerMaker", "buyerMaker", "m"),
}
# A first line with three of these is a header.
KLINE_HEADER = ("opentime", "open", "high", "low", "close", "volume", "closetime")
TRADE_HEADER = (
    "id",
    "tradeid",
    "price",
    "qty",
    "quantity",
    "quoteqty",
    "time",
    "timestamp",
    "isbuyermaker",
)
TRADE_OUTPUT = ("time", "price", "qty", "isBuyerMaker", "trade_id")


def find_files(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Files that match any pattern, once each, with their size and the date their name holds.

    ``sort_key`` orders files by year, month, day (1 if absent) and lower-case
    name; names without a date come last.  Empty files are listed too: they
    count where the presence of a file decides.
    """
    conf = spark._jsc.hadoopConfiguration()
    sizes: dict[str, int] = {}
    for pattern in patterns:
        glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = glob.getFileSystem(conf).globStatus(glob)
        sizes |= {s.getPath().toString(): s.getLen() for s in found or [] if s.isFile()}
    found = spark.createDataFrame(sorted(sizes.items()), "path string, size long")
    name = F.element_at(F.split("path", "/"), -1)
    date = r"(\d{4})-(\d{2})(?:-(\d{2}))?"

    def part(k: int, otherwise: int) -> Column:
        text = F.regexp_extract(name, date, k)
        dated = F.coalesce(text.try_cast("int"), F.lit(1))
        return F.when(name.rlike(date), dated).otherwise(otherwise)

    return found.select(
        "path",
        "size",
        name.alias("file_name"),
        F.struct(
            part(1, 9999).alias("year"),
            part(2, 12).alias("month"),
            part(3, 31).alias("day"),
            F.lower(name).alias("name"),
        ).alias("sort_key"),
    )


@dataclass(frozen=True)
class RawFile:
    """A file of a symbol; rank orders the files of one symbol."""

    path: str
    size: int
    symbol: str
    grain: str
    rank: int


def _of_symbols(spark: SparkSession, root: str, symbols: Sequence[str], kind: str, endings: Sequence[str]) -> DataFrame:
    """Files below ``<root>/spot/<grain>/<kind>`` of all symbols, in one listing."""
    folders = [(f"/spot/{g}/{kind.format(symbol=s)}", g, s) for g in ("daily", "monthly") for s in symbols]
    found = find_files(spark, [f"{root.rstrip('/')}{folder}/*.{e}" for folder, _, _ in folders for e in endings])
    known = spark.createDataFrame(folders, "folder string, grain string, symbol string")
    folder = F.regexp_extract("path", r"^.*(/spot/(?:daily|monthly)/.*)/[^/]*$", 1)
    return found.withColumn("folder", folder).join(known, "folder")


def _ranked(files: DataFrame, *order: str | Column) -> list[RawFile]:
    """Files of every symbol in order; the reader needs the list on the driver anyway."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(*order))
    rows = files.withColumn("rank", rank).orderBy("symbol", "rank").select("path", "size", "symbol", "grain", "rank")
    return [RawFile(**r.asDict()) for r in rows.collect()]


def trade_files(spark: SparkSession, root: str, symbols: Sequence[str]) -> list[RawFile]:
    """Daily trade files of each symbol that has any, else its monthly ones, by the date of their names."""
    found = _of_symbols(spark, root, symbols, "trades/{symbol}", ("csv", "zip"))
    daily = F.bool_or(F.col("grain") == "daily").over(Window.partitionBy("symbol"))
    chosen = found.withColumn("has_daily", daily).where(F.col("has_daily") == (F.col("grain") == "daily"))
    return _ranked(chosen, "sort_key", "path")


def kline_files(spark: SparkSession, root: str, symbols: Sequence[str]) -> list[RawFile]:
    """Monthly and then daily candle files of each symbol, each by path; archives are not read."""
    found = _of_symbols(spark, root, symbols, "klines/{symbol}/1m", ("csv",))
    return _ranked(found, F.col("grain") == "daily", "path")


def trade_paths(spark: SparkSession, root: str, symbol: str) -> tuple[list[str], str]:
    """Daily trade files of a symbol if there are any, else the monthly ones."""
    files = trade_files(spark, root, [symbol])
    return [f.path for f in files], files[0].grain if files else "none"


def kline_paths(spark: SparkSession, root: str, symbol: str) -> list[str]:
    """Monthly and then daily candle files, each by path; archives are not read."""
    return [f.path for f in kline_files(spark, root, [symbol])]


def _sized(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Full paths and sizes; a path that isn't there is left for its reader to report."""
    conf, sizes = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        full = system.makeQualified(path)
        sizes.append((full.toString(), system.getFileStatus(full).getLen() if system.exists(full) else 0))
    return sizes


def _check_names(paths: Sequence[str]) -> None:
    unknown = sorted(p for p in paths if not p.lower().endswith((".csv", ".zip")))
    if unknown:
        raise ValueError(f"neither CSV nor ZIP: {unknown}")


def read_lines(spark: SparkSession, paths: Sequence[str], heads: bool = False) -> DataFrame:
    """Lines of CSV files and of the first CSV inside each ZIP archive, or their first lines alone.

    A file that cannot be read to its end gives one row with ``error`` and no line after those read.
    """
    _check_names(paths)
    return scan_lines(spark, _sized(spark, paths), heads)


def rejected_files(lines: DataFrame) -> DataFrame:
    return lines.where("error IS NOT NULL").select("source_file", "error")


def split_fields(line: Column) -> Column:
    """Comma-separated fields; commas inside double quotes do not split."""
    plain = F.split(line, ",", -1)
    quoted = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = F.transform(quoted, lambda f: F.regexp_replace(f, r'^\s*"(.*)"\s*$', "$1"))
    return F.when(line.contains('"'), bare).otherwise(plain)


def header_like(fields: Column, known: Sequence[str]) -> Column:
    """At least three distinct known names among the cleaned fields."""
    cleaned = F.array_distinct(F.transform(fields, clean_name))
    return F.size(F.array_intersect(cleaned, F.array(*[F.lit(k) for k in known]))) >= 3


def _readable(rows: DataFrame, files: int | None) -> DataFrame:
    """Rows of the files without an error.

    A file with an unreadable part is left out as a whole, as it would be if it
    were read in one piece.
    """
    broken = rejected_files(rows).select("source_file").distinct()
    return rows.where("error IS NULL").join(per_file(broken, files), "source_file", "left_anti").drop("error")


def _with_fields(lines: DataFrame) -> DataFrame:
    position = F.struct("split_start", "nth")
    kept = [c for c in lines.columns if c == "error"]
    return lines.select("source_file", position.alias("position"), split_fields(F.col("line")).alias("fields"), *kept)


def _first_lines(rows: DataFrame, files: int | None) -> DataFrame:
    """The first line of each file; it lies in the split that starts the file.

    The smallest place is found first: that aggregates one number per line in a
    hash table, where carrying the fields along would sort all lines.
    """
    starts = rows.where("position.split_start = 0")
    places = starts.groupBy("source_file").agg(F.min("position.nth").alias("_nth"))
    return (
        starts.join(per_file(places, files), "source_file")
        .where("position.nth = _nth")
        .select("source_file", F.col("fields").alias("first"))
    )


def _layouts(lines: DataFrame, files: int | None, heads: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows with fields, and the fields of the first line of each file.

    Without ``heads``, files with an error are left out and the first lines are looked up.
    """
    if heads is None:
        rows = _with_fields(_readable(lines, files))
        return rows, _first_lines(rows, files)
    firsts = heads.where("error IS NULL").select("source_file", split_fields(F.col("line")).alias("first"))
    return _with_fields(lines), firsts


def _data_rows(rows: DataFrame, layouts: DataFrame, files: int | None) -> DataFrame:
    """Rows with the layout of their file, without its header; rows with an error stay."""
    data = rows.join(per_file(layouts, files), "source_file", "left")
    return data.where(~F.coalesce(_repeats_header(), F.lit(False)))


def _repeats_header() -> Column:
    """The header itself, or a line equal to it, which holds no data either."""
    return F.col("headed") & (F.col("fields") == F.col("first"))


def _known_rows(rows: DataFrame, time: str) -> DataFrame:
    """Rows with a time; where errors are kept, those too."""
    return rows.where(f"{time} IS NOT NULL" + (" OR error IS NOT NULL" if "error" in rows.columns else ""))


def normalize_klines(lines: DataFrame, files: int | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Candle lines to the merged layout, with file and position; rows without a time drop.

    With the first lines of all files as ``heads`` the lines are read once, and a file with an
    error keeps its rows beside one that holds the ``error``.
    """
    rows, firsts = _layouts(lines, files, heads)
    layouts = firsts.withColumn("headed", header_like(F.col("first"), KLINE_HEADER))
    data = _data_rows(rows, layouts, files)
    kept = [c for c in rows.columns if c != "fields"]
    raw = data.select(
        *kept,
        *[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(KLINE_COLUMNS)],
    )
    typed = {}
    for c in KLINE_COLUMNS:
        if c not in ("open_time", "close_time"):
            typed[c] = to_long(c) if c in KLINE_INTEGERS else to_double(c)
    times = ("open_time", "close_time")
    for c in times:
        typed |= {f"{c}_raw": to_long(c), f"_{c}": finite(to_double(c))}
    out = raw.withColumns(typed)
    out = out.withColumns({c: epoch_ms_of(f"{c}_raw", f"_{c}") for c in times})
    out = _known_rows(out, "open_time").withColumns({f"{c}_utc": utc_timestamp(c) for c in times})
    return out.select(*kept, *KLINE_OUTPUT)


def _field_places(first: Column, headed: Column) -> dict[str, Column]:
    """For each trade column its place in the fields, or NULL."""
    names = F.transform(first, clean_name)
    width = F.least(F.size(first), F.lit(7))
    places = {}
    for column, aliases in TRADE_ALIASES.items():
        cleaned = [clean_name_text(a) for a in aliases]
        found = [F.array_position(names, a) for a in cleaned]
        by_name = F.coalesce(*[F.when(p > 0, p) for p in found])
        by_width = None
        for w, defaults in TRADE_COLUMNS.items():
            held = [clean_name_text(d) for d in defaults]
            at = next((held.index(a) + 1 for a in cleaned if a in held), None)
            if at:
                by_width = (F if by_width is None else by_width).when(width == w, at)
        places[column] = F.when(headed, by_name).otherwise(by_width).cast("int")
    return places


def normalize_trades(lines: DataFrame, files: int | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Trade lines of any known layout to one schema; rows without a time drop.

    Each file's layout is read off its first line, so one row per file decides
    where the columns of all its lines are.  With the first lines of all files as
    ``heads`` the lines are read once, and a file with an error keeps its rows
    beside one that holds the ``error``.
    """
    rows, firsts = _layouts(lines, files, heads)
    firsts = firsts.withColumn("headed", header_like(F.col("first"), TRADE_HEADER))
    places = {f"_at_{c}": p for c, p in _field_places(F.col("first"), F.col("headed")).items()}
    layouts = firsts.select("source_file", "first", "headed", *[p.alias(c) for c, p in places.items()])
    data = _data_rows(rows, layouts, files)
    kept = [c for c in rows.columns if c != "fields"]

    def text(c: str) -> Column:
        return F.get("fields", F.col(f"_at_{c}") - 1)

    # one parse per step: a text is split, then read, then interpreted
    texts = data.select(*kept, *[text(c).alias(c) for c in TRADE_OUTPUT])
    parsed = texts.select(
        *kept,
        to_long("time").alias("whole"),
        finite(to_double("time")).alias("number"),
        to_double("price").alias("price"),
        to_double("qty").alias("qty"),
        to_bool("isBuyerMaker").alias("isBuyerMaker"),
        to_long("trade_id").alias("trade_id"),
    )
    return _known_rows(parsed.select(*kept, epoch_ms_of("whole", "number").alias("time"), *TRADE_OUTPUT[1:]), "time")


@dataclass
class Merged:
    """rows: the kept rows with symbol, source_file, rank and position; report: one row per file.

    The report holds kind, symbol, grain, rank, source_file, rows_read (with a time), rows_kept
    and, where a file was left out, its error.
    """

    rows: DataFrame
    report: DataFrame


def _parsed_files(spark: SparkSession, files: Sequence[RawFile], normalize, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Typed rows of readable files with symbol and rank, written once, the files with their errors, and the number of rows written."""
    sizes = [(f.path, f.size) for f in files]
    listed = spark.createDataFrame(
        [(f.path, f.symbol, f.grain, f.rank) for f in files], "source_file string, symbol string, grain string, rank int"
    )
    heads = written(scan_lines(spark, sizes, heads=True), f"{name}_heads")
    parsed = written(normalize(scan_lines(spark, sizes), len(files), heads), name)
    errors = rejected_files(parsed).groupBy("source_file").agg(F.min("error").alias("error"))
    listed = listed.join(per_file(errors, len(files)), "source_file", "left")
    rows = _readable(parsed, len(files)).join(per_file(listed.select("source_file", "symbol", "rank"), len(files)), "source_file")
    return rows, listed, parsed.count()


def _merged(kind: str, parsed: DataFrame, kept: DataFrame, listed: DataFrame, files: int) -> Merged:
    kept = written(kept, f"kept_{kind}")
    read = parsed.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_read"))
    left = kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_kept"))
    report = listed.join(per_file(read, files), "source_file", "left").join(per_file(left, files), "source_file", "left")
    report = report.na.fill(0, ["rows_read", "rows_kept"]).withColumn("kind", F.lit(kind))
    return Merged(kept, report.select("kind", "symbol", "grain", "rank", "source_file", "rows_read", "rows_kept", "error"))


def merge_kline_files(spark: SparkSession, files: Sequence[RawFile]) -> Merged:
    """One candle per symbol and open time: the first one over the symbol's files in order of rank."""
    _check_names([f.path for f in files])
    parsed, listed, rows = _parsed_files(spark, files, normalize_klines, "parsed_klines")
    kept = keep_first_dealt(parsed, ["symbol", "open_time"], ["rank", "position"], rows)
    return _merged("klines", parsed, kept, listed, len(files))


def merge_trade_files(spark: SparkSession, files: Sequence[RawFile]) -> Merged:
    """Trades of all files of all symbols, each file without its own repeats."""
    _check_names([f.path for f in files])
    parsed, listed, rows = _parsed_files(spark, files, normalize_trades, "parsed_trades")
    kept = dedup_trades(parsed, files=len(files), rows=rows)
    return _merged("trades", parsed, kept, listed, len(files))


def _as_files(spark: SparkSession, paths: Sequence[str]) -> list[RawFile]:
    return [RawFile(p, size, "", "", rank) for rank, (p, size) in enumerate(_sized(spark, paths))]


def merge_klines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One candle per open time: the first one over the files in the given order."""
    return merge_kline_files(spark, _as_files(spark, paths)).rows.select(*KLINE_OUTPUT)


def merge_trades(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Trades of all files, each file without its own repeats, and the rejected files."""
    merged = merge_trade_files(spark, _as_files(spark, paths))
    return merged.rows.select(*TRADE_OUTPUT, "source_file"), rejected_files(merged.report)
