"""Price bars: reading, normalising, and building them from ticks or exchange payloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
COLUMNS = ["symbol", "ts", *PRICES, "volume"]
SIGNALS = ["datetime", "available_at", "symbol", "signal_name", "signal_value", "signal_binary", "source"]
#: Other names of the time column.
ALIASES = {"date": "datetime", "timestamp": "datetime"}


def standard_columns(df: DataFrame, required: list[str], time_column: str = "datetime", aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Names trimmed and lower-cased, the time column and its aliases renamed, required columns kept, all else pruned."""
    rename = {**aliases, time_column.strip().lower(): "datetime"}
    found: dict[str, str] = {}
    for c in df.columns:
        name = c.strip().lower()
        found.setdefault(rename.get(name, name), c)
    if missing := [c for c in required if c not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{found[c]}`").alias(c) for c in required])


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, time_column: str = "datetime", fmt: str = "csv") -> DataFrame:
    """Bars of one symbol (given) or of a panel (a symbol column in the files); a value that is no number is an error."""
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    own = ["symbol"] if symbol is None else []
    df = standard_columns(df, [*own, "datetime", *PRICES, "volume"], time_column)
    name = F.col("symbol") if symbol is None else F.lit(symbol)
    return df.select(
        name.alias("symbol"),
        F.col("datetime").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in [*PRICES, "volume"]],
    )


def read_signals(spark: SparkSession, path: str, time_column: str = "datetime", fmt: str = "csv") -> DataFrame:
    """External signals: symbol, ts, available_at, signal_name, signal_value, signal_binary, source; all else is pruned."""
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    df = standard_columns(df, SIGNALS, time_column, {})
    kinds = {"available_at": "timestamp_ntz", "signal_value": "double", "signal_binary": "double"}
    times = F.col("datetime").cast("timestamp_ntz").alias("ts")
    return df.select("symbol", times, *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in SIGNALS if c not in ("symbol", "datetime")])


def bars_from_ticks(ticks: DataFrame, symbol: str, time: Column, price: str, order: str) -> DataFrame:
    """One bar for each symbol and time bucket; the close is the mean price in whole cents, the volume the number of ticks."""
    cents = F.sum(F.round(F.col(price) * 100).cast("long"))
    made = ticks.groupBy(F.col(symbol).alias("symbol"), time.cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (F.floor(cents / F.count("*")) / 100.0).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return made.select(*COLUMNS)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def fill_volume(bars: DataFrame) -> DataFrame:
    """Missing volume counts as zero."""
    return bars.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


# --- exchange payloads -------------------------------------------------------------------------------------------------


def roc_date(text: Column) -> Column:
    """"113/03/01" of the Republic of China calendar as a date; null if it is none."""
    part = F.split(F.trim(text), "/")
    year, month, day = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    return F.when(F.size(part) == 3, F.make_date(year + 1911, month, day))


def plain_number(text: Column) -> Column:
    """"24,167,721" as a double; "--", "---" and the empty string are null."""
    bare = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(bare.isin("--", "---", ""), None).otherwise(bare.cast("double"))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Bars from (symbol, ingest_order, payload): JSON texts {"stat": "OK", "data": [[date, volume, _, open, high, low, close, ..], ..]}.

    Payloads of another status and rows of fewer than eight cells are skipped.  Of a date that comes twice the last counts.
    """
    doc = F.from_json("payload", "stat string, data array<array<string>>")
    rows = payloads.select("symbol", "ingest_order", doc.alias("doc")).filter("doc.stat = 'OK'")
    rows = rows.select("symbol", "ingest_order", F.posexplode("doc.data").alias("pos", "cell")).filter(F.size("cell") >= 8)
    cell = lambda i: F.get("cell", F.lit(i))
    made = rows.select(
        "symbol",
        roc_date(cell(0)).cast("timestamp_ntz").alias("ts"),
        *[plain_number(cell(i)).alias(c) for i, c in ((3, "open"), (4, "high"), (5, "low"), (6, "close"), (1, "volume"))],
        F.struct("ingest_order", "pos").alias("_at"),
    )
    return latest(made, ["symbol", "ts"], "_at").drop("_at")


def month_starts(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month): "YYYYMM01" of every month from first to last, both "YYYY-MM"."""
    if first > last:
        raise ValueError("the first month must not come after the last")
    return spark.range(1).select(F.explode(months_between(*[F.lit(f"{x}-01").cast("date") for x in (first, last)])).alias("month"))


def months_between(first: Column, last: Column) -> Column:
    """"YYYYMM01" of every month from one date to another, as an array."""
    days = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(days, lambda d: F.date_format(d, "yyyyMMdd"))


# --- sinks -------------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet") -> None:
    """One folder for each value of by; rows are dealt out by them first, so that each folder gets few files."""
    out = df.repartition(*by).write if by else df.write
    out = out.partitionBy(*by) if by else out
    (out.option("header", True) if fmt == "csv" else out).format(fmt).mode("overwrite").save(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics, settings and nested summaries, one JSON object a row; columns that are null are written too."""
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)
