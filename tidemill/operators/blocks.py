"""Runs of any length: bars of one run are dealt out by blocks, and what a window carries from block to block is joined back.

A run that is one task (one symbol of a billion ticks) can't be made faster by more machines.  Here rows are numbered from counts of
time buckets, cut into blocks of equal numbers of rows, each of which also holds the last rows of the block before, and all
windows that look back a bounded way run inside a block.  Products, maxima and counts since the first bar are aggregated by
block, accumulated over the few blocks of a run, and joined back: a second pass adds them to each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import Config, positions, run_metrics, trade_flags, trade_rows
from ..functions.rules import score

#: Rows of a block.
ROWS = 100_000


def seconds(ts: Column) -> Column:
    """A time without zone as seconds, in the same order."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def bucket_seconds(bars: DataFrame, keys: list[str], rows: int = ROWS) -> int:
    """A width of time buckets in which the densest run has about so many rows, if its bars are spread evenly."""
    at = seconds(F.col("ts"))
    runs = bars.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(at) - F.min(at) + 1).alias("span"))
    width = runs.agg(F.min(rows * F.col("span") / F.col("n"))).first()[0]
    return max(1, int(width or 1))


def numbered_by_buckets(bars: DataFrame, keys: list[str], width: int) -> DataFrame:
    """bars with idx, from 0 in time order in every run; a task holds one time bucket of a run.

    Bars without time come before all others.
    """
    if width <= 0:
        raise ValueError("the width must be positive")
    df = bars.withColumn("_bucket", F.coalesce(F.floor(seconds(F.col("ts")) / width), F.lit(-(2**62))).cast("long"))
    part = [*keys, "_bucket"]
    counts = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("ts")) - 1
    return joined(df.withColumn("_own", own), starts, part).withColumn("idx", F.col("_start") + F.col("_own")).drop("_bucket", "_start", "_own")


def joined(df: DataFrame, sums: DataFrame, part: list[str]) -> DataFrame:
    """df with what sums has for its block; keys may be null."""
    right = sums.select(*[F.col(c).alias(f"_r_{c}") for c in part], *[c for c in sums.columns if c not in part])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in part]
    return df.join(right.hint("merge"), same).drop(*[f"_r_{c}" for c in part])


def blocked(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Numbered rows with block and own: a block's own rows, and the halo rows before them again."""
    if not 0 <= halo <= size or size <= 0:
        raise ValueError("a block must hold at least as many rows as are looked back on")
    block, at = F.floor(F.col("idx") / size), F.col("idx") % size
    both = F.when(at >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("block", F.explode(both)).withColumn("own", F.floor(F.col("idx") / size) == F.col("block"))


def carried(df: DataFrame, keys: list[str], sums: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """df with what comes before its block.  sums: aggregates of a block; before: expressions on windows over earlier blocks.

    One row a block takes part, so even a very long run has few.
    """
    part = [*keys, "block"]
    each = df.groupBy(*part).agg(*[c.alias(k) for k, c in sums.items()])
    for k, c in before.items():
        each = each.withColumn(k, c)
    return joined(df, each.select(*part, *before), part)


def earlier_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def backtest(
    bars: DataFrame,
    keys: list[str],
    targets: Callable[[DataFrame, list[str]], DataFrame],
    look_back: int,
    config: Config = Config(),
    size: int = ROWS,
    width: int | None = None,
) -> DataFrame:
    """The equity curve of every run as backtest.backtest() makes it, with idx, drawdown and trade_id (0 before the first).

    targets(bars, keys) adds target_position and looks back on at most look_back bars, its own among them.  size: rows of a block; width: seconds of
    the time buckets that rows are numbered by, by default such that the densest run has size rows in one.
    """
    df = numbered_by_buckets(bars, keys, width or bucket_seconds(bars, keys, size))
    df = blocked(df, size, min(size, look_back + 2))
    part = [*keys, "block"]
    df = trade_flags(positions(targets(df, part), part), part).filter("own").drop("own")
    r = F.col("position") * F.col("close_return") - F.col("turnover") * (config.fee + config.slippage)
    df = df.withColumn("strategy_return", r)
    here = Window.partitionBy(*part).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_p": F.product(1 + F.col("strategy_return")).over(here), "_e": F.sum(F.col("_entry").cast("long")).over(here)})
    df = df.withColumn("_m", F.max("_p").over(here))
    w = earlier_blocks(keys)
    df = carried(
        df,
        keys,
        {"_bp": F.max_by("_p", "idx"), "_bm": F.max("_p"), "_be": F.max("_e")},
        {
            "_cp": F.coalesce(F.product("_bp").over(w), F.lit(1.0)),
            "_cm": F.max(F.col("_cp") * F.col("_bm")).over(w),
            "_ce": F.coalesce(F.sum("_be").over(w), F.lit(0)),
        },
    )
    growth = F.col("_cp") * F.col("_p")
    peak = F.greatest("_cm", F.col("_cp") * F.col("_m"))  # a null is passed over
    return df.withColumns(
        {"equity": config.capital * growth, "drawdown": growth / peak - 1, "trade_id": F.col("_ce") + F.col("_e")}
    ).drop("_p", "_m", "_e", "_bp", "_cp", "_cm", "_ce", "block")


def trades(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Round trips of a curve of backtest(): partial aggregates of a trade that spans blocks meet by its number."""
    return trade_rows(curve.filter("trade_id > 0 and (position > 0 or _exit)"), keys)


def metrics(curve: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """Metrics and score of every run of a curve of backtest(), all of them grouped aggregates."""
    found = trades(curve, keys).groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(
        F.count("*").alias("_trades"), F.count_if(F.col("trade_net_return") > 0).alias("_won")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    df = run_metrics(curve, keys, config).join(found.hint("merge"), same, "left").drop(*[f"_t_{k}" for k in keys])
    count = F.coalesce("_trades", F.lit(0))
    df = df.withColumns({"trade_count": count, "win_rate": F.when(count > 0, F.col("_won") / count).otherwise(0.0)})
    return df.drop("_trades", "_won").withColumn("score", score())
