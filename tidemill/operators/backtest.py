"""Backtests of target positions: equity curves, trades, metrics, buy and hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import finite, long_only, score
from .signals import ordered


@dataclass(frozen=True)
class Config:
    """Capital, cost rates of a unit of turnover, and bars a year."""

    capital: float = 100_000.0
    fee: float = 0.001
    slippage: float = 0.0005
    annualization: float = 252.0


def so_far(keys: list[str]):
    return ordered(keys).rowsBetween(Window.unboundedPreceding, 0)


def positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with position (the target of the bar before), close_return and turnover; costs don't matter yet.

    A return that can't be told, as a close is missing or the one before it zero, is NaN: it stays in all metrics of its run, which
    ranks last, and stops no other run.
    """
    w = ordered(keys)
    df = df.withColumn("target_position", long_only(F.col("target_position")))
    before = F.lag(F.struct("close")).over(w)  # null only at the first bar
    told = F.coalesce(F.try_divide("close", before["close"]) - 1, F.lit(float("nan")))
    df = df.withColumn("position", F.coalesce(F.lag("target_position").over(w), F.lit(0.0))).withColumn(
        "close_return",
        F.when(before.isNull(), 0.0).otherwise(told),
    )
    return df.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))


def equity(df: DataFrame, keys: list[str], cost: Column, capital: float) -> DataFrame:
    """positions() with strategy_return, net of cost for each unit of turnover, and compounded equity."""
    df = df.withColumn("strategy_return", F.col("position") * F.col("close_return") - F.col("turnover") * cost)
    return df.withColumn("equity", capital * F.product(1 + F.col("strategy_return")).over(so_far(keys)))


def backtest(df: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """The equity curve of every run: bars and target_position in, position, returns, turnover and equity added."""
    return equity(positions(df, keys), keys, F.lit(config.fee + config.slippage), config.capital)


def trade_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """positions() with _entry and _exit: bars at which a trade begins, and after which it has ended."""
    before = F.coalesce(F.lag("position").over(ordered(keys)), F.lit(0.0))
    return df.withColumns({"_entry": (before == 0) & (F.col("position") > 0), "_exit": (before > 0) & (F.col("position") == 0)})


def trades(curve: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each round trip.  A trade still open at the last bar ends there, without exit cost.

    The gross return compounds closes of held bars; the net return compounds net returns of held bars and the exit bar.
    """
    df = trade_flags(curve, keys).withColumn("trade_id", F.sum(F.col("_entry").cast("long")).over(so_far(keys)))
    return trade_rows(df.filter("trade_id > 0 and (position > 0 or _exit)"), keys)


def trade_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The trades of bars that are held or end a trade, by trade_id: grouped aggregates, partial ones before the shuffle."""
    held = F.col("position") > 0
    made = df.groupBy(*keys, "trade_id").agg(
        F.min("ts").alias("entry_datetime"),
        F.max("ts").alias("exit_datetime"),
        F.min_by("close", "ts").alias("entry_price"),
        F.max_by("close", "ts").alias("exit_price"),
        F.count_if(held).alias("holding_period"),
        (F.product(F.when(held, 1 + F.col("close_return")).otherwise(1.0)) - 1).alias("trade_gross_return"),
        (F.product(1 + F.col("strategy_return")) - 1).alias("trade_net_return"),
        F.min_by("position", "ts").alias("entry_target_position"),
        F.max_by("target_position", "ts").alias("exit_target_position"),
    )
    return made.withColumn("cost_return_contribution", F.col("trade_gross_return") - F.col("trade_net_return"))


def drawdowns(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The curve with drawdown; below a highest equity of zero it is NaN."""
    return curve.withColumn("drawdown", ratio(F.col("equity"), F.max("equity").over(so_far(keys))) - 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or NaN where it can't be told."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def annual(total: Column, periods: Column, per_year: float) -> Column:
    """A total return as a yearly one; a loss of more than all has none (NaN)."""
    return annual_growth(1 + total, periods, per_year)


def annual_growth(growth: Column, periods: Column, per_year: float) -> Column:
    """The same from the factor of growth, which keeps its digits where almost all is lost."""
    return F.when(growth < 0, F.lit(float("nan"))).otherwise(F.pow(growth, per_year / F.greatest(periods, F.lit(1)).cast("double")) - 1)


def run_metrics(curve: DataFrame, keys: list[str], config: Config = Config(), risk_free: float = 0.0, extra: list[Column] | None = None) -> DataFrame:
    """Metrics that need no trades.  extra: further aggregates over each run's bars.  A curve may have drawdowns already."""
    r = F.col("strategy_return") - risk_free
    total = ratio(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1
    sd = F.stddev_samp(r)
    usable = (F.count("*") >= 2) & sd.isNotNull() & ~F.isnan(sd) & (sd != 0)
    df = (curve if "drawdown" in curve.columns else drawdowns(curve, keys)).groupBy(*keys).agg(
        total.alias("total_return"),
        annual(total, F.count("*") - 1, config.annualization).alias("annualized_return"),
        F.when(usable, F.avg(r) / F.nullif(sd, F.lit(0.0)) * config.annualization**0.5).otherwise(0.0).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
        F.count("*").alias("bar_count"),
        *(extra or []),
    )
    return df


def metrics(curve: DataFrame, keys: list[str], config: Config = Config(), extra: list[Column] | None = None) -> DataFrame:
    """The full metric report and score of every run, in one pass over its bars.

    Trades are not collected for it: a trade's net return is the equity at its last bar over that before its first one.  After
    a loss of exactly everything no trade counts as won.
    """
    w = ordered(keys)
    df = trade_flags(curve, keys).withColumns({"_prev": F.lag("equity").over(w), "_next": F.lead("ts").over(w)})
    df = df.withColumn("_base", F.last(F.when(F.col("_entry"), F.col("_prev")), ignorenulls=True).over(so_far(keys)))
    ends = F.col("_exit") | ((F.col("position") > 0) & F.col("_next").isNull())
    won = F.when(ends & (F.col("_base") != 0), F.col("equity") / F.col("_base") - 1 > 0)
    counts = [F.count_if("_entry").alias("trade_count"), F.count_if(won).alias("_won")]
    df = run_metrics(df, keys, config, extra=[*counts, *(extra or [])])
    rate = F.when(F.col("trade_count") > 0, F.col("_won") / F.nullif(F.col("trade_count"), F.lit(0))).otherwise(0.0)
    return df.withColumn("win_rate", rate).drop("_won").withColumn("score", score())


def buy_and_hold(bars: DataFrame, keys: list[str], capital: float = 100_000.0) -> DataFrame:
    """bars with the equity of holding from the first bar on; NaN where a close is missing or the first is zero."""
    first = F.first("close").over(ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumn("equity", capital * ratio(F.col("close"), first))


def buy_and_hold_summary(bars: DataFrame, keys: list[str], capital: float = 100_000.0) -> DataFrame:
    """Return and drawdown of holding, and benchmark_status: ok, or price_unusable where a close is missing, no number or not positive."""
    usable = finite(F.col("close")) & F.coalesce(F.col("close") > 0, F.lit(False))
    curve = drawdowns(buy_and_hold(bars, keys, capital), keys)
    return curve.groupBy(*keys).agg(
        (ratio(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("benchmark_total_return"),
        F.min("drawdown").alias("benchmark_max_drawdown"),
        F.when(F.every(usable), "ok").otherwise("price_unusable").alias("benchmark_status"),
    )


def trade_markers(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, price, kind): entries and exits of trades to draw on a chart."""
    one = lambda side: found.select(*keys, F.col(f"{side}_datetime").alias("ts"), F.col(f"{side}_price").alias("price"), F.lit(side).alias("kind"))
    return one("entry").unionByName(one("exit")).dropna(subset=["ts", "price"])
