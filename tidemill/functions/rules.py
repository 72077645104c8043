"""What makes a bar or a signal row wrong, and small expressions on positions and metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import PRICES, fill_volume

# What is done about faulty bars.
POLICIES = {
    "datetime_policy": "parse_sort_fail_on_duplicate",
    "duplicate_datetime_policy": "fail",
    "missing_ohlc_policy": "fail",
    "missing_volume_policy": "fill_zero",
}


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False))


def bar_rules() -> dict[str, Column]:
    """rule -> whether a bar breaks it, in the order in which they are reported; repeated is a column of mark_repeated()."""
    o, h, low, c = (F.col(x) for x in PRICES)
    broken = lambda x: F.coalesce(x, F.lit(False))  # noqa: E731  a comparison with null breaks no further rule
    any_of = lambda f: f(o) | f(h) | f(low) | f(c)
    return {
        "datetime_missing": F.col("ts").isNull(),
        "datetime_repeated": F.col("ts").isNotNull() & (F.col("_same") > 1),
        "price_missing": any_of(lambda x: x.isNull()),
        "price_not_finite": any_of(lambda x: x.isNotNull() & ~finite(x)),
        "price_not_positive": any_of(lambda x: broken(x <= 0)),
        "high_below_low": broken(h < low),
        "high_below_open": broken(h < o),
        "high_below_close": broken(h < c),
        "low_above_open": broken(low > o),
        "low_above_close": broken(low > c),
        "volume_not_numeric": broken(F.isnan("volume")),
    }


def mark_repeated(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_same", F.count("*").over(Window.partitionBy("symbol", "ts")))


def bar_violations(bars: DataFrame) -> DataFrame:
    """The bars that break a rule, with the list of rules."""
    found = F.filter(F.array(*[F.when(x, F.lit(k)) for k, x in bar_rules().items()]), lambda x: x.isNotNull())
    return mark_repeated(bars).withColumn("violations", found).drop("_same").filter(F.size("violations") > 0)


def bar_quality(bars: DataFrame) -> DataFrame:
    """For each symbol: rows, rows without volume, how many break each rule, and the first rule broken (null: accepted).

    One broken rule rejects all rows of a symbol: gaps would change every window after them.  Missing volume is filled.
    """
    rules = bar_rules()
    counts = mark_repeated(bars).groupBy("symbol").agg(
        F.count("*").alias("source_row_count"),
        F.count_if(F.col("volume").isNull()).alias("volume_missing_row_count"),
        *[F.count_if(x).alias(k) for k, x in rules.items()],
    )
    counts = counts.withColumn("first_violation", F.coalesce(*[F.when(F.col(k) > 0, F.lit(k)) for k in rules]))
    accepted = F.when(F.col("first_violation").isNull(), F.col("source_row_count")).otherwise(F.lit(0)).cast("long")
    return counts.withColumns(
        {"accepted_row_count": accepted, "duplicate_row_count": F.col("datetime_repeated")} | {k: F.lit(v) for k, v in POLICIES.items()}
    )


def with_status(bars: DataFrame) -> DataFrame:
    """bars with status: ok, or the first rule that any bar of the symbol breaks.

    Rows are dealt out by symbol and ordered in time, as the windows of a backtest ask for, so this pass adds no shuffle to theirs.
    """
    rules = bar_rules()
    w = Window.partitionBy("symbol").orderBy("ts")
    same = F.when((F.lag("ts").over(w) == F.col("ts")) | (F.lead("ts").over(w) == F.col("ts")), 2).otherwise(1)
    number = F.coalesce(*[F.when(x, F.lit(i)) for i, x in enumerate(rules.values())])
    names = F.array(*[F.lit(k) for k in rules])
    first = F.min("_rule").over(Window.partitionBy("symbol"))
    df = bars.withColumn("_same", same).withColumn("_rule", number).withColumn("_first", first)
    return df.withColumn("status", F.coalesce(F.get(names, F.col("_first")), F.lit("ok"))).drop("_same", "_rule", "_first")


def sound_bars(bars: DataFrame) -> DataFrame:
    """The bars of symbols without a fault, missing volume as 0: what every workflow works on."""
    return fill_volume(with_status(bars).filter("status = 'ok'").drop("status"))


def with_faulty(runs: DataFrame, bars: DataFrame) -> DataFrame:
    """runs of a workflow with status ok, and a row for each symbol that was set aside, with the rule that its bars break."""
    bad = with_status(bars).filter("status <> 'ok'").groupBy("symbol").agg(F.first("status").alias("status"))
    return runs.withColumn("status", F.lit("ok")).unionByName(bad, allowMissingColumns=True)


def accepted_bars(bars: DataFrame) -> DataFrame:
    """The bars of symbols that break no rule, missing volume as 0; bar_quality() tells why others are not there."""
    bad = bar_violations(bars).select("symbol").distinct().withColumnRenamed("symbol", "_bad")
    return fill_volume(bars.join(bad.hint("merge"), F.col("symbol").eqNullSafe(F.col("_bad")), "left_anti"))


def checked_bars(bars: DataFrame) -> DataFrame:
    """The bars, missing volume as 0, if no rule is broken and there are any; else an error that names some symbols and rules."""
    found = bar_quality(bars).select("symbol", "first_violation").orderBy(F.col("first_violation").isNull(), "symbol").limit(5).collect()
    if not found:
        raise ValueError("there are no bars")
    if bad := [f"{r['symbol']}: {r['first_violation']}" for r in found if r["first_violation"]]:
        raise ValueError("bars break rules: " + ", ".join(bad))
    return fill_volume(bars)


def signal_rules() -> dict[str, Column]:
    """The same for external signals: no null, one row a time, known by then, zero or one."""
    at, known, binary = F.col("ts"), F.col("available_at"), F.col("signal_binary")
    return {
        "datetime_missing": at.isNull(),
        "available_at_missing": known.isNull(),
        "symbol_missing": F.col("symbol").isNull(),
        "signal_missing": binary.isNull(),
        "datetime_repeated": at.isNotNull() & (F.col("_same") > 1),
        "available_too_late": F.coalesce(known > at, F.lit(False)),
        "signal_not_binary": F.coalesce(~binary.isin(0, 1), F.lit(False)),
    }


def signal_violations(signals: DataFrame) -> DataFrame:
    """The signal rows that break a rule, with the list of rules."""
    found = F.filter(F.array(*[F.when(x, F.lit(k)) for k, x in signal_rules().items()]), lambda x: x.isNotNull())
    return mark_repeated(signals).withColumn("violations", found).drop("_same").filter(F.size("violations") > 0)


def signal_quality(signals: DataFrame) -> DataFrame:
    rules = signal_rules()
    counts = mark_repeated(signals).groupBy("symbol").agg(F.count("*").alias("rows"), *[F.count_if(x).alias(k) for k, x in rules.items()])
    return counts.withColumn("first_violation", F.coalesce(*[F.when(F.col(k) > 0, F.lit(k)) for k in rules]))


def long_only(target: Column) -> Column:
    """A target position between 0 and 1; missing is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(target, F.lit(0.0)), F.lit(0.0))))


def score() -> Column:
    """The composite score of a run's metrics."""
    c = F.col
    return c("annualized_return") + 0.2 * c("sharpe_ratio") + 0.1 * c("win_rate") - 2.0 * F.abs("max_drawdown") - 0.01 * c("turnover") / c("bar_count")


def passes(max_drawdown_cap: float | None, min_trade_count: int | None) -> Column:
    """Whether a run is within the limits; no limit is null, and a limit itself is within."""
    ok = F.lit(True)
    if max_drawdown_cap is not None:
        ok = ok & (F.col("max_drawdown") >= -abs(max_drawdown_cap))
    return ok if min_trade_count is None else ok & (F.col("trade_count") >= min_trade_count)
