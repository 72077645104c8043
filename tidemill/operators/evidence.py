"""Evidence on selected candidates: costs, degradation, benchmark comparison, aggregates over folds, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import Config, equity, metrics, positions

#: Cost scenarios and what they multiply both cost rates by.
SCENARIOS = {"low_cost": 0.5, "base_cost": 1.0, "high_cost": 2.0}
#: Verdicts of the research policy, best first.
VERDICT_ORDER = ["promote", "blocked", "reject"]


def text_array(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def cost_sensitivity(df: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """Annualised return, Sharpe ratio and drawdown of every run at each cost level, and whether costs decide.

    Positions don't depend on costs: they are made once, and rows are repeated three times after that.
    """
    rate = config.fee + config.slippage
    levels = F.explode(F.create_map(*[x for k, v in SCENARIOS.items() for x in (F.lit(k), F.lit(v))]))
    run = [*keys, "scenario"]
    curve = equity(positions(df, keys).select("*", levels.alias("scenario", "_m")), run, F.lit(rate) * F.col("_m"), config.capital)
    found = metrics(curve, run, config)
    of = lambda k, c: F.max(F.when(F.col("scenario") == k, F.col(c))).alias(f"{k}_{c}")
    wide = found.groupBy(*keys).agg(*[of(k, c) for k in SCENARIOS for c in ("annualized_return", "sharpe_ratio", "max_drawdown")])
    good = {k: (F.col(f"{k}_annualized_return") > 0) & (F.col(f"{k}_sharpe_ratio") > 0) for k in SCENARIOS}
    fragile = good["low_cost"] & ~(good["base_cost"] & good["high_cost"])
    return wide.withColumn("cost_verdict", F.when(fragile, "cost_fragile").otherwise("stable"))


def train_and_test(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the same runs side by side, and how much worse (below 0) the test is."""
    names = ["total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "win_rate", "turnover", "trade_count", "bar_count", "score"]
    left = train.select(*keys, *[F.col(c).alias(f"train_{c}") for c in names])
    right = test.select(*keys, *[F.col(c).alias(f"test_{c}") for c in names])
    df = left.join(right.hint("merge"), keys)
    change = lambda c: F.col(f"test_{c}") - F.col(f"train_{c}")
    return df.withColumns(
        {
            "return_degradation": change("annualized_return"),
            "sharpe_degradation": change("sharpe_ratio"),
            "max_drawdown_delta": change("max_drawdown"),
        }
    )


def against_benchmark(runs: DataFrame, benchmark: DataFrame, keys: list[str], prefix: str = "test_") -> DataFrame:
    """runs with the benchmark of their segment (0 where there is none), the excess return and the drawdown gap."""
    df = runs.join(benchmark.hint("merge"), keys, "left").fillna(0.0, ["benchmark_total_return", "benchmark_max_drawdown"])
    return df.withColumn("return_excess", F.col(f"{prefix}total_return") - F.col("benchmark_total_return")).withColumn(
        "max_drawdown_gap",
        F.col(f"{prefix}max_drawdown") - F.col("benchmark_max_drawdown"),
    )


def fold_aggregates(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the folds of walk-forward tests and their benchmarks; the worst drawdown; the sum of trades."""
    t = lambda c: F.col(f"test_{c}")
    return folds.groupBy(*keys).agg(
        F.count("*").alias("fold_count"),
        F.avg(t("total_return")).alias("mean_test_total_return"),
        F.avg(t("sharpe_ratio")).alias("mean_test_sharpe_ratio"),
        F.avg(t("max_drawdown")).alias("mean_test_max_drawdown"),
        F.min(t("max_drawdown")).alias("worst_test_max_drawdown"),
        F.avg(t("win_rate")).alias("mean_test_win_rate"),
        F.avg(t("turnover")).alias("mean_test_turnover"),
        F.sum(t("trade_count")).alias("total_test_trade_count"),
        F.avg("benchmark_total_return").alias("mean_benchmark_total_return"),
        F.avg("benchmark_max_drawdown").alias("mean_benchmark_max_drawdown"),
        F.avg("return_excess").alias("mean_excess_return"),
    )


def pooled_sharpe(curve: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """(keys, pooled_test_sharpe_ratio): the Sharpe ratio over the returns of all folds together, 0 without spread."""
    r = F.col("strategy_return")
    sd = F.stddev_samp(r)
    usable = (F.count("*") >= 2) & sd.isNotNull() & ~F.isnan(sd) & (sd != 0)
    return curve.groupBy(*keys).agg(
        F.when(usable, F.avg(r) / F.nullif(sd, F.lit(0.0)) * config.annualization**0.5).otherwise(0.0).alias("pooled_test_sharpe_ratio")
    )


def derived_verdict(search: Column, train: Column, test: Column, folds: Column | None = None, rejected: Column | None = None) -> Column:
    """What can be said from which evidence exists, before any policy."""
    inconclusive = (folds <= 0) if folds is not None else F.lit(False)
    v = F.when(train & test & inconclusive, "inconclusive").when(train & test, "validated").when(search, "candidate").otherwise("inconclusive")
    return v if rejected is None else F.when(rejected, "rejected").otherwise(v)


def fold_coverage_verdict(folds: Column, validated: Column, skipped: Column) -> Column:
    return F.when((folds == 0) | (skipped > 0) | (validated <= 0), "inconclusive").otherwise("validated")


def permutation_status(
    enabled: bool,
    error: Column,
    p: Column,
    most: float | None,
    null_model: Column,
    model: str | None,
    scope: Column,
    wanted: str | None,
) -> Column:
    """skipped, error, completed_failed or completed_passed; the p-value is looked at before model and scope."""
    if not enabled:
        return F.lit("skipped")
    c = F.when(error | p.isNull(), "error")
    if most is not None:
        c = c.when(p > most, "completed_failed")
    if model is not None:
        c = c.when(F.coalesce(null_model != model, F.lit(True)), "error")
    if wanted is not None:
        c = c.when(F.coalesce(scope, F.lit("candidate_fixed")) != wanted, "error")
    return c.otherwise("completed_passed")
