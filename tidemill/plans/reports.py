"""The tables that runs are reported in: columns and order as readers of such reports know them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import parameter_names, parameters_json
from ..operators.signals import parameters_of

# Columns of reports.
RANKED = ["total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "win_rate", "turnover", "trade_count", "score"]
FOLD_METRICS = [
    "train_score",
    "train_total_return",
    "train_sharpe_ratio",
    "test_total_return",
    "test_annualized_return",
    "test_sharpe_ratio",
    "test_max_drawdown",
    "test_win_rate",
    "test_turnover",
    "test_trade_count",
    "benchmark_total_return",
    "benchmark_max_drawdown",
]
COMPARISON = [
    "train_score",
    "test_score",
    "train_total_return",
    "test_total_return",
    "train_sharpe_ratio",
    "test_sharpe_ratio",
    "train_max_drawdown",
    "test_max_drawdown",
    "test_trade_count",
    "test_bar_count",
    "benchmark_total_return",
    "return_excess",
    "permutation_status",
    "empirical_p_value",
]


def _used(grid: dict) -> list[str]:
    """The parameters of a grid's families, in their order."""
    return [p for p in parameter_names(grid) if any(p in lists for lists in grid.values())]


def ranked_results(ranked: DataFrame, keys: list[str], grid: dict) -> DataFrame:
    """(keys, rank, strategy, the grid's parameters, metrics, score): no bar counts."""
    return ranked.select(*keys, "rank", "strategy", *_used(grid), *RANKED)


def fold_results(folds: DataFrame, grid: dict) -> DataFrame:
    """(symbol, fold_index, bounds of the fold, the winner's parameters, train, test and benchmark metrics)."""
    return folds.select(
        "symbol",
        F.col("fold").alias("fold_index"),
        "train_start",
        "train_end",
        "test_start",
        "test_end",
        *_used(grid),
        *FOLD_METRICS,
    )


def comparison_results(compared: DataFrame) -> DataFrame:
    """(symbol, comparison_rank, strategy_name, selected_parameters as JSON, metrics of both sides, statuses and verdicts)."""
    verdicts = [F.col("research_verdict").alias("research_policy_verdict"), F.col("candidate_verdict").alias("candidate_policy_verdict")]
    return compared.select(
        "symbol",
        "comparison_rank",
        F.col("strategy").alias("strategy_name"),
        parameters_json(parameters_of(compared.columns)).alias("selected_parameters"),
        *COMPARISON,
        *verdicts,
    )


def nested_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary): all that is known of each run as one struct, metrics of train, test and benchmark nested in it."""
    side = lambda p: F.struct(*[F.col(c).alias(c.removeprefix(p)) for c in runs.columns if c.startswith(p)]).alias(p.rstrip("_"))
    sides = [p for p in ("train_", "test_", "benchmark_", "low_cost_", "base_cost_", "high_cost_") if any(c.startswith(p) for c in runs.columns)]
    rest = [c for c in runs.columns if c not in keys and not any(c.startswith(p) for p in sides)]
    return runs.select(*keys, F.struct(*rest, *map(side, sides)).alias("summary"))
