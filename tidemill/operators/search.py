"""Candidates, their runs, and their ranking."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import passes
from .backtest import Config, backtest, metrics
from .signals import FAMILIES, candidate_targets, parameters_of

Grid = dict[str, dict[str, list[int]]]
#: The default grids.
GRID: Grid = {"ma_crossover": {"short_window": [5, 10, 20], "long_window": [50, 100, 150]}}
BREAKOUT: Grid = {"breakout": {"lookback_window": [10, 20, 30, 40, 60]}}
PARAMETERS = ["short_window", "long_window", "lookback_window"]
#: The most candidates of a grid: their list goes to every task.
MOST = 100_000


def parameter_names(grid: Grid) -> list[str]:
    """The columns that candidates of a grid have: PARAMETERS, and those of its other families."""
    return list(dict.fromkeys([*PARAMETERS, *(p for name in grid for p in FAMILIES[name].parameters)]))


def candidates(spark: SparkSession, grid: Grid) -> DataFrame:
    """(cand_id, strategy, parameters, is_valid) of every combination of the grid; a family without a valid one is an error.

    So is a grid of more than MOST combinations: it is searched in parts.
    """
    names, rows = parameter_names(grid), []
    for name, lists in sorted(grid.items()):
        family = FAMILIES[name]
        if set(lists) != set(family.parameters) or not all(lists.values()):
            raise ValueError(f"{name} takes values of {', '.join(family.parameters)}")
        if len(rows) + math.prod(map(len, lists.values())) > MOST:
            raise ValueError(f"a grid may have {MOST} combinations at most")
        combos = [dict(zip(family.parameters, v, strict=True)) for v in itertools.product(*(lists[p] for p in family.parameters))]
        if not any(map(family.valid, combos)):
            raise ValueError(f"{name} has no valid combination")
        for c in combos:
            cand = ":".join([name, *(f"{p}={c[p]}" for p in sorted(c))])
            rows.append((cand, name, *(c.get(p) for p in names), bool(family.valid(c))))
    return spark.createDataFrame(rows, "cand_id string, strategy string, " + ", ".join(f"{p} int" for p in names) + ", is_valid boolean")


def candidate_curves(bars: DataFrame, keys: list[str], found: DataFrame, grid: Grid, config: Config = Config()) -> DataFrame:
    """Equity curves of all valid candidates on all runs."""
    return backtest(candidate_targets(bars, keys, found, grid), [*keys, "cand_id"], config)


def candidate_metrics(
    bars: DataFrame,
    keys: list[str],
    found: DataFrame,
    grid: Grid,
    config: Config = Config(),
    extra: list[Column] | None = None,
) -> DataFrame:
    """Metrics and score of all valid candidates on all runs, with their parameters."""
    own = [F.first(c).alias(c) for c in ["strategy", *parameter_names(grid)]]
    return metrics(candidate_curves(bars, keys, found, grid, config), [*keys, "cand_id"], config, extra=[*own, *(extra or [])])


def ranked(runs: DataFrame, keys: list[str], max_drawdown_cap: float | None = None, min_trade_count: int | None = None) -> DataFrame:
    """The runs within the limits with rank: by score, then strategy, then parameters in the order of their names.

    A run whose score is no number comes after all others.
    """
    w = Window.partitionBy(*keys).orderBy(best_first("score"), "strategy", *sorted(parameters_of(runs.columns)))
    return runs.filter(passes(max_drawdown_cap, min_trade_count)).withColumn("rank", F.row_number().over(w))


def best_first(metric: str) -> Column:
    """The order of a metric from the highest down, what is no number last."""
    return F.nanvl(F.col(metric), F.lit(float("-inf"))).desc()


def candidate_id(cand: Column, start: Column, end: Column) -> Column:
    """The name of a candidate on a stretch of time."""
    return F.concat_ws(":", cand, F.concat_ws("-", *[F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in (start, end)]))


def parameters_json(columns: list[str] = PARAMETERS) -> Column:
    """The parameters that a candidate has, as JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def search_summary(rank: DataFrame, keys: list[str], found: DataFrame, top: int = 3) -> DataFrame:
    """For each run of keys: combinations tried and valid, results within the limits, the best, and the first few."""
    tried = found.agg(
        F.count("*").alias("attempted_combinations"),
        F.count_if("is_valid").alias("valid_combinations"),
        F.count_if(~F.col("is_valid")).alias("invalid_combinations"),
    )
    df = rank.groupBy(*keys).agg(
        F.count("*").alias("result_count"),
        F.max(F.when(F.col("rank") == 1, F.col("cand_id"))).alias("best_candidate"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "cand_id")))), lambda x: x["cand_id"]),
            ";",
        ).alias("top_candidates"),
    )
    return df.crossJoin(F.broadcast(tried))  # one row


def curve_label(rank: Column, short: Column, long: Column) -> Column:
    return F.concat(F.lit("Rank "), rank, F.lit(" | SW "), short, F.lit(" | LW "), long)
