"""The workflows: search on one segment, test on another, decide."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import sound_bars
from ..operators import evidence, nulls, policy, search, signals, splits
from ..operators.backtest import Config, backtest, buy_and_hold_summary, metrics
from ..sources.store import kept


def experiment(bars: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """Metrics, score and benchmark of bars with target_position."""
    runs = metrics(backtest(bars, keys, config), keys, config)
    return evidence.against_benchmark(runs, buy_and_hold_summary(bars, keys, config.capital), keys, prefix="")


def grid_search(spark: SparkSession, bars: DataFrame, keys: list[str], grid: search.Grid, config: Config = Config(), **limits) -> DataFrame:
    """All valid candidates on every run, ranked.

    Symbols with a faulty bar are set aside, here and in the other searches; rules.with_faulty() adds a row that says why.
    """
    found = search.candidates(spark, grid)
    return search.ranked(search.candidate_metrics(sound_bars(bars), keys, found, grid, config), keys, **limits)


@dataclass(frozen=True)
class Chance:
    """The permutation test of a chosen candidate: paths, bars of a block, seed, metric; and the draws of its bootstrap."""

    paths: int = 25
    block: int = 2
    seed: int = 42
    metric: str = "score"
    samples: int = 1000


def winners(
    spark: SparkSession,
    df: DataFrame,
    keys: list[str],
    grid: search.Grid,
    config: Config,
    by_family: bool = False,
    **limits
) -> tuple[DataFrame, DataFrame]:
    """(train and test metrics, test curves) of the best candidate on the train rows of every run of keys.

    df has role train or test.  Runs with less train history than the grid asks for are left out; splits.history_check()
    tells which.  Only the winner's targets are made on the test segment.  Winners, their curves and both sides' metrics are kept,
    as several steps begin from each.
    """
    found = search.candidates(spark, grid)
    df = splits.with_history(df, keys, grid)
    train = search.candidate_metrics(df.filter("role = 'train'"), keys, found, grid, config)
    best = search.ranked(train, [*keys, "strategy"] if by_family else keys, **limits)
    count = F.count("*").over(Window.partitionBy(*keys, *(["strategy"] if by_family else [])))
    best = kept(best.withColumn("result_count", count).filter("rank = 1"))  # a row a run; else every step would search again
    curve = kept(backtest(signals.chosen_targets(df.filter("role = 'test'"), keys, best, keys, grid), [*keys, "cand_id"], config))
    test = metrics(curve, [*keys, "cand_id"], config)
    own = best.select(*keys, "cand_id", "strategy", *search.parameter_names(grid), "result_count", F.col("rank").alias("search_rank"))
    both = evidence.train_and_test(best, test, [*keys, "cand_id"]).join(own.hint("merge"), [*keys, "cand_id"])
    bench = buy_and_hold_summary(df.filter("role = 'test'"), keys, config.capital)
    sides = [(r, n, f) for r in ("train", "test") for n, f in (("start", F.min), ("end", F.max))]
    bounds = df.groupBy(*keys).agg(*[f(F.when(F.col("role") == r, F.col("ts"))).alias(f"{r}_{n}") for r, n, f in sides])
    both = evidence.against_benchmark(both, bench, keys).join(bounds.hint("merge"), keys)
    return kept(both.withColumn("candidate_id", search.candidate_id(F.col("cand_id"), F.col("train_start"), F.col("test_end")))), curve


def with_evidence(runs: DataFrame, curve: DataFrame, run: list[str], config: Config, samples: int) -> DataFrame:
    """runs with what costs and chance make of their test curves."""
    costs = evidence.cost_sensitivity(curve.select(*run, "ts", "close", "target_position"), run, config)
    boot = nulls.bootstrap(curve, run, samples, per_year=config.annualization)
    boot = boot.select(
        *run,
        "annualized_low",
        "annualized_high",
        "mean_low",
        "mean_high",
        "ci_crosses_zero",
        F.col("verdict").alias("bootstrap_verdict"),
    )
    return runs.join(costs.hint("merge"), run, "left").join(boot.hint("merge"), run, "left")


def with_permutation(
    runs: DataFrame,
    bars: DataFrame,
    keys: list[str],
    grid: search.Grid,
    config: Config,
    chance: Chance | None,
    limits: policy.Research,
    side: str = "test",
) -> DataFrame:
    """runs with the p-value of each one's candidate on the given bars, and permutation_status; without chance it was skipped.

    One row of runs for each run of keys; side: whether its train or its test metric was observed on these bars.
    """
    if chance is None:
        none = {"empirical_p_value": "double", "null_ge_count": "long", "null_model": "string", "permutation_scope": "string"}
        return runs.withColumns({k: F.lit(None).cast(t) for k, t in (none | {"permutation_error": "string"}).items()} | {"permutation_status": F.lit("skipped")})
    run = [*keys, "perm_id"]
    paths = nulls.null_paths(bars, keys, chance.paths, chance.block, chance.seed)
    targets = signals.chosen_targets(paths, run, runs, keys, grid, scale=None)
    observed = runs.select(*keys, F.col(f"{side}_{chance.metric}").alias(chance.metric))
    found = nulls.p_values(
        observed,
        metrics(backtest(targets, run, config), run, config),
        keys,
        chance.metric,
    ).select(*keys, "empirical_p_value", "null_ge_count")
    df = with_path_errors(runs.join(found.hint("merge"), keys, "left"), bars, keys, chance.block)
    done = F.col("empirical_p_value").isNotNull()
    df = df.withColumns({"null_model": F.when(done, "return_block_reconstruction"), "permutation_scope": F.when(done, "candidate_fixed")})
    c = F.col
    status = evidence.permutation_status(
        True,
        c("permutation_error").isNotNull(),
        c("empirical_p_value"),
        limits.max_p_value,
        c("null_model"),
        limits.null_model,
        c("permutation_scope"),
        limits.scope,
    )
    return df.withColumn("permutation_status", status)


def with_path_errors(runs: DataFrame, bars: DataFrame, keys: list[str], block: int) -> DataFrame:
    """runs with permutation_error: why a run has no permuted paths, no_metric if it has but no p-value, else null."""
    status = nulls.path_status(bars, keys, block).select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("status").alias("_path"))
    same = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]
    df = runs.join(status.hint("merge"), same, "left").drop(*[f"_p_{k}" for k in keys])
    why = F.when(F.coalesce("_path", F.lit("no_bars")) != "ok", F.coalesce("_path", F.lit("no_bars"))).when(F.col("empirical_p_value").isNull(), "no_metric")
    return df.withColumn("permutation_error", why).drop("_path")


def decided(runs: DataFrame, limits: policy.Research) -> DataFrame:
    """Both policies.  What the evidence alone says stays as evidence_verdict; the candidate policy's verdict is the verdict."""
    there = lambda c: F.col(c).isNotNull() if c in runs.columns else F.lit(False)
    known = evidence.derived_verdict(there("search_rank"), there("train_total_return"), there("test_total_return"))
    df = policy.research_policy(policy.candidate_policy(runs.withColumn("evidence_verdict", known)), limits)
    return df.withColumn("verdict", F.col("candidate_verdict"))


def validate_search(
    spark: SparkSession,
    bars: DataFrame,
    grid: search.Grid,
    ratio: float = 0.7,
    config: Config = Config(),
    chance: Chance | None = None,
    max_drawdown_cap: float | None = None,
    min_trade_count: int | None = None,
) -> DataFrame:
    """Train/test validation of every symbol: search on the first part, the winner's run on the rest, evidence, decisions.

    The limits hold for the ranking and for the decision.  chance: also permute the test bars.
    """
    return _validated(spark, bars, grid, ratio, config, chance, False, max_drawdown_cap, min_trade_count)


def _validated(spark, bars, grid, ratio, config, chance, by_family, max_drawdown_cap, min_trade_count) -> DataFrame:
    keys = ["symbol"]
    df = kept(splits.by_ratio(sound_bars(bars), keys, ratio))  # every step begins from bars that lie by symbol
    runs, curve = winners(spark, df, keys, grid, config, by_family, max_drawdown_cap=max_drawdown_cap, min_trade_count=min_trade_count)
    limits = policy.limits_for(max_drawdown_cap, min_trade_count, chance is not None)
    runs = with_evidence(runs, curve, [*keys, "cand_id"], config, (chance or Chance()).samples)
    test = df.filter("role = 'test'").drop("role")
    if by_family and chance is not None:  # one test for each family's winner
        test = test.join(runs.select("symbol", "strategy").hint("merge"), "symbol")
        keys = ["symbol", "strategy"]
    return decided(with_permutation(runs, test, keys, grid, config, chance, limits), limits)


def validation_status(bars: DataFrame, grid: search.Grid, ratio: float = 0.7) -> DataFrame:
    """(symbol, train_rows, test_rows, required, status): ok, empty_train, empty_test or history_too_short."""
    df = splits.by_ratio(bars, ["symbol"], ratio)
    need = splits.needed(grid)
    counts = df.groupBy("symbol").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"),
        F.count_if(F.col("role") == "test").alias("test_rows"),
    )
    status = F.when(F.col("train_rows") == 0, "empty_train").when(F.col("test_rows") == 0, "empty_test").when(
        F.col("train_rows") < need,
        "history_too_short",
    ).otherwise("ok")
    return counts.withColumns({"required": F.lit(need).cast("long"), "status": status})


def walk_forward(
    spark: SparkSession,
    bars: DataFrame,
    grid: search.Grid,
    train: int,
    test: int,
    step: int,
    config: Config = Config(),
    samples: int | None = None,
    max_drawdown_cap: float | None = None,
    min_trade_count: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(a row for each symbol and fold: the winner on the train rows, how it does on the test rows, decisions; the test curves).

    samples: also say what costs and so many bootstrap draws make of each fold.
    """
    keys = ["symbol", "fold"]
    df = splits.folds(sound_bars(bars), ["symbol"], train, test, step)
    runs, curve = winners(spark, df, keys, grid, config, max_drawdown_cap=max_drawdown_cap, min_trade_count=min_trade_count)
    if samples:
        runs = with_evidence(runs, curve, [*keys, "cand_id"], config, samples)
    return decided(runs, policy.limits_for(max_drawdown_cap, min_trade_count, False)), curve


def walk_forward_summary(folds: DataFrame, bars: DataFrame, train: int, test: int, step: int, pooled: DataFrame | None = None) -> DataFrame:
    """Aggregates over folds (zeros where there are none), coverage, and the walk-forward decision for every symbol.

    pooled: evidence.pooled_sharpe() of the folds' test curves; without it the decision stays inconclusive.
    """
    planned = sound_bars(bars).groupBy("symbol").agg(F.count("*").alias("n")).select(
        "symbol",
        F.greatest(F.lit(0), F.floor((F.col("n") - (train + test)) / step) + 1).alias("planned"),
    )
    found = evidence.fold_aggregates(folds, ["symbol"])
    df = planned.join(found.hint("merge"), "symbol", "left").fillna(0, [c for c in found.columns if c != "symbol"])
    df = df.withColumns(
        {"validated_fold_count": F.col("fold_count"), "skipped_fold_count": F.col("planned") - F.col("fold_count"), "fold_count": F.col("planned")}
    )
    df = df.withColumn(
        "coverage_verdict",
        evidence.fold_coverage_verdict(F.col("fold_count"), F.col("validated_fold_count"), F.col("skipped_fold_count")),
    )
    if pooled is not None:
        df = df.join(pooled.hint("merge"), "symbol", "left")
    return policy.walk_forward_policy(df, None if pooled is None else "pooled_test_sharpe_ratio").drop("planned")


def compare_families(
    spark: SparkSession,
    bars: DataFrame,
    grid: search.Grid,
    ratio: float = 0.7,
    config: Config = Config(),
    families: list[str] | None = None,
    chance: Chance | None = None,
    max_drawdown_cap: float | None = None,
    min_trade_count: int | None = None,
) -> DataFrame:
    """validate_search() of every family of the grid, ranked by research verdict, test score and name."""
    named = list(grid) if families is None else families
    if not named:
        raise ValueError("a comparison needs a family")
    if len(set(named)) < len(named):
        raise ValueError("a family is named twice")
    if unknown := [x for x in named if x not in grid]:
        raise ValueError(f"no grid for {', '.join(unknown)}")
    grid = {k: grid[k] for k in named}
    df = _validated(spark, bars, grid, ratio, config, chance, True, max_drawdown_cap, min_trade_count)
    w = Window.partitionBy("symbol").orderBy(policy.comparison_order(F.col("research_verdict")), search.best_first("test_score"), "strategy")
    return df.withColumn("comparison_rank", F.row_number().over(w))


def permutation_scores(bars: DataFrame, keys: list[str], targets, paths: int, block: int, seed: int = 42, config: Config = Config()) -> DataFrame:
    """Metrics of a fixed candidate on permuted paths; targets(bars, keys) adds target_position."""
    run = [*keys, "perm_id"]
    null = targets(nulls.null_paths(bars, keys, paths, block, seed), run)
    return metrics(backtest(null, run, config), run, config)


def permutation_test(
    observed: DataFrame,
    bars: DataFrame,
    keys: list[str],
    targets,
    paths: int,
    block: int,
    seed: int = 42,
    config: Config = Config(),
    metric: str = "score",
) -> DataFrame:
    """p-values of a fixed candidate; targets(bars, keys) adds target_position to observed and permuted bars alike."""
    return nulls.p_values(observed, permutation_scores(bars, keys, targets, paths, block, seed, config), keys, metric)


def permutation_report(
    observed: DataFrame,
    bars: DataFrame,
    keys: list[str],
    targets,
    paths: int,
    block: int,
    seed: int = 42,
    config: Config = Config(),
    metric: str = "score",
    limits: policy.Research = policy.Research(scope="candidate_fixed"),
) -> DataFrame:
    """(keys, empirical_p_value, permutation_status, permutation_error) of every observed run: one that fails has status error."""
    tested = permutation_test(observed, bars, keys, targets, paths, block, seed, config, metric).select(*keys, "empirical_p_value")
    df = with_path_errors(observed.select(*keys).join(tested.hint("merge"), keys, "left"), bars, keys, block)
    c = F.col
    model, scope = F.lit("return_block_reconstruction"), F.lit("candidate_fixed")
    status = evidence.permutation_status(
        True, c("permutation_error").isNotNull(), c("empirical_p_value"), limits.max_p_value, model, limits.null_model, scope, limits.scope
    )
    return df.withColumn("permutation_status", status)


def research_protocol(
    spark: SparkSession,
    bars: DataFrame,
    development: tuple[str, str],
    holdout: tuple[str, str],
    grid: search.Grid,
    config: Config = Config(),
    samples: int = 1000,
    fold: tuple[int, int, int] | None = None,
    chance: Chance | None = None,
    max_drawdown_cap: float | None = None,
    min_trade_count: int | None = None,
) -> DataFrame:
    """Search on the development period, one run of the frozen winner on the holdout, cost and bootstrap evidence on it.

    fold: (train, test, step) of a walk-forward on the development bars; its aggregates, pooled Sharpe ratio and verdict come
    along.  chance: also a permutation test of the winner on the development bars.  Nothing of the holdout reaches the
    choice: the winner is all that the holdout run takes from the search.
    """
    keys, run = ["symbol"], ["symbol", "cand_id"]
    df = splits.by_periods(sound_bars(bars), development, holdout)
    df = kept(df.withColumn("role", F.when(F.col("role") == "development", "train").otherwise("test")))
    runs, curve = winners(spark, df, keys, grid, config, max_drawdown_cap=max_drawdown_cap, min_trade_count=min_trade_count)
    limits = policy.limits_for(max_drawdown_cap, min_trade_count, chance is not None)
    dev = df.filter("role = 'train'").drop("role")
    runs = with_evidence(with_permutation(runs, dev, keys, grid, config, chance, limits, "train"), curve, run, config, samples)
    if fold is not None:
        folds, curves = walk_forward(spark, dev, grid, *fold, config, max_drawdown_cap=max_drawdown_cap, min_trade_count=min_trade_count)
        summary = walk_forward_summary(folds, dev, *fold, evidence.pooled_sharpe(curves, keys, config))
        runs = runs.join(summary.hint("merge"), keys, "left")
    return decided(runs, limits)


def frozen_plan(
    spark: SparkSession,
    protocol: DataFrame,
    development: tuple[str, str],
    holdout: tuple[str, str],
    grid: search.Grid,
    config: Config = Config(),
) -> DataFrame:
    """What was fixed for every symbol before the holdout was looked at: candidate, rule, costs, periods, size of the search."""
    fixed = {"parameter_selection_rule": "highest_development_score_after_configured_filters", "scoring_formula_name": "score"}
    spans = {f"{name}_{end}": p[k] for name, p in (("development", development), ("holdout", holdout)) for k, end in enumerate(("start", "end"))}
    costs = {"fee_rate": config.fee, "slippage_rate": config.slippage, "annualization_factor": config.annualization}
    size = sum(math.prod(map(len, lists.values())) for lists in grid.values())
    return protocol.select(
        "symbol",
        F.col("strategy").alias("strategy_family"),
        search.parameters_json(search.parameter_names(grid)).alias("selected_parameters"),
        *[F.lit(v).alias(k) for k, v in (fixed | spans | costs).items()],
        F.lit(size).cast("long").alias("search_space_size"),
        F.lit(len(grid)).cast("long").alias("tried_strategy_family_count"),
        F.col("result_count").alias("tried_parameter_combination_count"),
    )


def custom_signal_run(
    bars: DataFrame,
    external: DataFrame,
    development: tuple[str, str],
    holdout: tuple[str, str],
    config: Config = Config(),
    samples: int = 1000,
) -> DataFrame:
    """Development and holdout runs of an external signal, side by side, with evidence, decided like a search winner.

    Only symbols whose signals signals.signal_status() finds ok are run.
    """
    df = splits.by_periods(signals.signal_targets(bars, external), development, holdout)
    curve = backtest(df, ["symbol", "role"], config)
    runs = metrics(curve, ["symbol", "role"], config)
    one = lambda role: runs.filter(F.col("role") == role).drop("role")
    both = evidence.train_and_test(one("development"), one("holdout"), ["symbol"])
    bench = buy_and_hold_summary(df.filter("role = 'holdout'"), ["symbol"], config.capital)
    both = evidence.against_benchmark(both, bench, ["symbol"])
    both = with_evidence(both, curve.filter("role = 'holdout'"), ["symbol"], config, samples)
    return decided(both, policy.without_permutation(policy.Research()))
