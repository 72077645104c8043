"""Search, splits, chance, evidence and policies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_backtest import FREE, K, bars
from tidemill.operators import backtest as bt
from tidemill.operators import evidence, nulls, policy, search, splits
from tidemill.plans import workflows as wf

WAVE = [100 + 10 * ((i // 6) % 2) + i % 6 + i * 0.1 for i in range(90)]


def test_candidates(spark):
    c = search.candidates(spark, {"ma_crossover": {"short_window": [2, 4], "long_window": [3, 4, 5]}})
    assert sorted((r.short_window, r.long_window) for r in c.filter("is_valid").collect()) == [(2, 3), (2, 4), (2, 5), (4, 5)] and c.count() == 6
    c = search.candidates(spark, {"breakout": {"lookback_window": [2, 0]}})
    assert c.filter("is_valid").count() == 1
    for grid in (
        {"ma_crossover": {"short_window": [5, 6], "long_window": [3, 4]}},
        {"breakout": {"lookback_window": []}},
        {"breakout": {"window": [1]}},
    ):
        with pytest.raises(ValueError):
            search.candidates(spark, grid)


def test_rank_ties_go_by_long_window_first(spark):
    rows = [
        ("A", "x", "ma_crossover", 3, 6, None, 0.7, -0.1, 1),
        ("A", "y", "ma_crossover", 2, 5, None, 0.7, -0.1, 1),
        ("A", "z", "ma_crossover", 1, 9, None, 0.9, -0.5, 1),
    ]
    df = spark.createDataFrame(
        rows,
        "symbol string, cand_id string, strategy string, short_window int, long_window int, lookback_window int, score double, max_drawdown double, trade_count long",
    )
    assert [r.cand_id for r in search.ranked(df, K).orderBy("rank").collect()] == ["z", "y", "x"]
    assert [r.cand_id for r in search.ranked(df, K, max_drawdown_cap=0.2).orderBy("rank").collect()] == ["y", "x"]


def test_candidates_match_single_runs(spark):
    b = bars(spark, WAVE).drop("target_position")
    grid = {"ma_crossover": {"short_window": [2, 3], "long_window": [5]}, "breakout": {"lookback_window": [4]}}
    runs = {r.cand_id: r for r in wf.grid_search(spark, b, K, grid).collect()}
    from tidemill.operators import signals

    for name, df in (
        ("ma_crossover:long_window=5:short_window=3", signals.ma_targets(b, K, 3, 5)),
        ("breakout:lookback_window=4", signals.breakout_targets(b, K, 4)),
    ):
        m = bt.metrics(bt.backtest(df, K), K).first()
        assert runs[name].score == pytest.approx(m.score) and runs[name].trade_count == m.trade_count
    summary = search.search_summary(wf.grid_search(spark, b, K, grid), K, search.candidates(spark, grid)).first()
    assert (summary.attempted_combinations, summary.result_count) == (3, 3)


def test_splits(spark):
    b = bars(spark, range(1, 11)).drop("target_position")
    assert {r.role: r.row_count for r in splits.segments(splits.by_cutoff(b, "2024-01-04"), ["role"]).collect()} == {"development": 3, "holdout": 7}
    assert {r.role: r.row_count for r in splits.segments(splits.by_ratio(b, K, 0.7), ["role"]).collect()} == {"train": 7, "test": 3}
    p = splits.by_periods(b, ("2024-01-01", "2024-01-04"), ("2024-01-06", "2024-01-08"))
    assert {r.role: r.row_count for r in splits.segments(p, ["role"]).collect()} == {"development": 4, "holdout": 3}
    with pytest.raises(ValueError):
        splits.by_periods(b, ("2024-01-01", "2024-01-06"), ("2024-01-06", "2024-01-08"))
    with pytest.raises(ValueError):
        splits.by_ratio(b, K, 1.0)


@pytest.mark.parametrize("train,test,step", [(4, 2, 2), (3, 2, 7), (4, 4, 1), (8, 2, 1), (20, 2, 1)])
def test_folds(spark, train, test, step):
    b = bars(spark, range(1, 11)).drop("target_position")
    want, at = [], 0
    while at + train + test <= 10:
        want.append((at // step, at, at + train, at + train + test))
        at += step
    got = splits.folds(b, K, train, test, step).withColumn("i", F.dayofmonth(F.col("ts").cast("date")) - 1)
    rows = got.groupBy("fold").agg(
        F.min("i").alias("a"),
        F.min(F.when(F.col("role") == "test", F.col("i"))).alias("b"),
        (F.max("i") + 1).alias("c"),
        F.count("*").alias("n"),
    ).orderBy("fold").collect()
    assert [(r.fold, r.a, r.b, r.c) for r in rows] == want and all(r.n == train + test for r in rows)


def test_history_check(spark):
    df = splits.by_ratio(bars(spark, range(1, 11)).drop("target_position"), K, 0.7)
    got = {r.role: r.enough for r in splits.history_check(df, ["role"], {"ma_crossover": {"short_window": [9], "long_window": [5, 6]}}).collect()}
    assert got == {"train": True, "test": False}


def test_walk_forward_means(spark):
    cols = ["total_return", "sharpe_ratio", "max_drawdown", "win_rate", "turnover"]
    rows = [("A", 0, 0.1, 1.0, -0.1, 0.5, 1.0, 2, 0.05, -0.08, 0.05), ("A", 1, 0.2, 1.4, -0.2, 0.75, 1.5, 4, 0.09, -0.10, 0.11)]
    df = spark.createDataFrame(
        rows,
        "symbol string, fold int, " + ", ".join(f"test_{c} double" for c in cols) + ", test_trade_count long, benchmark_total_return double, benchmark_max_drawdown double, return_excess double",
    )
    a = evidence.fold_aggregates(df, K).first()
    assert [
        round(x, 6) for x in (
            a.mean_test_total_return,
            a.mean_test_sharpe_ratio,
            a.mean_test_max_drawdown,
            a.worst_test_max_drawdown,
            a.mean_test_win_rate,
            a.mean_test_turnover,
        )
    ] == [0.15, 1.2, -0.15, -0.2, 0.625, 1.25]
    assert a.total_test_trade_count == 6 and round(a.mean_benchmark_total_return, 6) == 0.07 and round(a.mean_excess_return, 6) == 0.08


def test_bootstrap_verdicts(spark):
    good, mixed = [0.02, 0.03, 0.04, 0.05, 0.01, 0.025, 0.035, 0.045], [0.04, -0.03, 0.0, 0.02, -0.01, 0.01, -0.02, 0.03]
    rows = [(s, i, x) for s, xs in (("good", good), ("mixed", mixed), ("lost", [0.1, -1.0, 0.1]), ("one", [0.1])) for i, x in enumerate(xs)] + [("good", 99, float("nan")), ("good", 98, None)]
    df = spark.createDataFrame(rows, "symbol string, ts long, strategy_return double")
    got = {r.symbol: r for r in nulls.bootstrap(df, K, 200).collect()}
    assert got["good"].verdict == "stronger_evidence" and not got["good"].ci_crosses_zero and 0.01 < got["good"].mean_low < got["good"].mean_high < 0.05
    assert got["mixed"].verdict == "weak_evidence" and got["mixed"].ci_crosses_zero
    assert got["lost"].status == got["one"].status == "invalid" and got["one"].verdict is None
    assert nulls.bootstrap(df, K, 200).orderBy("symbol").collect() == nulls.bootstrap(df.repartition(3), K, 200).orderBy("symbol").collect()


def test_null_paths(spark):
    b = bars(spark, [100, 104, 99, 107, 103, 110, 108]).drop("target_position")
    paths = nulls.null_paths(b, K, 6, 2)
    rows = paths.orderBy("perm_id", "ts").collect()
    rel = lambda xs: sorted(round(y / x, 9) for x, y in zip(xs, xs[1:], strict=False))
    want = [r.close for r in b.orderBy("ts").collect()]
    seen = set()
    for p in range(6):
        mine = [r for r in rows if r.perm_id == p]
        assert [r.ts for r in mine] == [r.ts for r in b.orderBy("ts").collect()]
        closes = [r.close for r in mine]
        assert closes[0] == 100 and rel(closes) == rel(want) and closes[-1] == pytest.approx(108)
        assert all(r.high >= max(r.open, r.close) and r.low <= min(r.open, r.close) and r.low > 0 for r in mine)
        seen.add(tuple(round(c, 6) for c in closes))
    assert len(seen) > 1
    assert nulls.null_paths(b.limit(1), K, 2, 1).count() == 2


def test_p_value(spark):
    o = spark.createDataFrame([("A", 1.0)], "symbol string, score double")
    n = spark.createDataFrame([("A", x) for x in (0.5, 1.0, 2.0, 0.1)], "symbol string, score double")
    r = nulls.p_values(o, n, K).first()
    assert (r.permutations, r.null_ge_count, r.empirical_p_value) == (4, 2, 3 / 5)


def test_cost_sensitivity(spark):
    closes, targets = range(100, 180, 10), [0, 1, 0, 1, 0, 1, 0, 1]
    c = evidence.cost_sensitivity(bars(spark, closes, targets), K, bt.Config(fee=0.02, slippage=0.01)).first()
    assert c.low_cost_annualized_return > c.base_cost_annualized_return > c.high_cost_annualized_return
    fragile = evidence.cost_sensitivity(bars(spark, closes, targets), K, bt.Config(fee=0.03, slippage=0.02)).first()
    assert fragile.cost_verdict == "cost_fragile"
    assert evidence.cost_sensitivity(bars(spark, closes, targets), K, bt.Config(fee=0.001, slippage=0.0)).first().cost_verdict == "stable"


BASE = {
    "train_total_return": 0.1,
    "test_total_return": 0.1,
    "test_sharpe_ratio": 1.0,
    "return_degradation": 0.0,
    "sharpe_degradation": 0.0,
    "max_drawdown_delta": 0.0,
    "return_excess": 0.0,
}


@pytest.mark.parametrize(
    "change,verdict,last",
    [
        ({}, "validated", "benchmark_return_excess_non_negative"),
        ({"train_total_return": None}, "inconclusive", "missing_train_metrics"),
        ({"test_total_return": None}, "inconclusive", "missing_test_metrics"),
        ({"sharpe_degradation": None}, "inconclusive", "missing_degradation_summary"),
        ({"return_excess": None}, "inconclusive", "missing_benchmark_relative_summary"),
        ({"test_total_return": 0.0}, "rejected", "out_of_sample_return_non_positive"),
        ({"test_sharpe_ratio": -0.1}, "rejected", "out_of_sample_sharpe_non_positive"),
        ({"return_degradation": -0.1, "sharpe_degradation": -0.1, "max_drawdown_delta": -0.1}, "rejected", "all_degradation_signals_negative"),
        ({"return_degradation": -0.1}, "inconclusive", "mixed_signals"),
    ],
)
def test_candidate_policy(spark, change, verdict, last):
    row = BASE | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    r = policy.candidate_policy(df).first()
    assert (r.candidate_verdict, r.candidate_reasons[-1]) == (verdict, last)


@pytest.mark.parametrize(
    "change,verdict,last",
    [
        ({}, "validated", "aggregate_drawdown_non_worsening"),
        ({"fold_count": 0}, "inconclusive", "no_valid_folds"),
        ({"skipped_fold_count": 1}, "inconclusive", "fold_coverage_incomplete"),
        ({"pooled": None}, "inconclusive", "missing_pooled_test_sharpe_ratio"),
        ({"mean_test_total_return": -0.1}, "rejected", "aggregate_return_non_positive"),
        ({"pooled": 0.0}, "rejected", "aggregate_pooled_sharpe_non_positive"),
        ({"mean_excess_return": -0.1, "mean_test_max_drawdown": -0.5}, "rejected", "aggregate_relative_performance_negative"),
        ({"mean_excess_return": -0.1}, "inconclusive", "mixed_signals"),
    ],
)
def test_walk_forward_policy(spark, change, verdict, last):
    row = {
        "fold_count": 2,
        "validated_fold_count": 2,
        "skipped_fold_count": 0,
        "mean_test_total_return": 0.1,
        "mean_test_sharpe_ratio": 1.0,
        "mean_test_max_drawdown": -0.1,
        "mean_benchmark_max_drawdown": -0.2,
        "mean_excess_return": 0.1,
        "pooled": 1.0,
    } | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if 'fold' in k else 'double'}" for k in row))
    r = policy.walk_forward_policy(df, "pooled").first()
    assert (r.walk_forward_verdict, r.walk_forward_reasons[-1]) == (verdict, last)


def test_research_policy(spark):
    schema = "test_trade_count long, test_max_drawdown double, return_degradation double, empirical_p_value double, null_model string, permutation_scope string"
    make = lambda *row: spark.createDataFrame([row], schema)
    good = make(3, -0.1, 0.1, 0.01, "return_block_reconstruction", "candidate_fixed")
    r = policy.research_policy(good, policy.Research(max_drawdown_cap=0.2, scope="candidate_fixed")).first()
    assert r.research_verdict == "promote" and all(r.research_checks.values()) and r.research_reasons[-1] == "all configured research policy checks passed"
    r = policy.research_policy(good, policy.Research(max_drawdown_cap=0.05)).first()
    assert r.research_verdict == "reject" and not r.research_checks["max_drawdown_cap"] and "max_drawdown -0.1 exceeds cap 0.05" in r.research_reasons
    r = policy.research_policy(make(0, -0.1, 0.1, 0.2, "other", None)).first()
    assert {k for k, v in r.research_checks.items() if not v} == {"min_trade_count", "max_permutation_p_value", "required_permutation_null_model"}
    r = policy.research_policy(make(3, -0.1, None, None, None, None)).first()
    assert not r.research_checks[
        "permutation_summary_present_for_p_value"
    ] and not r.research_checks["return_degradation_present"] and "min_return_degradation" not in r.research_checks
    assert policy.research_policy(
        make(3, -0.1, 0.1, None, None, None),
        policy.without_permutation(policy.Research()),
    ).first().research_verdict == "promote"
    r = policy.research_policy(make(None, None, None, None, None, None)).first()
    assert r.research_verdict == "reject" and r.research_reasons[-1] == "missing test metrics"
    r = policy.research_policy(good, rerun_count=1).first()
    assert r.research_verdict == "blocked" and r.research_checks == {"rerun_count_within_limit": False}


def test_verdicts_and_status(spark):
    df = spark.createDataFrame(
        [(True, True, False, 0.01, "m"), (True, False, False, 0.9, "m"), (False, False, True, None, "m"), (True, True, True, 0.01, "x")],
        "s boolean, t boolean, e boolean, p double, m string",
    )
    got = df.select(
        evidence.derived_verdict(F.col("s"), F.lit(True), F.col("t")).alias("v"),
        evidence.permutation_status(True, F.col("e"), F.col("p"), 0.05, F.col("m"), "m", F.lit(None).cast("string"), "candidate_fixed").alias("st"),
    ).collect()
    assert [r.v for r in got] == ["validated", "candidate", "inconclusive", "validated"]
    assert [r.st for r in got] == ["completed_passed", "completed_failed", "error", "error"]
    assert df.select(
        evidence.permutation_status(False, F.col("e"), F.col("p"), 0.05, F.col("m"), "m", F.col("m"), None).alias("st")
    ).first().st == "skipped"


def test_test_segment_is_only_used_for_the_winner(spark):
    b = bars(spark, WAVE).drop("target_position")
    grid = {"ma_crossover": {"short_window": [2, 3], "long_window": [5, 8]}}
    r = wf.validate_search(spark, b, grid, 0.6, FREE).first()
    best = wf.grid_search(spark, splits.by_ratio(b, K, 0.6).filter("role = 'train'"), K, grid, FREE).filter("rank = 1").first()
    assert r.cand_id == best.cand_id and r.train_score == pytest.approx(best.score) and r.result_count == 4
    late = F.col("ts") > F.lit("2024-03-15").cast("timestamp_ntz")
    changed = b.withColumns({c: F.when(late, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    again = wf.validate_search(spark, changed, grid, 0.6, FREE).first()
    assert again.cand_id == r.cand_id and again.train_score == r.train_score


def test_walk_forward_and_protocol(spark):
    b = bars(spark, WAVE).drop("target_position").unionByName(bars(spark, WAVE[:10], symbol="B").drop("target_position"))
    grid = {"ma_crossover": {"short_window": [2], "long_window": [5]}}
    folds, _ = wf.walk_forward(spark, b, grid, 30, 20, 20)
    assert folds.count() == 3
    got = {r.symbol: r for r in wf.walk_forward_summary(folds, b, 30, 20, 20).collect()}
    assert got["A"].walk_forward_reasons == [
        "fold_coverage_complete",
        "missing_pooled_test_sharpe_ratio",
    ] and got["B"].walk_forward_reasons == ["no_valid_folds"]
    r = wf.research_protocol(spark, b.filter("symbol = 'A'"), ("2024-01-01", "2024-02-15"), ("2024-02-16", "2024-03-30"), grid, samples=20).first()
    assert r.cost_verdict in ("stable", "cost_fragile") and r.bootstrap_verdict in ("stronger_evidence", "weak_evidence")
    c = wf.compare_families(spark, b.filter("symbol = 'A'"), grid | {"breakout": {"lookback_window": [3]}}).collect()
    assert sorted(x.comparison_rank for x in c) == [1, 2]
