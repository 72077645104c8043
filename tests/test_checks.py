"""What is refused: faulty bars and signals, empty segments, scores that are no numbers; and tables for reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.test_backtest import FREE, K, bars
from tests.test_research import WAVE
from tidemill.functions.rules import accepted_bars, bar_quality, checked_bars, signal_violations
from tidemill.operators import backtest as bt
from tidemill.operators import evidence, nulls, search, signals, splits
from tidemill.plans import reports
from tidemill.plans import workflows as wf
from tidemill.sources import bars as src

GRID = {"ma_crossover": {"short_window": [2], "long_window": [5]}}


def plain(spark, closes, symbol="A"):
    return bars(spark, closes, symbol=symbol).drop("target_position")


def signal_rows(spark, b):
    return b.select("symbol", "ts", F.col("ts").alias("available_at"), F.lit(1).alias("signal_binary"))


def test_faulty_bars_are_refused(spark):
    good, bad = plain(spark, [1, 2, 3]), plain(spark, [1, 2, 3], "B").withColumn("high", F.when(F.col("close") == 2, 1.0).otherwise(F.col("high")))
    both = good.withColumn("volume", F.lit(None).cast("double")).unionByName(bad)
    assert {(r.symbol, r.volume) for r in accepted_bars(both).collect()} == {("A", 0.0)}
    with pytest.raises(ValueError, match="B: high_below_low"):
        checked_bars(both)
    with pytest.raises(ValueError, match="no bars"):
        checked_bars(good.limit(0))
    assert checked_bars(good).count() == 3
    q = {r.symbol: r for r in bar_quality(both).collect()}
    assert (q["A"].accepted_row_count, q["B"].accepted_row_count, q["A"].missing_volume_policy) == (3, 0, "fill_zero")
    odd = good.withColumn("volume", F.lit(float("nan")))
    assert bar_quality(odd).first().first_violation == "volume_not_numeric"


def test_signals_are_refused_by_symbol(spark):
    b = plain(spark, [1, 2, 3]).unionByName(plain(spark, [1, 2, 3], "B")).unionByName(plain(spark, [1, 2], "C")).unionByName(plain(spark, [1, 2], "D"))
    s = signal_rows(spark, b.filter("symbol <> 'C'"))
    s = s.withColumn("available_at", F.when(F.col("symbol") == "B", F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("available_at")))
    s = s.filter("not (symbol = 'D' and day(ts) = 2)").unionByName(signal_rows(spark, plain(spark, [1], "E")))
    got = {r.symbol: r.status for r in signals.signal_status(b, s).collect()}
    assert got == {"A": "ok", "B": "available_too_late", "C": "no_signals", "D": "misaligned", "E": "no_bars"}
    assert {r.symbol for r in signals.signal_targets(b, s).collect()} == {"A"}
    assert signal_violations(s).count() == 3
    with pytest.raises(ValueError, match="B: available_too_late"):
        signals.checked_signals(b, s)
    one = s.filter("symbol = 'A'"), b.filter("symbol = 'A'")
    assert signals.checked_signals(one[1], one[0], "A").count() == 3
    with pytest.raises(ValueError, match="symbol 'A' of the signals"):
        signals.checked_signals(one[1], one[0], "Z")


def test_targets_of_callers_are_aligned(spark):
    b, t = plain(spark, [1, 2, 3]), bars(spark, [1, 2, 3], [0, 1, 1])
    assert signals.checked_targets(b, t, K).count() == 3
    for wrong in (t.filter("close > 1"), t.unionByName(t.limit(1)), t.withColumn("symbol", F.lit("B"))):
        with pytest.raises(ValueError, match="same keys"):
            signals.checked_targets(b, wrong, K)


def test_signal_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Datetime, available_at ,symbol,signal_name,signal_value,signal_binary,source,more\n2024-01-02,2024-01-01,A,x,0.5,1,me,z\n"
    )
    (r,) = src.read_signals(spark, str(tmp_path / "s.csv")).collect()
    assert (
        r.symbol,
        str(r.ts),
        str(r.available_at),
        r.signal_value,
        r.signal_binary,
    ) == ("A", "2024-01-02 00:00:00", "2024-01-01 00:00:00", 0.5, 1.0)
    (tmp_path / "t.csv").write_text("datetime,symbol\n2024-01-02,A\n")
    with pytest.raises(ValueError, match="missing columns"):
        src.read_signals(spark, str(tmp_path / "t.csv"))


def test_empty_segments(spark):
    b = plain(spark, range(1, 9)).unionByName(plain(spark, [1, 2], "B"))
    df = splits.by_cutoff(b, "2024-01-04")
    assert {r.symbol: r.status for r in splits.segment_status(df, K, ["development", "holdout"]).collect()} == {"A": "ok", "B": "empty_holdout"}
    with pytest.raises(ValueError, match="empty_holdout"):
        splits.checked_segments(df, K, ["development", "holdout"])
    assert splits.shared_times(df, K, "development", "holdout").count() == 0
    assert splits.shared_times(df.unionByName(df.withColumn("role", F.lit("holdout"))), K, "development", "holdout").count() == 5
    df = splits.by_ratio(b, K, 0.7)
    assert {r.symbol for r in splits.with_history(df, K, GRID).collect()} == {"A"}
    status = {r.symbol: r.status for r in wf.validation_status(b.unionByName(plain(spark, [1], "C")), GRID).collect()}
    assert status == {"A": "ok", "B": "history_too_short", "C": "empty_train"}


def test_scores_that_are_no_numbers_come_last(spark):
    rows = [("A", c, "ma_crossover", 2, 5, None, v, -0.1, 1) for c, v in (("x", float("nan")), ("y", -3.0), ("z", 0.5))]
    df = spark.createDataFrame(
        rows,
        "symbol string, cand_id string, strategy string, short_window int, long_window int, lookback_window int, score double, max_drawdown double, trade_count long",
    )
    assert [r.cand_id for r in search.ranked(df, K).orderBy("rank").collect()] == ["z", "y", "x"]
    o, n = spark.createDataFrame([("A", 1.0)], "symbol string, score double"), spark.createDataFrame(
        [("A", x) for x in (2.0, float("nan"))],
        "symbol string, score double",
    )
    assert nulls.p_values(o, n, K).first().null_ge_count == 1


def test_paths_need_usable_prices(spark):
    b = plain(spark, [5, 6, 7, 8]).unionByName(plain(spark, [5, 0, 7, 8], "B")).unionByName(plain(spark, [5], "C"))
    assert {r.symbol: r.status for r in nulls.path_status(b, K, 2).collect()} == {"A": "ok", "B": "price_unusable", "C": "block_too_long"}
    assert {r.symbol for r in nulls.null_paths(b, K, 2, 2).collect()} == {"A"}


def test_families_of_a_comparison(spark):
    b = plain(spark, WAVE)
    for families in ([], ["ma_crossover", "ma_crossover"], ["breakout"]):
        with pytest.raises(ValueError):
            wf.compare_families(spark, b, GRID, families=families)


def test_limits_reach_the_decision(spark):
    b = plain(spark, WAVE)
    free = wf.validate_search(spark, b, GRID, 0.5, FREE).first()
    assert free.evidence_verdict == "validated" and free.candidate_id == "ma_crossover:long_window=5:short_window=2:2024-01-01 00:00:00-2024-03-30 00:00:00"
    assert free.permutation_status == "skipped" and free.search_rank == 1 and free.cost_verdict and free.bootstrap_verdict
    assert "max_drawdown_cap" not in free.research_checks
    tight = wf.validate_search(spark, b, GRID, 0.5, FREE, wf.Chance(8, 3, samples=20), max_drawdown_cap=0.5, min_trade_count=1).first()
    assert {"max_drawdown_cap", "max_permutation_p_value", "required_permutation_scope"} <= set(tight.research_checks)
    assert tight.permutation_status in ("completed_passed", "completed_failed") and 0 < tight.empirical_p_value <= 1


def test_protocol_reports(spark, tmp_path):
    b, periods = plain(spark, WAVE), (("2024-01-01", "2024-02-20"), ("2024-02-21", "2024-03-30"))
    p = wf.research_protocol(spark, b, *periods, GRID, FREE, 20, (20, 10, 10), wf.Chance(5, 2))
    r = p.first()
    assert r.fold_count == 3 and r.walk_forward_reasons[0] == "fold_coverage_complete" and r.pooled_test_sharpe_ratio is not None
    plan = wf.frozen_plan(spark, p, *periods, GRID, FREE).first()
    assert json.loads(plan.selected_parameters) == {"long_window": 5, "short_window": 2} and (
        plan.search_space_size,
        plan.tried_parameter_combination_count,
        plan.holdout_start,
    ) == (1, 1, "2024-02-21")
    src.write_json(reports.nested_summary(p, K), str(tmp_path / "p"))
    (made,) = spark.read.json(str(tmp_path / "p")).collect()
    assert made.summary.test.score == pytest.approx(r.test_score) and made.summary.low_cost.sharpe_ratio == pytest.approx(r.low_cost_sharpe_ratio)
    none = wf.walk_forward_summary(wf.walk_forward(spark, b, GRID, 80, 20, 10, FREE)[0], b, 80, 20, 10).first()
    assert (none.fold_count, none.mean_test_total_return, none.total_test_trade_count, none.walk_forward_reasons) == (0, 0.0, 0, ["no_valid_folds"])


def test_pooled_sharpe(spark):
    df = spark.createDataFrame([("A", x) for x in (0.01, -0.02, 0.03)] + [("B", 0.1)], "symbol string, strategy_return double")
    got = {r.symbol: r.pooled_test_sharpe_ratio for r in evidence.pooled_sharpe(df, K, bt.Config(annualization=52.0)).collect()}
    mean, sd = 0.02 / 3, (((0.01 - 0.02 / 3) ** 2 + (0.02 + 0.02 / 3) ** 2 + (0.03 - 0.02 / 3) ** 2) / 2) ** 0.5
    assert got["A"] == pytest.approx(mean / sd * 52**0.5) and got["B"] == 0


def test_candidate_names(spark):
    df = spark.createDataFrame(
        [("breakout:lookback_window=3", None, None, 3)],
        "cand_id string, short_window int, long_window int, lookback_window int",
    )
    r = df.select(
        search.parameters_json().alias("p"),
        search.candidate_id(F.col("cand_id"), F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")).alias("i"),
    ).first()
    assert r.p == '{"lookback_window":3}' and r.i == "breakout:lookback_window=3:2024-01-01 00:00:00-2024-02-01 00:00:00"
