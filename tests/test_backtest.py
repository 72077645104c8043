"""Backtests, trades, metrics and signals on hand-made tables."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions.rules import bar_quality, bar_violations, long_only, passes, score, signal_quality
from tidemill.operators import backtest as bt
from tidemill.operators import signals
from tidemill.sources import bars as src

K = ["symbol"]
FREE = bt.Config(fee=0.0, slippage=0.0)


def bars(spark, closes, targets=None, symbol="A", more=None):
    rows = []
    for i, c in enumerate(closes):
        t = pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)
        rows.append((symbol, t.to_pydatetime(), float(c), float(c), float(c), float(c), 1.0, None if targets is None else float(targets[i])))
    return spark.createDataFrame(
        rows,
        "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, target_position double",
    )


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_ma_signal(spark):
    df = signals.ma_targets(bars(spark, [1, 2, 3, 2, 1, 2, 3, 4]).drop("target_position"), K, 2, 3)
    assert column(df, "target_position") == [0, 0, 1, 1, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        signals.ma_targets(df, K, 3, 3)


def test_breakout_signal(spark):
    df = signals.breakout_targets(bars(spark, [1, 2, 3, 2, 4, 5]).drop("target_position"), K, 2)
    assert column(df, "target_position") == [0, 0, 1, 0, 1, 1]


def test_position_lags_one_bar(spark):
    curve = bt.backtest(bars(spark, [100, 101, 102, 103], [0, 1, 0, 0]), K, FREE)
    assert column(curve, "position") == [0, 0, 1, 0]
    (t,) = bt.trades(curve, K).collect()
    assert (t.entry_datetime.day, t.exit_datetime.day) == (3, 4)


def test_open_trade_ends_at_last_bar(spark):
    curve = bt.backtest(bars(spark, [100, 102, 104, 105], [1, 1, 1, 1]), K, FREE)
    (t,) = bt.trades(curve, K).collect()
    assert (t.entry_datetime.day, t.entry_price, t.exit_datetime.day, t.exit_price, t.holding_period) == (2, 102, 4, 105, 3)
    assert (t.entry_target_position, t.exit_target_position) == (1, 1)
    curve = bt.backtest(bars(spark, [100, 101, 103, 106, 108], [0, 1, 1, 1, 1]), K, FREE)
    assert column(curve, "position") == [0, 0, 1, 1, 1]
    (t,) = bt.trades(curve, K).collect()
    assert (t.exit_datetime.day, t.exit_price) == (5, 108)


def test_trade_returns_with_costs(spark):
    curve = bt.backtest(bars(spark, [100, 110, 121, 121], [0, 1, 1, 0]), K, bt.Config(fee=0.01, slippage=0.0))
    (t,) = bt.trades(curve, K).collect()
    assert (t.entry_datetime.day, t.entry_price, t.exit_datetime.day, t.exit_price, t.holding_period) == (3, 121, 4, 121, 2)
    assert t.trade_gross_return == pytest.approx(0.10)
    assert t.trade_net_return == pytest.approx(0.09)
    assert t.cost_return_contribution == pytest.approx(0.01)
    assert (t.entry_target_position, t.exit_target_position) == (1, 0)


def test_flat_and_empty_have_no_trades(spark):
    flat = bars(spark, [1, 2, 3], [0, 0, 0])
    assert bt.trades(bt.backtest(flat, K), K).count() == 0
    empty = bt.trades(bt.backtest(flat.limit(0), K), K)
    assert empty.count() == 0 and "trade_net_return" in empty.columns
    (m,) = bt.metrics(bt.backtest(flat, K), K).collect()
    assert (m.trade_count, m.win_rate, m.sharpe_ratio, m.total_return, m.bar_count) == (0, 0, 0, 0, 3)


def test_metrics(spark):
    rows = [("A", i, float(r), float(e), t) for i, (r, e, t) in enumerate(zip([0, 0.01, -0.005, 0.02], [100, 101, 100.495, 102.5049], [0.0, 1.0, 0.0, 1.0], strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts long, strategy_return double, equity double, turnover double")
    (m,) = bt.run_metrics(df, K).collect()
    assert m.total_return == pytest.approx(0.025049) and m.bar_count == 4 and m.turnover == 2
    assert m.annualized_return == pytest.approx(1.025049 ** (252 / 3) - 1)
    s = pd.Series([0, 0.01, -0.005, 0.02])
    assert m.sharpe_ratio == pytest.approx(s.mean() / s.std() * math.sqrt(252))


def test_sharpe_is_zero_without_spread(spark):
    df = spark.createDataFrame(
        [("one", 0, 0.1, 1.0, 0.0), ("two", 0, 0.1, 1.0, 0.0), ("two", 1, 0.1, 1.1, 0.0)],
        "symbol string, ts long, strategy_return double, equity double, turnover double",
    )
    assert {r.sharpe_ratio for r in bt.run_metrics(df, K).collect()} == {0.0}


def test_total_loss_has_no_annual_return(spark):
    df = spark.createDataFrame(
        [("A", 0, 0.0, 100.0, 0.0), ("A", 1, -1.5, -50.0, 1.0)],
        "symbol string, ts long, strategy_return double, equity double, turnover double",
    )
    assert math.isnan(bt.run_metrics(df, K).first().annualized_return)


def test_buy_and_hold(spark):
    assert column(bt.buy_and_hold(bars(spark, [100, 110, 105]), K, 1000.0), "equity") == [1000, 1100, 1050]
    (s,) = bt.buy_and_hold_summary(bars(spark, [100, 120, 90, 110]), K).collect()
    assert s.benchmark_total_return == pytest.approx(0.1) and s.benchmark_max_drawdown == pytest.approx(-0.25)


def test_fractional_change_is_no_exit(spark):
    curve = bt.backtest(bars(spark, [100, 101, 102, 103], [1.0, 0.5, 0.5, 0.5]), K, FREE)
    assert column(curve, "turnover") == [0, 1, 0.5, 0]
    assert bt.trades(curve, K).count() == 1


def test_targets_are_clipped(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (2.0,), (0.3,)], "x double").select(long_only(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [0, 0, 0, 1, 0.3]


def test_row_order_does_not_matter(spark):
    df = bars(spark, [100, 104, 99, 107, 103, 110, 108], [0, 1, 1, 0, 1, 1, 0])
    a = bt.metrics(bt.backtest(df, K), K).collect()
    b = bt.metrics(bt.backtest(df.orderBy(F.rand(3)).repartition(3), K), K).collect()
    assert a == b


def test_panel_runs_are_independent(spark):
    a, b = [100, 110, 121, 121], [50, 49, 52, 60]
    both = bars(spark, a, [0, 1, 1, 0]).unionByName(bars(spark, b, [1, 1, 0, 1], "B"))
    alone = bt.metrics(bt.backtest(bars(spark, b, [1, 1, 0, 1], "B"), K), K).first()
    assert bt.metrics(bt.backtest(both, K), K).filter("symbol = 'B'").first() == alone


def test_custom_signal_function(spark):
    df = signals.custom_targets(bars(spark, [1, 2, 3, 2]).drop("target_position"), K, lambda pdf: (pdf["close"] > 1.5).astype(float))
    assert column(df, "target_position") == [0, 1, 1, 1]


def test_alignment(spark):
    b = bars(spark, [1, 2, 3]).drop("target_position")
    s = b.select("symbol", "ts", F.col("ts").alias("available_at"), F.lit(1).alias("signal_binary"))
    assert signals.signal_targets(b, s).count() == 3
    s = s.filter("day(ts) < 3").union(spark.sql("select 'A', timestamp_ntz '2025-01-01', timestamp_ntz '2025-01-01', 1"))
    assert sorted(r.side for r in signals.misaligned(b, s).collect()) == ["extra_signal", "missing_signal"]
    assert signals.signal_targets(b, s).count() == 0


def test_bar_rules(spark):
    inf = float("inf")
    rows = [
        ("A", "2024-01-01", 1.0, 1.0, 1.0, 1.0, None),
        ("A", "2024-01-02", 1.0, 0.5, 1.0, 1.0, 1.0),
        ("A", "2024-01-03", None, 1.0, 1.0, 1.0, 1.0),
        ("A", "2024-01-04", 1.0, inf, 1.0, 1.0, 1.0),
        ("A", "2024-01-05", -1.0, 1.0, 1.0, 1.0, 1.0),
        ("A", "2024-01-06", 1.0, 1.0, 1.5, 1.0, 1.0),
        ("A", "2024-01-07", 1.0, 1.0, 1.0, 1.0, 1.0),
        ("A", "2024-01-07", 1.0, 1.0, 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(
        rows,
        "symbol string, ts string, open double, high double, low double, close double, volume double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = {(r.ts.day, tuple(r.violations)) for r in bar_violations(df).collect()}
    assert (2, ("high_below_low", "high_below_open", "high_below_close")) in found
    assert (3, ("price_missing",)) in found and (4, ("price_not_finite",)) in found and (7, ("datetime_repeated",)) in found
    assert (6, ("high_below_low", "low_above_open", "low_above_close")) in found
    q = bar_quality(df).first()
    assert (q.source_row_count, q.volume_missing_row_count, q.first_violation) == (8, 1, "datetime_repeated")


def test_signal_rules(spark):
    rows = [
        ("A", "2024-01-02", "2024-01-01", 1),
        ("A", "2024-01-03", "2024-01-04", 0),
        ("A", "2024-01-05", "2024-01-05", 2),
        ("A", None, "2024-01-05", None),
    ]
    df = spark.createDataFrame(rows, "symbol string, ts string, available_at string, signal_binary int")
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "available_at")})
    q = signal_quality(df).first()
    assert (q.datetime_missing, q.signal_missing, q.available_too_late, q.signal_not_binary, q.first_violation) == (1, 1, 1, 1, "datetime_missing")


def test_score_and_thresholds(spark):
    df = spark.createDataFrame(
        [(0.1, 1.0, 0.5, -0.2, 10.0, 10, 3), (0.1, 1.0, 0.5, -0.2, 20.0, 20, 3)],
        "annualized_return double, sharpe_ratio double, win_rate double, max_drawdown double, turnover double, bar_count long, trade_count long",
    )
    a, b = df.select(score().alias("s"), passes(0.2, 3).alias("ok"), passes(0.1, 3).alias("no")).collect()
    assert a.s == pytest.approx(0.1 + 0.2 + 0.05 - 0.4 - 0.01) and a.s == b.s and a.ok and not a.no


def test_columns_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Date ,OPEN,High,low,Close,volume,extra\n2024-01-02,1,2,1,2,\n2024-01-01,1,2,1,1,5,x\n")
    df = src.fill_volume(src.read_bars(spark, str(tmp_path / "a.csv"), symbol="A"))
    assert df.columns == src.COLUMNS and [r.volume for r in df.orderBy("ts").collect()] == [5, 0]
    (tmp_path / "b.csv").write_text("date,open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        src.read_bars(spark, str(tmp_path / "b.csv"), symbol="A")


def test_payloads(spark):
    row = '["113/03/01","24,167,721","16,699,995,060","697.00","697.00","688.00","689.00","-1.00"]'
    again = '["113/03/01","1","1","697.00","697.00","--","690.00","-1.00"]'
    docs = [
        ("A", 1, f'{{"stat":"OK","data":[{row},["113/03/04","1"]]}}'),
        ("B", 1, f'{{"stat":"NO","data":[{row}]}}'),
        ("C", 1, f'{{"stat":"OK","data":[{row}]}}'),
        ("C", 2, f'{{"stat":"OK","data":[{again}]}}'),
    ]
    got = {r.symbol: r for r in src.parse_payloads(spark.createDataFrame(docs, "symbol string, ingest_order int, payload string")).collect()}
    assert set(got) == {"A", "C"}
    a = got["A"]
    assert (str(a.ts), a.open, a.high, a.low, a.close, a.volume) == ("2024-03-01 00:00:00", 697, 697, 688, 689, 24167721)
    assert got["C"].low is None and got["C"].close == 690


def test_months(spark):
    assert [r.month for r in src.month_starts(spark, "2024-01", "2024-03").collect()] == ["20240101", "20240201", "20240301"]
    with pytest.raises(ValueError):
        src.month_starts(spark, "2024-03", "2024-01")


def test_sinks(spark, tmp_path):
    curve = bt.backtest(bars(spark, [1, 2, 3], [0, 0, 0]), K)
    src.write_table(curve, str(tmp_path / "curve"), ["symbol"])
    assert spark.read.parquet(str(tmp_path / "curve")).count() == 3
    src.write_table(bt.trades(curve, K), str(tmp_path / "trades"))
    assert "trade_net_return" in spark.read.parquet(str(tmp_path / "trades")).columns
