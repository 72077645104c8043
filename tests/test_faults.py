"""Faulty symbols are set aside in every workflow, runs that fail say so, and the others are as without them."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tests.test_backtest import K, bars
from tests.test_research import WAVE
from tidemill.functions.rules import sound_bars, with_faulty, with_status
from tidemill.operators import backtest as bt
from tidemill.operators import nulls, signals
from tidemill.plans import workflows as wf

GRID = {"ma_crossover": {"short_window": [2, 3], "long_window": [5]}}
FAULTS = {
    "zero": ("price_not_positive", 0.0),
    "nan": ("price_not_finite", float("nan")),
    "null": ("price_missing", None),
    "infinite": ("price_not_finite", float("inf")),
}


def panel(spark):
    """(all bars, those of the sound symbol, status by symbol)."""
    b = bars(spark, WAVE).drop("target_position").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    bad, status = b, {"A": "ok", "repeated": "datetime_repeated", "timeless": "datetime_missing"}
    hit = F.dayofmonth("ts") == 9
    for name, (rule, close) in FAULTS.items():
        bad = bad.unionByName(b.withColumns({"symbol": F.lit(name), "close": F.when(hit, F.lit(close).cast("double")).otherwise(F.col("close"))}))
        status[name] = rule
    again = b.withColumn("symbol", F.lit("repeated"))
    bad = bad.unionByName(again).unionByName(again.filter(hit))
    late = b.withColumn("symbol", F.lit("timeless")).withColumn("ts", F.when(hit, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")))
    return bad.unionByName(late), b, status


def test_status_by_symbol(spark):
    bad, b, status = panel(spark)
    assert {r.symbol: r.status for r in with_status(bad).select("symbol", "status").distinct().collect()} == status
    assert sound_bars(bad.withColumn("volume", F.lit(None).cast("double"))).select("symbol", "volume").distinct().collect() == [("A", 0.0)]
    plan = with_status(bad)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1


@pytest.mark.parametrize("work", ["grid", "validation", "folds", "protocol", "families"])
def test_every_workflow_sets_faulty_symbols_aside(spark, work):
    bad, b, status = panel(spark)
    run = {
        "grid": lambda x: wf.grid_search(spark, x, K, GRID),
        "validation": lambda x: wf.validate_search(spark, x, GRID, 0.6, chance=wf.Chance(3, 2)),
        "folds": lambda x: wf.walk_forward(spark, x, GRID, 30, 15, 15)[0],
        "protocol": lambda x: wf.research_protocol(spark, x, ("2024-01-01", "2024-02-20"), ("2024-02-21", "2024-12-31"), GRID, samples=20),
        "families": lambda x: wf.compare_families(spark, x, GRID, 0.6),
    }[work]
    got, want = run(bad), run(b)
    order = [c for c in ("fold", "cand_id") if c in got.columns]
    sound = got.orderBy(*order).collect()
    assert len(sound) and str(sound) == str(want.orderBy(*order).collect())
    reported = with_faulty(got, bad).select("symbol", "status").distinct().collect()
    assert {r.symbol: r.status for r in reported} == status


def test_a_run_that_fails_stops_no_other(spark):
    closes = {"zero": [1.0, 0.0, 2.0, 3.0], "first": [0.0, 1.0, 2.0, 3.0], "gap": [1.0, None, 2.0, 3.0], "good": [1.0, 2.0, 3.0, 4.0]}
    df = None
    for name, c in closes.items():
        one = bars(spark, [x if x is not None else 1.0 for x in c], [1.0] * 4).withColumns({"symbol": F.lit(name), "close": F.when(F.dayofmonth("ts") == c.index(None) + 1, None).otherwise(F.col("close")) if None in c else F.col("close")})
        df = one if df is None else df.unionByName(one)
    got = {r.symbol: r for r in bt.metrics(bt.backtest(df, K), K).collect()}
    assert math.isfinite(got["good"].score) and all(math.isnan(got[x].score) for x in ("zero", "first", "gap"))
    hold = {r.symbol: r for r in bt.buy_and_hold_summary(df, K).collect()}
    assert hold["good"].benchmark_status == "ok" and hold["good"].benchmark_total_return == pytest.approx(3.0)
    assert {hold[x].benchmark_status for x in ("zero", "first", "gap")} == {"price_unusable"} and math.isnan(hold["first"].benchmark_total_return)


def test_a_path_that_fails_has_a_status(spark):
    bad, b, _ = panel(spark)
    short = b.withColumn("symbol", F.lit("short")).orderBy("ts").limit(2)
    whole = bad.unionByName(short)
    targets = lambda df, keys: signals.ma_targets(df, keys, 2, 5, scale=None)
    observed = bt.metrics(bt.backtest(signals.ma_targets(whole.filter("symbol <> 'timeless'"), K, 2, 5), K), K)
    observed = observed.unionByName(observed.limit(1).withColumn("symbol", F.lit("absent")))
    got = {r.symbol: (r.permutation_status, r.permutation_error) for r in wf.permutation_report(observed, whole, K, targets, 4, 3).collect()}
    assert {k for k, v in got.items() if v[0] == "error"} == {"zero", "nan", "null", "infinite", "short", "absent"}
    assert got["zero"][1] == got["null"][1] == "price_unusable" and got["short"][1] == "block_too_long" and got["absent"][1] == "no_bars"
    assert got["A"] in (("completed_passed", None), ("completed_failed", None))


def test_paths_are_made_where_their_bars_are(spark):
    b = bars(spark, WAVE).drop("target_position")
    plan = bt.metrics(bt.backtest(signals.ma_targets(nulls.null_paths(b, K, 50, 4), [*K, "perm_id"], 2, 5, scale=None), [*K, "perm_id"]), [*K, "perm_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "perm_id" not in re.search(r"Exchange hashpartitioning\(([^)]*)\)", text)[1]


def test_validation_shuffles_little(spark):
    _, b, _ = panel(spark)
    df = wf.validate_search(spark, b, GRID, 0.6, chance=wf.Chance(3, 2))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("(?<!Reused)Exchange hashpartitioning", final)) < 15
