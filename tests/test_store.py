"""Tables that are added to, curves that are read again, families that callers add."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.test_backtest import K, bars
from tests.test_research import WAVE
from tidemill.operators import backtest as bt
from tidemill.operators import search, signals, splits
from tidemill.plans import workflows as wf
from tidemill.sources import store

ROW = "symbol string, ts timestamp_ntz, close double, ingest_order int, month string"


def rows(spark, *values):
    made = [(s, dt.datetime(2024, m, d), c, o, f"2024{m:02d}") for s, m, d, c, o in values]
    return spark.createDataFrame(made, ROW)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_bars_are_added_and_reruns_change_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    add = lambda df: store.merge_latest(df, path, ["symbol", "ts"], "ingest_order", ["symbol", "month"])
    read = lambda: sorted((r.symbol, r.ts.month, r.ts.day, r.close, r.ingest_order) for r in spark.read.schema(ROW).parquet(path).collect())
    first = [("2330", 1, 2, 1.0, 1), ("2330", 1, 3, 2.0, 1), ("2330", 2, 1, 3.0, 1), ("A", 1, 2, 9.0, 1)]
    assert add(rows(spark, *first)) == 3 and read() == sorted(first)
    before = files(path)
    assert add(rows(spark, *first)) == 0 and files(path) == before
    later = [("2330", 1, 3, 5.0, 2), ("2330", 1, 4, None, 2), ("B", 3, 1, 1.0, 2), ("B", 3, 1, 2.0, 3)]
    assert add(rows(spark, *later)) == 2
    want = [("2330", 1, 2, 1.0, 1), ("2330", 1, 3, 5.0, 2), ("2330", 1, 4, None, 2), ("2330", 2, 1, 3.0, 1), ("A", 1, 2, 9.0, 1), ("B", 3, 1, 2.0, 3)]
    assert sorted(read(), key=str) == sorted(want, key=str)
    kept = {f: t for f, t in files(path).items() if "month=202402" in f or "symbol=A" in f}
    assert kept and kept.items() <= before.items()  # other folders are as they were
    assert add(rows(spark, *later)) == 0
    assert add(rows(spark, ("2330", 1, 3, 4.0, 1))) == 0  # an earlier fetch comes late
    assert add(rows(spark).limit(0)) == 0


def test_only_chosen_curves_are_read(spark, tmp_path):
    b = bars(spark, WAVE).drop("target_position")
    b = b.unionByName(b.withColumn("symbol", F.lit("Z")))
    grid = {"breakout": {"lookback_window": [2, 3, 4, 5, 6, 7, 8]}}
    curves = search.candidate_curves(b, K, search.candidates(spark, grid), grid)
    path = str(tmp_path / "curves")
    store.write_curves(curves, path)
    best = store.kept(search.ranked(search.candidate_metrics(b, K, search.candidates(spark, grid), grid), K).select("symbol", "cand_id", "rank"))
    got = store.read_curves(spark, path, best.filter("rank = 1"))
    want = curves.join(best.filter("rank = 1").hint("merge"), ["symbol", "cand_id"])
    columns = ["symbol", "cand_id", "ts", "equity", "rank"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    plan = got._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    inputs = {r[0].rsplit("/", 2)[1] for r in got.select(F.input_file_name()).distinct().collect()}
    assert len(inputs) <= 2 < len({f.rsplit("/", 2)[1] for f in files(path)})


def test_a_family_is_one_registration(spark):
    family = signals.Family(
        ("rest_days", "hold_days"),
        "rest_days",
        lambda v: v["hold_days"] < v["rest_days"],
        "at",
        lambda df, keys, lists, scale: df.withColumn("at", F.row_number().over(signals.ordered(keys))),
        lambda: F.col("at") % F.col("rest_days") < F.col("hold_days"),
    )
    signals.register("calendar", family)
    try:
        signals.register("calendar", family)
        with pytest.raises(ValueError):
            signals.register("breakout", family)
        grid = {"calendar": {"rest_days": [5, 7], "hold_days": [2, 6]}, "breakout": {"lookback_window": [3]}}
        found = search.candidates(spark, grid)
        assert sorted(r.cand_id for r in found.filter("is_valid and strategy = 'calendar'").collect()) == [
            "calendar:hold_days=2:rest_days=5",
            "calendar:hold_days=2:rest_days=7",
            "calendar:hold_days=6:rest_days=7",
        ]
        assert splits.needed(grid) == 7
        b = bars(spark, WAVE).drop("target_position")
        runs = wf.grid_search(spark, b, K, grid).collect()
        assert sorted(r.rank for r in runs) == [1, 2, 3, 4] and {r.rest_days for r in runs} == {None, 5, 7}
        made = wf.validate_search(spark, b, grid, 0.6).first()
        assert made.result_count == 4 and made.strategy in grid
        with pytest.raises(ValueError):
            search.candidates(spark, {"calendar": {"rest_days": [5], "hold_days": [6]}})
    finally:
        del signals.FAMILIES["calendar"]


def test_grids_are_bounded(spark):
    with pytest.raises(ValueError):
        search.candidates(spark, {"ma_crossover": {"short_window": list(range(1, 400)), "long_window": list(range(1, 400))}})


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    b = bars(spark, WAVE).drop("target_position")
    b = b.unionByName(b.withColumn("symbol", F.lit("Z")))
    s = b.select("symbol", "ts", (F.dayofmonth("ts") % 2).alias("signal_binary"))
    names = ["t_bars", "t_signals"]
    stored = [store.write_bucketed(df, n, str(tmp_path / n), 3) for df, n in zip((b, s), names, strict=True)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        run = bt.metrics(bt.backtest(signals.ma_targets(stored[0], K, 3, 8), K), K)
        both = stored[0].join(stored[1].hint("merge"), ["symbol", "ts"])
        signal = bt.metrics(bt.backtest(both.withColumn("target_position", F.col("signal_binary").cast("double")), K), K)
        assert "Exchange" not in plan(run) and "Exchange" not in plan(both) and "Exchange" not in plan(signal)
        assert both.count() == b.count()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for n in names:
            spark.sql(f"drop table {n}")
    assert sorted(map(str, run.collect())) == sorted(map(str, bt.metrics(bt.backtest(signals.ma_targets(b, K, 3, 8), K), K).collect()))
