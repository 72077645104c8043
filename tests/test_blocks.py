"""Runs in blocks and windows of many lengths: against the plain ones, and their plans."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest as bt
from tidemill.operators import blocks, signals

K = ["symbol"]
START = dt.datetime(2024, 1, 1)


def ticks(spark, seed=1):
    """Uneven times, a symbol with one bar, another of equal closes, targets between 0 and 1."""
    r = random.Random(seed)
    rows = []
    for symbol, n in (("A", 300), ("B", 37), ("C", 1), ("D", 90)):
        at, close = START, 100.0
        for _ in range(n):
            at += dt.timedelta(seconds=r.choice([1, 1, 60, 3600, 86400 * 9]))
            close = 50.0 if symbol == "D" else max(1.0, close + r.choice([-2, -1, 0, 1, 2]) + r.choice([0, 0.5]))
            rows.append((symbol, at, close, close, close, close, 1.0, r.choice([0.0, 0.0, 0.5, 1.0, 1.0, 2.0, None])))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, target_position double")


def same(got, want, *names):
    """Equal rows, numbers but for the last digits, in the order of symbol and first column."""
    a, b = (sorted(map(tuple, df.select("symbol", *names).collect()), key=lambda r: (str(r[0]), str(r[1]))) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or u == pytest.approx(v, rel=1e-9, abs=1e-12), (x, y)


@pytest.mark.parametrize("size, width", [(4, 7200), (50, 86400), (1000, 10**9), (4, None)])
def test_a_run_in_blocks_is_the_same_run(spark, size, width):
    b = ticks(spark)
    plain = bt.drawdowns(bt.backtest(b, K), K)
    curve = blocks.backtest(b, K, lambda df, keys: df, 1, size=size, width=width)
    names = ["ts", "position", "close_return", "turnover", "strategy_return", "equity", "drawdown"]
    same(curve, plain, *names)
    columns = bt.trades(plain, K).columns[1:]
    same(blocks.trades(curve, K), bt.trades(plain, K), *columns)
    columns = sorted(set(bt.metrics(plain.drop("drawdown"), K).columns) - {"symbol"})
    same(blocks.metrics(curve, K), bt.metrics(plain.drop("drawdown"), K), *columns)


def test_windows_look_into_the_block_before(spark):
    b = ticks(spark, 2).drop("target_position")
    made = lambda df, keys: signals.ma_targets(df, keys, 3, 8)
    got = blocks.backtest(b, K, made, 8, size=10, width=5000)
    same(got, bt.backtest(made(b, K), K), "ts", "target_position", "equity")
    with pytest.raises(ValueError):
        blocks.blocked(b.withColumn("idx", F.lit(0)), 5, 6)


def test_rows_are_numbered_without_a_task_for_a_run(spark):
    b = ticks(spark).unionByName(ticks(spark, 9).limit(2).withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("symbol", F.lit(None).cast("string")))
    got = blocks.numbered_by_buckets(b, K, 3600)
    idx = {s: sorted(r.idx for r in got.collect() if r.symbol == s) for s in ("A", "B", "C", "D", None)}
    assert idx == {"A": list(range(300)), "B": list(range(37)), "C": [0], "D": list(range(90)), None: [0, 1]}
    late = [r.ts for r in got.filter("symbol = 'A'").orderBy("idx").collect()]
    assert late == sorted(late)
    empty = b.limit(0)
    assert blocks.backtest(empty, K, lambda df, keys: df, 1, size=4).count() == 0
    assert blocks.bucket_seconds(b.filter("symbol = 'D'"), K, 10**9) > 86400


def closes(spark, values):
    rows = [("A", START + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


@pytest.mark.parametrize("values", [[float(i * 7 % 11) for i in range(40)], [1.0, None, 3.0, float("nan"), 5.0, 4.0, 6.0, 2.0, 9.0, 1.0, 7.0, 3.0]])
def test_windows_of_many_lengths(spark, values):
    lengths = [1, 2, 3, 4, 5, 7, 8, 9, 13]
    rows = signals.prior_highs(signals.close_sums(closes(spark, values), K, lengths), K, lengths).orderBy("ts").collect()
    whole = lambda xs, n: len(xs) == n and all(x is not None for x in xs)
    for i, row in enumerate(rows):
        for n in lengths:
            last, before = values[max(0, i - n + 1) : i + 1], values[max(0, i - n) : i]
            assert row.sums[n] == (sum(last) * 100 if whole(last, n) and all(x == x for x in last) else None), (i, n)
            if whole(before, n) and all(x == x for x in before):
                assert row.highs[n] == max(before), (i, n)
            elif not whole(before, n):
                assert row.highs[n] is None


def test_any_number_of_lengths_shares_one_sort_and_no_sliding_frame(spark):
    lengths = list(range(2, 60))
    df = signals.prior_highs(signals.close_sums(closes(spark, [1.0, 2.0]), K, lengths), K, lengths)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    frames = re.findall(r"specifiedwindowframe\(RowFrame, ([^)]*)\)", plan)
    assert frames and all(f.startswith("unboundedpreceding") or len(set(re.findall(r"-?\d+", f))) == 1 for f in frames)
