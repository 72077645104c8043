"""The registered queries: bars are made from orders and events, all else from the bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import accepted_bars, bar_quality, bar_violations, signal_quality, signal_violations, with_faulty
from ..operators import backtest as bt
from ..operators import blocks, evidence, nulls, policy, search, signals, splits
from ..sources import bars as src
from ..sources import store
from . import reports
from . import workflows as wf

KEYS = ["symbol"]
GRID: search.Grid = search.GRID
SMALL: search.Grid = {"ma_crossover": {"short_window": [5, 10], "long_window": [20, 40]}}
FAMILIES: search.Grid = SMALL | {"breakout": {"lookback_window": [10, 20, 40]}}
MIXED: search.Grid = {"ma_crossover": {"short_window": [5, 30], "long_window": [20, 40]}, "breakout": {"lookback_window": [0, 10]}}
CUTOFF = "1999-01-01"
PERIODS = (("1995-01-02", "1999-12-31"), ("2000-01-01", "2001-08-31"))
FOLD = (80, 30, 30)
PATHS, BLOCK, SAMPLES, SEED = 25, 5, 1000, 42
#: A year has 52 weekly bars.
WEEKLY = bt.Config(annualization=52.0)
CHANCE = wf.Chance(PATHS, BLOCK, SEED, "score", SAMPLES)
#: Symbols whose bars, or signals, are made faulty.
FAULTY = ("1-URGENT", "3-MEDIUM")


signals.register(
    "momentum",
    signals.Family(
        ("momentum_window",),
        "momentum_window",
        lambda v: v["momentum_window"] > 0,
        "earlier",
        lambda bars, keys, lists, scale: bars.withColumn(
            "earlier", F.create_map(*[x for n in lists["momentum_window"] for x in (F.lit(n), F.lag("close", n).over(signals.ordered(keys)))])
        ),
        lambda: F.col("close") > F.try_element_at("earlier", "momentum_window"),
    ),
)
THREE: search.Grid = FAMILIES | {"momentum": {"momentum_window": [4, 13, 26]}}


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    ticks = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    return src.bars_from_ticks(ticks, "o_orderpriority", F.date_trunc("week", "o_orderdate"), "o_totalprice", "o_orderkey")


def six_hourly(spark: SparkSession, sf: str) -> DataFrame:
    ticks = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "value")
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    return src.bars_from_ticks(ticks, "event_type", bucket, "value", "ts")


WEEK_SQL = "cast(floor(datediff(cast(ts as date), date'1990-01-01') / 7) as int)"


def week(c: str = "ts") -> Column:
    return F.floor(F.date_diff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")) / 7).cast("int")


def external(spark: SparkSession, sf: str) -> DataFrame:
    """An external signal for every bar, known a day before."""
    return weekly(spark, sf).select(
        "symbol",
        "ts",
        (F.col("ts") - F.expr("interval 1 day")).alias("available_at"),
        F.lit("parity").alias("signal_name"),
        (week() % 2).alias("signal_binary"),
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars of which some break a rule, one kind of fault for each of several weeks."""
    b, k = weekly(spark, sf), week() % 50
    broken = b.withColumns(
        {
            "high": F.when(k == 1, F.col("low") - 1).otherwise(F.col("high")),
            "open": F.when(k == 2, -F.col("open")).when(k == 3, F.lit(None)).otherwise(F.col("open")),
            "low": F.when(k == 4, F.col("close") + 1).otherwise(F.col("low")),
            "close": F.when(k == 5, F.lit(float("inf"))).otherwise(F.col("close")),
            "volume": F.when(k == 6, F.lit(None)).otherwise(F.col("volume")),
        }
    )
    return broken.unionByName(b.filter(week() % 50 == 7))


def faulty_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars with zero, NaN, null and repeated closes in one symbol, repeated bars in another, and volume missing in all."""
    b, k = weekly(spark, sf), week() % 40
    one, two = (F.col("symbol") == x for x in FAULTY)
    close = F.when(one & (k == 0), 0.0).when(one & (k == 1), float("nan")).when(one & (k == 2), F.lit(None)).otherwise(F.col("close"))
    broken = b.withColumns({"close": close, "volume": F.when(week() % 6 == 0, F.lit(None)).otherwise(F.col("volume"))})
    return broken.unionByName(broken.filter((one & (k == 3)) | (two & (k == 5))))


def unpermuted(spark: SparkSession, sf: str) -> DataFrame:
    """The permutation test of MA(5, 20) where one symbol has closes of zero and another only the bars before 1995-01-30.

    Those are fewer than a block, and so an error, unless every one of the first weeks has an order.
    """
    b = weekly(spark, sf)
    zero = F.when((F.col("symbol") == FAULTY[0]) & (week() % 40 == 0), 0.0).otherwise(F.col("close"))
    b = b.withColumn("close", zero).filter((F.col("symbol") != FAULTY[1]) | (F.col("ts") < "1995-01-30"))
    observed = bt.metrics(bt.backtest(ma(b), KEYS), KEYS, WEEKLY)
    limits = policy.Research(max_p_value=0.5, scope="candidate_fixed")
    return wf.permutation_report(observed, b, KEYS, plain_ma, PATHS, BLOCK, SEED, WEEKLY, limits=limits)


def ma(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return signals.ma_targets(bars, keys, 5, 20)


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return bt.backtest(ma(weekly(spark, sf)), KEYS)


def in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """curve() of MA(5, 20), each symbol's bars dealt out by blocks of 64 that are numbered from buckets of 100 days."""
    return blocks.backtest(weekly(spark, sf), KEYS, ma, 20, WEEKLY, size=64, width=100 * 86400)


#: Lengths of windows that rolling_all_lengths makes at once.
LENGTHS = [1, 2, 3, 5, 8, 13, 20, 21, 34, 50, 55, 89, 100]


def rolling(spark: SparkSession, sf: str) -> DataFrame:
    """For every bar and length: the sum of the last closes in cents, and the highest close before."""
    df = signals.prior_highs(signals.close_sums(weekly(spark, sf), KEYS, LENGTHS), KEYS, LENGTHS)
    each = F.transform(F.array(*map(F.lit, LENGTHS)), lambda n: F.struct(n.alias("length"), F.col("sums")[n].alias("cents"), F.col("highs")[n].alias("high_before")))
    return df.select("symbol", "ts", F.inline(each))


def tidy(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns, doubles to some decimals, counts as bigint, arrays and maps as text."""
    out = []
    for c in columns or df.columns:
        kind = dict(df.dtypes)[c]
        x = F.col(c)
        if kind == "double":
            x = F.round(x, digits)
        elif kind in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        elif kind == "array<string>":
            x = F.array_join(x, ";")
        elif kind == "map<string,boolean>":
            x = F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
        out.append(x.alias(c))
    return df.select(*out)


METRICS = ["total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "win_rate", "turnover", "trade_count", "bar_count", "score"]
EVIDENCE = [
    "test_total_return",
    "test_sharpe_ratio",
    "test_max_drawdown",
    "test_trade_count",
    "return_degradation",
    "sharpe_degradation",
    "max_drawdown_delta",
    "return_excess",
    "max_drawdown_gap",
]


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars as exchange payloads of a symbol and month, with cells and rows that don't count."""
    b = weekly(spark, sf)
    date = F.concat_ws("/", (F.year("ts") - 1911).cast("string"), F.date_format("ts", "MM"), F.date_format("ts", "dd"))
    money = lambda c: F.format_number(F.col(c), 2)
    cells = F.array(
        date,
        F.format_number("volume", 0),
        F.lit("0"),
        money("open"),
        money("high"),
        F.when(week() % 11 == 0, F.lit("--")).otherwise(money("low")),
        money("close"),
        F.lit("0"),
    )
    b = b.withColumn("row", F.struct("ts", F.when(week() % 13 == 0, F.slice(cells, 1, 5)).otherwise(cells).alias("cells")))
    month = b.groupBy("symbol", F.date_format("ts", "yyyyMM").alias("month")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    stat = F.when(F.col("month").endswith("07"), "NO DATA").otherwise("OK")
    doc = F.to_json(F.struct(stat.alias("stat"), F.transform("rows", lambda r: r["cells"]).alias("data")))
    return month.select("symbol", F.col("month").cast("int").alias("ingest_order"), doc.alias("payload"))


def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Bars fetched twice, the second time with another volume for some: the later fetch counts."""
    b = weekly(spark, sf).withColumn("ingest_order", F.lit(1))
    again = b.filter(week() % 4 == 0).withColumns({"volume": F.col("volume") + 1, "ingest_order": F.lit(2)})
    return src.latest(b.unionByName(again), ["symbol", "ts"], "ingest_order")


def months(spark: SparkSession, sf: str) -> DataFrame:
    """Every month from the first to the last bar of each symbol."""
    span = weekly(spark, sf).groupBy("symbol").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return span.select("symbol", F.explode(src.months_between(F.col("a"), F.col("b"))).alias("month"))


def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """The two fetches of keep_last() added one after the other, and the second once more, to a table by symbol and year."""
    b = weekly(spark, sf).withColumns({"ingest_order": F.lit(1), "year": F.year("ts")})
    again = b.filter(week() % 4 == 0).withColumns({"volume": F.col("volume") + 1, "ingest_order": F.lit(2)})
    path = store.new_folder(spark, "bars")
    for fetch in (b, again, again):
        store.merge_latest(fetch, path, ["symbol", "ts"], "ingest_order", ["symbol", "year"])
    return spark.read.schema(b.schema).parquet(path).drop("year")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return wf.grid_search(spark, weekly(spark, sf), KEYS, GRID, WEEKLY, max_drawdown_cap=0.99, min_trade_count=1)


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the external signal, bars and signals read from tables in buckets by symbol."""
    made = []
    for name, df in (("bars", weekly(spark, sf)), ("signals", external(spark, sf))):
        path = store.new_folder(spark, name)
        made.append(store.write_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), path, 8))
    df = signals.signal_targets(*made)
    return bt.metrics(bt.backtest(df, KEYS), KEYS, WEEKLY)


def labelled(curve: DataFrame) -> DataFrame:
    """Equity and drawdown, a row each, of curves with rank and parameters."""
    c = bt.drawdowns(curve, ["symbol", "cand_id"])
    c = c.withColumn("label", search.curve_label(F.col("rank"), F.col("short_window"), F.col("long_window")))
    return c.unpivot(["symbol", "label", "ts"], ["equity", "drawdown"], "series", "value")


def top_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Equity and drawdown of the two best candidates of every symbol, whose targets alone are made again."""
    best = ranked(spark, sf).filter("rank <= 2").select("symbol", "cand_id", "strategy", *search.PARAMETERS, "rank")
    targets = signals.chosen_targets(weekly(spark, sf), KEYS, best, KEYS, GRID)
    curve = bt.backtest(targets, ["symbol", "cand_id"], WEEKLY)
    ranks = best.select("symbol", "cand_id", "rank")
    return labelled(curve.join(ranks.hint("merge"), ["symbol", "cand_id"]))


def stored_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The same from curves that the search wrote: only folders of chosen candidates are read."""
    path = store.new_folder(spark, "curves")
    store.write_curves(search.candidate_curves(weekly(spark, sf), KEYS, search.candidates(spark, GRID), GRID, WEEKLY), path)
    best = store.kept(ranked(spark, sf).select("symbol", "cand_id", "rank")).filter("rank <= 2")
    return labelled(store.read_curves(spark, path, best))


def walk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return wf.walk_forward(spark, weekly(spark, sf), SMALL, *FOLD, WEEKLY)


def pooled_policy(spark: SparkSession, sf: str) -> DataFrame:
    folds, curves = walk(spark, sf)
    return wf.walk_forward_summary(folds, weekly(spark, sf), *FOLD, evidence.pooled_sharpe(curves, KEYS, WEEKLY))


def every_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate policy on every candidate of every symbol, its train and test run side by side."""
    df = splits.by_ratio(weekly(spark, sf), KEYS, 0.5)
    runs = search.candidate_metrics(df, ["symbol", "role"], search.candidates(spark, FAMILIES), FAMILIES, WEEKLY)
    one = lambda r: runs.filter(F.col("role") == r).drop("role")
    both = evidence.train_and_test(one("train"), one("test"), ["symbol", "cand_id"])
    bench = bt.buy_and_hold_summary(df.filter("role = 'test'"), KEYS)
    return policy.candidate_policy(evidence.against_benchmark(both, bench, KEYS))


def faulty_signals(spark: SparkSession, sf: str) -> DataFrame:
    """External signals, some of them late, not binary or missing for two of the symbols."""
    s, some = external(spark, sf), F.col("symbol").isin(*FAULTY)
    late = F.when(some & (week() % 8 == 0), F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("available_at"))
    return s.withColumns({"signal_binary": F.when(some & (week() % 9 == 0), 2).otherwise(F.col("signal_binary")), "available_at": late})


def signals_of_some(spark: SparkSession, sf: str) -> DataFrame:
    """faulty_signals() without those of one symbol, and without every seventh of another."""
    return faulty_signals(spark, sf).filter(f"symbol <> '2-HIGH' and (symbol <> '5-LOW' or {WEEK_SQL} % 7 <> 0)")


def protocol(spark: SparkSession, sf: str, fold: tuple | None = FOLD, chance: wf.Chance | None = None) -> DataFrame:
    return wf.research_protocol(spark, weekly(spark, sf), *PERIODS, SMALL, WEEKLY, SAMPLES, fold, chance)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return wf.permutation_scores(weekly(spark, sf), KEYS, plain_ma, PATHS, BLOCK, SEED, WEEKLY)


def permutation(spark: SparkSession, sf: str) -> DataFrame:
    b = weekly(spark, sf)
    observed = bt.metrics(bt.backtest(ma(b), KEYS), KEYS, WEEKLY)
    return wf.permutation_test(observed, b, KEYS, plain_ma, PATHS, BLOCK, SEED, WEEKLY)


def plain_ma(df: DataFrame, keys: list[str]) -> DataFrame:
    """MA(5, 20) on prices that aren't whole cents."""
    return signals.ma_targets(df, keys, 5, 20, scale=None)


def permutation_status(spark: SparkSession, sf: str) -> DataFrame:
    limits = policy.Research(max_p_value=0.5)
    s = evidence.permutation_status(
        True,
        F.lit(False),
        F.col("empirical_p_value"),
        limits.max_p_value,
        F.lit("return_block_reconstruction"),
        limits.null_model,
        F.lit("candidate_fixed"),
        "candidate_fixed",
    )
    return permutation(spark, sf).withColumn("status", s)


def permuted_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The research policy: each symbol's MA(5, 20) run against its own first half, and a permutation test over all its bars."""
    b = splits.by_ratio(weekly(spark, sf), KEYS, 0.5)
    runs = bt.metrics(bt.backtest(ma(b, ["symbol", "role"]), ["symbol", "role"]), ["symbol", "role"], WEEKLY)
    one = lambda r: runs.filter(F.col("role") == r).drop("role")
    df = evidence.train_and_test(one("train"), one("test"), KEYS).join(
        permutation(spark, sf).select("symbol", "empirical_p_value").hint("merge"),
        "symbol",
    )
    df = df.withColumns({"null_model": F.lit("return_block_reconstruction"), "permutation_scope": F.lit("candidate_fixed")})
    limits = policy.Research(min_trade_count=2, max_drawdown_cap=0.9, max_p_value=0.5, scope="candidate_fixed")
    return policy.research_policy(df, limits)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    b = weekly
    return {
        "bars_weekly": lambda s, d: tidy(b(s, d)),
        "bars_6h": lambda s, d: tidy(six_hourly(s, d)),
        "bars_quality": lambda s, d: tidy(bar_quality(dirty(s, d))),
        "bar_violations": lambda s, d: tidy(bar_violations(dirty(s, d)), "symbol", "ts", "violations"),
        "ma_signal": lambda s, d: tidy(ma(b(s, d)), "symbol", "ts", "target_position"),
        "breakout_signal": lambda s, d: tidy(signals.breakout_targets(b(s, d), KEYS, 20), "symbol", "ts", "target_position"),
        "equity_curve": lambda s, d: tidy(curve(s, d)),
        "drawdown_series": lambda s, d: tidy(bt.drawdowns(curve(s, d), KEYS), "symbol", "ts", "drawdown"),
        "buy_and_hold": lambda s, d: tidy(bt.buy_and_hold(b(s, d), KEYS), "symbol", "ts", "equity"),
        "benchmark_summary": lambda s, d: tidy(bt.buy_and_hold_summary(b(s, d), KEYS)),
        "trade_log": lambda s, d: tidy(bt.trades(curve(s, d), KEYS)),
        "trade_markers": lambda s, d: tidy(bt.trade_markers(bt.trades(curve(s, d), KEYS), KEYS)),
        "chunked_equity": lambda s, d: tidy(in_blocks(s, d), "symbol", "ts", "idx", "position", "turnover", "equity", "drawdown", "trade_id", digits=4),
        "chunked_trades": lambda s, d: tidy(blocks.trades(in_blocks(s, d), KEYS)),
        "chunked_metrics": lambda s, d: tidy(blocks.metrics(in_blocks(s, d), KEYS, WEEKLY)),
        "rolling_all_lengths": lambda s, d: tidy(rolling(s, d)),
        "run_metrics": lambda s, d: tidy(bt.metrics(curve(s, d), KEYS, WEEKLY)),
        "single_experiment": lambda s, d: tidy(wf.experiment(ma(b(s, d)), KEYS, WEEKLY)),
        "candidates": lambda s, d: tidy(b(s, d).select("symbol").distinct().crossJoin(F.broadcast(search.candidates(s, MIXED)))),
        "grid_search": lambda s, d: tidy(ranked(s, d), "symbol", "cand_id", "rank", *METRICS),
        "faulty_panel": lambda s, d: tidy(
            with_faulty(wf.grid_search(s, faulty_panel(s, d), KEYS, SMALL, WEEKLY), faulty_panel(s, d)), "symbol", "status", "cand_id", "rank", "score"
        ),
        "faulty_validation": lambda s, d: tidy(
            with_faulty(wf.validate_search(s, faulty_panel(s, d), SMALL, config=WEEKLY), faulty_panel(s, d)), "symbol", "status", "cand_id", *EVIDENCE, "verdict"
        ),
        "faulty_folds": lambda s, d: tidy(
            with_faulty(wf.walk_forward(s, faulty_panel(s, d), SMALL, *FOLD, WEEKLY)[0], faulty_panel(s, d)), "symbol", "status", "fold", "cand_id", "test_total_return"
        ),
        "permutation_errors": lambda s, d: tidy(unpermuted(s, d)),
        "search_summary": lambda s, d: tidy(search.search_summary(ranked(s, d), KEYS, search.candidates(s, GRID))),
        "top_k": lambda s, d: tidy(ranked(s, d).filter("rank <= 3"), "symbol", "cand_id", "rank", "score"),
        "top_curves": lambda s, d: tidy(top_curves(s, d)),
        "holdout_split": lambda s, d: tidy(splits.segments(splits.by_cutoff(b(s, d), CUTOFF), ["symbol", "role"])),
        "development_run": lambda s, d: tidy(
            bt.metrics(bt.backtest(ma(splits.by_cutoff(b(s, d), CUTOFF).filter("role = 'development'")), KEYS), KEYS, WEEKLY)
        ),
        "period_split": lambda s, d: tidy(splits.segments(splits.by_periods(b(s, d), *PERIODS), ["symbol", "role"])),
        "ratio_split": lambda s, d: tidy(splits.by_ratio(b(s, d), KEYS, 0.7), "symbol", "ts", "role"),
        "fold_map": lambda s, d: tidy(splits.folds(b(s, d), KEYS, *FOLD), "symbol", "ts", "fold", "role", "segment_idx"),
        "history_check": lambda s, d: tidy(splits.history_check(splits.by_ratio(b(s, d), KEYS, 0.4), ["symbol", "role"], GRID)),
        "validate_search": lambda s, d: tidy(
            wf.validate_search(s, b(s, d), SMALL, config=WEEKLY, chance=CHANCE),
            *["symbol", "cand_id", "result_count", *EVIDENCE, "cost_verdict", "bootstrap_verdict", "empirical_p_value", "permutation_status"],
            *["verdict", "candidate_reasons", "research_verdict", "research_checks"],
        ),
        "validation_status": lambda s, d: tidy(wf.validation_status(b(s, d), GRID, 0.4)),
        "candidate_policy": lambda s, d: tidy(every_candidate(s, d), "symbol", "cand_id", *EVIDENCE, "candidate_verdict", "candidate_reasons"),
        "walk_forward_folds": lambda s, d: tidy(walk(s, d)[0], "symbol", "fold", "cand_id", *EVIDENCE, "verdict", "research_verdict"),
        "fold_results": lambda s, d: tidy(reports.fold_results(walk(s, d)[0], SMALL)),
        "walk_forward_aggregate": lambda s, d: tidy(wf.walk_forward_summary(walk(s, d)[0], b(s, d), *FOLD)),
        "walk_forward_policy": lambda s, d: tidy(
            pooled_policy(s, d),
            "symbol",
            "fold_count",
            "pooled_test_sharpe_ratio",
            "walk_forward_verdict",
            "walk_forward_reasons",
        ),
        "ranked_results": lambda s, d: tidy(reports.ranked_results(ranked(s, d), KEYS, GRID)),
        "cost_sensitivity": lambda s, d: tidy(evidence.cost_sensitivity(ma(b(s, d)), KEYS, WEEKLY)),
        "bootstrap_ci": lambda s, d: tidy(nulls.bootstrap(curve(s, d), KEYS, SAMPLES, SEED, WEEKLY.annualization)),
        "null_paths": lambda s, d: tidy(nulls.null_paths(b(s, d), KEYS, 3, BLOCK, SEED), digits=2),
        "null_scores": lambda s, d: tidy(nulls.null_scores(scores(s, d), KEYS)),
        "path_status": lambda s, d: tidy(
            nulls.path_status(dirty(s, d).unionByName(b(s, d).withColumn("symbol", F.concat("symbol", F.lit("'")))), KEYS, BLOCK)
        ),
        "permutation_test": lambda s, d: tidy(permutation(s, d)),
        "permutation_status": lambda s, d: tidy(permutation_status(s, d), "symbol", "status"),
        "research_policy": lambda s, d: tidy(permuted_policy(s, d), "symbol", "research_verdict", "research_checks"),
        "family_comparison": lambda s, d: tidy(
            wf.compare_families(s, b(s, d), FAMILIES, config=WEEKLY), "symbol", "strategy", "cand_id", "comparison_rank", "test_score", "research_verdict", "candidate_verdict"
        ),
        "comparison_results": lambda s, d: tidy(reports.comparison_results(wf.compare_families(s, b(s, d), FAMILIES, config=WEEKLY))),
        "bars_validated": lambda s, d: tidy(
            accepted_bars(dirty(s, d).filter(F.col("symbol").isin(*FAULTY)).unionByName(b(s, d).filter(~F.col("symbol").isin(*FAULTY))))
        ),
        "signal_rejects": lambda s, d: tidy(signal_violations(faulty_signals(s, d)), "symbol", "ts", "violations"),
        "signal_status": lambda s, d: tidy(signals.signal_status(b(s, d), signals_of_some(s, d))),
        "signal_validation": lambda s, d: tidy(
            signal_quality(
                external(s, d).withColumn("signal_binary", F.when(week() % 9 == 0, 2).otherwise(F.col("signal_binary"))).withColumn(
                    "available_at",
                    F.when(week() % 8 == 0, F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("available_at")),
                )
            )
        ),
        "signal_alignment": lambda s, d: tidy(signals.misaligned(b(s, d).filter(week() % 7 != 0), external(s, d).filter(week() % 5 != 0))),
        "custom_signal_run": lambda s, d: tidy(
            wf.custom_signal_run(b(s, d), signals_of_some(s, d), *PERIODS, WEEKLY, SAMPLES),
            *["symbol", *EVIDENCE, "cost_verdict", "bootstrap_verdict", "verdict", "research_verdict"],
        ),
        "research_protocol": lambda s, d: tidy(
            protocol(s, d, chance=CHANCE),
            *["symbol", "cand_id", "result_count", *EVIDENCE, "verdict", "cost_verdict", "annualized_low", "annualized_high", "bootstrap_verdict"],
            *[
                "fold_count",
                "mean_test_total_return",
                "pooled_test_sharpe_ratio",
                "walk_forward_verdict",
                "empirical_p_value",
                "permutation_status",
                "research_verdict",
            ],
        ),
        "frozen_plan": lambda s, d: tidy(wf.frozen_plan(s, protocol(s, d, None), *PERIODS, SMALL, WEEKLY)),
        "payload_ingest": lambda s, d: tidy(src.parse_payloads(payloads(s, d))),
        "payload_search": lambda s, d: tidy(
            wf.grid_search(s, accepted_bars(src.parse_payloads(payloads(s, d)).filter("low is not null")), KEYS, SMALL, WEEKLY),
            "symbol",
            "cand_id",
            "rank",
            "score",
        ),
        "month_sequence": lambda s, d: tidy(months(s, d)),
        "keep_last": lambda s, d: tidy(keep_last(s, d)),
        "incremental_ingest": lambda s, d: tidy(ingested(s, d)),
        "bucketed_signals": lambda s, d: tidy(bucketed(s, d)),
        "stored_curves": lambda s, d: tidy(stored_curves(s, d)),
        "momentum_search": lambda s, d: tidy(wf.grid_search(s, b(s, d), KEYS, THREE, WEEKLY), "symbol", "cand_id", "rank", "momentum_window", *METRICS),
        "momentum_validation": lambda s, d: tidy(
            wf.validate_search(s, b(s, d), THREE, config=WEEKLY), "symbol", "cand_id", "momentum_window", "result_count", *EVIDENCE, "verdict"
        ),
    }
