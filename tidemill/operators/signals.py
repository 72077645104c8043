"""Target positions: families of signals with parameters, external signals, and whatever a caller adds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import signal_quality

Lists = dict[str, list[int]]


@dataclass(frozen=True)
class Family:
    """A kind of signal with whole-numbered parameters.

    valid: whether a combination may be run, from its values by name.  measure(bars, keys, lists, scale): bars with the column named measured,
    which holds what all values of the lists need.  up: whether to be invested, from columns of bars, that one, and parameters.
    history: the parameter that says how many bars are needed.
    """

    parameters: tuple[str, ...]
    history: str
    valid: Callable[[dict[str, int]], bool]
    measured: str
    measure: Callable[[DataFrame, list[str], Lists, int | None], DataFrame]
    up: Callable[[], Column]


#: strategy -> family; register() adds to them, and nothing else names them.
FAMILIES: dict[str, Family] = {}


def register(name: str, family: Family) -> None:
    """Adds a family under a new name.  Its parameters are columns of their own, so two families may share one only in the same sense."""
    if name in FAMILIES and FAMILIES[name] != family:
        raise ValueError(f"{name} is registered already")
    if family.history not in family.parameters:
        raise ValueError("the history must be one of the parameters")
    FAMILIES[name] = family


def parameters_of(columns: list[str]) -> list[str]:
    """Which of some columns are parameters of a family, in the order of registration."""
    return list(dict.fromkeys(p for f in FAMILIES.values() for p in f.parameters if p in columns))


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def close_sums(bars: DataFrame, keys: list[str], windows: list[int], scale: int | None = 100) -> DataFrame:
    """bars with sums, window length -> sum of the last closes in units of 1/scale (null before the window is full).

    Whole units make equal means equal however they are added: running sums are made once, exactly, and each length is the
    difference of two of them, so any number of lengths costs one window over the sorted bars and a look back for each.  With
    scale None the closes are no whole units and are summed as they are, frame by frame.  A close that is missing or no number
    leaves the windows that hold it empty.
    """
    w = ordered(keys)
    lengths = sorted(set(windows))
    if scale is None:
        frame = lambda n: w.rowsBetween(-(n - 1), 0)
        pairs = [x for n in lengths for x in (F.lit(n), F.when(F.count("close").over(frame(n)) >= n, F.sum("close").over(frame(n))))]
        return bars.withColumn("sums", F.create_map(*pairs))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    units = F.round(F.col("close") * scale).try_cast("long")
    df = bars.withColumns({"_sum": F.coalesce(F.sum(units).over(so_far), F.lit(0)), "_count": F.count(units).over(so_far)})
    old = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0))
    pairs = [x for n in lengths for x in (F.lit(n), F.when(F.col("_count") - old("_count", n) >= n, (F.col("_sum") - old("_sum", n)).cast("double")))]
    return df.withColumn("sums", F.create_map(*pairs)).drop("_sum", "_count")


def prior_highs(bars: DataFrame, keys: list[str], windows: list[int]) -> DataFrame:
    """bars with highs, window length -> highest close of the bars before this one (null before the window is full).

    Maxima over 1, 2, 4, .. bars are each made of two of the level before, and any length of two that overlap: every row takes part in
    as many steps as the longest length has bits, whatever the lengths are, and all share one sort.
    """
    w = ordered(keys)
    lengths = sorted(set(windows))
    df = bars.withColumns({"_h1": F.struct(F.col("close").isNull().alias("gap"), F.col("close").alias("x")), "_at": F.row_number().over(w)})
    worse = lambda a, b: F.greatest(a, b)  # noqa: E731  a gap is greater than any price, so it stays to be seen
    size = 1
    while size * 2 <= max(lengths, default=0):
        df = df.withColumn(f"_h{2 * size}", worse(F.col(f"_h{size}"), F.lag(f"_h{size}", size).over(w)))
        size *= 2
    pairs = []
    for n in lengths:
        half = 1 << (n.bit_length() - 1)
        whole = worse(F.lag(f"_h{half}", 1).over(w), F.lag(f"_h{half}", n - half + 1).over(w))
        pairs += [F.lit(n), F.when((F.col("_at") > n) & ~whole["gap"], whole["x"])]
    made = df.withColumn("highs", F.create_map(*pairs))
    return made.drop("_at", *[c for c in made.columns if c.startswith("_h") and c[2:].isdigit()])


def candidate_targets(
    bars: DataFrame,
    keys: list[str],
    candidates: DataFrame,
    grid: dict[str, dict[str, list[int]]],
    parts: int | None = None,
) -> DataFrame:
    """bars x valid candidates with target_position.

    Window sums are made once for each length, then crossed with the candidates.  The candidate list is as long as the
    grid the caller wrote, at most search.MOST rows, so it is broadcast.  Rows stay where their keys are, which is all that the windows of single
    candidates need.  parts: where keys are fewer than cores, deal rows x candidates out to so many partitions by run.
    """
    df = _measured(bars, keys, grid).crossJoin(F.broadcast(candidates.filter("is_valid").drop("is_valid")))
    return _targets(df if parts is None else df.repartition(parts, *keys, "cand_id"), grid)


def chosen_targets(
    bars: DataFrame,
    keys: list[str],
    chosen: DataFrame,
    by: list[str],
    grid: dict[str, dict[str, list[int]]],
    scale: int | None = 100,
) -> DataFrame:
    """bars with target_position of the candidates chosen for their values of by, which are some of keys; other bars are left out."""
    own = [c for c in ("cand_id", "strategy", *parameters_of(chosen.columns)) if c not in by]
    right = chosen.select(*[F.col(k).alias(f"_{k}") for k in by], *own)
    same = [F.col(k) == F.col(f"_{k}") for k in by]
    return _targets(_measured(bars, keys, grid, scale).join(right.hint("merge"), same).drop(*[f"_{k}" for k in by]), grid)


def _measured(bars: DataFrame, keys: list[str], grid: dict[str, Lists], scale: int | None = 100) -> DataFrame:
    """bars with what every family of the grid measures."""
    for name, lists in grid.items():
        bars = FAMILIES[name].measure(bars, keys, lists, scale)
    return bars


def _targets(df: DataFrame, grid: dict[str, Lists]) -> DataFrame:
    up = F.coalesce(*[F.when(F.col("strategy") == name, FAMILIES[name].up()) for name in grid], F.lit(False))
    return df.withColumn("target_position", F.when(up, 1.0).otherwise(0.0)).drop(*[FAMILIES[name].measured for name in grid])


def _lengths(lists: Lists) -> list[int]:
    return [n for values in lists.values() for n in values if n > 0] or [1]


register(
    "ma_crossover",
    Family(
        ("short_window", "long_window"),
        "long_window",
        lambda v: 0 < v["short_window"] < v["long_window"],
        "sums",
        lambda bars, keys, lists, scale: close_sums(bars, keys, _lengths(lists), scale),
        lambda: F.try_element_at("sums", "short_window") * F.col("long_window") > F.try_element_at("sums", "long_window") * F.col("short_window"),
    ),
)
register(
    "breakout",
    Family(
        ("lookback_window",),
        "lookback_window",
        lambda v: v["lookback_window"] > 0,
        "highs",
        lambda bars, keys, lists, scale: prior_highs(bars, keys, _lengths(lists)),
        lambda: F.col("close") > F.try_element_at("highs", "lookback_window"),
    ),
)


def ma_targets(bars: DataFrame, keys: list[str], short: int, long: int, scale: int | None = 100) -> DataFrame:
    """bars with target_position: 1 where the short mean of closes is above the long one; scale as in close_sums()."""
    if not 0 < short < long:
        raise ValueError("windows must be positive, the short one below the long one")
    df = close_sums(bars, keys, [short, long], scale)
    return df.withColumn("target_position", F.when(F.col("sums")[short] * long > F.col("sums")[long] * short, 1.0).otherwise(0.0)).drop("sums")


def breakout_targets(bars: DataFrame, keys: list[str], lookback: int) -> DataFrame:
    """bars with target_position: 1 where the close is above every close of the lookback bars before."""
    if lookback <= 0:
        raise ValueError("the lookback must be positive")
    df = prior_highs(bars, keys, [lookback])
    return df.withColumn("target_position", F.when(F.col("close") > F.col("highs")[lookback], 1.0).otherwise(0.0)).drop("highs")


def signal_targets(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """The bars of symbols that signal_status() finds ok, with the external signal of the same time as target_position.

    A symbol with a faulty, late, missing or extra signal is left out whole: it has no row for which that went unseen.
    """
    good = signal_status(bars, signals).filter("status = 'ok'").select(F.col("symbol").alias("_good"))
    s = signals.select("symbol", "ts", F.col("signal_binary").cast("double").alias("target_position"))
    return bars.join(s.hint("merge"), ["symbol", "ts"]).join(good.hint("merge"), F.col("symbol") == F.col("_good"), "left_semi")


def checked_signals(bars: DataFrame, signals: DataFrame, symbol: str | None = None) -> DataFrame:
    """The signals, if all that bars and signals hold is ok and, where one is named, of that symbol; else an error."""
    if symbol is not None:
        for name, df in (("signals", signals), ("bars", bars)):
            other = df.filter(F.col("symbol").isNull() | (F.col("symbol") != symbol)).select("symbol").first()
            if other is not None:
                raise ValueError(f"symbol {other[0]!r} of the {name} is not the one asked for, {symbol!r}")
    bad = signal_status(bars, signals).filter("status <> 'ok'").orderBy("symbol").limit(5).collect()
    if bad:
        raise ValueError("signals can't be used: " + ", ".join(f"{r['symbol']}: {r['status']}" for r in bad))
    return signals


def signal_status(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """(symbol, status) of every symbol of bars or signals: ok, no_bars, no_signals, the first rule that a signal breaks, or misaligned."""
    broken = signal_quality(signals).select("symbol", "first_violation")
    apart = misaligned(bars, signals).groupBy(F.col("symbol").alias("_a")).agg(F.count("*").alias("apart"))
    sides = bars.select("symbol", F.lit(1).alias("b"), F.lit(0).alias("s")).unionByName(
        signals.select("symbol", F.lit(0).alias("b"), F.lit(1).alias("s"))
    )
    df = sides.groupBy("symbol").agg(F.max("b").alias("b"), F.max("s").alias("s"))
    df = df.join(
        broken.withColumnRenamed("symbol", "_q").hint("merge"),
        F.col("symbol").eqNullSafe(F.col("_q")),
        "left",
    ).join(apart.hint("merge"), F.col("symbol") == F.col("_a"), "left")
    status = F.when(F.col("b") == 0, "no_bars").when(F.col("s") == 0, "no_signals").when(
        F.col("first_violation").isNotNull(),
        F.col("first_violation"),
    )
    return df.select("symbol", status.when(F.col("apart") > 0, "misaligned").otherwise("ok").alias("status"))


def misaligned(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """(symbol, ts, side): times of bars without a signal, and of signals without a bar."""
    b, s = bars.select("symbol", "ts"), signals.select("symbol", "ts")
    missing = b.join(s.hint("merge"), ["symbol", "ts"], "left_anti").withColumn("side", F.lit("missing_signal"))
    return missing.unionByName(s.join(b.hint("merge"), ["symbol", "ts"], "left_anti").withColumn("side", F.lit("extra_signal")))


def checked_targets(bars: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """bars with a caller's target_position of the same keys and time, if each has just one; else an error."""
    at = [*keys, "ts"]
    t = targets.select(*at, "target_position")
    sides = bars.select(*at, F.lit(1).alias("b"), F.lit(0).alias("t")).unionByName(t.select(*at, F.lit(0).alias("b"), F.lit(1).alias("t")))
    if sides.groupBy(*at).agg(F.sum("b").alias("b"), F.sum("t").alias("t")).filter("b <> 1 or t <> 1").head(1):
        raise ValueError("targets and bars must have the same keys and times, each once")
    return bars.join(t.hint("merge"), at)


def custom_targets(bars: DataFrame, keys: list[str], generate: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """bars with target_position from a caller's function of one run's bars in time order; prefer column expressions where they do."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        return pdf.assign(target_position=pd.Series(generate(pdf)).astype(float).to_numpy())

    schema = T.StructType([*bars.schema.fields, T.StructField("target_position", T.DoubleType())])
    return bars.groupBy(*keys).applyInPandas(one, schema)
