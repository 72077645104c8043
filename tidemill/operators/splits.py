"""Segments of bars for out-of-sample tests.  A segment is a run of its own: windows start again in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import FAMILIES, ordered


def by_cutoff(bars: DataFrame, cutoff: str) -> DataFrame:
    """bars with role: development before the cutoff, holdout from it on."""
    return bars.withColumn("role", F.when(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"), "development").otherwise("holdout"))


def by_periods(bars: DataFrame, development: tuple[str, str], holdout: tuple[str, str]) -> DataFrame:
    """The bars of two periods, ends included, with role.  They must not overlap, and the holdout comes last."""
    if not development[0] <= development[1] < holdout[0] <= holdout[1]:
        raise ValueError("the development period must end before the holdout period begins")
    within = lambda p: F.col("ts").between(*[F.lit(x).cast("timestamp_ntz") for x in p])
    role = F.when(within(development), "development").when(within(holdout), "holdout")
    return bars.withColumn("role", role).filter("role is not null")


def numbered(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars with idx, from 0 in time order, and n, the number of bars of the run."""
    return bars.withColumn("idx", F.row_number().over(ordered(keys)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def by_ratio(bars: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """bars with role: the first floor(n * ratio) of every run are train, the others test."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio must lie between 0 and 1")
    return numbered(bars, keys).withColumn("role", F.when(F.col("idx") < F.floor(F.col("n") * ratio), "train").otherwise("test")).drop("idx", "n")


def folds(bars: DataFrame, keys: list[str], train: int, test: int, step: int) -> DataFrame:
    """bars with fold, role and segment index of every walk-forward fold that they belong to.

    A bar's folds follow from its number, so it is repeated by a bounded sequence and joined with nothing.
    """
    if min(train, test, step) <= 0:
        raise ValueError("train, test and step must be positive")
    size = train + test
    df = numbered(bars, keys).filter(F.col("n") >= size)
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("int")
    high = F.least(F.floor((F.col("n") - size) / step), F.floor(F.col("idx") / step)).cast("int")
    df = df.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi").withColumn("fold", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("idx") - F.col("fold") * step
    return df.withColumn("role", F.when(at < train, "train").otherwise("test")).withColumn(
        "segment_idx",
        F.when(at < train, at).otherwise(at - train),
    ).drop("_lo", "_hi", "idx", "n")


def checked_segments(df: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """df, if every run of keys has rows of every role; else an error that names some runs and roles."""
    bad = segment_status(df, keys, roles).filter("status <> 'ok'").limit(5).collect()
    if bad:
        raise ValueError("empty segments: " + ", ".join(f"{[r[k] for k in keys]}: {r['status']}" for r in bad))
    return df


def segment_status(df: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """(keys, status): ok, or the first of the roles of which a run has no row."""
    none = F.coalesce(*[F.when(F.count_if(F.col("role") == r) == 0, F.lit(f"empty_{r}")) for r in roles], F.lit("ok"))
    return df.groupBy(*keys).agg(none.alias("status"))


def shared_times(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """(keys, ts): times that rows of both roles have; none where segments are apart."""
    at = [*keys, "ts"]
    return df.groupBy(*at).agg(
        F.count_if(F.col("role") == first).alias("a"),
        F.count_if(F.col("role") == second).alias("b"),
    ).filter("a > 0 and b > 0").select(*at)


def with_history(df: DataFrame, keys: list[str], grid: dict[str, dict[str, list[int]]], role: str = "train") -> DataFrame:
    """The rows of runs whose segment of that role is as long as history_check() asks; a run that isn't can't be searched."""
    rows = F.count_if(F.col("role") == role).over(Window.partitionBy(*keys))
    return df.withColumn("_rows", rows).filter(F.col("_rows") >= needed(grid)).drop("_rows")


def needed(grid: dict[str, dict[str, list[int]]]) -> int:
    return max((max(v[FAMILIES[k].history]) for k, v in grid.items()), default=0)


def segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, first and last time of every segment."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def history_check(df: DataFrame, keys: list[str], grid: dict[str, dict[str, list[int]]]) -> DataFrame:
    """For each segment: whether it is as long as the longest history the grid asks for, invalid combinations included."""
    need = needed(grid)
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).withColumn("required", F.lit(need).cast("long")).withColumn("enough", F.col("row_count") >= need)
