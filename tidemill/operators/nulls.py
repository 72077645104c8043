"""Chance: bootstrap intervals of returns, and permuted price paths.  Draws come from md5, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import finite
from .backtest import annual_growth
from .signals import ordered


def drawn(*parts: Column | str | int) -> Column:
    """A number below 2^60 that follows from the parts."""
    text = F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: Samples that are drawn in one row: a run's returns are shuffled once for so many.
DRAWS = 100


def bootstrap(curve: DataFrame, keys: list[str], samples: int = 1000, seed: int = 42, per_year: float = 252.0) -> DataFrame:
    """95 % intervals of the mean and the annualised return over resamples of each run's returns, and what they say.

    Null and non-finite returns don't count.  Runs of fewer than two returns, or with one of -100 % or below, get status
    invalid and no interval.  A run's returns travel as one array, once for every DRAWS samples.
    """
    if samples <= 0 or per_year <= 0:
        raise ValueError("samples and bars a year must be positive")
    r = F.col("strategy_return")
    runs = curve.filter(finite(r)).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", r.alias("r")))), lambda x: x["r"]).alias("rs")
    )
    runs = runs.withColumn("status", F.when((F.size("rs") >= 2) & (F.array_min("rs") > -1), "ok").otherwise("invalid"))
    n = F.size("rs")
    drew = runs.filter("status = 'ok'").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS)))).repartition(*keys, "part")
    some = F.sequence(F.col("part") * DRAWS, F.least(F.col("part") * DRAWS + (DRAWS - 1), F.lit(samples - 1)))
    drew = drew.withColumn("sample", F.explode(some))
    pick = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.element_at("rs", (drawn(seed, F.col("sample").cast("string"), i.cast("string")) % n + 1).cast("int")),
    )
    drew = drew.withColumn("pick", pick)
    mean = F.aggregate("pick", F.lit(0.0), lambda s, x: s + x) / n
    growth = F.aggregate("pick", F.lit(1.0), lambda s, x: s * (1 + x))
    made = drew.select(*keys, mean.alias("mean"), annual_growth(growth, n, per_year).alias("annualized"))
    cut = F.array(F.lit(0.025), F.lit(0.975))
    made = made.groupBy(*keys).agg(
        F.count("*").alias("n_bootstrap"),
        F.percentile("mean", cut).alias("m"),
        F.percentile("annualized", cut).alias("a"),
    )
    low = F.col("a")[0]
    made = made.select(
        *keys,
        "n_bootstrap",
        F.col("m")[0].alias("mean_low"),
        F.col("m")[1].alias("mean_high"),
        low.alias("annualized_low"),
        F.col("a")[1].alias("annualized_high"),
        ((low <= 0) & (F.col("a")[1] >= 0)).alias("ci_crosses_zero"),
        F.when(low > 0, "stronger_evidence").otherwise("weak_evidence").alias("verdict"),
    )
    return runs.select(*keys, "status").join(made.hint("merge"), keys, "left")


def null_paths(bars: DataFrame, keys: list[str], paths: int, block: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """Permuted paths: blocks of relative moves in another order, compounded from the first bar, on the original times.

    Adds perm_id.  The recurrence of closes is a running product; the first bar stays, highs and lows hold the bar.  Runs with a
    price that is missing, not finite or not positive, or of fewer bars than a block, have no paths: path_status() tells which.
    Bars are shuffled once by run, into parts (by default as many as the session asks for), and gathered in one row.  A path
    sorts block numbers, not bars, and unfolds the run's moves in their order where they are: no path is shuffled, and windows
    over keys and perm_id find their rows together.
    """
    if paths <= 0 or block <= 0:
        raise ValueError("paths and block must be positive")
    if parts is None:
        parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prices = ["open", "high", "low", "close"]
    bar = F.struct("ts", *prices, "volume")
    runs = bars.repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(bar)).alias("b"), F.count_if(_unusable()).alias("_bad"))
    n = F.size("b")
    runs = runs.filter((F.col("_bad") == 0) & (n >= block)).select(
        *keys,
        F.col("b")[0].alias("first"),
        F.transform("b", lambda x: x["ts"]).alias("times"),
        F.zip_with(
            F.slice("b", 2, n),
            F.slice("b", 1, n - 1),
            lambda x, before: F.struct(*[(x[c] / before["close"]).alias(c) for c in prices], x["volume"].alias("volume")),
        ).alias("moves"),
    )
    count = F.ceil(F.size("moves") / block).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    made = runs.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    rank = lambda i: F.md5(F.concat_ws("-", (F.col("perm_id") + seed).cast("string"), i.cast("string")))
    order = F.array_sort(F.transform(numbers, lambda i: F.struct(rank(i).alias("rank"), i.alias("i"))))
    moved = F.flatten(F.transform(order, lambda x: F.slice("moves", x["i"] * block + 1, F.lit(block))))
    whole = F.concat(F.array(F.struct(*[F.col("first")[c].alias(c) for c in [*prices, "volume"]])), moved)
    run = [*keys, "perm_id"]
    df = made.select(*run, F.inline(F.arrays_zip(F.col("times").alias("ts"), whole.alias("x")))).select(*run, "ts", "x.*")
    w = ordered(run)
    df = df.withColumn("_c", F.product("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_p", F.coalesce(F.lag("_c").over(w), F.lit(1.0)))  # the first bar is itself
    o, h, low = (F.col("_p") * F.col(x) for x in prices[:3])
    c = F.col("_c")
    return df.select(
        *run,
        "ts",
        o.alias("open"),
        F.greatest(o, h, low, c).alias("high"),
        F.least(o, h, low, c).alias("low"),
        c.alias("close"),
        "volume",
    )


def _unusable() -> Column:
    """Whether a bar has a price from which no path can be made."""
    bad = F.lit(False)
    for c in ("open", "high", "low", "close"):
        bad = bad | ~finite(F.col(c)) | F.coalesce(F.col(c) <= 0, F.lit(True))
    return bad


def path_status(bars: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, status): ok, price_unusable, or block_too_long."""
    df = bars.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(_unusable()).alias("bad"))
    return df.select(*keys, F.when(F.col("bad") > 0, "price_unusable").when(F.col("n") < block, "block_too_long").otherwise("ok").alias("status"))


def null_scores(scores: DataFrame, keys: list[str], metric: str = "score") -> DataFrame:
    """(keys, permutation_index, metric_value): the scores of permuted paths, numbered from 1."""
    return scores.select(*keys, (F.col("perm_id") + 1).cast("long").alias("permutation_index"), F.col(metric).alias("metric_value"))


def p_values(observed: DataFrame, nulls: DataFrame, keys: list[str], metric: str = "score") -> DataFrame:
    """(keys, observed, permutations, null_ge_count, empirical_p_value): (null runs at least as good + 1) / (null runs + 1).

    A null run whose metric is no number is not at least as good as anything.
    """
    o = observed.select(*keys, F.col(metric).alias("observed"))
    df = nulls.select(*keys, F.col(metric).alias("_null")).join(o.hint("merge"), keys).groupBy(*keys).agg(
        F.first("observed").alias("observed"),
        F.count("*").alias("permutations"),
        F.count_if(~F.isnan("_null") & ~F.isnan("observed") & (F.col("_null") >= F.col("observed"))).alias("null_ge_count"),
    )
    return df.withColumn("empirical_p_value", (F.col("null_ge_count") + 1) / (F.col("permutations") + 1))
