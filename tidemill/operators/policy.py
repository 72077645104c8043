"""Decision rules: verdict and reasons as columns, in the order in which the rules are tried."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import VERDICT_ORDER, text_array

# The reasons that a decision gives.
MISSING = ["missing_train_metrics", "missing_test_metrics", "missing_degradation_summary", "missing_benchmark_relative_summary"]
VALIDATED = [
    "evidence_complete",
    "out_of_sample_return_positive",
    "out_of_sample_sharpe_positive",
    "return_degradation_non_negative",
    "sharpe_degradation_non_negative",
    "max_drawdown_delta_non_negative",
    "benchmark_return_excess_non_negative",
]
FOLDS_VALIDATED = [
    "fold_coverage_complete",
    "aggregate_return_positive",
    "aggregate_pooled_sharpe_positive",
    "aggregate_return_excess_non_negative",
    "aggregate_drawdown_non_worsening",
]


def _decide(df: DataFrame, rules: list[tuple[Column, str, list[str]]], prefix: str) -> DataFrame:
    """The first rule that holds; the last one's condition is not looked at."""
    *some, (_, verdict, reasons) = rules
    v, r = F, F
    for when, a, b in some:
        v, r = v.when(when, F.lit(a)), r.when(when, text_array(*b))
    return df.withColumn(f"{prefix}verdict", v.otherwise(F.lit(verdict))).withColumn(f"{prefix}reasons", r.otherwise(text_array(*reasons)))


def candidate_policy(df: DataFrame, prefix: str = "candidate_") -> DataFrame:
    """validated, rejected or inconclusive for rows of train and test metrics, degradations and excess return."""
    c = F.col
    none = lambda *names: ~F.coalesce(*[c(n).isNotNull() for n in names], F.lit(True)) if len(names) == 1 else F.greatest(*[c(n).isNull() for n in names])
    total, sharpe = c("test_total_return"), c("test_sharpe_ratio")
    a, b, d = c("return_degradation"), c("sharpe_degradation"), c("max_drawdown_delta")
    rules = [
        (none("train_total_return"), "inconclusive", MISSING[:1]),
        (none("test_total_return"), "inconclusive", MISSING[1:2]),
        (none("return_degradation", "sharpe_degradation", "max_drawdown_delta"), "inconclusive", MISSING[2:3]),
        (none("return_excess"), "inconclusive", MISSING[3:]),
        ((total > 0) & (sharpe > 0) & (a >= 0) & (b >= 0) & (d >= 0) & (c("return_excess") >= 0), "validated", VALIDATED),
        (total <= 0, "rejected", ["evidence_complete", "out_of_sample_return_non_positive"]),
        (sharpe <= 0, "rejected", ["evidence_complete", "out_of_sample_sharpe_non_positive"]),
        ((a < 0) & (b < 0) & (d < 0), "rejected", ["evidence_complete", "all_degradation_signals_negative"]),
        (F.lit(True), "inconclusive", ["evidence_complete", "mixed_signals"]),
    ]
    return _decide(df, rules, prefix)


def walk_forward_policy(df: DataFrame, pooled: str | None = None, prefix: str = "walk_forward_") -> DataFrame:
    """The same for aggregates over folds, with fold_count, validated_fold_count and skipped_fold_count.

    pooled: the column of the Sharpe ratio over the returns of all folds.  Without one the verdict stays inconclusive.
    """
    c = F.col
    p = c(pooled) if pooled else F.lit(None).cast("double")
    total, excess, drop, bench = c("mean_test_total_return"), c("mean_excess_return"), c("mean_test_max_drawdown"), c("mean_benchmark_max_drawdown")
    rules = [
        (c("fold_count") <= 0, "inconclusive", ["no_valid_folds"]),
        (
            (c("validated_fold_count") <= 0) | (c("skipped_fold_count") > 0) | (c("validated_fold_count") != c("fold_count")),
            "inconclusive",
            ["fold_coverage_incomplete"],
        ),
        (total.isNull() | c("mean_test_sharpe_ratio").isNull() | drop.isNull(), "inconclusive", ["missing_aggregate_test_metrics"]),
        (bench.isNull() | excess.isNull(), "inconclusive", ["missing_aggregate_benchmark_metrics"]),
        (p.isNull(), "inconclusive", ["fold_coverage_complete", "missing_pooled_test_sharpe_ratio"]),
        ((total > 0) & (p > 0) & (excess >= 0) & (drop >= bench), "validated", FOLDS_VALIDATED),
        (total <= 0, "rejected", ["fold_coverage_complete", "aggregate_return_non_positive"]),
        (p <= 0, "rejected", ["fold_coverage_complete", "aggregate_pooled_sharpe_non_positive"]),
        ((excess < 0) & (drop < bench), "rejected", ["fold_coverage_complete", "aggregate_relative_performance_negative"]),
        (F.lit(True), "inconclusive", ["fold_coverage_complete", "mixed_signals"]),
    ]
    return _decide(df, rules, prefix)


@dataclass(frozen=True)
class Research:
    """Limits of the research policy; None turns a check off."""

    max_reruns: int = 0
    min_trade_count: int = 1
    max_drawdown_cap: float | None = None
    min_return_degradation: float = 0.0
    max_p_value: float | None = 0.05
    null_model: str | None = "return_block_reconstruction"
    scope: str | None = None


def limits_for(max_drawdown_cap: float | None, min_trade_count: int | None, permuted: bool) -> Research:
    """The limits that follow from those of a search; without a permutation test nothing is asked of one."""
    limits = Research(min_trade_count=1 if min_trade_count is None else min_trade_count, max_drawdown_cap=max_drawdown_cap, scope="candidate_fixed")
    return limits if permuted else without_permutation(limits)


def without_permutation(limits: Research) -> Research:
    """The limits where no permutation test was run."""
    return Research(limits.max_reruns, limits.min_trade_count, limits.max_drawdown_cap, limits.min_return_degradation, None, None, None)


def research_policy(df: DataFrame, limits: Research = Research(), rerun_count: int = 0, prefix: str = "research_") -> DataFrame:
    """promote, reject or blocked, with the named checks and a reason for each.

    df: test metrics, return_degradation, and, where the limits look at them, empirical_p_value, null_model and
    permutation_scope (null: no permutation test).
    """
    c = F.col
    checks: list[tuple[str, Column, Column, Column]] = []  # name, whether it applies, whether it holds, reason

    def add(name: str, holds: Column, yes: Column, no: Column, applies: Column = F.lit(True)) -> None:
        checks.append((name, applies, F.coalesce(holds, F.lit(False)), F.when(F.coalesce(holds, F.lit(False)), yes).otherwise(no)))

    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    shown = lambda name: F.col(name).cast("string")
    trades = shown("test_trade_count")
    add(
        "min_trade_count",
        c("test_trade_count") >= limits.min_trade_count,
        say("trade_count ", trades, f" meets minimum {limits.min_trade_count}"),
        say("trade_count ", trades, f" below minimum {limits.min_trade_count}"),
    )
    if limits.max_drawdown_cap is not None:
        cap = limits.max_drawdown_cap
        add(
            "max_drawdown_cap",
            c("test_max_drawdown") >= -abs(cap),
            say("max_drawdown ", shown("test_max_drawdown"), f" within cap {cap}"),
            say("max_drawdown ", shown("test_max_drawdown"), f" exceeds cap {cap}"),
        )
    has = c("return_degradation").isNotNull()
    add("return_degradation_present", has, F.lit(None).cast("string"), F.lit("missing return_degradation"))
    least = limits.min_return_degradation
    add(
        "min_return_degradation",
        c("return_degradation") >= least,
        say("return_degradation ", shown("return_degradation"), f" meets minimum {least}"),
        say("return_degradation ", shown("return_degradation"), f" below minimum {least}"),
        has,
    )
    if limits.max_p_value is not None:
        p, most = c("empirical_p_value"), limits.max_p_value
        add(
            "permutation_summary_present_for_p_value",
            p.isNotNull(),
            F.lit(None).cast("string"),
            F.lit("missing permutation summary for p-value check"),
        )
        add(
            "max_permutation_p_value",
            p <= most,
            say("permutation p-value ", p.cast("string"), f" within maximum {most}"),
            say("permutation p-value ", p.cast("string"), f" above maximum {most}"),
            p.isNotNull(),
        )
    if limits.null_model is not None:
        m = c("null_model")
        add(
            "permutation_summary_present_for_null_model",
            m.isNotNull(),
            F.lit(None).cast("string"),
            F.lit("missing permutation summary for null-model check"),
        )
        add(
            "required_permutation_null_model",
            m == limits.null_model,
            say("permutation null_model ", m, " matches requirement"),
            say("permutation null_model ", m, f" does not match required {limits.null_model}"),
            m.isNotNull(),
        )
    if limits.scope is not None:
        s = c("permutation_scope")
        add("permutation_summary_present_for_scope", s.isNotNull(), F.lit(None).cast("string"), F.lit("missing permutation summary for scope check"))
        add(
            "required_permutation_scope",
            s == limits.scope,
            say("permutation_scope ", s, " matches requirement"),
            say("permutation_scope ", s, f" does not match required {limits.scope}"),
            s.isNotNull(),
        )

    if rerun_count > limits.max_reruns:
        one = F.create_map(F.lit("rerun_count_within_limit"), F.lit(False))
        reason = text_array(f"rerun_count {rerun_count} exceeds max_reruns {limits.max_reruns}")
        return df.withColumn(f"{prefix}verdict", F.lit("blocked")).withColumn(f"{prefix}checks", one).withColumn(f"{prefix}reasons", reason)
    tested = c("test_trade_count").isNotNull()
    entries = F.array(*[F.when(applies, F.struct(F.lit(name).alias("key"), holds.alias("value"))) for name, applies, holds, _ in checks])
    first = F.array(
        F.struct(F.lit("rerun_count_within_limit").alias("key"), F.lit(True).alias("value")),
        F.struct(F.lit("test_metrics_present").alias("key"), tested.alias("value")),
    )
    all_checks = F.when(tested, F.concat(first, F.filter(entries, lambda x: x.isNotNull()))).otherwise(first)
    passed = F.forall(all_checks, lambda x: x["value"])
    said = F.array(*[F.when(applies, reason) for _, applies, _, reason in checks])
    reasons = F.when(
        tested,
        F.concat(
            text_array("rerun_count_within_limit", "test_metrics_present"),
            F.filter(said, lambda x: x.isNotNull()),
            F.when(passed, text_array("all configured research policy checks passed")).otherwise(F.array().cast("array<string>")),
        ),
    ).otherwise(text_array("rerun_count_within_limit", "missing test metrics"))
    return df.withColumn(
        f"{prefix}verdict",
        F.when(passed, "promote").otherwise("reject"),
    ).withColumn(f"{prefix}checks", F.map_from_entries(all_checks)).withColumn(f"{prefix}reasons", reasons)


def comparison_order(verdict: Column) -> Column:
    rank = F.lit(len(VERDICT_ORDER))
    for k, v in reversed(list(enumerate(VERDICT_ORDER))):
        rank = F.when(verdict == v, k).otherwise(rank)
    return rank
