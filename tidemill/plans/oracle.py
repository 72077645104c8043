"""DuckDB SQL of the registered queries, written apart from the Spark code: chains of common table expressions."""

from __future__ import annotations

import itertools

CAP, COST, YEAR = 100000.0, 0.0015, 52.0
WEEK = "(date_diff('day', DATE '1990-01-01', ts::DATE) // 7)::INT"
METRICS = ["total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "win_rate", "turnover", "trade_count", "bar_count", "score"]
COUNTS = {"trade_count", "bar_count", "rank"}
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

WEEKLY = """SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  (sum(round(o_totalprice * 100)::BIGINT) // count(*))::DOUBLE / 100.0::DOUBLE AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2"""
SIX_HOURLY = """SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  (sum(round(value * 100)::BIGINT) // count(*))::DOUBLE / 100.0::DOUBLE AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def show(*names: str) -> str:
    """Columns of a result: counts as they are, all else rounded."""
    return ", ".join(f"{n}::BIGINT AS {n}" if n.endswith("_count") or n in COUNTS else f"round({n}, 6) + 0.0 AS {n}" for n in names)


class Chain:
    """A list of common table expressions."""

    def __init__(self, **first: str):
        self.parts = dict(first)

    def add(self, name: str, body: str) -> Chain:
        self.parts[name] = body
        return self

    def sql(self, last: str) -> str:
        return "WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k.endswith('_drawn') else ''}({v})" for k, v in self.parts.items()) + "\n" + last

    # -- backtests -------------------------------------------------------------------------------------------------

    def sums(self, src: str, out: str, keys: str, means=(), highs=(), scale: int | None = 100) -> Chain:
        """sN: sum of the last N closes; hN: highest of the N closes before."""
        c = "close" if scale is None else f"round(close * {scale})"
        cols = []
        for n in sorted(set(means)):
            f = f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            cols.append(f"CASE WHEN count(close) OVER {f} >= {n} THEN sum({c}) OVER {f} END AS s{n}")
        for n in sorted(set(highs)):
            f = f"(PARTITION BY {keys} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            cols.append(f"CASE WHEN count(close) OVER {f} >= {n} THEN max(close) OVER {f} END AS h{n}")
        return self.add(out, f"SELECT *, {', '.join(cols)} FROM {src}")

    def ma(self, src: str, out: str, keys: str, scale: int | None = 100) -> Chain:
        self.sums(src, f"{out}_s", keys, (5, 20), scale=scale)
        return self.add(out, f"SELECT * EXCLUDE (s5, s20), CASE WHEN s5 * 20 > s20 * 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM {out}_s")

    def candidates(self, src: str, out: str, keys: str, grid: dict, scale: int | None = 100) -> Chain:
        """src for every valid candidate of the grid, with target."""
        ma, bo = grid.get("ma_crossover", {}), grid.get("breakout", {})
        pairs = [(s, n) for s, n in itertools.product(ma.get("short_window", []), ma.get("long_window", [])) if 0 < s < n]
        looks = [n for n in bo.get("lookback_window", []) if n > 0]
        self.sums(src, f"{out}_s", keys, [n for p in pairs for n in p], looks, scale)
        one = "SELECT s.* EXCLUDE ({drop}), '{id}' AS cand_id, '{fam}' AS strategy, {short} AS short_window, {long} AS long_window, {look} AS lookback_window, CASE WHEN {up} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM {src} s"
        more = grid.get("momentum", {}).get("momentum_window", [])
        if more:
            lags = ", ".join(f"lag(close, {n}) OVER (PARTITION BY {keys} ORDER BY ts) AS m{n}" for n in more)
            self.parts[f"{out}_s"] = f"SELECT *, {lags} FROM ({self.parts[f'{out}_s']})"
            one = one.replace(", CASE", ", {mom} AS momentum_window, CASE")
        drop = ", ".join([f"s{n}" for n in sorted({n for p in pairs for n in p})] + [f"h{n}" for n in sorted(set(looks))] + [f"m{n}" for n in more])
        rows = [one.format(drop=drop, id=f"ma_crossover:long_window={n}:short_window={s}", fam="ma_crossover", short=s, long=n, look="NULL::INT", mom="NULL::INT", up=f"s{s} * {n} > s{n} * {s}", src=f"{out}_s") for s, n in pairs]
        rows += [
            one.format(
                drop=drop,
                id=f"breakout:lookback_window={n}",
                fam="breakout",
                short="NULL::INT",
                long="NULL::INT",
                look=n,
                mom="NULL::INT",
                up=f"close > h{n}",
                src=f"{out}_s",
            ) for n in looks
        ]
        rows += [
            one.format(
                drop=drop,
                id=f"momentum:momentum_window={n}",
                fam="momentum",
                short="NULL::INT",
                long="NULL::INT",
                look="NULL::INT",
                mom=n,
                up=f"close > m{n}",
                src=f"{out}_s",
            ) for n in more
        ]
        return self.add(out, "\nUNION ALL ".join(rows))

    def backtest(self, src: str, out: str, keys: str, cost: str = str(COST)) -> Chain:
        w = f"(PARTITION BY {keys} ORDER BY ts)"
        self.add(
            f"{out}_a",
            f"SELECT * EXCLUDE (target), greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(target, 0.0))) AS target_position FROM {src}",
        )
        self.add(
            f"{out}_b",
            f"SELECT *, coalesce(lag(target_position) OVER {w}, 0.0) AS position, coalesce(close / lag(close) OVER {w} - 1, 0.0) AS "
            f"close_return FROM {out}_a",
        )
        self.add(f"{out}_c", f"SELECT *, abs(position - coalesce(lag(position) OVER {w}, 0.0)) AS turnover FROM {out}_b")
        self.add(f"{out}_d", f"SELECT *, position * close_return - turnover * {cost}::DOUBLE AS strategy_return FROM {out}_c")
        return self.add(
            out,
            f"SELECT *, {CAP} * product(1 + strategy_return) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM {out}_d",
        )

    def trades(self, src: str, out: str, keys: str) -> Chain:
        w = f"(PARTITION BY {keys} ORDER BY ts)"
        self.add(f"{out}_a", f"SELECT *, coalesce(lag(position) OVER {w}, 0.0) AS before FROM {src}")
        self.add(
            f"{out}_b",
            f"SELECT *, sum(CASE WHEN before = 0 AND position > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED "
            f"PRECEDING)::BIGINT AS trade_id FROM {out}_a",
        )
        return self.add(
            out,
            f"""SELECT {keys}, trade_id, min(ts) AS entry_datetime, max(ts) AS exit_datetime, arg_min(close, ts) AS entry_price, arg_max(close, ts) AS exit_price,
  sum(CASE WHEN position > 0 THEN 1 ELSE 0 END)::BIGINT AS holding_period, product(CASE WHEN position > 0 THEN 1 + close_return ELSE 1 END) - 1 AS trade_gross_return, product(1 + strategy_return) - 1 AS trade_net_return,
  arg_min(position, ts) AS entry_target_position, arg_max(target_position, ts) AS exit_target_position
  FROM {out}_b WHERE trade_id > 0 AND (position > 0 OR (before > 0 AND position = 0)) GROUP BY {keys}, trade_id""",
        )

    def metrics(self, src: str, out: str, keys: str, extra: str = "") -> Chain:
        """extra: further aggregates, each with a comma before it."""
        self.trades(src, f"{out}_t", keys)
        self.add(
            f"{out}_w",
            f"SELECT {keys}, count(*) AS trade_count, avg(CASE WHEN trade_net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM {out}_t GROUP "
            f"BY {keys}",
        )
        self.add(
            f"{out}_d",
            f"SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM {src}",
        )
        self.add(
            f"{out}_m",
            f"SELECT {keys}, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, CASE WHEN count(*) < 2 OR "
            f"stddev_samp(strategy_return) = 0 THEN 0.0 ELSE avg(strategy_return) / stddev_samp(strategy_return) * sqrt({YEAR}) END AS "
            f"sharpe_ratio, min(drawdown) AS max_drawdown, sum(turnover) AS turnover, count(*) AS bar_count{extra} FROM {out}_d GROUP BY {keys}",
        )
        self.add(
            f"{out}_n",
            f"SELECT m.*, pow(1 + total_return, {YEAR} / greatest(bar_count - 1, 1)) - 1 AS annualized_return, coalesce(trade_count, 0) AS "
            f"trade_count, coalesce(win_rate, 0.0) AS win_rate FROM {out}_m m LEFT JOIN {out}_w w USING ({keys})",
        )
        return self.add(
            out,
            f"SELECT *, annualized_return + 0.2 * sharpe_ratio + 0.1 * win_rate - 2.0 * abs(max_drawdown) - 0.01 * turnover / bar_count AS "
            f"score FROM {out}_n",
        )

    def hold(self, src: str, out: str, keys: str) -> Chain:
        self.add(f"{out}_e", f"SELECT *, {CAP} * (close / first_value(close) OVER (PARTITION BY {keys} ORDER BY ts)) AS equity FROM {src}")
        self.add(
            f"{out}_d",
            f"SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM {out}_e",
        )
        return self.add(
            out,
            f"SELECT {keys}, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS benchmark_total_return, min(drawdown) AS benchmark_max_drawdown "
            f"FROM {out}_d GROUP BY {keys}",
        )

    # -- workflows -------------------------------------------------------------------------------------------------

    def ranking(self, src: str, out: str, keys: str, where: str = "true", more: str = "") -> Chain:
        return self.add(
            out,
            f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN isnan(score) THEN '-infinity'::DOUBLE ELSE score END DESC, "
            f"strategy, long_window NULLS FIRST, lookback_window NULLS FIRST{more}, short_window NULLS FIRST) AS rank FROM {src} WHERE {where}",
        )

    def winners(self, src: str, out: str, keys: str, grid: dict, by_family: bool = False) -> Chain:
        """Train and test metrics of the best candidate by train score; src has role train or test.  curve: {out}_tc."""
        run = f"{keys}, cand_id"
        own = ", any_value(strategy) AS strategy, any_value(short_window) AS short_window, any_value(long_window) AS long_window, any_value(lookback_window) AS lookback_window"
        momentum = "momentum" in grid
        own += ", any_value(momentum_window) AS momentum_window" * momentum
        self.add(f"{out}_train", f"SELECT * FROM {src} WHERE role = 'train'").add(f"{out}_test", f"SELECT * FROM {src} WHERE role = 'test'")
        self.candidates(f"{out}_train", f"{out}_rc", keys, grid).backtest(f"{out}_rc", f"{out}_rb", run).metrics(f"{out}_rb", f"{out}_rm", run, own)
        group = f"{keys}, strategy" if by_family else keys
        self.ranking(f"{out}_rm", f"{out}_rk", group, more=", momentum_window NULLS FIRST" * momentum)
        self.add(
            f"{out}_best",
            f"SELECT *, (SELECT count(*) FROM {out}_rk o WHERE "
            f"{' AND '.join(f'o.{k.strip()} = {out}_rk.{k.strip()}' for k in group.split(','))}) AS result_count FROM {out}_rk WHERE rank = 1",
        )
        self.candidates(f"{out}_test", f"{out}_tr", keys, grid).add(f"{out}_tx", f"SELECT r.* FROM {out}_tr r SEMI JOIN {out}_best b USING ({run})")
        self.backtest(f"{out}_tx", f"{out}_tc", run).metrics(f"{out}_tc", f"{out}_tm", run).hold(f"{out}_test", f"{out}_bh", keys)
        return self.beside(
            f"{out}_best",
            f"{out}_tm",
            f"{out}_bh",
            out,
            run,
            keys,
            ", a.strategy, a.result_count, a.short_window, a.long_window, a.lookback_window" + ", a.momentum_window" * momentum,
        )

    def beside(self, train: str, test: str, bench: str, out: str, run: str, keys: str, extra: str = "") -> Chain:
        ks = ", ".join(f"a.{k.strip()}" for k in run.split(","))
        cols = ", ".join(f"a.{c} AS train_{c}, b.{c} AS test_{c}" for c in METRICS)
        self.add(
            f"{out}_ab",
            f"SELECT {ks}{extra}, {cols}, b.annualized_return - a.annualized_return AS return_degradation, b.sharpe_ratio - a.sharpe_ratio AS "
            f"sharpe_degradation, b.max_drawdown - a.max_drawdown AS max_drawdown_delta FROM {train} a JOIN {test} b USING ({run})",
        )
        return self.add(
            out,
            f"SELECT x.*, coalesce(benchmark_total_return, 0) AS benchmark_total_return, coalesce(benchmark_max_drawdown, 0) AS "
            f"benchmark_max_drawdown, test_total_return - coalesce(benchmark_total_return, 0) AS return_excess, test_max_drawdown - "
            f"coalesce(benchmark_max_drawdown, 0) AS max_drawdown_gap FROM {out}_ab x LEFT JOIN {bench} USING ({keys})",
        )


CANDIDATE_VERDICT = """CASE WHEN test_total_return > 0 AND test_sharpe_ratio > 0 AND return_degradation >= 0 AND sharpe_degradation >= 0 AND max_drawdown_delta >= 0 AND return_excess >= 0 THEN 'validated'
  WHEN test_total_return <= 0 OR test_sharpe_ratio <= 0 OR (return_degradation < 0 AND sharpe_degradation < 0 AND max_drawdown_delta < 0) THEN 'rejected' ELSE 'inconclusive' END"""
CANDIDATE_REASONS = """'evidence_complete;' || CASE WHEN test_total_return > 0 AND test_sharpe_ratio > 0 AND return_degradation >= 0 AND sharpe_degradation >= 0 AND max_drawdown_delta >= 0 AND return_excess >= 0
  THEN 'out_of_sample_return_positive;out_of_sample_sharpe_positive;return_degradation_non_negative;sharpe_degradation_non_negative;max_drawdown_delta_non_negative;benchmark_return_excess_non_negative'
  WHEN test_total_return <= 0 THEN 'out_of_sample_return_non_positive' WHEN test_sharpe_ratio <= 0 THEN 'out_of_sample_sharpe_non_positive'
  WHEN return_degradation < 0 AND sharpe_degradation < 0 AND max_drawdown_delta < 0 THEN 'all_degradation_signals_negative' ELSE 'mixed_signals' END"""
RESEARCH_VERDICT = "CASE WHEN test_trade_count >= 1 AND return_degradation >= 0 THEN 'promote' ELSE 'reject' END"
RESEARCH_CHECKS = "'min_return_degradation=' || (return_degradation >= 0)::VARCHAR || ';min_trade_count=' || (test_trade_count >= 1)::VARCHAR || ';rerun_count_within_limit=true;return_degradation_present=true;test_metrics_present=true'"

DIRTY = f"""SELECT symbol, ts, CASE k WHEN 2 THEN -open WHEN 3 THEN NULL ELSE open END AS open, CASE k WHEN 1 THEN low - 1 ELSE high END AS high, CASE k WHEN 4 THEN close + 1 ELSE low END AS low,
  CASE k WHEN 5 THEN 'inf'::DOUBLE ELSE close END AS close, CASE k WHEN 6 THEN NULL ELSE volume END AS volume FROM (SELECT *, {WEEK} % 50 AS k FROM weekly)
  UNION ALL SELECT * FROM weekly WHERE {WEEK} % 50 = 7"""
RULES = {
    "datetime_missing": "ts IS NULL",
    "datetime_repeated": "same > 1",
    "price_missing": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL",
    "price_not_finite": "coalesce(NOT isfinite(open), false) OR coalesce(NOT isfinite(high), false) OR coalesce(NOT isfinite(low), false) OR coalesce(NOT isfinite(close), false)",
    "price_not_positive": "coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false) OR coalesce(close <= 0, false)",
    "high_below_low": "coalesce(high < low, false)",
    "high_below_open": "coalesce(high < open, false)",
    "high_below_close": "coalesce(high < close, false)",
    "low_above_open": "coalesce(low > open, false)",
    "low_above_close": "coalesce(low > close, false)",
    "volume_not_numeric": "coalesce(isnan(volume), false)",
}


def weekly() -> Chain:
    return Chain(weekly=WEEKLY)


def curve(c: Chain | None = None) -> Chain:
    return (c or weekly()).ma("weekly", "tgt", "symbol").backtest("tgt", "eq", "symbol")


def hashed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def null_paths(c: Chain, src: str, out: str, paths: int, block: int, seed: int) -> Chain:
    c.add(
        f"{out}_m",
        f"SELECT *, row_number() OVER w - 1 AS idx, open / lag(close) OVER w AS ro, high / lag(close) OVER w AS rh, low / lag(close) OVER w AS "
        f"rl, close / lag(close) OVER w AS rc FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    )
    c.add(
        f"{out}_p",
        f"SELECT m.*, p.perm_id, CASE WHEN idx = 0 THEN 0 ELSE row_number() OVER (PARTITION BY symbol, perm_id ORDER BY idx > 0, CASE WHEN idx "
        f"> 0 THEN md5((perm_id + {seed})::VARCHAR || '-' || ((idx - 1) // {block})::VARCHAR) END, idx) - 1 END AS pos FROM {out}_m m, (SELECT "
        f"unnest(range({paths}))::INT AS perm_id) p",
    )
    c.add(
        f"{out}_c",
        f"SELECT *, product(CASE WHEN pos = 0 THEN close ELSE rc END) OVER (PARTITION BY symbol, perm_id ORDER BY pos ROWS UNBOUNDED "
        f"PRECEDING) AS sc FROM {out}_p",
    )
    c.add(f"{out}_q", f"SELECT *, lag(sc) OVER (PARTITION BY symbol, perm_id ORDER BY pos) AS pc FROM {out}_c")
    return c.add(
        out,
        f"SELECT q.symbol, q.perm_id, m.ts, CASE WHEN pos = 0 THEN q.open ELSE pc * q.ro END AS open, CASE WHEN pos = 0 THEN greatest(q.open, "
        f"q.high, q.low, sc) ELSE greatest(pc * q.ro, pc * q.rh, pc * q.rl, sc) END AS high, CASE WHEN pos = 0 THEN least(q.open, q.high, "
        f"q.low, sc) ELSE least(pc * q.ro, pc * q.rh, pc * q.rl, sc) END AS low, sc AS close, q.volume FROM {out}_q q JOIN {out}_m m ON "
        f"q.symbol = m.symbol AND q.pos = m.idx",
    )


def path_state(bars: str, block: int) -> str:
    """Whether each symbol's bars can be permuted, and if not, why."""
    return (
        "SELECT symbol, CASE WHEN count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR NOT isfinite(open) OR NOT isfinite(high) OR NOT "
        "isfinite(low) OR NOT isfinite(close) OR least(open, high, low, close) <= 0) > 0 THEN 'price_unusable' "
        f"WHEN count(*) < {block} THEN 'block_too_long' ELSE 'ok' END AS status FROM ({bars}) GROUP BY symbol"
    )


def permutation(paths: int, block: int, seed: int, bars: str = "SELECT * FROM weekly") -> Chain:
    c = weekly().add("half", bars)
    c.ma("half", "ot", "symbol").backtest("ot", "oc", "symbol").metrics("oc", "om", "symbol")
    null_paths(c, "half", "np", paths, block, seed)
    c.ma("np", "nt", "symbol, perm_id", scale=None).backtest("nt", "nc", "symbol, perm_id").metrics("nc", "nm", "symbol, perm_id")
    return c.add(
        "pv",
        "SELECT symbol, any_value(o.score) AS observed, count(*) AS permutations, sum((n.score >= o.score AND NOT isnan(n.score) AND NOT "
        "isnan(o.score))::INT) AS null_ge_count, (sum((n.score >= o.score AND NOT isnan(n.score) AND NOT isnan(o.score))::INT) + 1)::DOUBLE / "
        "(count(*) + 1) AS empirical_p_value FROM nm n JOIN om o USING (symbol) GROUP BY symbol",
    )


def folds(c: Chain, fold: tuple[int, int, int]) -> Chain:
    train, test, step = fold
    c.add(
        "numbered",
        "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM weekly",
    )
    return c.add(
        "folds",
        f"SELECT b.* EXCLUDE (idx, n), f.fold::INT AS fold, CASE WHEN idx < fold * {step} + {train} THEN 'train' ELSE 'test' END AS role, idx "
        f"- fold * {step} - CASE WHEN idx < fold * {step} + {train} THEN 0 ELSE {train} END AS segment_idx FROM numbered b, (SELECT "
        f"unnest(range(10000)) AS fold) f WHERE fold * {step} + {train + test} <= n AND idx >= fold * {step} AND idx < fold * {step} + {train + test}",
    )


def ratio(c: Chain, share: float) -> Chain:
    c.add(
        "numbered",
        "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM weekly",
    )
    return c.add("ratio", f"SELECT * EXCLUDE (idx, n), CASE WHEN idx < floor(n * {share}::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM numbered")


def periods(src: str, p: tuple, names: tuple[str, str]) -> str:
    (a, b), (x, y) = p
    return f"SELECT *, CASE WHEN ts <= TIMESTAMP '{b}' THEN '{names[0]}' ELSE '{names[1]}' END AS role FROM {src} WHERE ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' OR ts BETWEEN TIMESTAMP '{x}' AND TIMESTAMP '{y}'"


def bootstrap(c: Chain, src: str, run: str, samples: int, seed: int) -> Chain:
    """{src}_boot_b: intervals of the returns of src."""
    c.add(
        f"{src}_boot_boot_r",
        f"SELECT {run}, strategy_return AS r, row_number() OVER (PARTITION BY {run} ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY {run}) "
        f"AS n FROM {src}",
    )
    c.add(
        f"{src}_boot_drawn",
        f"SELECT {run}, sample, n, {hashed(f"'{seed}-' || sample::VARCHAR || '-' || i::VARCHAR")} % n AS i FROM {src}_boot_boot_r, (SELECT unnest(range({samples})) AS sample)",
    )
    c.add(f"{src}_boot_boot_u", f"SELECT {run}, sample, d.n, r FROM {src}_boot_drawn d JOIN {src}_boot_boot_r USING ({run}, i)")
    c.add(
        f"{src}_boot_boot_v",
        f"SELECT {run}, sample, avg(r) AS mean, pow(product(1 + r), {YEAR} / any_value(n)) - 1 AS a FROM {src}_boot_boot_u GROUP BY {run}, sample",
    )
    return c.add(
        f"{src}_boot_b",
        f"SELECT {run}, 'ok' AS status, count(*) AS n_bootstrap, quantile_cont(mean, 0.025) AS mean_low, quantile_cont(mean, 0.975) AS "
        f"mean_high, quantile_cont(a, 0.025) AS annualized_low, quantile_cont(a, 0.975) AS annualized_high FROM {src}_boot_boot_v GROUP BY {run}",
    )


def costs(c: Chain, src: str, out: str, run: str) -> Chain:
    """src has target; one backtest for each cost level."""
    wide = []
    for k, m in (("low_cost", 0.5), ("base_cost", 1.0), ("high_cost", 2.0)):
        c.backtest(src, f"{out}_{k}c", run, f"({COST} * {m})").metrics(f"{out}_{k}c", f"{out}_{k}", run)
        wide += [f"{k}.{x} AS {k}_{x}" for x in ("annualized_return", "sharpe_ratio", "max_drawdown")]
    ks = ", ".join(f"low_cost.{k.strip()}" for k in run.split(","))
    c.add(
        f"{out}_w",
        f"SELECT {ks}, {', '.join(wide)} FROM {out}_low_cost low_cost JOIN {out}_base_cost base_cost USING ({run}) JOIN {out}_high_cost "
        f"high_cost USING ({run})",
    )
    good = {k: f"({k}_annualized_return > 0 AND {k}_sharpe_ratio > 0)" for k in ("low_cost", "base_cost", "high_cost")}
    return c.add(
        out,
        f"SELECT *, CASE WHEN {good['low_cost']} AND NOT ({good['base_cost']} AND {good['high_cost']}) THEN 'cost_fragile' ELSE 'stable' END "
        f"AS cost_verdict FROM {out}_w",
    )


AGGREGATES = "SELECT symbol, count(*) AS done, avg(test_total_return) AS mean_test_total_return, avg(test_sharpe_ratio) AS mean_test_sharpe_ratio, avg(test_max_drawdown) AS mean_test_max_drawdown, min(test_max_drawdown) AS worst_test_max_drawdown, avg(test_win_rate) AS mean_test_win_rate, avg(test_turnover) AS mean_test_turnover, sum(test_trade_count)::BIGINT AS total_test_trade_count, avg(benchmark_total_return) AS mean_benchmark_total_return, avg(benchmark_max_drawdown) AS mean_benchmark_max_drawdown, avg(return_excess) AS mean_excess_return FROM wf GROUP BY symbol"
SOME_FAULTY = f"SELECT symbol, ts, symbol IN {{faulty}} AND {WEEK} % 8 = 0 AS late, symbol IN {{faulty}} AND {WEEK} % 9 = 0 AS odd FROM weekly"


def pooled(c: Chain, curve_: str, aggregates: str, train: int, test: int, step: int) -> Chain:
    """wfp: fold aggregates of wf with the Sharpe ratio over all folds' returns, and the decision."""
    c.add("ag", aggregates).add(
        "pl",
        f"SELECT symbol, greatest(0, floor((count(*) - {train + test}) / {step}.0) + 1)::BIGINT AS planned FROM weekly GROUP BY symbol",
    )
    c.add(
        "ps",
        f"SELECT symbol, CASE WHEN count(*) < 2 OR stddev_samp(strategy_return) = 0 THEN 0.0 ELSE avg(strategy_return) / "
        f"stddev_samp(strategy_return) * sqrt({YEAR}) END AS pooled_test_sharpe_ratio FROM {curve_} GROUP BY symbol",
    )
    c.add(
        "pj",
        "SELECT symbol, planned AS fold_count, coalesce(done, 0) AS done, coalesce(mean_test_total_return, 0) AS mean_test_total_return, "
        "coalesce(mean_excess_return, 0) AS ex, coalesce(mean_test_max_drawdown, 0) AS dd, coalesce(mean_benchmark_max_drawdown, 0) AS bd, "
        "pooled_test_sharpe_ratio FROM pl LEFT JOIN ag USING (symbol) LEFT JOIN ps USING (symbol)",
    )
    good = "mean_test_total_return > 0 AND pooled_test_sharpe_ratio > 0 AND ex >= 0 AND dd >= bd"
    cases = [
        ("fold_count = 0", "inconclusive", "no_valid_folds"),
        ("fold_count <> done", "inconclusive", "fold_coverage_incomplete"),
        ("pooled_test_sharpe_ratio IS NULL", "inconclusive", "fold_coverage_complete;missing_pooled_test_sharpe_ratio"),
    ]
    cases += [
        (
            good,
            "validated",
            "fold_coverage_complete;aggregate_return_positive;aggregate_pooled_sharpe_positive;aggregate_return_excess_non_negative;aggregate_drawdown_non_worsening",
        ),
        ("mean_test_total_return <= 0", "rejected", "fold_coverage_complete;aggregate_return_non_positive"),
    ]
    cases += [
        ("pooled_test_sharpe_ratio <= 0", "rejected", "fold_coverage_complete;aggregate_pooled_sharpe_non_positive"),
        ("ex < 0 AND dd < bd", "rejected", "fold_coverage_complete;aggregate_relative_performance_negative"),
        ("true", "inconclusive", "fold_coverage_complete;mixed_signals"),
    ]
    verdict, reasons = ("CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in cases) + " END" for k in (1, 2))
    return c.add("wfp", f"SELECT *, {verdict} AS walk_forward_verdict, {reasons} AS walk_forward_reasons FROM pj")


def every_candidate(c: Chain, grid: dict) -> Chain:
    """v: train and test metrics of every candidate, side by side."""
    c.candidates("ratio", "ec", "symbol, role", grid).backtest("ec", "eb", "symbol, role, cand_id").metrics("eb", "em", "symbol, role, cand_id")
    c.add("ea", "SELECT * FROM em WHERE role = 'train'").add("et", "SELECT * FROM em WHERE role = 'test'").add(
        "h2",
        "SELECT * FROM ratio WHERE role = 'test'",
    )
    return c.hold("h2", "bh", "symbol").beside("ea", "et", "bh", "v", "symbol, cand_id", "symbol")


EXTERNAL = f"SELECT symbol, ts, ts - INTERVAL 1 DAY AS available_at, 'parity' AS signal_name, {WEEK} % 2 AS signal_binary FROM weekly"
BARS = f"symbol, ts, {r6('open', 'high', 'low', 'close', 'volume')}"


def statements(q) -> dict[str, str]:
    """name -> SQL; q: the module of the Spark queries, for its parameters only."""
    own = ", any_value(strategy) AS strategy, any_value(short_window) AS short_window, any_value(long_window) AS long_window, any_value(lookback_window) AS lookback_window"

    def search(c: Chain, src: str, grid: dict, where: str = "max_drawdown >= -0.99 AND trade_count >= 1") -> Chain:
        c.candidates(src, "cc", "symbol", grid).backtest("cc", "cb", "symbol, cand_id").metrics("cb", "cm", "symbol, cand_id", own)
        return c.ranking("cm", "rk", "symbol", where)

    unpermuted = (
        f"SELECT * REPLACE (CASE WHEN symbol = '{q.FAULTY[0]}' AND {WEEK} % 40 = 0 THEN 0.0::DOUBLE ELSE close END AS close) FROM weekly "
        f"WHERE symbol <> '{q.FAULTY[1]}' OR ts < TIMESTAMP '1995-01-30'"
    )

    def sound() -> Chain:
        """The bars of symbols that are not made faulty."""
        return Chain(every=WEEKLY, weekly=f"SELECT * FROM every WHERE symbol NOT IN {q.FAULTY}")

    def set_aside(nulls: str) -> str:
        return f"SELECT DISTINCT symbol, 'datetime_repeated', {nulls} FROM every WHERE symbol IN {q.FAULTY}"

    segment = "role, count(*)::BIGINT AS row_count, min(ts) AS start, max(ts) AS \"end\""
    metrics = show(*METRICS)
    evidence = show(*EVIDENCE)
    fold_c = lambda: folds(weekly(), q.FOLD).winners("folds", "wf", "symbol, fold", q.SMALL)
    train, test, step = q.FOLD
    out = {
        "bars_weekly": weekly().sql(f"SELECT {BARS} FROM weekly"),
        "bars_6h": Chain(b=SIX_HOURLY).sql(f"SELECT {BARS} FROM b"),
        "bars_quality": weekly().add("dirty", DIRTY).add("m", "SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS same FROM dirty").add("a", f"SELECT symbol, count(*)::BIGINT AS source_row_count, sum((volume IS NULL)::INT)::BIGINT AS volume_missing_row_count, {', '.join(f'sum(({x})::INT)::BIGINT AS {k}' for k, x in RULES.items())} FROM m GROUP BY symbol").add("f", f"SELECT *, CASE {' '.join(f'WHEN {k} > 0 THEN {chr(39)}{k}{chr(39)}' for k in RULES)} END AS first_violation FROM a").sql(
            "SELECT *, CASE WHEN first_violation IS NULL THEN source_row_count ELSE 0 END::BIGINT AS accepted_row_count, datetime_repeated AS "
            "duplicate_row_count, 'parse_sort_fail_on_duplicate' AS datetime_policy, 'fail' AS duplicate_datetime_policy, 'fail' AS "
            "missing_ohlc_policy, 'fill_zero' AS missing_volume_policy FROM f"
        ),
        "bar_violations": weekly().add("dirty", DIRTY).add("m", "SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS same FROM dirty").add(
            "v",
            f"SELECT symbol, ts, concat_ws(';', {', '.join(f'CASE WHEN {x} THEN {chr(39)}{k}{chr(39)} END' for k, x in RULES.items())}) AS "
            f"violations FROM m",
        ).sql("SELECT * FROM v WHERE violations <> ''"),
        "ma_signal": weekly().ma("weekly", "t", "symbol").sql("SELECT symbol, ts, target AS target_position FROM t"),
        "breakout_signal": weekly().sums("weekly", "t", "symbol", highs=(20,)).sql(
            "SELECT symbol, ts, CASE WHEN close > h20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_position FROM t"
        ),
        "equity_curve": curve().sql(
            f"SELECT {BARS}, {r6('target_position', 'position', 'close_return', 'turnover', 'strategy_return', 'equity')} FROM eq"
        ),
        "drawdown_series": curve().sql(
            "SELECT symbol, ts, round(equity / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS "
            "drawdown FROM eq"
        ),
        "buy_and_hold": weekly().hold("weekly", "h", "symbol").sql("SELECT symbol, ts, round(equity, 6) + 0.0 AS equity FROM h_e"),
        "benchmark_summary": weekly().hold("weekly", "h", "symbol").sql(
            f"SELECT symbol, {r6('benchmark_total_return', 'benchmark_max_drawdown')}, 'ok' AS benchmark_status FROM h"
        ),
        "trade_log": curve().trades("eq", "tr", "symbol").add("x", "SELECT *, trade_gross_return - trade_net_return AS cost_return_contribution FROM tr").sql(
            f"SELECT symbol, trade_id, entry_datetime, exit_datetime, holding_period, "
            f"{r6('entry_price', 'exit_price', 'trade_gross_return', 'trade_net_return', 'entry_target_position', 'exit_target_position', 'cost_return_contribution')} "
            f"FROM x"
        ),
        "trade_markers": curve().trades("eq", "tr", "symbol").sql(
            "SELECT symbol, entry_datetime AS ts, round(entry_price, 6) + 0.0 AS price, 'entry' AS kind FROM tr UNION ALL SELECT symbol, "
            "exit_datetime, round(exit_price, 6) + 0.0, 'exit' FROM tr"
        ),
        "chunked_equity": curve().trades("eq", "tr", "symbol").sql(
            "SELECT symbol, ts, row_number() OVER w - 1 AS idx, round(position, 4) + 0.0 AS position, round(turnover, 4) + 0.0 AS turnover, "
            "round(equity, 4) + 0.0 AS equity, round(equity / max(equity) OVER w - 1, 4) + 0.0 AS drawdown, trade_id FROM tr_b "
            "WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
        ),
        "rolling_all_lengths": " UNION ALL ".join(
            f"SELECT symbol, ts, {n}::BIGINT AS length, round(s{n}, 6) + 0.0 AS cents, round(h{n}, 6) + 0.0 AS high_before FROM "
            f"({weekly().sums('weekly', 'x', 'symbol', q.LENGTHS, q.LENGTHS).sql('SELECT * FROM x')})" for n in q.LENGTHS
        ),
        "run_metrics": curve().metrics("eq", "m", "symbol").sql(f"SELECT symbol, {metrics} FROM m"),
        "single_experiment": curve().metrics("eq", "m", "symbol").hold("weekly", "h", "symbol").add(
            "x",
            "SELECT *, total_return - benchmark_total_return AS return_excess, max_drawdown - benchmark_max_drawdown AS max_drawdown_gap FROM "
            "m JOIN h USING (symbol)",
        ).sql(f"SELECT symbol, {metrics}, {r6('benchmark_total_return', 'benchmark_max_drawdown', 'return_excess', 'max_drawdown_gap')}, 'ok' AS benchmark_status FROM x"),
        "candidates": "SELECT symbol, c.* FROM (SELECT DISTINCT o_orderpriority AS symbol FROM orders), (SELECT 'ma_crossover:long_window=' || l || ':short_window=' || s AS cand_id, 'ma_crossover' AS strategy, s::BIGINT AS short_window, l::BIGINT AS long_window, NULL::BIGINT AS lookback_window, s < l AS is_valid FROM (SELECT unnest([5, 30]) AS s), (SELECT unnest([20, 40]) AS l) UNION ALL SELECT 'breakout:lookback_window=' || k, 'breakout', NULL, NULL, k, k > 0 FROM (SELECT unnest([0, 10]) AS k)) c",
        "grid_search": search(weekly(), "weekly", q.GRID).sql(f"SELECT symbol, cand_id, rank::BIGINT AS rank, {metrics} FROM rk"),
        "faulty_panel": search(sound(), "weekly", q.SMALL, "true").sql(f"SELECT symbol, 'ok' AS status, cand_id, rank::BIGINT AS rank, round(score, 6) + 0.0 AS score FROM rk UNION ALL {set_aside('NULL, NULL, NULL')}"),
        "faulty_validation": ratio(sound(), 0.7).winners("ratio", "v", "symbol", q.SMALL).sql(
            f"SELECT symbol, 'ok' AS status, cand_id, {evidence}, {CANDIDATE_VERDICT} AS verdict FROM v UNION ALL {set_aside(', '.join(['NULL'] * (len(EVIDENCE) + 2)))}"
        ),
        "faulty_folds": folds(sound(), q.FOLD).winners("folds", "wf", "symbol, fold", q.SMALL).sql(
            f"SELECT symbol, 'ok' AS status, fold::BIGINT AS fold, cand_id, round(test_total_return, 6) + 0.0 AS test_total_return FROM wf UNION ALL {set_aside('NULL, NULL, NULL')}"
        ),
        "permutation_errors": permutation(q.PATHS, q.BLOCK, q.SEED, f"SELECT * FROM ({unpermuted}) WHERE symbol IN (SELECT symbol FROM ({path_state(unpermuted, q.BLOCK)}) WHERE status = 'ok')").sql(
            f"SELECT symbol, round(empirical_p_value, 6) + 0.0 AS empirical_p_value, CASE WHEN status <> 'ok' THEN 'error' WHEN empirical_p_value > 0.5 THEN "
            f"'completed_failed' ELSE 'completed_passed' END AS permutation_status, nullif(status, 'ok') AS permutation_error FROM "
            f"({path_state(unpermuted, q.BLOCK)}) LEFT JOIN pv USING (symbol)"
        ),
        "search_summary": search(weekly(), "weekly", q.GRID).sql(
            "SELECT symbol, count(*)::BIGINT AS result_count, max(CASE WHEN rank = 1 THEN cand_id END) AS best_candidate, round(max(CASE WHEN "
            "rank = 1 THEN score END), 6) + 0.0 AS best_score, string_agg(cand_id, ';' ORDER BY rank) FILTER (rank <= 3) AS top_candidates, "
            "9::BIGINT AS attempted_combinations, 9::BIGINT AS valid_combinations, 0::BIGINT AS invalid_combinations FROM rk GROUP BY symbol"
        ),
        "top_k": search(weekly(), "weekly", q.GRID).sql(
            "SELECT symbol, cand_id, rank::BIGINT AS rank, round(score, 6) + 0.0 AS score FROM rk WHERE rank <= 3"
        ),
        "top_curves": search(weekly(), "weekly", q.GRID).add(
            "x",
            "SELECT symbol, 'Rank ' || rank || ' | SW ' || cb.short_window || ' | LW ' || cb.long_window AS label, ts, equity, equity / "
            "max(equity) OVER (PARTITION BY symbol, cand_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM cb JOIN (SELECT "
            "symbol, cand_id, rank FROM rk WHERE rank <= 2) USING (symbol, cand_id)",
        ).sql("SELECT symbol, label, ts, 'equity' AS series, round(equity, 6) + 0.0 AS value FROM x UNION ALL SELECT symbol, label, ts, 'drawdown', round(drawdown, 6) + 0.0 FROM x"),
        "holdout_split": weekly().sql(
            f"SELECT symbol, {segment} FROM (SELECT *, CASE WHEN ts < TIMESTAMP '{q.CUTOFF}' THEN 'development' ELSE 'holdout' END AS role "
            f"FROM weekly) GROUP BY symbol, role"
        ),
        "development_run": weekly().add(
            "dev",
            f"SELECT * FROM weekly WHERE ts < TIMESTAMP '{q.CUTOFF}'",
        ).ma("dev", "t", "symbol").backtest("t", "e", "symbol").metrics("e", "m", "symbol").sql(f"SELECT symbol, {metrics} FROM m"),
        "period_split": weekly().add(
            "p",
            periods("weekly", q.PERIODS, ("development", "holdout")),
        ).sql(f"SELECT symbol, {segment} FROM p GROUP BY symbol, role"),
        "ratio_split": ratio(weekly(), 0.7).sql("SELECT symbol, ts, role FROM ratio"),
        "fold_map": folds(weekly(), q.FOLD).sql("SELECT symbol, ts, fold::BIGINT AS fold, role, segment_idx::BIGINT AS segment_idx FROM folds"),
        "history_check": ratio(weekly(), 0.4).sql(
            "SELECT symbol, role, count(*)::BIGINT AS row_count, 150::BIGINT AS required, count(*) >= 150 AS enough FROM ratio GROUP BY symbol, role"
        ),
        "walk_forward_folds": fold_c().sql(
            f"SELECT symbol, fold::BIGINT AS fold, cand_id, {evidence}, {CANDIDATE_VERDICT} AS verdict, {RESEARCH_VERDICT} AS research_verdict "
            f"FROM wf"
        ),
        "fold_results": fold_c().add("bd", "SELECT symbol, fold, min(CASE WHEN role = 'train' THEN ts END) AS train_start, max(CASE WHEN role = 'train' THEN ts END) AS train_end, min(CASE WHEN role = 'test' THEN ts END) AS test_start, max(CASE WHEN role = 'test' THEN ts END) AS test_end FROM folds GROUP BY symbol, fold").sql(
            f"SELECT symbol, fold::BIGINT AS fold_index, train_start, train_end, test_start, test_end, short_window::BIGINT AS short_window, "
            f"long_window::BIGINT AS long_window, "
            f"{show('train_score', 'train_total_return', 'train_sharpe_ratio', 'test_total_return', 'test_annualized_return', 'test_sharpe_ratio', 'test_max_drawdown', 'test_win_rate', 'test_turnover', 'test_trade_count', 'benchmark_total_return', 'benchmark_max_drawdown')} "
            f"FROM wf JOIN bd USING (symbol, fold)"
        ),
        "walk_forward_policy": pooled(fold_c(), "wf_tc", AGGREGATES, train, test, step).sql(
            "SELECT symbol, fold_count, round(pooled_test_sharpe_ratio, 6) + 0.0 AS pooled_test_sharpe_ratio, walk_forward_verdict, "
            "walk_forward_reasons FROM wfp"
        ),
        "ranked_results": search(weekly(), "weekly", q.GRID).sql(
            f"SELECT symbol, rank::BIGINT AS rank, strategy, short_window::BIGINT AS short_window, long_window::BIGINT AS long_window, "
            f"{show(*[m for m in METRICS if m != 'bar_count'])} FROM rk"
        ),
        "validation_status": ratio(weekly(), 0.4).add("n", "SELECT symbol, sum((role = 'train')::INT)::BIGINT AS train_rows, sum((role = 'test')::INT)::BIGINT AS test_rows FROM ratio GROUP BY symbol").sql(
            "SELECT *, 150::BIGINT AS required, CASE WHEN train_rows = 0 THEN 'empty_train' WHEN test_rows = 0 THEN 'empty_test' WHEN "
            "train_rows < 150 THEN 'history_too_short' ELSE 'ok' END AS status FROM n"
        ),
        "candidate_policy": every_candidate(ratio(weekly(), 0.5), q.FAMILIES).sql(
            f"SELECT symbol, cand_id, {evidence}, {CANDIDATE_VERDICT} AS candidate_verdict, {CANDIDATE_REASONS} AS candidate_reasons FROM v"
        ),
        "walk_forward_aggregate": fold_c()
        .add("ag", AGGREGATES)
        .add("pl", f"SELECT symbol, greatest(0, floor((count(*) - {train + test}) / {step}.0) + 1)::BIGINT AS planned FROM weekly GROUP BY symbol")
        .sql(
            f"SELECT symbol, planned AS fold_count, coalesce(done, 0)::BIGINT AS validated_fold_count, (planned - coalesce(done, 0))::BIGINT "
            f"AS skipped_fold_count, coalesce(total_test_trade_count, 0)::BIGINT AS total_test_trade_count, "
            f"{', '.join(f'round(coalesce({x}, 0), 6) + 0.0 AS {x}' for x in ('mean_test_total_return', 'mean_test_sharpe_ratio', 'mean_test_max_drawdown', 'worst_test_max_drawdown', 'mean_test_win_rate', 'mean_test_turnover', 'mean_benchmark_total_return', 'mean_benchmark_max_drawdown', 'mean_excess_return'))}, "
            f"CASE WHEN planned = 0 OR planned > coalesce(done, 0) THEN 'inconclusive' ELSE 'validated' END AS coverage_verdict, "
            f"'inconclusive' AS walk_forward_verdict, CASE WHEN planned = 0 THEN 'no_valid_folds' WHEN planned <> coalesce(done, 0) THEN "
            f"'fold_coverage_incomplete' ELSE 'fold_coverage_complete;missing_pooled_test_sharpe_ratio' END AS walk_forward_reasons FROM pl "
            f"LEFT JOIN ag USING (symbol)"
        ),
        "cost_sensitivity": costs(weekly().ma("weekly", "t", "symbol"), "t", "cs", "symbol").sql(
            f"SELECT symbol, "
            f"{r6(*[f'{k}_{x}' for k in ('low_cost', 'base_cost', 'high_cost') for x in ('annualized_return', 'sharpe_ratio', 'max_drawdown')])}, "
            f"cost_verdict FROM cs"
        ),
        "bootstrap_ci": bootstrap(curve(), "eq", "symbol", q.SAMPLES, q.SEED).sql(
            f"SELECT symbol, status, n_bootstrap::BIGINT AS n_bootstrap, {r6('mean_low', 'mean_high', 'annualized_low', 'annualized_high')}, "
            f"annualized_low <= 0 AND annualized_high >= 0 AS ci_crosses_zero, CASE WHEN annualized_low > 0 THEN 'stronger_evidence' ELSE "
            f"'weak_evidence' END AS verdict FROM eq_boot_b"
        ),
        "null_paths": null_paths(weekly(), "weekly", "np", 3, q.BLOCK, q.SEED).sql(
            "SELECT symbol, perm_id::BIGINT AS perm_id, ts, " + ", ".join(
                f"round({x}, 2) + 0.0 AS {x}" for x in ("open", "high", "low", "close", "volume")
            ) + " FROM np"
        ),
        "null_scores": permutation(q.PATHS, q.BLOCK, q.SEED).sql(
            "SELECT symbol, (perm_id + 1)::BIGINT AS permutation_index, round(score, 6) + 0.0 AS metric_value FROM nm"
        ),
        "path_status": weekly().add("dirty", DIRTY).add("x", "SELECT * FROM dirty UNION ALL SELECT symbol || chr(39), ts, open, high, low, close, volume FROM weekly").add(
            "n",
            "SELECT symbol, count(*) AS n, sum((open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR NOT isfinite(open) OR NOT "
            "isfinite(high) OR NOT isfinite(low) OR NOT isfinite(close) OR least(open, high, low, close) <= 0)::INT) AS bad FROM x GROUP BY symbol",
        ).sql(f"SELECT symbol, CASE WHEN bad > 0 THEN 'price_unusable' WHEN n < {q.BLOCK} THEN 'block_too_long' ELSE 'ok' END AS status FROM n"),
        "permutation_test": permutation(q.PATHS, q.BLOCK, q.SEED).sql(
            f"SELECT symbol, permutations::BIGINT AS permutations, null_ge_count::BIGINT AS null_ge_count, "
            f"{r6('observed', 'empirical_p_value')} FROM pv"
        ),
        "permutation_status": permutation(q.PATHS, q.BLOCK, q.SEED).sql(
            "SELECT symbol, CASE WHEN empirical_p_value > 0.5 THEN 'completed_failed' ELSE 'completed_passed' END AS status FROM pv"
        ),
        "family_comparison": ratio(weekly(), 0.7).winners("ratio", "v", "symbol", q.FAMILIES, by_family=True).add("d", f"SELECT *, {CANDIDATE_VERDICT} AS candidate_verdict, {RESEARCH_VERDICT} AS research_verdict FROM v").sql(
            "SELECT symbol, strategy, cand_id, row_number() OVER (PARTITION BY symbol ORDER BY CASE research_verdict WHEN 'promote' THEN 0 "
            "WHEN 'blocked' THEN 1 WHEN 'reject' THEN 2 ELSE 3 END, CASE WHEN isnan(test_score) THEN '-infinity'::DOUBLE ELSE test_score END "
            "DESC, strategy)::BIGINT AS comparison_rank, round(test_score, 6) + 0.0 AS test_score, research_verdict, candidate_verdict FROM d"
        ),
        "comparison_results": ratio(weekly(), 0.7).winners("ratio", "v", "symbol", q.FAMILIES, by_family=True).add("d", f"SELECT *, {CANDIDATE_VERDICT} AS candidate_verdict, {RESEARCH_VERDICT} AS research_verdict FROM v").sql(
            "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY CASE research_verdict WHEN 'promote' THEN 0 WHEN 'blocked' THEN 1 WHEN 'reject' THEN 2 ELSE 3 END, test_score DESC, strategy)::BIGINT AS comparison_rank, strategy AS strategy_name, CASE strategy WHEN 'breakout' THEN '{\"lookback_window\":' || lookback_window || '}' ELSE '{\"long_window\":' || long_window || ',\"short_window\":' || short_window || '}' END AS selected_parameters, " + show(
                "train_score",
                "test_score",
                "train_total_return",
                "test_total_return",
                "train_sharpe_ratio",
                "test_sharpe_ratio",
                "train_max_drawdown",
                "test_max_drawdown",
                "test_trade_count",
                "test_bar_count",
                "benchmark_total_return",
                "return_excess",
            ) + ", 'skipped' AS permutation_status, NULL::DOUBLE AS empirical_p_value, research_verdict AS research_policy_verdict, candidate_verdict AS candidate_policy_verdict FROM d"
        ),
        "bars_validated": weekly().sql(f"SELECT {BARS} FROM weekly WHERE symbol NOT IN {q.FAULTY}"),
        "signal_rejects": weekly().add("x", SOME_FAULTY.format(faulty=q.FAULTY)).sql(
            "SELECT symbol, ts, concat_ws(';', CASE WHEN late THEN 'available_too_late' END, CASE WHEN odd THEN 'signal_not_binary' END) AS "
            "violations FROM x WHERE late OR odd"
        ),
        "signal_status": weekly().sql(
            f"SELECT symbol, CASE WHEN symbol IN {q.FAULTY} THEN CASE WHEN sum(({WEEK} % 8 = 0)::INT) > 0 THEN 'available_too_late' WHEN "
            f"sum(({WEEK} % 9 = 0)::INT) > 0 THEN 'signal_not_binary' ELSE 'ok' END WHEN symbol = '2-HIGH' THEN 'no_signals' WHEN symbol = "
            f"'5-LOW' AND sum(({WEEK} % 7 = 0)::INT) > 0 THEN 'misaligned' ELSE 'ok' END AS status FROM weekly GROUP BY symbol"
        ),
        "signal_validation": weekly().add("x", EXTERNAL).add("y", f"SELECT symbol, ts, CASE WHEN {WEEK} % 8 = 0 THEN ts + INTERVAL 1 DAY ELSE available_at END AS available_at, CASE WHEN {WEEK} % 9 = 0 THEN 2 ELSE signal_binary END AS signal_binary FROM x").sql(
            "SELECT symbol, count(*)::BIGINT AS rows, 0::BIGINT AS datetime_missing, 0::BIGINT AS available_at_missing, 0::BIGINT AS "
            "symbol_missing, 0::BIGINT AS signal_missing, 0::BIGINT AS datetime_repeated, sum((available_at > ts)::INT)::BIGINT AS "
            "available_too_late, sum((signal_binary NOT IN (0, 1))::INT)::BIGINT AS signal_not_binary, CASE WHEN sum((available_at > "
            "ts)::INT) > 0 THEN 'available_too_late' WHEN sum((signal_binary NOT IN (0, 1))::INT) > 0 THEN 'signal_not_binary' END AS "
            "first_violation FROM y GROUP BY symbol"
        ),
        "signal_alignment": weekly().sql(
            f"SELECT symbol, ts, CASE WHEN {WEEK} % 5 = 0 THEN 'missing_signal' ELSE 'extra_signal' END AS side FROM weekly WHERE ({WEEK} % 7 "
            f"<> 0) <> ({WEEK} % 5 <> 0)"
        ),
        "custom_signal_run": lambda: weekly().add("x", EXTERNAL).add(
            "b",
            "SELECT w.*, x.signal_binary::DOUBLE AS target FROM weekly w JOIN x USING (symbol, ts) WHERE symbol NOT IN ('1-URGENT', '2-HIGH', "
            "'3-MEDIUM', '5-LOW')",
        ).add("p", periods("b", q.PERIODS, ("development", "holdout"))).backtest("p", "e", "symbol, role").metrics("e", "m", "symbol, role").add("dev", "SELECT * FROM m WHERE role = 'development'").add("hold", "SELECT * FROM m WHERE role = 'holdout'").add("hb", "SELECT * FROM p WHERE role = 'holdout'").hold("hb", "bh", "symbol").beside("dev", "hold", "bh", "v", "symbol", "symbol"),
        "bucketed_signals": weekly().add("x", EXTERNAL).add("t", "SELECT w.*, x.signal_binary::DOUBLE AS target FROM weekly w JOIN x USING (symbol, ts)").backtest("t", "e", "symbol").metrics("e", "m", "symbol").sql(f"SELECT symbol, {metrics} FROM m"),
        "momentum_validation": ratio(weekly(), 0.7).winners("ratio", "v", "symbol", q.THREE).sql(
            f"SELECT symbol, cand_id, momentum_window::BIGINT AS momentum_window, result_count::BIGINT AS result_count, {evidence}, {CANDIDATE_VERDICT} AS verdict FROM v"
        ),
        "payload_ingest": weekly().sql(
            f"SELECT symbol, ts, round(open, 2) AS open, round(high, 2) AS high, CASE WHEN {WEEK} % 11 = 0 THEN NULL ELSE round(low, 2) END AS "
            f"low, round(close, 2) AS close, volume FROM weekly WHERE month(ts) <> 7 AND {WEEK} % 13 <> 0"
        ),
        "payload_search": search(
            weekly().add(
                "got",
                f"SELECT symbol, ts, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, volume "
                f"FROM weekly WHERE month(ts) <> 7 AND {WEEK} % 13 <> 0 AND {WEEK} % 11 <> 0",
            ),
            "got",
            q.SMALL,
            "true",
        ).sql("SELECT symbol, cand_id, rank::BIGINT AS rank, round(score, 6) + 0.0 AS score FROM rk"),
        "month_sequence": weekly().add(
            "s",
            "SELECT symbol, date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS b FROM weekly GROUP BY symbol",
        ).sql("SELECT symbol, strftime(unnest(generate_series(a, b, INTERVAL 1 MONTH)), '%Y%m%d') AS month FROM s"),
        "keep_last": weekly().sql(
            f"SELECT symbol, ts, {r6('open', 'high', 'low', 'close')}, volume + ({WEEK} % 4 = 0)::INT AS volume, CASE WHEN {WEEK} % 4 = 0 THEN "
            f"2 ELSE 1 END::BIGINT AS ingest_order FROM weekly"
        ),
    }
    c = weekly().candidates("weekly", "cc", "symbol", q.THREE).backtest("cc", "cb", "symbol, cand_id")
    c.metrics("cb", "cm", "symbol, cand_id", own + ", any_value(momentum_window) AS momentum_window").ranking("cm", "rk", "symbol", more=", momentum_window NULLS FIRST")
    out["momentum_search"] = c.sql(f"SELECT symbol, cand_id, rank::BIGINT AS rank, momentum_window::BIGINT AS momentum_window, {metrics} FROM rk")
    out |= {"incremental_ingest": out["keep_last"], "stored_curves": out["top_curves"]}
    out |= {"chunked_trades": out["trade_log"], "chunked_metrics": out["run_metrics"]}  # a run in blocks is the same run
    c = ratio(weekly(), 0.5).ma("ratio", "rt", "symbol, role").backtest("rt", "rc", "symbol, role").metrics("rc", "rm", "symbol, role").add("a", "SELECT * FROM rm WHERE role = 'train'").add("b", "SELECT * FROM rm WHERE role = 'test'").add(
        "h2",
        "SELECT * FROM ratio WHERE role = 'test'",
    ).hold("h2", "bh", "symbol").beside("a", "b", "bh", "v", "symbol", "symbol")
    c.parts |= {k: v for k, v in permutation(q.PATHS, q.BLOCK, q.SEED).parts.items() if k not in c.parts}
    t = "test_trade_count >= 2", "test_max_drawdown >= -0.9", "return_degradation >= 0", "empirical_p_value <= 0.5"
    names = [
        "max_drawdown_cap",
        "max_permutation_p_value",
        "min_return_degradation",
        "min_trade_count",
        "permutation_summary_present_for_null_model",
        "permutation_summary_present_for_p_value",
        "permutation_summary_present_for_scope",
        "required_permutation_null_model",
        "required_permutation_scope",
        "rerun_count_within_limit",
        "return_degradation_present",
        "test_metrics_present",
    ]
    value = {"max_drawdown_cap": t[1], "max_permutation_p_value": t[3], "min_return_degradation": t[2], "min_trade_count": t[0]}
    checks = " || ';' || ".join(f"'{n}=' || ({value.get(n, 'true')})::VARCHAR" for n in names)
    out["research_policy"] = c.sql(
        f"SELECT symbol, CASE WHEN {' AND '.join(t)} THEN 'promote' ELSE 'reject' END AS research_verdict, {checks} AS research_checks FROM v "
        f"JOIN pv USING (symbol)"
    )
    def with_evidence(c: Chain, target: str, curve_: str, run: str) -> Chain:
        c.add("vt", f"SELECT {run}, ts, close, {target} AS target FROM {curve_}")
        return bootstrap(costs(c, "vt", "cs", run), curve_, run, q.SAMPLES, q.SEED)

    def chosen_permutation(c: Chain, bars: str, side: str) -> Chain:
        """pv: the p-value of each symbol's winner of v on permuted bars."""
        null_paths(c, bars, "np", q.PATHS, q.BLOCK, q.SEED)
        c.candidates("np", "nq", "symbol, perm_id", q.SMALL, scale=None).add("nt", "SELECT q.* FROM nq q SEMI JOIN v USING (symbol, cand_id)")
        c.backtest("nt", "nc", "symbol, perm_id").metrics("nc", "nm", "symbol, perm_id")
        good = f"n.score >= {side}_score AND NOT isnan(n.score) AND NOT isnan({side}_score)"
        return c.add(
            "pv",
            f"SELECT symbol, (sum(({good})::INT) + 1)::DOUBLE / (count(*) + 1) AS empirical_p_value FROM nm n JOIN v USING (symbol) GROUP BY symbol",
        )

    boot = "CASE WHEN annualized_low > 0 THEN 'stronger_evidence' ELSE 'weak_evidence' END AS bootstrap_verdict"
    p_status = "CASE WHEN empirical_p_value IS NULL THEN 'error' WHEN empirical_p_value > 0.05 THEN 'completed_failed' ELSE 'completed_passed' END AS permutation_status"
    p_research = "CASE WHEN test_trade_count >= 1 AND return_degradation >= 0 AND empirical_p_value <= 0.05 THEN 'promote' ELSE 'reject' END AS research_verdict"
    p_names = [n for n in names if n != "max_drawdown_cap"]
    p_value = {
        "max_permutation_p_value": "empirical_p_value <= 0.05",
        "min_return_degradation": "return_degradation >= 0",
        "min_trade_count": "test_trade_count >= 1",
    }
    p_checks = " || ';' || ".join(f"'{n}=' || ({p_value.get(n, 'true')})::VARCHAR" for n in p_names)
    c = ratio(weekly(), 0.7).winners("ratio", "v", "symbol", q.SMALL)
    with_evidence(c, "target_position", "v_tc", "symbol, cand_id")
    c.add("tb", "SELECT * EXCLUDE (role) FROM ratio WHERE role = 'test'")
    chosen_permutation(c, "tb", "test")
    out["validate_search"] = c.sql(
        f"SELECT symbol, cand_id, result_count::BIGINT AS result_count, {evidence}, cost_verdict, {boot}, round(empirical_p_value, 6) + 0.0 AS "
        f"empirical_p_value, {p_status}, {CANDIDATE_VERDICT} AS verdict, {CANDIDATE_REASONS} AS candidate_reasons, {p_research}, {p_checks} AS "
        f"research_checks FROM v LEFT JOIN cs USING (symbol, cand_id) LEFT JOIN v_tc_boot_b USING (symbol, cand_id) LEFT JOIN pv USING (symbol)"
    )

    c = out["custom_signal_run"]()
    with_evidence(c.add("he", "SELECT * FROM e WHERE role = 'holdout'"), "target_position", "he", "symbol")
    out["custom_signal_run"] = c.sql(
        f"SELECT symbol, {evidence}, cost_verdict, {boot}, {CANDIDATE_VERDICT} AS verdict, {RESEARCH_VERDICT} AS research_verdict FROM v LEFT "
        f"JOIN cs USING (symbol) LEFT JOIN he_boot_b USING (symbol)"
    )

    plan = "'highest_development_score_after_configured_filters' AS parameter_selection_rule, 'score' AS scoring_formula_name, " + ", ".join(f"'{x}' AS {n}" for n, x in zip(("development_start", "development_end", "holdout_start", "holdout_end"), (*q.PERIODS[0], *q.PERIODS[1]), strict=True))
    out["frozen_plan"] = weekly().add("p", periods("weekly", q.PERIODS, ("train", "test"))).winners("p", "v", "symbol", q.SMALL).sql(
        f"SELECT symbol, strategy AS strategy_family, '{{\"long_window\":' || long_window || ',\"short_window\":' || short_window || '}}' AS "
        f"selected_parameters, {plan}, 0.001::DOUBLE AS fee_rate, 0.0005::DOUBLE AS slippage_rate, {YEAR}::DOUBLE AS annualization_factor, "
        f"4::BIGINT AS search_space_size, 1::BIGINT AS tried_strategy_family_count, result_count::BIGINT AS tried_parameter_combination_count "
        f"FROM v"
    )

    # The protocol: its walk-forward has a chain of its own on the development bars.
    dev = Chain(weekly=f"SELECT * FROM ({WEEKLY}) WHERE ts BETWEEN TIMESTAMP '{q.PERIODS[0][0]}' AND TIMESTAMP '{q.PERIODS[0][1]}'")
    dev = pooled(folds(dev, q.FOLD).winners("folds", "wf", "symbol, fold", q.SMALL), "wf_tc", AGGREGATES, train, test, step).sql(
        "SELECT symbol, fold_count, mean_test_total_return, pooled_test_sharpe_ratio, walk_forward_verdict FROM wfp"
    )
    c = weekly().add("p", periods("weekly", q.PERIODS, ("train", "test"))).winners("p", "v", "symbol", q.SMALL)
    with_evidence(c, "target_position", "v_tc", "symbol, cand_id")
    c.add("tb", "SELECT * EXCLUDE (role) FROM p WHERE role = 'train'")
    chosen_permutation(c, "tb", "train").add("wfd", dev)
    out["research_protocol"] = c.sql(
        f"SELECT symbol, cand_id, result_count::BIGINT AS result_count, {evidence}, {CANDIDATE_VERDICT} AS verdict, cost_verdict, "
        f"{r6('annualized_low', 'annualized_high')}, {boot}, fold_count, "
        f"{r6('mean_test_total_return', 'pooled_test_sharpe_ratio', 'empirical_p_value')}, walk_forward_verdict, {p_status}, {p_research} FROM "
        f"v LEFT JOIN cs USING (symbol, cand_id) LEFT JOIN v_tc_boot_b USING (symbol, cand_id) LEFT JOIN pv USING (symbol) LEFT JOIN wfd USING (symbol)"
    )
    return out
