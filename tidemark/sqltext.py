"""Building blocks of the SQL that the registered queries are compared with."""

from __future__ import annotations

P = "(PARTITION BY symbol ORDER BY ts)"
UP_TO = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frame(n: int, key: str = "symbol") -> str:
    return f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int = 1, key: str = "symbol") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY ts)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def roll(f: str, x: str, n: int, least: int | None = None, key: str = "symbol") -> str:
    return f"CASE WHEN count({x}) OVER {frame(n, key)} >= {least or n} THEN {f}({x}) OVER {frame(n, key)} END"


def dev(x: str, n: int, f: str = "stddev_samp") -> str:
    s = f"{f}({x}) OVER {frame(n)}"
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n} THEN CASE WHEN {s} < 1e-12 THEN 0.0 ELSE {s} END END"


def z(x: str, n: int) -> str:
    return div(f"{x} - ({roll('avg', x, n)})", dev(x, n))


def ret(x: str = "close", n: int = 1) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def quantile(x: str, q: float, n: int, least: int | None = None) -> str:
    w = frame(n)
    return f"CASE WHEN count({x}) OVER {w} >= {least or n} THEN list_sort(list({x}) FILTER ({x} IS NOT NULL) OVER {w})[CAST(round_even((count({x}) OVER {w} - 1) * {q}, 0) AS BIGINT) + 1] END"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if " " not in n else f"round({n.rsplit(' AS ', 1)[0]}, 6) AS {n.rsplit(' AS ', 1)[1]}" for n in names)


BARS = """bars AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS ts,
  arg_min(100 + value, ts) AS open, max(100 + value) AS high, min(100 + value) AS low, arg_max(100 + value, ts) AS close,
  CAST(count(*) AS DOUBLE) AS volume, sum(100 + value) AS turnover FROM events GROUP BY 1, 2)"""


def rsi(n: int, name: str, source: str = "bars", flat: float = 50.0, key: str = "symbol", keep: str = "*") -> str:
    """CTEs <name>_c and <name>: the rows of source with column `rsi`."""
    g, l = f"avg(up_) OVER {frame(n, key)}", f"avg(dn_) OVER {frame(n, key)}"
    return f"""{name}_c AS (SELECT *, greatest(coalesce(close - {lag('close', 1, key)}, 0), 0) AS up_, greatest(coalesce({lag('close', 1, key)} - close, 0), 0) AS dn_ FROM {source}),
{name} AS (SELECT * EXCLUDE (up_, dn_), CASE WHEN count(up_) OVER {frame(n, key)} < {n} THEN NULL WHEN {l} < 1e-12 AND {g} < 1e-12 THEN {flat} WHEN {l} < 1e-12 THEN 100.0 ELSE 100 - 100 / (1 + {g} / ({l})) END AS rsi FROM {name}_c)"""


def held(x: str, key: str = "symbol") -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"


def neutral(upper: str = "70", lower: str = "30", leave: str = "50", key: str = "symbol") -> str:
    a = held(f"CASE WHEN rsi >= {upper} THEN 1 WHEN rsi < {leave} THEN 0 END", key)
    b = held(f"CASE WHEN rsi <= {lower} THEN -1 WHEN rsi > {leave} THEN 0 END", key)
    return f"({a} + {b})"


def ledger(source: str, cost: str = "0.0006", key: str = "symbol", low: str = "0", name: str = "ledger") -> str:
    """CTEs up to <name>: source with signal, and all columns of a ledger."""
    up = f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_t AS (SELECT *, greatest({low}.0, least(1.0, CAST({held('signal', key)} AS DOUBLE))) AS target_position, coalesce(close / {lag('close', 1, key)} - 1, 0.0) AS asset_return FROM {source}),
{name}_p AS (SELECT *, coalesce({lag('target_position', 1, key)}, 0.0) AS position FROM {name}_t),
{name}_u AS (SELECT *, abs(position - coalesce({lag('position', 1, key)}, 0.0)) AS turnover, position * asset_return AS gross_return FROM {name}_p),
{name}_n AS (SELECT *, turnover * {cost} AS cost_return, gross_return - turnover * {cost} AS net_return FROM {name}_u),
{name} AS (SELECT *, product(1 + net_return) OVER {up} AS equity, position <> 0 AS is_exposed FROM {name}_n)"""


def metrics(source: str = "ledger", key: str = "symbol", name: str = "metrics") -> str:
    up = f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_k AS (SELECT *, max(equity) OVER {up} AS peak, CAST(floor(ts / 86400) AS BIGINT) AS day FROM {source}),
{name}_w AS (SELECT {key}, arg_max(equity, ts) AS last_, (max(ts) - min(ts)) / 86400.0 AS days_, min(equity / peak - 1) AS mdd, avg(CASE WHEN is_exposed THEN 1.0 ELSE 0.0 END) AS tim FROM {name}_k GROUP BY {key}),
{name}_e AS (SELECT {key}, day, min(equity) / arg_min(equity, ts) - 1 AS d0, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS r0 FROM {name}_k GROUP BY {key}, day),
{name}_d AS (SELECT {key}, day, CASE WHEN abs(d0) < 1e-12 THEN 0.0 ELSE d0 END AS daily_dd, CASE WHEN abs(r0) < 1e-12 THEN 0.0 ELSE r0 END AS dr FROM {name}_e),
{name}_l AS (SELECT *, CASE WHEN dr < 0 THEN 1 ELSE 0 END AS loss FROM {name}_d),
{name}_s AS (SELECT *, CASE WHEN loss IS DISTINCT FROM lag(loss) OVER (PARTITION BY {key} ORDER BY day) THEN 1 ELSE 0 END AS new FROM {name}_l),
{name}_g AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY day) AS streak FROM {name}_s),
{name}_m AS (SELECT {key}, max(n) AS mcl FROM (SELECT {key}, streak, sum(loss) AS n FROM {name}_g GROUP BY {key}, streak) GROUP BY {key}),
{name}_a AS (SELECT {key}, min(daily_dd) AS mddd, avg(dr) AS mean_, stddev_samp(dr) AS std_, stddev_samp(dr) FILTER (dr < 0) AS down_, quantile_cont(dr, 0.95) AS p95, quantile_cont(dr, 0.05) AS p5,
  sum(dr) FILTER (dr > 0) AS gain, sum(-dr) FILTER (dr < 0) AS pain, avg(dr) FILTER (dr > 0) AS win, avg(-dr) FILTER (dr < 0) AS lose, count(*) FILTER (dr > 0) / count(dr) AS rate FROM {name}_d GROUP BY {key}),
{name} AS (SELECT {key}, last_ - 1 AS cumulative_return, CASE WHEN days_ > 0 AND last_ > 0 THEN pow(last_, 365.0 / days_) - 1 ELSE 0.0 END AS cagr, tim AS time_in_market, coalesce(mdd, 0.0) AS max_drawdown, coalesce(mddd, 0.0) AS max_daily_drawdown, CAST(mcl AS BIGINT) AS max_consecutive_losing_days,
  coalesce(mean_ / nullif(std_, 0) * sqrt(365.0), 0.0) AS smart_sharpe, coalesce(mean_ / nullif(down_, 0) * sqrt(365.0), 0.0) AS smart_sortino, abs(p95 / nullif(p5, 0)) AS tail_ratio, gain / nullif(pain, 0) AS gain_pain_ratio,
  CASE WHEN win IS NULL THEN 0.0 WHEN lose IS NULL THEN 1.0 ELSE rate - (1 - rate) / (win / lose) END AS kelly_criterion
  FROM {name}_w JOIN {name}_a USING ({key}) JOIN {name}_m USING ({key}))"""


METRICS = ("cumulative_return", "cagr", "time_in_market", "max_drawdown", "max_daily_drawdown", "smart_sharpe", "smart_sortino", "tail_ratio", "gain_pain_ratio", "kelly_criterion")


def trades(source: str = "ledger", key: str = "symbol", name: str = "trades") -> str:
    """CTEs <name>_r (rows with trade_id, by sign of the position) and <name>: (key, trade_id, trade_return, bars_held) of the long runs."""
    p = f"(PARTITION BY {key} ORDER BY ts)"
    up = f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name}_f AS (SELECT *, CASE WHEN sign(position) <> 0 AND sign(position) <> coalesce(lag(sign(position)) OVER {p}, 0) THEN 1 ELSE 0 END AS new FROM {source}),
{name}_r AS (SELECT *, CASE WHEN position <> 0 THEN sum(new) OVER {up} END AS trade_id FROM {name}_f),
{name}_n AS (SELECT *, CASE WHEN position > 0 AND NOT coalesce(lag(position) OVER {p} > 0, FALSE) THEN 1 ELSE 0 END AS opens FROM {source}),
{name}_l AS (SELECT *, sum(opens) OVER {up} AS long_id FROM {name}_n),
{name} AS (SELECT {key}, CAST(long_id AS BIGINT) AS trade_id, product(1 + asset_return) - 1 AS trade_return, count(*) AS bars_held FROM {name}_l WHERE position > 0 GROUP BY {key}, long_id)"""


def trade_log(source: str = "ledger", name: str = "tlog") -> str:
    """CTE <name>: closed trades; in from the first bar with a position over 0 to the first one with none."""
    return f"""{name}_h AS (SELECT *, {held('CASE WHEN position > 0 THEN 1 WHEN position = 0 THEN 0 END')} AS held FROM {source}),
{name}_e AS (SELECT *, held = 1 AND coalesce({lag('held')}, 0) = 0 AS opens, held = 0 AND coalesce({lag('held')}, 0) = 1 AS closes FROM {name}_h),
{name}_i AS (SELECT *, CAST(count(*) FILTER (opens) OVER {UP_TO} AS BIGINT) AS trade_id FROM {name}_e),
{name} AS (SELECT a.symbol, a.trade_id, a.ts AS entry_time, b.ts AS exit_time, a.close AS entry_price, b.close AS exit_price, n.bars_held FROM {name}_i a JOIN {name}_i b USING (symbol, trade_id)
  JOIN (SELECT symbol, trade_id, count(*) AS bars_held FROM {name}_i WHERE held = 1 GROUP BY ALL) n USING (symbol, trade_id) WHERE a.opens AND b.closes)"""


def recursion(source: str = "bars") -> str:
    """CTE rec (use WITH RECURSIVE): exponential means of 10, 12, 20, 26, 50, 200, MACD's signal, by symbol and row number n."""
    spans = (10, 12, 20, 26, 50, 200)
    a = {n: f"(2.0 / {n + 1})" for n in (9, *spans)}
    step = ", ".join(f"{a[n]} * num.close + (1 - {a[n]}) * e.y{n} AS y{n}" for n in spans)
    m = f"(({a[12]} * num.close + (1 - {a[12]}) * e.y12) - ({a[26]} * num.close + (1 - {a[26]}) * e.y26))"
    return f"""num AS (SELECT *, row_number() OVER {P} AS n FROM {source}),
rec AS (SELECT symbol, ts, n, {", ".join(f"close AS y{n}" for n in spans)}, CAST(0.0 AS DOUBLE) AS sig FROM num WHERE n = 1
  UNION ALL SELECT num.symbol, num.ts, num.n, {step}, {a[9]} * {m} + (1 - {a[9]}) * e.sig AS sig FROM rec e JOIN num ON num.symbol = e.symbol AND num.n = e.n + 1)"""


#: Bars of the market dataset: perpetuals with spot close, funding and open interest available at the close.
MARKET = f"""{BARS}, perp AS (SELECT *, ts + 3600 AS available_at FROM bars WHERE symbol IN ('purchase', 'click')),
spot AS (SELECT ts, close AS spot_close FROM bars WHERE symbol = 'error'),
fund AS (SELECT ts + 3600 AS funding_available_at, (close - 120) / 1e4 AS funding_rate FROM bars WHERE symbol = 'view'),
inter AS (SELECT ts + 3600 AS oi_available_at, volume * 1000 + close AS open_interest FROM bars WHERE symbol = 'signup'),
market AS (SELECT p.*, spot_close, funding_available_at, funding_rate, oi_available_at, open_interest, p.close - spot_close AS basis, coalesce((p.close - spot_close) / nullif(spot_close, 0), 0.0) * 1e4 AS basis_bps
  FROM perp p LEFT JOIN spot USING (ts) ASOF LEFT JOIN fund ON p.available_at >= fund.funding_available_at ASOF LEFT JOIN inter ON p.available_at >= inter.oi_available_at)"""
