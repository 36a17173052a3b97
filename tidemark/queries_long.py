"""Registered queries of long histories: the rows of the plain forms, with no window over a whole history.

The SQL is that of the plain forms. Stretches are a day or two here, so that each symbol has many.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqltext as S
from .operators import stretches as ST
from .operators.blocks import Quantile, Rank, add_order_statistics
from .plans import ledger as B
from .plans import metrics as A
from .plans import research as R
from .plans import signals as SG
from .queries import CONTEXT, MET, RSI_LEDGER, RSI_SHORT, context_events, query, rsi_ledger, tidy
from .queries_more import _LEDGER, _SQUEEZE, _VARIANTS
from .queries_research import _SWEEP, _walk
from .sources import market as M
from .sources.store import scratch, stored
from .functions import indicators as I

KT = "symbol, ts"
DAY = 86400
_PEAK = S.r(f"max(equity) OVER {S.UP_TO} AS peak", f"equity / max(equity) OVER {S.UP_TO} - 1 AS drawdown")


def stretched_ledger(spark, d, long_only: bool = True, seconds: int = DAY):
    """Bars, RSI block by block, the signal held and the ledger in stretches."""
    from .operators.scan import with_halo

    p = SG.RsiParams()
    bars = with_halo(M.bars(spark, d), lambda df, k: I.add_rsi(df, p.period, k, flat=100.0, name="rsi"), p.period, length=128)
    return B.ledger_in_stretches(SG.add_rsi_signal(bars, "neutral-exit", F.col("rsi"), p, seconds=seconds), B.cost_rate(5.0, 1.0), long_only=long_only, seconds=seconds)


def _columns(df):
    return tidy(df.select("symbol", "ts", "target_position", "position", "turnover", "gross_return", "cost_return", "net_return", "equity", "is_exposed", "peak", "drawdown"))


@query(f"WITH {RSI_LEDGER} SELECT {_LEDGER}, {_PEAK} FROM ledger")
def ledger_in_stretches(spark, d):
    """B1, B2, W16, W12 and S3."""
    return _columns(stretched_ledger(spark, d))


@query(f"WITH {RSI_SHORT} SELECT {_LEDGER}, {_PEAK} FROM ledger")
def ledger_in_hours(spark, d):
    """B6 in stretches of two hours, so that most hold one or two bars and some symbols have gaps."""
    return _columns(stretched_ledger(spark, d, long_only=False, seconds=7200))


@query(f"WITH {RSI_LEDGER}, {S.metrics()} SELECT {MET} FROM metrics")
def metrics_in_stretches(spark, d):
    """A4, A5."""
    return tidy(A.metrics(stored(stretched_ledger(spark, d), "ledger")))


@query(f"WITH {S.BARS} SELECT {KT}, {S.r(f'max(close) OVER {S.UP_TO} AS peak', f'close / max(close) OVER {S.UP_TO} - 1 AS drawdown')} FROM bars")
def drawdown_in_stretches(spark, d):
    """W16."""
    return tidy(ST.add_drawdown(M.bars(spark, d), seconds=DAY).select("symbol", "ts", "peak", "drawdown"))


@query(f"WITH {S.BARS}, s AS (SELECT *, CASE WHEN volume > 4 THEN close END AS x FROM bars) SELECT {KT}, {S.r(f'last_value(x IGNORE NULLS) OVER {S.UP_TO} AS filled')} FROM s")
def forward_fill_in_stretches(spark, d):
    """W20."""
    return tidy(ST.add_held(M.bars(spark, d), {"filled": F.when(F.col("volume") > 4, F.col("close"))}, seconds=DAY).select("symbol", "ts", "filled"))


@query(f"WITH {S.BARS}, {S.rsi(14, 'rs', flat=100.0)} SELECT {KT}, {', '.join(f'CAST({x} AS BIGINT) AS ' + n.replace('-', '_') for n, x in _VARIANTS.items())} FROM rs")
def rsi_variants_in_stretches(spark, d):
    """S3: the seven variants, their pulses held in one scan."""
    df = I.add_rsi(M.bars(spark, d), 14, flat=100.0, name="rsi")
    pulses = {(v, i): x for v in SG.RSI_VARIANTS for i, x in enumerate(SG.rsi_pulses(v, F.col("rsi"), SG.RsiParams()))}
    df = ST.add_held(df, {f"{v}/{i}".replace("-", "_"): x for (v, i), x in pulses.items()}, seconds=DAY)
    total = {v: sum((F.coalesce(F.col(f"`{v}/{i}`".replace("-", "_")), F.lit(0)) for w, i in pulses if w == v), F.lit(0)) for v in SG.RSI_VARIANTS}
    return tidy(df.select("symbol", "ts", *(x.alias(v.replace("-", "_")) for v, x in total.items())))


@query(f"WITH {_SWEEP} SELECT symbol, param_id, {S.r(*S.METRICS)}, max_consecutive_losing_days FROM sm")
def sweep_in_stretches(spark, d):
    """Every parameter set's automaton and equity in one scan."""
    params = R.grid(spark, [7, 14], [60.0, 70.0], [30.0, 50.0], [50.0, 55.0], [0.0, 10.0])
    led = R.sweep_in_stretches(M.bars(spark, d), params, [7, 14], seconds=2 * DAY)
    return tidy(A.metrics(stored(led, "ledger"), keys=("symbol", "param_id")))


def _rank(x: str, n: int) -> str:
    w = S.frame(n)
    return f"CASE WHEN count({x}) OVER {w} >= {n} AND {x} IS NOT NULL THEN len(list_filter(list({x}) OVER {w}, lambda v: v <= {x})) / count({x}) OVER {w} END"


@query(f"WITH {S.BARS}, v AS (SELECT *, CASE WHEN volume <> 2 THEN close END AS gap FROM bars) SELECT {KT}, {S.r(*(S.quantile(x, q, n, least) + f' AS {name}' for name, x, q, n, least in (('q25_125', 'close', 0.25, 125, 125), ('q90_90', 'gap', 0.9, 90, 30), ('q75_240', 'gap', 0.75, 240, 120))), _rank('close', 50) + ' AS rank_50')} FROM v")
def sliding_order_statistics(spark, d):
    """W8, W9 by rank structures, block by block; some values are missing."""
    df = M.bars(spark, d).withColumn("gap", F.when(F.col("volume") != 2, F.col("close")))
    wanted = {"q25_125": Quantile("close", 0.25, 125), "q90_90": Quantile("gap", 0.9, 90, 30), "q75_240": Quantile("gap", 0.75, 240, 120), "rank_50": Rank("close", 50)}
    return tidy(add_order_statistics(df, wanted, length=300).select("symbol", "ts", *wanted))


@query(f"WITH {_SQUEEZE} SELECT {KT}, squeeze FROM q2")
def squeeze_by_ranks(spark, d):
    """S4 with its quantile by a rank structure."""
    return tidy(I.squeeze_by_ranks(M.bars(spark, d)).select("symbol", "ts", "squeeze"))


_FOLDS = f"""{RSI_LEDGER}, {_walk(200, 100, 75, 'ledger')}, w1 AS (SELECT symbol, fold, role, ts, net_return, is_exposed, turnover, product(1 + net_return) OVER w AS eq, row_number() OVER w AS i, CASE WHEN net_return < 0 THEN 1 ELSE 0 END AS loss FROM wf WINDOW w AS (PARTITION BY symbol, fold, role ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, eq / max(eq) OVER w - 1 AS dd, i - coalesce(max(CASE WHEN loss = 0 THEN i END) OVER w, 0) AS since FROM w1 WINDOW w AS (PARTITION BY symbol, fold, role ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_FOLDS} SELECT symbol, fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, {S.r('product(1 + net_return) - 1 AS total_return', 'min(dd) AS max_drawdown', 'avg(CASE WHEN is_exposed THEN 1.0 ELSE 0.0 END) AS exposure', 'sum(turnover) AS turnover')}, CAST(max(since) AS BIGINT) AS losing_bars FROM w2 GROUP BY 1, 2, 3")
def fold_metrics(spark, d):
    """Folds that overlap, from cells of 25 bars."""
    return tidy(R.fold_metrics(rsi_ledger(spark, d), 200, 100, 75, seconds=2 * DAY))


@query(f"WITH {S.BARS} SELECT symbol, CASE WHEN ts < 1704931200 THEN 'a' WHEN ts < 1705795200 THEN 'b' ELSE 'c' END AS origin, ts, {S.r('close', 'CASE WHEN ts < 1704931200 OR ts >= 1705795200 THEN volume END AS volume')}, CASE WHEN ts BETWEEN 1704931200 AND 1705795199 THEN 'x' END AS venue FROM bars")
def drifted_bars(spark, d):
    """IO2: three files of bars: whole volumes; none, but a venue; and times as milliseconds with fractional volumes."""
    from .sources import drift

    b, folder = M.bars(spark, d), scratch(spark, "drifted")
    cut = lambda low, high: b.where(f"ts >= timestamp'{low}' AND ts < timestamp'{high}'")
    cut("2000-01-01", "2024-01-11").select("symbol", "ts", "close", F.col("volume").cast("int").alias("volume")).write.parquet(f"{folder}/a")
    cut("2024-01-11", "2024-01-21").select("symbol", "ts", "close", F.lit("x").alias("venue")).write.parquet(f"{folder}/b")
    cut("2024-01-21", "2100-01-01").select("symbol", F.unix_millis("ts").alias("ts"), F.col("close").cast("decimal(18,6)").cast("double").alias("close"), "volume").write.parquet(f"{folder}/c")
    out = drift.scan(spark, drift.files(spark, folder))
    return tidy(out.select("symbol", F.regexp_extract("_file", "/([abc])/[^/]*$", 1).alias("origin"), "ts", "close", "volume", "venue"))


@query(f"WITH {CONTEXT} SELECT source, signal_type, symbol, ts, round(value, 6) AS value, historical_integrity FROM ctx WHERE symbol = 'U1' AND ts BETWEEN 1704412800 AND 1705017600")
def event_store_commits(spark, d):
    """IO5, IO6, ST7: events committed in batches, one twice, one half-way only; compacted, and a later batch; one symbol and range read."""
    from .sources import commits

    root, events = scratch(spark, "store"), context_events(spark, d).withColumn("_k", F.pmod(F.xxhash64("ts", "value"), F.lit(4)))
    part = lambda k: events.where(F.col("_k") == k).drop("_k")
    for k in (0, 1, 1, 2):
        commits.commit(part(k), root, f"b{k}")
    part(3).withColumn("date", F.to_date("ts")).write.partitionBy("source", "symbol", "date").parquet(f"{root}/data/died")
    schema = "source string, signal_type string, symbol string, ts timestamp, value double, historical_integrity boolean, metadata string"
    commits.compact(spark, root, schema)
    commits.commit(part(2), root, "b2")  # tried again after the compaction
    commits.commit(part(3), root, "b3")
    out = commits.read(spark, root, schema, "U1", "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return tidy(out.select("source", "signal_type", "symbol", "ts", "value", "historical_integrity"))
