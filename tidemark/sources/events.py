"""Context events: from market rows to the long form, and from the long form to wide context frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, forward_fill, safe_div

SIGNAL_TYPES = ("funding_rate", "open_interest", "basis_bps", "spread_bps", "depth_imbalance", "liquidation_imbalance")


def _event(source: str, kind: str, value: Column, metadata: dict[str, Column] | None = None, integrity: bool = True) -> Column:
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(source).alias("source"), F.lit(kind).alias("signal_type"), value.cast("double").alias("value"), F.lit(integrity).alias("historical_integrity"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"))


def _long(rows: DataFrame, *events: Column) -> DataFrame:
    return rows.select("symbol", "ts", F.explode(F.array(*events)).alias("_e")).select("_e.source", "_e.signal_type", "symbol", "ts", "_e.value", "_e.historical_integrity", "_e.metadata").where("value IS NOT NULL")


def funding_events(rows: DataFrame) -> DataFrame:
    """P5."""
    return _long(rows, _event("funding", "funding_rate", F.col("funding_rate")))


def interest_events(rows: DataFrame) -> DataFrame:
    """P6."""
    return _long(rows, _event("open_interest", "open_interest", F.col("open_interest")))


def basis_events(rows: DataFrame) -> DataFrame:
    """Basis in basis points of the spot, 0 where the spot is 0."""
    perp, spot = F.col("perp_price"), F.col("spot_price")
    bps = F.when(spot == 0, 0.0).otherwise(safe_div(perp - spot, spot) * 1e4)
    return _long(rows, _event("basis", "basis_bps", bps, {"perp_price": perp, "spot_price": spot}))


def book_depth(payload: Column, levels: int = 5) -> Column:
    """P10: best prices and summed sizes of the first levels of {"bids": [[price, size], ..], "asks": ..} as text."""
    book = F.from_json(payload, "bids array<array<string>>, asks array<array<string>>")

    def side(name: str) -> tuple[Column, Column]:
        rows = book[name]
        total = F.aggregate(F.slice(rows, 1, levels), F.lit(0.0), lambda a, r: a + r[1].cast("double"))
        return F.try_element_at(rows, F.lit(1))[0].cast("double"), total

    (bid, bid_size), (ask, ask_size) = side("bids"), side("asks")
    return F.struct(bid.alias("best_bid"), ask.alias("best_ask"), bid_size.alias("bid_size"), ask_size.alias("ask_size"))


def book_events(rows: DataFrame) -> DataFrame:
    """Spread in basis points of the mid price and depth imbalance, two events a row."""
    bid, ask, b, a = (F.col(x) for x in ("best_bid", "best_ask", "bid_size", "ask_size"))
    spread = safe_div(ask - bid, (ask + bid) / 2) * 1e4
    imbalance = F.coalesce(safe_div(b - a, b + a), F.lit(0.0))
    return _long(rows, _event("orderbook", "spread_bps", spread), _event("orderbook", "depth_imbalance", imbalance))


def liquidation_events(rows: DataFrame, integrity: bool = False) -> DataFrame:
    """(long - short) / (long + short), 0 without any; not point-in-time safe unless said so."""
    long, short = F.col("long_liquidation_notional"), F.col("short_liquidation_notional")
    return _long(rows, _event("liquidations", "liquidation_imbalance", F.coalesce(safe_div(long - short, long + short), F.lit(0.0)), integrity=integrity))


def parse_feed(rows: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Landed JSON {"data": [..]} as typed rows; kind is funding, open_interest or ticker."""
    fields = {"funding": ("fundingRate", "fundingTime", "funding_rate"), "open_interest": ("oi", "ts", "open_interest"), "ticker": ("last", "ts", "price")}[kind]
    data = F.from_json(payload, f"data array<struct<instId:string,{fields[0]}:string,{fields[1]}:string>>")["data"]
    x = rows.select(F.explode(data).alias("x"))
    return x.select(F.col("x.instId").alias("symbol"), F.timestamp_millis(F.col(f"x.{fields[1]}").cast("long")).alias("ts"), F.col(f"x.{fields[0]}").cast("double").alias(fields[2]))


def context_frame(events: DataFrame, types=SIGNAL_TYPES, fill: bool = True, keys=KEYS) -> DataFrame:
    """One row for each symbol and time, a column for each type (of several the last source's), filled forward."""
    wide = events.groupBy(*keys, "ts").pivot("signal_type", list(types)).agg(F.max_by("value", "source"))
    return wide.withColumns({t: forward_fill(F.col(t), keys) for t in types}) if fill else wide


def context_tags(funding: float = 0.0001, spread: float = 12.0, imbalance: float = -0.25, low_funding: float = -0.00008) -> Column:
    """Tags of a context row with funding_rate, spread_bps and liquidation_imbalance; a null sets no tag."""
    f, s, q = F.col("funding_rate"), F.col("spread_bps"), F.col("liquidation_imbalance")
    return F.array_compact(F.array(F.when(F.abs(f) >= funding, "funding_extreme"), F.when((q <= imbalance) | (f <= low_funding), "risk_off"), F.when(s >= spread, "thin_liquidity")))


def gate_ready(context: DataFrame, required: list[str]) -> DataFrame:
    """Whether all required tags are there; spread and depth are nulled where not, the raw ones kept."""
    tags = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    ok = F.size(F.array_except(tags, "tags")) == 0
    out = context.withColumns({"tags_pass": ok, "raw_spread_bps": F.col("spread_bps"), "raw_depth_imbalance": F.col("depth_imbalance")})
    return out.withColumns({c: F.when(F.col("tags_pass"), F.col(c)) for c in ("spread_bps", "depth_imbalance")})


def optimizer_filter(context: DataFrame, max_spread: float, low: float, high: float) -> DataFrame:
    """P14."""
    return context.where((F.col("spread_bps") <= max_spread) & F.col("depth_imbalance").between(low, high))
