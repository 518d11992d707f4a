"""Point-in-time features over trades joined to captures (age = seconds before t0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.sources.shared import materialize

from .ordered import exact_quantiles

KEY = ("entity", "t0")


def _usd(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("usd"))), F.lit(0).cast("decimal(28,4)"))


def per_trader(pit: DataFrame, windows: dict[str, int]) -> DataFrame:
    """One row per (capture, trader): counts, volumes and presence flags by side and window.

    Counting traders over these rows replaces several distinct aggregates, which would multiply the rows.
    """
    buy = F.col("side") == "buy"
    aggs = []
    for name, w in windows.items():
        inside = F.col("age").between(0, w)
        for side, is_side in (("buy", buy), ("sell", ~buy)):
            aggs += [F.count_if(inside & is_side).alias(f"{side}_n_{name}"), _usd(inside & is_side).alias(f"{side}_usd_{name}")]
    aggs += [F.count_if(buy).alias("buy_n"), F.count_if(~buy).alias("sell_n"), _usd(buy).alias("buy_usd"), _usd(~buy).alias("sell_usd")]
    aggs += [F.sum(F.when(buy, F.col("tok")).otherwise(-F.col("tok"))).alias("net_tok"), F.max("age").alias("oldest"), F.max(F.when(buy, F.col("usd"))).alias("max_buy")]
    return pit.groupBy(*KEY, "trader").agg(*aggs)


def _flow_aggs(windows: dict[str, int]) -> list[Column]:
    aggs = []
    for name in windows:
        for side in ("buy", "sell"):
            aggs += [F.sum(f"{side}_n_{name}").alias(f"{side}_n_{name}"), F.sum(f"{side}_usd_{name}").cast("double").alias(f"{side}_usd_{name}"), F.count_if(F.col(f"{side}_n_{name}") > 0).alias(f"{side}ers_{name}")]
    return aggs + [F.sum("buy_n").alias("buy_n"), F.sum("sell_n").alias("sell_n"), F.max("oldest").alias("oldest")]


def flow_windows(pit: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Counts, volumes and distinct traders by side for each window and in total, and the oldest trade's age."""
    return per_trader(pit, windows).groupBy(*KEY).agg(*_flow_aggs(windows))


def buy_ordinal(pit: DataFrame) -> DataFrame:
    """The buys of each capture with nth, their place by time and larger amount, and after, seconds since its first trade."""
    begin = F.min("ts").over(Window.partitionBy(*KEY))
    rows = pit.withColumn("after", F.col("ts") - begin).where("side = 'buy'")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("ts", F.desc("usd"), "id")))


def sniper_stats(pit: DataFrame, first: tuple[int, int] = (5, 10), seconds: tuple[int, int] = (30 * 86400, 90 * 86400)) -> DataFrame:
    """The first buys of each capture, by order and by time after the first trade."""
    rows = buy_ordinal(pit)
    aggs = [F.max(F.when(F.col("nth") == 1, F.col("usd"))).cast("double").alias("first_buy_usd")]
    aggs += [_usd(F.col("nth") <= n).cast("double").alias(f"usd_first_{n}") for n in first]
    aggs += [_usd(F.col("after") <= s).cast("double").alias(f"usd_within_{i}") for i, s in enumerate(seconds)]
    aggs += [F.count_if(F.col("after") <= s).alias(f"buys_within_{i}") for i, s in enumerate(seconds)]
    return rows.groupBy(*KEY).agg(*aggs)


def trader_ranks(traders: DataFrame) -> DataFrame:
    """Adds r, the rank by bought usd, q, the rank by net tokens, and held, the net tokens where positive."""
    by_usd = Window.partitionBy(*KEY).orderBy(F.desc("buy_usd"), "trader")
    by_tok = Window.partitionBy(*KEY).orderBy(F.desc("net_tok"), "trader")
    return traders.withColumn("r", F.row_number().over(by_usd)).withColumn("q", F.row_number().over(by_tok)).withColumn("held", F.greatest("net_tok", F.lit(0.0)))


def _share_aggs(tops: tuple[int, ...]) -> list[Column]:
    share = lambda part, whole: F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), 6))
    aggs = [F.count_if(F.col("held") > 0).alias("holders"), F.count_if(F.col("buy_n") > 0).alias("buyers")]
    for n in tops:
        aggs += [share(F.sum(F.when(F.col("r") <= n, F.col("buy_usd"))), F.sum("buy_usd")).alias(f"top{n}_buy_share"), share(F.sum(F.when(F.col("q") <= n, F.col("held"))), F.sum("held")).alias(f"top{n}_held_share")]
    return aggs


def concentration(pit: DataFrame, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Shares of the largest buyers and of the largest net holders; null where the denominator is not positive."""
    return trader_ranks(per_trader(pit, {})).groupBy(*KEY).agg(*_share_aggs(tops))


def microstructure_pack(pit: DataFrame, windows: dict[str, int], tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Flow, snipers and concentration of each capture in one row, with null-safe shares.

    One table of (capture, trader) holds what flow, totals and concentration need, so trades are aggregated once
    for those and once for the snipers.
    """
    total = [F.sum("buy_usd").cast("double").alias("buy_usd"), F.sum("sell_usd").cast("double").alias("sell_usd"), F.max("max_buy").cast("double").alias("max_buy_usd")]
    traders = trader_ranks(per_trader(pit, windows)).groupBy(*KEY).agg(*_flow_aggs(windows), *total, *_share_aggs(tops))
    out = traders.join(sniper_stats(pit), list(KEY), "left")
    share = lambda part: F.when(F.col("buy_usd") > 0, F.round(F.coalesce(F.col(part), F.lit(0.0)) / F.col("buy_usd"), 6))
    out = out.withColumn("net_usd", F.round(F.col("buy_usd") - F.col("sell_usd"), 4))
    return out.withColumn("sniper_share", share("usd_within_0")).withColumn("first5_share", share("usd_first_5")).withColumn("max_buy_share", share("max_buy_usd"))


def peak_vwap(trades: DataFrame, step: int = 86400, threshold: float = 2000.0) -> DataFrame:
    """Per entity: the highest volume-weighted price of a step of time, its step, and the number above a threshold."""
    slots = trades.where("tok > 0").groupBy("entity", (F.col("ts") - F.col("ts") % step).alias("slot")).agg((F.sum("usd").cast("double") / F.sum("tok")).alias("vwap"))
    return slots.groupBy("entity").agg(F.round(F.max("vwap"), 6).alias("peak"), F.max_by("slot", F.struct("vwap", -F.col("slot"))).alias("peak_slot"), F.count("*").alias("slots"), F.count_if(F.col("vwap") >= threshold).alias("above"))


def buy_volume(captures: DataFrame, pit: DataFrame, window: int) -> DataFrame:
    """Buys in one window; captures without any have 0, which is an observation."""
    got = pit.where((F.col("side") == "buy") & F.col("age").between(0, window)).groupBy("entity").agg(F.sum("usd").cast("double").alias("buy_usd"), F.count("*").alias("buy_n"))
    return captures.select(*KEY).join(got, "entity", "left").select(*KEY, F.coalesce("buy_usd", F.lit(0.0)).alias("buy_usd"), F.coalesce("buy_n", F.lit(0)).alias("buy_n"))


def repriced_pack(pit: DataFrame, quotes: DataFrame, window: int, lookup) -> DataFrame:
    """Window sums of base * quote; legs without a quote are dropped and counted; median quote of the rest.

    The priced legs are written once: the sums and each pass of the median read them."""
    rows = materialize(lookup(pit, quotes).select(*KEY, "age", "base", "quote"), "priced-legs")
    inside = F.col("age").between(0, window) & F.col("quote").isNotNull()
    usd = F.sum(F.when(inside, (F.col("base") * F.col("quote")).cast("decimal(28,6)"))).cast("double")
    sums = rows.groupBy(*KEY).agg(F.coalesce(usd, F.lit(0.0)).alias("usd"), F.count_if(inside).alias("n"), F.count_if(F.col("quote").isNull()).alias("missing"))
    middle = exact_quantiles(rows.where("quote is not null"), list(KEY), "quote", [0.5]).select(*KEY, F.col("q")[0].alias("median_quote"))
    return sums.join(middle, list(KEY), "left")


def replay_flow(captures: DataFrame, pit: DataFrame, window: int) -> DataFrame:
    """Counts, volumes, traders, ratio, last venue and the missing flag of a window, one row for each capture.

    A capture without events in the window has zeros, no age and no venue, and is missing.
    """
    inside, buy = F.col("age").between(0, window), F.col("side") == "buy"
    t = pit.where(inside).groupBy(*KEY, "trader").agg(F.count_if(buy).alias("b"), F.count_if(~buy).alias("s"), _usd(buy).alias("bu"), _usd(~buy).alias("su"), F.max(F.struct("ts", "id", "venue")).alias("last"), F.max("age").alias("oldest"))
    got = t.groupBy(*KEY).agg(F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.sum("bu").cast("double").alias("buy_usd"), F.sum("su").cast("double").alias("sell_usd"), F.count_if(F.col("b") > 0).alias("buyers"), F.count_if(F.col("s") > 0).alias("sellers"), F.max("last")["venue"].alias("last_venue"), F.max("oldest").alias("oldest"))
    out = captures.select(*KEY).join(got, list(KEY), "left").na.fill(0, ["buys", "sells", "buyers", "sellers"]).na.fill(0.0, ["buy_usd", "sell_usd"])
    return out.withColumn("ratio", F.round(F.col("buy_usd") / F.greatest("sell_usd", F.lit(1e-12)), 2)).withColumn("missing", F.col("buys") + F.col("sells") == 0)


def catalogue_features(pit: DataFrame, window: int) -> DataFrame:
    """VWAP against p0, variance of gaps between trades, holder Gini."""
    w = Window.partitionBy(*KEY).orderBy("ts", "id")
    gaps = pit.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).groupBy(*KEY).agg(F.var_pop("gap").alias("gap_var"), F.first("p0").alias("p0"), (F.sum(F.when(F.col("age") <= window, F.col("usd"))).cast("double") / F.sum(F.when(F.col("age") <= window, F.col("tok")))).alias("vwap"))
    held = per_trader(pit, {}).where("net_tok > 0").withColumn("i", F.row_number().over(Window.partitionBy(*KEY).orderBy("net_tok", "trader")))
    gini = held.groupBy(*KEY).agg((2 * F.sum(F.col("i") * F.col("net_tok")) / (F.count("*") * F.sum("net_tok")) - (F.count("*") + 1) / F.count("*")).alias("gini"))
    out = gaps.join(gini, list(KEY), "left")
    return out.select(*KEY, F.round("gap_var", 2).alias("gap_var"), F.round(F.col("vwap") / F.col("p0"), 6).alias("vwap_vs_p0"), F.round("gini", 6).alias("gini"))


def next_time(rows: DataFrame, by: list[str], at: str, out: str, bucket: int = 30 * 86400) -> DataFrame:
    """Adds the least later-or-equal time of the group's next row (ties are next to each other), null at its last row.

    Rows are ordered within buckets of time; the last row of a bucket takes the first time of the group's next bucket, from
    a table of a row for each bucket. So a group that holds much of the table is spread over its buckets.
    """
    tagged = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    starts = tagged.groupBy(*by, "_b").agg(F.min(at).alias("_first"))
    after = starts.select(*by, "_b", F.lead("_first").over(Window.partitionBy(*by).orderBy("_b")).alias("_next"))
    inside = F.lead(at).over(Window.partitionBy(*by, "_b").orderBy(at))
    return tagged.withColumn("_lead", inside).join(after, [*by, "_b"]).withColumn(out, F.coalesce("_lead", "_next")).drop("_b", "_lead", "_next")


def curve_catalogue(pit: DataFrame, lo: float, window: int, quote: float, virtual_base: float, virtual_tok: float, real_tok: float, supply: float = 1e9) -> DataFrame:
    """Per capture, from its trades up to t0: time_in_band, time_above, max_buy_base, liq_real, liq_over_mc, inv_k and curve_share.

    The price after a trade holds until the next one, the last one's until t0. time_in_band adds up the time at `lo` or
    above, time_above is the last unbroken stretch of it that reaches t0 (0 if the last price is below). max_buy_base is the
    largest buy within the window. Of the curve, which starts with virtual reserves and real_tok tokens: liq_real is the
    base paid in, on balance, liq_over_mc its worth at the quote over p0 * supply, inv_k the product of the virtual
    reserves after it, and curve_share what is left of the tokens over the supply. Trades without tokens have no price and
    change no stretch.
    """
    pit = materialize(pit.select(*KEY, "p0", "ts", "age", "side", "usd", "tok", "base"), "curve-trades")  # the sums and the steps read it
    buy = F.col("side") == "buy"
    usd = F.sum(F.when(buy, F.col("usd")).otherwise(-F.col("usd"))).cast("double")
    tok = F.sum(F.when(buy, F.col("tok")).otherwise(-F.col("tok")))
    sums = pit.groupBy(*KEY).agg(F.first("p0").alias("p0"), usd.alias("net_usd"), tok.alias("net_tok"), F.max(F.when(buy & (F.col("age") <= window), F.col("base"))).alias("max_buy_base"))
    price = F.col("usd").cast("double") / F.nullif(F.col("tok"), F.lit(0.0))
    steps = next_time(pit.select(*KEY, "ts", price.alias("_p")).where("_p is not null"), list(KEY), "ts", "_until")
    # of trades at one time only the last one's price holds for longer than no time; which is last is told by the larger price
    steps = steps.groupBy(*KEY, "ts").agg(F.max("_p").alias("_p"), F.max("_until").alias("_until"))
    held = F.coalesce("_until", "t0") - F.col("ts")
    above = F.col("_p") >= lo
    times = steps.groupBy(*KEY).agg(F.coalesce(F.sum(F.when(above, held)), F.lit(0)).alias("time_in_band"), F.max(F.when(~above, F.coalesce("_until", "t0"))).alias("_fell"), F.min("ts").alias("_first"))
    times = times.select(*KEY, "time_in_band", (F.col("t0") - F.coalesce("_fell", "_first")).alias("time_above"))
    base = F.col("net_usd") / quote
    out = sums.join(times, list(KEY), "left")
    return out.select(*KEY, F.coalesce("time_in_band", F.lit(0)).alias("time_in_band"), F.coalesce("time_above", F.lit(0)).alias("time_above"), "max_buy_base", base.alias("liq_real"), (F.col("net_usd") / (F.col("p0") * supply)).alias("liq_over_mc"), ((virtual_base + base) * (virtual_tok - F.col("net_tok"))).alias("inv_k"), ((real_tok - F.col("net_tok")) / supply).alias("curve_share"))


def microstructure_flow(captures: DataFrame, pit: DataFrame, windows: dict[str, int], curve: str = "pumpdotfun", migrated: str = "pumpswap") -> DataFrame:
    """Per capture: counts, volumes and distinct traders of each window, buyers, sellers, totals, net base in all and on
    the curve, the largest buy, the age of the first trade, and whether a trade stands at the venue after migration.

    Distinct traders are counted over a (capture, trader) table. A capture without trades has zeros, no age, no migration.
    """
    buy = F.col("side") == "buy"
    base = F.when(buy, F.col("base")).otherwise(-F.col("base")).cast("decimal(28,6)")
    more = [F.sum(base).alias("net"), F.sum(F.when(F.col("venue") == curve, base)).alias("net_curve"), F.bool_or(F.col("venue") == migrated).alias("mig"), F.max(F.when(buy, F.col("base"))).alias("max_base")]
    flow = [F.count_if(buy).alias("buy_n"), F.count_if(~buy).alias("sell_n"), _usd(buy).alias("buy_usd"), _usd(~buy).alias("sell_usd"), F.max(F.when(buy, F.col("usd"))).alias("max_buy"), F.max("age").alias("oldest")]
    for name, w in windows.items():
        inside = F.col("age").between(0, w)
        flow += [F.count_if(inside & s).alias(f"{k}_n_{name}") for k, s in (("buy", buy), ("sell", ~buy))] + [_usd(inside & s).alias(f"{k}_usd_{name}") for k, s in (("buy", buy), ("sell", ~buy))]
    t = pit.groupBy(*KEY, "trader").agg(*flow, *more)
    sums = [F.sum(c).cast("double" if "usd" in c else "long").alias(c) for name in ("", *[f"_{w}" for w in windows]) for c in (f"buy_n{name}", f"sell_n{name}", f"buy_usd{name}", f"sell_usd{name}")]
    sums += [F.count_if(F.col(f"buy_n_{w}") + F.col(f"sell_n_{w}") > 0).alias(f"traders_{w}") for w in windows]
    sums += [F.count_if(F.col("buy_n") > 0).alias("buyers"), F.count_if(F.col("sell_n") > 0).alias("sellers"), F.sum("net").cast("double").alias("net_base"), F.sum("net_curve").cast("double").alias("net_base_curve")]
    sums += [F.max("max_buy").cast("double").alias("max_buy_usd"), F.max("max_base").alias("max_buy_base"), F.bool_or("mig").alias("migrated"), F.max("oldest").alias("oldest")]
    out = captures.select(*KEY).join(t.groupBy(*KEY).agg(*sums), list(KEY), "left")
    zeros = [c for c in out.columns if c not in (*KEY, "migrated", "oldest")]
    return out.na.fill(0, zeros).na.fill(False, ["migrated"])
