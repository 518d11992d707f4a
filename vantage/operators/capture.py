"""Prices, first qualifying moments and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def implied_mc(trades: DataFrame, supply: float = 1e9) -> DataFrame:
    """Adds price = usd / tok (null when tok is 0) and mc = price * supply."""
    price = F.col("usd").cast("double") / F.nullif(F.col("tok"), F.lit(0.0))
    return trades.withColumn("price", price).withColumn("mc", price * supply)


def in_band(value: Column, lo: float, hi: float) -> Column:
    """Inclusive at both ends; null, NaN and infinite values are outside."""
    return F.coalesce(value.between(lo, hi) & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def normalize_swaps(pairs: DataFrame, quote: str = "SOL", least_usd: float = 1.0, projects: tuple[str, ...] | None = None) -> DataFrame:
    """bought, sold, bought_amount, sold_amount, usd -> entity, side, tok, base of pairs with the quote asset, of the listed
    projects where there is a list; a null project is not listed."""
    if projects is not None:
        pairs = pairs.where(F.col("project").isin(*projects))
    buy, sell = F.col("sold") == quote, F.col("bought") == quote
    rows = pairs.where((buy != sell) & (F.col("usd") >= least_usd))
    rows = rows.withColumn("side", F.when(buy, "buy").otherwise("sell")).withColumn("entity", F.when(buy, F.col("bought")).otherwise(F.col("sold")))
    rows = rows.withColumn("tok", F.when(buy, F.col("bought_amount")).otherwise(F.col("sold_amount"))).withColumn("base", F.when(buy, F.col("sold_amount")).otherwise(F.col("bought_amount")))
    return rows.where("tok > 0").drop("bought", "sold", "bought_amount", "sold_amount")


def first_in_band(trades: DataFrame, lo: float, hi: float) -> DataFrame:
    """(entity, t0, p0, venue0) of each entity's first trade with a price in the band, ties by id.

    An aggregate of the least (ts, id): one shuffle with partial aggregation and no sort.
    """
    rows = implied_mc(trades).where(in_band(F.col("price"), lo, hi))
    first = rows.groupBy("entity").agg(F.min(F.struct("ts", "id", "price", "venue")).alias("f"))
    return first.select("entity", F.col("f.ts").alias("t0"), F.col("f.price").alias("p0"), F.col("f.venue").alias("venue0"))


def time_bounds(captures: DataFrame, back: int) -> tuple[int, int]:
    """(min t0 - back, max t0), as literals for a scan filter that reaches the files."""
    lo, hi = captures.agg(F.min("t0"), F.max("t0")).first()
    return (lo - back, hi) if lo is not None else (0, -1)


def pit_join(captures: DataFrame, trades: DataFrame) -> DataFrame:
    """Trades of captured entities up to t0, with age = t0 - ts in whole seconds."""
    rows = trades.join(captures, "entity").where(F.col("ts") <= F.col("t0"))
    return rows.withColumn("age", F.col("t0") - F.col("ts"))


def semi_keys(trades: DataFrame, captures: DataFrame) -> DataFrame:
    return trades.join(captures.select("entity").distinct(), "entity", "left_semi")


def as_of_quotes(rows: DataFrame, quotes: DataFrame, at: str = "ts", most_age: int = 86400, bucket: int = 30 * 86400) -> DataFrame:
    """rows with quote_ts and quote: the latest quote at or before `at`, null when older than most_age.

    Quotes form one series, so time is cut into buckets; each bucket also holds the last quote before it,
    and a window runs within buckets only.
    """
    q = quotes.select(F.col("ts").alias("q_ts"), "price").withColumn("_b", F.floor(F.col("q_ts") / bucket))
    ends = q.groupBy("_b").agg(F.max(F.struct("q_ts", "price")).alias("last"))  # one row per bucket
    reach = F.ceil(F.lit(most_age) / bucket).cast("long")
    carried = ends.select(F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)).alias("_b"), "last.q_ts", "last.price")
    r = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    names = rows.columns
    left = r.select("_b", F.col(at).alias("_t"), F.lit(1).alias("_s"), F.struct(*names).alias("_row"), F.lit(None).cast("struct<q_ts:bigint,price:double>").alias("_q"))
    right = q.unionByName(carried.select("q_ts", "price", "_b")).select("_b", F.col("q_ts").alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct("q_ts", "price").alias("_q"))
    w = Window.partitionBy("_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_got", F.last("_q", True).over(w)).where("_s = 1")
    fresh = F.col("_t") - F.col("_got.q_ts") <= most_age
    return out.select("_row.*", F.when(fresh, F.col("_got.q_ts")).alias("quote_ts"), F.when(fresh, F.col("_got.price")).alias("quote"))


def as_of_chain(rows: DataFrame, series: list[tuple[str, DataFrame, int]], at: str = "ts", explicit: str | None = None, default: float | None = None, bucket: int = 86400, salt: int = 8) -> DataFrame:
    """rows with quote, quote_ts and quote_source: the latest quote at or before `at` of the first series that has one in time.

    series: (name, quotes of ts and price, largest age in seconds), the preferred one first. Each series keeps its own latest
    quote, so a stale one never hides the next series', and a quote after `at` is never read. A positive value of the
    column `explicit` goes before all series, with the source "explicit" and no time; where no series answers, the
    quote is the default with the source "default", or null without one. Quotes without a time or a positive price
    count for nothing; rows without a time get no series' quote.

    One pass over rows and all series: time is cut into buckets, each bucket also starts with each series' last quote
    from before it, and a window runs within a part of a bucket. Rows of a bucket are dealt over `salt` parts, as one
    moment may hold many of them; the quotes, which are few, stand in each part.
    """
    names = rows.columns
    kind = "struct<ts:bigint,price:double>"
    good = [(i, q.where("ts is not null and price > 0").select(F.col("ts").cast("long").alias("ts"), F.col("price").cast("double").alias("price"))) for i, (_, q, _) in enumerate(series)]
    quoted = None
    for i, q in good:
        q = q.groupBy("ts").agg(F.max("price").alias("price")).withColumn("_b", F.floor(F.col("ts") / bucket))
        last = q.groupBy("_b").agg(F.max(F.struct("ts", "price")).alias("q"))
        reach = -(-series[i][2] // bucket)
        ahead = last.select(F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)).alias("_b"), "q") if reach > 0 else last.limit(0)
        start = ahead.groupBy("_b").agg(F.max("q").alias("q"))  # the latest of all buckets within reach
        one = q.select("_b", F.col("ts").alias("_t"), F.struct("ts", "price").alias("q")).unionByName(start.select("_b", F.col("q.ts").alias("_t"), "q"))
        one = one.select("_b", "_t", *[(F.col("q") if i == j else F.lit(None).cast(kind)).alias(f"_q{j}") for j in range(len(series))])
        quoted = one if quoted is None else quoted.unionByName(one)
    dealt = F.pmod(F.xxhash64(*names), F.lit(salt)).cast("int")
    left = rows.select(F.floor(F.col(at) / bucket).alias("_b"), dealt.alias("_p"), F.col(at).cast("long").alias("_t"), F.lit(1).alias("_s"), F.struct(*names).alias("_row"), *[F.lit(None).cast(kind).alias(f"_q{j}") for j in range(len(series))])
    right = quoted.withColumn("_p", F.explode(F.array(*[F.lit(k) for k in range(salt)]))).withColumn("_s", F.lit(0)).withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType))
    w = Window.partitionBy("_b", "_p").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumns({f"_q{j}": F.last(f"_q{j}", True).over(w) for j in range(len(series))}).where("_s = 1")
    found = [F.when(F.col("_t") - F.col(f"_q{j}.ts") <= age, F.struct(F.col(f"_q{j}.ts").alias("ts"), F.col(f"_q{j}.price").alias("price"), F.lit(name).alias("source"))) for j, (name, _, age) in enumerate(series)]
    answer = lambda price, source: F.struct(F.lit(None).cast("long").alias("ts"), price.cast("double").alias("price"), F.lit(source).alias("source"))
    if explicit is not None:
        own = F.col(f"_row.{explicit}")
        found.insert(0, F.when(own > 0, answer(own, "explicit")))
    if default is not None:
        found.append(answer(F.lit(default), "default"))
    got = seen.select("_row", F.coalesce(*found).alias("_a"))
    return got.select("_row.*", F.col("_a.price").alias("quote"), F.col("_a.ts").alias("quote_ts"), F.col("_a.source").alias("quote_source"))


def minute_lookup(rows: DataFrame, quotes: DataFrame, step: int = 86400) -> DataFrame:
    """rows with the quote of their own step of time, null where it has none."""
    q = quotes.select((F.col("ts") - F.col("ts") % step).alias("_slot"), F.col("price").alias("quote"))
    return rows.withColumn("_slot", F.col("ts") - F.col("ts") % step).join(q, "_slot", "left").drop("_slot")


def detect_captures(trades: DataFrame, created: DataFrame, lo: float, hi: float, age: int, late: int = 3600, source: Column | None = None, graduated: DataFrame | None = None) -> DataFrame:
    """(entity, t0, p0, quality, reason): the first in-band trade that is `age` old, since the create or the first trade.

    The quality follows the source of the quote, HIGH for pyth and pyth_asof and else MED, and is LOW when the
    first trade comes more than `late` after the create. Entities without such a trade get their first in-band
    one with LOW and a reason. Those first seen above the band, graduated by then, or never in the band are REJECT.
    """
    rows = implied_mc(trades).join(created.groupBy("entity").agg(F.min("created").alias("created")), "entity", "left")
    rows = rows.withColumn("first", F.min("ts").over(Window.partitionBy("entity"))).withColumn("source", F.lit(None).cast("string") if source is None else source)
    old = F.coalesce(F.col("ts") - F.col("created") >= age, F.lit(False)) | (F.col("ts") - F.col("first") >= age)
    banded = in_band(F.col("price"), lo, hi)
    pick = F.struct("ts", "id", "price", "source")
    got = rows.groupBy("entity").agg(F.min(F.when(banded & old, pick)).alias("fit"), F.min(F.when(banded, pick)).alias("any"), F.min("created").alias("created"), F.min("first").alias("first"), F.min(F.when(F.col("price").isNotNull(), F.struct("ts", "id", "price"))).alias("seen"))
    if graduated is not None:
        got = got.join(graduated.select("entity", "graduated"), "entity", "left")
    best = F.coalesce("fit", "any")
    gone = F.coalesce(F.col("graduated") <= best["ts"], F.lit(False)) if graduated is not None else F.lit(False)
    graded = F.when(F.coalesce(F.col("first") - F.col("created") > late, F.lit(False)), "LOW").when(F.lower(best["source"]).isin("pyth", "pyth_asof"), "HIGH").otherwise("MED")
    reject = F.when(F.col("any").isNull(), "never_in_band").when(F.col("seen.price") > hi, "first_seen_above_band").when(gone, "graduated")
    quality = F.when(reject.isNotNull(), "REJECT").when(F.col("fit").isNull(), "LOW").otherwise(graded)
    reason = F.coalesce(reject, F.when(F.col("fit").isNull(), "too_young").otherwise(""))
    return got.select("entity", best["ts"].alias("t0"), best["price"].alias("p0"), quality.alias("quality"), reason.alias("reason"))


def curve_path(trades: DataFrame, v0: float = 30.0, k: float = 30.0 * 1.073e9) -> DataFrame:
    """Price after each trade on a constant-product curve: reserves are running sums of signed base amounts."""
    w = Window.partitionBy("entity").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "buy", F.col("base")).otherwise(-F.col("base"))
    rows = trades.withColumn("reserve", F.greatest(F.lit(v0) + F.sum(signed).over(w), F.lit(1e-9)))
    return rows.withColumn("curve_price", F.col("reserve") * F.col("reserve") / k)
