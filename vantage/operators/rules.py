"""Row rules and small joins over trades, captures and scores, and the variants of the capture detector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .capture import implied_mc, in_band, minute_lookup
from .gates import all_of, quality_of
from .ordered import exact_quantiles


def suffix_filter(rows: DataFrame, column: str, suffix: str) -> DataFrame:
    """Rows whose value, as text, ends in the suffix; null does not."""
    return rows.where(F.col(column).cast("string").endswith(suffix))


def t0_features(captures: DataFrame, lo: float, hi: float, curve: str = "pumpdotfun") -> DataFrame:
    """(entity, t0, band_pos, log1p_p0, is_<curve>): where p0 lies in the band, 0 to 1 at its ends, and the venue at t0."""
    return captures.select("entity", "t0", ((F.col("p0") - lo) / (hi - lo)).alias("band_pos"), F.log1p("p0").alias("log1p_p0"), (F.col("venue0") == curve).cast("int").alias(f"is_{curve}"))


def usd_legs(trades: DataFrame, quotes: DataFrame, amount: str = "tok", scale: float = 1.0, step: int = 86400) -> DataFrame:
    """trades with quote and leg_usd, the amount over its scale (units in one) at the quote of its step of time; both null
    where the step has none."""
    return minute_lookup(trades, quotes, step).withColumn("leg_usd", F.col(amount) / scale * F.col("quote"))


def resolve_label(rows: DataFrame, primary: Column, proxy: Column) -> DataFrame:
    """Adds label, the primary one where it is known, else the proxy, and label_source: primary, proxy or none."""
    source = F.when(primary.isNotNull(), "primary").when(proxy.isNotNull(), "proxy").otherwise("none")
    return rows.withColumn("label", F.coalesce(primary.cast("int"), proxy.cast("int"))).withColumn("label_source", source)


def capture_id(entity: Column, t0: Column, version: str = "v1") -> Column:
    """The first 32 hex digits of the SHA-256 of entity|t0|version."""
    return F.substring(F.sha2(F.concat_ws("|", entity.cast("string"), t0.cast("string"), F.lit(version)), 256), 1, 32)


def sanity_filter(priced: DataFrame, most_price: float, most_mc: float | None = None) -> DataFrame:
    """Rows with a positive price up to a bound and, where told, a market cap up to one; null and NaN are outside."""
    rules = [in_band(F.col("price"), 0.0, most_price), F.col("price") > 0]
    return priced.where(all_of(rules + ([in_band(F.col("mc"), 0.0, most_mc)] if most_mc is not None else [])))


def fill_price(price: Column, fee_bps: float = 125.0) -> Column:
    """What is paid in all for a price with a fee in hundredths of a percent."""
    return price * (1 + fee_bps / 1e4)


def anti_done(rows: DataFrame, done: DataFrame, key: str = "entity") -> DataFrame:
    """Rows whose key is not among the done ones; rows without a key stay."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def compare_implied(trades: DataFrame, quotes: DataFrame, step: int = 86400) -> DataFrame:
    """(entity, n, least, most): of trades with a quote, the range of usd over amount times quote; null for no amount."""
    rows = minute_lookup(trades, quotes, step).where("quote is not null")
    ratio = F.col("usd").cast("double") / F.nullif(F.col("tok") * F.col("quote"), F.lit(0.0))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))


def key_coverage(expected: DataFrame, found: DataFrame, key: str = "entity", least: float = 0.995) -> DataFrame:
    """One row (n_keys, n_expected, coverage, complete): how many of the expected keys are found; no keys are no coverage."""
    both = expected.select(key).distinct().join(found.select(key, F.lit(1).alias("_f")).distinct(), key, "left").agg(F.count("_f").alias("n_keys"), F.count("*").alias("n_expected"))
    return both.select("n_keys", "n_expected", (F.col("n_keys") / F.nullif(F.col("n_expected"), F.lit(0))).alias("coverage"), (F.col("n_keys") >= least * F.col("n_expected")).alias("complete"))


def prior_coverage(captures: DataFrame, store: DataFrame, key: str = "entity") -> DataFrame:
    """One row (n, covered): the captures, counted each, and the share of them whose key the store has."""
    rows = captures.join(store.select(key, F.lit(1).alias("_k")).distinct(), key, "left")
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("_k").isNotNull().cast("int")).alias("covered"))


def band_outcome(captures: DataFrame, priced: DataFrame, migrated: str = "pumpswap") -> DataFrame:
    """(entity, t0, max_after, reached): the largest price after t0, null without any, and whether a trade with a price
    stands at the venue after migration."""
    after = captures.select("entity", "t0").join(priced, "entity").where("ts > t0 and price is not null")
    after = after.groupBy("entity", "t0").agg(F.max("price").alias("max_after"), F.bool_or(F.col("venue") == migrated).alias("reached"))
    return captures.select("entity", "t0").join(after, ["entity", "t0"], "left").select("entity", "t0", "max_after", F.coalesce("reached", F.lit(False)).alias("reached"))


def score_by_outcome(preds: DataFrame, outcome: str = "y") -> DataFrame:
    """(outcome, n, least, most, median) of the scores; the median is exact and needs no group in one buffer."""
    ends = preds.groupBy(outcome).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
    q = exact_quantiles(preds.where(F.col("score").isNotNull()), [outcome], "score", [0.5])
    return ends.join(q.select(F.col(outcome).alias("_o"), "q"), F.col(outcome).eqNullSafe(F.col("_o")), "left").select(outcome, "n", "least", "most", F.col("q")[0].alias("median"))


def event_coverage(captures: DataFrame, trades: DataFrame) -> DataFrame:
    """(entity, n_after, first_after, last_after) of each capture's trades after t0; a capture without any has 0."""
    after = trades.join(captures.select("entity", "t0"), "entity").where("ts > t0").groupBy("entity").agg(F.count("*").alias("n"), F.min("ts").alias("first_after"), F.max("ts").alias("last_after"))
    return captures.select("entity").join(after, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n_after"), "first_after", "last_after")


def closest_to(rows: DataFrame, value: str, target: float, n: int, key: str = "entity") -> DataFrame:
    """The n rows whose value is closest to the target, ties by key: Spark keeps n rows a task. Null values are not taken."""
    return rows.where(F.col(value).isNotNull()).orderBy(F.abs(F.col(value) - target), key).limit(n)


def newest(rows: DataFrame, n: int | None = None, at: str = "t0", key: str = "entity") -> DataFrame:
    """Rows from the newest on, ties by key; the first n of them."""
    ordered = rows.orderBy(F.desc(at), key)
    return ordered if n is None else ordered.limit(n)


def distinct_buyers(pit: DataFrame) -> DataFrame:
    """(entity, t0, trader), once each, of the buys up to t0."""
    return pit.where("side = 'buy'").select("entity", "t0", "trader").distinct()


#: Columns that a row of the training matrix needs, each with the test it must pass; null fails.
TRAINING = {"enough_trades": "n >= 3", "has_age": "oldest > 0", "known_create": "created is not null"}


def training_matrix(rows: DataFrame, rules: Mapping[str, str] = TRAINING, loose: Mapping[str, str] | None = None, least: int = 80) -> DataFrame:
    """Rows that pass all rules (SQL conditions by name). Where fewer than `least` do, those that pass the loose rules,
    if that is more rows. Counting is one job with one row of result."""
    tight = all_of([F.expr(r) for r in rules.values()])
    if loose is None:
        return rows.where(tight)
    wide = all_of([F.expr(r) for r in loose.values()])
    n = rows.agg(F.count_if(tight).alias("tight"), F.count_if(wide).alias("wide")).first()
    return rows.where(wide if n["tight"] < least and n["wide"] > n["tight"] else tight)


def score_gates(lo: float, migrated: str = "pumpswap") -> dict[str, Column]:
    """The gates before scoring, in order, over rows (known, t0, created, p0, venue0, prior_ok): a create is known and not
    after t0, the price is at `lo` or above, the venue is not the one after migration, the prior is from training."""
    return {"capture": F.coalesce("known", F.lit(False)), "age": F.col("t0") >= F.col("created"), "t0": F.col("p0") >= lo, "oracle": F.col("venue0") != migrated, "prior_source": F.coalesce("prior_ok", F.lit(False))}


def pack_checks(apart: int = 2) -> dict[str, Column]:
    """What is wrong with a row of a feature pack (t0, pack_t0, created, share, progress, n_buyers, n_buys, venue0), by check."""
    return {
        "t0_match": F.abs(F.col("t0") - F.col("pack_t0")) > apart, "create_leq_t0": F.col("created") > F.col("t0"), "age_nonneg": F.col("t0") - F.col("created") < 0,
        "shares_01": ~F.col("share").between(0, 1.0001), "progress_01": ~F.col("progress").between(0, 1), "cardinality": F.col("n_buyers") > F.col("n_buys"), "migrated_rate": F.col("venue0") == "pumpswap",
    }


# Variants of the capture detector. Each gives (entity, t0, mc, quality, refined, n_window, tradeable, detail).


def capture_first_band(trades: DataFrame, lo: float, hi: float, source: str = "pyth", sightings: DataFrame | None = None, supply: float = 1e9) -> DataFrame:
    """The first trade of each entity whose own market cap lies in [lo, hi], ties by id. Entities without one are LOW, not
    refined, with mc 0 and the time of their sighting (entity, seen), else of their last trade. Trades and sightings both count
    as entities. One aggregate of structs: no sort and no window."""
    rows = implied_mc(trades, supply)
    got = rows.groupBy("entity").agg(F.min(F.when(in_band(F.col("mc"), lo, hi), F.struct("ts", "id", "mc"))).alias("f"), F.max("ts").alias("last"))
    if sightings is not None:
        got = got.join(sightings.groupBy("entity").agg(F.min("seen").alias("seen")), "entity", "full")
    seen = F.col("seen") if sightings is not None else F.lit(None).cast("long")
    hit = F.col("f").isNotNull()
    quality = F.when(hit, quality_of(F.lit(source))).otherwise("LOW")
    return got.select("entity", F.coalesce("f.ts", seen, "last").alias("t0"), F.coalesce("f.mc", F.lit(0.0)).alias("mc"), quality.alias("quality"), hit.alias("refined"), hit.cast("int").alias("n_window"), F.lit(0).cast("long").alias("tradeable"), F.when(hit, "first_band").otherwise("no_band_trade").alias("detail"))


def capture_aligned(path: DataFrame, creates: DataFrame, lo: float, hi: float, least_age: int = 30, source: str = "pyth") -> DataFrame:
    """path (entity, ts, id, mc) after each trade -> the first time in the band that is tradeable: `least_age` after the create
    or after the first trade, or, as training does, before that age as long as the create is not in the future.

    n_window counts the trades of the `least_age` up to t0. Entities that are never tradeable in the band are LOW with their
    first time in it and the detail too_young; those never in the band are REJECT. tradeable is the age that counted.
    """
    made = creates.groupBy("entity").agg(F.min("created").alias("created"))
    times = path.where("entity is not null").select("entity", "ts").repartition("entity")  # one shuffle for the first times and for the counts
    first = times.groupBy("entity").agg(F.min("ts").alias("first"))
    inside = in_band(F.col("mc"), lo, hi)
    rows = path.where(inside).join(first, "entity").join(made, "entity", "left")
    age, since = F.col("ts") - F.col("created"), F.col("ts") - F.col("first")
    ok = F.coalesce(age >= least_age, F.lit(False)) | (since >= least_age) | F.coalesce(age.between(0, least_age - 1), F.lit(False))
    span = F.when(age >= least_age, age).when(since >= least_age, since).otherwise(age)
    point = F.struct("ts", "id", "mc", span.alias("span"))
    got = first.join(rows.groupBy("entity").agg(F.min(F.when(ok, point)).alias("f"), F.min(point).alias("any")), "entity", "left")
    near = times.join(got.where("f is not null").select("entity", F.col("f.ts").alias("_t")), "entity").groupBy("entity").agg(F.count_if(F.col("ts").between(F.col("_t") - least_age, F.col("_t"))).cast("int").alias("n"))
    out = got.join(near, "entity", "left")
    hit, some = F.col("f").isNotNull(), F.col("any").isNotNull()
    quality = F.when(hit, quality_of(F.lit(source))).when(some, "LOW").otherwise("REJECT")
    detail = F.when(hit, "aligned").when(some, "too_young").otherwise("never_in_band")
    return out.select("entity", F.coalesce("f.ts", "any.ts", "first").alias("t0"), F.coalesce("f.mc", "any.mc", F.lit(0.0)).alias("mc"), quality.alias("quality"), hit.alias("refined"), F.coalesce("n", F.lit(0)).alias("n_window"), F.coalesce("f.span", F.lit(0)).cast("long").alias("tradeable"), detail.alias("detail"))


def capture_sighting(sightings: DataFrame, creates: DataFrame, lo: float, hi: float, most_age: int = 86400) -> DataFrame:
    """sightings (entity, seen, mc, complete), one an entity: t0 is the sighting itself. REJECT where it is complete, outside the
    band, or before the create; LOW without a create or beyond most_age; else MED and refined. In this order."""
    made = creates.groupBy("entity").agg(F.min("created").alias("created"))
    rows = sightings.join(made, "entity", "left").withColumn("age", F.col("seen") - F.col("created"))
    reject = F.when(F.coalesce("complete", F.lit(False)), "graduated").when(~in_band(F.col("mc"), lo, hi), "mc_out_of_band").when(F.col("age") < 0, "create_after_t0")
    low = F.when(F.col("created").isNull(), "missing_create").when(F.col("age") > most_age, "age_above_most")
    told = F.coalesce(reject, low)
    spent = F.when(F.coalesce(reject, F.lit("")).isin("graduated", "mc_out_of_band"), 0).otherwise(F.coalesce("age", F.lit(0)))
    quality = F.when(reject.isNotNull(), "REJECT").when(low.isNotNull(), "LOW").otherwise("MED")
    return rows.select("entity", F.col("seen").alias("t0"), "mc", quality.alias("quality"), told.isNull().alias("refined"), F.lit(0).alias("n_window"), spent.cast("long").alias("tradeable"), F.coalesce(told, F.lit("sighting")).alias("detail"))
