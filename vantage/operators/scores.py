"""Engineered features, fixed-weight scores, bands, samples and comparisons of score sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import numbered

EPS = 1e-9


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def engineered(rows: DataFrame) -> DataFrame:
    """Adds ratios, shares, logs and interactions of the flow columns of two windows, 60s and 5m; null stays null."""
    c = lambda name: F.col(name).cast("double")
    over = lambda a, b: a / (b + EPS)
    out: dict[str, Column] = {}
    for w in ("60s", "5m"):
        buy, sell = c(f"buy_vol_usd_{w}"), c(f"sell_vol_usd_{w}")
        out |= {f"buy_sell_vol_ratio_{w}": over(buy, sell), f"buy_share_{w}": over(buy, buy + sell), f"sell_pressure_{w}": over(sell, buy + sell)}
        out |= {f"log1p_buy_vol_{w}": F.log1p(F.greatest(buy, F.lit(0.0))), f"net_buy_vol_{w}": buy - sell}
    buy, sell, n_buy, n_sell = c("buy_vol_usd_60s"), c("sell_vol_usd_60s"), c("buy_count_60s"), c("sell_count_60s")
    out |= {"log1p_sell_vol_60s": F.log1p(F.greatest(sell, F.lit(0.0))), "log1p_net_buy_vol_60s": signed_log(buy - sell)}
    out |= {"buy_sell_count_ratio_60s": over(n_buy, n_sell), "buy_count_share_60s": over(n_buy, n_buy + n_sell)}
    trades, traders, age = F.greatest(c("trade_count_total"), F.lit(0.0)), c("unique_traders_total"), F.greatest(c("time_since_first_trade_s"), F.lit(0.0))
    out |= {"unique_traders_per_trade": over(traders, trades), "trades_per_unique_trader": over(trades, traders)}
    out |= {"buy_vol_per_trader_60s": over(buy, c("unique_traders_60s")), "buy_vol_per_buy_count_60s": over(buy, n_buy)}
    out |= {"buy_vol_60s_over_5m": over(buy, c("buy_vol_usd_5m")), "buy_count_60s_over_5m": over(n_buy, c("buy_count_5m"))}
    out |= {"log1p_time_since_first_trade_s": F.log1p(age), "buy_vol_per_age_60s": buy / (age + 1)}
    out |= {"buy_vol_x_mc_band": buy * c("mc_band_pos"), "log_buy_vol_x_log_mc": F.log1p(F.greatest(buy, F.lit(0.0))) * c("log1p_mc_usd_t0")}
    return rows.withColumns(out)


def lite_inputs(age_fill: float = 900.0) -> dict[str, Column]:
    """The clipped and scaled inputs of the lite score; missing values have soft defaults, but for the bought volume."""

    def soft(name: str, lo: float, hi: float, default: float = 0.0) -> Column:
        value = F.col(name).cast("double")
        return F.least(F.greatest(F.coalesce(F.when(~F.isnan(value), value), F.lit(default)), F.lit(lo)), F.lit(hi))

    bought = F.col("buy_vol_usd_60s").cast("double")
    return {
        "buy_vol_usd_60s": F.when(bought.isNotNull() & ~F.isnan(bought), F.log1p(F.least(F.greatest(bought, F.lit(0.0)), F.lit(1e7))) / 10),
        **{c: soft(c, 0.0, 1.0) for c in ("sniper_vol_share_5s", "top1_buyer_vol_share", "top5_buyer_vol_share", "progress_curve_proxy")},
        "age_s": F.log1p(soft("age_s", 0.0, 86400.0, age_fill)) / 10,
        "net_sol_curve": soft("net_sol_curve", -85.0, 85.0) / 85,
        "creator_prior_mints_7d": F.log1p(soft("creator_prior_mints_7d", 0.0, 100.0)) / 5,
        "creator_prior_mints_30d": F.log1p(soft("creator_prior_mints_30d", 0.0, 300.0)) / 5,
    }


def lite_score(rows: DataFrame, weights: dict[str, float], bias: float, temperature: float = 1.0) -> DataFrame:
    """Adds score, a logistic of fixed weights over the lite inputs; null without the bought volume."""
    z = F.lit(bias)
    for name, phi in lite_inputs().items():
        if weights.get(name):
            z = z + weights[name] * phi
    return rows.withColumn("score", 1 / (1 + F.exp(-(z / temperature if temperature > 0 else z))))


#: Score by the number of rules that hold.
RULE_SCORES = (0.1, 0.35, 0.65, 0.9)


def rule_score(rules: list[Column]) -> Column:
    """A fixed score by how many of three rules hold; null does not."""
    n = sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules[1:]), F.coalesce(rules[0], F.lit(False)).cast("int"))
    return F.get(F.array(*[F.lit(x) for x in RULE_SCORES]), n)


def lanes(rows: DataFrame, scores: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per lane <lane>_score and <lane>_pass (score at or above its threshold; null does not pass), and n_pass."""
    out = rows.withColumns({f"{k}_score": c for k, (c, _) in scores.items()})
    out = out.withColumns({f"{k}_pass": F.coalesce(F.col(f"{k}_score") >= t, F.lit(False)) for k, (_, t) in scores.items()})
    return out.withColumn("n_pass", sum((F.col(f"{k}_pass").cast("int") for k in scores), F.lit(0)))


def recommend_band(bands: DataFrame, precision: float = 0.85, hits: int = 20, least: int = 50) -> DataFrame:
    """The band with most hits among those precise enough with hits enough; else the most precise of `least` entries
    or more; else the most precise of all. One row with its policy; none without bands."""
    good = (F.col("precision") >= precision) & (F.col("hits") >= hits)
    tier = F.when(good, 2).when(F.col("entries") >= least, 1).otherwise(0)
    rank = F.struct(tier.alias("tier"), F.when(good, F.col("hits").cast("double")).otherwise(F.col("precision")).alias("x"), F.when(good, F.col("precision")).otherwise(F.col("hits").cast("double")).alias("y"), F.struct(*bands.columns).alias("band"))
    best = bands.where("precision is not null").agg(F.max(rank).alias("r")).where("r is not null")
    return best.select("r.band.*", F.when(F.col("r.tier") == 2, "precision_max_hits").otherwise("fallback_best_precision").alias("policy"))


def compare_to_baseline(rows: DataFrame, by: str, baseline: str, values: list[str], small: float = 0.005) -> DataFrame:
    """Each row's values less those of the baseline row, and whether all of them are below `small`, so that the simpler one will do.

    Of several baseline rows the least counts; without one there are no deltas."""
    base = rows.where(F.col(by) == baseline).agg(F.min(F.struct(*values)).alias("b")).select(*[F.col(f"b.{v}").alias(f"_{v}") for v in values])  # one row
    out = rows.crossJoin(F.broadcast(base)).withColumns({f"delta_{v}": F.round(F.col(v) - F.col(f"_{v}"), 6) for v in values}).drop(*[f"_{v}" for v in values])
    within = [F.abs(F.col(f"delta_{v}")) < small for v in values]
    return out.withColumn("prefer_simpler", sum((w.cast("int") for w in within), F.lit(0)) == len(values))


def strategy_compare(rows: DataFrame, rules: dict[str, Column], baseline: str) -> DataFrame:
    """(strategy, n, hit_rate, cum_r, mean_r and their deltas) of rows (y, r) that each rule accepts, less the baseline's.

    All rules are summed in one pass, so rows are not multiplied; a rule that is null accepts nothing. Rates and means of no
    rows are null, and so are deltas to them.
    """
    one = []
    for name, rule in rules.items():
        take = F.coalesce(rule, F.lit(False))
        r = F.when(take, F.col("r").cast("decimal(18,6)"))
        one.append(F.struct(F.lit(name).alias("strategy"), F.count_if(take).alias("n"), F.avg(F.when(take, F.col("y"))).alias("hit_rate"), F.coalesce(F.sum(r), F.lit(0)).cast("double").alias("cum_r"), (F.sum(r) / F.nullif(F.count(r), F.lit(0))).cast("double").alias("mean_r")).alias(name))
    told = rows.agg(*one).select(F.explode(F.array(*rules)).alias("x")).select("x.*")
    return compare_to_baseline(told, "strategy", baseline, ["n", "hit_rate", "cum_r", "mean_r"]).drop("prefer_simpler")


def score_lift(a: DataFrame, b: DataFrame, high: float = 0.9) -> DataFrame:
    """One row: n, largest score, mean and share at or above `high` of two score sets, and a verdict on the second."""
    side = lambda df, p: df.agg(F.count("*").alias(f"{p}_n"), F.max("score").alias(f"{p}_max"), F.round(F.avg("score"), 6).alias(f"{p}_mean"), F.round(F.avg((F.col("score") >= high).cast("int")), 6).alias(f"{p}_high"))
    out = side(a, "last").crossJoin(side(b, "new"))  # one row each
    verdict = F.when((F.col("new_high") >= F.col("last_high")) & (F.col("new_mean") >= F.col("last_mean")), "better").when((F.col("new_high") < F.col("last_high")) & (F.col("new_mean") < F.col("last_mean")), "worse").otherwise("mixed")
    return out.withColumn("verdict", verdict)


def repair_sol(rows: DataFrame, sol_usd: float) -> DataFrame:
    """Fills sol columns that are 0 or null from usd, carries the total to the curve, and recomputes the progress."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(0.0)) == 0
    buy, sell = F.coalesce("buy_vol_usd_total", F.lit(0.0)), F.coalesce("sell_vol_usd_total", F.lit(0.0))
    needed = empty("net_sol_curve") & empty("net_sol_total") & ((buy > 0) | (sell > 0))
    out = rows.withColumn("max_buy_sol", F.when((F.col("max_buy_usd") > 0) & (F.coalesce("max_buy_sol", F.lit(0.0)) <= 0), F.col("max_buy_usd") / sol_usd).otherwise(F.col("max_buy_sol")))
    total = F.when(needed, (buy - sell) / sol_usd).otherwise(F.col("net_sol_total"))
    curve = F.when(needed, (buy - sell) / sol_usd).when(empty("net_sol_curve") & ~empty("net_sol_total"), F.col("net_sol_total")).otherwise(F.col("net_sol_curve"))
    out = out.withColumns({"net_sol_total": total, "net_sol_curve": curve})
    return out.withColumn("progress_curve_proxy", F.when(F.col("net_sol_curve").isNotNull(), F.least(F.greatest(F.col("net_sol_curve") / 85, F.lit(0.0)), F.lit(2.0))).otherwise(F.col("progress_curve_proxy")))


def resolve_priors(captures: DataFrame, store: DataFrame, cohort: DataFrame) -> DataFrame:
    """captures (entity, creator) with prior and prior_source: the stored row of the entity, else the count of the
    cohort of its creator, else 0 where the creator is known ('empty'), else null ('none')."""
    out = captures.join(store.select("entity", F.col("prior").alias("_s")), "entity", "left").join(cohort.select("creator", F.col("prior").alias("_c")), "creator", "left")
    source = F.when(F.col("_s").isNotNull(), "store").when(F.col("_c").isNotNull(), "cohort").when(F.col("creator").isNotNull(), "empty").otherwise("none")
    return out.withColumn("prior_source", source).withColumn("prior", F.coalesce("_s", "_c", F.when(F.col("creator").isNotNull(), F.lit(0)))).drop("_s", "_c")


def relabel(captures: DataFrame, prices: DataFrame, peaks: DataFrame, horizon: int, multiple: float, slack: int = 3600) -> DataFrame:
    """(entity, top, source, hit): the highest of own prices in (t0, t0 + horizon] and of an outside peak whose time is
    at most `slack` before t0. Without evidence the label is false and the source none."""
    after = (F.col("ts") > F.col("t0")) & (F.col("ts") <= F.col("t0") + horizon)
    own = prices.join(captures.select("entity", "t0"), "entity").groupBy("entity").agg(F.max(F.when(after, F.col("price"))).alias("own"))
    out = captures.select("entity", "t0", "p0").join(own, "entity", "left").join(peaks.select("entity", "peak_ts", "peak"), "entity", "left")
    outside = F.when(F.col("peak_ts") >= F.col("t0") - slack, F.col("peak"))
    top = F.greatest("own", outside)
    source = F.when(top.isNull(), "none").when(F.col("own").isNull() | (outside > F.col("own")), "peak").otherwise("trades")
    return out.select("entity", top.alias("top"), source.alias("source"), F.coalesce(top >= multiple * F.col("p0"), F.lit(False)).alias("hit"))


def outlier_join(rows: DataFrame, side: DataFrame, flags: list[str]) -> DataFrame:
    """Left join of flags by entity; rows that the side table lacks are no outliers."""
    out = rows.join(side.select("entity", *flags), "entity", "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def merge_by_capture(base: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join by capture_id with the columns of rows; feature_ts is stamped with t0."""
    return base.join(rows.select("capture_id", *columns), "capture_id").withColumn("feature_ts", F.col("t0"))


def matched_baseline(rows: DataFrame, chosen: DataFrame, by: str, key: str, seeds: list[int]) -> DataFrame:
    """For each seed, as many rows of each group as `chosen` has, in hash order; never more than there are. Rows are numbered in
    buckets of their hash, so no group is sorted in one task."""
    n = chosen.groupBy(by).agg(F.count("*").alias("_n"))
    seeded = rows.join(n, by).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("_h", F.xxhash64("seed", key))
    return numbered(seeded, ["seed", by], F.shiftright("_h", 52), "_h", key).where("_i < _n").drop("_i", "_h", "_n")


def forced_sample(rows: DataFrame, forced: Column, preferred: Column, n: int, key: str, seed: int = 7) -> DataFrame:
    """All forced rows, then preferred ones, then the rest in hash order, up to n; forced rows stay beyond n too."""
    rank = F.when(forced, 0).when(preferred, 1).otherwise(2)
    tagged = rows.withColumn("_p", rank).withColumn("_h", F.xxhash64(F.lit(seed), key))
    top = tagged.where("_p > 0").orderBy("_p", "_h", key).limit(n)
    room = F.lit(n) - F.col("_f")
    count = tagged.agg(F.count_if(F.col("_p") == 0).alias("_f"))
    filled = top.withColumn("_i", F.row_number().over(Window.orderBy("_p", "_h", key))).crossJoin(F.broadcast(count)).where(F.col("_i") <= room)  # n rows at most
    return tagged.where("_p = 0").drop("_p", "_h").unionByName(filled.drop("_p", "_h", "_i", "_f"))


def week_cap(rows: DataFrame, label: str, n: int, key: str, seed: int = 7) -> DataFrame:
    """At most n rows of each class, spread over weeks as the class is: of each class and week its share of n, rounded down,
    in hash order; a class of n rows or fewer stays whole."""
    week = F.floor((F.col("t0") + 3 * 86400) / (7 * 86400))
    tagged = rows.withColumn("_w", week)
    sizes = tagged.groupBy(label, "_w").agg(F.count("*").alias("_k"))
    totals = sizes.groupBy(label).agg(F.sum("_k").alias("_t"))
    quota = sizes.join(F.broadcast(totals), label).select(label, "_w", F.when(F.col("_t") <= n, F.col("_k")).otherwise(F.floor(F.col("_k") * n / F.col("_t"))).alias("_q"))  # classes are few
    r = F.row_number().over(Window.partitionBy(label, "_w").orderBy(F.xxhash64(F.lit(seed), key), key))
    return tagged.withColumn("_r", r).join(quota, [label, "_w"]).where("_r <= _q").drop("_w", "_r", "_q")
