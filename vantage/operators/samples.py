"""Samples by class, week and recency. Rows are chosen in hash order, so that runs agree, and numbered in buckets, so
that no class is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 7 * 86400


def numbered(rows: DataFrame, by: list[str], bucket: Column, *order) -> DataFrame:
    """Adds _i, the 0-based place of a row within its group: rows are numbered within buckets, which must not decrease
    along the order, and moved on by the count of the buckets before."""
    tagged = rows.withColumn("_b", bucket)
    sizes = tagged.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    return tagged.withColumn("_r", place).join(before, [*by, "_b"]).withColumn("_i", F.col("_r") + F.col("_off") - 1).drop("_b", "_r", "_off")


def take(rows: DataFrame, by: list[str], quota: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Of each group the first `_k` rows in hash order; quota (by, _k) has a row for each group, and groups are few."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    placed = numbered(hashed, by, F.shiftright("_h", 52), "_h", key)
    return placed.join(F.broadcast(quota), by).where("_i < _k").drop("_i", "_h", "_k")


def stratified_cap(rows: DataFrame, label: str, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows, half of each class where there are enough, the rest of the other; within a class the weeks keep their
    shares, and what is left of rounding goes to the largest fractions, earlier weeks first."""
    tagged = rows.withColumn("_w", F.floor((F.col("t0") + 3 * 86400) / WEEK))
    sizes = tagged.groupBy(label, "_w").agg(F.count("*").alias("_s"))
    one = sizes.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("_s"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col(label) == 0, F.col("_s"))), F.lit(0)).alias("m"))
    neg = F.least("m", F.lit(n) - F.least("p", F.lit(n // 2)))
    goal = one.select(F.inline(F.array(F.struct(F.lit(1).alias(label), F.least("p", F.lit(n) - neg).alias("_goal"), F.col("p").alias("_t")), F.struct(F.lit(0).alias(label), neg.alias("_goal"), F.col("m").alias("_t")))))
    shared = sizes.join(F.broadcast(goal), label).withColumn("_q", F.floor(F.col("_s") * F.col("_goal") / F.col("_t"))).withColumn("_f", (F.col("_s") * F.col("_goal")) % F.col("_t"))
    left = F.col("_goal") - F.sum("_q").over(Window.partitionBy(label))  # weeks of a class: a small table
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("_f"), "_w"))
    quota = shared.select(label, "_w", (F.col("_q") + (order <= left).cast("int")).alias("_k"))
    return take(tagged, [label, "_w"], quota, key, seed).drop("_w")


def take_recent(rows: DataFrame, by: str, quota: DataFrame, key: str, share: float = 0.7, seed: int = 7) -> DataFrame:
    """Of each group `_k` rows, of which `share` from its newer half and the rest from the older one; where a half is
    too small the other one gives more. quota: (by, _k), a row for each group."""
    placed = numbered(rows, [by], -F.floor(F.col("t0") / 86400), F.desc("t0"), key)
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n")).join(F.broadcast(quota), by)
    sizes = sizes.withColumn("_mid", F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).withColumn("_k", F.least("_k", "_n"))
    newer = F.least(F.rint(F.col("_k") * share).cast("long"), F.col("_mid"))
    sizes = sizes.withColumn("_old", F.least(F.col("_k") - newer, F.col("_n") - F.col("_mid")))
    halves = placed.join(F.broadcast(sizes.select(by, "_mid")), by).withColumn("_newer", F.col("_i") < F.col("_mid")).drop("_i", "_mid")
    each = sizes.select(by, F.inline(F.array(F.struct(F.lit(True).alias("_newer"), F.least(F.col("_k") - F.col("_old"), F.col("_mid")).alias("_k")), F.struct(F.lit(False).alias("_newer"), F.col("_old").alias("_k")))))
    return take(halves, [by, "_newer"], each, key, seed).drop("_newer")


def recency_sample(rows: DataFrame, label: str, n: int, key: str, share: float = 0.7, seed: int = 7) -> DataFrame:
    """n rows with classes in proportion, newer rows preferred: see take_recent."""
    one = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("m"))
    pos = F.greatest(F.lit(1), F.least(F.rint(n * F.col("p") / (F.col("p") + F.col("m"))).cast("long"), F.col("p"), F.lit(n - 1)))
    quota = one.select(F.inline(F.array(F.struct(F.lit(1).alias(label), pos.alias("_k")), F.struct(F.lit(0).alias(label), F.least(n - pos, F.col("m")).alias("_k")))))
    return take_recent(rows, label, quota, key, share, seed)


def augment_sample(rows: DataFrame, base: Column, label: str, n: int, least_negatives: int, key: str, share: float = 0.7, seed: int = 7) -> DataFrame:
    """All base rows, then positives, but for `least_negatives` places, then negatives up to n; positives fill what
    negatives leave. Adds in_base. Base rows stay even beyond n."""
    tagged = rows.withColumn("in_base", F.coalesce(base, F.lit(False)))
    rest = tagged.where("not in_base")
    one = tagged.agg(F.count_if("in_base").alias("b"), F.count_if(~F.col("in_base") & (F.col(label) == 1)).alias("p"), F.count_if(~F.col("in_base") & (F.col(label) == 0)).alias("m"))
    room = F.greatest(n - F.col("b"), F.lit(0))
    first = F.least(F.greatest(room - least_negatives, F.lit(0)), F.col("p"))
    neg = F.least(room - first, F.col("m"))
    quota = one.select(F.inline(F.array(F.struct(F.lit(1).alias(label), F.least(room - neg, F.col("p")).alias("_k")), F.struct(F.lit(0).alias(label), neg.alias("_k")))))
    return tagged.where("in_base").unionByName(take_recent(rest, label, quota, key, share, seed))


def _slots(sizes: DataFrame, goal: Column, size: Column, out: str) -> DataFrame:
    """Adds goal slots shared in proportion to a size by largest remainder, earlier weeks first; sizes is a row for each week."""
    every = Window.partitionBy()  # weeks: a small table
    total = F.sum(size).over(every)
    shared = sizes.withColumn("_t", total).withColumn("_g", goal)
    known = F.col("_t") > 0
    shared = shared.withColumn("_q", F.when(known, F.floor(size * F.col("_g") / F.col("_t"))).otherwise(0)).withColumn("_f", F.when(known, (size * F.col("_g")) % F.col("_t")).otherwise(0))
    left = F.col("_g") - F.sum("_q").over(every)
    return shared.withColumn(out, (F.col("_q") + (F.row_number().over(Window.orderBy(F.desc("_f"), "_w")) <= left).cast("long")).cast("long")).drop("_t", "_g", "_q", "_f")


def mirrored_sample(rows: DataFrame, label: str, n_pos: int, n_neg: int, key: str, seed: int = 7) -> DataFrame:
    """Positives by their weeks, and negatives that mirror the weeks of the positives taken.

    n_pos positives are taken, or all of them if there are fewer; then as many negatives as positives, else n_neg. Weeks share
    both in proportion to the positives, by largest remainder, earlier weeks first. A week with too few negatives gives
    all it has, and what is missing is shared over the negatives left in all weeks in proportion to them, which always
    suffices, so none is missing while one is left. Rows of a (class, week) are chosen in hash order. Rows without a
    label or time are not taken.
    """
    tagged = rows.where(F.col(label).isin(0, 1) & F.col("t0").isNotNull()).withColumn("_w", F.floor((F.col("t0") + 3 * 86400) / WEEK))
    sizes = tagged.groupBy("_w").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("m"))
    every = Window.partitionBy()
    have_p, have_m = F.sum("p").over(every), F.sum("m").over(every)
    goals = sizes.withColumn("_gp", F.least(F.lit(n_pos), have_p)).withColumn("_gn", F.least(have_m, F.when(have_p < n_pos, have_p).otherwise(n_neg)))
    pos = _slots(goals, F.col("_gp"), F.col("p"), "kp")
    want = _slots(pos, F.when(F.col("_gp") > 0, F.col("_gn")).otherwise(0), F.col("kp"), "want")
    capped = want.withColumn("c", F.least("m", "want")).withColumn("_gn", F.when(F.col("_gp") > 0, F.col("_gn")).otherwise(0))
    filled = _slots(capped, F.col("_gn") - F.sum("c").over(every), F.col("m") - F.col("c"), "more")
    quota = filled.select(F.explode(F.array(F.struct(F.lit(1).alias(label), "_w", F.col("kp").alias("_k")), F.struct(F.lit(0).alias(label), "_w", (F.col("c") + F.col("more")).alias("_k")))).alias("x")).select("x.*")
    return take(tagged, [label, "_w"], quota, key, seed).drop("_w")


def negatives_cap(rows: DataFrame, label: str, cap: int, key: str, whole: int | None = None, seed: int = 7) -> DataFrame:
    """All rows but those with label 0; of these, all where they are at most `whole` (the cap unless told), else about `cap`,
    spread over weeks of t0 as they lie.

    A week's quota is its share of the cap, rounded half to even, and at least one. Where the quotas are too many, one after
    another is taken from the largest, the earliest week of equal ones first; where they are too few, the largest gets the
    rest. What repeated taking leaves is told at once: the largest weeks, lowered to one level, so a table of a row for
    each week is all that is ordered. A quota above its week's rows takes them all. Rows without a t0 are a week of their own.
    Rows of a week are chosen in hash order, so runs agree.
    """
    week = F.coalesce(F.floor((F.col("t0") + 3 * 86400) / WEEK), F.lit(-(1 << 40)))
    tagged = rows.withColumn("_w", week)
    negative = F.coalesce(F.col(label) == 0, F.lit(False))
    every, order = Window.partitionBy(), Window.orderBy(F.desc("_a"), "_w")
    weeks = tagged.where(negative).groupBy("_w").agg(F.count("*").alias("_s")).withColumn("_t", F.sum("_s").over(every))
    goal = F.least(F.col("_t"), F.lit(cap))
    weeks = weeks.withColumn("_a", F.greatest(F.bround(F.col("_s") / F.col("_t") * goal).cast("long"), F.lit(1)))
    weeks = weeks.withColumn("_over", F.sum("_a").over(every) - goal).withColumn("_i", F.row_number().over(order)).withColumn("_p", F.sum("_a").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lowered = F.col("_p") - F.col("_i") * F.col("_a") < F.col("_over")  # taking has reached this week
    weeks = weeks.withColumn("_m", F.count_if(lowered).over(every)).withColumn("_left", F.max(F.when(lowered, F.col("_p"))).over(every) - F.col("_over"))
    level = F.floor(F.col("_left") / F.col("_m")) + (F.col("_i") > F.col("_m") - F.col("_left") % F.col("_m")).cast("long")
    quota = F.when(F.col("_over") > 0, F.when(F.col("_i") <= F.col("_m"), level).otherwise(F.col("_a"))).otherwise(F.col("_a") - F.when(F.col("_i") == 1, F.col("_over")).otherwise(0))
    quota = F.when(F.col("_t") <= (cap if whole is None else whole), F.col("_s")).otherwise(F.least(quota, "_s"))
    kept = take(tagged.where(negative), ["_w"], weeks.select("_w", quota.alias("_k")), key, seed)
    return tagged.where(~negative).drop("_w").unionByName(kept.select(*rows.columns))
