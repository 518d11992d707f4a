"""Temporal splits, ranking metrics, strategies, sampling, merges and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import unique_by
from .ordered import cumulated, curve_metrics, exact_quantiles
from .samples import take

DAY = 86400


def row_index(df: DataFrame, *order: str, bucket: Column) -> DataFrame:
    """Adds idx, the 0-based position in the given order, without sorting everything in one task.

    bucket must not decrease along the order: rows are numbered within their bucket and shifted by the count
    of earlier buckets, a table of one row per bucket.
    """
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return rows.join(before, "_b").withColumn("idx", F.col("_r") + F.col("_off") - 1).drop("_b", "_r", "_off")


def expanding_folds(df: DataFrame, n_folds: int = 5, start: float = 0.4) -> DataFrame:
    """(entity, t0, fold, part): test rows lie between edges of the row index, train rows strictly before the
    first test t0; rows tied with it are in neither."""
    idx = row_index(df.select("entity", "t0"), "t0", "entity", bucket=F.floor(F.col("t0") / (30 * DAY)))
    n = idx.agg(F.count("*").alias("n"))
    step = (1 - start) / n_folds
    edges = n.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("fold"), F.floor(F.round(F.lit(start + step * k), 9) * F.col("n")).alias("lo"), F.floor(F.round(F.lit(start + step * (k + 1)), 9) * F.col("n")).alias("hi")) for k in range(n_folds)])).alias("e")).select("e.*")
    firsts = idx.join(F.broadcast(edges), F.col("idx") == F.col("lo")).select("fold", "lo", "hi", F.col("t0").alias("cut"))  # one row per fold
    rows = idx.join(F.broadcast(firsts), (F.col("idx") < F.col("hi")) & ((F.col("idx") >= F.col("lo")) | (F.col("t0") < F.col("cut"))))
    return rows.select("entity", "t0", "fold", F.when(F.col("idx") >= F.col("lo"), "test").otherwise("train").alias("part"))


def single_cut(df: DataFrame, label: str, share: float = 0.7, back: int = 40) -> DataFrame:
    """(entity, t0, fold, part) of one fold: the rows before a cut of the time order train, the others test.

    The cut is the largest one at or before `share` of the rows that leaves both classes on both sides, looked for
    `back` rows back and not below the middle; without one it is at `share`. Both sides hold both classes just when the
    cut lies after the first row and not after the last row of each class, so four positions tell it, and no rows are tried.
    Rows without a label belong to no class but count in the order.
    """
    idx = row_index(df.select("entity", "t0", label), "t0", "entity", bucket=F.floor(F.col("t0") / (30 * DAY)))
    one = lambda agg, y: agg(F.when(F.col(label) == y, F.col("idx")))
    ends = idx.agg(F.count("*").alias("n"), one(F.min, 1).alias("p"), one(F.min, 0).alias("m"), one(F.max, 1).alias("pl"), one(F.max, 0).alias("ml"))
    at = F.floor(F.col("n") * share)
    best = F.least(at, "pl", "ml")  # null classes: least and greatest skip nulls, so they are told apart below
    fits = F.col("p").isNotNull() & F.col("m").isNotNull() & (best > F.greatest("p", "m")) & (best > F.greatest(at - back, F.floor(F.col("n") / 2)))
    cut = ends.select(F.when(fits, best).otherwise(at).alias("_cut"))  # one row
    return idx.crossJoin(F.broadcast(cut)).select("entity", "t0", F.lit(1).alias("fold"), F.when(F.col("idx") < F.col("_cut"), "train").otherwise("test").alias("part"))


def folds_or_cut(df: DataFrame, label: str, n_folds: int = 5, start: float = 0.4, least_rows: int = 80) -> DataFrame:
    """Expanding folds where the rows are enough for them: at least least_rows, and each fold with both parts and, in its
    train part, both classes. Else the single cut. The decision reads counts of folds, a row for each."""
    folds = expanding_folds(df, n_folds, start)
    n = df.count()
    if n >= least_rows:
        told = folds.join(df.select("entity", F.col(label).alias("_y")), "entity").groupBy("fold").agg(F.countDistinct("part").alias("parts"), F.countDistinct(F.when(F.col("part") == "train", F.col("_y"))).alias("classes")).collect()
        if len(told) == n_folds and all(r["parts"] == 2 and r["classes"] == 2 for r in told):
            return folds
    return single_cut(df, label)


def embargo_split(df: DataFrame, train_end: int, val_end: int, test_end: int, embargo: int, horizon: int | None = None) -> DataFrame:
    """train: t0 up to train_end whose outcome, t0 + horizon, is known when validation starts; val: after train_end +
    embargo, up to val_end; test: after the last row of val + embargo, up to test_end. The horizon is the embargo
    unless told. Without rows in val there is no split, and no rows."""
    v = F.col("t0")
    is_val = (v > train_end + embargo) & (v <= val_end)
    ends = df.where(is_val).agg(F.min("t0").alias("_lo"), F.max("t0").alias("_hi"))  # one row
    rows = df.crossJoin(F.broadcast(ends))
    train = (v <= train_end) & (v + (embargo if horizon is None else horizon) <= F.col("_lo"))
    test = (v > F.col("_hi") + embargo) & (v <= test_end)
    part = F.when(train, "train").when(is_val, "val").when(test, "test")
    return rows.withColumn("part", part).where("part is not null").drop("_lo", "_hi")


def rank_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    """Exact AUC (ties by average rank), average precision and base rate per group, from the curve of its distinct scores.
    preds: by..., score, y (0 or 1)."""
    m = curve_metrics(preds, by)
    rate = F.col("pos") / (F.col("pos") + F.col("neg"))
    return m.select(*by, "pos", "neg", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"), F.round(rate, 6).alias("base_rate"))


def precision_recall_at_k(preds: DataFrame, by: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Per group: pos, and hits, precision and recall among its best k by score, then time, then key. Only the best max(ks) of a
    group are ranked; the rest is counted."""
    top = rank_topk(preds, by, max(ks)).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("y"))).alias(f"hits_{k}") for k in ks], *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = preds.groupBy(*by).agg(F.sum("y").alias("pos")).join(top, same).drop(*[f"_{c}" for c in by])
    for k in ks:
        out = out.withColumn(f"precision_{k}", F.round(F.col(f"hits_{k}") / F.col(f"n_{k}"), 6)).withColumn(f"recall_{k}", F.round(F.col(f"hits_{k}") / F.col("pos"), 6))
    return out.drop(*[f"n_{k}" for k in ks])


def threshold_sweep(preds: DataFrame, thresholds: list[float]) -> DataFrame:
    """Entries, hits, precision and recall per threshold: rows are counted in one pass for all of them."""
    total = preds.agg(*[F.struct(F.count_if(F.col("score") >= t).alias("n"), F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("y"))), F.lit(0)).alias("h"), F.lit(t).alias("threshold")).alias(f"t{i}") for i, t in enumerate(thresholds)], F.sum("y").alias("pos"))
    rows = total.select("pos", F.explode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("x")).select("pos", "x.*")
    return rows.select("threshold", F.col("n").alias("entries"), F.col("h").alias("hits"), F.when(F.col("n") > 0, F.round(F.col("h") / F.col("n"), 6)).alias("precision"), F.round(F.col("h") / F.col("pos"), 6).alias("recall"))


def rank_topk(preds: DataFrame, by: list[str], k: int, salt: int = 64) -> DataFrame:
    """The best k of each group with their rank, by score, then time, then key.

    A group is first ranked in `salt` parts, of which the best k stay, so that the task that ranks the group gets at most
    salt * k rows of it. Where that is no bound (k above a million) the group is ranked at once.
    """
    order = (F.desc("score"), "t0", "entity")
    if k <= 1_000_000:
        part = Window.partitionBy(*by, "_part").orderBy(*order)
        preds = preds.withColumn("_part", F.pmod(F.xxhash64("entity", "t0"), F.lit(salt))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("_part", "rank")
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def quantile_thresholds(preds: DataFrame, fraction: float) -> DataFrame:
    """(fold, threshold): the score that the best fraction of a fold's train rows reach, exact."""
    q = exact_quantiles(preds.where("part = 'train' and score is not null"), ["fold"], "score", [1 - fraction])
    return q.select("fold", F.round(F.col("q")[0], 9).alias("threshold"))


def strategy_returns(rows: DataFrame, cost: float = 0.015, cap: float = 10.0) -> DataFrame:
    """Returns after cost: take profit at the cap, binary by the hit y, and with twice the cap. Without a multiple
    there is no capped return; without y no binary one."""
    m = F.col("multiple")
    capped = lambda c: F.when(m.isNotNull(), F.least(m, F.lit(c)) - 1 - cost)
    binary = F.when(F.col("y") == 1, cap - 1 - cost).when(F.col("y").isNotNull(), -1 - cost)
    return rows.withColumn("r_cap", capped(cap)).withColumn("r_binary", binary).withColumn("r_wide", capped(2 * cap))


def cum_drawdown(rows: DataFrame, by: list[str], value: str, bucket: int = 30 * DAY) -> DataFrame:
    """Adds cum, the running sum of a value in time order, and fall, its distance below its running peak; null adds nothing.

    Sums and peaks run within buckets of time; each bucket starts from the sum and the peak of those before it, which come
    from a table of a row for each bucket, so no group is sorted in one task. Rows without a time come first.
    """
    order = ("t0", "entity")
    tagged = rows.withColumn("_b", F.coalesce(F.floor(F.col("t0") / bucket), F.lit(-(1 << 40))))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("_in", F.coalesce(F.sum(F.col(value).cast("decimal(18,6)")).over(inside), F.lit(0).cast("decimal(28,6)"))).withColumn("_top", F.max("_in").over(inside))
    ends = tagged.groupBy(*by, "_b").agg(F.coalesce(F.sum(F.col(value).cast("decimal(18,6)")), F.lit(0)).alias("_sum"), F.max("_in").alias("_high"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    ends = ends.withColumn("_peak", F.max(F.col("_off") + F.col("_high")).over(ahead)).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_b").alias("_at"), "_off", "_peak")
    same = F.col("_b") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = tagged.join(ends, same).withColumn("cum", F.col("_in") + F.col("_off"))
    out = out.withColumn("fall", F.col("cum") - F.greatest(F.col("_top") + F.col("_off"), "_peak"))
    return out.drop("_b", "_in", "_top", "_off", "_peak", "_at", *[f"_by_{c}" for c in by])


def strategy_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, hit rate, and of rows with a return: their number, cumulative and mean return, and the deepest fall of the
    cumulative return below its peak."""
    r = F.col("r_cap").cast("decimal(18,6)")
    c = cum_drawdown(rows, by, "r_cap")
    return c.groupBy(*by).agg(F.count("*").alias("n"), F.count("r_cap").alias("n_returns"), F.round(F.avg("y"), 6).alias("hit_rate"), F.round(F.sum(r).cast("double"), 4).alias("cum_r"), F.round((F.sum(r) / F.count("r_cap")).cast("double"), 5).alias("mean_r"), F.round(F.min("fall").cast("double"), 4).alias("drawdown"))


def rolling_capacity(events: DataFrame, cap: int, window: int) -> DataFrame:
    """Top-k per slot: in each fixed slot of time, the best `cap` events by score, then time, then key."""
    slot = F.col("ts") - F.col("ts") % window
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "ts", "event_id")
    return events.withColumn("slot", slot).withColumn("rank", F.row_number().over(w)).withColumn("accepted", F.col("rank") <= cap)


def trailing_capacity(events: DataFrame, cap: int, window: int, top_k: int, every: int) -> DataFrame:
    """Micro-batches of `every` seconds, decided at their end `now`: of each, the best events by score, then time,
    then key are accepted, up to top_k and to cap less what was accepted since now - window, that time included.
    A negative cap is none.

    The counts carry over in a table of one row per batch, cut where no batch lies within the window before.
    """
    batch = Window.partitionBy("now").orderBy(F.desc("score"), "ts", "event_id")
    ranked = events.withColumn("now", -F.floor(-F.col("ts") / every) * every).withColumn("rank", F.row_number().over(batch))
    sizes = ranked.where("now is not null").groupBy("now").agg(F.least(F.count("*"), F.lit(max(0, top_k))).alias("n"))
    time = Window.orderBy("now")
    starts = F.coalesce(F.col("now") - F.lag("now").over(time) > window, F.lit(True)).cast("int")
    runs = sizes.withColumn("_start", starts).withColumn("run", F.sum("_start").over(time)).select("run", "now", "n")

    def carry(run):
        run = run.sort_values("now", ignore_index=True)
        now, taken = run["now"].tolist(), run["n"].tolist()
        first = held = 0
        for i in range(len(now)):
            while now[first] < now[i] - window:
                held -= taken[first]
                first += 1
            if cap >= 0:
                taken[i] = min(taken[i], max(0, cap - held))
            held += taken[i]
        return run[["now"]].assign(room=taken)

    room = runs.groupBy("run").applyInPandas(carry, "now long, room long")
    return ranked.join(room, "now", "left").withColumn("accepted", F.coalesce(F.col("rank") <= F.col("room"), F.lit(False))).drop("room")


def largest_remainder(strata: DataFrame, n: int) -> DataFrame:
    """(stratum, size) -> slots: n slots in proportion to sizes; remainders go to the largest fractions."""
    total = strata.agg(F.sum("size").alias("total"))
    s = strata.crossJoin(F.broadcast(total)).withColumn("base", F.floor(n * F.col("size") / F.col("total"))).withColumn("frac", (n * F.col("size")) % F.col("total"))
    left = F.lit(n) - F.sum("base").over(Window.partitionBy())
    s = s.withColumn("left", left).withColumn("r", F.row_number().over(Window.orderBy(F.desc("frac"), "stratum")))
    return s.select("stratum", "size", (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("slots"))


def interleave(rows: DataFrame, stratum: list[str], order: str) -> DataFrame:
    """Round-robin order over strata: the round within the stratum."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(*stratum).orderBy(order)))


def stratified_sample(rows: DataFrame, stratum: str, n: int, seed: int = 7) -> DataFrame:
    """n rows shared over strata by largest remainders, chosen by hash order, so that runs agree. Rows are numbered in buckets
    of their hash, so no stratum is sorted in one task."""
    slots = largest_remainder(rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size")), n)
    return take(rows, [stratum], slots.select(F.col("stratum").alias(stratum), F.col("slots").alias("_k")), "entity", seed)


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def merge_pack(base: DataFrame, pack: DataFrame, columns: list[str], tolerance: int) -> DataFrame:
    """Left join on entity, one to one: an entity that either side repeats is an error. The pack's columns become null where
    its t0 is off by more than the tolerance."""
    p = unique_by(pack.select("entity", F.col("t0").alias("_t0"), *columns), "entity")
    out = unique_by(base, "entity").join(p, "entity", "left")
    ok = F.abs(F.col("t0") - F.col("_t0")) <= tolerance
    return out.withColumns({c: F.when(ok, F.col(c)) for c in columns}).withColumn("matched", F.coalesce(ok, F.lit(False))).drop("_t0")


def overlay_update(base: DataFrame, overlay: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces columns where the overlay's flag is set; keeps the base value as <column>_base."""
    o = overlay.select("entity", F.col("flag").alias("_f"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(o, "entity", "left")
    take = F.coalesce(F.col("_f"), F.lit(False))
    for c in columns:
        out = out.withColumn(f"{c}_base", F.col(c)).withColumn(c, F.when(take, F.col(f"_{c}")).otherwise(F.col(c))).drop(f"_{c}")
    return out.withColumn("overlaid", take).drop("_f")


def feature_delta(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Long table of (entity, feature, left, right, delta) of two wide tables."""
    long = lambda df, name: df.select("entity", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["entity"], columns, "feature", name)
    return long(a, "left").join(long(b, "right"), ["entity", "feature"]).withColumn("delta", F.round(F.col("right") - F.col("left"), 6))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "null_rate")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, p05, p25, p50, p75, p95, scale) of each column: exact quantiles, and the IQR over 1.35."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v").where("v is not null")
    shares = (5, 25, 50, 75, 95)
    q = exact_quantiles(long, ["feature"], "v", [p / 100 for p in shares]).join(F.broadcast(long.groupBy("feature").agg(F.avg("v").alias("mean"))), "feature")
    scale = ((F.col("q")[3] - F.col("q")[1]) / 1.35).alias("scale")
    return q.select("feature", "n", "mean", *[F.round(F.col("q")[i], 6).alias(f"p{p:02d}") for i, p in enumerate(shares)], scale)


def class_by_week(rows: DataFrame) -> DataFrame:
    """Monday-based week number of the epoch × class counts."""
    week = F.floor((F.col("t0") + 3 * DAY) / (7 * DAY))
    return rows.groupBy(week.alias("week")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y").isNull()).alias("unknown"))


def cohort_funnel(rows: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """One row per step: n_in, n_out, n_dropped, all from one pass."""
    so_far = F.lit(True)
    aggs = []
    for i, (_, keep) in enumerate(steps):
        into, so_far = so_far, so_far & F.coalesce(keep, F.lit(False))
        aggs.append(F.struct(F.lit(i).alias("step"), F.lit(steps[i][0]).alias("name"), F.count_if(into).alias("n_in"), F.count_if(so_far).alias("n_out")).alias(f"s{i}"))
    one = rows.agg(*aggs).select(F.explode(F.array(*[f"s{i}" for i in range(len(steps))])).alias("x")).select("x.*")
    return one.withColumn("n_dropped", F.col("n_in") - F.col("n_out"))


def key_set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of only one of the tables; empty when the sets are equal."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def future_reads(rows: DataFrame, at: str, t0: str = "t0") -> DataFrame:
    """Violations of the point-in-time rule: rows read after t0, or without a time."""
    late = F.col(at).isNull() | (F.col(at) > F.col(t0))
    return rows.where(late).withColumn("rule", F.when(F.col(at).isNull(), "missing_time").otherwise("after_t0"))


def ks_drift(rows: DataFrame, split: Column, value: str) -> DataFrame:
    """Largest distance of the two cumulative distributions of a value, over its distinct values, which are summed in buckets."""
    g = cumulated(rows.groupBy(F.col(value).alias("v")).agg(F.count_if(split).alias("a"), F.count_if(~split).alias("b")), [], "v", ["a", "b"])
    return g.agg(F.round(F.max(F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))), 6).alias("ks"))
