"""Outcomes strictly after t0, creator priors and history joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def forward_labels(captures: DataFrame, prices: DataFrame, horizons: dict[str, int], multiple: float = 10.0) -> DataFrame:
    """Per horizon H: highest price in (t0, t0 + H] over p0, whether it reaches `multiple`, seconds to the first
    such price; null without prices in the window. prices: entity, ts, price."""
    after = captures.select("entity", "t0", "p0").join(prices.select("entity", "ts", "price"), "entity").where((F.col("ts") > F.col("t0")) & (F.col("ts") <= F.col("t0") + max(horizons.values())))
    aggs = []
    for name, h in horizons.items():
        inside = F.col("ts") <= F.col("t0") + h
        aggs += [F.max(F.when(inside, F.col("price"))).alias(f"max_{name}"), F.min(F.when(inside & (F.col("price") >= multiple * F.col("p0")), F.col("ts") - F.col("t0"))).alias(f"time_{name}")]
    got = after.groupBy("entity").agg(*aggs)
    out = captures.select("entity", "t0", "p0").join(got, "entity", "left")
    for name in horizons:
        out = out.withColumn(f"multiple_{name}", F.round(F.col(f"max_{name}") / F.col("p0"), 6)).withColumn(f"hit_{name}", F.when(F.col(f"max_{name}").isNotNull(), F.col(f"time_{name}").isNotNull())).drop(f"max_{name}")
    return out


def label_violations(captures: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices that no label may use, with the rule: at or before t0, without a time, or not positive (null included)."""
    rows = prices.select("entity", "ts", "price").join(captures.select("entity", "t0"), "entity")
    rule = F.when(F.col("ts").isNull(), "missing_time").when(F.col("ts") <= F.col("t0"), "not_after_t0").when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price")
    return rows.withColumn("rule", rule).where("rule is not null")


def peak_hit(captures: DataFrame, prices: DataFrame, multiple: float = 10.0) -> DataFrame:
    """(entity, hit): the highest price after t0 reaches `multiple` times a positive p0; no price after t0 is no hit."""
    top = prices.join(captures.select("entity", "t0"), "entity").where("ts > t0").groupBy("entity").agg(F.max("price").alias("top"))
    out = captures.select("entity", "p0").join(top, "entity", "left")
    return out.select("entity", F.coalesce((F.col("p0") > 0) & (F.col("top") >= multiple * F.col("p0")), F.lit(False)).alias("hit"))


def base_rates(labels: DataFrame, horizons: list[str]) -> DataFrame:
    """Mean of hits over rows that have a label, per horizon."""
    stacked = labels.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"hit_{h}").alias("hit")) for h in horizons])).alias("x")).select("x.*")
    return stacked.groupBy("horizon").agg(F.count("hit").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def followup_peak(captures: DataFrame, prices: DataFrame, multiple: float = 10.0) -> DataFrame:
    """Running maximum after t0: each price that raises it, with the multiple so far."""
    after = prices.join(captures.select("entity", "t0", "p0"), "entity").where("ts > t0")
    w = Window.partitionBy("entity").orderBy("ts", "id")
    rows = after.withColumn("before", F.max("price").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where(F.col("before").isNull() | (F.col("price") > F.col("before"))).select("entity", "ts", F.round(F.col("price") / F.col("p0"), 6).alias("multiple"), (F.col("price") >= multiple * F.col("p0")).alias("hit"))


def creator_priors(creates: DataFrame, strict: bool = False) -> DataFrame:
    """Earlier creates of the same creator: all, within 7 and 30 days. Ties count by entity order, or not at all
    when strict. One window over the creator; no self-join."""
    w = Window.partitionBy("creator").orderBy("created", "entity")
    span = lambda d: Window.partitionBy("creator").orderBy("created").rangeBetween(-d * DAY, 0)
    peers = F.count("*").over(Window.partitionBy("creator", "created"))
    place = F.row_number().over(Window.partitionBy("creator", "created").orderBy("entity"))
    less = peers if strict else peers - place + 1  # of those counted up to this moment, the ones not before it
    upto = F.count("*").over(Window.partitionBy("creator").orderBy("created").rangeBetween(Window.unboundedPreceding, 0))
    known = F.col("creator").isNotNull()
    out = creates.select("entity", "creator", "created", (upto - less).alias("all"), *[(F.count("*").over(span(d)) - less).alias(f"d{d}") for d in (7, 30)])
    return out.select("entity", "created", *[F.when(known, F.col(c)).otherwise(F.lit(0)).cast("long").alias(f"prior_{c}") for c in ("d7", "d30", "all")])


def create_join(captures: DataFrame, creates: DataFrame) -> DataFrame:
    """captures with their first create at or before t0: age and name length; no such create leaves nulls and 0."""
    first = creates.groupBy("entity").agg(F.min(F.struct("created", "creator", "name")).alias("c")).select("entity", "c.*")
    out = captures.join(first.withColumnRenamed("entity", "_e"), (F.col("entity") == F.col("_e")) & (F.col("created") <= F.col("t0")), "left").drop("_e")
    return out.select("entity", "t0", "creator", (F.col("t0") - F.col("created")).alias("age"), F.coalesce(F.length("name"), F.lit(0)).cast("long").alias("name_len"))


def create_age(captures: DataFrame, creates: DataFrame, most: int) -> DataFrame:
    """Age at t0 with ok and reason: missing, create_after_t0, age_gt_max."""
    out = captures.join(creates.groupBy("entity").agg(F.min("created").alias("created")), "entity", "left").withColumn("age", F.col("t0") - F.col("created"))
    reason = F.when(F.col("created").isNull(), "missing").when(F.col("age") < 0, "create_after_t0").when(F.col("age") > most, "age_gt_max").otherwise("")
    return out.select("entity", "age", reason.alias("reason"), (reason == "").alias("ok"))


def creator_graduates(captures: DataFrame, creates: DataFrame, graduations: DataFrame) -> DataFrame:
    """Other entities of the same creator, created before t0, that graduated in [create, t0]: within 7, 30, all days.

    Captures and graduations of a creator stand on one time line and are counted by range windows, so no
    pairs are made; an entity's own graduation is taken off again, and so are those created at t0 itself.
    """
    own = captures.join(creates, "entity").select("entity", "t0", "creator", "created")
    grads = creates.join(graduations, "entity").where("graduated >= created").select("entity", "creator", "created", "graduated")
    mine = own.join(grads.select("entity", "graduated"), "entity", "left").select("creator", F.col("t0").alias("at"), "entity", "t0", "created", "graduated", F.lit(0).alias("n"), F.lit(0).alias("late"))
    others = grads.select("creator", F.col("graduated").alias("at"), F.lit(1).alias("n"), (F.col("created") == F.col("graduated")).cast("int").alias("late"))
    line = mine.unionByName(others, allowMissingColumns=True)
    w = Window.partitionBy("creator").orderBy("at")
    ranges = {"d7": (8 * DAY - 1, w.rangeBetween(-(8 * DAY - 1), 0)), "d30": (31 * DAY - 1, w.rangeBetween(-(31 * DAY - 1), 0)), "all": (None, w.rangeBetween(Window.unboundedPreceding, 0))}
    counts = []
    for name, (reach, r) in ranges.items():
        inside = (F.col("graduated") <= F.col("t0")) & ((F.col("created") < F.col("t0"))) & (F.lit(True) if reach is None else F.col("t0") - F.col("graduated") <= reach)
        counts.append((F.sum("n").over(r) - F.sum("late").over(w.rangeBetween(0, 0)) - F.coalesce(inside, F.lit(False)).cast("int")).alias(f"graduates_{name}"))
    return line.select("entity", *counts).where("entity is not null")


def buyer_history(pit: DataFrame, trades: DataFrame, back: int) -> DataFrame:
    """Distinct buyers of a capture, and how many bought other entities in [t0 - back, t0).

    Buys and captures of a trader stand on one time line and are counted by range windows; buys of the
    captured entity itself are counted the same way and taken off.
    """
    buyers = pit.where("side = 'buy'").select("entity", "t0", "trader").distinct().withColumn("at", F.col("t0")).withColumn("n", F.lit(0))
    buys = trades.where("side = 'buy'").select("entity", "trader", F.col("ts").alias("at"), F.lit(1).alias("n"))
    line = buyers.unionByName(buys, allowMissingColumns=True)
    count = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("at").rangeBetween(-back, -1)), F.lit(0))
    got = line.withColumn("any", count("trader")).withColumn("same", count("trader", "entity")).where("t0 is not null").withColumn("n", F.col("any") - F.col("same"))
    return got.groupBy("entity").agg(F.count("*").alias("buyers"), F.count_if(F.col("n") > 0).alias("with_history"), F.sum("n").alias("history"))
