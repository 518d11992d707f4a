"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_words_of

#: Relative weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> adds weight and target.

    Sources in code-point order, null last, weigh weights in turn and share the sum of all sizes; a target
    stops at most times its source's size and the excess is shared again by weight. The shares that end
    this are min(most * size, level * weight) for one level, found by sorting the sources by the level at
    which each stops. The table has one row per source, so its running sums are over sources, not rows.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    rows = sizes.withColumn("weight", w).withColumn("_stop", most * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("_stop", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)))
    rows = rows.withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) - F.col("_full")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", F.col("source").isNull(), "source", "_level"))).over(everything)["_level"]  # of the first that does not stop
    rows = rows.withColumn("target", F.least(most * F.col("source_size"), level * F.col("weight")).cast("double"))
    return rows.select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))


def _uniform(*cols: Column) -> Column:
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def pivotal_round(units: DataFrame, fan_in: int = 64, seed: int = 17) -> DataFrame:
    """(grp, id, size, part in (0, 1)) with unique (grp, id) -> (grp, id, up 0 or 1).

    Pairs of fractional units trade size-weighted mass until one is integral: the sum of size * part of a
    group is kept and each unit's expectation is its part. Units meet in blocks of about fan_in; each block
    hands on one residual, residuals meet in blocks again, and so on: a reduction tree of log(n) / log(fan_in)
    levels whose blocks never grow. The last residual of a group is rounded at random by its own part.
    """
    state = "struct<id:bigint,size:double,mass:double>"
    left = materialize(units.select(F.col("grp"), F.col("id").cast("long").alias("id"), F.col("size").cast("double").alias("size"), (F.col("size") * F.col("part")).cast("double").alias("mass")), "mix")
    done = None
    level = 0
    while True:
        counts = left.groupBy("grp").agg(F.count("*").alias("_n"))
        widest = counts.agg(F.max("_n")).first()[0] or 0
        blocks = F.greatest(F.ceil(F.col("_n") / fan_in), F.lit(1))
        dealt = left.join(counts, "grp").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id"), blocks))
        groups = dealt.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(-seed - level), "id").alias("o"), "id", "size", "mass"))).alias("xs"))

        def meet(a: Column, x: Column) -> Column:
            i, u = a["r"], _uniform(F.lit(seed), F.lit(level), a["r"]["id"], x["id"])  # noqa: B023  called at once
            t1 = F.least(i["size"] - i["mass"], x["mass"])  # to i
            t2 = F.least(i["mass"], x["size"] - x["mass"])  # to x
            to_i = u * (t1 + t2) < t2
            room, need = i["size"] - i["mass"] <= x["mass"], x["size"] - x["mass"] <= i["mass"]
            unit = lambda v, mass: F.struct(v["id"].alias("id"), v["size"].alias("size"), mass.cast("double").alias("mass"))
            full_i, none_x = (unit(i, i["size"]), unit(x, x["mass"] - t1)), (unit(x, F.lit(0.0)), unit(i, i["mass"] + t1))
            full_x, none_i = (unit(x, x["size"]), unit(i, i["mass"] - t2)), (unit(i, F.lit(0.0)), unit(x, x["mass"] + t2))
            pick = lambda k: F.when(to_i, F.when(room, full_i[k]).otherwise(none_x[k])).otherwise(F.when(need, full_x[k]).otherwise(none_i[k]))
            first = i.isNull()
            return F.struct(F.when(first, unit(x, x["mass"])).otherwise(pick(1)).alias("r"), F.when(first, a["out"]).otherwise(F.concat(a["out"], F.array(pick(0)))).alias("out"))

        zero = F.struct(F.expr(f"cast(null as {state})").alias("r"), F.expr(f"cast(array() as array<{state}>)").alias("out"))
        met = materialize(groups.select("grp", F.aggregate("xs", zero, meet).alias("a")), "mix")
        out = met.select("grp", F.explode("a.out").alias("x")).select("grp", F.col("x.id").alias("id"), (F.col("x.mass") > 0).cast("int").alias("up"))
        rest = met.select("grp", "a.r.*")
        level += 1
        if widest <= fan_in:
            share = F.when(F.col("size") > 0, F.col("mass") / F.col("size")).otherwise(0.0)
            last = rest.select("grp", "id", (_uniform(F.lit(seed), F.lit(-1), "id") < share).cast("int").alias("up"))
            return (done.unionByName(out) if done is not None else out).unionByName(last)
        done = done.unionByName(out) if done is not None else out
        left = rest


def mix_to_targets(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: float = 3.0, fan_in: int = 64, seed: int = 17) -> DataFrame:
    """One row per input row: key, source, size, source_size, target, copies, taken = copies * size.

    A source's documents are each taken target / source_size times on average: the whole part always, the
    fraction by pivotal_round, so a source's taken words differ from its target by less than one document.
    No document is taken more than ceil(most) times. Null text has size 0 and takes nothing; a null source is
    a source of its own. Of rows that repeat key, source and size, as many take one more as their fractions add
    up to, and one row is rounded, so they too cost less than one document. Reruns agree. An empty table gives no rows;
    other columns are not read, whatever their names, and a text of any length is only counted.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"))
    units = materialize(rows.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "units")
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most)
    targets = materialize(targets, "targets").withColumnRenamed("source", "_source")
    units = units.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.when(F.col("size") > 0, F.floor(rate + 1e-12)).otherwise(0).cast("long")).withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    # of equal rows, so many take one more for sure as their parts add up to; one row takes what is left at random
    extra = F.when(F.col("size") > 0, F.col("part") * F.col("rows")).otherwise(0.0)
    units = units.withColumn("sure", F.least(F.floor(extra + 1e-9), F.col("rows"))).withColumn("rest", F.greatest(extra - F.col("sure"), F.lit(0.0)))
    units = units.withColumn("uid", F.xxhash64("id", "source", "size"))
    loose = units.where(F.col("rest") > 1e-12)
    rounded = pivotal_round(loose.select(F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")).alias("grp"), F.col("uid").alias("id"), "size", F.col("rest").alias("part")), fan_in, seed)
    rounded = rounded.groupBy(F.col("id").alias("_uid")).agg(F.max("up").alias("up"))
    out = units.join(rounded, F.col("uid") == F.col("_uid"), "left").withColumn("more", F.col("sure") + F.coalesce("up", F.lit(0)))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).withColumn("copies", F.col("whole") + (F.col("_row") <= F.col("more")).cast("long"))
    return out.select(F.col("id").alias(key), "source", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
