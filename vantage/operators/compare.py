"""Row gates, comparisons of tables and scores, and summaries of strategies."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import at_places, exact_quantiles


def clip(value: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def reserve_price(rows: DataFrame, supply: float = 1e9) -> DataFrame:
    """vs, vt, rt, rt0 -> adds price, mc and curve progress; null where a reserve is not positive."""
    price = F.when((F.col("vs") > 0) & (F.col("vt") > 0), F.col("vs") / F.col("vt"))
    progress = F.when((F.col("rt0") > 0) & (F.col("rt") >= 0), 1 - F.col("rt") / F.col("rt0"))
    return rows.withColumns({"price": price, "mc": price * supply, "progress": progress})


def in_ranges(ranges: Mapping[str, tuple[float, float]], null_passes: bool) -> Column:
    """All columns lie in their inclusive ranges; a null passes or fails."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(lo, hi), F.lit(null_passes)) for c, (lo, hi) in ranges.items()])


def complete(columns: list[str], allowed: list[str], excused: Column) -> Column:
    """No column is null, but for the allowed ones of excused rows."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() | (excused if c in allowed else F.lit(False)) for c in columns])


def robust_distance(rows: DataFrame, columns: list[str], missing: float = 3.0) -> DataFrame:
    """Adds distance: mean of |x - median| / (IQR / 1.35) over columns; null values and constant columns count as missing.

    The statistics are exact and one row, joined to all rows.
    """
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v").where("v is not null")
    told = exact_quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75])
    stats = told.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_q{i}") for i, c in enumerate(columns)])
    out, terms = rows.crossJoin(F.broadcast(stats)), []
    for i, c in enumerate(columns):
        q = F.col(f"_q{i}")
        scale = (q[2] - q[0]) / 1.35
        terms.append(F.when(scale > 0, F.coalesce(F.abs(F.col(c) - q[1]) / scale, F.lit(missing))).otherwise(F.lit(missing)))
    return out.withColumn("distance", reduce(lambda a, b: a + b, terms) / len(columns)).drop(*[f"_q{i}" for i in range(len(columns))])


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """The rows as they are; reading them is an error where a key repeats. Null is no key and may repeat. The check stands in the plan, on
    the partitioning that a join on the key needs anyway."""
    n = F.count("*").over(Window.partitionBy(key))
    told = F.when((F.col("_same") > 1) & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return rows.withColumn("_same", n).where(told.cast("boolean")).drop("_same")


def overlay_changes(live: DataFrame, store: DataFrame, key: str, columns: list[str], live_count: str, store_count: str, atol: float = 1e-9) -> DataFrame:
    """Adds to live: in_store; exact, whether its count equals the store's, so that both saw the same trades; and changes,
    an array of (col, base, store, delta) of the columns whose values differ by more than atol.

    A value against null differs, two nulls do not; NaN counts as null. A key that the store repeats is an error. One join
    serves the wide table, the long one and the notes.
    """
    side = unique_by(store.select(key, F.col(store_count).cast("double").alias("_count"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_in")), key)
    out = live.join(side, key, "left")
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    differs = lambda c: F.coalesce(F.abs(value(c) - F.col(f"_s_{c}")) > atol, value(c).isNull() != F.col(f"_s_{c}").isNull())
    one = [F.when(F.col("_in") & differs(c), F.struct(F.lit(c).alias("col"), value(c).alias("base"), F.col(f"_s_{c}").alias("store"), (value(c) - F.col(f"_s_{c}")).alias("delta"))) for c in columns]
    exact = F.coalesce(F.floor(F.col(live_count)) == F.floor(F.col("_count")), F.lit(False))
    return out.withColumns({"in_store": F.coalesce("_in", F.lit(False)), "exact": exact, "changes": F.array_compact(F.array(*one))}).drop("_count", "_in", *[f"_s_{c}" for c in columns])


def overlay_wide(changed: DataFrame, columns: list[str]) -> DataFrame:
    """Of overlay_changes: the store's values where the trades are exact and the values differ, with the former value in
    <column>_base, which is null elsewhere."""
    of = lambda c: F.get(F.filter("changes", lambda x: x["col"] == c), F.lit(0))
    hit = {c: F.when(F.col("exact"), of(c)) for c in columns}
    new = {c: F.when(h.isNotNull(), h["store"]).otherwise(F.col(c).cast("double")) for c, h in hit.items()}
    return changed.withColumns(new | {f"{c}_base": h["base"] for c, h in hit.items()}).drop("changes", "in_store", "exact")


def overlay_long(changed: DataFrame, key: str) -> DataFrame:
    """(key, col, base, store, delta): a row for each value that overlay_wide replaces."""
    return changed.where("exact").select(key, F.inline("changes"))


def overlay_notes(changed: DataFrame, key: str) -> DataFrame:
    """(key, note, n_diff, n_overlaid, largest, top): what came of each row, its largest difference and that column's name."""
    big = F.array_max(F.transform(F.filter("changes", lambda x: x["delta"].isNotNull()), lambda x: F.struct(F.abs(x["delta"]).alias("d"), x["col"].alias("col"))))
    note = F.when(~F.col("in_store"), "missing_in_store").when(F.col("exact"), "overlaid").otherwise("trades_not_exact")
    n = F.size("changes").cast("long")
    return changed.select(key, note.alias("note"), n.alias("n_diff"), F.when(F.col("exact"), n).otherwise(0).alias("n_overlaid"), big["d"].alias("largest"), big["col"].alias("top"))


def merge_fill(base: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join; rows without a match, and nulls, have 0."""
    out = base.join(side.select(key, *columns), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def attach_label(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Inner join with only the label; a label column in rows is an error."""
    if label in rows.columns:
        raise ValueError(f"{label} is already a column")
    return rows.join(labels.select(key, label), key)


def reconcile(stored: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """(key, stored, fresh, delta) of all stored rows."""
    out = stored.select(key, F.col(value).alias("stored")).join(fresh.select(key, F.col(value).alias("fresh")), key, "left")
    return out.withColumn("delta", F.abs(F.col("stored") - F.col("fresh")))


def delta_summary(deltas: DataFrame, small: float = 1e-6, large: float = 1e-4) -> DataFrame:
    """One row: n, n_both (with a delta), the largest, exact median and 95th percentile, and how many are above small and large."""
    one = deltas.agg(F.count("*").alias("n"), F.count("delta").alias("n_both"), F.max("delta").alias("largest"), F.count_if(F.col("delta") > small).alias("above_small"), F.count_if(F.col("delta") > large).alias("above_large"))
    q = exact_quantiles(deltas.where("delta is not null"), [], "delta", [0.5, 0.95]).select("q")
    q = q.agg(F.max("q").alias("q"))  # a row also without deltas
    return one.crossJoin(F.broadcast(q)).select("n", "n_both", "largest", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "above_small", "above_large")


def compare_distributions(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, side, n, mean, median, null_rate) of the columns of two tables; the median is exact."""

    def side(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
        q = exact_quantiles(long.where("v is not null"), ["feature"], "v", [0.5]).select("feature", F.col("q")[0].alias("median"))
        one = long.groupBy("feature").agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v").isNull().cast("int")).alias("null_rate"))
        return one.join(F.broadcast(q), "feature", "left").select("feature", "side", "n", "mean", "median", "null_rate")  # a row per feature

    return side(a, "left").unionByName(side(b, "right"))


def score_gate(preds: DataFrame, threshold: float) -> DataFrame:
    """n, n_pass, pass_rate, the largest score and the upper median."""
    passes = F.count_if(F.col("score") >= threshold)
    one = preds.agg(F.count("*").alias("n"), passes.alias("n_pass"), (passes / F.nullif(F.count("*"), F.lit(0))).alias("pass_rate"), F.max("score").alias("largest"))
    middle = at_places(preds, [], "score", {"upper_median": lambda n: F.floor(n / 2)}).agg(F.max("upper_median").alias("upper_median"))
    return one.crossJoin(F.broadcast(middle))  # one row each


def replay_scan(priced: DataFrame, band: Column, hit: Column) -> DataFrame:
    """Per entity: price range, first time in the band, first hit, events, venues and days seen."""
    return priced.groupBy("entity").agg(
        F.min("price").alias("least"), F.max("price").alias("most"), F.min(F.when(band, F.col("ts"))).alias("first_band"), F.min(F.when(hit, F.col("ts"))).alias("first_hit"),
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("venue")), ",").alias("venues"), F.min("ts").alias("seen_from"), F.max("ts").alias("seen_to"),
    )


def cost_sensitivity(rows: DataFrame, costs: list[float], cap: float = 10.0) -> DataFrame:
    """n and mean return per cost over rows with a multiple: one pass, as costs only shift the capped multiples."""
    gross = F.when(F.col("multiple").isNotNull(), F.least(F.col("multiple"), F.lit(cap)) - 1)
    one = rows.agg(F.count("multiple").alias("n"), F.avg(gross).alias("gross"))
    return one.select("n", "gross", F.explode(F.array(*[F.lit(c) for c in costs])).alias("cost")).select("cost", "n", (F.col("gross") - F.col("cost")).alias("mean_r"))


def accept_overlap(preds: DataFrame, a: Column, b: Column) -> DataFrame:
    """(part, n, precision): rows accepted by both gates, by one only, or by none."""
    part = F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("none")
    return preds.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("y").alias("precision"))


def union_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Union by name with missing columns as null; of equal keys, the row of the earliest table stays."""
    tagged = [t.withColumn("_at", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    names = [c for c in rows.columns if c not in (key, "_at")]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), "_at").alias("_row"))
    return best.select(key, "_row.*")


def union_samples(samples: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of the samples, with the name of the sample; a row that stands in several is kept in each."""
    return reduce(lambda x, y: x.unionByName(y), [df.withColumn("sample", F.lit(name)) for name, df in samples.items()])
