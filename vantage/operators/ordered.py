"""Ranks and cumulative counts over ordered values without a sort of the whole: values are cut into buckets at approximate
quantiles, sums run within a bucket, and each bucket starts from the sums of those before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 7 * 86400


def bucketed(rows: DataFrame, value: str, n: int = 256) -> DataFrame:
    """Adds _b, which does not fall as the value rises; n bounds the buckets and the numbers that the driver gets.

    Buckets hold like numbers of rows but for ties, so the work is even however the values lie. Values must not be null.
    """
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = rows.agg(F.percentile_approx(F.col(value).cast("double"), shares, 4 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({c for c in cuts if abs(c) < float("inf")}), float("inf")]
    if len(splits) < 3:
        return rows.withColumn("_b", F.lit(0))
    tagged = rows.withColumn("_v", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(tagged).drop("_v").withColumn("_b", F.col("_b").cast("int"))


def cumulated(points: DataFrame, by: list[str], value: str, counts: list[str], falling: bool = False, n: int = 256) -> DataFrame:
    """points has one row for each (by, value). Adds cum_<c>, the sum of c over the values up to a row's (from it on, if
    falling), and all_<c>, the group's sum. Rows with a null or NaN value go."""
    rows = bucketed(points.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), value, n)
    sums = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_own_{c}") for c in counts])
    order = F.desc("_b") if falling else F.asc("_b")
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    every = Window.partitionBy(*by)
    before = [F.coalesce(F.sum(f"_own_{c}").over(ahead), F.lit(0)).alias(f"_before_{c}") for c in counts]
    start = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_b").alias("_at"), *before, *[F.sum(f"_own_{c}").over(every).alias(f"all_{c}") for c in counts])
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(value) if falling else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_b") == F.col("_at")
    for c in by:  # a null group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in counts}).join(start, same)
    out = out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in counts})
    return out.drop("_b", "_at", *[f"_by_{c}" for c in by], *[f"_before_{c}" for c in counts])


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column for each place): the values at 0-based places in rising order, each place told from the group's n.

    Equal values are one row of the counts, and groups are summed in buckets: no group is held in one buffer. Null and
    NaN values have no place; a group without others gives no row.
    """
    c = cumulated(rows.groupBy(*by, value).agg(F.count("*").alias("_k")), by, value, ["_k"])
    at = lambda place: F.max(F.when((F.col("cum__k") > place) & (F.col("cum__k") - F.col("_k") <= place), F.col(value)))
    out = c.groupBy(*by).agg(F.max("all__k").alias("n"), *[at(f(F.col("all__k"))).alias(name) for name, f in places.items()])
    return out.where("n is not null")


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q): the exact quantiles of a value in the order of shares, between two values in proportion. Bounded memory, as
    in at_places."""
    places: dict[str, Callable[[Column], Column]] = {}
    for i, p in enumerate(shares):
        places[f"_lo{i}"] = lambda n, p=p: F.floor((n - 1) * p)
        places[f"_hi{i}"] = lambda n, p=p: F.ceil((n - 1) * p)
    out = at_places(rows, by, value, places)

    def between(i: int, p: float) -> Column:
        lo, hi, place = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double"), (F.col("n") - 1) * p
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place)))

    return out.select(*by, "n", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the rank of each value from the least on, equal values sharing the mean of their places."""
    points = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    return cumulated(points, [], value, ["k"]).select(value, (F.col("cum_k") - (F.col("k") - 1) / 2).alias(out), F.col("all_k").alias("_n"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, spearman): the correlation of tie-averaged ranks over rows in which both values are known; null where
    one of them is constant or no row is left.

    Rows are first reduced to distinct pairs, so a pair that holds much of the table is one row of the joins.
    """
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    pairs = known.groupBy(F.col(a).alias("_x"), F.col(b).alias("_y")).agg(F.count("*").alias("_k"))
    ranked = pairs.join(average_ranks(known.select(F.col(a).alias("_x")), "_x", "_rx"), "_x").drop("_n").join(average_ranks(known.select(F.col(b).alias("_y")), "_y", "_ry"), "_y")
    x, y, k = F.col("_rx") - (F.col("_n") + 1) / 2, F.col("_ry") - (F.col("_n") + 1) / 2, F.col("_k")  # the mean rank is known
    one = ranked.agg(F.coalesce(F.sum(k), F.lit(0)).alias("n"), F.sum(k * x * y).alias("_xy"), F.sum(k * x * x).alias("_xx"), F.sum(k * y * y).alias("_yy"))
    return one.select("n", F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("spearman"))


def weekly_ks(rows: DataFrame, reference: Column, value: str, at: str = "ts") -> DataFrame:
    """(week, n, ks): the largest distance between a week's distribution of a value and that of the reference rows.

    Weeks start on Mondays of the epoch and hold the rows outside the reference. The distance is largest at or just before a
    value of the week, so the reference is looked up there and not multiplied by the weeks. Null values count nowhere.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.floor((F.col(at) + 3 * 86400) / WEEK).alias("week"), F.coalesce(reference, F.lit(False)).alias("_r"))
    base = cumulated(known.groupBy("v").agg(F.count_if("_r").alias("r")), [], "v", ["r"]).select("v", "r", "cum_r", "all_r")
    own = cumulated(known.where("not _r").groupBy("week", "v").agg(F.count("*").alias("k")), ["week"], "v", ["k"])
    both = own.join(base, "v")
    up = F.col("cum_k") / F.col("all_k") - F.col("cum_r") / F.col("all_r")
    down = (F.col("cum_r") - F.col("r")) / F.col("all_r") - (F.col("cum_k") - F.col("k")) / F.col("all_k")
    return both.groupBy("week").agg(F.max("all_k").alias("n"), F.max(F.greatest(up, down)).alias("ks"))


def score_curve(preds: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, p, q, tp, fp, pos, neg): what is accepted from each score on, one row for each distinct score."""
    points = preds.where(F.col("y").isNotNull()).groupBy(*by, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("q"))
    out = cumulated(points, by, "score", ["p", "q"], falling=True)
    return out.withColumnsRenamed({"cum_p": "tp", "cum_q": "fp", "all_p": "pos", "all_q": "neg"})


def _hits(k: Column) -> Column:
    """Positives among the k best rows of a group of score_curve: rows of the score that k falls in share its positives."""
    size = F.col("p") + F.col("q")
    inside = (k - (F.col("tp") + F.col("fp") - size)) / size
    return F.sum(F.col("p") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)))


def curve_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    """Per group, from one cumulative curve of its scores: pos, neg, auc, ap, best_f1 with its threshold (the smaller, if
    equal), precision and recall there, and k_natural, as many rows as are positive, with precision and recall of the k best.

    Rows without a label or score count nowhere. With one class only there is no auc, and without positives no ap and no
    recall. Scores lie in buckets, so no group is sorted in one task, and equal scores are one row of the curve.
    """
    c = score_curve(preds, by)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("pos"), F.lit(0))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"), precision.alias("precision"), recall.alias("recall")))
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0))
    k = F.greatest(F.lit(1), F.col("pos"))
    out = c.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), area.alias("auc"), (F.sum(F.col("p") * precision) / F.nullif(F.max("pos"), F.lit(0))).alias("ap"), best.alias("_f"), F.max(k).alias("k_natural"), _hits(k).alias("_h"))
    told = [F.col("_f.f1").alias("best_f1"), (-F.col("_f.s")).alias("threshold"), F.col("_f.precision").alias("best_precision"), F.col("_f.recall").alias("best_recall")]
    return out.select(*by, "pos", "neg", "auc", "ap", *told, "k_natural", (F.col("_h") / F.col("k_natural")).alias("precision_natural"), (F.col("_h") / F.nullif(F.col("pos"), F.lit(0))).alias("recall_natural"))


def rank_bands(preds: DataFrame, by: list[str], fractions: list[float], tops: list[int] = ()) -> DataFrame:
    """(by, band, k, hits, precision, recall, f1, lift) of the best fraction of a group, at least one row, and of its best k
    where it has so many. lift is precision over the group's rate; hits are shared evenly within a score."""
    c = score_curve(preds, by)
    n = F.col("pos") + F.col("neg")
    ks = [(f"top_{f:.1%}", F.greatest(F.lit(1), F.bround(F.lit(float(f)) * n)).cast("long")) for f in fractions] + [(f"top_{k}", F.lit(k).cast("long")) for k in tops]
    one = c.groupBy(*by).agg(F.max("pos").alias("pos"), F.max(n).alias("n"), *[F.struct(F.lit(name).alias("band"), F.max(k).alias("k"), _hits(k).alias("hits")).alias(f"_{i}") for i, (name, k) in enumerate(ks)])
    rows = one.select(*by, "pos", "n", F.explode(F.array(*[f"_{i}" for i in range(len(ks))])).alias("x")).select(*by, "pos", "n", "x.*").where("k <= n")
    precision, recall = F.col("hits") / F.col("k"), F.col("hits") / F.nullif(F.col("pos"), F.lit(0))
    return rows.select(*by, "band", "k", "hits", precision.alias("precision"), recall.alias("recall"), (2 * F.col("hits") / (F.col("k") + F.col("pos"))).alias("f1"), (precision * F.col("n") / F.nullif(F.col("pos"), F.lit(0))).alias("lift"))
