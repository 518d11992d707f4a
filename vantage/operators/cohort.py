"""Cohorts with follow-up and consistency flags, and full reports of strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import DAY, cum_drawdown
from .ordered import exact_quantiles


def cohort_flags(rows: DataFrame, end: int, ready_days: float, hit: str, top: str, threshold: float) -> DataFrame:
    """Adds followup_days, the days from t0 to `end`; primary_ready, whether they reach ready_days, so that the outcome is not
    cut off; and inconsistent, whether a told hit contradicts the highest value, which is never changed. A null t0 is not
    ready, and without a hit or a highest value nothing is contradicted."""
    days = (F.lit(end) - F.col("t0")) / DAY
    reached = F.col(top) >= threshold
    said = F.col(hit).cast("boolean")
    return rows.withColumns({"followup_days": days, "primary_ready": F.coalesce(days >= ready_days, F.lit(False)), "inconsistent": F.coalesce(said != reached, F.lit(False))})


def cohort_counts(flagged: DataFrame, hit: str) -> DataFrame:
    """One row of a flagged cohort: rows, hits and misses, of these the ready ones, and the inconsistent rows."""
    said, ready = F.col(hit).cast("boolean"), F.col("primary_ready")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return flagged.agg(F.count("*").alias("n"), count(said, "n_pos"), count(~said, "n_neg"), count(said & ready, "n_pos_ready"), count(~said & ready, "n_neg_ready"), count(F.col("inconsistent"), "n_inconsistent"))


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join of two tables with a row for each group; a null group is a group."""
    named = right.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    return left.join(named, same, "left").drop(*[f"_by_{c}" for c in by])


def _wide(long: DataFrame, by: list[str], kind: str, kinds: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """One row for each group, with a column <value>_<kind> for each value and kind."""
    return long.groupBy(*by).agg(*[F.max(F.when(F.col(kind) == k, v)).alias(f"{name}_{k}") for name, v in values.items() for k in kinds])


def strategy_report(rows: DataFrame, by: list[str], base: DataFrame, end: int, follow: tuple[int, ...] = (14, 30), multiples: tuple[int, ...] = (10, 20), returns: tuple[str, ...] = ("r_cap", "r_binary", "r_wide")) -> DataFrame:
    """One row for each strategy in `by` of rows (by..., entity, t0, y, multiple, returns...): n, n_hits and hit_rate; of each
    return its sum cum_<r>, its mean mean_<r> and the deepest fall dd_<r> of the running sum in time order below its peak;
    span_days from the first to the last t0 and n_per_day; the exact median of the days from t0 to `end` and the share with
    at least so many of `follow`; mean and median multiple and the share of all rows that reach `multiples`; and lift, the
    hit rate over the mean y of `base`.

    All returns run through one pass, each as a group of its own, and sums and peaks are carried over buckets of time, so no
    strategy is sorted in one task. Rows without a return add nothing to it; one without a multiple reaches none.
    """
    names = list(returns)
    long = rows.select(*by, "t0", "entity", *[F.col(c).cast("double").alias(c) for c in names]).unpivot([*by, "t0", "entity"], names, "_kind", "_r")
    r = F.col("_r").cast("decimal(18,6)")
    falls = cum_drawdown(long, [*by, "_kind"], "_r").groupBy(*by, "_kind").agg(F.coalesce(F.sum(r), F.lit(0)).cast("double").alias("_cum"), F.count("_r").alias("_n"), F.min("fall").cast("double").alias("_dd"))
    falls = _wide(falls, by, "_kind", returns, {"cum": F.col("_cum"), "mean": F.when(F.col("_n") > 0, F.col("_cum") / F.col("_n")), "dd": F.col("_dd")})

    days = (F.lit(end) - F.col("t0")) / DAY
    stats = rows.select(*by, days.alias("followup"), F.col("multiple").cast("double").alias("multiple")).unpivot(by, ["followup", "multiple"], "_what", "value")
    medians = _wide(exact_quantiles(stats.where("value is not null"), [*by, "_what"], "value", [0.5]), by, "_what", ("followup", "multiple"), {"median": F.col("q")[0]})

    n = F.count("*")
    span = F.greatest((F.max("t0") - F.min("t0")) / DAY, F.lit(1e-9))
    one = rows.groupBy(*by).agg(
        n.alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("n_hits"), F.avg("y").alias("hit_rate"), span.alias("span_days"), (n / span).alias("n_per_day"), F.avg("multiple").alias("mean_multiple"),
        *[(F.count_if(days >= k) / n).alias(f"followup_ge_{k}") for k in follow], *[(F.count_if(F.col("multiple") >= k) / n).alias(f"multiple_ge_{k}") for k in multiples],
    )
    out = _beside(_beside(one, falls, by), medians, by)
    rate = base.agg(F.avg("y").alias("_rate"))  # one row
    return out.crossJoin(F.broadcast(rate)).withColumn("lift", F.when(F.col("_rate") > 0, F.col("hit_rate") / F.col("_rate"))).drop("_rate")
