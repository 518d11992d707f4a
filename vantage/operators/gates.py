"""Gates: each returns the rows that break a rule, or one row per check, so that an empty or all-ok result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(rows: DataFrame, rules: dict[str, Column], *keep: str) -> DataFrame:
    """(keep..., rule): one row for each rule that a row breaks; a rule that is null is broken."""
    hit = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.select(*keep, F.explode(F.filter(F.array(*hit), lambda r: r.isNotNull())).alias("rule"))


def checks(rows: DataFrame, bad: dict[str, Column], most: dict[str, float] | None = None, soft: tuple[str, ...] = ()) -> DataFrame:
    """(check, n, n_bad, ok, soft): all checks in one pass. ok: the bad rows are none, or at most the share in `most`."""
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in bad.items()])
    long = one.unpivot(["n"], list(bad), "check", "n_bad")
    share = F.coalesce(F.create_map(*[x for k, v in (most or {"": 0.0}).items() for x in (F.lit(k), F.lit(float(v)))])[F.col("check")], F.lit(0.0))
    return long.select("check", "n", "n_bad", (F.col("n_bad") <= share * F.col("n")).alias("ok"), F.col("check").isin(*soft, "").alias("soft"))


def staleness(rows: DataFrame, by: list[str], at: str, longest: int, share: float = 0.05) -> DataFrame:
    """Per group: rows at or before t0, how many are older than `longest`, their share, and ok up to `share`."""
    age = F.col("t0") - F.col(at)
    out = rows.where(age >= 0).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(age > longest).alias("n_stale"))
    return out.withColumn("fraction_stale", F.round(F.col("n_stale") / F.col("n"), 6)).withColumn("ok", F.col("n_stale") <= share * F.col("n"))


def split_gate(rows: DataFrame, embargo: int) -> DataFrame:
    """(check, n_bad, ok) of (entity, t0, part): each part starts an embargo after the one before ends, and no
    entity is in two parts."""
    ends = rows.groupBy("part").agg(F.min("t0").alias("lo"), F.max("t0").alias("hi"))  # three rows
    one = ends.agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "val", "test") for c in ("lo", "hi")])
    gap = lambda a, b: F.when(F.col(f"{a}_hi") + embargo > F.col(f"{b}_lo"), 1).otherwise(0).cast("long")
    order = one.select(F.explode(F.array(F.struct(F.lit("train_val").alias("check"), gap("train", "val").alias("n_bad")), F.struct(F.lit("val_test").alias("check"), gap("val", "test").alias("n_bad")))).alias("x")).select("x.*")
    twice = rows.groupBy("entity").agg((F.min("part") != F.max("part")).alias("twice")).agg(F.lit("single_part").alias("check"), F.count_if("twice").alias("n_bad"))
    return order.unionByName(twice).withColumn("ok", F.col("n_bad") == 0)


def capture_schema(events: DataFrame, lo: float, hi: float, version: str, source: str = "pyth") -> DataFrame:
    """(capture_id, rule) of capture events: complete must be false, mc0 in the band, the version right, the source told
    and `source` where the quality is HIGH, t0 present, capture_id unique."""
    rules = {
        "complete": F.col("complete") == F.lit(False),
        "band": F.col("mc0").between(lo, hi),
        "version": F.col("definition_version") == version,
        "source": F.col("sol_usd_source") != "",
        "high_source": (F.col("capture_quality") != "HIGH") | (F.col("sol_usd_source") == source),
        "t0": F.col("t0").isNotNull(),
    }
    twice = events.groupBy("capture_id").agg(F.count("*").alias("n")).where("n > 1").select("capture_id", F.lit("duplicate").alias("rule"))
    return broken(events, rules, "capture_id").unionByName(twice)


def capture_audit(events: DataFrame, reads: DataFrame, required: tuple[str, ...], lo: float, hi: float, version: str, source: str = "pyth") -> DataFrame:
    """(capture_id, rule): capture_schema, and missing_<c> for each required field that is null or no column, and
    future_read for captures whose detector read (capture_id, at) later than t0, or at no told time."""
    fields = {f"missing_{c}": F.col(c).isNotNull() if c in events.columns else F.lit(False) for c in required}
    late = reads.join(events.groupBy("capture_id").agg(F.min("t0").alias("_t0")), "capture_id")
    late = late.where(F.col("at").isNull() | (F.col("at") > F.col("_t0"))).select("capture_id", F.lit("future_read").alias("rule")).distinct()
    return capture_schema(events, lo, hi, version, source).unionByName(broken(events, fields, "capture_id")).unionByName(late)


def feature_time_gate(rows: DataFrame, at: str = "ts", slot: str = "slot", t0: str = "t0", slot0: str = "slot0") -> DataFrame:
    """Rows of features with the rule that they break: read after t0, or, where they have no time, in a slot after slot0;
    with neither time nor both slots they cannot be audited, which breaks the rule too. A told time decides alone."""
    by_time = F.col(at).isNotNull()
    by_slot = F.col(slot).isNotNull() & F.col(slot0).isNotNull()
    rule = F.when(by_time, F.when(F.coalesce(F.col(at) > F.col(t0), F.lit(True)), "after_t0")).when(by_slot, F.when(F.col(slot) > F.col(slot0), "after_slot0")).otherwise("not_auditable")
    return rows.withColumn("rule", rule).where("rule is not null")


#: Sources of priors that come from the training family, by beginning and by name.
PRIOR_BEGINS = ("dune_cohort_",)
PRIOR_NAMES = ("train_store_v1",)


def score_row_gates(rows: DataFrame, key: str, threshold: float, atol: float = 1e-9, begins: tuple[str, ...] = PRIOR_BEGINS, names: tuple[str, ...] = PRIOR_NAMES) -> DataFrame:
    """(key, rule) of scored rows: creator_prior_source is of the training family, t0_refined is true, and score_threshold
    is the configured one up to atol. Null breaks each."""
    prior = F.trim("creator_prior_source")
    family = reduce(lambda a, b: a | b, [F.startswith(prior, F.lit(p)) for p in begins], prior.isin(*names))
    return broken(rows, {"prior_not_train": family, "t0_not_refined": F.col("t0_refined"), "threshold_differs": F.abs(F.col("score_threshold") - threshold) <= atol}, key)


def trade_table(trades: DataFrame, key: list[str], by: str, order: list[str], allowed: Column) -> DataFrame:
    """(rule, n_bad): keys that repeat, rows outside the allowed programs, and rows whose time is before that of
    the row ahead of them in the given order of their entity."""
    twice = trades.groupBy(*key).agg((F.count("*") - 1).alias("more")).agg(F.lit("duplicate").alias("rule"), F.coalesce(F.sum("more"), F.lit(0)).alias("n_bad"))
    # a verdict instead of its columns, and order by plain columns: rows of the window's sort are short
    rows = trades.select(F.col(by).alias("_by"), "ts", allowed.alias("_ok"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("_by").orderBy(*[f"_o{i}" for i in range(len(order))]))
    rest = rows.select("_ok", back.alias("_back")).agg(F.count_if(~F.coalesce("_ok", F.lit(False))).alias("program"), F.count_if(F.coalesce("_back", F.lit(False))).alias("time"))
    return twice.unionByName(rest.unpivot([], ["program", "time"], "rule", "n_bad"))


def leak_columns(features: list[str], labels: list[str], prefixes: tuple[str, ...] = ("hit_", "label_", "multiple_", "time_to_")) -> list[str]:
    """The feature columns that are label columns or begin like them."""
    return sorted(c for c in features if c in labels or c.startswith(prefixes))


def leak_rules(features: list[str], labels: list[str], allowed: list[str] | None = None, prefixes: tuple[str, ...] = ("hit_", "label_", "multiple_", "time_to_")) -> list[tuple[str, str]]:
    """(column, rule) of feature columns that must not be: label columns, those that begin like one, and, with a list of
    allowed ones, those that are not on it; the first rule that a column breaks."""
    out = []
    for c in features:
        rule = "label" if c in labels else "prefix" if c.startswith(prefixes) else "not_listed" if allowed is not None and c not in allowed else None
        out += [(c, rule)] if rule else []
    return sorted(out)


def unstamped(rows: DataFrame, required: tuple[str, ...] = ("feature_set_version", "label_version", "seed")) -> DataFrame:
    """(column, n) of the version columns that rows lack: in how many rows; in all of them where there is no such column.
    Columns that every row has are not listed."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "") if c in rows.columns else F.lit(True)
    one = rows.agg(*[F.count_if(empty(c)).alias(c) for c in required])
    return one.unpivot([], list(required), "column", "n").where("n > 0")


def recipe_difference(recipe: list[str], columns: list[str]) -> dict[str, list[str]]:
    """What a table lacks and has beyond a recipe, and the places where the order differs."""
    both = [c for c in columns if c in recipe]
    return {"missing": [c for c in recipe if c not in columns], "extra": [c for c in columns if c not in recipe], "moved": [c for c, r in zip(both, [r for r in recipe if r in both], strict=True) if c != r]}


def first_gate(gates: dict[str, Column]) -> Column:
    """The name of the first gate that a row fails, null where it passes all. A gate that is null does not fail."""
    return F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in gates.items()])


def all_of(conditions: list[Column]) -> Column:
    """All hold; null does not."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def window_gate(trades: DataFrame, window: int) -> DataFrame:
    """Trades (entity, t0, ts) that a window claims and that have no time, lie after t0, or before its begin."""
    rule = F.when(F.col("ts").isNull(), "missing").when(F.col("ts") > F.col("t0"), "after_t0").when(F.col("ts") < F.col("t0") - window, "before_window")
    return trades.withColumn("rule", rule).where("rule is not null")


def feature_quality(df: DataFrame, features: list[str], labels: list[str], lo: float, hi: float, least: int = 1) -> DataFrame:
    """(check, n, n_bad, ok, soft): label columns among the features, too few rows, prices outside the band, nulls by feature."""
    leaks = leak_columns(features, labels)
    bad = {"band": ~F.coalesce(F.col("p0").between(lo, hi), F.lit(False))} | {f"null_{c}": F.col(c).isNull() for c in features}
    out = checks(df, bad, {f"null_{c}": 1.0 for c in features}, tuple(f"null_{c}" for c in features))
    n = df.agg(F.count("*").alias("n"))
    short = (F.col("n") < least).cast("long")
    more = n.select(F.inline(F.array(F.struct(F.lit("leak").alias("check"), "n", F.lit(len(leaks)).cast("long").alias("n_bad"), F.lit(not leaks).alias("ok"), F.lit(False).alias("soft")), F.struct(F.lit("rows").alias("check"), "n", short.alias("n_bad"), (short == 0).alias("ok"), F.lit(False).alias("soft")))))
    return out.unionByName(more)


def candidate_sample(df: DataFrame, forbidden: tuple[str, ...], value: str, lo: float, hi: float, key: str = "entity") -> DataFrame:
    """(key, rule) of candidates outside the band; an error where the sample is to hold columns known only after t0."""
    wrong = sorted(set(df.columns) & set(forbidden))
    if wrong:
        raise ValueError(f"columns known only after t0: {', '.join(wrong)}")
    return broken(df, {"band": F.col(value).between(lo, hi)}, key)


def journal_invariant(rows: DataFrame, cut: int, ages: tuple[str, ...], prior_prefix: str, prior_store: str, skipped: str) -> DataFrame:
    """(entity, rule) of rows since the cut: the age's source is a known one, the score was not skipped for want of a
    prior, and a prior, where one is told, comes from the training family."""
    prior = F.coalesce(F.col("creator_prior_source"), F.lit(""))
    rules = {
        "age_source": F.col("age_source").isin(*ages),
        "score_mode": F.coalesce(F.col("score_mode"), F.lit("")) != skipped,
        "prior_source": (prior == "") | F.startswith(prior, F.lit(prior_prefix)) | (prior == prior_store),
    }
    return broken(rows.where(F.col("ts") >= cut), rules, "entity")


def missing_stamps(columns: list[str], required: tuple[str, ...] = ("feature_set_version", "label_version", "seed")) -> list[str]:
    """The version columns that an artifact lacks."""
    return [c for c in required if c not in columns]


def quality_of(source: Column) -> Column:
    """HIGH for quotes of pyth or as of pyth, else MED."""
    return F.when(F.lower(F.coalesce(source, F.lit(""))).isin("pyth", "pyth_asof"), "HIGH").otherwise("MED")


def score_reject_reason(captures: DataFrame, require_pyth: bool = True, allow_med: bool = False) -> DataFrame:
    """Adds scoreable and reject_reason of captures (refined, detail, quality, sol_usd_source): null where they may be scored.

    In this order: not refined, a quality of LOW or REJECT, MED where only HIGH will do, a quote of another source, and
    any quality that is none of these.
    """
    quality = F.upper(F.coalesce("quality", F.lit("")))
    reason = F.when(~F.coalesce("refined", F.lit(False)), F.concat(F.lit("t0_unrefined:"), F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.lit("provisional"))))
    reason = reason.when(quality.isin("LOW", "REJECT"), F.concat(F.lit("capture_quality_"), F.lower(quality)))
    if not allow_med:
        reason = reason.when(quality == "MED", "capture_quality_med_pyth_required")
    if require_pyth:
        reason = reason.when(quality_of(F.col("sol_usd_source")) != "HIGH", F.concat(F.lit("sol_usd_not_pyth:"), F.coalesce("sol_usd_source", F.lit(""))))
    reason = reason.when(~quality.isin("HIGH", "MED"), "not_scoreable")
    return captures.withColumn("reject_reason", reason).withColumn("scoreable", F.col("reject_reason").isNull())
