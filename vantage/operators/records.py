"""Journal rows, snapshots and feature packs: projections, fills, partitions and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .capture import implied_mc, in_band
from .gates import first_gate
from .ordered import exact_quantiles
from .samples import numbered


def snapshot_proxies(real_tokens: Column, real_base: Column, initial: float) -> dict[str, Column]:
    """progress, 1 - reserves left / initial reserves within [0, 1], and net_base, the base units of the raw ones."""
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - real_tokens / initial))
    return {"progress": F.when(real_tokens.isNotNull(), done), "net_base": real_base / 1e9}


def select_pack(df: DataFrame, pack: list[str], banned: tuple[str, ...] = (), keep: tuple[str, ...] = ("entity",)) -> DataFrame:
    """The keys and, in the order of the pack, those of its columns that df has; an error where the pack names a banned one."""
    wrong = sorted(set(pack) & set(banned))
    if wrong:
        raise ValueError(f"banned columns in the pack: {', '.join(wrong)}")
    return df.select(*keep, *[c for c in pack if c in df.columns and c not in keep])


def mask_features(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """Sets columns to null, in all rows or in those of a condition; names that df lacks are left out."""
    types = dict(df.dtypes)
    hidden = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(~hidden, F.col(c)).cast(types[c]) for c in columns if c in types})


def fill_meta(rows: DataFrame) -> DataFrame:
    """name_len, name_missing, symbol_len, symbol_missing and meta_source of rows with name, symbol and those of the
    sighting (sighting_*) and lengths of the store (store_name_len, store_symbol_len).

    The create's own text counts first, then the sighting's, then the stored length; the source is that of the last fill.
    """
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    out, seen, stored = {}, [], []
    for c in ("name", "symbol"):
        seen.append(own(c).isNull() & own(f"sighting_{c}").isNotNull())
        stored.append(own(c).isNull() & own(f"sighting_{c}").isNull() & F.col(f"store_{c}_len").isNotNull())
        out[f"{c}_len"] = F.coalesce(F.length(own(c)), F.length(own(f"sighting_{c}")), F.col(f"store_{c}_len")).cast("double")
        out[f"{c}_missing"] = F.coalesce(F.length(own(c)), F.length(own(f"sighting_{c}")), F.col(f"store_{c}_len")).isNull()
    return rows.withColumns(out | {"meta_source": F.when(stored[0] | stored[1], "store").when(seen[0] | seen[1], "sighting").otherwise("create")})


def legacy_flags(rows: DataFrame, cut: int, stub_version: str, stub_source: str, stub_mode: str) -> DataFrame:
    """Adds is_stub (stub markers of features, source or mode) and is_legacy (a stub, or entered before the cut)."""
    version, source, mode = (F.coalesce(c, F.lit("")) for c in ("feature_set_version", "buy_vol_source", "score_mode"))
    told = F.coalesce(F.col("t0_definition"), F.lit("")) != ""
    hashed = F.contains(source, F.lit("hash_stub")) | (source == stub_source)
    stub = (version == stub_version) | hashed | ((mode == stub_mode) & (F.endswith(version, F.lit("_stub")) | ~told))
    return rows.withColumn("is_stub", stub).withColumn("is_legacy", F.col("is_stub") | F.coalesce(F.col("entered_at") < cut, F.lit(False)))


def entry_metrics(rows: DataFrame) -> DataFrame:
    """One row of flagged rows: n_raw, n_stub, n_legacy, n_kept, and of the kept ones' scores n, largest and the upper median."""
    counts = rows.agg(F.count("*").alias("n_raw"), F.count_if("is_stub").alias("n_stub"), F.count_if("is_legacy").alias("n_legacy"), F.count_if(~F.col("is_legacy")).alias("n_kept"))
    scores = rows.where(~F.col("is_legacy") & F.col("score").isNotNull()).select(F.lit(0).alias("g"), "score")
    some = scores.agg(F.count("*").alias("n_scores"), F.max("score").alias("largest"))
    middle = numbered(scores, ["g"], F.floor(F.col("score") * 4096), "score").join(F.broadcast(some), F.col("_i") == F.floor(F.col("n_scores") / 2)).agg(F.max("score").alias("upper_median"))
    return counts.join(F.broadcast(some)).join(F.broadcast(middle))  # one row each


def first_and_before(trades: DataFrame, lo: float, hi: float) -> DataFrame:
    """The trades up to each entity's first one in the band, with t0, p0 and age, from one pass over the trades.

    The first moment is a minimum over the entity, so trades are shuffled once and read once, where pit_join reads them
    twice. An entity's trades meet in one task, which spills; where one entity holds much of the table, pit_join
    with its broadcast of captures is the better form.
    """
    hit = F.when(in_band(F.col("price"), lo, hi), F.struct("ts", "id", "price"))
    rows = implied_mc(trades).withColumn("_first", F.min(hit).over(Window.partitionBy("entity")))
    rows = rows.where(F.col("ts") <= F.col("_first.ts")).withColumn("t0", F.col("_first.ts")).withColumn("p0", F.col("_first.price"))
    return rows.withColumn("age", F.col("t0") - F.col("ts")).drop("_first", "mc")


def journal_labels(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the label and matched, whether the label table has the key; a key must stand there once."""
    return rows.join(labels.select(key, F.col(label), F.lit(True).alias("matched")), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def event_audit(events: DataFrame, legs: DataFrame) -> DataFrame:
    """events (event, t0, ts, source) with their parsed legs (event, side, usd, trader): the largest buy leg stands for
    the event, else the largest leg; le_t0 tells whether it lies up to t0, parsed whether it has a leg."""
    best = legs.groupBy("event").agg(F.max_by(F.struct("side", "usd", "trader"), F.struct(F.col("side") == "buy", F.col("usd"), F.col("trader"))).alias("leg"), F.count("*").alias("n_legs"))
    out = events.join(best, "event", "left")
    return out.select("event", "source", (F.col("ts") <= F.col("t0")).alias("le_t0"), F.col("leg").isNotNull().alias("parsed"), F.coalesce("n_legs", F.lit(0)).alias("n_legs"), "leg.side", "leg.usd", "leg.trader")


def usable_geometry(rows: DataFrame, usable: Column, hard: Column, label: str, columns: list[str], live: DataFrame, least: int) -> DataFrame:
    """(feature, n_used, fallback, pos_n, pos_median, neg_median, live_median) over the usable rows; where these are fewer
    than `least` and the hard gate alone keeps `least` or more than they are, over its rows. live: (feature, live_median)."""
    soft, firm = F.coalesce(usable, F.lit(False)), F.coalesce(hard, F.lit(False))
    tagged = rows.withColumn("_u", soft).withColumn("_h", firm).where("_u or _h")
    n = tagged.agg(F.count_if("_u").alias("_nu"), F.count_if("_h").alias("_nh"))
    n = n.select(((F.col("_nu") < least) & ((F.col("_nh") >= least) | (F.col("_nh") > F.col("_nu")))).alias("fallback"), "_nu", "_nh")
    used = tagged.join(F.broadcast(n)).where(F.when(F.col("fallback"), F.col("_h")).otherwise(F.col("_u"))).withColumn("n_used", F.when(F.col("fallback"), F.col("_nh")).otherwise(F.col("_nu")))
    long = used.select(label, "fallback", "n_used", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([label, "fallback", "n_used"], columns, "feature", "value")
    pos = F.col(label) == 1
    out = long.groupBy("feature", "n_used", "fallback").agg(F.count(F.when(pos, F.col("value"))).alias("pos_n"))
    q = exact_quantiles(long.where("value is not null"), ["feature", label], "value", [0.5]).groupBy("feature").agg(*[F.max(F.when(F.col(label) == y, F.col("q")[0])).alias(name) for y, name in ((1, "pos_median"), (0, "neg_median"))])
    out = out.join(F.broadcast(q), "feature", "left")
    return out.join(F.broadcast(live), "feature", "left")  # a row per feature


def resolve_by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """One row for each key: that of the first table that has it; within a table, the least row. Adds source, its place."""
    ranked = reduce(DataFrame.unionByName, [t.withColumn("source", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in ranked.columns if c not in (key, "source")]
    best = ranked.groupBy(key).agg(F.min(F.struct("source", *rest)).alias("r"))
    return best.select(key, "r.source", *[f"r.{c}" for c in rest])


def dedupe_by_id(tables: list[DataFrame], key: str) -> DataFrame:
    """resolve_by_priority without rows whose id is null or empty."""
    return resolve_by_priority([t.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "") for t in tables], key)


def read_journal(rows: DataFrame, mode: str | None = None, since: int | None = None, limit: int | None = None) -> DataFrame:
    """Journal rows of a mode since a time, newest first, ties by entity."""
    if mode is not None:
        rows = rows.where(F.col("mode") == mode)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    rows = rows.orderBy(F.desc("ts"), "entity")
    return rows if limit is None else rows.limit(limit)


def first_seen(store: DataFrame, seen: DataFrame, key: str = "entity", at: str = "ts") -> DataFrame:
    """The rows to append: of entities that the store lacks, the earliest sighting, ties by all other columns."""
    rest = [c for c in seen.columns if c not in (key, at)]
    new = seen.join(store.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(F.struct(at, *rest)).alias("r"))
    return new.select(key, f"r.{at}", *[f"r.{c}" for c in rest])


def latest_followup(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The view of an append-only log in which a later write of the same keys replaces the earlier one."""
    rest = [c for c in log.columns if c not in (*keys, version)]
    return log.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r")).select(*keys, f"r.{version}", *[f"r.{c}" for c in rest])


def reconstruct_matrix(sample: DataFrame, captures: DataFrame, features: DataFrame, labels: DataFrame, gates: dict[str, Column], columns: list[str]) -> DataFrame:
    """Each row of a sample (entity, stored columns) with its capture, label, features, reason and deltas.

    captures (entity, t0, p0), features and labels (entity, hit) have an entity once. Stored columns come as store_<name>, and
    <name>_delta is the rebuilt value less the stored one, where both tables have it. Entities without a capture and those
    that fail a gate stay, with the reason and null features; a gate that is null does not fail.
    """
    stored = [c for c in sample.columns if c != "entity"]
    rows = sample.select("entity", *[F.col(c).alias(f"store_{c}") for c in stored]).join(captures.select("entity", "t0", "p0"), "entity", "left")
    rows = rows.join(features.select("entity", *columns), "entity", "left").join(labels.select("entity", "hit"), "entity", "left")
    reason = F.coalesce(F.when(F.col("t0").isNull(), "no_capture"), first_gate(gates))
    rows = rows.withColumn("reason", reason)
    rows = mask_features(rows, columns, F.col("reason").isNotNull())
    return rows.withColumns({f"{c}_delta": F.col(c) - F.col(f"store_{c}") for c in columns if c in stored})
