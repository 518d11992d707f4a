"""Registered queries over whole rule lists, cohorts, overlays and strategy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import capture as cap
from vantage.operators import cohort as co
from vantage.operators import compare as cmp
from vantage.operators import evaluate as ev
from vantage.operators import features as ft
from vantage.operators import gates as gt
from vantage.operators import labels as lb
from vantage.operators import records as rc
from vantage.operators import rules as rl
from vantage.operators import samples as sm
from vantage.operators import scores as sc
from vantage.plans import gated  # noqa: F401 - its SQL is composed below
from vantage.plans.registry import LABELS, PREDS, W, captured, labelled, oracle_sql, pit, predictions, query
from vantage.sources.bindings import BAND, DAY, creates, trades
from vantage.sources.shared import materialize

END = 915148800  # 1999-01-01

REPORT = PREDS + """, top as (select * from (select *, row_number() over (partition by fold order by score desc, t0, entity) as rank from preds) where rank <= 20),
  ret as (select fold, t0, entity, 'r_cap' as kind, (least(multiple, 10) - 1 - 0.015::double)::decimal(18,6) as r, multiple from top union all select fold, t0, entity, 'r_binary', (case when y = 1 then 9 - 0.015::double else -1 - 0.015::double end)::decimal(18,6), multiple from top
    union all select fold, t0, entity, 'r_wide', (least(multiple, 20) - 1 - 0.015::double)::decimal(18,6), multiple from top),
  cum as (select fold, kind, t0, entity, case when kind = 'r_binary' or multiple is not null then r end as r, coalesce(sum(case when kind = 'r_binary' or multiple is not null then r end) over (partition by fold, kind order by t0, entity rows unbounded preceding), 0) as c from ret),
  fall as (select *, c - max(c) over (partition by fold, kind order by t0, entity rows unbounded preceding) as f from cum),
  k as (select fold, """ + ", ".join(f"round(coalesce(sum(r) filter (kind = '{k}'), 0)::double, 4) as cum_{k}, round(sum(r) filter (kind = '{k}')::double / count(r) filter (kind = '{k}'), 5) as mean_{k}, round(min(f) filter (kind = '{k}')::double, 4) as dd_{k}" for k in ("r_cap", "r_binary", "r_wide")) + """ from fall group by fold)
  select fold, count(*) as n, sum(y)::bigint as n_hits, round(avg(y), 6) as hit_rate, round((max(t0) - min(t0)) / 86400, 6) as span_days, round(count(*) / ((max(t0) - min(t0)) / 86400), 6) as n_per_day, round(avg(multiple), 5) as mean_multiple,
    count(*) filter ((915148800 - t0) / 86400 >= 1000) / count(*) as followup_ge_1000, count(*) filter ((915148800 - t0) / 86400 >= 2000) / count(*) as followup_ge_2000, count(*) filter (multiple >= 1) / count(*) as multiple_ge_1, count(*) filter (multiple >= 2) / count(*) as multiple_ge_2,
    any_value(columns(k.* exclude (fold))), round(quantile_cont((915148800 - t0) / 86400, 0.5), 5) as median_followup, round(quantile_cont(multiple, 0.5), 5) as median_multiple, round(avg(y) / (select avg(y) from preds), 5) as lift
  from top join k using (fold) group by fold"""


@query("a29_strategy_report", REPORT)
def _(s, d):
    p = predictions(s, d)
    out = co.strategy_report(ev.strategy_returns(ev.rank_topk(p, ["fold"], 20)), ["fold"], p, END, (1000, 2000), (1, 2))
    kinds = ("r_cap", "r_binary", "r_wide")
    digits = dict.fromkeys(("hit_rate", "span_days", "n_per_day"), 6) | dict.fromkeys(("mean_multiple", "median_followup", "median_multiple", "lift", *(f"mean_{k}" for k in kinds)), 5) | dict.fromkeys([f"{a}_{k}" for a in ("cum", "dd") for k in kinds], 4)
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


COHORT = LABELS + """, co as (select entity, t0, multiple_180d >= 1.15::double as hit, multiple_365d as top, entity % 10 <> 7 as a, not coalesce(multiple_365d > 1.9, false) as b, not coalesce(entity % 4 = 0 and multiple_90d > 1.1, false) as c from labelled),
  fl as (select entity, t0, hit, top, (915148800 - t0) / 86400 as days, (915148800 - t0) / 86400 >= 400 as ready, coalesce(hit <> (top >= 1.15::double), false) as bad from co where a and b and c)"""


def _cohort(s, d):
    rows = labelled(s, d)
    side = rows.where("entity % 4 = 0").select("entity", (F.col("multiple_90d") > 1.1).alias("outlier"))
    rows = rows.select("entity", "t0", (F.col("multiple_180d") >= 1.15).alias("hit"), F.col("multiple_365d").alias("top"))
    return rows.join(sc.outlier_join(rows.select("entity"), side, ["outlier"]), "entity")


def _steps():
    return [("raw", F.lit(True)), ("suffix", F.col("entity") % 10 != 7), ("absurd", ~F.coalesce(F.col("top") > 1.9, F.lit(False))), ("outlier", ~F.col("outlier"))]


@query("a15_cohort_steps", COHORT + """, st as (select count(*) as n, count(*) filter (a) as na, count(*) filter (a and b) as nb, count(*) filter (a and b and c) as nc from co)
  select 0 as step, 'raw' as name, n as n_in, n as n_out, 0 as n_dropped from st union all select 1, 'suffix', n, na, n - na from st union all select 2, 'absurd', na, nb, na - nb from st union all select 3, 'outlier', nb, nc, nb - nc from st""")
def _(s, d):
    return ev.cohort_funnel(_cohort(s, d), _steps())


def _flagged(s, d):
    rows = _cohort(s, d).where(gt.all_of([keep for _, keep in _steps()]))
    return co.cohort_flags(rows, END, 400, "hit", "top", 1.15)


@query("a15_cohort_flags", COHORT + " select entity, t0, round(days, 6) as followup_days, ready as primary_ready, bad as inconsistent from fl")
def _(s, d):
    return _flagged(s, d).select("entity", "t0", F.round("followup_days", 6).alias("followup_days"), "primary_ready", "inconsistent")


@query("a15_cohort_counts", COHORT + " select count(*) as n, count(*) filter (hit) as n_pos, count(*) filter (not hit) as n_neg, count(*) filter (hit and ready) as n_pos_ready, count(*) filter (not hit and ready) as n_neg_ready, count(*) filter (bad) as n_inconsistent from fl")
def _(s, d):
    return co.cohort_counts(_flagged(s, d), "hit")


OVERLAY = """, lv as (select entity, count(*) as n, sum(usd)::double as usd, max(age)::double as age from pit group by entity),
  so as (select entity, case when entity % 4 = 0 then n + 1 else n end as buys, case when entity % 3 = 0 then usd * 2 else usd end as usd, case when entity % 5 = 0 then null when entity % 7 = 0 then age + 10 else age end as age from lv where entity % 6 <> 1),
  o as (select lv.*, so.entity is not null as there, coalesce(lv.n = so.buys, false) as exact, so.usd as su, so.age as sa, so.entity is not null and so.usd <> lv.usd as du, so.entity is not null and (so.age is null or abs(so.age - lv.age) > 1e-9) as da from lv left join so using (entity))"""


def _overlay(s, d):
    live = pit(s, d).groupBy("entity").agg(F.count("*").alias("n"), F.sum("usd").cast("double").alias("usd"), F.max("age").cast("double").alias("age"))
    e = F.col("entity")
    store = live.where("entity % 6 <> 1").select("entity", F.when(e % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("buys"), F.when(e % 3 == 0, F.col("usd") * 2).otherwise(F.col("usd")).alias("usd"), F.when(e % 5 == 0, None).when(e % 7 == 0, F.col("age") + 10).otherwise(F.col("age")).alias("age"))
    return cmp.overlay_changes(live, store, "entity", ["usd", "age"], "n", "buys")


@query("j15_overlay_exact", OVERLAY + " select entity, n, case when exact and du then su else usd end as usd, case when exact and da then sa else age end as age, case when exact and du then usd end as usd_base, case when exact and da then age end as age_base from o")
def _(s, d):
    return cmp.overlay_wide(_overlay(s, d), ["usd", "age"])


@query("j15_overlay_deltas", OVERLAY + " select entity, 'usd' as col, usd as base, su as store, usd - su as delta from o where exact and du union all select entity, 'age', age, sa, age - sa from o where exact and da")
def _(s, d):
    return cmp.overlay_long(_overlay(s, d), "entity")


@query("j15_overlay_notes", OVERLAY + """, b as (select *, case when du then abs(usd - su) end as xu, case when da then abs(age - sa) end as xa from o)
  select entity, case when not there then 'missing_in_store' when exact then 'overlaid' else 'trades_not_exact' end as note, (du::int + da::int)::bigint as n_diff, case when exact then du::int + da::int else 0 end::bigint as n_overlaid, greatest(xu, xa) as largest, case when xu is null and xa is null then null when xa is null or xu >= xa then 'usd' else 'age' end as top from b""")
def _(s, d):
    return cmp.overlay_notes(_overlay(s, d), "entity")


@query("g1_time_or_slot_gate", """, r as (select t.entity, l_orderkey, l_linenumber, case when l_orderkey % 3 <> 0 then ts end as seen, case when l_orderkey % 6 <> 0 then ts // 400 end as slot, t0, t0 // 400 as slot0 from trades t join captures c using (entity))
  select entity, l_orderkey, l_linenumber, case when seen is not null then case when seen > t0 then 'after_t0' end when slot is not null then case when slot > slot0 then 'after_slot0' end else 'not_auditable' end as rule from r where rule is not null""")
def _(s, d):
    key = F.col("id.l_orderkey")
    rows = trades(s, d).join(captured(s, d).select("entity", "t0"), "entity")
    rows = rows.select("entity", key.alias("l_orderkey"), F.col("id.l_linenumber").alias("l_linenumber"), F.when(key % 3 != 0, F.col("ts")).alias("at"), F.when(key % 6 != 0, F.floor(F.col("ts") / 400)).alias("slot"), "t0", F.floor(F.col("t0") / 400).alias("slot0"))
    return gt.feature_time_gate(rows, "at").select("entity", "l_orderkey", "l_linenumber", "rule")


@query("g6_capture_audit", """, e as (select 'c' || entity as capture_id, entity, false as complete, p0 as mc0, t0, case when entity % 9 <> 0 then t0 // 400 end as slot0, case when entity % 2 = 0 then 'HIGH' else 'MED' end as q, case when entity % 6 = 0 then 'jupiter' else 'pyth' end as src from captures),
    rd as (select 'c' || t.entity as capture_id, max(ts) as last_read from trades t join captures c using (entity) where ts <= t0 or t.entity % 8 = 0 group by 1)
  select capture_id, unnest([x for x in [case when not mc0 between 1050 and 1400 then 'band' end, case when q = 'HIGH' and src <> 'pyth' then 'high_source' end, case when slot0 is null then 'missing_slot0' end, 'missing_sig0'] if x is not null]) as rule from e
  union all select capture_id, 'future_read' from e join rd using (capture_id) where last_read > t0""")
def _(s, d):
    e = F.col("entity")
    name = F.concat(F.lit("c"), e.cast("string")).alias("capture_id")
    rows = captured(s, d).select(
        name, F.lit(False).alias("complete"), F.col("p0").alias("mc0"), "t0", F.when(e % 9 != 0, F.floor(F.col("t0") / 400)).alias("slot0"), F.lit("v1").alias("definition_version"), F.when(e % 2 == 0, "HIGH").otherwise("MED").alias("capture_quality"), F.when(e % 6 == 0, "jupiter").otherwise("pyth").alias("sol_usd_source"),
    )
    read = trades(s, d).join(captured(s, d).select("entity", "t0"), "entity").where((F.col("ts") <= F.col("t0")) | (e % 8 == 0)).select(name, F.col("ts").alias("at"))
    return gt.capture_audit(rows, read, ("slot0", "sig0"), 1050.0, BAND[1], "v1")


@query("g10_score_row_gates", PREDS + """, r as (select entity, case when entity % 4 = 0 then 'dune_cohort_' || fold when entity % 4 = 1 then ' train_store_v1 ' when entity % 4 = 2 then 'pump_frontend_30d' end as src, case when entity % 5 <> 0 then entity % 3 <> 0 end as refined, case when entity % 11 <> 0 then 0.9 + (entity % 2) / 10.0 end as th from preds)
  select entity, unnest([x for x in [case when not coalesce(src like 'dune_cohort_%' or src = ' train_store_v1 ', false) then 'prior_not_train' end, case when not coalesce(refined, false) then 't0_not_refined' end, case when not coalesce(abs(th - 0.9) <= 1e-9, false) then 'threshold_differs' end] if x is not null]) as rule from r""")
def _(s, d):
    e = F.col("entity")
    source = F.when(e % 4 == 0, F.concat(F.lit("dune_cohort_"), F.col("fold").cast("string"))).when(e % 4 == 1, " train_store_v1 ").when(e % 4 == 2, "pump_frontend_30d")
    rows = predictions(s, d).select("entity", source.alias("creator_prior_source"), F.when(e % 5 != 0, e % 3 != 0).alias("t0_refined"), F.when(e % 11 != 0, 0.9 + (e % 2) / 10.0).alias("score_threshold"))
    return gt.score_row_gates(rows, "entity", 0.9)


@query("n1_listed_swaps", "select entity, side, count(*) as n, sum(usd)::double as usd from trades where usd >= 1 and tok > 0 and venue = 'pumpswap' and l_suppkey % 3 <> 0 group by all")
def _(s, d):
    buy, name = F.col("side") == "buy", F.col("entity").cast("string")
    project = F.when(F.col("id.l_suppkey") % 3 != 0, F.col("venue"))
    pairs = trades(s, d).select(F.when(buy, name).otherwise("SOL").alias("bought"), F.when(buy, F.lit("SOL")).otherwise(name).alias("sold"), F.when(buy, F.col("tok")).otherwise(F.col("base")).alias("bought_amount"), F.when(buy, F.col("base")).otherwise(F.col("tok")).alias("sold_amount"), "usd", project.alias("project"))
    return cap.normalize_swaps(pairs, projects=("pumpswap",)).groupBy(F.col("entity").cast("long").alias("entity"), "side").agg(F.count("*").alias("n"), F.sum("usd").cast("double").alias("usd"))


#: What a pack of the matrix holds: activity, its largest buy, the buys of a month, the age since the create, and the gates' own columns.
MATRIX = ["buy_usd", "sell_usd", "max_buy_usd", "max_buy_share", "buy_usd_30d", "age", "scoreable", "distance"]


@query("a35_composed_matrix", f""", a5 as ({oracle_sql()["a5_microstructure_pack"]}), a8 as ({oracle_sql()["a8_buy_volume"]}), a13 as ({oracle_sql()["a13_relabel_two_sources"]}), j7 as ({oracle_sql()["j7_create_join"]}),
  seen as (select entity, max(ts) as last from trades group by 1), st as (select quantile_cont(buy_usd, [0.25, 0.5, 0.75]) as a, quantile_cont(max_buy_usd, [0.25, 0.5, 0.75]) as b from a5),
  f as (select seen.entity, coalesce(c.t0, last) as t0, c.p0, a5.buy_usd, a5.sell_usd, a5.max_buy_usd, a5.max_buy_share, a8.buy_usd as buy_usd_30d, j7.age, c.entity is not null as scoreable, a13.hit,
      (case when a[3] > a[1] then coalesce(abs(a5.buy_usd - a[2]) / ((a[3] - a[1]) / 1.35::double), 3) else 3 end + case when b[3] > b[1] then coalesce(abs(a5.max_buy_usd - b[2]) / ((b[3] - b[1]) / 1.35::double), 3) else 3 end) / 2 as distance
    from seen cross join st left join captures c using (entity) left join a5 on a5.entity = seen.entity left join a8 on a8.entity = seen.entity left join a13 on a13.entity = seen.entity left join j7 on j7.entity = seen.entity),
  r as (select k.entity, k.entity % 10 * 1000.0::double as store_buy_usd, f.* exclude (entity), case when t0 is null then 'no_capture' when not scoreable then 'capture_quality' when not coalesce(max_buy_usd between 500 and 60000, false) then 'hard_range' when age > 31536000 then 'age' when distance > 2 then 'distance' end as reason
    from creates k left join f using (entity))
  select entity, store_buy_usd, t0, p0 * 1e9::double / 1e9::double as p0, hit, reason, {", ".join(f"case when reason is null then {'round(distance, 5)' if c == 'distance' else c} end as {c}" for c in MATRIX)}, case when reason is null then round(buy_usd - store_buy_usd, 4) end as buy_usd_delta from r""")
def _(s, d):
    t = materialize(trades(s, d), "trades")
    found = rl.capture_first_band(t, BAND[0] * 1e9, BAND[1] * 1e9)
    found = materialize(found.select("entity", "t0", F.when(F.col("refined"), F.col("mc") / 1e9).alias("p0"), "quality", "refined", "detail"))
    c = found.where("refined").select("entity", "t0", "p0")
    seen = cap.pit_join(c, t)
    prices = cap.implied_mc(t).where("price is not null")
    peaks = prices.groupBy("entity").agg(F.max(F.struct("price", (-F.col("ts")).alias("back"))).alias("m")).select("entity", F.col("m.price").alias("peak"), (-F.col("m.back")).alias("peak_ts"))
    pack = ft.microstructure_pack(seen, W).select("entity", "buy_usd", "sell_usd", "max_buy_usd", "max_buy_share")
    month = ft.buy_volume(c, seen, W["30d"]).select("entity", F.col("buy_usd").alias("buy_usd_30d"))
    graded = gt.score_reject_reason(found.withColumn("sol_usd_source", F.lit("pyth"))).select("entity", "scoreable")
    features = graded.join(pack, "entity", "left").join(month, "entity", "left").join(lb.create_join(c, creates(s, d)).select("entity", "age"), "entity", "left")
    features = materialize(features, "features")  # its quantiles read it again and again
    features = cmp.robust_distance(features, ["buy_usd", "max_buy_usd"])
    gates = {"capture_quality": F.col("scoreable"), "hard_range": cmp.in_ranges({"max_buy_usd": (500, 60000)}, False), "age": F.col("age") <= 365 * DAY, "distance": F.col("distance") <= 2}
    sample = creates(s, d).select("entity", (F.col("entity") % 10 * 1000.0).alias("buy_usd"))
    out = rc.reconstruct_matrix(sample, found, features, sc.relabel(c, prices, peaks, 180 * DAY, 1.3), gates, MATRIX)
    return out.withColumns({"distance": F.round("distance", 5), "buy_usd_delta": F.round("buy_usd_delta", 4)})


@query("l3_negatives_cap", PREDS + """, sz as (select (t0 + 259200) // 604800 as week, count(*) as s, sum(count(*)) over () as t from preds where entity % 9 <> 0 group by 1),
  a as (select *, greatest(round_even(s::double / t * least(t, 700), 0)::bigint, 1) as a from sz), o as (select *, sum(a) over () - least(t, 700) as over, row_number() over (order by a desc, week) as i, sum(a) over (order by a desc, week rows unbounded preceding) as p from a),
  m as (select *, count(*) filter (p - i * a < over) over () as m, max(p) filter (p - i * a < over) over () - over as rest from o),
  q as (select week, s, case when over <= 0 then a - case when i = 1 then over else 0 end when i <= m then rest // m + (i > m - rest % m)::int else a end as q from m)
  select 0 as y, week, least(q, s)::bigint as n from q where least(q, s) > 0 union all select 1, (t0 + 259200) // 604800, count(*) from preds where entity % 9 = 0 group by all""")
def _(s, d):
    rows = predictions(s, d).withColumn("y", (F.col("entity") % 9 == 0).cast("int"))
    return sm.negatives_cap(rows, "y", 700, "entity", 150).groupBy("y", F.floor((F.col("t0") + 3 * DAY) / (7 * DAY)).alias("week")).agg(F.count("*").alias("n"))
