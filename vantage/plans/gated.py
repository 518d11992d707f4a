"""Registered queries over gates, scores, priors, samples and normalised payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import capture as cap
from vantage.operators import compare as cmp
from vantage.operators import evaluate as ev
from vantage.operators import features as ft
from vantage.operators import gates as gt
from vantage.operators import labels as lb
from vantage.operators import normalize as nz
from vantage.operators import rules as rl
from vantage.operators import scores as sc
from vantage.plans.registry import FLOW, NTH, PREDS, PRICED, W, captured, pit, predictions, priced, query
from vantage.sources.bindings import BAND, DAY, creates, trades

#: Payload times are moved on by so many seconds, as epochs in milliseconds are told from seconds by their size only after 2001.
LATER = 1_000_000_000
WEEK = "(t0 + 259200) // 604800"


@query("g2_staleness", """select entity, count(*) as n, count(*) filter (age > 7776000) as n_stale, round(count(*) filter (age > 7776000) / count(*), 6) as fraction_stale,
  count(*) filter (age > 7776000) <= 0.05::double * count(*) as ok from pit group by entity""")
def _(s, d):
    return gt.staleness(pit(s, d), ["entity"], "ts", 90 * DAY)


@query("g3_label_time_gate", PRICED + "select c.entity, p.ts, case when p.ts <= c.t0 then 'not_after_t0' else 'price' end as rule from priced p join captures c using (entity) where p.ts <= c.t0 or not (p.price > 0)")
def _(s, d):
    return lb.label_violations(captured(s, d), priced(s, d).where("price is not null")).select("entity", "ts", "rule")


SPLIT = """, v as (select min(t0) as lo, max(t0) as hi from captures where t0 > 852076800 + 2592000 and t0 <= 883612800),
  sp as (select entity, t0, case when t0 <= 852076800 and t0 + 2592000 <= lo then 'train' when t0 > 852076800 + 2592000 and t0 <= 883612800 then 'val' when t0 > hi + 2592000 and t0 <= 915148800 then 'test' end as part from captures, v where part is not null),
  e as (select max(t0) filter (part = 'train') as th, min(t0) filter (part = 'val') as vl, max(t0) filter (part = 'val') as vh, min(t0) filter (part = 'test') as xl from sp)"""


@query("g5_split_gate", SPLIT + """ select 'train_val' as "check", (coalesce(th + 5184000 > vl, false))::bigint as n_bad, n_bad = 0 as ok from e union all select 'val_test', (coalesce(vh + 5184000 > xl, false))::bigint, not coalesce(vh + 5184000 > xl, false) from e
  union all select 'single_part', count(*) filter (a <> b), count(*) filter (a <> b) = 0 from (select min(part) as a, max(part) as b from sp group by entity)""")
def _(s, d):
    return gt.split_gate(ev.embargo_split(captured(s, d).select("entity", "t0"), 852076800, 883612800, 915148800, 30 * DAY), 60 * DAY)


@query("g6_capture_schema", """, e as (select 'c' || entity % 1500 as capture_id, venue0 = 'pumpswap' as complete, p0 as mc0, case when entity % 7 = 0 then 'v0' else 'v1' end as ver,
    case when entity % 5 = 0 then '' when entity % 3 = 0 then 'jupiter' else 'pyth' end as src, case when entity % 2 = 0 then 'HIGH' else 'MED' end as q from captures)
  select capture_id, unnest([x for x in [case when complete then 'complete' end, case when not mc0 between 1050 and 1400 then 'band' end, case when ver <> 'v1' then 'version' end,
    case when src = '' then 'source' end, case when q = 'HIGH' and src <> 'pyth' then 'high_source' end] if x is not null]) as rule from e
  union all select capture_id, 'duplicate' from e group by 1 having count(*) > 1""")
def _(s, d):
    e = F.col("entity")
    rows = captured(s, d).select(
        F.concat(F.lit("c"), (e % 1500).cast("string")).alias("capture_id"), (F.col("venue0") == "pumpswap").alias("complete"), F.col("p0").alias("mc0"), F.when(e % 7 == 0, "v0").otherwise("v1").alias("definition_version"),
        F.when(e % 5 == 0, "").when(e % 3 == 0, "jupiter").otherwise("pyth").alias("sol_usd_source"), F.when(e % 2 == 0, "HIGH").otherwise("MED").alias("capture_quality"), "t0",
    )
    return gt.capture_schema(rows, 1050.0, BAND[1], "v1")


@query("g7_pack_audit", """, k as (select entity, created from creates), b as (select entity, count(*) as nb, count(distinct trader) as nt, sum(case when side = 'buy' then tok else -tok end) as net from pit where true group by entity),
  pk as (select c.entity, c.t0, k.created, c.t0 - k.created as age, c.t0 + c.entity % 4 as pack_t0, (c.p0 - 1000) / 380 as share, c.venue0, net / 85 as progress, nb - c.entity % 2 as nb, nt from captures c left join k using (entity) left join b using (entity)),
  o as (select count(*) as n, count(*) filter (abs(t0 - pack_t0) > 2) as a, count(*) filter (created > t0) as b, count(*) filter (age < 0) as c, count(*) filter (share not between 0 and 1.0001) as e, count(*) filter (progress not between 0 and 1) as h, count(*) filter (nt > nb) as i, count(*) filter (venue0 = 'pumpswap') as f from pk)
  select 't0_match' as "check", n, a as n_bad, a = 0 as ok, false as soft from o union all select 'create_leq_t0', n, b, b = 0, false from o union all select 'age_nonneg', n, c, c = 0, false from o
  union all select 'shares_01', n, e, e <= 0.5 * n, false from o union all select 'progress_01', n, h, h = 0, false from o union all select 'cardinality', n, i, i = 0, false from o union all select 'migrated_rate', n, f, f <= 0.25 * n, true from o""")
def _(s, d):
    buys = pit(s, d).groupBy("entity", "trader").agg(F.count("*").alias("k"), F.sum(F.when(F.col("side") == "buy", F.col("tok")).otherwise(-F.col("tok"))).alias("net")).groupBy("entity").agg(F.sum("k").alias("n_buys"), F.count("*").alias("n_buyers"), (F.sum("net") / 85).alias("progress"))
    rows = captured(s, d).join(creates(s, d).select("entity", "created"), "entity", "left").join(buys, "entity", "left")
    rows = rows.withColumn("pack_t0", F.col("t0") + F.col("entity") % 4).withColumn("share", (F.col("p0") - 1000) / 380).withColumn("n_buys", F.col("n_buys") - F.col("entity") % 2)
    return gt.checks(rows, rl.pack_checks(), {"shares_01": 0.5, "migrated_rate": 0.25}, soft=("migrated_rate",))


@query("g14_trade_table", """, b as (select ts < lag(ts) over (partition by entity order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as back, venue from trades)
  select 'duplicate' as rule, coalesce(sum(n - 1), 0)::bigint as n_bad from (select count(*) as n from trades group by l_orderkey, l_linenumber)
  union all select 'program', count(*) filter (venue <> 'pumpdotfun') from b union all select 'time', count(*) filter (back) from b""")
def _(s, d):
    order = [f"id.{c}" for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return gt.trade_table(trades(s, d), ["id.l_orderkey", "id.l_linenumber"], "entity", order, F.col("venue") == "pumpdotfun")


@query("p25_training_filter", """, f as (select c.entity, count(*) as n, max(p.age) as oldest, any_value(k.created) as created from captures c join pit p using (entity) left join creates k on k.entity = c.entity group by c.entity)
  select entity, n from f where n >= 3 and oldest > 0 and coalesce(created <= 800000000, false)""")
def _(s, d):
    rows = pit(s, d).groupBy("entity").agg(F.count("*").alias("n"), F.max("age").alias("oldest")).join(creates(s, d).select("entity", "created"), "entity", "left")
    tight = rl.TRAINING | {"known_create": "created <= 800000000"}
    return rl.training_matrix(rows, tight, {"enough_trades": "n >= 2"}, least=1).select("entity", "n")


@query("p25_training_fallback", """, f as (select c.entity, count(*) as n, any_value(k.created) as created from captures c join pit p using (entity) left join creates k on k.entity = c.entity group by c.entity)
  select entity, n from f where n >= 2""")
def _(s, d):
    rows = pit(s, d).groupBy("entity").agg(F.count("*").alias("n"), F.max("age").alias("oldest")).join(creates(s, d).select("entity", "created"), "entity", "left")
    return rl.training_matrix(rows, rl.TRAINING | {"known_create": "created <= 0"}, {"enough_trades": "n >= 2"}).select("entity", "n")


@query("p28_score_gates", """select c.entity, case when k.entity is null then 'capture' when c.t0 < k.created then 'age' when c.p0 < 1050 then 't0' when c.venue0 = 'pumpswap' then 'oracle' when c.entity % 4 = 0 then 'prior_source' end as gate
  from captures c left join creates k on k.entity = c.entity and k.entity % 3 > 0""")
def _(s, d):
    known = creates(s, d).where("entity % 3 > 0").select("entity", "created", F.lit(True).alias("known"))
    rows = captured(s, d).join(known, "entity", "left").withColumn("prior_ok", F.col("entity") % 4 != 0)
    return rows.select("entity", gt.first_gate(rl.score_gates(1050.0)).alias("gate"))


def _flow(s, d):
    """Flow features under the names of the score operators: 60s is the short window, 5m the long one."""
    f = ft.flow_windows(pit(s, d), W)
    names = {"30d": "60s", "180d": "5m"}
    cols = [F.col(f"{side}_{a}_{w}").alias(f"{side}_{b}_{n}") for w, n in names.items() for side in ("buy", "sell") for a, b in (("usd", "vol_usd"), ("n", "count"))]
    more = [(F.col("buy_n") + F.col("sell_n")).alias("trade_count_total"), F.col("buyers_180d").alias("unique_traders_total"), F.col("buyers_30d").alias("unique_traders_60s"), F.col("oldest").alias("time_since_first_trade_s")]
    rows = f.select("entity", *cols, *more).join(captured(s, d).select("entity", "p0"), "entity")
    return rows.withColumn("mc_band_pos", (F.col("p0") - 1000) / 400).withColumn("log1p_mc_usd_t0", F.log1p("p0"))


FLOWED = f""", fl as (select entity, t0, {FLOW} from pit group by entity, t0),
  fw as (select fl.entity, buy_usd_30d as b, sell_usd_30d as s, buy_usd_180d as b5, sell_usd_180d as s5, buy_n_30d as bc, sell_n_30d as sc, buy_n_180d as bc5, buy_n + sell_n as tc, buyers_180d as ut, buyers_30d as ut60, fl.oldest as age,
    (p0 - 1000) / 400 as pos, ln(1 + p0) as lmc from fl join captures using (entity))"""


@query("p7_engineered_features", FLOWED + """ select entity, round(b / (b + s + 1e-9::double), 6) as buy_share_60s, round(s5 / (b5 + s5 + 1e-9::double), 6) as sell_pressure_5m, round(ln(1 + b), 6) as log1p_buy_vol_60s,
    round(sign(b - s) * ln(1 + abs(b - s)), 6) as log1p_net_buy_vol_60s, round(bc / (bc + sc + 1e-9::double), 6) as buy_count_share_60s, round(ut / (tc + 1e-9::double), 6) as unique_traders_per_trade,
    round(b / (b5 + 1e-9::double), 6) as buy_vol_60s_over_5m, round(bc / (bc5 + 1e-9::double), 6) as buy_count_60s_over_5m, round(b / (age + 1), 6) as buy_vol_per_age_60s, round(b * pos, 4) as buy_vol_x_mc_band, round(ln(1 + b) * lmc, 6) as log_buy_vol_x_log_mc from fw""")
def _(s, d):
    names = ["buy_share_60s", "sell_pressure_5m", "log1p_buy_vol_60s", "log1p_net_buy_vol_60s", "buy_count_share_60s", "unique_traders_per_trade", "buy_vol_60s_over_5m", "buy_count_60s_over_5m", "buy_vol_per_age_60s", "log_buy_vol_x_log_mc"]
    out = sc.engineered(_flow(s, d))
    return out.select("entity", *[F.round(c, 6).alias(c) for c in names], F.round("buy_vol_x_mc_band", 4).alias("buy_vol_x_mc_band"))


WEIGHTS = {"buy_vol_usd_60s": 2.0, "age_s": -0.5, "net_sol_curve": 1.0, "creator_prior_mints_7d": -1.0}
LITE = FLOWED + ", li as (select entity, b, ln(1 + least(greatest(b, 0), 1e7::double)) / 10 as f1, ln(1 + least(age, 86400)) / 10 as f2, least(greatest((b - s) / 1000, -85), 85) / 85 as f3, ln(1 + least(bc, 100)) / 5 as f4, bc, s from fw)"


def _lite(s, d):
    rows = _flow(s, d).withColumn("age_s", F.col("time_since_first_trade_s")).withColumn("net_sol_curve", (F.col("buy_vol_usd_60s") - F.col("sell_vol_usd_60s")) / 1000).withColumn("creator_prior_mints_7d", F.col("buy_count_60s"))
    missing = ("sniper_vol_share_5s", "top1_buyer_vol_share", "top5_buyer_vol_share", "progress_curve_proxy", "creator_prior_mints_30d")
    return rows.withColumns({c: F.lit(None).cast("double") for c in missing})


@query("p8_lite_inputs", LITE + " select entity, round(f1, 6) as buy_vol_usd_60s, round(f2, 6) as age_s, round(f3, 6) as net_sol_curve, round(f4, 6) as creator_prior_mints_7d, 0.0::double as top1_buyer_vol_share from li")
def _(s, d):
    phi = sc.lite_inputs()
    return _lite(s, d).select("entity", *[F.round(phi[c], 6).alias(c) for c in ("buy_vol_usd_60s", "age_s", "net_sol_curve", "creator_prior_mints_7d", "top1_buyer_vol_share")])


@query("m7_lite_score", LITE + " select entity, round(1 / (1 + exp(-((-1.5::double + 2 * f1 - 0.5::double * f2 + f3 - f4) / 1.5::double))), 6) as score, list_extract([0.1, 0.35, 0.65, 0.9]::double[], 1 + (b >= 500)::int + (s between 100 and 50000)::int + (bc <= 1)::int) as rules from li")
def _(s, d):
    rows = sc.lite_score(_lite(s, d), WEIGHTS, -1.5, 1.5)
    rules = sc.rule_score([F.col("buy_vol_usd_60s") >= 500, F.col("sell_vol_usd_60s").between(100, 50000), F.col("buy_count_60s") <= 1])
    return rows.select("entity", F.round("score", 6).alias("score"), rules.alias("rules"))


@query("m9_multi_lane", PREDS + " select entity, score as a_score, score * 0.5::double as b_score, score >= 0.4 as a_pass, score * 0.5::double >= 0.3::double as b_pass, (score >= 0.4)::int + (score * 0.5::double >= 0.3::double)::int as n_pass from preds")
def _(s, d):
    return sc.lanes(predictions(s, d).select("entity", "score"), {"a": (F.col("score"), 0.4), "b": (F.col("score") * 0.5, 0.3)}).drop("score")


@query("m4_recommend_band", PREDS + """, t as (select unnest([0.1, 0.3, 0.5, 0.7])::double as threshold), b as (select threshold, count(*) filter (score >= threshold) as entries, coalesce(sum(y) filter (score >= threshold), 0)::bigint as hits, round(coalesce(sum(y) filter (score >= threshold), 0) / nullif(count(*) filter (score >= threshold), 0), 6) as "precision", round(coalesce(sum(y) filter (score >= threshold), 0) / sum(y), 6) as recall from preds, t group by threshold)
  select *, case when "precision" >= 0.85 and hits >= 20 then 'precision_max_hits' else 'fallback_best_precision' end as policy from b where "precision" is not null
  order by case when "precision" >= 0.85 and hits >= 20 then 2 when entries >= 50 then 1 else 0 end desc, case when "precision" >= 0.85 and hits >= 20 then hits else "precision" end desc, hits desc limit 1""")
def _(s, d):
    return sc.recommend_band(ev.threshold_sweep(predictions(s, d), [0.1, 0.3, 0.5, 0.7]))


@query("a31_strategy_compare", PREDS + """, f as (select fold::varchar as fold, round(avg(score), 6) as score, round(avg(y), 6) as rate from preds group by fold)
  select f.*, round(f.score - b.score, 6) as delta_score, round(f.rate - b.rate, 6) as delta_rate, abs(round(f.score - b.score, 6)) < 0.005 and abs(round(f.rate - b.rate, 6)) < 0.005 as prefer_simpler from f, (select * from f where fold = '0') b""")
def _(s, d):
    folds = predictions(s, d).groupBy(F.col("fold").cast("string").alias("fold")).agg(F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("y"), 6).alias("rate"))
    return sc.compare_to_baseline(folds, "fold", "0", ["score", "rate"])


@query("a31_strategy_rules", PREDS + """, r as (select *, case when multiple is not null then (least(multiple, 10) - 1 - 0.015::double)::decimal(18,6) end as r from preds), s as (select 'all' as strategy, * from r union all select 'score', * from r where score >= 0.4 union all select 'early', * from r where fold < 2 and score >= 0.2 union all select 'none', * from r where score > 9),
  n as (select unnest(['all', 'score', 'early', 'none']) as strategy), a as (select n.strategy, count(s.entity) as n, avg(y) as hit_rate, coalesce(sum(r), 0)::double as cum_r, (sum(r) / nullif(count(r), 0))::double as mean_r from n left join s using (strategy) group by 1)
  select a.strategy, a.n, round(a.hit_rate, 6) as hit_rate, round(a.cum_r, 4) as cum_r, round(a.mean_r, 4) as mean_r, a.n - b.n as delta_n, round(a.hit_rate - b.hit_rate, 4) as delta_hit_rate, round(a.cum_r - b.cum_r, 4) as delta_cum_r, round(a.mean_r - b.mean_r, 4) as delta_mean_r from a, (select * from a where strategy = 'all') b""")
def _(s, d):
    rows = ev.strategy_returns(predictions(s, d)).withColumn("r", F.col("r_cap"))
    out = sc.strategy_compare(rows, {"all": F.lit(True), "score": F.col("score") >= 0.4, "early": (F.col("fold") < 2) & (F.col("score") >= 0.2), "none": F.col("score") > 9}, "all")
    digits = {"hit_rate": 6} | dict.fromkeys(("cum_r", "mean_r", "delta_hit_rate", "delta_cum_r", "delta_mean_r"), 4)
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("a33_candidate_vs_last", PREDS + """, l as (select count(*) as n, max(score) as m, round(avg(score), 6) as a, round(avg((score >= 0.4)::int), 6) as h from preds where fold < 2), n as (select count(*) as n, max(score) as m, round(avg(score), 6) as a, round(avg((score >= 0.4)::int), 6) as h from preds where fold >= 2)
  select l.n as last_n, l.m as last_max, l.a as last_mean, l.h as last_high, n.n as new_n, n.m as new_max, n.a as new_mean, n.h as new_high,
    case when n.h >= l.h and n.a >= l.a then 'better' when n.h < l.h and n.a < l.a then 'worse' else 'mixed' end as verdict from l, n""")
def _(s, d):
    p = predictions(s, d)
    return sc.score_lift(p.where("fold < 2"), p.where("fold >= 2"), 0.4)


@query("p11_repair_sol", FLOWED + """, z as (select entity, b5, s5, b, case when entity % 3 = 0 then (b5 - s5) / 150 else 0 end as total, case when entity % 5 = 0 then 1.0::double else 0 end as curve from fw),
  y as (select *, curve = 0 and total = 0 and (b5 > 0 or s5 > 0) as need from z)
  select entity, round(case when need then (b5 - s5) / 120 else total end, 8) as net_sol_total, round(case when need then (b5 - s5) / 120 when curve = 0 and total <> 0 then total else curve end, 8) as net_sol_curve,
    round(least(greatest(case when need then (b5 - s5) / 120 when curve = 0 and total <> 0 then total else curve end / 85, 0), 2), 8) as progress, round(case when b > 0 then b / 120 else 0 end, 8) as max_buy_sol from y""")
def _(s, d):
    e = F.col("entity")
    rows = _flow(s, d).select("entity", F.col("buy_vol_usd_5m").alias("buy_vol_usd_total"), F.col("sell_vol_usd_5m").alias("sell_vol_usd_total"), F.col("buy_vol_usd_60s").alias("max_buy_usd"), F.lit(0.0).alias("max_buy_sol"), F.lit(None).cast("double").alias("progress_curve_proxy"))
    rows = rows.withColumn("net_sol_total", F.when(e % 3 == 0, (F.col("buy_vol_usd_total") - F.col("sell_vol_usd_total")) / 150).otherwise(0.0)).withColumn("net_sol_curve", F.when(e % 5 == 0, 1.0).otherwise(0.0))
    out = sc.repair_sol(rows, 120.0)
    return out.select("entity", *[F.round(c, 8).alias(c) for c in ("net_sol_total", "net_sol_curve", "max_buy_sol")], F.round("progress_curve_proxy", 8).alias("progress"))


@query("p13_resolve_label", PREDS + " select entity, coalesce(case when fold > 0 then y end, (score >= 0.4)::int) as label, case when fold > 0 then 'primary' else 'proxy' end as label_source from preds")
def _(s, d):
    return rl.resolve_label(predictions(s, d), F.when(F.col("fold") > 0, F.col("y")), F.col("score") >= 0.4).select("entity", "label", "label_source")


@query("j13_outlier_join", PREDS + " select entity, coalesce(case when entity % 4 = 0 then multiple > 1.1 end, false) as outlier from preds")
def _(s, d):
    p = predictions(s, d)
    side = p.where("entity % 4 = 0").select("entity", (F.col("multiple") > 1.1).alias("outlier"))
    return sc.outlier_join(p.select("entity"), side, ["outlier"])


@query("j16_resolve_priors", """, st as (select entity, entity % 10 as prior from creates where entity % 3 = 0), co as (select creator, count(*) as prior from creates where creator <> 'Brand#11' group by 1),
  c as (select c.entity, case when c.entity % 7 > 0 then k.creator end as creator from captures c join creates k using (entity))
  select c.entity, c.creator, coalesce(s.prior, o.prior, case when c.creator is not null then 0 end) as prior, case when s.prior is not null then 'store' when o.prior is not null then 'cohort' when c.creator is not null then 'empty' else 'none' end as prior_source
  from c left join st s using (entity) left join co o on o.creator = c.creator""")
def _(s, d):
    made = creates(s, d)
    rows = captured(s, d).select("entity").join(made.select("entity", F.when(F.col("entity") % 7 > 0, F.col("creator")).alias("creator")), "entity")
    store = made.where("entity % 3 = 0").select("entity", (F.col("entity") % 10).alias("prior"))
    cohort = made.where("creator <> 'Brand#11'").groupBy("creator").agg(F.count("*").alias("prior"))
    return sc.resolve_priors(rows, store, cohort)


@query("j18_compare_implied_price", """select t.entity, count(*) as n, round(min(usd::double / nullif(tok * q.price, 0)), 8) as least, round(max(usd::double / nullif(tok * q.price, 0)), 8) as most from trades t join quotes q on q.ts = t.ts - t.ts % 86400 group by t.entity""")
def _(s, d):
    from vantage.sources.bindings import quotes

    out = rl.compare_implied(trades(s, d), quotes(s, d))
    return out.withColumns({c: F.round(c, 8) for c in ("least", "most")})


@query("j20_merge_by_capture", "select 'c' || entity as capture_id, t0, venue0, p0, t0 as feature_ts from captures where entity % 2 = 0")
def _(s, d):
    c = captured(s, d).withColumn("capture_id", F.concat(F.lit("c"), F.col("entity").cast("string")))
    return sc.merge_by_capture(c.select("capture_id", "t0", "venue0"), c.where("entity % 2 = 0"), ["p0"])


@query("a13_relabel_two_sources", PRICED + """, own as (select c.entity, max(price) as own from captures c join priced p on p.entity = c.entity and p.ts > c.t0 and p.ts <= c.t0 + 15552000 group by 1),
  pk as (select entity, ts as pts, price as peak from (select *, row_number() over (partition by entity order by price desc, ts) as r from priced where price is not null) where r = 1),
  j as (select c.entity, c.p0, own, case when pts >= c.t0 - 3600 then peak end as outside from captures c left join own using (entity) left join pk using (entity))
  select entity, greatest(own, outside) as top, case when greatest(own, outside) is null then 'none' when own is null or outside > own then 'peak' else 'trades' end as source, coalesce(greatest(own, outside) >= 1.3::double * p0, false) as hit from j""")
def _(s, d):
    p = priced(s, d).where("entity is not null and price is not null").select("entity", "ts", "price").repartition("entity")  # one shuffle for both sources
    peaks = p.groupBy("entity").agg(F.max(F.struct(F.col("price"), -F.col("ts"))).alias("m")).select("entity", F.col("m.price").alias("peak"), (-F.col("m.col2")).alias("peak_ts"))
    return sc.relabel(captured(s, d), p, peaks, 180 * DAY, 1.3)


@query("w2_buy_ordinal", """select entity, l_orderkey, l_linenumber, row_number() over (partition by entity order by ts, usd desc, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as nth, ts - first as after from (select *, min(ts) over (partition by entity) as first from pit) where side = 'buy'""")
def _(s, d):
    return ft.buy_ordinal(pit(s, d)).select("entity", "id.l_orderkey", "id.l_linenumber", F.col("nth").cast("long").alias("nth"), "after")


@query("w3_trader_rank", """, tr as (select entity, trader, coalesce(sum(usd) filter (side = 'buy'), 0) as bu, sum(case when side = 'buy' then tok else -tok end) as net from pit group by all)
  select entity, trader, row_number() over (partition by entity order by bu desc, trader) as r, row_number() over (partition by entity order by net desc, trader) as q from tr""")
def _(s, d):
    return ft.trader_ranks(ft.per_trader(pit(s, d), {})).select("entity", "trader", F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"))


@query("w5_first_create", "select creator, min(created) as created, arg_min(entity, row(created, entity)) as entity from creates group by creator")
def _(s, d):
    return ev.latest(creates(s, d), ["creator"], F.col("created"), F.col("entity")).select("creator", "created", "entity")


@query("w10_capture_first_band", PRICED + f""", e as (select entity, max(ts) as last from trades group by 1), b as (select *, row_number() over (partition by entity {NTH}) as r from priced where price * 1e9 between 1.05e12 and 1.4e12), f as (select * from b where r = 1),
  k as (select entity, min(created) as seen from creates where entity % 3 = 0 group by 1), u as (select coalesce(e.entity, k.entity) as entity, last, seen from e full join k on k.entity = e.entity)
  select u.entity, coalesce(f.ts, seen, last) as t0, coalesce(f.price * 1e9, 0) as mc, case when f.ts is not null then 'HIGH' else 'LOW' end as quality, f.ts is not null as refined, (f.ts is not null)::int as n_window, 0::bigint as tradeable,
    case when f.ts is not null then 'first_band' else 'no_band_trade' end as detail from u left join f on f.entity = u.entity""")
def _(s, d):
    sightings = creates(s, d).where("entity % 3 = 0").select("entity", F.col("created").alias("seen"))
    return rl.capture_first_band(trades(s, d), 1050e9, 1400e9, sightings=sightings)


@query("w10_capture_aligned", PRICED + f""", m as (select entity, min(created) as created from creates group by 1), p as (select priced.*, price * 1e9 as mc, min(ts) over (partition by entity) as first from priced),
  r as (select p.*, created, ts - created as age, ts - first as since from p left join m using (entity)), b as (select *, coalesce(age >= 86400, false) or since >= 86400 or coalesce(age between 0 and 86399, false) as ok from r where mc between 1.05e12 and 1.4e12),
  fx as (select *, row_number() over (partition by entity {NTH}) as r from b where ok), ax as (select *, row_number() over (partition by entity {NTH}) as r from b), a1 as (select * from ax where r = 1), f1 as (select * from fx where r = 1),
  nw as (select f1.entity, count(*)::int as n from f1 join p on p.entity = f1.entity and p.ts between f1.ts - 86400 and f1.ts group by 1), e as (select entity, min(ts) as first from p group by 1)
  select e.entity, coalesce(f1.ts, a1.ts, e.first) as t0, coalesce(f1.mc, a1.mc, 0) as mc, case when f1.ts is not null then 'MED' when a1.ts is not null then 'LOW' else 'REJECT' end as quality, f1.ts is not null as refined, coalesce(nw.n, 0) as n_window,
    coalesce(case when f1.age >= 86400 then f1.age when f1.since >= 86400 then f1.since else f1.age end, 0)::bigint as tradeable, case when f1.ts is not null then 'aligned' when a1.ts is not null then 'too_young' else 'never_in_band' end as detail
  from e left join f1 using (entity) left join a1 on a1.entity = e.entity left join nw on nw.entity = e.entity""")
def _(s, d):
    path = priced(s, d).where("price is not null").select("entity", "ts", "id", "mc")
    return rl.capture_aligned(path, creates(s, d), 1050e9, 1400e9, 86400, "jupiter")


@query("w10_capture_sighting", """, m as (select entity, min(created) as created from creates where entity % 5 > 0 group by 1), r as (select c.entity, t0 as seen, p0 as mc, venue0 = 'pumpswap' as complete, created, t0 - created as age from captures c left join m using (entity)),
  t as (select *, case when complete then 'graduated' when not mc between 1100 and 1400 then 'mc_out_of_band' when age < 0 then 'create_after_t0' end as rej, case when created is null then 'missing_create' when age > 8640000 then 'age_above_most' end as low from r)
  select entity, seen as t0, mc, case when rej is not null then 'REJECT' when low is not null then 'LOW' else 'MED' end as quality, rej is null and low is null as refined, 0 as n_window,
    case when rej in ('graduated', 'mc_out_of_band') then 0 else coalesce(age, 0) end::bigint as tradeable, coalesce(rej, low, 'sighting') as detail from t""")
def _(s, d):
    seen = captured(s, d).select("entity", F.col("t0").alias("seen"), F.col("p0").alias("mc"), (F.col("venue0") == "pumpswap").alias("complete"))
    return rl.capture_sighting(seen, creates(s, d).where("entity % 5 > 0"), 1100.0, 1400.0, 100 * DAY)


@query("w11_curve_path", f"""select entity, count(*) as n, round(max(c), 7) as top from (select entity, greatest(30 + sum(case when side = 'buy' then (usd::double / 150)::decimal(18,6) else -(usd::double / 150)::decimal(18,6) end) over (partition by entity {NTH} rows unbounded preceding), 0.000000001)::double as c from trades) group by entity""")
def _(s, d):
    rows = trades(s, d).withColumn("base", F.col("base").cast("decimal(18,6)"))
    return cap.curve_path(rows).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max(F.col("reserve").cast("double")), 7).alias("top"))


@query("w15_batch_rank", PREDS + " select entity, fold, row_number() over (partition by fold order by score desc, t0, entity) as rank from preds")
def _(s, d):
    return ev.rank_topk(predictions(s, d), ["fold"], 1 << 30).select("entity", "fold", F.col("rank").cast("long").alias("rank"))


@query("l3_week_cap", PREDS + f", k as (select y, {WEEK} as w, count(*) as k from preds group by all), t as (select *, sum(k) over (partition by y) as t from k) select y, w as week, case when t <= 300 then k else k * 300 // t end::bigint as n from t where n > 0")
def _(s, d):
    out = sc.week_cap(predictions(s, d), "y", 300, "entity")
    return out.groupBy("y", F.floor((F.col("t0") + 259200) / 604800).alias("week")).agg(F.count("*").alias("n"))


@query("l5_forced_include", "select count(*) as n, 60 as most, count(*) filter (entity % 50 = 0) as n_forced from (select * from captures where entity % 50 = 0 union all (select * from captures where entity % 50 <> 0 limit (select greatest(0, 60 - count(*)) from captures where entity % 50 = 0)))")
def _(s, d):
    out = sc.forced_sample(captured(s, d), F.col("entity") % 50 == 0, F.col("venue0") == "pumpswap", 60, "entity")
    return out.agg(F.count("*").alias("n"), F.lit(60).alias("most"), F.count_if(F.col("entity") % 50 == 0).alias("n_forced"))


@query("l6_random_matched_baseline", PREDS + ", seeds as (select unnest([1, 2, 3]) as seed) select seed, fold, least(20, count(*)) as n from preds, seeds group by all")
def _(s, d):
    p = predictions(s, d)
    return sc.matched_baseline(p, ev.rank_topk(p, ["fold"], 20), "fold", "entity", [1, 2, 3]).groupBy("seed", "fold").agg(F.count("*").alias("n"))


@query("u1_union_samples", "select entity, t0, 'a' as sample from captures where entity % 2 = 0 union all select entity, t0, 'b' from captures where entity % 3 = 0")
def _(s, d):
    c = captured(s, d).select("entity", "t0")
    return cmp.union_samples({"a": c.where("entity % 2 = 0"), "b": c.where("entity % 3 = 0")})


@query("n2_frontend_trades", """select entity, ts, side, round(usd::double, 4) as usd, round(tok * 1.5::double, 4) as tok, round(usd::double / 150, 6) as base, trader::varchar as trader from pit""")
def _(s, d):
    rows = pit(s, d).withColumns({c: F.col(c) + LATER for c in ("ts", "t0")})
    raw = lambda c, k: F.struct(F.round(c * 10**k).cast("long").cast("string").alias("raw"), F.lit(k).alias("decimals"))
    flat = F.col("entity") % 2 == 0
    payload = F.to_json(F.struct(
        F.when(~flat, F.col("ts") * 1000.0).alias("blockTimeMs"), F.when(flat, F.col("ts").cast("string")).alias("timestamp"), F.when(~flat, F.col("side")).alias("side"), F.when(flat, F.col("side") == "buy").alias("is_buy"),
        F.when(~flat, F.col("usd").cast("string")).alias("valueUsd"), F.when(flat, F.col("usd").cast("string")).alias("amount_usd"), F.when(~flat, (F.col("usd").cast("double") / 150).cast("string")).alias("valueNative"),
        F.when(flat, (F.col("usd").cast("double") / 150).cast("string")).alias("sol_amount"), raw(F.col("tok") * 1.5, 6).alias("baseAmount"), F.when(~flat, F.struct(F.col("trader").cast("string").alias("address"))).alias("trader"), F.when(flat, F.col("trader").cast("string")).alias("user"),
    ))
    out = nz.frontend_trades(rows.select("entity", "t0", payload.alias("payload")))
    return out.select("entity", (F.col("ts") - LATER).alias("ts"), "side", F.round("usd", 4).alias("usd"), F.round("tok", 4).alias("tok"), F.round("base", 6).alias("base"), "trader")


@query("n6_replay_legs", """select entity, count(*) filter (trader is not null) as n_traders, sum(case when side = 'buy' then 1 else 0 end)::bigint as n_buys, count(*) as n_legs from (
  select entity, trader, side from trades union all select entity, trader + 1, side from trades where entity % 2 = 0) group by entity""")
def _(s, d):
    leg = F.struct(F.col("trader").cast("string").alias("trader"), "side", F.col("base").alias("base"))
    rows = trades(s, d).select("entity", "ts", F.col("trader").cast("string").alias("trader"), "side", "base", F.when(F.col("entity") % 3 == 0, F.array(leg)).alias("breakdown"), F.when(F.col("entity") % 2 == 0, F.array((F.col("trader") + 1).cast("string"))).alias("extra"))
    return nz.replay_legs(rows).groupBy("entity").agg(F.count("trader").alias("n_traders"), F.count_if(F.col("side") == "buy").alias("n_buys"), F.count("*").alias("n_legs"))


@query("n8_cache_schema", """select p_partkey as entity, case when p_size % 5 = 0 then 'keys,null_trades' when p_size % 5 = 1 then 'null_trades' when p_size % 5 = 2 then 'time' else '' end as problems from part""")
def _(s, d):
    from vantage.sources.bindings import table

    k = F.col("p_size") % 5
    good = F.concat(F.lit('{"mint":"m","trades":[{"ts":'), F.col("p_partkey").cast("string"), F.lit(',"amount_usd":1}]}'))
    payload = F.when(k == 0, "nope").when(k == 1, '{"mint":"m","trades":null}').when(k == 2, '{"mint":"m","trades":[{"amount_usd":2}]}').otherwise(good)
    return nz.cache_problems(table(s, d, "part").select(F.col("p_partkey").alias("entity"), payload.alias("payload")))


@query("p18_parse_event_time", "select entity, ts from pit")
def _(s, d):
    t = F.timestamp_seconds(F.col("ts") + LATER)
    told = F.element_at(F.array((F.col("ts") + LATER).cast("string"), ((F.col("ts") + LATER) * 1000).cast("string"), F.date_format(t, "yyyy-MM-dd HH:mm:ss' UTC'"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")), (F.col("entity") % 4 + 1).cast("int"))
    return pit(s, d).select("entity", (nz.event_time(told) - LATER).alias("ts"))


@query("p19_map_project", "select entity, case when entity % 3 = 0 then 'pumpswap' when entity % 3 = 1 then 'pumpdotfun' else 'other' end as project from captures")
def _(s, d):
    program = F.element_at(F.array(F.lit("PUMP_AMM"), F.lit("pump.fun program"), F.lit("raydium")), (F.col("entity") % 3 + 1).cast("int"))
    return captured(s, d).select("entity", nz.map_project(program, {"pump_amm": "pumpswap", "pump": "pumpdotfun"}).alias("project"))
