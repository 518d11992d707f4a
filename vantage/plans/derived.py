"""Registered queries over row gates, comparisons and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import capture as cap
from vantage.operators import compare as cmp
from vantage.operators import labels as lb
from vantage.operators import ordered as od
from vantage.operators import rules as rl
from vantage.plans.registry import PREDS, PRICED, captured, pit, predictions, priced, query
from vantage.sources.bindings import BAND, creates, quotes, table, trades

LONG = ", long as (select entity, count(*) as n, sum(case when side = 'buy' then tok else -tok end) as net, max(age) as oldest, max(usd) filter (side = 'buy' and age <= 15552000)::double as max_buy from pit group by entity)"


def _long(s, d):
    buy = F.col("side") == "buy"
    recent = F.max(F.when(buy & (F.col("age") <= 15552000), F.col("usd"))).cast("double")
    return pit(s, d).groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.when(buy, F.col("tok")).otherwise(-F.col("tok"))).alias("net"), F.max("age").alias("oldest"), recent.alias("max_buy"))


@query("p3_suffix_filter", "select entity, count(*) as n from trades where entity::varchar like '%7' group by entity")
def _(s, d):
    return rl.suffix_filter(trades(s, d), "entity", "7").groupBy("entity").agg(F.count("*").alias("n"))


@query("p4_reserve_price_mc", "select p_partkey as entity, case when p_size > 2 and p_retailprice > 0 then (p_size - 2) / p_retailprice end as price, round(1 - p_size / 50.0::double, 6) as progress from part")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("entity"), (F.col("p_size") - 2).alias("vs"), F.col("p_retailprice").alias("vt"), F.col("p_size").alias("rt"), F.lit(50.0).alias("rt0"))
    return cmp.reserve_price(rows).select("entity", "price", F.round("progress", 6).alias("progress"))


@query("p9_progress_proxy", LONG + " select entity, round(least(greatest(net / 85, 0), 2), 6) as progress from long")
def _(s, d):
    return _long(s, d).select("entity", F.round(cmp.clip(F.col("net") / 85, 0.0, 2.0), 6).alias("progress"))


@query("p10_usd_legs", """select t.entity, count(q.price) as n_priced, count(*) filter (tok * q.price > 5000) as n_large
  from trades t left join quotes q on q.ts = t.ts - t.ts % 86400 group by t.entity""")
def _(s, d):
    legs = rl.usd_legs(trades(s, d).withColumn("units", F.col("tok") * 1000), quotes(s, d), "units", 1000.0)
    return legs.groupBy("entity").agg(F.count("quote").alias("n_priced"), F.count_if(F.col("leg_usd") > 5000).alias("n_large"))


@query("p16_completeness_flags", LONG + " select entity, max_buy is not null or n < 3 as complete from long")
def _(s, d):
    return _long(s, d).select("entity", cmp.complete(["n", "net", "oldest", "max_buy"], ["max_buy"], F.col("n") < 3).alias("complete"))


@query("p21_hard_reject", LONG + " select entity, n between 2 and 40 and coalesce(max_buy between 500 and 60000, false) as hard_ok, n between 2 and 40 and coalesce(max_buy between 500 and 60000, true) as soft_ok from long")
def _(s, d):
    ranges = {"n": (2, 40), "max_buy": (500, 60000)}
    return _long(s, d).select("entity", cmp.in_ranges(ranges, False).alias("hard_ok"), cmp.in_ranges(ranges, True).alias("soft_ok"))


@query("p22_robust_distance", LONG + """, st as (select quantile_cont(oldest, 0.5) as m1, quantile_cont(oldest, 0.75) - quantile_cont(oldest, 0.25) as s1,
    quantile_cont(max_buy, 0.5) as m2, quantile_cont(max_buy, 0.75) - quantile_cont(max_buy, 0.25) as s2 from long)
  select entity, round((coalesce(abs(oldest - m1) / (s1 / 1.35::double), 3) + coalesce(abs(max_buy - m2) / (s2 / 1.35::double), 3)) / 2, 5) as distance from long, st""")
def _(s, d):
    rows = _long(s, d)
    return cmp.robust_distance(rows, ["oldest", "max_buy"]).select("entity", F.round("distance", 5).alias("distance"))


@query("p26_sanity_filter", PRICED + "select entity, count(*) as n from priced where price > 0 and price <= 1500 and price * 1e9 <= 1.4e12 group by entity")
def _(s, d):
    return rl.sanity_filter(priced(s, d), 1500.0, 1.4e12).groupBy("entity").agg(F.count("*").alias("n"))


@query("p27_fill_price_after_fee", "select entity, p0 * (1 + 125 / 10000.0::double) as fill_price from captures")
def _(s, d):
    return captured(s, d).select("entity", rl.fill_price(F.col("p0")).alias("fill_price"))


@query("j11_merge_flow_fill0", ", f as (select entity, count(*) as sells from pit where side = 'sell' and age <= 15552000 group by entity) select c.entity, coalesce(sells, 0)::bigint as sells from captures c left join f using (entity)")
def _(s, d):
    flow = pit(s, d).where("side = 'sell' and age <= 15552000").groupBy("entity").agg(F.count("*").alias("sells"))
    return cmp.merge_fill(captured(s, d).select("entity"), flow, "entity", ["sells"])


@query("j12_attach_label", PREDS + " select l.entity, l.n, p.y from (select entity, count(*) as n from pit group by entity) l join preds p using (entity)")
def _(s, d):
    return cmp.attach_label(_long(s, d).select("entity", "n"), predictions(s, d), "entity", "y")


def _scores(s, d):
    p = predictions(s, d)
    return p, p.where("entity % 10 <> 3").withColumn("score", F.round(F.col("score") + (F.col("entity") % 3) * 0.001, 4))


RECON = PREDS + """, fresh as (select entity, round(score + (entity % 3) * 0.001::double, 4) as score from preds where entity % 10 <> 3),
  rec as (select p.entity, p.score as stored, f.score as fresh, abs(p.score - f.score) as delta from preds p left join fresh f using (entity))"""


@query("j17_reconcile_scores", RECON + " select entity, stored, fresh, round(delta, 6) as delta from rec")
def _(s, d):
    return cmp.reconcile(*_scores(s, d), "entity", "score").withColumn("delta", F.round("delta", 6))


@query("a25_delta_summary", RECON + """ select count(*) as n, count(delta) as n_both, round(max(delta), 6) as largest, round(quantile_cont(delta, 0.5), 6) as median,
  round(quantile_cont(delta, 0.95), 6) as p95, count(*) filter (delta > 1e-6) as above_small, count(*) filter (delta > 1e-4) as above_large from rec""")
def _(s, d):
    out = cmp.delta_summary(cmp.reconcile(*_scores(s, d), "entity", "score"))
    return out.withColumns({c: F.round(c, 6) for c in ("largest", "median", "p95")})


@query("j21_prior_coverage", "select count(*) as n, round(avg((k.entity is not null)::int), 6) as covered from captures c left join (select distinct entity from creates where created <= 9131 * 86400 + 86400 * 200) k using (entity)")
def _(s, d):
    out = rl.prior_coverage(captured(s, d), creates(s, d).where(F.col("created") <= 9131 * 86400 + 86400 * 200))
    return out.withColumn("covered", F.round("covered", 6))


@query("a12_label_from_peak", PRICED + "select c.entity, coalesce(max(price) >= 1.2::double * any_value(p0), false) as hit from captures c left join priced p on p.entity = c.entity and p.ts > c.t0 group by c.entity")
def _(s, d):
    return lb.peak_hit(captured(s, d), priced(s, d).where("price is not null"), 1.2)


@query("a14_band_outcome_labels", PRICED + """select c.entity, c.t0, max(price) as max_after, count(price) > 0 and bool_or(coalesce(p.venue = 'pumpswap', false)) as reached
  from captures c left join priced p on p.entity = c.entity and p.ts > c.t0 group by all""")
def _(s, d):
    return rl.band_outcome(captured(s, d), priced(s, d))


@query("a18_coverage", "select (select count(*) from captures) as n_keys, count(*) as n_expected, round((select count(*) from captures) / count(*), 6) as coverage, (select count(*) from captures) >= 0.995::double * count(*) as complete from creates")
def _(s, d):
    return rl.key_coverage(creates(s, d), captured(s, d)).withColumn("coverage", F.round("coverage", 6))


@query("a20_compare_distributions", LONG + """, v as (select case when entity % 2 = 0 then 'left' else 'right' end as side, unnest([{'f': 'n', 'v': n::double}, {'f': 'max_buy', 'v': max_buy}]) as x from long)
  select x.f as feature, side, count(*) as n, round(avg(x.v), 3) as mean, round(median(x.v), 5) as median, round(avg((x.v is null)::int), 6) as null_rate from v group by all""")
def _(s, d):
    rows = _long(s, d)
    out = cmp.compare_distributions(rows.where("entity % 2 = 0"), rows.where("entity % 2 = 1"), ["n", "max_buy"])
    return out.withColumns({"mean": F.round("mean", 3), "median": F.round("median", 5), "null_rate": F.round("null_rate", 6)})


@query("a22_score_gate_backtest", PREDS + " select count(*) as n, count(*) filter (score >= 0.4) as n_pass, round(count(*) filter (score >= 0.4) / count(*), 6) as pass_rate, max(score) as largest, list_sort(list(score))[count(*) // 2 + 1] as upper_median from preds")
def _(s, d):
    return cmp.score_gate(predictions(s, d), 0.4).withColumn("pass_rate", F.round("pass_rate", 6))


@query("a27_score_by_outcome", PREDS + " select y, count(*) as n, min(score) as least, max(score) as most, round(median(score), 6) as median from preds group by y")
def _(s, d):
    return rl.score_by_outcome(predictions(s, d)).withColumn("median", F.round("median", 6))


@query("a28_replay_scan", PRICED + """select entity, min(price) as least, max(price) as most, min(ts) filter (price between 1000 and 1400) as first_band, min(ts) filter (price >= 1600) as first_hit,
  count(*) as n, string_agg(distinct venue, ',' order by venue) as venues, min(ts) as seen_from, max(ts) as seen_to from priced group by entity""")
def _(s, d):
    rows = priced(s, d).where("price is not null")
    return cmp.replay_scan(rows, cap.in_band(F.col("price"), *BAND), F.col("price") >= 1600)


@query("a30_cost_sensitivity", PREDS + " select cost, count(multiple) as n, round(avg(case when multiple is not null then least(multiple, 10) - 1 end) - cost, 5) as mean_r from preds, (select unnest([0.005, 0.015, 0.03])::double as cost) group by cost")
def _(s, d):
    return cmp.cost_sensitivity(predictions(s, d), [0.005, 0.015, 0.03]).withColumn("mean_r", F.round("mean_r", 5))


@query("l8_newest", "select entity, t0 from captures order by t0 desc, entity limit 100")
def _(s, d):
    return rl.newest(captured(s, d).select("entity", "t0"), 100)


@query("u2_union_by_name", ", k as (select entity, created from creates) select coalesce(c.entity, k.entity) as entity, c.t0, case when c.entity is null then k.created end as created from captures c full join k on c.entity = k.entity")
def _(s, d):
    return cmp.union_first([captured(s, d).select("entity", "t0"), creates(s, d).select("entity", "created")], "entity")


@query("u4_spearman", PREDS + """, k as (select entity, score, round(multiple, 1) as m from preds where multiple is not null), n as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as a, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2 as b from k)
  select count(*) as n, round(corr(a, b), 9) as spearman from n""")
def _(s, d):
    return od.spearman(predictions(s, d).withColumn("m", F.round("multiple", 1)), "score", "m").withColumn("spearman", F.round("spearman", 9))


@query("u4_accept_set_overlap", PREDS + """ select case when score >= 0.3 and entity % 3 = 0 then 'both' when score >= 0.3 then 'only_a' when entity % 3 = 0 then 'only_b' else 'none' end as part,
  count(*) as n, round(avg(y), 6) as "precision" from preds group by 1""")
def _(s, d):
    return cmp.accept_overlap(predictions(s, d), F.col("score") >= 0.3, F.col("entity") % 3 == 0).withColumn("precision", F.round("precision", 6))
