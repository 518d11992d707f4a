"""The registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.operators import capture as cap
from vantage.operators import evaluate as ev
from vantage.operators import features as ft
from vantage.operators import labels as lb
from vantage.operators import ordered as od
from vantage.operators import rules as rl
from vantage.operators import samples as sm
from vantage.sources.bindings import BAND, DAY, SQL, creates, events, quotes, table, trades
from vantage.sources.shared import materialize

W = {"30d": 30 * DAY, "180d": 180 * DAY}
H = {"90d": 90 * DAY, "180d": 180 * DAY, "365d": 365 * DAY}

#: Order of the trades of an entity.
NTH = "order by ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql is appended to the common table expressions."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = SQL + sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def captured(s: SparkSession, d: str) -> DataFrame:
    return cap.first_in_band(trades(s, d), *BAND)


def pit(s: SparkSession, d: str) -> DataFrame:
    return cap.pit_join(captured(s, d), trades(s, d))


def priced(s: SparkSession, d: str) -> DataFrame:
    return cap.implied_mc(trades(s, d))


def labelled(s: SparkSession, d: str) -> DataFrame:
    """Written once, a row for each capture: quantiles, ranks and curves over it read it several times."""
    return materialize(lb.forward_labels(captured(s, d), priced(s, d), H), "labelled")


def predictions(s: SparkSession, d: str) -> DataFrame:
    """entity, t0, score, y, multiple, fold: a score from the key, blended with the label."""
    y = F.coalesce(F.col("hit_365d").cast("int"), F.lit(0))
    score = F.round((F.col("entity") * 7919 % 1000) / 2000.0 + y * 0.3, 4)
    return labelled(s, d).select("entity", "t0", score.alias("score"), y.alias("y"), F.col("multiple_365d").alias("multiple"), (F.col("entity") % 5).alias("fold"))


PRICED = ", priced as (select *, usd::double / tok as price from trades where tok <> 0)"
LABELS = PRICED + """, lab as (select c.entity, c.t0, c.p0,
  max(case when ts <= t0 + 31536000 then price end) as m365, min(case when ts <= t0 + 31536000 and price >= 10 * p0 then ts - t0 end) as time_365d,
  max(case when ts <= t0 + 15552000 then price end) as m180, min(case when ts <= t0 + 15552000 and price >= 10 * p0 then ts - t0 end) as time_180d,
  max(case when ts <= t0 + 7776000 then price end) as m90, min(case when ts <= t0 + 7776000 and price >= 10 * p0 then ts - t0 end) as time_90d
  from captures c left join priced p on p.entity = c.entity and p.ts > c.t0 and p.ts <= c.t0 + 31536000 group by all),
labelled as (select entity, t0, p0, time_90d, time_180d, time_365d,
  round(m90 / p0, 6) as multiple_90d, case when m90 is not null then time_90d is not null end as hit_90d,
  round(m180 / p0, 6) as multiple_180d, case when m180 is not null then time_180d is not null end as hit_180d,
  round(m365 / p0, 6) as multiple_365d, case when m365 is not null then time_365d is not null end as hit_365d from lab)"""
PREDS = LABELS + """, preds as (select entity, t0, round((entity * 7919 % 1000) / 2000.0::double + coalesce(hit_365d::int, 0) * 0.3::double, 4) as score,
  coalesce(hit_365d::int, 0) as y, multiple_365d as multiple, entity % 5 as fold from labelled)"""


@query("w1_first_in_band", "select entity, t0, p0, venue0 from captures")
def _(s, d):
    return captured(s, d)


@query("n1_normalize_swaps", """select entity, count(*) as n, sum(case when side = 'buy' then 1 else 0 end)::bigint as buys, sum(usd)::double as usd
  from trades where usd >= 1 and tok > 0 group by entity""")
def _(s, d):
    buy = F.col("side") == "buy"
    name = F.col("entity").cast("string")
    pairs = trades(s, d).select(F.when(buy, name).otherwise("SOL").alias("bought"), F.when(buy, F.lit("SOL")).otherwise(name).alias("sold"), F.when(buy, F.col("tok")).otherwise(F.col("base")).alias("bought_amount"), F.when(buy, F.col("base")).otherwise(F.col("tok")).alias("sold_amount"), "usd")
    return cap.normalize_swaps(pairs).groupBy(F.col("entity").cast("long").alias("entity")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "buy").alias("buys"), F.sum("usd").cast("double").alias("usd"))


@query("p1_implied_mc", PRICED + "select entity, count(*) as n, round(max(price), 6) as max_price, round(max(price * 1e9) / 1e9, 6) as max_mc_bn from priced group by entity")
def _(s, d):
    return priced(s, d).where("price is not null").groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max("price"), 6).alias("max_price"), F.round(F.max("mc") / 1e9, 6).alias("max_mc_bn"))


@query("p2_band_filter", "select entity, count(*) as n from banded group by entity")
def _(s, d):
    return priced(s, d).where(cap.in_band(F.col("price"), *BAND)).groupBy("entity").agg(F.count("*").alias("n"))


@query("p6_t0_features", "select entity, t0, round((p0 - 1000) / 400, 6) as band_pos, round(ln(1 + p0), 6) as log1p_p0, (venue0 = 'pumpdotfun')::int as is_pumpdotfun from captures")
def _(s, d):
    return rl.t0_features(captured(s, d), *BAND).withColumns({"band_pos": F.round("band_pos", 6), "log1p_p0": F.round("log1p_p0", 6)})


@query("p14_capture_id", "select entity, t0, substring(sha256(entity || '|' || t0 || '|v1'), 1, 32) as capture_id from captures")
def _(s, d):
    return captured(s, d).select("entity", "t0", rl.capture_id(F.col("entity"), F.col("t0")).alias("capture_id"))


@query("j1_pit_join", "select entity, t0, count(*) as n, max(age) as oldest, min(age) as newest from pit group by all")
def _(s, d):
    return pit(s, d).groupBy("entity", "t0").agg(F.count("*").alias("n"), F.max("age").alias("oldest"), F.min("age").alias("newest"))


@query("j2_time_bounds", "select count(*) as n, min(ts) as lo, max(ts) as hi from trades where ts between (select min(t0) - 604800 from captures) and (select max(t0) from captures)")
def _(s, d):
    lo, hi = cap.time_bounds(captured(s, d), 7 * DAY)
    return trades(s, d).where(F.col("ts").between(lo, hi)).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("j3_semi_keys", "select entity, count(*) as n from trades where entity in (select entity from captures) group by entity")
def _(s, d):
    return cap.semi_keys(trades(s, d), captured(s, d)).groupBy("entity").agg(F.count("*").alias("n"))


@query("j5_minute_lookup", """select t.entity, count(*) as n, count(q.price) as matched, (count(*) - count(q.price)) as missed
  from trades t left join quotes q on q.ts = t.ts - t.ts % 86400 group by t.entity""")
def _(s, d):
    return cap.minute_lookup(trades(s, d), quotes(s, d)).groupBy("entity").agg(F.count("*").alias("n"), F.count("quote").alias("matched"), (F.count("*") - F.count("quote")).alias("missed"))


@query("j6_asof_join", """select c.entity, c.t0, case when c.t0 - q.ts <= 86400 then q.ts end as quote_ts, case when c.t0 - q.ts <= 86400 then round(q.price, 6) end as quote
  from captures c asof left join quotes q on c.t0 >= q.ts""")
def _(s, d):
    out = cap.as_of_quotes(captured(s, d).select("entity", "t0"), quotes(s, d), at="t0")
    return out.select("entity", "t0", "quote_ts", F.round("quote", 6).alias("quote"))


SERIES = """, q1 as (select (o_orderdate::date - date '1970-01-01') * 86400 + 43200 as ts, max(o_totalprice) / 1000 as price from orders where dayofyear(o_orderdate) % 5 < 2 group by 1),
  q2 as (select (o_orderdate::date - date '1970-01-01') * 86400 as ts, max(o_totalprice) / 500 as price from orders where dayofyear(o_orderdate) % 3 = 0 group by 1),
  q3 as (select (o_orderdate::date - date '1970-01-01') * 86400 as ts, max(o_totalprice) / 250 as price from orders where day(o_orderdate) in (1, 11) group by 1),
  a as (select c.entity, c.t0, case when entity % 17 = 0 then 150.0::double when entity % 17 = 1 then -1.0::double end as own, q1.ts as t1, q1.price as p1 from captures c asof left join q1 on c.t0 >= q1.ts),
  b as (select a.*, q2.ts as t2, q2.price as p2 from a asof left join q2 on a.t0 >= q2.ts), x as (select b.*, q3.ts as t3, q3.price as p3 from b asof left join q3 on b.t0 >= q3.ts),
  s as (select *, case when own > 0 then 'explicit' when t0 - t1 <= 50000 then 'noon' when t0 - t2 <= 86400 then 'third_day' when t0 - t3 <= 432000 then 'tenth_day' else 'default' end as quote_source from x)"""


@query("j6_asof_chain", SERIES + """select entity, t0, quote_source, case quote_source when 'noon' then t1 when 'third_day' then t2 when 'tenth_day' then t3 end as quote_ts,
  round(case quote_source when 'explicit' then own when 'noon' then p1 when 'third_day' then p2 when 'tenth_day' then p3 else 99.5::double end, 6) as quote from s""")
def _(s, d):
    o = table(s, d, "orders")
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    series = lambda keep, shift, by: o.where(keep).groupBy((day + shift).alias("ts")).agg((F.max("o_totalprice") / by).alias("price"))
    chain = [("noon", series(F.dayofyear("o_orderdate") % 5 < 2, 43200, 1000), 50000), ("third_day", series(F.dayofyear("o_orderdate") % 3 == 0, 0, 500), DAY), ("tenth_day", series(F.dayofmonth("o_orderdate").isin(1, 11), 0, 250), 5 * DAY)]
    own = F.when(F.col("entity") % 17 == 0, 150.0).when(F.col("entity") % 17 == 1, -1.0)
    out = cap.as_of_chain(captured(s, d).select("entity", "t0", own.alias("own")), chain, at="t0", explicit="own", default=99.5)
    return out.select("entity", "t0", "quote_source", "quote_ts", F.round("quote", 6).alias("quote"))


@query("j7_create_join", """select c.entity, c.t0, k.creator, c.t0 - k.created as age, coalesce(length(k.name), 0)::bigint as name_len
  from captures c left join creates k on k.entity = c.entity and k.created <= c.t0""")
def _(s, d):
    return lb.create_join(captured(s, d), creates(s, d))


@query("p20_age_from_create", """select c.entity, c.t0 - k.created as age, case when k.created is null then 'missing' when c.t0 < k.created then 'create_after_t0'
  when c.t0 - k.created > 31536000 then 'age_gt_max' else '' end as reason, coalesce(c.t0 - k.created between 0 and 31536000, false) as ok from captures c left join creates k using (entity)""")
def _(s, d):
    return lb.create_age(captured(s, d), creates(s, d), 365 * DAY)


GRADUATED = ", grads as (select entity, min(ts) as graduated from trades where venue = 'pumpswap' group by entity)"


@query("j8_creator_graduates", GRADUATED + """, own as (select c.entity, c.t0, k.creator from captures c join creates k using (entity)),
  met as (select o.entity, (o.t0 - g.graduated) // 86400 as days from own o join creates k on k.creator = o.creator and k.entity <> o.entity and k.created < o.t0
    join grads g on g.entity = k.entity and g.graduated >= k.created and g.graduated <= o.t0),
  n as (select entity, count(*) as a, count(*) filter (days <= 7) as d7, count(*) filter (days <= 30) as d30 from met group by 1)
  select o.entity, coalesce(d7, 0) as graduates_d7, coalesce(d30, 0) as graduates_d30, coalesce(a, 0) as graduates_all from own o left join n using (entity)""")
def _(s, d):
    grads = trades(s, d).where("venue = 'pumpswap'").groupBy("entity").agg(F.min("ts").alias("graduated"))
    return lb.creator_graduates(captured(s, d), creates(s, d), grads)


@query("j9_buyer_history", """, buyers as (select distinct entity, t0, trader from pit where side = 'buy'),
  seen as (select b.entity, b.trader, count(*) as n from buyers b join trades t on t.trader = b.trader and t.side = 'buy' and t.entity <> b.entity
    and t.ts >= b.t0 - 2592000 and t.ts < b.t0 group by all)
  select b.entity, count(*) as buyers, count(n) as with_history, coalesce(sum(n), 0)::bigint as history from buyers b left join seen s on s.entity = b.entity and s.trader = b.trader group by b.entity""")
def _(s, d):
    return lb.buyer_history(pit(s, d), trades(s, d), 30 * DAY)


def _flow_sql(name: str, w: int) -> str:
    inside = f"age between 0 and {w}"
    out = []
    for side in ("buy", "sell"):
        c = f"{inside} and side = '{side}'"
        out.append(f"count(*) filter ({c}) as {side}_n_{name}, coalesce(sum(usd) filter ({c}), 0)::double as {side}_usd_{name}, count(distinct trader) filter ({c}) as {side}ers_{name}")
    return ", ".join(out)


FLOW = ", ".join(_flow_sql(n, w) for n, w in W.items()) + ", count(*) filter (side = 'buy') as buy_n, count(*) filter (side = 'sell') as sell_n, max(age) as oldest"


@query("a1_flow_windows", f"select entity, t0, {FLOW} from pit group by entity, t0")
def _(s, d):
    return ft.flow_windows(pit(s, d), W)


SNIPER = """, sn as (select *, ts - min(ts) over (partition by entity) as after from pit),
  sb as (select *, row_number() over (partition by entity order by ts, usd desc, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as nth from sn where side = 'buy'),
  sniper as (select entity, t0, max(usd) filter (nth = 1)::double as first_buy_usd, coalesce(sum(usd) filter (nth <= 5), 0)::double as usd_first_5, coalesce(sum(usd) filter (nth <= 10), 0)::double as usd_first_10,
    coalesce(sum(usd) filter (after <= 2592000), 0)::double as usd_within_0, coalesce(sum(usd) filter (after <= 7776000), 0)::double as usd_within_1,
    count(*) filter (after <= 2592000) as buys_within_0, count(*) filter (after <= 7776000) as buys_within_1 from sb group by all)"""
CONC = """, tr as (select entity, t0, trader, count(*) filter (side = 'buy') as bn, coalesce(sum(usd) filter (side = 'buy'), 0) as bu, sum(case when side = 'buy' then tok else -tok end) as net from pit group by all),
  rk as (select *, row_number() over (partition by entity order by bu desc, trader) as r, row_number() over (partition by entity order by net desc, trader) as q, greatest(net, 0) as held from tr),
  conc as (select entity, t0, count(*) filter (held > 0) as holders, count(*) filter (bn > 0) as buyers, """ + ", ".join(
    f"case when sum(bu) > 0 then round(sum(bu) filter (r <= {n})::double / sum(bu)::double, 6) end as top{n}_buy_share, case when sum(held) > 0 then round(sum(held) filter (q <= {n}) / sum(held), 6) end as top{n}_held_share" for n in (1, 5, 10)) + " from rk group by all)"


@query("a3_sniper_stats", SNIPER + "select * from sniper")
def _(s, d):
    return ft.sniper_stats(pit(s, d))


@query("a4_concentration", CONC + "select * from conc")
def _(s, d):
    return ft.concentration(pit(s, d))


@query("a5_microstructure_pack", SNIPER + CONC + f""", flow as (select entity, t0, {FLOW} from pit group by entity, t0),
  tot as (select entity, t0, coalesce(sum(usd) filter (side = 'buy'), 0)::double as buy_usd, coalesce(sum(usd) filter (side = 'sell'), 0)::double as sell_usd, max(usd) filter (side = 'buy')::double as max_buy_usd from pit group by all)
  select flow.*, buy_usd, sell_usd, max_buy_usd, sniper.* exclude (entity, t0), conc.* exclude (entity, t0), round(buy_usd - sell_usd, 4) as net_usd,
    case when buy_usd > 0 then round(coalesce(usd_within_0, 0) / buy_usd, 6) end as sniper_share, case when buy_usd > 0 then round(coalesce(usd_first_5, 0) / buy_usd, 6) end as first5_share,
    case when buy_usd > 0 then round(coalesce(max_buy_usd, 0) / buy_usd, 6) end as max_buy_share
  from flow join tot using (entity) left join sniper using (entity) left join conc using (entity)""")
def _(s, d):
    return ft.microstructure_pack(pit(s, d), W)


@query("a6_repriced_usd_pack", """, rp as (select p.*, q.price as quote from pit p left join quotes q on q.ts = p.ts - p.ts % 86400)
  select entity, t0, coalesce(sum((usd::double / 150 * quote)::decimal(28,6)) filter (age between 0 and 15552000 and quote is not null), 0)::double as usd,
    count(*) filter (age between 0 and 15552000 and quote is not null) as n, count(*) filter (quote is null) as missing, round(median(quote), 10) as median_quote from rp group by all""")
def _(s, d):
    return ft.repriced_pack(pit(s, d), quotes(s, d), W["180d"], cap.minute_lookup).withColumn("median_quote", F.round("median_quote", 10))


@query("a7_peak_vwap", """, sl as (select entity, ts - ts % 86400 as slot, sum(usd)::double / sum(tok) as vwap from trades where tok > 0 group by all)
  select entity, round(max(vwap), 6) as peak, arg_max(slot, row(vwap, -slot)) as peak_slot, count(*) as slots, count(*) filter (vwap >= 2000) as above from sl group by entity""")
def _(s, d):
    return ft.peak_vwap(trades(s, d))


@query("a8_buy_volume", """select c.entity, c.t0, coalesce(sum(usd) filter (side = 'buy' and age between 0 and 2592000), 0)::double as buy_usd, count(*) filter (side = 'buy' and age between 0 and 2592000) as buy_n
  from captures c left join pit p using (entity) group by c.entity, c.t0""")
def _(s, d):
    return ft.buy_volume(captured(s, d), pit(s, d), W["30d"])


@query("a9_replay_flow", """, w as (select * from pit where age between 0 and 15552000)
  select c.entity, c.t0, count(*) filter (side = 'buy') as buys, count(*) filter (side = 'sell') as sells, coalesce(sum(usd) filter (side = 'buy'), 0)::double as buy_usd, coalesce(sum(usd) filter (side = 'sell'), 0)::double as sell_usd,
    count(distinct trader) filter (side = 'buy') as buyers, count(distinct trader) filter (side = 'sell') as sellers, arg_max(venue, row(ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) as last_venue, max(age) as oldest,
    round(coalesce(sum(usd) filter (side = 'buy'), 0)::double / greatest(coalesce(sum(usd) filter (side = 'sell'), 0)::double, 1e-12::double), 2) as ratio, count(ts) = 0 as missing
  from (select * from captures union all select entity + 1000000000, t0, p0, venue0 from captures) c left join w on w.entity = c.entity group by c.entity, c.t0""")
def _(s, d):
    seen = captured(s, d)  # and as many captures of entities that have no events
    both = seen.unionByName(seen.withColumn("entity", F.col("entity") + 1000000000))
    return ft.replay_flow(both, pit(s, d), W["180d"])


@query("a10_forward_labels", LABELS + "select * from labelled")
def _(s, d):
    return labelled(s, d)


@query("a11_label_base_rates", LABELS + " select h as horizon, count(hit) as n, round(avg(hit::int), 6) as rate from (" + " union all ".join(f"select '{h}' as h, hit_{h} as hit from labelled" for h in H) + ") group by h")
def _(s, d):
    return lb.base_rates(labelled(s, d), list(H))


@query("a15_cohort_funnel", LABELS + """, st as (select count(*) as a, count(*) filter (venue0 = 'pumpdotfun') as b, count(*) filter (venue0 = 'pumpdotfun' and hit_365d is not null) as c from labelled join captures using (entity))
  select 0 as step, 'captured' as name, a as n_in, a as n_out, 0 as n_dropped from st union all select 1, 'venue', a, b, a - b from st union all select 2, 'labelled', b, c, b - c from st""")
def _(s, d):
    rows = labelled(s, d).join(captured(s, d).select("entity", "venue0"), "entity")
    return ev.cohort_funnel(rows, [("captured", F.lit(True)), ("venue", F.col("venue0") == "pumpdotfun"), ("labelled", F.col("hit_365d").isNotNull())])


@query("a16_class_by_week", LABELS + " select (t0 + 259200) // 604800 as week, count(*) filter (hit_365d) as pos, count(*) filter (not hit_365d) as neg, count(*) filter (hit_365d is null) as unknown from labelled group by 1")
def _(s, d):
    return ev.class_by_week(labelled(s, d).select("t0", F.col("hit_365d").cast("int").alias("y")))


@query("a17_null_rates", LABELS + " select 'multiple_90d' as feature, round(avg((multiple_90d is null)::int), 6) as null_rate from labelled union all select 'time_365d', round(avg((time_365d is null)::int), 6) from labelled")
def _(s, d):
    return ev.null_rates(labelled(s, d), ["multiple_90d", "time_365d"])


@query("a19_distribution_profile", LABELS + ", x as (select 'p0' as feature, p0 as v from labelled union all select 'multiple_365d', multiple_365d from labelled) select feature, count(*) as n, round(avg(v), 5) as mean, round((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.35::double, 6) as scale, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) as p{p:02d}" for p in (5, 25, 50, 75, 95)) + " from x where v is not null group by feature")
def _(s, d):
    return ev.distribution(labelled(s, d), ["p0", "multiple_365d"]).withColumns({"mean": F.round("mean", 5), "scale": F.round("scale", 6)})


@query("a21_feature_delta", """, a as (select entity, count(*) filter (age <= 2592000) as n, max(age) filter (age <= 2592000) as oldest from pit group by entity),
  b as (select entity, count(*) filter (age <= 15552000) as n, max(age) filter (age <= 15552000) as oldest from pit group by entity)
  select entity, 'n' as feature, a.n::double as "left", b.n::double as "right", (b.n - a.n)::double as delta from a join b using (entity)
  union all select entity, 'oldest', a.oldest::double, b.oldest::double, (b.oldest - a.oldest)::double from a join b using (entity)""")
def _(s, d):
    p = pit(s, d)
    side = lambda w: p.groupBy("entity").agg(F.count_if(F.col("age") <= w).alias("n"), F.max(F.when(F.col("age") <= w, F.col("age"))).alias("oldest"))
    return ev.feature_delta(side(W["30d"]), side(W["180d"]), ["n", "oldest"])


@query("a23_threshold_sweep", PREDS + ", t as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9])::double as threshold) select threshold, count(*) filter (score >= threshold) as entries, coalesce(sum(y) filter (score >= threshold), 0)::bigint as hits, case when count(*) filter (score >= threshold) > 0 then round(coalesce(sum(y) filter (score >= threshold), 0) / count(*) filter (score >= threshold), 6) end as precision, round(coalesce(sum(y) filter (score >= threshold), 0) / sum(y), 6) as recall from preds, t group by threshold")
def _(s, d):
    return ev.threshold_sweep(predictions(s, d), [0.1, 0.3, 0.5, 0.7, 0.9])


@query("a26_followup_peak", PRICED + """, ap as (select p.*, c.p0, max(price) over (partition by p.entity order by ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding) as before
    from priced p join captures c on p.entity = c.entity and p.ts > c.t0)
  select entity, ts, round(price / p0, 6) as multiple, price >= 10 * p0 as hit from ap where before is null or price > before""")
def _(s, d):
    return lb.followup_peak(captured(s, d), priced(s, d).where("price is not null"))


STRAT = PREDS + """, top as (select * from (select *, row_number() over (partition by fold order by score desc, t0, entity) as rank from preds) where rank <= 20),
  ret as (select *, case when multiple is not null then (least(multiple, 10) - 1 - 0.015::double)::decimal(18,6) end as r from top),
  cum as (select *, coalesce(sum(r) over (partition by fold order by t0, entity rows unbounded preceding), 0) as c from ret),
  fall as (select *, c - max(c) over (partition by fold order by t0, entity rows unbounded preceding) as f from cum)"""


@query("a29_strategy_summary", STRAT + " select fold, count(*) as n, count(r) as n_returns, round(avg(y), 6) as hit_rate, round(sum(r)::double, 4) as cum_r, round(sum(r)::double / count(r), 5) as mean_r, round(min(f)::double, 4) as drawdown from fall group by fold")
def _(s, d):
    return ev.strategy_summary(ev.strategy_returns(ev.rank_topk(predictions(s, d), ["fold"], 20)), ["fold"])


@query("w8_cum_drawdown", STRAT + " select entity, t0, fold, round(c::double, 4) as cum, round(f::double, 4) as fall from fall")
def _(s, d):
    out = ev.cum_drawdown(ev.strategy_returns(ev.rank_topk(predictions(s, d), ["fold"], 20)), ["fold"], "r_cap")
    return out.select("entity", "t0", "fold", F.round(F.col("cum").cast("double"), 4).alias("cum"), F.round(F.col("fall").cast("double"), 4).alias("fall"))


@query("a36_event_coverage", "select c.entity, count(t.ts) as n_after, min(t.ts) as first_after, max(t.ts) as last_after from captures c left join trades t on t.entity = c.entity and t.ts > c.t0 group by c.entity")
def _(s, d):
    return rl.event_coverage(captured(s, d), trades(s, d))


@query("a38_catalogue_features", """, g as (select *, ts - lag(ts) over (partition by entity order by ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as gap from pit),
  a as (select entity, t0, round(var_pop(gap), 2) as gap_var, round(sum(usd) filter (age <= 15552000)::double / sum(tok) filter (age <= 15552000) / any_value(p0), 6) as vwap_vs_p0 from g group by all),
  tr as (select entity, trader, sum(case when side = 'buy' then tok else -tok end) as net from pit group by all having net > 0),
  gi as (select entity, 2 * sum(i * net) / (count(*) * sum(net)) - (count(*) + 1) / count(*) as gini from (select *, row_number() over (partition by entity order by net, trader) as i from tr) group by entity)
  select a.*, round(gini, 6) as gini from a left join gi using (entity)""")
def _(s, d):
    return ft.catalogue_features(pit(s, d), W["180d"])


@query("a38_curve_catalogue", """, g as (select entity, t0, ts, max(usd::double / tok) as p from pit where tok <> 0 group by all), st as (select *, coalesce(lead(ts) over (partition by entity order by ts), t0) as until from g),
  ti as (select entity, coalesce(sum(until - ts) filter (p >= 1100), 0)::bigint as time_in_band, any_value(t0) - coalesce(max(until) filter (p < 1100), min(ts)) as time_above from st group by entity),
  su as (select entity, t0, any_value(p0) as p0, sum(case when side = 'buy' then usd else -usd end)::double as nu, sum(case when side = 'buy' then tok else -tok end) as nt, max(usd::double / 150.0::double) filter (side = 'buy' and age <= 15552000) as mb from pit group by all)
  select su.entity, t0, coalesce(time_in_band, 0) as time_in_band, coalesce(time_above, 0) as time_above, round(mb, 6) as max_buy_base, round(nu / 150, 6) as liq_real, round(nu / p0 / 1e6, 9) as liq_over_mc, round((30000 + nu / 150) * (5000 - nt) / 1e6, 6) as inv_k, round((4000 - nt) / 1e6, 9) as curve_share from su left join ti using (entity)""")
def _(s, d):
    out = ft.curve_catalogue(pit(s, d), 1100.0, W["180d"], 150.0, 30000.0, 5000.0, 4000.0, 1e6)
    rounded = {"max_buy_base": F.round("max_buy_base", 6), "liq_real": F.round("liq_real", 6), "liq_over_mc": F.round("liq_over_mc", 9), "inv_k": F.round(F.col("inv_k") / 1e6, 6), "curve_share": F.round("curve_share", 9)}
    return out.withColumns(rounded)


PRIOR = """select entity, created, (count(*) over (partition by creator order by created range between {r} preceding and current row) - {less}) as {n}"""


@query("w4_creator_priors", """, k as (select *, count(*) over (partition by creator, created) as peers, row_number() over (partition by creator, created order by entity) as place from creates)
  select entity, created, count(*) over (partition by creator order by created range between 604800 preceding and current row) - (peers - place + 1) as prior_d7,
    count(*) over (partition by creator order by created range between 2592000 preceding and current row) - (peers - place + 1) as prior_d30,
    count(*) over (partition by creator order by created range between unbounded preceding and current row) - (peers - place + 1) as prior_all from k""")
def _(s, d):
    return lb.creator_priors(creates(s, d))


@query("w4_creator_priors_strict", """select entity, created, (select count(*) from creates b where b.creator = a.creator and b.created < a.created and b.created >= a.created - 604800) as prior_d7,
    (select count(*) from creates b where b.creator = a.creator and b.created < a.created and b.created >= a.created - 2592000) as prior_d30,
    (select count(*) from creates b where b.creator = a.creator and b.created < a.created) as prior_all from creates a""")
def _(s, d):
    return lb.creator_priors(creates(s, d), strict=True)


FOLDS = """, ix as (select entity, t0, row_number() over (order by t0, entity) - 1 as idx, count(*) over () as n from captures),
  ed as (select k + 1 as fold, floor(round(0.4::double + 0.12::double * k, 9) * n)::bigint as lo, floor(round(0.4::double + 0.12::double * (k + 1), 9) * n)::bigint as hi from (select distinct n from ix), range(5) r(k)),
  cu as (select ed.*, ix.t0 as cut from ed join ix on ix.idx = ed.lo),
  folds as (select entity, t0, fold::int as fold, case when idx >= lo then 'test' else 'train' end as part from ix join cu on idx < hi and (idx >= lo or t0 < cut))"""


@query("w6_expanding_folds", FOLDS + "select * from folds")
def _(s, d):
    return ev.expanding_folds(captured(s, d))


ONE_CUT = """, fr as (select entity, t0, (entity % 3 = 0)::int as y from captures), ix as (select *, row_number() over (order by t0, entity) - 1 as idx, count(*) over () as n from fr),
  e as (select any_value(n) as n, greatest(min(idx) filter (y = 1), min(idx) filter (y = 0)) + 1 as lo, least(max(idx) filter (y = 1), max(idx) filter (y = 0)) as hi, floor(any_value(n) * 0.7::double)::bigint as pl from ix),
  c as (select case when least(pl, hi) >= lo and least(pl, hi) > greatest(pl - 40, n // 2) then least(pl, hi) else pl end as cut from e)
  select entity, t0, 1 as fold, case when idx < cut then 'train' else 'test' end as part from ix, c"""


@query("w6_single_cut", ONE_CUT)
def _(s, d):
    rows = captured(s, d).select("entity", "t0", (F.col("entity") % 3 == 0).cast("int").alias("y"))
    return ev.folds_or_cut(rows, "y", least_rows=10**9)


@query("w7_embargo_fold", """, v as (select min(t0) as lo, max(t0) as hi from captures where t0 > 852076800 + 2592000 and t0 <= 883612800)
  select entity, t0, case when t0 <= 852076800 and t0 + 15552000 <= lo then 'train' when t0 > 852076800 + 2592000 and t0 <= 883612800 then 'val' when t0 > hi + 2592000 and t0 <= 915148800 then 'test' end as part
  from captures, v where part is not null""")
def _(s, d):
    return ev.embargo_split(captured(s, d).select("entity", "t0"), 852076800, 883612800, 915148800, 30 * DAY, 180 * DAY)


@query("w9_capture_detector", PRICED + f""", k as (select entity, min(created) as created from creates group by 1), g as (select entity, min(ts) as graduated from trades where venue = 'pumpswap' group by 1),
  tp as (select p.*, k.created, case when tok <> 0 then usd::double / tok end as price, min(ts) over (partition by p.entity) as first, case when l_suppkey % 3 = 0 then 'pyth' else 'jupiter' end as source from trades p left join k using (entity)),
  rk as (select *, coalesce(ts - created >= 2592000, false) or ts - first >= 2592000 as old from tp),
  fit as (select * from (select *, row_number() over (partition by entity {NTH}) as rn from rk where price between 1000 and 1400 and old) where rn = 1),
  anyb as (select * from (select *, row_number() over (partition by entity {NTH}) as rn from rk where price between 1000 and 1400) where rn = 1),
  seen as (select * from (select *, row_number() over (partition by entity {NTH}) as rn from rk where price is not null) where rn = 1)
  select e.entity, coalesce(f.ts, a.ts) as t0, coalesce(f.price, a.price) as p0,
    case when a.entity is null then 'never_in_band' when s.price > 1400 then 'first_seen_above_band' when coalesce(graduated <= coalesce(f.ts, a.ts), false) then 'graduated' when f.entity is null then 'too_young' else '' end as reason,
    case when reason in ('never_in_band', 'first_seen_above_band', 'graduated') then 'REJECT' when f.entity is null then 'LOW' when coalesce(e.first - e.created > 86400 * 300, false) then 'LOW' when f.source = 'pyth' then 'HIGH' else 'MED' end as quality
  from (select entity, min(first) as first, min(created) as created from rk group by 1) e left join fit f using (entity) left join anyb a using (entity) left join seen s using (entity) left join g using (entity)""")
def _(s, d):
    grads = trades(s, d).where("venue = 'pumpswap'").groupBy("entity").agg(F.min("ts").alias("graduated"))
    source = F.when(F.col("id.l_suppkey") % 3 == 0, "pyth").otherwise("jupiter")
    return cap.detect_captures(trades(s, d), creates(s, d), *BAND, age=30 * DAY, late=300 * DAY, source=source, graduated=grads)


@query("w12_rank_topk", PREDS + " select entity, t0, score, y, multiple, fold, rank::int as rank from (select *, row_number() over (partition by fold order by score desc, t0, entity) as rank from preds) where rank <= 20")
def _(s, d):
    return ev.rank_topk(predictions(s, d), ["fold"], 20)


@query("w13_precision_recall_at_k", PREDS + ", r as (select *, row_number() over (partition by fold order by score desc, t0, entity) as r from preds) select fold, sum(y)::bigint as pos, " + ", ".join(f"sum(y) filter (r <= {k})::bigint as hits_{k}, round(sum(y) filter (r <= {k}) / count(*) filter (r <= {k}), 6) as precision_{k}, round(sum(y) filter (r <= {k}) / sum(y), 6) as recall_{k}" for k in (10, 50)) + " from r group by fold")
def _(s, d):
    return ev.precision_recall_at_k(predictions(s, d), ["fold"], (10, 50))


@query("w14_rolling_capacity", ", r as (select event_id, entity, ts, round(value, 2) as score, ts - ts % 3600 as slot, row_number() over (partition by ts - ts % 3600 order by round(value, 2) desc, ts, event_id) as rank from ev) select event_id, entity, ts, score, slot, rank::int as rank, rank <= 5 as accepted from r")
def _(s, d):
    return ev.rolling_capacity(events(s, d).select("event_id", "entity", "ts", F.round("value", 2).alias("score")), 5, 3600)


@query("w14_trailing_capacity")
def _(s, d):
    return ev.trailing_capacity(events(s, d).select("event_id", "entity", "ts", F.round("value", 2).alias("score")), 5, 3600, 3, 60)


@query("w16_largest_remainder_alloc", ", st as (select venue as stratum, count(*) as size from trades group by 1), t as (select *, floor(1001 * size / sum(size) over ())::bigint as base, (1001 * size) % sum(size) over () as frac, sum(size) over () as total from st) select stratum, size, base + (row_number() over (order by frac desc, stratum) <= 1001 - sum(base) over ())::bigint as slots from t")
def _(s, d):
    return ev.largest_remainder(trades(s, d).groupBy(F.col("venue").alias("stratum")).agg(F.count("*").alias("size")), 1001)


@query("w17_interleave_strata", "select entity, venue0, row_number() over (partition by venue0 order by entity)::int as round from captures")
def _(s, d):
    return ev.interleave(captured(s, d).select("entity", "venue0"), ["venue0"], "entity")


@query("w18_latest_per_entity", "select entity, event_id, ts, value from (select *, row_number() over (partition by entity order by ts desc, event_id desc) as r from ev) where r = 1")
def _(s, d):
    return ev.latest(events(s, d), ["entity"], F.desc("ts"), F.desc("event_id")).select("entity", "event_id", "ts", "value")


@query("l1_stratified_sample")
def _(s, d):
    return ev.stratified_sample(captured(s, d), "venue0", 100)


L1_SQL = """, r as (select entity, (t0 + 259200) // 604800 as w, (entity % 5 = 0)::int as y from captures), sz as (select y, w, count(*) as s from r group by all),
  tot as (select coalesce(sum(s) filter (y = 1), 0) as p, coalesce(sum(s) filter (y = 0), 0) as m from sz), goal as (select least(150, p) as gp, least(m, case when p < 150 then p else 600 end) as gn from tot),
  pf as (select w, s, s * gp // sum(s) over () as q, s * gp % sum(s) over () as f, gp from sz, goal where y = 1), pq as (select w, q + (row_number() over (order by f desc, w) <= gp - sum(q) over ())::int as k from pf),
  nf as (select w, k * gn // sum(k) over () as q, k * gn % sum(k) over () as f, gn from pq, goal where k > 0), nm as (select w, q + (row_number() over (order by f desc, w) <= gn - sum(q) over ())::int as want from nf),
  nc as (select sz.w, s, least(s, coalesce(want, 0)) as c from sz left join nm using (w) where y = 0), lf as (select w, c, s - c as rest, (select gn from goal) - sum(c) over () as need, sum(s - c) over () as all_rest from nc),
  ls as (select *, case when all_rest > 0 then rest * need // all_rest else 0 end as q, case when all_rest > 0 then rest * need % all_rest else 0 end as f from lf),
  nq as (select w, c + q + (row_number() over (order by f desc, w) <= need - sum(q) over ())::int as k from ls)
  select 1 as y, w, k::bigint as n from pq where k > 0 union all select 0, w, k::bigint from nq where k > 0"""


@query("l1_mirrored_sample", L1_SQL)
def _(s, d):
    rows = captured(s, d).select("entity", "t0", (F.col("entity") % 5 == 0).cast("int").alias("y"))
    out = sm.mirrored_sample(rows, "y", 150, 600, "entity")
    return out.groupBy("y", F.floor((F.col("t0") + 3 * DAY) / (7 * DAY)).alias("w")).agg(F.count("*").alias("n"))


@query("l7_closest_to_mid", "select entity, p0 from captures order by abs(p0 - 1200), entity limit 50")
def _(s, d):
    return rl.closest_to(captured(s, d), "p0", 1200.0, 50).select("entity", "p0")


@query("m3_rank_metrics", PREDS + """, g as (select fold, score, sum(y) as p, count(*) - sum(y) as q from preds group by all),
  c as (select *, sum(p) over (partition by fold order by score desc) as tp, sum(q) over (partition by fold order by score desc) as fp from g)
  select fold, sum(p)::bigint as pos, sum(q)::bigint as neg, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) as auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) as ap, round(sum(p) / (sum(p) + sum(q)), 6) as base_rate from c group by fold""")
def _(s, d):
    return ev.rank_metrics(predictions(s, d), ["fold"])


CURVE = PREDS + """, g as (select fold, score, sum(y)::bigint as p, count(*) - sum(y)::bigint as q from preds group by all),
  c as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over f as pos, sum(q) over f as neg from g window w as (partition by fold order by score desc), f as (partition by fold))"""


@query("m3_curve_metrics", CURVE + """, b as (select *, 2 * tp / (tp + fp + pos) as f1, tp / (tp + fp) as pr, tp / pos as re from c),
  h as (select fold, sum(p * least(1, greatest(0, (pos - (tp + fp - p - q)) / (p + q)))) as h from c group by fold)
  select fold, any_value(pos)::bigint as pos, any_value(neg)::bigint as neg, round(sum(q * (tp - p / 2)) / any_value(pos * neg), 6) as auc, round(sum(p * pr) / any_value(pos), 6) as ap, round(max(f1), 6) as best_f1, arg_max(score, row(f1, -score)) as threshold,
    round(arg_max(pr, row(f1, -score)), 6) as best_precision, round(arg_max(re, row(f1, -score)), 6) as best_recall, any_value(pos)::bigint as k_natural, round(any_value(h) / any_value(pos), 6) as precision_natural, round(any_value(h) / any_value(pos), 6) as recall_natural
  from b join h using (fold) group by fold""")
def _(s, d):
    out = od.curve_metrics(predictions(s, d), ["fold"])
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "ap", "best_f1", "best_precision", "best_recall", "precision_natural", "recall_natural")})


@query("m3_rank_bands", CURVE + """, k as (select fold, pos, n, band, k from (select distinct fold, pos, pos + neg as n from c), lateral (values ('top_1.0%', greatest(1, round_even(0.01::double * n, 0))), ('top_10.0%', greatest(1, round_even(0.1::double * n, 0))), ('top_50', 50), ('top_100000000', 100000000)) v(band, k) where k <= n),
  h as (select k.fold, band, k::bigint as k, any_value(k.pos) as pos, any_value(n) as n, sum(p * least(1, greatest(0, (k - (tp + fp - p - q)) / (p + q)))) as hits from k join c using (fold) group by all)
  select fold, band, k, round(hits, 6) as hits, round(hits / k, 6) as "precision", round(hits / pos, 6) as recall, round(2 * hits / (k + pos), 6) as f1, round(hits / k * n / pos, 6) as lift from h""")
def _(s, d):
    out = od.rank_bands(predictions(s, d), ["fold"], [0.01, 0.1], [50, 100_000_000])
    return out.withColumns({c: F.round(c, 6) for c in ("hits", "precision", "recall", "f1", "lift")})


@query("m5_train_quantile_threshold", PREDS + FOLDS + " select f.fold, round(quantile_cont(score, 0.9::double), 9) as threshold from folds f join preds p using (entity) where part = 'train' group by f.fold")
def _(s, d):
    p = predictions(s, d)  # a row for each capture
    return ev.quantile_thresholds(ev.expanding_folds(p).join(p.select("entity", "score"), "entity"), 0.1)


@query("m6_strategy_returns", PREDS + " select entity, round(case when multiple is not null then least(multiple, 10) - 1 - 0.015::double end, 6) as r_cap, round(case when y = 1 then 10 - 1 - 0.015::double else -1 - 0.015::double end, 6) as r_binary, round(case when multiple is not null then least(multiple, 20) - 1 - 0.015::double end, 6) as r_wide from preds")
def _(s, d):
    return ev.strategy_returns(predictions(s, d)).select("entity", *[F.round(c, 6).alias(c) for c in ("r_cap", "r_binary", "r_wide")])


@query("j10_merge_pack", """, pk as (select entity, t0 + entity % 4 as t0, count(*) as n from pit group by entity, t0)
  select c.entity, c.t0, case when abs(c.t0 - p.t0) <= 2 then n end as n, coalesce(abs(c.t0 - p.t0) <= 2, false) as matched from captures c left join pk p using (entity)""")
def _(s, d):
    pack = pit(s, d).groupBy("entity", "t0").agg(F.count("*").alias("n")).withColumn("t0", F.col("t0") + F.col("entity") % 4)
    return ev.merge_pack(captured(s, d).select("entity", "t0"), pack, ["n"], 2)


@query("j14_anti_done", "select entity, count(*) as n from trades where entity not in (select entity from captures) group by entity")
def _(s, d):
    return rl.anti_done(trades(s, d), captured(s, d)).groupBy("entity").agg(F.count("*").alias("n"))


@query("j15_overlay_update", ", o as (select entity, entity % 3 = 0 as flag, round(p0 * 2, 6) as v from captures) select c.entity, round(case when flag then v else p0 end, 6) as p0, round(p0, 6) as p0_base, flag as overlaid from captures c join o using (entity)")
def _(s, d):
    base = captured(s, d).select("entity", F.round("p0", 6).alias("p0"))
    overlay = captured(s, d).select("entity", (F.col("entity") % 3 == 0).alias("flag"), F.round(F.col("p0") * 2, 6).alias("p0"))
    return ev.overlay_update(base, overlay, ["p0"])


@query("u3_key_set_equal", "select entity, 'left' as only_in from (select entity from trades except select entity from captures)")
def _(s, d):
    return ev.key_set_difference(trades(s, d), captured(s, d), "entity")


@query("u5_distinct_buyers", "select distinct entity, t0, trader from pit where side = 'buy'")
def _(s, d):
    return rl.distinct_buyers(pit(s, d))


@query("g1_feature_time_gate", "select entity, ts, t0, 'after_t0' as rule from (select t.entity, t.ts, c.t0 from trades t join captures c using (entity)) where ts > t0")
def _(s, d):
    return ev.future_reads(trades(s, d).join(captured(s, d), "entity").select("entity", "ts", "t0"), "ts")


@query("t6_ks_drift", """, g as (select round(value, 1) as v, count(*) filter (ts < 1705276800) as a, count(*) filter (ts >= 1705276800) as b from ev group by 1)
  select round(max(d), 6) as ks from (select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as d from g)""")
def _(s, d):
    return ev.ks_drift(events(s, d).withColumn("value", F.round("value", 1)), F.col("ts") < 1705276800, "value")


@query("a34_cycle_counters", "select ts - ts % 86400 as cycle, side, count(*) as n, count(distinct entity) as entities from ev group by all")
def _(s, d):
    return events(s, d).groupBy((F.col("ts") - F.col("ts") % DAY).alias("cycle"), "side", "entity").agg(F.count("*").alias("k")).groupBy("cycle", "side").agg(F.sum("k").alias("n"), F.count("*").alias("entities"))


from vantage.plans import completed, derived, gated, recorded, streamed  # noqa: E402, F401 - register their queries
