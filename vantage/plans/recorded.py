"""Registered queries over records, samples, audits and vendor payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import features as ft
from vantage.operators import gates as gt
from vantage.operators import normalize as nz
from vantage.operators import ordered as od
from vantage.operators import records as rc
from vantage.operators import samples as sm
from vantage.plans.derived import LONG, _long
from vantage.plans.registry import FLOW, PREDS, W, captured, pit, predictions, query
from vantage.sources.bindings import BAND, DAY, creates, events, table, trades

LATER = 1_000_000_000


def _flow_sql(name: str, age: str) -> str:
    return f"""count(*) filter (side = 'buy'{age}) as buy_n{name}, count(*) filter (side = 'sell'{age}) as sell_n{name},
  coalesce(sum(usd) filter (side = 'buy'{age}), 0)::double as buy_usd{name}, coalesce(sum(usd) filter (side = 'sell'{age}), 0)::double as sell_usd{name}"""


SIGNED = "(case when side = 'buy' then usd::double / 150 else -(usd::double / 150) end)::decimal(28,6)"


@query("a2_microstructure_flow", f"""select entity, t0, {_flow_sql('', '')}, {', '.join(_flow_sql(f'_{n}', f' and age <= {w}') + f', count(distinct trader) filter (age <= {w}) as traders_{n}' for n, w in W.items())},
  count(distinct trader) filter (side = 'buy') as buyers, count(distinct trader) filter (side = 'sell') as sellers, sum({SIGNED})::double as net_base, coalesce(sum({SIGNED}) filter (venue = 'pumpdotfun'), 0)::double as net_base_curve,
  coalesce(max(usd) filter (side = 'buy'), 0)::double as max_buy_usd, coalesce(max(usd::double / 150) filter (side = 'buy'), 0) as max_buy_base, bool_or(venue = 'pumpswap') as migrated, max(age) as oldest from pit group by entity, t0""")
def _(s, d):
    return ft.microstructure_flow(captured(s, d), pit(s, d), W)


LABELLED = ", lb as (select entity, t0, (entity % 4 = 0)::int as y from captures)"


def _classed(s, d):
    return captured(s, d).select("entity", "t0", F.when(F.col("entity") % 4 == 0, 1).otherwise(0).alias("y"))


@query("l2_stratified_cap", LABELLED + """, k as (select y, (t0 + 259200) // 604800 as w, count(*) as s from lb group by all), o as (select coalesce(sum(s) filter (y = 1), 0) as p, coalesce(sum(s) filter (y = 0), 0) as m from k),
  g as (select *, least(m, 60 - least(p, 30)) as gn from o), q as (select y, w, s, case when y = 1 then least(p, 60 - gn) else gn end as goal, case when y = 1 then p else m end as t from k, g), f as (select *, s * goal // t as b, (s * goal) % t as f from q),
  r as (select y, w as week, (b + (row_number() over (partition by y order by f desc, w) <= goal - sum(b) over (partition by y))::int)::bigint as n from f) select * from r where n > 0""")
def _(s, d):
    out = sm.stratified_cap(_classed(s, d), "y", 60, "entity")
    return out.groupBy("y", F.floor((F.col("t0") + 259200) / 604800).alias("week")).agg(F.count("*").alias("n"))


@query("l4_recency_sample", LABELLED + """, o as (select count(*) filter (y = 1) as p, count(*) filter (y = 0) as m from lb), q as (select greatest(1, least(round_even(40 * p / (p + m)::double, 0)::bigint, p, 39)) as kp, p, m from o)
  select 1 as y, kp as n from q union all select 0, least(40 - kp, m) from q""")
def _(s, d):
    return sm.recency_sample(_classed(s, d), "y", 40, "entity").groupBy("y").agg(F.count("*").alias("n"))


@query("l9_augment_sample", LABELLED + """, o as (select count(*) filter (entity % 10 = 0) as b, count(*) filter (entity % 10 <> 0 and y = 1) as p, count(*) filter (entity % 10 <> 0 and y = 0) as m from lb),
  r as (select *, greatest(90 - b, 0) as room, least(greatest(greatest(90 - b, 0) - 30, 0), p) as f from o), g as (select *, least(room - f, m) as neg from r)
  select entity % 10 = 0 as in_base, y, count(*) as n from lb where entity % 10 = 0 group by all union all select false, 1, least(room - neg, p) from g where least(room - neg, p) > 0 union all select false, 0, neg from g where neg > 0""")
def _(s, d):
    return sm.augment_sample(_classed(s, d), F.col("entity") % 10 == 0, "y", 90, 30, "entity").groupBy("in_base", "y").agg(F.count("*").alias("n"))


@query("p5_snapshot_proxies", "select p_partkey as entity, round(greatest(0, least(1, 1 - p_size / 40.0::double)), 6) as progress, round(p_retailprice::double, 4) as net_base from part")
def _(s, d):
    out = rc.snapshot_proxies(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") * 1e9, 40.0)
    return table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.round(out["progress"], 6).alias("progress"), F.round(out["net_base"], 4).alias("net_base"))


@query("p12_select_pack", f", f as (select entity, t0, {FLOW} from pit group by entity, t0) select entity, sell_n_30d, buy_n_30d from f")
def _(s, d):
    return rc.select_pack(ft.flow_windows(pit(s, d), W), ["sell_n_30d", "absent", "buy_n_30d"], ("hit_90d", "multiple_90d"))


@query("p15_meta_coalesce", """, r as (select entity, case when entity % 2 = 0 then nullif(name, '') end as n1, case when entity % 3 = 0 then nullif(name, '') end as n2, case when entity % 5 = 0 then 7 end as n3, case when entity % 3 = 1 then nullif(symbol, '') end as s1, case when entity % 7 = 0 then 4 end as s3 from creates)
  select entity, coalesce(length(n1), length(n2), n3)::double as name_len, coalesce(length(s1), s3)::double as symbol_len, coalesce(length(n1), length(n2), n3) is null as name_missing, coalesce(length(s1), s3) is null as symbol_missing,
    case when (n1 is null and n2 is null and n3 is not null) or (s1 is null and s3 is not null) then 'store' when n1 is null and n2 is not null then 'sighting' else 'create' end as meta_source from r""")
def _(s, d):
    e = F.col("entity")
    rows = creates(s, d).select("entity", F.when(e % 2 == 0, F.col("name")).alias("name"), F.when(e % 3 == 1, F.col("symbol")).alias("symbol"), F.when(e % 3 == 0, F.col("name")).otherwise("").alias("sighting_name"), F.lit("").alias("sighting_symbol"), F.when(e % 5 == 0, 7).alias("store_name_len"), F.when(e % 7 == 0, 4).alias("store_symbol_len"))
    return rc.fill_meta(rows).select("entity", "name_len", "symbol_len", "name_missing", "symbol_missing", "meta_source")


@query("p17_mask_features", "select entity, case when entity % 3 <> 0 then p0 end as p0, venue0 from captures")
def _(s, d):
    return rc.mask_features(captured(s, d), ["p0", "absent"], F.col("entity") % 3 == 0).select("entity", "p0", "venue0")


FLAGGED = PREDS + """, fg as (select entity, score, entity % 10 = 0 or entity % 7 = 0 or (entity % 3 = 0 and entity % 2 <> 0) as is_stub, t0 < 830000000 as early from preds)"""


def _flagged(s, d):
    e = F.col("entity")
    rows = predictions(s, d).select("entity", "score", F.when(e % 10 == 0, "v0_stub").otherwise("v1").alias("feature_set_version"), F.when(e % 7 == 0, "dry_run.hash_stub").otherwise("trades").alias("buy_vol_source"), F.when(e % 3 == 0, "rule_buy60").otherwise("model").alias("score_mode"), F.when(e % 2 == 0, "first").alias("t0_definition"), F.col("t0").alias("entered_at"))
    return rc.legacy_flags(rows, 830000000, "v0_stub", "dry_run.hash_stub", "rule_buy60")


@query("p24_legacy_partition", FLAGGED + " select entity, is_stub, is_stub or early as is_legacy from fg")
def _(s, d):
    return _flagged(s, d).select("entity", "is_stub", "is_legacy")


@query("a24_entry_metrics", FLAGGED + """ select count(*) as n_raw, count(*) filter (is_stub) as n_stub, count(*) filter (is_stub or early) as n_legacy, count(*) filter (not (is_stub or early)) as n_kept, count(*) filter (not (is_stub or early)) as n_scores,
  max(score) filter (not (is_stub or early)) as largest, list_sort(list(score) filter (not (is_stub or early)))[count(*) filter (not (is_stub or early)) // 2 + 1] as upper_median from fg""")
def _(s, d):
    return rc.entry_metrics(_flagged(s, d))


@query("j4_t0_single_pass", "select entity, t0, p0, count(*) as n, sum(age)::bigint as ages from pit group by all")
def _(s, d):
    return rc.first_and_before(trades(s, d), *BAND).groupBy("entity", "t0", "p0").agg(F.count("*").alias("n"), F.sum("age").alias("ages"))


@query("j19_journal_labels", PREDS + " select entity, case when entity % 4 = 0 then y end as y, entity % 4 = 0 as matched from preds")
def _(s, d):
    p = predictions(s, d)
    return rc.journal_labels(p.select("entity"), p.where("entity % 4 = 0"), "entity", "y")


@query("a37_event_audit", """, lg as (select l_orderkey as event, case when l_linestatus = 'O' then 'buy' else 'sell' end as side, l_extendedprice::double as usd, l_suppkey as trader from lineitem where l_quantity > 10),
  b as (select *, row_number() over (partition by event order by (side = 'buy') desc, usd desc, trader desc) as r, count(*) over (partition by event) as k from lg)
  select o_orderkey as event, o_orderpriority as source, o_orderdate::date <= date '1997-01-01' as le_t0, b.event is not null as parsed, coalesce(k, 0) as n_legs, side, usd, trader from orders left join b on b.event = o_orderkey and r = 1""")
def _(s, d):
    legs = table(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("event"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_extendedprice").cast("double").alias("usd"), F.col("l_suppkey").alias("trader"))
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("ts"), F.lit("1997-01-01").cast("date").alias("t0"), F.col("o_orderpriority").alias("source"))
    return rc.event_audit(rows, legs)


@query("a39_usable_geometry", LONG + """, u as (select *, entity % 2 as y from long where n >= 3), o as (select count(*) filter (n >= 100000) as nu, count(*) as nh from u), g as (select *, nu < 50 and (nh >= 50 or nh > nu) as fallback from o),
  r as (select u.*, fallback, case when fallback then nh else nu end as n_used from u, g where fallback or n >= 100000), v as (select y, fallback, n_used, unnest([{'f': 'n', 'v': n::double}, {'f': 'oldest', 'v': oldest::double}]) as x from r),
  lv as (select x.f as f, median(x.v) as m from (select unnest([{'f': 'n', 'v': n::double}, {'f': 'oldest', 'v': oldest::double}]) as x from long where entity % 5 = 0) group by 1)
  select x.f as feature, n_used, fallback, count(x.v) filter (y = 1) as pos_n, median(x.v) filter (y = 1) as pos_median, median(x.v) filter (y = 0) as neg_median, any_value(lv.m) as live_median from v left join lv on lv.f = x.f group by all""")
def _(s, d):
    rows = _long(s, d).withColumn("y", F.col("entity") % 2)
    live = rows.where("entity % 5 = 0").select(F.col("n").cast("double").alias("n"), F.col("oldest").cast("double").alias("oldest")).unpivot([], ["n", "oldest"], "feature", "v")
    live = od.exact_quantiles(live, ["feature"], "v", [0.5]).select("feature", F.col("q")[0].alias("live_median"))
    return rc.usable_geometry(rows, F.col("n") >= 100000, F.col("n") >= 3, "y", ["n", "oldest"], live, 50)


@query("g8_feature_quality", """, j as (select c.*, k.created from captures c left join creates k on k.entity = c.entity and k.entity % 3 > 0), o as (select count(*) as n, count(*) filter (p0 not between 1050 and 1400) as b, count(*) filter (created is null) as c from j)
  select 'band' as "check", n, b as n_bad, b = 0 as ok, false as soft from o union all select 'null_p0', n, 0, true, true from o union all select 'null_created', n, c, true, true from o union all select 'leak', n, 0, true, false from o union all select 'rows', n, (n < 100)::bigint, n >= 100, false from o""")
def _(s, d):
    rows = captured(s, d).join(creates(s, d).where("entity % 3 > 0").select("entity", "created"), "entity", "left")
    return gt.feature_quality(rows, ["p0", "created"], ["hit_90d"], 1050.0, 1400.0, 100)


@query("g10_window_gate", "select t.entity, t.ts, case when t.ts > t0 then 'after_t0' else 'before_window' end as rule from trades t join captures c using (entity) where t.ts > t0 or t.ts < t0 - 15552000")
def _(s, d):
    rows = trades(s, d).join(captured(s, d).select("entity", "t0"), "entity")
    return gt.window_gate(rows, 180 * DAY).select("entity", "ts", "rule")


@query("g11_candidate_sample", "select entity, 'band' as rule from captures where p0 not between 1050 and 1400")
def _(s, d):
    return gt.candidate_sample(captured(s, d).select("entity", "p0"), ("hit_90d", "multiple_90d", "max_after"), "p0", 1050.0, 1400.0)


@query("g13_journal_invariant", """select entity, unnest([x for x in [case when entity % 5 = 0 then 'age_source' end, case when entity % 7 = 0 then 'score_mode' end, case when entity % 3 = 2 then 'prior_source' end] if x is not null]) as rule from captures where t0 >= 830000000""")
def _(s, d):
    e = F.col("entity")
    rows = captured(s, d).select("entity", F.col("t0").alias("ts"), F.when(e % 5 > 0, "trades").alias("age_source"), F.when(e % 7 == 0, "skip").alias("score_mode"), F.when(e % 3 == 0, "cohort_30d").when(e % 3 == 2, "frontend").alias("creator_prior_source"))
    return gt.journal_invariant(rows, 830000000, ("trades", "snapshot"), "cohort_", "store_v1", "skip")


def _both(s, d, key):
    c = creates(s, d)
    return [c.where("entity % 2 = 0").select(key.alias("id"), F.col("name").alias("v")), c.where("entity % 3 = 0").select(key.alias("id"), F.col("symbol").alias("v"))]


@query("s5_resolve_by_priority", "select entity as id, case when entity % 2 = 0 then 0 else 1 end as source, case when entity % 2 = 0 then name else symbol end as v from creates where entity % 2 = 0 or entity % 3 = 0")
def _(s, d):
    return rc.resolve_by_priority(_both(s, d, F.col("entity")), "id")


@query("s6_dedupe_by_id", "select entity::varchar as id, case when entity % 2 = 0 then 0 else 1 end as source, case when entity % 2 = 0 then name else symbol end as v from creates where (entity % 2 = 0 or entity % 3 = 0) and entity % 11 > 0")
def _(s, d):
    return rc.dedupe_by_id(_both(s, d, F.when(F.col("entity") % 11 > 0, F.col("entity").cast("string")).otherwise("")), "id")


@query("s8_read_journal", "select event_id as entity, side as mode, ts from ev where side = 'signup' and ts >= 1704200000 order by ts desc, event_id limit 50")
def _(s, d):
    return rc.read_journal(events(s, d).select(F.col("event_id").alias("entity"), F.col("side").alias("mode"), "ts"), "signup", 1704200000, 50)


@query("k2_append_first_seen", "select entity, min(ts) as ts, arg_min(event_id, row(ts, event_id)) as event_id from ev where entity not in (select entity from ev where event_id % 97 = 0) group by entity")
def _(s, d):
    e = events(s, d).select("entity", "ts", "event_id")
    return rc.first_seen(e.where("event_id % 97 = 0"), e)


@query("k3_upsert_followup", "select entity, side, ts, event_id from (select *, row_number() over (partition by entity, side order by ts desc, event_id desc) as r from ev) where r = 1")
def _(s, d):
    return rc.latest_followup(events(s, d).select("entity", "side", "ts", "event_id"), ["entity", "side"], "ts")


@query("n3_gql_trades", """select entity::varchar as entity, ts, side, round(usd::double, 4) as usd, round(usd::double / 150, 5) as base, 't' || trader as trader, case when entity % 4 = 3 then 'pumpswap' else 'pumpdotfun' end as project from pit where usd >= 1""")
def _(s, d):
    k, usd = F.col("entity") % 4, F.col("usd").cast("double")
    base = F.when(k == 2, usd / 150 * 1e9).when(k != 1, usd / 150).cast("string")
    account = F.struct(F.concat(F.lit("t"), F.col("trader").cast("string")).alias("Address"))
    side = F.struct(F.col("side").alias("Type"), base.alias("Amount"), F.when(k % 2 == 1, account).alias("Account"))
    trade = F.struct(F.struct(F.col("entity").cast("string").alias("MintAddress")).alias("Currency"), F.when(k > 0, F.col("usd").cast("string")).alias("AmountInUSD"), F.when(k == 3, F.struct(F.lit("Pump Swap").alias("ProtocolName"))).alias("Dex"), F.when(k == 0, account).alias("Account"), side.alias("Side"))
    payload = F.to_json(F.struct(F.struct(F.col("ts").cast("string").alias("Time")).alias("Block"), F.struct(account["Address"].alias("Signer")).alias("Transaction"), trade.alias("Trade")))
    out = nz.gql_trades(pit(s, d).select(payload.alias("payload")), "curve", "swap", 150.0)
    return out.select("entity", "ts", "side", F.round("usd", 4).alias("usd"), F.round("base", 5).alias("base"), "trader", "project")


@query("n4_transfers", """, li as (select l_orderkey as o, l_linenumber as ln, l_suppkey as sk, l_quantity::double as qty, l_linenumber % 2 as tr, l_orderkey % 7 = 1 as rev from lineitem where l_orderkey % 10 > 0 and l_orderkey % 13 > 0),
  net as (select o, sum(qty) as tok, coalesce(sum(qty * 2) filter (ln <> 3), 0) as base from li where rev and tr = 1 group by o),
  buys as (select o, case when rev then 'pool' else 't' || tr end as trader, qty, ln, sk from li where o not in (select o from net)), b as (select *, row_number() over (partition by o, trader order by ln, sk, qty) as k from buys),
  p as (select o, trader, qty * 2 as base, row_number() over (partition by o, trader order by ln, sk, qty) as k from buys where ln <> 3)
  select o as tx, 'sell' as side, 't1' as trader, tok, base from net union all select b.o, 'buy', b.trader, b.qty, coalesce(p.base, 0) from b left join p on p.o = b.o and p.trader = b.trader and p.k = b.k""")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("qty")))).alias("ls"))
    move = "named_struct('mint', {m}, 'sender', if({r}, 'pool', concat('t', x.l_linenumber % 2)), 'receiver', if({r}, concat('t', x.l_linenumber % 2), 'pool'), 'amount', {a})"
    tokens = "transform(ls, x -> " + move.format(m="'m'", r="tx % 7 <> 1", a="x.qty") + ")"
    quotes = "transform(filter(ls, x -> x.l_linenumber <> 3), x -> " + move.format(m=f"'{nz.NATIVE[1]}'", r="tx % 7 = 1", a="x.qty * 2") + ")"
    rows = lines.select("tx", F.expr("if(tx % 13 = 0, 'CREATE_POOL', 'SWAP')").alias("kind"), (F.col("tx") % 10 == 0).alias("err"), F.lit("m").alias("mint"), F.lit("t1").alias("payer"), F.expr(f"concat({tokens}, {quotes})").alias("transfers"))
    return nz.transfer_legs(rows)


@query("n5_creates", f"select entity || case when entity % 3 = 1 then 'pump' else '' end as entity, creator, created + {LATER} as created, name from creates")
def _(s, d):
    e = F.col("entity").cast("string")
    k = F.col("entity") % 3
    arg = lambda name, value, kind="string": F.struct(F.lit(name).alias("Name"), F.struct(F.when(F.lit(kind == "string"), value).alias("string"), F.when(F.lit(kind == "address"), value).alias("address")).alias("Value"))
    args = F.array(arg("Name", F.col("name")), arg("Mint", F.when(k == 0, e), "address"), arg("User", F.when(F.col("entity") % 2 == 0, F.col("creator"))))
    accounts = F.when(k == 1, F.array(F.struct(F.concat(F.lit("x"), e).alias("Address")), F.struct(F.concat(e, F.lit("pump")).alias("Address")))).otherwise(F.array(F.struct(e.alias("Address"))))
    payload = F.to_json(F.struct(F.struct((F.col("created") + LATER).cast("string").alias("Time")).alias("Block"), F.struct(F.when(F.col("entity") % 2 == 1, F.col("creator")).alias("Signer")).alias("Transaction"), F.struct(accounts.alias("Accounts"), F.struct(args.alias("Arguments")).alias("Program")).alias("Instruction")))
    return nz.creates_of(creates(s, d).select(payload.alias("payload"))).select("entity", "creator", "created", "name")


@query("n7_snapshots", """, c as (select o_custkey::varchar as entity, o_orderkey as seen, o_totalprice::double as mc, 1600000000 + o_orderkey as created, round(greatest(0, least(1, 1 - (o_orderkey % 50) / 40.0::double)), 6) as progress, (o_orderkey % 90)::double as net_base from orders where o_totalprice between 50000 and 200000 and o_orderstatus <> 'F')
  select entity, max(seen) as seen, arg_max(mc, seen) as mc, arg_max(created, seen) as created, arg_max(progress, seen) as progress, arg_max(net_base, seen) as net_base from c group by entity""")
def _(s, d):
    k = F.col("o_orderkey")
    mc = F.col("o_totalprice").cast("double").cast("string")
    coin = F.struct(F.col("o_custkey").cast("string").alias("mint"), F.when(k % 2 == 0, mc).alias("usd_market_cap"), mc.alias("market_cap_usd"), ((k + 1600000000) * F.when(k % 2 == 0, 1000).otherwise(1)).alias("created_timestamp"), (F.col("o_orderstatus") == "F").alias("complete"), (k % 90 * 1000000000).alias("real_sol_reserves"), (k % 50).alias("real_token_reserves"))
    out = nz.snapshots(table(s, d, "orders").select(k.alias("seen"), F.to_json(coin).alias("payload")), 50000.0, 200000.0, 40.0)
    return out.select("entity", "seen", "mc", "created", F.round("progress", 6).alias("progress"), "net_base")


@query("p23_quality_grade", """, c as (select entity, case when entity % 3 = 0 then 'pyth' when entity % 3 = 1 then 'jupiter' end as src, entity % 11 > 0 as refined, case when entity % 22 = 0 then 'no trades' else '' end as detail, case when entity % 5 = 0 then 'LOW' when entity % 7 = 0 then 'HIGH' when entity % 3 = 0 then 'HIGH' else 'MED' end as quality from captures),
  r as (select *, case when not refined then 't0_unrefined:' || coalesce(nullif(detail, ''), 'provisional') when quality = 'LOW' then 'capture_quality_low' when quality = 'MED' then 'capture_quality_med_pyth_required' when coalesce(src, '') <> 'pyth' then 'sol_usd_not_pyth:' || coalesce(src, '') end as reject_reason from c)
  select entity, quality, reject_reason, reject_reason is null as scoreable from r""")
def _(s, d):
    e = F.col("entity")
    rows = captured(s, d).select("entity", F.when(e % 3 == 0, "pyth").when(e % 3 == 1, "jupiter").alias("sol_usd_source"), (e % 11 > 0).alias("refined"), F.when(e % 22 == 0, "no trades").otherwise("").alias("detail"))
    rows = rows.withColumn("quality", F.when(e % 5 == 0, "LOW").when(e % 7 == 0, "HIGH").otherwise(gt.quality_of(F.col("sol_usd_source"))))
    return gt.score_reject_reason(rows).select("entity", "quality", "reject_reason", "scoreable")


@query("a35_reconstruct_matrix", LONG + """, pk as (select c.entity, max(t.usd::double / t.tok) as top, any_value(p0) as p0 from captures c join trades t on t.entity = c.entity and t.ts > c.t0 and t.tok > 0 group by 1),
  j as (select k.entity, k.entity % 10 as store_n, c.t0, c.p0, case when c.entity is not null then coalesce(top >= 1.2::double * pk.p0, false) end as hit, l.n, l.max_buy, case when c.t0 is null then 'no_capture' when l.n < 3 then 'few_trades' when l.max_buy > 60000 then 'max_buy' end as reason
    from creates k left join captures c using (entity) left join long l on l.entity = k.entity left join pk on pk.entity = k.entity)
  select entity, store_n, t0, p0, hit, reason, case when reason is null then n end as n, case when reason is null then max_buy end as max_buy, case when reason is null then n - store_n end as n_delta from j""")
def _(s, d):
    from vantage.operators import labels as lb
    from vantage.plans.registry import priced

    c = captured(s, d)
    hits = lb.peak_hit(c, priced(s, d).where("price is not null"), 1.2)
    gates = {"few_trades": F.col("n") >= 3, "max_buy": F.col("max_buy") <= 60000}
    sample = creates(s, d).select("entity", (F.col("entity") % 10).alias("n"))
    return rc.reconstruct_matrix(sample, c, _long(s, d), hits, gates, ["n", "max_buy"])


@query("n4_native_transfers", """, li as (select l_orderkey as o, l_linenumber as ln, l_quantity::double as qty, 't' || l_linenumber % 3 as tr, l_orderkey % 4 as k, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_quantity) as i from lineitem),
  pay as (select o, tr, sum((qty * 1000000)::bigint)::double / 1e9 as base from li where k = 0 and ln <> 2 group by all), had as (select distinct o from pay),
  gain as (select o, sum(qty) as t, sum((qty * 1000003)::bigint)::bigint as g, count(*) as n from li where k = 0 and o not in (select o from had) or k = 1 group by o),
  cu as (select li.*, g, n, floor(g * (sum(qty) over (partition by li.o order by i) / t))::bigint as upto from li join gain using (o)),
  sh as (select *, (case when i = n then g else upto end) - coalesce(lag(upto) over (partition by o order by i), 0) as d from cu)
  select li.o as tx, 'buy' as side, li.tr as trader, qty as tok, round(base, 9) as base from li join pay on pay.o = li.o and pay.tr = li.tr where k = 0 and base > 0
  union all select o, 'buy', tr, qty, round(d / 1e9, 9) from sh union all select o, 'buy', tr, qty, round(case when k = 2 then qty * 2 else 0 end, 9) from li where k >= 2""")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("qty")))).alias("ls"))
    move = "named_struct('mint', {m}, 'sender', {s}, 'receiver', {r}, 'amount', {a})"
    who = "concat('t', x.l_linenumber % 3)"
    tokens = "transform(ls, x -> " + move.format(m="'m'", s="'curve'", r=who, a="x.qty") + ")"
    quotes = "if(tx % 4 = 2, transform(ls, x -> " + move.format(m=f"'{nz.NATIVE[1]}'", s=who, r="'curve'", a="x.qty * 2") + "), array())"
    natives = f"if(tx % 4 = 0, transform(filter(ls, x -> x.l_linenumber <> 2), x -> named_struct('sender', {who}, 'receiver', 'curve', 'amount', cast(x.qty * 1000000 as bigint))), array())"
    balances = "if(tx % 4 < 2, array(named_struct('account', 'curve', 'change', aggregate(ls, 0L, (a, x) -> a + cast(x.qty * 1000003 as bigint)))), array())"
    rows = lines.select("tx", F.lit("SWAP").alias("kind"), F.lit(False).alias("err"), F.lit("m").alias("mint"), F.lit("nobody").alias("payer"), F.lit("curve").alias("curve"), F.expr(f"concat({tokens}, {quotes})").alias("transfers"), F.expr(natives).alias("natives"), F.expr(balances).alias("balances"))
    return nz.native_legs(rows).withColumn("base", F.round("base", 9))
