"""Vendor payloads in JSON to trades: parsed once with a schema, then columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the trade rows of both known routes.
FRONTEND = """blockTimeMs double, timestamp string, side string, type string, is_buy boolean, valueUsd string, amount_usd string,
valueNative string, sol_amount string, quoteAmount struct<raw:string,decimals:int>, baseAmount struct<raw:string,decimals:int>, token_amount string,
trader struct<address:string>, user string, quote struct<id:string>"""
#: Identifiers of the native quote asset.
NATIVE = ("11111111111111111111111111111111", "So11111111111111111111111111111111111111112")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: the optimizer neither repeats what a generator gives out nor moves it
    into the lambdas and filters that use it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def event_time(value: Column) -> Column:
    """Epoch seconds (long) of a string: epoch seconds, epoch milliseconds, ISO with or without a zone, or '... UTC'."""
    number = value.try_cast("double")
    stamp = F.try_to_timestamp(F.regexp_replace(value, r" UTC$", "Z"))
    return F.when(number.isNotNull(), F.floor(F.when(number >= 1e12, number / 1000).otherwise(number))).otherwise(stamp.cast("long"))


def _raw(amount: Column) -> Column:
    """{raw, decimals} as a number."""
    return amount["raw"].try_cast("double") / F.pow(F.lit(10.0), F.greatest(F.coalesce(amount["decimals"], F.lit(0)), F.lit(0)))


def frontend_trades(rows: DataFrame, sol_usd: float = 0.0) -> DataFrame:
    """(entity, t0, payload) -> entity, ts, side, usd, tok, base, trader of the JSON payloads with a time at or before t0
    and a side. The usd leg is derived from the native one where it is missing; other missing amounts are 0."""
    p = _once(rows.select("entity", "t0", "payload"), p=F.from_json("payload", FRONTEND)).select("entity", "t0", "p.*")
    ts = F.coalesce(F.floor(F.col("blockTimeMs") / F.when(F.col("blockTimeMs") >= 1e12, 1000.0).otherwise(1.0)), event_time(F.col("timestamp")))
    word = F.lower(F.coalesce("side", "type", F.col("is_buy").cast("string")))
    side = F.when(word.isin("buy", "true", "1"), "buy").when(word.isin("sell", "false", "0"), "sell").when(F.col("is_buy"), "buy").when(~F.col("is_buy"), "sell")
    native = F.coalesce(F.col("quote.id"), F.lit(NATIVE[0])).isin(*NATIVE)
    base = F.coalesce(F.col("valueNative").try_cast("double"), F.col("sol_amount").try_cast("double"), F.when(native, _raw(F.col("quoteAmount"))), F.lit(0.0))
    usd = F.coalesce(F.col("valueUsd").try_cast("double"), F.col("amount_usd").try_cast("double"), F.when((base != 0) & F.lit(sol_usd > 0), base * sol_usd), F.lit(0.0))
    tok = F.coalesce(_raw(F.col("baseAmount")), F.col("token_amount").try_cast("double"), F.lit(0.0))
    out = p.select("entity", "t0", ts.alias("ts"), side.alias("side"), usd.alias("usd"), tok.alias("tok"), base.alias("base"), F.coalesce("user", "trader.address").alias("trader"))
    return out.where("ts <= t0 and side is not null").drop("t0")


def replay_legs(rows: DataFrame) -> DataFrame:
    """Actions with an array breakdown<trader, side, base> -> one row per leg: the breakdown, or the action itself where
    it has none. extra traders come as rows that count as traders, with no amount and counts false."""
    none = F.size(F.coalesce("breakdown", F.array().cast("array<struct<trader:string,side:string,base:double>>"))) == 0
    own = F.array(F.struct("trader", "side", "base"))
    legs = rows.select("entity", "ts", F.explode(F.when(none, own).otherwise(F.col("breakdown"))).alias("x")).select("entity", "ts", "x.*", F.lit(True).alias("counts"))
    extra = rows.select("entity", "ts", F.explode("extra").alias("trader"), "side").select("entity", "ts", "trader", "side", F.lit(0.0).alias("base"), F.lit(False).alias("counts"))
    return legs.unionByName(extra)


def map_project(program: Column, known: dict[str, str], default: str = "other") -> Column:
    """The project of a program or source name, the longest known part first."""
    out = F
    for part in sorted(known, key=lambda k: (-len(k), k)):
        out = out.when(F.contains(F.lower(program), F.lit(part)), known[part])
    return out.otherwise(default) if known else F.lit(default)


def cache_problems(docs: DataFrame) -> DataFrame:
    """(entity, problems) of cached JSON documents: keys, null_trades, time, amount; empty when sound."""
    d = docs.select("entity", F.try_parse_json("payload").alias("v"))
    trades = F.expr("try_variant_get(v, '$.trades', 'array<variant>')")
    has = lambda path: f"exists(try_variant_get(v, '$.trades', 'array<variant>'), x -> {' and '.join(f'try_variant_get(x, {chr(39)}$.{p}{chr(39)}, {chr(39)}string{chr(39)}) is null' for p in path)})"
    problems = F.array(
        F.when(F.col("v").isNull() | F.expr("try_variant_get(v, '$.mint', 'string') is null"), "keys"),
        F.when(trades.isNull(), "null_trades"),
        F.when(F.expr(has(("ts", "timestamp", "blockTimeMs"))), "time"),
        F.when(F.expr(has(("amount_usd", "valueUsd"))), "amount"),
    )
    return d.select("entity", F.array_join(problems, ",").alias("problems"))


#: Fields of nested trade rows.
GQL = """Block struct<Time:string>, Transaction struct<Signer:string>, Trade struct<Amount:string,AmountInUSD:string,
Currency:struct<MintAddress:string>,Account:struct<Address:string>,Dex:struct<ProgramAddress:string,ProtocolName:string,ProtocolFamily:string>,
Side:struct<Type:string,Amount:string,AmountInUSD:string,Currency:struct<MintAddress:string>,Account:struct<Address:string>>>"""
#: Fields of create instructions.
CREATE = """Block struct<Time:string>, Transaction struct<Signer:string>, Instruction struct<Accounts:array<struct<Address:string>>,
Program:struct<Arguments:array<struct<Name:string,Value:struct<string:string,address:string>>>>>"""
#: Fields of coin snapshots.
COIN = """mint string, usd_market_cap string, market_cap_usd string, name string, symbol string, creator string, created_timestamp string,
complete boolean, real_sol_reserves string, real_token_reserves string, bonding_curve string"""


def gql_trades(rows: DataFrame, program: str, swap_program: str, sol_usd: float, least_usd: float = 1.0) -> DataFrame:
    """(payload) -> entity, ts, side, usd, tok, base, trader, project of nested trades.

    Of trades in the native asset the missing one of usd and base is derived from the other; more than a million base
    units are raw ones. Trades without entity, time, side or usd, or below least_usd, go. Without a program the
    protocol's name tells the project, and without both it is the curve.
    """
    p = _once(rows.select("payload"), p=F.from_json("payload", GQL)).select("p.*").select("Block.Time", "Transaction.Signer", "Trade.*")
    quote = F.nullif(F.col("Side.Currency.MintAddress"), F.lit(""))
    native = quote.isNull() | (quote == NATIVE[1])
    amount = F.when(native, F.coalesce(F.col("Side.Amount").try_cast("double"), F.lit(0.0))).otherwise(0.0)
    amount = F.when(amount > 1e6, amount / 1e9).otherwise(amount)
    told = F.coalesce(F.col("AmountInUSD").try_cast("double"), F.col("Side.AmountInUSD").try_cast("double"))
    usd = F.when(native & (F.coalesce(told, F.lit(0.0)) <= 0) & (amount > 0), amount * sol_usd).otherwise(told)
    base = F.when(native & (amount <= 0) & (usd > 0), usd / sol_usd).otherwise(F.greatest(amount, F.lit(0.0)))
    by = F.nullif(F.col("Dex.ProgramAddress"), F.lit(""))
    name = F.replace(F.lower(F.coalesce("Dex.ProtocolName", "Dex.ProtocolFamily", F.lit(""))), F.lit(" "), F.lit(""))
    project = F.when(by == program, "pumpdotfun").when(by == swap_program, "pumpswap").when(F.contains(name, F.lit("pumpswap")) | (name == "pumpamm"), "pumpswap").when(F.contains(name, F.lit("pump")) | by.isNull(), "pumpdotfun").otherwise("other")
    trader = F.coalesce(F.nullif(F.col("Side.Account.Address"), F.lit("")), F.nullif(F.col("Account.Address"), F.lit("")), "Signer", F.lit("unknown"))
    out = p.select(F.nullif(F.col("Currency.MintAddress"), F.lit("")).alias("entity"), event_time(F.col("Time")).alias("ts"), F.lower("Side.Type").alias("side"), usd.alias("usd"), F.coalesce(F.col("Amount").try_cast("double"), F.lit(0.0)).alias("tok"), base.alias("base"), trader.alias("trader"), project.alias("project"))
    return out.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & F.col("side").isin("buy", "sell") & (F.col("usd") >= max(least_usd, 0.0)))


def creates_of(rows: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(payload) -> entity, creator, created, name, symbol of create instructions.

    The entity is the argument mint or token, else an account that ends in pump, else the first account. With hints
    (entity), it is the first of the argument and the accounts that is among them, and other rows go.
    """
    p = _once(rows.select("payload"), p=F.from_json("payload", CREATE)).select("p", F.monotonically_increasing_id().alias("_row"))
    given = F.coalesce(F.col("p.Instruction.Program.Arguments"), F.array().cast("array<struct<Name:string,Value:struct<string:string,address:string>>>"))
    value = lambda a: F.coalesce(a["Value"]["string"], a["Value"]["address"])

    def last(*names: str) -> Column:
        found = [F.try_element_at(F.transform(F.filter(given, lambda a: F.lower(a["Name"]) == n), value), F.lit(-1)) for n in names]  # noqa: B023
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in found])

    accounts = F.filter(F.coalesce(F.col("p.Instruction.Accounts.Address"), F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    out = p.select("_row", last("mint", "token").alias("arg"), accounts.alias("accounts"), F.coalesce(F.nullif(F.col("p.Transaction.Signer"), F.lit("")), last("creator", "user")).alias("creator"), event_time(F.col("p.Block.Time")).alias("created"), last("name").alias("name"), last("symbol").alias("symbol"))
    out = out.where("created is not null")
    columns = ["entity", "creator", "created", "name", "symbol"]
    if hints is None:
        pump = F.get(F.filter("accounts", lambda a: F.endswith(a, F.lit("pump"))), F.lit(0))
        return out.withColumn("entity", F.coalesce("arg", pump, F.get("accounts", F.lit(0)))).where("entity is not null").select(columns)
    may = out.select("creator", "created", "name", "symbol", "_row", F.posexplode(F.concat(F.array("arg"), "accounts")).alias("at", "entity")).join(hints.select("entity").distinct(), "entity", "left_semi")
    return may.groupBy("_row").agg(F.min_by(F.struct(*columns), "at").alias("r")).select("r.*")


def snapshots(rows: DataFrame, lo: float, hi: float, initial: float) -> DataFrame:
    """(seen, payload) -> the last in-band, not completed snapshot of each entity, with its created time and proxies."""
    from .capture import in_band
    from .records import snapshot_proxies

    c = _once(rows.select("seen", "payload"), c=F.from_json("payload", COIN)).select("seen", "c.*")
    cap = F.coalesce(F.col("usd_market_cap").try_cast("double"), F.col("market_cap_usd").try_cast("double"))
    made = F.col("created_timestamp").try_cast("double")
    proxies = snapshot_proxies(F.col("real_token_reserves").try_cast("double"), F.col("real_sol_reserves").try_cast("double"), initial)
    out = c.select(F.col("mint").alias("entity"), "seen", cap.alias("mc"), "name", "symbol", "creator", F.floor(F.when(made >= 1e12, made / 1000).otherwise(made)).alias("created"), "complete", *[v.alias(k) for k, v in proxies.items()])
    out = out.where((F.coalesce(F.col("entity"), F.lit("")) != "") & in_band(F.col("mc"), lo, hi) & ~F.coalesce("complete", F.lit(False)))
    rest = [x for x in out.columns if x not in ("entity", "seen")]
    return out.groupBy("entity").agg(F.max(F.struct("seen", *rest)).alias("r")).select("entity", "r.*")


def _swap_legs(rows: DataFrame, quote: str) -> DataFrame:
    ok = rows.where(~F.coalesce("err", F.lit(False)) & ~F.lower(F.coalesce("kind", F.lit(""))).rlike("liquidity|create_pool"))
    ok = _once(ok, m=F.expr("filter(transfers, t -> t.mint = mint and t.amount > 0)"), q=F.expr(f"filter(transfers, t -> t.mint = '{quote}' and t.amount > 0)"))
    net = lambda side: F.expr(f"aggregate({side}, 0D, (s, t) -> s + case when t.receiver = payer then t.amount else 0D end - case when t.sender = payer then t.amount else 0D end)")
    ok = _once(ok, net=net("m"), got=net("q"), pools=F.expr("array_distinct(transform(m, t -> t.sender))"))
    ok = _once(ok, buys=F.expr("filter(m, t -> not array_contains(pools, t.receiver))"), paid=F.expr("filter(q, t -> array_contains(pools, t.receiver) and not array_contains(pools, t.sender))"))
    buys = F.expr("""transform(buys, (t, i) -> named_struct('side', 'buy', 'trader', t.receiver, 'tok', t.amount, 'base',
        coalesce(get(filter(paid, x -> x.sender = t.receiver), size(filter(slice(buys, 1, i), y -> y.receiver = t.receiver))).amount, 0D)))""")
    sell = F.array(F.struct(F.lit("sell").alias("side"), F.col("payer").alias("trader"), (-F.col("net")).alias("tok"), F.greatest("got", F.lit(0.0)).alias("base")))
    return ok.withColumn("legs", F.when(F.col("net") < 0, sell).otherwise(buys))


def transfer_legs(rows: DataFrame, quote: str = NATIVE[1]) -> DataFrame:
    """(tx, kind, err, mint, payer, transfers array<struct<mint,sender,receiver,amount>>) -> tx, side, trader, tok, base.

    Where the payer gives up tokens on balance, it is one sell of the net amounts. Otherwise each receipt of tokens by
    an account that sends none is a buy, paired in order with the trader's payments to token senders; receipts
    beyond its payments have base 0. Failed and liquidity transactions go. All is done within the row: no shuffle.
    """
    return _swap_legs(rows, quote).select("tx", F.inline("legs"))


#: Units of the native asset in one.
UNIT = 1_000_000_000


def native_legs(rows: DataFrame, quote: str = NATIVE[1]) -> DataFrame:
    """transfer_legs, and where no leg has a base, buys from a curve that was paid in the native asset.

    More columns: curve (an account), natives array<struct<sender,receiver,amount>> and balances
    array<struct<account,change>>, amounts in units of the native asset (long). Each receipt of tokens from the curve by
    another account is a buy. Its base is what the receiver paid to the curve, all its payments summed; receivers that
    paid nothing are left out, as long as somebody paid. Without any payment the curve's first positive balance
    change is shared over the receipts in proportion to their tokens, in whole units, the last one taking what rounding
    leaves, so that the shares add up to the change. Without either, the legs without a base stay. A curve, list or
    amount that is null is as absent. All is done within the row: no shuffle.
    """
    ok = _swap_legs(rows, quote)
    ok = ok.withColumn("_got", F.expr("filter(coalesce(transfers, array()), t -> t.mint = mint and t.amount > 0 and t.sender = curve and t.receiver <> curve)"))
    ok = ok.withColumn("_paid", F.expr("filter(coalesce(natives, array()), t -> t.receiver = curve and t.sender is not null and t.amount > 0)"))
    ok = ok.withColumn("_gain", F.expr("coalesce(get(filter(coalesce(balances, array()), b -> b.account = curve and b.change > 0), 0).change, 0L)"))
    by_payer = F.expr(f"""filter(transform(_got, t -> named_struct('side', 'buy', 'trader', t.receiver, 'tok', t.amount, 'base',
        aggregate(filter(_paid, p -> p.sender = t.receiver), 0L, (s, p) -> s + p.amount) / {UNIT})), x -> x.base > 0)""")
    total = "aggregate(_got, 0D, (s, t) -> s + t.amount)"
    upto = lambda n: f"(case when {n} >= size(_got) then _gain else floor(_gain * (aggregate(slice(_got, 1, {n}), 0D, (s, t) -> s + t.amount) / {total})) end)"
    shared = F.expr(f"transform(_got, (t, i) -> named_struct('side', 'buy', 'trader', t.receiver, 'tok', t.amount, 'base', ({upto('i + 1')} - {upto('i')}) / {UNIT}))")
    native = F.when(F.size("_paid") > 0, by_payer).when(F.col("_gain") > 0, shared)
    bare = ~F.coalesce(F.exists("legs", lambda x: x["base"] > 0), F.lit(False))
    return ok.select("tx", F.inline(F.when(bare & (F.size(F.coalesce(native, F.array().cast("array<struct<side:string,trader:string,tok:double,base:double>>"))) > 0), native).otherwise(F.col("legs"))))
