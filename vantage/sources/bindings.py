"""The canonical tables of the library, bound to the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400
#: Price band of the first qualifying trade, both ends included.
BAND = (1000.0, 1400.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long") * DAY


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, ts (epoch seconds), id (total tie-break), side, usd decimal, tok, base, trader, venue."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ts = _day("l_shipdate") + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613 + F.col("l_suppkey") * 31) % DAY
    # before the join, so that their columns need not be shuffled for it
    lines = lines.withColumns({"ts": ts, "usd": (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")})
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    usd = F.col("usd")
    return rows.select(
        F.col("l_partkey").alias("entity"),
        "ts",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("id"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        usd,
        F.col("l_quantity").alias("tok"),
        (usd.cast("double") / 150.0).alias("base"),
        F.col("o_custkey").alias("trader"),
        F.when(F.col("l_returnflag") == "N", "pumpswap").otherwise("pumpdotfun").alias("venue"),
    )


def creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    start = 9131 * DAY  # 1995-01-01
    return parts.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("creator"), (F.lit(start) + (F.col("p_partkey") * 37) % 8000 * 3600).cast("long").alias("created"), F.col("p_name").alias("name"), F.col("p_type").alias("symbol"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote a day, at midnight; every seventh day has none."""
    orders = table(spark, sf_dir, "orders").where(F.dayofyear("o_orderdate") % 7 != 0)
    return orders.groupBy(_day("o_orderdate").alias("ts")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count("*") / 1000).alias("price"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"))


def event_rows(rows: DataFrame) -> DataFrame:
    """The columns of events, of a table or of a stream."""
    clock = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return rows.select("event_id", F.col("user_id").alias("entity"), (_day("ts") + clock).cast("long").alias("ts"), F.col("event_type").alias("side"), "value", F.get_json_object("props", "$.k").cast("long").alias("trader"))


#: The same tables as common table expressions.
SQL = """with trades as (
  select l_partkey as entity, (l_shipdate::date - date '1970-01-01') * 86400 + (l_orderkey * 7919 + l_linenumber * 613 + l_suppkey * 31) % 86400 as ts,
    l_orderkey, l_linenumber, l_suppkey, l_extendedprice, case when l_linestatus = 'O' then 'buy' else 'sell' end as side,
    (l_extendedprice * (1 - l_discount))::decimal(18,4) as usd, l_quantity as tok, o_custkey as trader,
    case when l_returnflag = 'N' then 'pumpswap' else 'pumpdotfun' end as venue
  from lineitem join orders on l_orderkey = o_orderkey),
creates as (
  select p_partkey as entity, p_brand as creator, 9131 * 86400 + (p_partkey * 37) % 8000 * 3600 as created, p_name as name, p_type as symbol from part),
quotes as (
  select (o_orderdate::date - date '1970-01-01') * 86400 as ts, sum(o_totalprice::decimal(18,4))::double / count(*) / 1000 as price
  from orders where dayofyear(o_orderdate) % 7 <> 0 group by 1),
ev as (
  select event_id, user_id as entity, (ts::date - date '1970-01-01') * 86400 + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))::bigint as ts,
    event_type as side, value, (props::json->>'k')::bigint as trader from events),
banded as (select *, usd::double / tok as price from trades where tok > 0 and usd::double / tok between 1000 and 1400),
captures as (
  select entity, ts as t0, price as p0, venue as venue0 from (
    select *, row_number() over (partition by entity order by ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as rn from banded) where rn = 1),
pit as (select t.*, c.t0, c.p0, c.t0 - t.ts as age from captures c join trades t on t.entity = c.entity and t.ts <= c.t0)
"""
