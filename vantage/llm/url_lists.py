"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """The list keys that a URL falls under: url:..., host:..., domain:... for the host and all its parents."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("url:"), url), F.concat(F.lit("host:"), host)), domains)).otherwise(F.array().cast("array<string>"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], width: int) -> DataFrame:
    """left with the values of the latest right row of the same key with right.at <= left.at (longs), else null.

    Keys are cut into blocks of time of the given width, so a frequent key spreads over many tasks; the last
    row of each block is carried to later blocks over the small table of (key, block). Rows of right must be
    unique by (key, at). Null keys match nothing.
    """
    block = F.floor(F.col(at) / width)
    packed = F.struct(F.col(at).alias("_at"), *values)
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), block.alias("_b"), packed.alias("_v"))
    ends = r.groupBy("_k", "_b").agg(F.max("_v").alias("_last"))
    here = left.withColumn("_b", block)
    asked = here.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), "_b").distinct()
    carried = ends.select("_k", "_b", "_last").unionByName(asked.join(ends.select("_k", "_b"), ["_k", "_b"], "left_anti").withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType)))
    carried = carried.withColumn("_before", F.last("_last", True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), "_before")
    names = left.columns
    both = here.select(F.col(key).alias("_k"), F.col(at).alias("_t"), "_b", F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    both = both.unionByName(r.select("_k", "_t", "_b", F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_v"))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_got", F.last("_v", True).over(w)).where("_side = 1")
    out = out.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")), "left").withColumn("_got", F.when(F.col("_k").isNotNull(), F.coalesce("_got", "_before")))
    return out.select("_row.*", *[F.col("_got")[v].alias(v) for v in values])


def validity(entries: DataFrame) -> DataFrame:
    """(list_key, at long, action 'add' or 'remove') -> (list_key, at, until): intervals in which a key is listed.

    Entries of one key and time: an addition wins. A key listed already stays so; until is null while it is
    never removed. Null keys, times and actions say nothing.
    """
    e = entries.where("list_key is not null and at is not null and action in ('add', 'remove')").groupBy("list_key", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy("list_key").orderBy("at")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where(F.col("on") != F.col("was"))
    return e.withColumn("until", F.lead("at").over(w)).where("on = 1").select("list_key", "at", "until")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched", width: int = 86400) -> DataFrame:
    """One row per capture: key, url, at, n_active (long), rules (sorted, comma-joined), blocked.

    A capture is evaluated against the entries that are active at its fetch time for its URL, its host and
    every parent domain. Null or malformed URLs and null times match nothing; repeated captures stay apart.
    """
    rows = captures.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(at).cast("long").alias("t"))
    asked = rows.withColumn("list_key", F.explode(keys_of(F.col("u")))).select("k", "u", F.col("t").alias("at"), "list_key").distinct()
    found = as_of(asked, validity(entries).withColumn("since", F.col("at")), "list_key", "at", ["since", "until"], width)
    active = found.where(F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    active = active.groupBy(F.col("k").alias("_k"), F.col("u").alias("_u"), F.col("at").alias("_t")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("list_key")), ",").alias("rules"))
    out = rows.join(active, F.col("k").eqNullSafe(F.col("_k")) & (F.col("u") == F.col("_u")) & (F.col("t") == F.col("_t")), "left")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), F.col("t").alias(at), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("rules", F.lit("")).alias("rules"), F.col("n").isNotNull().alias("blocked"))
