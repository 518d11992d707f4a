"""Secret scans with multipart credential linking, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (kind, Java pattern, least length). Letters of the keywords match in either case; the value of an
#: assignment is the second group.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that only count when complementary parts stand in the same scope.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|wss?|postgres|mysql|redis|amqp|s3)://[^\s\"'<>]+"
#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "opaque", "endpoint")
_MARK, _PLAIN = "\u0001", "\u0002"
_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def spans_of(text: Column, kind: str, pattern: str, keep: Column | None = None) -> Column:
    """array<struct<s, k, e, m>> of a pattern's leftmost matches, in code points, end exclusive.

    Each match is bracketed with a control character that the text itself no longer holds; splitting there
    alternates gaps and matches, and running lengths give the positions.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_PLAIN)), pattern, f"{_MARK}$0{_MARK}")
    pieces = F.split(marked, _MARK)
    none = F.expr(f"cast(array() as {_SPANS})")
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["p"])
        span = F.struct(a["at"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e"), x["p"].alias("m"))
        return F.struct(end.alias("at"), F.when(x["i"] % 2 == 1, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(numbered, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(pieces) > 1, found).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def link_credentials(docs: DataFrame, key: str = "doc_id", text: str = "text", min_value: int = 6, scope: int = 256) -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex (long), base_sha256, spans, n_linked.

    Strong parts (assignments with a value of min_value characters, access identifiers, long hex runs) always
    count. Weak parts are interval-joined with the strong ones of the same text: an opaque string is reported
    when an access identifier, or an endpoint and an assignment, lie within scope code points of it; an
    endpoint when both an access identifier and a secret do. Weak parts never overlap strong ones, and what
    overlaps a candidate does not complete it. The join runs on (text, block of scope characters) as
    semi-joins, so no pairs are emitted. Null text counts as empty; repeated rows get equal results; a text
    without parts has spans '' and the digest of the empty string; an empty table gives no rows; other columns
    are not read. Whole texts are scanned at any length; the work within a text grows with its length and
    with the square of its own matches.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("text", t)
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"], x["k"], x["e"]))
    rows = rows.select(
        "id",
        F.xxhash64("text", F.length("text")).alias("h"),
        F.filter(spans_of(F.col("text"), "assign", ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= min_value).alias("assign"),
        spans_of(F.col("text"), "access", ACCESS).alias("access"),
        spans_of(F.col("text"), "hex", HEX).alias("hex"),
        spans_of(F.col("text"), "opaque", OPAQUE).alias("opaque"),
        spans_of(F.col("text"), "endpoint", ENDPOINT).alias("endpoint"),
    )
    rows = rows.select("id", "h", *[slim(F.col(k)).alias(k) for k in KINDS])
    told = F.concat("assign", "access", "hex")
    free = lambda kind: F.filter(kind, lambda x: ~F.exists(told, lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"])))
    rows = materialize(rows.withColumn("opaque", free("opaque")).withColumn("endpoint", free("endpoint")), "spans")  # what is told already is not a weak part

    part = lambda *kinds: rows.where(F.size(F.concat(*kinds)) > 0).select("id", "h", F.explode(F.concat(*kinds)).alias("x")).select("id", "h", "x.*").distinct()
    block = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    linked = rows.where((F.size(F.concat("opaque", "endpoint")) > 0) & (F.size(F.concat("assign", "access")) > 0))
    weak = linked.select("id", "h", F.explode(F.concat("opaque", "endpoint")).alias("x")).select("id", "h", "x.*").distinct().withColumn("block", block(F.col("s"), F.col("e")))

    def near(left: DataFrame, *kinds: str) -> DataFrame:
        c = part(*kinds).select(F.col("id").alias("ci"), F.col("h").alias("ch"), F.col("s").alias("cs"), F.col("e").alias("ce"), F.col("k").alias("ck")).withColumn("cb", block(F.greatest(F.col("cs") - scope, F.lit(0)), F.col("ce") + scope))
        on = left["id"].eqNullSafe(c["ci"]) & (left["h"] == c["ch"]) & (left["block"] == c["cb"]) & (c["cs"] <= left["e"] + scope) & (c["ce"] >= left["s"] - scope)
        return left.join(c, on & ((c["cs"] >= left["e"]) | (c["ce"] <= left["s"])), "left_semi")  # no part completes itself

    opaque, endpoint = weak.where(F.col("k") == KINDS.index("opaque")), weak.where(F.col("k") == KINDS.index("endpoint"))
    told = near(opaque, "access").unionByName(near(near(opaque, "endpoint"), "assign")).unionByName(near(near(endpoint, "access"), "assign", "hex", "opaque"))
    told = told.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))
    out = rows.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    base = F.concat("assign", "access", "hex")
    more = F.coalesce(F.col("more"), F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)"))
    return out.select(
        F.col("id").alias(key),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_linked"),
    )
