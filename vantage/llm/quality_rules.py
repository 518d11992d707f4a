"""Quality rules with host-level verdicts, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _n_of(text: Column, chars: str) -> Column:
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c))
    return F.octet_length(text) - F.octet_length(left)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) from the whole text of each row.

    A null text counts as empty: all counts are 0. Everything is computed within the row, so there is no
    shuffle. Repeated 3-word windows are found by sorting (hash, position) pairs of the document.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words_of(t))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", _n_of(t, SYMBOLS).cast("long"))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    n = F.size("_w")
    windows = F.transform(F.slice("_w", F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", F.when(n >= 3, windows).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_any", F.size("_h") > F.size(F.array_distinct("_h")))
    df = df.withColumn("_s", F.when(F.col("_any"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, j) -> (j > 0 and _s[j - 1].h = x.h) or (j < size(_s) - 1 and _s[j + 1].h = x.h)), x -> x.i))"))
    covered = "aggregate(zip_with(_p, slice(_p, 2, size(_p)), (p, q) -> cast(least(3, coalesce(q - p, 3)) as bigint)), 0L, (s, x) -> s + x)"
    df = df.withColumn("n_repeat_words", F.when(F.col("_any"), F.expr(covered)).otherwise(F.lit(0)).cast("long"))
    return df.drop("_w", "_l", "_h", "_any", "_s", "_p")


#: Rules whose failures are counted by host, with the condition on a document's counts.
RULES = ("short", "repeat", "symbols", "dup_lines")


def host_verdicts(rows: DataFrame, host: str, rules: dict[str, Column], ratio: float = 1.1, tolerance: float = 1e-9) -> DataFrame:
    """One row per host and rule: host, rule, n_docs, n_failed, pooled, shrunk, bad.

    Failures are counted by host and rule. Per rule the prior is a beta whose mean is the pooled failure rate
    and whose strength comes from the moments of the hosts' rates; each host's rate is shrunk to
    (failed + alpha) / (docs + alpha + beta), and the host is bad when that exceeds `ratio` times the pooled
    rate. Null is a host of its own. Without hosts there are no rows; when rates vary no more than chance lets
    them, the prior is as strong as all documents together.
    """
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *[F.count_if(c).alias(r) for r, c in rules.items()])
    hosts = hosts.unpivot(["host", "n_docs"], list(rules), "rule", "n_failed")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.groupBy("rule").agg(  # one row per rule
        (F.sum("n_failed") / F.sum("n_docs")).alias("pooled"),
        (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs") - F.pow(F.sum("n_failed") / F.sum("n_docs"), 2)).alias("_v"),
        (F.count("*") / F.sum(1 / F.col("n_docs"))).alias("_size"),
        F.sum("n_docs").alias("_all"),
    )
    noise = F.col("pooled") * (1 - F.col("pooled"))
    between = F.greatest(F.col("_v") - noise / F.col("_size"), F.lit(0.0))
    prior = prior.select("rule", "pooled", F.when(between > tolerance, F.greatest(noise / between - 1, F.lit(tolerance))).otherwise(F.col("_all").cast("double")).alias("_k"))
    out = hosts.join(F.broadcast(prior), "rule")
    out = out.withColumn("shrunk", (F.col("n_failed") + F.col("pooled") * F.col("_k")) / (F.col("n_docs") + F.col("_k")))
    return out.select("host", "rule", "n_docs", "n_failed", "pooled", "shrunk", (F.col("shrunk") > ratio * F.col("pooled")).alias("bad"))


def host_level_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat: int = 50, ratio: float = 1.1, max_symbols: float = 0.1, max_dup_lines: float = 0.03) -> DataFrame:
    """One row per input row: key, counts of document_counts, base_failed, host, bad_rules, host_bad, kept.

    base_failed: fewer than min_words words, or more than max_repeat percent of the words lie in repeated
    windows. On hosts that are bad by a rule, documents also go that fail it in its soft form: more than half
    of max_repeat, more than max_symbols symbols per word, or more than max_dup_lines repeated lines per word;
    short documents have no soft form. bad_rules are the rules the host is bad by, comma-joined. Documents
    that fail nothing stay on every host. Repeated rows each get their row; null text fails for want of words;
    an empty table gives no rows; other columns are not read, so their names cannot clash.
    """
    rows = document_counts(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))).drop("text")
    n = F.col("n_words")
    soft = {
        "repeat": 200 * F.col("n_repeat_words") > max_repeat * n,
        "symbols": F.col("n_symbols") > max_symbols * n,
        "dup_lines": F.col("n_dup_lines") > max_dup_lines * n,
    }
    rows = rows.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat * n))
    rows = materialize(rows, "quality")
    verdicts = host_verdicts(rows, "host", {"short": n < min_words, **soft}, ratio).where("bad")
    verdicts = verdicts.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_set("rule")).alias("bad"))  # RULES at most
    out = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    dropped = F.lit(False)
    for rule, fails in soft.items():
        dropped = dropped | (fails & F.array_contains("bad", rule))
    out = out.withColumn("kept", ~F.col("base_failed") & ~dropped).withColumn("host_bad", F.size("bad") > 0).withColumn("bad_rules", F.array_join("bad", ","))
    return out.drop("_host", "bad").withColumnRenamed("doc_id", key)
