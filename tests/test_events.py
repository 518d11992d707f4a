"""Small cases of logs, chained quotes, keyed tables, streams over many batches, and ranks by buckets."""

import io
import json
import os
import random
from itertools import pairwise

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from vantage.operators import capture as cap
from vantage.operators import ordered as od
from vantage.sources import keyed, zstd_log
from vantage.streaming import jobs

LOG = "entity string, ts long, value double"


# Logs.


def _zst(path, lines, frames=1):
    size = max(1, -(-len(lines) // frames))
    with open(path, "wb") as out:
        for at in range(0, len(lines), size):
            out.write(zstandard.ZstdCompressor().compress(b"".join(line.encode() + b"\n" for line in lines[at : at + size])))


def test_log_lines_broken_ones_and_other_types(spark, tmp_path):
    _zst(tmp_path / "a.jsonl.zst", [json.dumps({"entity": "a", "ts": 5, "value": 1.5, "more": {"x": [1]}}), "", '{"entity": "b", "ts": "soon", "value": 2}', "{broken", "[1, 2]", '{"entity": 7, "ts": 6, "value": true}', '{"ts": 9}', '{"entity": "ü", "ts": 1e3, "value": null}'])
    (tmp_path / "_staging").mkdir()
    _zst(tmp_path / "_staging" / "b.jsonl.zst", ['{"entity": "hidden", "ts": 1}'])
    zstd_log.register(spark)
    got = spark.read.format("zstd_log").schema(LOG).load(str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 5, 1.5), ("b", None, 2.0), (None, 6, None), (None, 9, None), ("ü", 1000, None)], key=str)


def test_log_in_short_stretches_frames_and_files(spark, tmp_path):
    lines = [json.dumps({"entity": f"e{i % 7}", "ts": i, "value": i / 2, "pad": "é" * (i % 50)}) for i in range(2000)]
    _zst(tmp_path / "a.zst", lines[:1500], frames=4)
    _zst(tmp_path / "b.zst", lines[1500:])
    _zst(tmp_path / "c.zst", [])
    (tmp_path / "notes.txt").write_text("no log")
    zstd_log.register(spark)
    for stretch in (100, 10_000):
        df = spark.read.format("zstd_log").option("stretch", stretch).schema(LOG).load(str(tmp_path))
        assert df.agg(F.count("*"), F.sum("ts"), F.sum("value"), F.countDistinct("entity")).first() == (2000, 1999000, 999500.0, 7)
    assert spark.read.format("zstd_log").schema(LOG).load(str(tmp_path / "b.zst")).count() == 500


def test_log_filters_reach_the_source(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).alias("entity"), F.col("id").alias("ts"), (F.col("id") * 0.5).alias("value"))
    zstd_log.write_event_log(rows.repartition(3), str(tmp_path / "log"))
    keys = spark.createDataFrame([("k1",), ("k2",), (None,), ("none",), ("k1",)], "entity string")
    df = zstd_log.read_event_log(spark, str(tmp_path / "log"), LOG, keys, at="ts", since=100, until=199)
    assert sorted(r.ts for r in df.collect()) == [i for i in range(100, 200) if i % 10 in (1, 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "Join" not in plan, plan  # nothing is left for Spark to drop
    assert zstd_log.read_event_log(spark, str(tmp_path / "log"), LOG, keys.where("entity is null")).count() == 0


def test_more_keys_than_are_pushed_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zstd_log, "MOST_KEYS", 2)
    zstd_log.write_event_log(spark.createDataFrame([(f"k{i}", i, None) for i in range(9)], LOG), str(tmp_path / "log"))
    keys = spark.createDataFrame([(f"k{i}",) for i in (1, 3, 5)], "entity string")
    assert sorted(r.ts for r in zstd_log.read_event_log(spark, str(tmp_path / "log"), LOG, keys).collect()) == [1, 3, 5]


def test_a_failed_log_write_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "log")
    zstd_log.write_event_log(spark.createDataFrame([("a", 1, 1.0)], LOG), path)
    bad = spark.range(100).repartition(4).select(F.lit("b").alias("entity"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("ts"), F.lit(1.0).alias("value"))
    with pytest.raises(Exception, match="lost"):
        zstd_log.write_event_log(bad, path)
    assert spark.read.format("zstd_log").schema(LOG).load(path).count() == 1
    zstd_log.write_event_log(spark.createDataFrame([("c", 2, None)], LOG), path)
    assert sorted(r.entity for r in spark.read.format("zstd_log").schema(LOG).load(path).collect()) == ["a", "c"]


def test_stretches_hold_whole_lines():
    text = b"".join(b"x" * (i % 40) + b"\n" for i in range(300)) + b"last"
    parts = list(zstd_log.stretches(io.BytesIO(text), 64))
    assert b"".join(parts) == text and all(p.endswith(b"\n") for p in parts[:-1])
    assert zstd_log.parse(b"", pa.schema([("a", pa.int64())])).num_rows == 0


# Chained quotes.


def chain_by_hand(t, own, series, default):
    if own is not None and own > 0:
        return own, None, "explicit"
    for name, quotes, age in series:
        past = [q for q in quotes if q[0] is not None and q[1] is not None and q[1] > 0 and t is not None and q[0] <= t]
        if past:
            at = max(q[0] for q in past)
            if t - at <= age:
                return max(q[1] for q in past if q[0] == at), at, name
    return (default, None, "default") if default is not None else (None, None, None)


@pytest.mark.parametrize("default", [None, 42.0])
def test_chain_of_series_by_hand(spark, default):
    draw = random.Random(4)
    series = []
    for name, n, age in (("best", 12, 40), ("next", 25, 120), ("rare", 3, 5000)):
        quotes = [(draw.randrange(0, 3000), draw.choice([1.0, 2.5, 7.0, 9.25])) for _ in range(n)] + [(None, 5.0), (1500, None), (1501, -3.0), (1502, 0.0)]
        series.append((name, quotes, age))
    rows = [(i, draw.randrange(-50, 6000), draw.choice([None, None, None, 8.0, -1.0, 0.0])) for i in range(400)] + [(400, None, None), (401, None, 3.0)] + [(500 + i, 777, None) for i in range(300)]
    frames = [(name, spark.createDataFrame(q, "ts long, price double"), age) for name, q, age in series]
    df = spark.createDataFrame(rows, "entity long, t0 long, own double")
    for bucket, salt in ((100, 3), (100_000, 1), (7, 2)):
        got = cap.as_of_chain(df, frames, at="t0", explicit="own", default=default, bucket=bucket, salt=salt).collect()
        assert len(got) == len(rows)
        assert {r.entity: (r.quote, r.quote_ts, r.quote_source) for r in got} == {i: chain_by_hand(t, own, series, default) for i, t, own in rows}


def test_chain_without_quotes(spark):
    none = spark.createDataFrame([], "ts long, price double")
    df = spark.createDataFrame([(1, 5)], "entity long, t0 long")
    assert cap.as_of_chain(df, [("a", none, 10)], at="t0").first() == (1, 5, None, None, None)


# Keyed tables.


def test_first_seen_store_over_reruns_and_failures(spark, tmp_path):
    schema = spark.createDataFrame([], "entity long, ts long, who string").schema
    table = keyed.first_seen_table(spark, str(tmp_path / "t"), schema, buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    stood = lambda: sorted(map(tuple, keyed.unpacked(table).collect()), key=str)
    assert stood() == []
    assert keyed.append_first_seen(table, rows((1, 10, "a"), (2, 20, "b"), (1, 9, "c"), (1, 9, "b")), 0)
    assert stood() == [(1, 9, "b"), (2, 20, "b")]
    assert not keyed.append_first_seen(table, rows((3, 1, "x")), 0) and stood() == [(1, 9, "b"), (2, 20, "b")]
    bad = rows((1, 1, "z"), (5, 1, "z")).withColumn("who", F.when(F.col("entity") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("who")))
    with pytest.raises(Exception, match="lost"):
        keyed.append_first_seen(table, bad, 1)
    assert stood() == [(1, 9, "b"), (2, 20, "b")] and table.manifest().batch == 0
    assert keyed.append_first_seen(table, rows((2, 21, "late"), (3, 5, "d"), (None, 4, "n")), 1)
    assert sorted(stood(), key=str) == sorted([(1, 9, "b"), (2, 20, "b"), (3, 5, "d"), (None, 4, "n")], key=str)
    assert keyed.append_first_seen(table, rows(), 2) and len(stood()) == 4


def test_a_merge_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "entity long, v long, x long").schema
    table = keyed.followup_table(spark, str(tmp_path / "t"), schema, ["entity"], "v", buckets=3)
    keyed.upsert_followup(table, spark.createDataFrame([(i, 1, i) for i in range(30)], schema), 0)
    before = sorted(map(tuple, keyed.unpacked(table).collect()))

    def dies(self, manifest):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", dies)
        with pytest.raises(RuntimeError):
            keyed.upsert_followup(table, spark.createDataFrame([(i, 2, -i) for i in range(30)], schema), 1)
    assert sorted(map(tuple, keyed.unpacked(table).collect())) == before
    assert keyed.upsert_followup(table, spark.createDataFrame([(1, 2, -1), (2, 0, -2), (99, 1, 0)], schema), 1)
    got = {r.entity: (r.v, r.x) for r in keyed.unpacked(table).collect()}
    assert got[1] == (2, -1) and got[2] == (1, 2) and got[99] == (1, 0) and len(got) == 31
    assert table.vacuum(1) >= 3 and {r.entity: (r.v, r.x) for r in keyed.unpacked(table).collect()} == got


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], {"n": F.sum("n")}, buckets=8)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    first = table.manifest().folders
    table.upsert(spark.createDataFrame([(7, 5)], "k long, n long"))
    second = table.manifest().folders
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert {r.k: r.n for r in table.read().collect()} == {k: 6 if k == 7 else 1 for k in range(200)}


# Streams.

EVENT = "event_id long, entity long, ts long, side string, value double"


def test_many_batches_leave_few_folders_and_no_state(spark, tmp_path):
    draw = random.Random(9)
    events = [(i, draw.randrange(6), 10_000 - i * 7 + draw.randrange(900), "view", float(draw.randrange(100))) for i in range(260)]
    source, out, out2 = (str(tmp_path / x) for x in ("in", "sight", "peaks"))
    os.makedirs(source)
    progress = []
    for n, at in enumerate(range(0, 260, 20)):
        spark.createDataFrame(events[at : at + 20], EVENT).coalesce(1).write.parquet(f"{source}/f{n}")
        a = jobs.first_sighting(jobs.replay(spark, f"{source}/*", spark.createDataFrame([], EVENT).schema), F.col("value") < 50, out, str(tmp_path / "s1"), every=4)
        a.awaitTermination()
        b = jobs.followup_peak(jobs.replay(spark, f"{source}/*", spark.createDataFrame([], EVENT).schema), out2, str(tmp_path / "s2"), every=4)
        b.awaitTermination()
        progress += [a.lastProgress, b.lastProgress]
        seen = events[: at + 20]
        if n in (2, 3, 4, 12):
            first = {e: min((t, i) for i, x, t, _, v in seen if x == e and v < 50) for e in {x for _, x, _, _, v in seen if v < 50}}
            assert {r.entity: (r.ts, r.event_id) for r in jobs.sightings(spark, out).collect()} == first
            assert {r.entity: (r.peak, r.n) for r in jobs.peaks(spark, out2, 60.0).collect()} == {e: (max(v for _, x, _, _, v in seen if x == e), sum(x == e for _, x, *_ in seen)) for e in {x for _, x, *_ in seen}}
    assert all(not p["stateOperators"] for p in progress if p)
    for path in (out, out2):
        assert len([f for f in os.listdir(f"{path}/deltas") if f.startswith("batch=")]) <= 8
        assert len([f for f in os.listdir(f"{path}/table/manifests") if f.startswith("v")]) <= 2


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "p")
    sink = jobs._keep(jobs._peaks(spark, path), path, lambda b: b.select("entity", F.col("value").alias("peak"), F.lit(1).cast("long").alias("n")), 2)
    batches = [spark.createDataFrame([(1, 1, 1, "v", 5.0 + k), (2, 2, 1, "v", 1.0)], EVENT) for k in range(5)]
    for number in (0, 0, 1, 1, 0, 2, 3, 2, 3, 4, 4):
        sink(batches[number], number)
    assert sorted((r.entity, r.peak, r.n) for r in jobs.peaks(spark, path, 1.0).collect()) == [(1, 9.0, 5), (2, 1.0, 5)]


def test_monitor_stream_restarts_and_shows_silent_slots(spark, tmp_path):
    seen = lambda name, rows: spark.createDataFrame(rows, "t long, quality string, complete boolean").select(F.timestamp_seconds("t").alias("at"), "quality", "complete").coalesce(1).write.parquet(f"{tmp_path}/seen/{name}")
    beat = lambda name, *ts: spark.createDataFrame([(t,) for t in ts], "t long").select(F.timestamp_seconds("t").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/beat/{name}")
    out = str(tmp_path / "out")

    def run():
        captures = spark.readStream.schema("at timestamp, quality string, complete boolean").parquet(f"{tmp_path}/seen/*")
        jobs.monitor_stream(captures, spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/beat/*"), "1800 seconds", out, str(tmp_path / "state")).awaitTermination()
        return {r.slot: (r.n, r.n_low, r.problem) for r in jobs.monitored(spark, out).collect()}

    seen("a", [(10, "LOW", False), (20, "HIGH", False), (30, "HIGH", False), (950, "HIGH", True), (None, "LOW", False)])
    beat("a", 0, 900, 1800)
    assert run() == {}
    seen("b", [(40, "LOW", False), (2750, "LOW", None)])  # late, but within the bound
    beat("b", 2700, 5500)
    assert run() == {0: (4, 2, "low_share"), 900: (1, 0, "complete"), 1800: (0, 0, "silent"), 2700: (1, 1, "low_share")}
    seen("c", [(50, "LOW", False)])  # too late: the slot is closed
    beat("c", 3600, 9000)
    assert run() == {0: (4, 2, "low_share"), 900: (1, 0, "complete"), 1800: (0, 0, "silent"), 2700: (1, 1, "low_share"), 3600: (0, 0, "silent"), 5400: (0, 0, "silent")}


# Ranks by buckets.


def _values(n=700):
    draw = random.Random(3)
    return [(i, draw.choice(["a", "b"]), None if i % 50 == 0 else draw.choice([float(draw.randrange(20)), 7.0, draw.random() * 20]), float(draw.randrange(9)), int(draw.random() < 0.3)) for i in range(n)]


def test_spearman_with_ties_and_a_hot_value(spark):
    rows = _values() + [(1000 + i, "a", 7.0, 4.0, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, x double, z double, y int").repartition(5)
    kept = [(x, z) for _, _, x, z, _ in rows if x is not None]
    con = duckdb.connect()
    con.execute("create table t (x double, z double)")
    con.executemany("insert into t values (?, ?)", kept)
    want = con.execute("select corr(a, b) from (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as a, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2 as b from t)").fetchone()[0]
    got = od.spearman(df, "x", "z").first()
    assert got.n == len(kept) and got.spearman == pytest.approx(want, abs=1e-12)
    assert od.spearman(df.where("x = 7"), "x", "z").first().spearman is None
    assert od.spearman(df.where("false"), "x", "z").first() == (0, None)


@pytest.mark.parametrize("falling", [False, True])
def test_cumulated_counts(spark, falling):
    draw = random.Random(1)
    points = {(g, round(draw.gauss(0, 5), 1)): draw.randrange(5) for g in "ab" for _ in range(300)}
    df = spark.createDataFrame([(g, v, k) for (g, v), k in points.items()] + [("a", None, 9), ("b", float("nan"), 9)], "g string, v double, k long")
    for n in (1, 4, 64):
        for r in od.cumulated(df, ["g"], "v", ["k"], falling, n).collect():
            own = [(v, k) for (g, v), k in points.items() if g == r.g]
            assert r.cum_k == sum(k for v, k in own if (v >= r.v if falling else v <= r.v)) and r.all_k == sum(k for _, k in own)


def test_weekly_ks_by_hand(spark):
    rows = [(i * 7200, float((i * i) % 37) + (i > 200) * 5) for i in range(400)] + [(5, None)]
    df = spark.createDataFrame(rows, "ts long, value double")
    known = [(t, v) for t, v in rows if v is not None]
    ref = [v for t, v in known if t < 900_000]
    got = {r.week: r for r in od.weekly_ks(df, F.col("ts") < 900_000, "value").collect()}
    weeks = {}
    for t, v in known:
        if t >= 900_000:
            weeks.setdefault((t + 3 * 86400) // (7 * 86400), []).append(v)
    assert set(got) == set(weeks)
    for w, own in weeks.items():
        cut = sorted({*own, *ref})
        share = lambda xs, c: sum(x <= c for x in xs) / len(xs)
        assert got[w].n == len(own) and got[w].ks == pytest.approx(max(abs(share(own, c) - share(ref, c)) for c in cut))


def test_curve_metrics_by_hand(spark):
    rows = [(i, g, None if x is None else round(x), z, y) for i, g, x, z, y in _values()]
    df = spark.createDataFrame([(g, float(x) if x is not None else None, y if i % 90 else None) for i, g, x, _, y in rows], "g string, score double, y int")
    kept = [(g, float(x), y) for i, g, x, _, y in rows if x is not None and i % 90]
    for r in od.curve_metrics(df, ["g"]).collect():
        own = [(s, y) for g, s, y in kept if g == r.g]
        pos, n = sum(y for _, y in own), len(own)
        best = (-1,)
        for t in sorted({s for s, _ in own}, reverse=True):
            tp, k = sum(y for s, y in own if s >= t), sum(s >= t for s, _ in own)
            best = max(best, (round(2 * tp / (k + pos), 12), -t, tp / k, tp / pos))
        assert (r.pos, r.neg) == (pos, n - pos) and r.best_f1 == pytest.approx(best[0]) and r.threshold == -best[1] and r.best_precision == pytest.approx(best[2]) and r.best_recall == pytest.approx(best[3])
        pairs = [(a > b) + (a == b) / 2 for a, y in own if y for b, q in own if not q]
        assert r.auc == pytest.approx(sum(pairs) / len(pairs))
        hits = expected_hits(own, pos)
        assert r.k_natural == pos and r.precision_natural == pytest.approx(hits / pos)
    for r in od.rank_bands(df, ["g"], [0.001, 0.05, 0.5], [10, 10**6]).collect():
        own = [(s, y) for g, s, y in kept if g == r.g]
        k = {"top_0.1%": max(1, round(0.001 * len(own))), "top_5.0%": round(0.05 * len(own)), "top_50.0%": round(0.5 * len(own)), "top_10": 10}[r.band]
        hits, pos = expected_hits(own, k), sum(y for _, y in own)
        assert r.k == k and r.hits == pytest.approx(hits) and r.lift == pytest.approx(hits / k * len(own) / pos)


def expected_hits(rows, k):
    """Positives among the k best, those of the last score shared evenly."""
    out, left = 0.0, k
    for t in sorted({s for s, _ in rows}, reverse=True):
        own = [y for s, y in rows if s == t]
        out += sum(own) * min(1, left / len(own))
        left -= min(left, len(own))
    return out


def test_buckets_do_not_fall_as_values_rise(spark):
    df = od.bucketed(spark.createDataFrame([(float(x),) for x in [3, 3, 3, 1, 2, 9, 8, -4, float("inf"), -float("inf")] * 20], "v double"), "v", 8)
    seen = {(r.v, r._b) for r in df.collect()}
    assert len({v for v, _ in seen}) == len(seen)
    assert all(b <= d for (_, b), (_, d) in pairwise(sorted(seen)))
