"""Small cases of files, streams, samples, payloads and models."""

import json

import pytest
from pyspark.sql import functions as F

from vantage.operators import gates as gt
from vantage.operators import models as md
from vantage.operators import normalize as nz
from vantage.operators import records as rc
from vantage.operators import samples as sm
from vantage.sources import files
from vantage.streaming import jobs

EVENT = "event_id long, entity long, ts long, side string, value double"


def test_checked_reads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity,v\n1,x\n")
    assert files.read_table_checked(spark, str(tmp_path / "a.csv"), ["entity"]).first().v == "x"
    with pytest.raises(ValueError, match="w"):
        files.read_table_checked(spark, str(tmp_path / "a.csv"), ["entity", "w"])
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"m": "a", "v": 1}, {"m": "b", "v": None}]}, indent=1))
    assert sorted(r.m for r in files.read_rows_json(spark, str(tmp_path / "a.json"), "m string, v long").collect()) == ["a", "b"]


@pytest.mark.parametrize("keep,want", [("last", {1: "new", 2: "b"}), ("first", {1: "old", 2: "b"})])
def test_merge_batches(spark, tmp_path, keep, want):
    (tmp_path / "batch_1.json").write_text('{"entity": 1, "v": "old"}\n')
    (tmp_path / "batch_2.json").write_text('{"entity": 1, "v": "new"}\n{"entity": 2, "v": "b"}\n')
    got = files.merge_batches(spark, str(tmp_path), "entity", keep, "json", "entity long, v string")
    assert {r.entity: r.v for r in got.collect()} == want


def test_manifest_and_quarantine(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "in" / name).write_text(name)
    listed = [("a", hashlib.sha256(b"a").hexdigest()), ("b", "0"), ("d", "0")]
    got = files.file_manifest_check(spark, str(tmp_path / "in"), spark.createDataFrame(listed, "file string, sha256 string"))
    assert {r.file: r.problem for r in got.collect()} == {"b": "differs", "c": "unlisted", "d": "missing"}
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "entity long, old boolean")
    assert [r.entity for r in files.quarantine_partition(rows, "old", str(tmp_path / "side")).collect()] == [1]
    assert rows.count() == 3


def test_store_digest_ignores_order(spark, tmp_path):
    a = spark.range(50).select(F.col("id").alias("entity"), (F.col("id") * 2).alias("v"))
    one = files.write_feature_store({"a": a}, str(tmp_path / "x")).first()
    two = files.write_feature_store({"a": a.orderBy(F.desc("entity"))}, str(tmp_path / "y")).first()
    other = files.write_feature_store({"a": a.withColumn("v", F.col("v") + 1)}, str(tmp_path / "z")).first()
    assert one == two and one.digest != other.digest


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{name}")


def test_streams_go_on_after_a_restart_and_take_late_rows(spark, tmp_path):
    source, state, out, state2, out2 = (str(tmp_path / x) for x in ("in", "s1", "o1", "s2", "o2"))
    stream = lambda: jobs.replay(spark, f"{source}/*", EVENT)
    assert jobs.sightings(spark, out).count() == jobs.peaks(spark, out2, 6.0).count() == 0
    _write(spark, source, "1", [(1, 7, 100, "x", 5.0), (2, 7, 90, "x", 50.0), (3, 8, 10, "x", 6.0)])
    for _ in range(2):  # the second run finds nothing new
        jobs.first_sighting(stream(), F.col("value") < 10, out, state).awaitTermination()
        jobs.followup_peak(stream(), out2, state2).awaitTermination()
    assert {r.entity: (r.ts, r.event_id) for r in jobs.sightings(spark, out).collect()} == {7: (100, 1), 8: (10, 3)}
    _write(spark, source, "2", [(4, 7, 60, "x", 7.0), (5, 8, 99, "x", 1.0), (6, 9, 5, "x", 2.0)])
    jobs.first_sighting(stream(), F.col("value") < 10, out, state).awaitTermination()
    jobs.followup_peak(stream(), out2, state2).awaitTermination()
    assert {r.entity: (r.ts, r.event_id) for r in jobs.sightings(spark, out).collect()} == {7: (60, 4), 8: (10, 3), 9: (5, 6)}
    assert {r.entity: (r.peak, r.n, r.hit) for r in jobs.peaks(spark, out2, 6.0).collect()} == {7: (50.0, 3, True), 8: (6.0, 2, True), 9: (2.0, 1, False)}


def test_entries_keep_to_the_trailing_cap(spark, tmp_path):
    source, state, out = (str(tmp_path / x) for x in ("in", "s", "o"))
    priors = spark.createDataFrame([(1, 0.5), (2, 0.1)], "entity long, prior double")
    score = F.col("value") + F.coalesce("prior", F.lit(0.0))
    batches = ([(1, 1, 100, "x", 1.0), (2, 2, 100, "x", 1.2), (3, 3, 101, "x", 0.2)], [(4, 1, 200, "x", 9.0), (5, 4, 200, "x", 1.0), (6, 5, 210, "x", 3.0)], [(7, 6, 5000, "x", 1.0)])
    for number, rows in enumerate(batches):
        _write(spark, source, str(number), rows)
        jobs.score_and_enter(jobs.replay(spark, f"{source}/*", EVENT), priors, score, 0.9, 3, 3600, 2, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert {(r.batch, r.entity) for r in got.collect()} == {(0, 1), (0, 2), (1, 5), (2, 6)}


def test_samples(spark):
    rows = spark.range(200).select(F.col("id").alias("entity"), (F.col("id") * 86400).alias("t0"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = sm.recency_sample(rows, "y", 40, "entity").collect()
    assert len(got) == len({r.entity for r in got}) == 40 and sum(r.y for r in got) == 10
    assert sum(r.t0 >= 100 * 86400 for r in got if r.y == 1) == 7 and sum(r.t0 >= 100 * 86400 for r in got if r.y == 0) == 21
    assert {r.entity for r in sm.recency_sample(rows, "y", 40, "entity").collect()} == {r.entity for r in got}
    assert sm.stratified_cap(rows, "y", 120, "entity").groupBy("y").count().orderBy("y").collect() == [(0, 70), (1, 50)]
    more = sm.augment_sample(rows, F.col("entity") < 30, "y", 100, 20, "entity")
    assert more.count() == 100 and more.where("in_base").count() == 30 and more.where("not in_base and y = 0").count() == 28
    assert sm.stratified_cap(rows.limit(0), "y", 10, "entity").count() == 0


def test_creates_with_hints(spark):
    def row(args, accounts):
        arguments = [{"Name": k, "Value": {"string": v}} for k, v in args]
        return (json.dumps({"Block": {"Time": "1700000000"}, "Instruction": {"Program": {"Arguments": arguments}, "Accounts": [{"Address": a} for a in accounts]}}),)

    rows = spark.createDataFrame([row([("Mint", "a"), ("name", "n")], ["b"]), row([("MINT", "z")], ["q", "b"]), row([], ["c", "xpump"]), row([], [])], "payload string")
    assert sorted(r.entity for r in nz.creates_of(rows).collect()) == ["a", "xpump", "z"]
    hints = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "entity string")
    assert sorted((r.entity, r.name) for r in nz.creates_of(rows, hints).collect()) == [("a", "n"), ("b", None), ("c", None)]


def test_transfers(spark):
    q = nz.NATIVE[1]
    moves = [("m", "pool", "A", 10.0), (q, "A", "pool", 1.0), ("m", "pool", "B", 20.0), ("m", "pool", "A", 5.0), (q, "B", "pool", 2.0)]
    rows = spark.createDataFrame([("t", "SWAP", False, "m", "A", moves), ("u", "SWAP", True, "m", "A", moves), ("v", "CREATE_POOL", False, "m", "A", moves), ("w", "SWAP", False, "m", "A", [("m", "A", "pool", 4.0), (q, "pool", "A", 0.5)])],
                                 "tx string, kind string, err boolean, mint string, payer string, transfers array<struct<mint:string,sender:string,receiver:string,amount:double>>")
    got = sorted((r.tx, r.side, r.trader, r.tok, r.base) for r in nz.transfer_legs(rows).collect())
    assert got == [("t", "buy", "A", 5.0, 0.0), ("t", "buy", "A", 10.0, 1.0), ("t", "buy", "B", 20.0, 2.0), ("w", "sell", "A", 4.0, 0.5)]


def test_packs_and_gates(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "entity long, b double, a long")
    assert rc.select_pack(df, ["a", "b", "c"]).columns == ["entity", "a", "b"]
    with pytest.raises(ValueError, match="hit"):
        rc.select_pack(df, ["a", "hit"], ("hit",))
    with pytest.raises(ValueError, match="hit"):
        gt.candidate_sample(df.withColumn("hit", F.lit(1)), ("hit",), "b", 0, 9)
    late = spark.createDataFrame([(1, 100, 101), (1, 100, None), (1, 100, 39), (1, 100, 40), (1, 100, 100)], "entity long, t0 long, ts long")
    assert sorted(r.rule for r in gt.window_gate(late, 60).collect()) == ["after_t0", "before_window", "missing"]
    assert gt.missing_stamps(["seed"]) == ["feature_set_version", "label_version"]


def test_average_precision_and_fit(spark):
    rows = [(i, (i * 37 % 100) / 100, int(i % 3 == 0 or i % 37 > 30), None if i % 9 == 0 else float(i % 7)) for i in range(150)]
    df = spark.createDataFrame(rows, "entity long, score double, y int, x double").withColumn("g", F.lit(1))
    hits, seen, total, ap = 0, 0, sum(r[2] for r in rows), 0.0
    for value in sorted({r[1] for r in rows}, reverse=True):
        same = [r for r in rows if r[1] == value]
        seen, new = seen + len(same), sum(r[2] for r in same)
        hits += new
        ap += new / total * hits / seen
    assert md.average_precision(df, ["g"]).first().ap == pytest.approx(ap)
    df = df.drop("score").withColumn("z", F.col("y") + F.col("entity") % 5 * 0.1)
    model = md.fit(df, ["x", "z"])
    drop = {r.feature: r["drop"] for r in md.permutation_importance(model, df, ["x", "z"], repeats=1).collect()}
    assert drop["z"] > 0.2 > abs(drop["x"])
    assert md.score(model, df, ["x", "z"], ["entity", "y"]).where((F.col("score") > 0.5) != (F.col("y") == 1)).count() == 0


def test_reject_reasons(spark):
    rows = [(True, "", "HIGH", "pyth"), (False, "x", "HIGH", "pyth"), (None, "", "HIGH", "pyth"), (True, "", "med", "pyth"), (True, "", "REJECT", "pyth"), (True, "", "HIGH", "coingecko"), (True, "", None, "pyth")]
    df = spark.createDataFrame(rows, "refined boolean, detail string, quality string, sol_usd_source string")
    want = [None, "t0_unrefined:x", "t0_unrefined:provisional", "capture_quality_med_pyth_required", "capture_quality_reject", "sol_usd_not_pyth:coingecko", "not_scoreable"]
    assert [r.reject_reason for r in gt.score_reject_reason(df).collect()] == want
    assert [r.scoreable for r in gt.score_reject_reason(df, require_pyth=False, allow_med=True).collect()] == [True, False, False, True, False, True, False]
