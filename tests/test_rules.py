"""Small cases of the row rules, detector variants, exact quantiles, strategies and models."""

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import compare as cmp
from vantage.operators import evaluate as ev
from vantage.operators import gates as gt
from vantage.operators import models as md
from vantage.operators import ordered as od
from vantage.operators import rules as rl
from vantage.operators import scores as sc
from vantage.sources import files

TRADES = "entity long, ts long, id long, usd double, tok double, side string, venue string"


def _quantile_rows():
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1.0, 2.5, draw.gauss(0, 10), float(draw.randrange(6))])) for _ in range(500)]
    return rows + [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", None), ("a", float("nan"))] + [("a", 3.25)] * 300  # a hot value


def test_exact_quantiles_by_hand(spark):
    rows = _quantile_rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.q) for r in od.exact_quantiles(df, ["g"], "v", shares).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-9)
    assert od.exact_quantiles(df.where("false"), [], "v", [0.5]).count() == 0


def test_statistics_on_exact_quantiles(spark):
    draw = random.Random(2)
    values = [draw.gauss(5, 2) for _ in range(101)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)] + [(500, None, None)], "entity long, x double, flat double")
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    got = {r.entity: r.distance for r in cmp.robust_distance(df, ["x", "flat"]).collect()}
    assert got[500] == 3.0 and got[4] == pytest.approx((abs(values[4] - q2) / ((q3 - q1) / 1.35) + 3) / 2)
    profile = {r.feature: r for r in ev.distribution(df, ["x", "flat"]).collect()}
    assert profile["x"].mean == pytest.approx(statistics.mean(values)) and profile["x"].scale == pytest.approx((q3 - q1) / 1.35) and profile["flat"].scale == 0
    deltas = spark.createDataFrame([(0.0,), (None,), (0.5,), (1e-5,)], "delta double")
    one = cmp.delta_summary(deltas).first()
    assert (one.n, one.n_both, one.median, one.above_small, one.above_large) == (4, 3, 1e-5, 2, 1)
    assert cmp.delta_summary(deltas.where("delta is null")).first().median is None
    assert cmp.score_gate(df.select(F.col("x").alias("score")).where("x is not null"), 5.0).first().upper_median == sorted(values)[50]
    assert cmp.score_gate(df.select(F.col("x").alias("score")).where("false"), 5.0).first().n == 0


def test_first_band_detector(spark):
    rows = [(1, 10, 1, 50.0, 10.0, "buy", "v"), (1, 20, 3, 120.0, 10.0, "buy", "v"), (1, 20, 2, 110.0, 10.0, "buy", "v"), (2, 5, 1, 9.0, 1.0, "buy", "v"), (2, 8, 2, 5.0, 0.0, "buy", "v"), (3, 1, 1, 500.0, 1.0, "sell", "v")]
    trades = spark.createDataFrame(rows, TRADES)
    seen = spark.createDataFrame([(3, 77), (9, 99), (3, 70)], "entity long, seen long")
    got = {r.entity: (r.t0, r.mc, r.quality, r.refined, r.detail) for r in rl.capture_first_band(trades, 10.0, 13.0, "jupiter", seen, 1.0).collect()}
    assert got == {1: (20, 11.0, "MED", True, "first_band"), 2: (8, 0.0, "LOW", False, "no_band_trade"), 3: (70, 0.0, "LOW", False, "no_band_trade"), 9: (99, 0.0, "LOW", False, "no_band_trade")}
    assert rl.capture_first_band(trades.where("false"), 1.0, 2.0).count() == 0


def test_aligned_detector(spark):
    # created at 100: young and in band at once; created in the future; never in band; unknown create, in band only as first trade
    path = [(1, 105, 1, 11.0), (1, 110, 2, 12.0), (2, 50, 1, 11.0), (2, 70, 2, 12.0), (2, 90, 3, 30.0), (3, 10, 1, 99.0), (4, 10, 1, 11.0), (4, 60, 2, 99.0), (5, 10, 1, 99.0), (5, 45, 2, 11.0)]
    created = spark.createDataFrame([(1, 100), (1, 300), (2, 1000), (3, 0)], "entity long, created long")
    got = {r.entity: (r.t0, r.mc, r.quality, r.refined, r.n_window, r.tradeable, r.detail) for r in rl.capture_aligned(spark.createDataFrame(path, "entity long, ts long, id long, mc double"), created, 10.0, 13.0).collect()}
    assert got[1] == (105, 11.0, "HIGH", True, 1, 5, "aligned")
    assert got[2] == (50, 11.0, "LOW", False, 0, 0, "too_young") and got[3] == (10, 0.0, "REJECT", False, 0, 0, "never_in_band")
    assert got[4] == (10, 11.0, "LOW", False, 0, 0, "too_young") and got[5] == (45, 11.0, "HIGH", True, 1, 35, "aligned")


def test_sighting_detector(spark):
    seen = [(1, 100, 11.0, False), (2, 100, 11.0, True), (3, 100, 99.0, False), (4, 100, 11.0, None), (5, 100, 11.0, False), (6, 10**6, 11.0, False), (7, 100, None, False), (8, 100, float("nan"), False)]
    created = [(1, 90), (1, 95), (2, 90), (3, 90), (4, 100), (6, 0)]
    out = rl.capture_sighting(spark.createDataFrame(seen, "entity long, seen long, mc double, complete boolean"), spark.createDataFrame([*created, (9, 1)], "entity long, created long"), 10.0, 13.0)
    got = {r.entity: (r.quality, r.refined, r.tradeable, r.detail) for r in out.collect()}
    assert got[1] == ("MED", True, 10, "sighting") and got[2] == ("REJECT", False, 0, "graduated") and got[3] == ("REJECT", False, 0, "mc_out_of_band")
    assert got[4] == ("MED", True, 0, "sighting") and got[5] == ("LOW", False, 0, "missing_create") and got[6] == ("LOW", False, 10**6, "age_above_most")
    assert got[7][3] == got[8][3] == "mc_out_of_band" and len(got) == 8
    late = rl.capture_sighting(spark.createDataFrame([(1, 50, 11.0, False)], out.sparkSession.createDataFrame([], "entity long, seen long, mc double, complete boolean").schema), spark.createDataFrame([(1, 90)], "entity long, created long"), 10.0, 13.0).first()
    assert (late.quality, late.detail) == ("REJECT", "create_after_t0")


def test_row_rules(spark):
    rows = spark.createDataFrame([(17, 5.0), (27, None), (8, float("nan")), (None, -1.0)], "entity long, price double")
    assert sorted(r.entity for r in rl.suffix_filter(rows, "entity", "7").collect()) == [17, 27]
    assert [r.entity for r in rl.sanity_filter(rows.withColumn("mc", F.col("price") * 2), 9.0, 10.0).collect()] == [17]
    assert rl.sanity_filter(rows.withColumn("mc", F.col("price") * 2), 9.0, 9.0).count() == 0
    assert rl.anti_done(rows, rows.where("entity = 8")).count() == 3
    assert [r.entity for r in rl.closest_to(rows.where("not isnan(price) or price is null"), "price", 0.0, 1).collect()] == [None]
    one = rl.key_coverage(rows, rows.where("entity <> 8"), "entity", 0.5).first()
    assert (one.n_keys, one.n_expected, one.complete) == (2, 4, True)
    assert rl.key_coverage(rows.where("false"), rows).first().coverage is None
    assert rl.prior_coverage(rows.union(rows.limit(1)), rows.where("entity = 17")).first().n == 5
    labels = rl.resolve_label(spark.createDataFrame([(1, 0), (None, 1), (None, None)], "a int, b int"), F.col("a"), F.col("b")).collect()
    assert [(r.label, r.label_source) for r in labels] == [(1, "primary"), (1, "proxy"), (None, "none")]
    assert rows.select(rl.capture_id(F.lit(5), F.lit(9)).alias("c")).first().c == hashlib.sha256(b"5|9|v1").hexdigest()[:32]


def test_training_matrix_falls_back(spark):
    rows = spark.range(100).select("id", (F.col("id") % 10).alias("n"), F.when(F.col("id") < 30, 1).alias("oldest"), F.lit(1).alias("created"))
    assert rl.training_matrix(rows).count() == 21
    assert rl.training_matrix(rows, loose={"n": "n >= 3"}).count() == 70 and rl.training_matrix(rows, loose={"n": "n >= 3"}, least=21).count() == 21
    assert rl.training_matrix(rows, loose={"n": "n >= 30"}).count() == 21


def test_strategies_against_loops(spark):
    draw = random.Random(3)
    rows = [(draw.random(), draw.choice([0, 1]), draw.choice([None, round(draw.uniform(-1, 9), 4)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "score double, y int, r double")
    got = {r.strategy: r for r in sc.strategy_compare(df, {"all": F.lit(True), "high": F.col("score") > 0.7, "unknown": F.lit(None).cast("boolean")}, "all").collect()}
    high = [r for r in rows if r[0] > 0.7]
    told = [r for _, _, r in high if r is not None]
    assert got["high"].n == len(high) and got["high"].hit_rate == pytest.approx(statistics.mean(y for _, y, _ in high)) and got["high"].cum_r == pytest.approx(sum(told)) and got["high"].mean_r == pytest.approx(statistics.mean(told), abs=1e-5)
    assert got["high"].delta_n == len(high) - 200 and got["all"].delta_cum_r == 0 and got["unknown"].n == 0 and got["unknown"].delta_mean_r is None
    twice = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, v double")
    assert sc.compare_to_baseline(twice, "k", "a", ["v"]).count() == 3


def _folded(spark, n=600):
    draw = np.random.default_rng(1)
    y = (draw.random(n) < 0.4).astype(int)
    rows = [(i, i * 1000, f, "train" if k < 0.7 else "test", int(y[i]), float(y[i] + draw.normal(0, 0.4)), float(draw.normal())) for i in range(n) for f, k in ((1, draw.random()), (2, draw.random()))]
    return spark.createDataFrame(rows, "entity long, t0 long, fold int, part string, y int, good double, noise double")


def test_ablation_names_the_feature_that_tells(spark):
    got = {r.features: r for r in md.ablation(_folded(spark), {"both": ["good", "noise"], "good": ["good"], "noise": ["noise"]}, "both").collect()}
    assert got["both"].auc > 0.9 and got["good"].prefer_simpler and not got["noise"].prefer_simpler and got["noise"].delta_auc < -0.3 and got["noise"].delta_ap < -0.2


def test_best_model_and_last_fold(spark):
    folded = _folded(spark)
    scored = md.model_zoo(folded, ["good"], ("logistic", "logistic_natural")).unionByName(md.walk_forward_scores(folded, ["noise"]).withColumn("model", F.lit("blind")))
    got = {r.model: r for r in md.best_model(scored).collect()}
    assert sum(r.best for r in got.values()) == 1 and not got["blind"].best and all(r.folds == 2 for r in got.values()) and got["logistic_natural"].auc > 0.9
    last = md.lite_fit(folded, ["good"])
    assert {r.fold for r in last.select("fold").distinct().collect()} == {2}
    assert last.count() == folded.where("fold = 2 and part = 'test'").count()
    mean = lambda natural: md.score(md.fit(folded, ["noise"], balanced=not natural), folded, ["noise"], ["entity"]).agg(F.avg("score")).first()[0]
    assert mean(False) == pytest.approx(0.5, abs=0.02) and mean(True) == pytest.approx(folded.agg(F.avg("y")).first()[0], abs=0.02)


def test_perturbation_by_nulls_and_by_live_medians(spark):
    folded = _folded(spark).where("fold = 1")
    model = md.fit(folded, ["good", "noise"])
    masked = md.perturbation(model, folded, ["good", "noise"], {"g": ["good"], "n": ["noise"]})
    spread = {r.group: r.s for r in masked.groupBy("group").agg(F.stddev("after").alias("s")).collect()}
    assert spread["g"] < 0.05 < spread["n"]
    live = spark.createDataFrame([(3.0, 0.0), (4.0, None), (9.0, 0.0)], "good double, noise double")
    moved = md.perturbation(model, folded, ["good", "noise"], {"g": ["good"]}, live=live)
    by_hand = md.score(model, folded.withColumn("good", F.lit(4.0)), ["good", "noise"], ["entity"])
    assert {r.entity: round(r.after, 9) for r in moved.collect()} == {r.entity: round(r.score, 9) for r in by_hand.collect()}
    assert moved.agg(F.min("after")).first()[0] > 0.9  # all look like hits


def test_recalibration_after_a_repair(spark):
    folded = _folded(spark).where("fold = 1")
    model = md.fit(folded, ["good"])
    bare = folded.withColumn("good", F.lit(None).cast("double"))
    got = {r.version: r for r in md.recalibrate(model, bare, folded, ["good"], 0.5).collect()}
    assert got["before"].n == got["after"].n == folded.count() and got["before"].n_pass in (0, folded.count())
    assert got["after"].n_pass == md.score(model, folded, ["good"], ["entity"]).where("score >= 0.5").count() and got["after"].largest > got["before"].largest


def test_column_gates(spark):
    assert gt.leak_rules(["a", "hit_1", "y", "time_to_x", "b"], ["y"], ["a"]) == [("b", "not_listed"), ("hit_1", "prefix"), ("time_to_x", "prefix"), ("y", "label")]
    assert gt.leak_rules(["a"], []) == []
    rows = spark.createDataFrame([(1, "v", ""), (2, None, "s")], "entity long, feature_set_version string, seed string")
    assert {r.column: r.n for r in gt.unstamped(rows).collect()} == {"feature_set_version": 1, "label_version": 2, "seed": 1}


def test_nested_manifests_and_batches_by_folder(spark, tmp_path):
    for k in "ab":
        (tmp_path / "in" / k).mkdir(parents=True)
        (tmp_path / "in" / k / "part").write_text(k)
    listed = spark.createDataFrame([("a/part", hashlib.sha256(b"a").hexdigest()), ("b/part", "0"), ("c/part", "0")], "file string, sha256 string")
    assert {r.file: r.problem for r in files.file_manifest_check(spark, str(tmp_path / "in"), listed, nested=True).collect()} == {"b/part": "differs", "c/part": "missing"}
    for n, rows in ((1, [(1, "old"), (2, "b")]), (2, [(1, "new")])):
        spark.createDataFrame(rows, "k long, v string").repartition(2).write.parquet(str(tmp_path / "batches" / f"batch_{n}"))
    got = lambda keep: {r.k: r.v for r in files.merge_batches(spark, str(tmp_path / "batches"), "k", keep, by="folder").collect()}
    assert got("last") == {1: "new", 2: "b"} and got("first") == {1: "old", 2: "b"}


def test_running_falls_over_buckets(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", None]), i, draw.randrange(0, 3000), draw.choice([None, round(draw.uniform(-2, 2), 3)])) for i in range(300)] + [("c", 900, None, 1.0), ("c", 901, 5, -3.0)]
    df = spark.createDataFrame(rows, "g string, entity long, t0 long, v double")
    for bucket in (10, 500, 10**9):
        got = {r.entity: (float(r.cum), float(r.fall)) for r in ev.cum_drawdown(df, ["g"], "v", bucket).collect()}
        assert len(got) == len(rows)
        for g in {r[0] for r in rows}:
            cum, peak = 0.0, None
            for _, entity, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
                cum += v or 0.0
                peak = cum if peak is None else max(peak, cum)
                assert got[entity] == pytest.approx((cum, cum - peak), abs=1e-9)


def test_ranks_in_parts(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "b"]), draw.randrange(5), draw.choice([0.5, 0.25, 0.75]), draw.choice([0, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "entity long, g string, t0 long, score double, y int")
    for salt in (1, 7):
        got = sorted((r.g, r["rank"], r.entity) for r in ev.rank_topk(df, ["g"], 9, salt).collect())
        assert got == [(g, k, r[0]) for g in "ab" for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2], r[0]))[:9], 1)]
    one = {r.g: r for r in ev.precision_recall_at_k(df, ["g"], (3, 9)).collect()}
    best = [r[4] for r in sorted((r for r in rows if r[1] == "a"), key=lambda r: (-r[3], r[2], r[0]))]
    assert (one["a"].pos, one["a"].hits_3, one["a"].hits_9) == (sum(best), sum(best[:3]), sum(best[:9]))
