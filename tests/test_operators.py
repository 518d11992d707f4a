"""Small cases of the point-in-time operators."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vantage.operators import capture as cap
from vantage.operators import evaluate as ev
from vantage.operators import features as ft
from vantage.operators import gates as gt
from vantage.operators import labels as lb
from vantage.operators import normalize as nz
from vantage.operators import scores as sc
from vantage.plans import registry

T0 = 1_000_000
SF = "/root/testdata/sf0.001"


def trades(spark, rows):
    ddl = "entity string, ts long, id long, side string, usd decimal(18,4), tok double, base double, trader string, venue string"
    from decimal import Decimal

    return spark.createDataFrame([(e, t, i, s, Decimal(str(u)), k, b, w, "x") for i, (e, t, s, u, k, b, w) in enumerate(rows)], ddl)


def captures(spark):
    return spark.createDataFrame([("m", T0, 1.0)], "entity string, t0 long, p0 double")


def test_microstructure_case(spark):
    rows = trades(spark, [("m", T0 - 20, "buy", 100, 1000.0, 1.0, "A"), ("m", T0 - 18, "buy", 50, 500.0, 0.5, "B"), ("m", T0 - 5, "sell", 10, 100.0, 0.1, "A"), ("m", T0 + 1, "buy", 999, 1.0, 9.0, "C")])
    pit = cap.pit_join(captures(spark), rows)
    got = ft.microstructure_pack(pit, {"60s": 60}).first()
    assert (got.buy_n, got.sell_n, got.buy_usd, got.first_buy_usd, got.buyers_60s, got.oldest) == (2, 1, 150.0, 100.0, 2, 20)
    assert got.sniper_share == 1.0


def test_buy_volume_counts_the_window_only_and_zero(spark):
    rows = trades(spark, [("m", T0 - 10, "buy", 100, 1.0, 1.0, "A"), ("m", T0 + 1, "buy", 9999, 1.0, 1.0, "A"), ("m", T0 - 90, "buy", 50, 1.0, 1.0, "A")])
    c = captures(spark)
    got = ft.buy_volume(c, cap.pit_join(c, rows), 60).first()
    assert (got.buy_usd, got.buy_n) == (100.0, 1)
    got = ft.buy_volume(c, cap.pit_join(c, rows.limit(0)), 60).first()
    assert (got.buy_usd, got.buy_n) == (0.0, 0)


def test_creator_priors_strict(spark):
    day = 86400
    rows = [("this", "c", T0 - 30), ("a", "c", T0 - 3 * day), ("b", "c", T0 - 20 * day), ("later", "c", T0 + day), ("other", "d", T0 - day), ("none", None, T0)]
    df = spark.createDataFrame([(e, c, t, "abc", "s") for e, c, t in rows], "entity string, creator string, created long, name string, symbol string")
    got = {r.entity: r for r in lb.creator_priors(df, strict=True).collect()}
    assert (got["this"].prior_d7, got["this"].prior_d30, got["this"].prior_all) == (1, 2, 2)
    assert got["none"].prior_all == 0


def test_forward_labels(spark):
    prices = spark.createDataFrame([("m", T0 + 600, 2.0), ("m", T0 + 7200, 12.0), ("m", T0, 99.0)], "entity string, ts long, price double")
    got = lb.forward_labels(captures(spark), prices, {"1h": 3600, "6h": 21600}).first()
    assert (got.hit_6h, got.multiple_6h, got.time_6h) == (True, 12.0, 7200)
    assert (got.hit_1h, got.multiple_1h, got.time_1h) == (False, 2.0, None)
    none = lb.forward_labels(captures(spark), prices.limit(0), {"1h": 3600}).first()
    assert (none.hit_1h, none.multiple_1h) == (None, None)


def test_future_reads(spark):
    rows = spark.createDataFrame([(T0 - 3, T0), (T0, T0), (T0 + 1, T0), (None, T0)], "feature_ts long, t0 long")
    assert {r.rule for r in ev.future_reads(rows, "feature_ts").collect()} == {"after_t0", "missing_time"}


def test_embargo(spark):
    day = 86400
    rows = spark.createDataFrame([(i, t * day) for i, t in enumerate((1, 5, 70, 75, 141))], "entity int, t0 long")
    got = {r.entity: r.part for r in ev.embargo_split(rows, 10 * day, 80 * day, 150 * day, 30 * day).collect()}
    assert got == {0: "train", 1: "train", 2: "val", 3: "val", 4: "test"}
    purged = {r.entity: r.part for r in ev.embargo_split(rows, 10 * day, 80 * day, 150 * day, 30 * day, 66 * day).collect()}
    assert purged == {0: "train", 2: "val", 3: "val", 4: "test"}
    assert {r.part for r in ev.embargo_split(rows, 10 * day, 80 * day, 106 * day, 30 * day).collect()} == {"train", "val"}
    assert ev.embargo_split(rows, 10 * day, 20 * day, 150 * day, 30 * day).count() == 0


def test_label_violations(spark):
    prices = spark.createDataFrame([("m", T0, 2.0), ("m", T0 - 1, 2.0), ("m", T0 + 1, 0.0), ("m", T0 + 1, None), ("m", None, 1.0), ("m", T0 + 2, 3.0)], "entity string, ts long, price double")
    assert sorted(r.rule for r in lb.label_violations(captures(spark), prices).collect()) == ["missing_time", "not_after_t0", "not_after_t0", "price", "price"]
    assert lb.peak_hit(captures(spark), prices, 3.0).first().hit and not lb.peak_hit(captures(spark), prices.limit(0), 3.0).first().hit


def test_returns_without_a_multiple(spark):
    rows = spark.createDataFrame([(1, 1, "f", None, 0), (2, 2, "f", 12.0, 1), (3, 3, "f", 0.5, 0)], "entity int, t0 long, fold string, multiple double, y int")
    got = {r.entity: r for r in ev.strategy_returns(rows, 0.0).collect()}
    assert got[1].r_cap is None and got[1].r_binary == -1.0 and got[2].r_cap == 9.0 and got[2].r_wide == 11.0
    one = ev.strategy_summary(ev.strategy_returns(rows, 0.0), ["fold"]).first()
    assert (one.n, one.n_returns, one.cum_r, one.drawdown) == (3, 2, 8.5, -0.5)


def test_row_index_equals_global_order(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11) for i in range(50)], "entity int, t0 int")
    got = ev.row_index(rows, "t0", "entity", bucket=F.floor(F.col("t0") / 3)).collect()
    want = sorted(range(50), key=lambda i: ((i * 37) % 11, i))
    assert [r.entity for r in sorted(got, key=lambda r: r.idx)] == want


def test_trailing_capacity_against_a_loop(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, T0 + rnd.choice((0, 20000)) + rnd.randrange(9000), float(rnd.randrange(9))) for i in range(400)]
    rows += [(400, 3590, 1.0), (401, 3591, 2.0), (402, 3610, 3.0), (403, 3611, 4.0), (404, 7260, 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts long, score double")
    for cap_, top_k in ((7, 2), (2, 5), (0, 5), (-1, 1)):
        taken, want = [], set()
        for now in sorted({-(-r[1] // 60) * 60 for r in rows}):
            passed = sorted((r for r in rows if -(-r[1] // 60) * 60 == now), key=lambda r: (-r[2], r[1], r[0]))
            room = len(passed) if cap_ < 0 else max(0, cap_ - sum(t >= now - 3600 for t in taken))
            accepted = passed[:room][:top_k]
            taken += [now] * len(accepted)
            want |= {r[0] for r in accepted}
        got = ev.trailing_capacity(events, cap_, 3600, top_k, 60).collect()
        assert len(got) == len(rows) and {r.event_id for r in got if r.accepted} == want


def test_normalize_swaps_and_band(spark):
    rows = spark.createDataFrame([("m", "SOL", 10.0, 1.0, 100.0), ("SOL", "m", 1.0, 5.0, 90.0), ("m", "n", 1.0, 1.0, 9.0), ("m", "SOL", 0.0, 1.0, 5.0), ("m", "SOL", 1.0, 1.0, 0.5)], "bought string, sold string, bought_amount double, sold_amount double, usd double")
    assert sorted((r.side, r.tok, r.base) for r in cap.normalize_swaps(rows).collect()) == [("buy", 10.0, 1.0), ("sell", 5.0, 1.0)]
    band = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (2.0,), (2.1,), (None,)], "v double")
    assert band.where(cap.in_band(F.col("v"), 1.0, 2.0)).count() == 2


def test_curve_path_rises_on_buys(spark):
    rows = trades(spark, [("m", 1, "buy", 1, 1.0, 5.0, "A"), ("m", 2, "sell", 1, 1.0, 2.0, "A")])
    got = [r.curve_price for r in cap.curve_path(rows).orderBy("ts").collect()]
    assert got[0] > got[1] > 30 * 30 / (30 * 1.073e9)


def _norm(df):
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        number = isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_))
        return f"{float(v):.10g}" if number else str(v)  # pandas turns whole numbers with nulls into floats

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_normalised_payloads(spark):
    """Three rows, one after t0: two trades, 42.5 bought in the last 60 s."""
    row = lambda at, side, usd: f'{{"blockTimeMs": {at * 1000}, "side": "{side}", "valueUsd": "{usd}", "valueNative": "0.5", "trader": {{"address": "W"}}, "baseAmount": {{"raw": "2500000", "decimals": 6}}}}'
    t0 = 1_800_000_000
    rows = [("m", t0, row(t0 - 30, "buy", "42.5")), ("m", t0, row(t0 - 90, "SELL", "7")), ("m", t0, row(t0 + 1, "buy", "999")), ("m", t0, '{"timestamp": "2027-01-15T08:00:00", "is_buy": true, "sol_amount": 2}'), ("m", t0, "nonsense"), ("m", t0, None)]
    got = sorted((r.ts - t0, r.side, r.usd, r.tok, r.base, r.trader) for r in nz.frontend_trades(spark.createDataFrame(rows, "entity string, t0 long, payload string"), 100.0).collect())
    assert got == [(-90, "sell", 7.0, 2.5, 0.5, "W"), (-30, "buy", 42.5, 2.5, 0.5, "W"), (0, "buy", 200.0, 0.0, 2.0, None)]


def test_capture_schema_rules(spark):
    ddl = "capture_id string, complete boolean, mc0 double, definition_version string, sol_usd_source string, capture_quality string, t0 long"
    rows = [("ok", False, 9.0, "v1", "pyth", "HIGH", 1), ("a", True, 9.0, "v1", "pyth", "HIGH", 1), ("b", False, 99.0, "v1", "pyth", "MED", 1), ("c", False, 9.0, "v1", "other", "HIGH", None), ("d", False, 9.0, "v1", None, "MED", 1), ("e", False, 9.0, "v1", "pyth", "MED", 1), ("e", False, 9.0, "v0", "pyth", "MED", 1)]
    got = sorted((r.capture_id, r.rule) for r in gt.capture_schema(spark.createDataFrame(rows, ddl), 8.0, 20.0, "v1").collect())
    assert got == [("a", "complete"), ("b", "band"), ("c", "high_source"), ("c", "t0"), ("d", "source"), ("e", "duplicate"), ("e", "version")]


def test_column_gates():
    assert gt.leak_columns(["buy", "hit_10x", "peak"], ["peak"]) == ["hit_10x", "peak"]
    assert gt.recipe_difference(["a", "b", "c"], ["b", "a", "x"]) == {"missing": ["c"], "extra": ["x"], "moved": ["b", "a"]}


def test_samples_keep_what_they_must(spark):
    rows = spark.range(100).select(F.col("id").alias("entity"), (F.col("id") * 86400).alias("t0"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = {r.entity for r in sc.forced_sample(rows, F.col("entity") < 5, F.col("entity") % 2 == 0, 20, "entity").collect()}
    assert len(got) == 20 and set(range(5)) <= got and all(e < 5 or e % 2 == 0 for e in got)
    assert sc.forced_sample(rows, F.col("entity") < 30, F.lit(False), 20, "entity").count() == 30
    capped = sc.week_cap(rows, "y", 30, "entity").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in capped}[1] == 25 and {r.y: r["count"] for r in capped}[0] <= 30


def test_lite_score_needs_the_bought_volume(spark):
    names = ("buy_vol_usd_60s", "sniper_vol_share_5s", "top1_buyer_vol_share", "top5_buyer_vol_share", "age_s", "progress_curve_proxy", "net_sol_curve", "creator_prior_mints_7d", "creator_prior_mints_30d")
    rows = spark.createDataFrame([(None,) * 9, (100.0,) + (None,) * 8], ", ".join(f"{n} double" for n in names))
    got = sorted((r.score is None, r.score) for r in sc.lite_score(rows, {"buy_vol_usd_60s": 1.0}, 0.0).collect())
    assert got[0][1] == pytest.approx(1 / (1 + np.exp(-np.log1p(100) / 10))) and got[1] == (True, None)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
