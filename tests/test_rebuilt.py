"""Small cases of the curve catalogue, cuts, mirrored samples, native legs and entry counters against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vantage.operators import evaluate as ev
from vantage.operators import features as ft
from vantage.operators import normalize as nz
from vantage.operators import samples as sm
from vantage.streaming import jobs

EVENT = "event_id long, entity long, ts long, side string, value double"


def test_curve_catalogue_by_hand(spark):
    # prices 5, 12, 15, 8, 11 at 0, 100, 130, 200, 260; t0 = 300; at 10 or above from 100 to 200 and from 260 on
    trades = [(0, "buy", 50.0, 10.0), (100, "buy", 120.0, 10.0), (130, "sell", 15.0, 1.0), (200, "buy", 16.0, 2.0), (260, "buy", 11.0, 1.0), (270, "buy", 3.0, 0.0)]
    rows = [(1, 300, 2.0, 300 - t, t, t, s, u, q, u / 2.0, "v") for t, s, u, q in trades]
    pit = spark.createDataFrame(rows, "entity long, t0 long, p0 double, age long, ts long, id long, side string, usd double, tok double, base double, venue string").withColumn("usd", F.col("usd").cast("decimal(18,4)"))
    got = ft.curve_catalogue(pit, 10.0, 150, 2.0, 30.0, 1000.0, 800.0, 100.0).first()
    net_usd, net_tok = 50 + 120 - 15 + 16 + 11 + 3, 10 + 10 - 1 + 2 + 1
    assert (got.time_in_band, got.time_above, got.max_buy_base) == (140, 40, 8.0)
    assert got.liq_real == net_usd / 2 and got.liq_over_mc == pytest.approx(net_usd / 200) and got.inv_k == pytest.approx((30 + net_usd / 2) * (1000 - net_tok)) and got.curve_share == pytest.approx((800 - net_tok) / 100)


@pytest.mark.parametrize("bucket", [10, 10**9])
def test_next_times_over_buckets(spark, bucket):
    draw = random.Random(2)
    rows = [(draw.randrange(3), draw.randrange(200)) for _ in range(120)]
    got = sorted((r.g, r.ts, r.nxt) for r in ft.next_time(spark.createDataFrame(rows, "g long, ts long"), ["g"], "ts", "nxt", bucket).collect() if r.nxt is not None)
    want = []
    for g in range(3):
        own = sorted(t for x, t in rows if x == g)
        want += [(g, a, b) for a, b in zip(own, own[1:], strict=False)]
    assert got == sorted(want)


def cut_by_trying(y):
    at = int(len(y) * 0.7)
    for cut in range(at, max(at - 40, len(y) // 2), -1):
        if len({v for v in y[:cut] if v is not None}) == 2 and len({v for v in y[cut:] if v is not None}) == 2:
            return cut
    return at


def test_single_cut_equals_trying_all(spark):
    draw = random.Random(6)
    cases = [[0] * 10, [1] * 9 + [0], [0, 1] * 5, [0] * 8 + [1, 0, 1, 0, 0], [1] + [0] * 200, [0] * 70 + [1] + [0] * 60, [None, 1, 0, None, 0, 1, 1], [1]] + [[draw.choice([0, 0, 0, 0, 1]) for _ in range(n)] for n in (3, 5, 8, 13, 40)]
    for y in cases:
        df = spark.createDataFrame([(i, i * 999_999, v) for i, v in enumerate(y)], "entity long, t0 long, y int")
        got = {r.entity: r.part for r in ev.single_cut(df, "y").collect()}
        cut = cut_by_trying(y)
        assert got == {i: "train" if i < cut else "test" for i in range(len(y))}, y


def test_folds_where_the_rows_allow_them(spark):
    df = spark.range(200).select(F.col("id").alias("entity"), (F.col("id") * 86400).alias("t0"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    assert ev.folds_or_cut(df, "y").select("fold").distinct().count() == 5
    assert ev.folds_or_cut(df.where("entity < 70"), "y").select("fold").distinct().count() == 1
    late = df.withColumn("y", (F.col("entity") > 150).cast("int"))  # no positive in the first train parts
    assert ev.folds_or_cut(late, "y").select("fold").distinct().count() == 1


def slots(sizes, goal):
    total = sum(sizes.values())
    if not total:
        return dict.fromkeys(sizes, 0)
    out = {w: s * goal // total for w, s in sizes.items()}
    for w in sorted(sizes, key=lambda w: (-(sizes[w] * goal % total), w))[: goal - sum(out.values())]:
        out[w] += 1
    return out


@pytest.mark.parametrize("n_pos,n_neg", [(30, 90), (500, 90), (40, 10_000), (0, 50)])
def test_mirrored_sample_by_hand(spark, n_pos, n_neg):
    draw = random.Random(5)
    rows = [(i, draw.choice([0, 1, 1, 2, 3, 5]) * 7 * 86400 + 10, int(draw.random() < 0.3)) for i in range(400)]
    rows = [r for r in rows if not (r[2] == 0 and r[1] == 10 and r[0] % 5)] + [(900, None, 1), (901, 10, None), (902, 10, 3)]
    df = spark.createDataFrame(rows, "entity long, t0 long, y int").repartition(6)
    got = sm.mirrored_sample(df, "y", n_pos, n_neg, "entity").collect()
    week = lambda t: (t + 3 * 86400) // (7 * 86400)
    p, m = (Counter(week(t) for _, t, y in rows if t is not None and y == c) for c in (1, 0))
    weeks = sorted({*p, *m})
    have_p, have_m = sum(p.values()), sum(m.values())
    gp = min(n_pos, have_p)
    gn = min(have_m, have_p if have_p < n_pos else n_neg) if gp else 0
    kp = slots({w: p[w] for w in weeks}, gp)
    want = slots(kp, gn)
    c = {w: min(m[w], want[w]) for w in weeks}
    more = slots({w: m[w] - c[w] for w in weeks}, gn - sum(c.values()))
    expected = {(1, w): kp[w] for w in weeks if kp[w]} | {(0, w): c[w] + more[w] for w in weeks if c[w] + more[w]}
    assert Counter((r.y, week(r.t0)) for r in got) == expected and len({r.entity for r in got}) == len(got)
    assert sum(v for (y, _), v in expected.items() if y == 0) == gn
    assert {r.entity for r in sm.mirrored_sample(df.repartition(3), "y", n_pos, n_neg, "entity").collect()} == {r.entity for r in got}


LEGS = "tx long, kind string, err boolean, mint string, payer string, curve string, transfers array<struct<mint:string,sender:string,receiver:string,amount:double>>, natives array<struct<sender:string,receiver:string,amount:bigint>>, balances array<struct<account:string,change:bigint>>"


def test_native_legs(spark):
    got_a, got_b = ("m", "bc", "a", 1e8), ("m", "bc", "b", 5e7)
    pays = [("a", "bc", 29_629_630_000), ("b", "bc", 24_758_445_111)]
    row = lambda tx, transfers, natives, balances, payer="a", curve="bc": (tx, "SWAP", False, "m", payer, curve, transfers, natives, balances)
    rows = [
        row(1, [got_a, got_b], pays, [("bc", 54_388_075_111)]),
        row(2, [got_a, got_b], [("a", "bc", 10**9), ("a", "bc", 5 * 10**8), ("b", "x", 7), (None, "bc", 9)], None),  # b paid nothing to the curve
        row(3, [got_a], [], [("x", 5), ("bc", -4), ("bc", 1_000_000_000), ("bc", 7)]),
        row(4, [("m", "bc", "a", 1.0), ("m", "bc", "b", 1.0), ("m", "bc", "c", 1.0)], None, [("bc", 100)]),
        row(5, [got_a], None, None),
        row(6, [got_a, (nz.NATIVE[1], "a", "bc", 2.0)], pays, None),  # a leg has a base
        row(7, [("m", "bc", "bc", 5.0), ("m", "bc", None, 5.0)], pays, [("bc", 9)]),
        row(8, [got_a], pays, None, curve=None),
        (9, "SWAP", True, "m", "a", "bc", [got_a], pays, None),
    ]
    got = {}
    for r in nz.native_legs(spark.createDataFrame(rows, LEGS)).collect():
        got.setdefault(r.tx, []).append((r.side, r.trader, r.tok, r.base))
    assert got[1] == [("buy", "a", 1e8, 29.62963), ("buy", "b", 5e7, 24.758445111)]
    assert got[2] == [("buy", "a", 1e8, 1.5)] and got[3] == [("buy", "a", 1e8, 1.0)]
    assert sum(round(b * 1e9) for *_, b in got[4]) == 100 and [round(b * 1e9) for *_, b in got[4]] == [33, 33, 34]
    assert got[5] == got[8] == [("buy", "a", 1e8, 0.0)] and got[6] == [("buy", "a", 1e8, 2.0)] and 9 not in got


def cycles_by_hand(batches, priors, threshold, cap, window, top_k):
    taken, out = {}, []
    for number, batch in enumerate(batches):
        now = max(e[2] for e in batch)
        room = min(top_k, max(0, cap - sum(t >= now - window for t in taken.values())))
        scored = [(None if e[4] is None else e[4] + priors.get(e[1], 0.0), e) for e in batch]
        passing = [(s, e) for s, e in scored if s is not None and s >= threshold]
        best = {}
        for s, e in passing:
            if e[1] not in best or (s, -e[2], -e[0]) > (best[e[1]][0], -best[e[1]][1][2], -best[e[1]][1][0]):
                best[e[1]] = (s, e)
        new = sorted((-s, e[2], e[1]) for s, e in best.values() if e[1] not in taken)
        for _, _, entity in new[:room]:
            taken[entity] = now
        n = [len(batch), sum(s is None for s, _ in scored), sum(s is not None and s < threshold for s, _ in scored), len(passing) - len(best), len(best) - len(new), len(new) - len(new[:room]), len(new[:room])]
        assert sum(n[1:]) == n[0]
        out.append((number, now, *n))
    return out


def test_cycle_counters_equal_a_recount(spark, tmp_path):
    draw = random.Random(12)
    batches = [[(100 * k + i, draw.randrange(25), k * 1500 + draw.randrange(900), "x", draw.choice([None, 0.1, 0.4, 1.0, 2.0, draw.random()])) for i in range(30)] for k in range(4)]
    batches += [[(900, 1, 6100, "x", 0.0), (901, 2, 6100, "x", 0.1)], [(902, 90, 6200, "x", 3.0)], [(903, 91, 60_000, "x", 3.0)]]
    priors = {1: 0.5, 2: 0.25, 3: 0.125}
    known = spark.createDataFrame(list(priors.items()), "entity long, prior double")
    source, out, state, counters = (str(tmp_path / x) for x in ("in", "out", "state", "cycles"))
    assert jobs.cycle_counters(spark, counters).count() == 0
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{source}/{k}")
        stream = jobs.replay(spark, f"{source}/*", spark.createDataFrame([], EVENT).schema)
        jobs.score_and_enter(stream, known, F.col("value") + F.coalesce("prior", F.lit(0.0)), 0.9, 8, 3600, 5, out, state, counters).awaitTermination()
    assert sorted(map(tuple, jobs.cycle_counters(spark, counters).collect())) == cycles_by_hand(batches, priors, 0.9, 8, 3600, 5)
