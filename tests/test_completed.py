"""Small cases of cohorts, reports, overlays, one-to-one merges and whole rule lists."""

import random
from collections import defaultdict
from statistics import median

import pytest

from vantage.operators import capture as cap
from vantage.operators import cohort as co
from vantage.operators import compare as cmp
from vantage.operators import evaluate as ev
from vantage.operators import gates as gt
from vantage.operators import samples as sm

DAY = 86400


def test_report_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), i, draw.randrange(100) * DAY, draw.randrange(2), draw.choice([None, 0.5, 2.0, 12.0, 25.0])) for i in range(120)]
    df = spark.createDataFrame(rows + [("c", 999, 5 * DAY, 1, None)], "rule string, entity long, t0 long, y int, multiple double")
    got = {r.rule: r for r in co.strategy_report(ev.strategy_returns(df), ["rule"], df, 100 * DAY).collect()}
    base = sum(r[3] for r in rows + [(0, 0, 0, 1)]) / 121
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert set(got) == {"a", "b", None, "c"}
    for rule, own in groups.items():
        own.sort(key=lambda r: (r[2], r[1]))
        g, total, peak, fall = got[rule], 0.0, float("-inf"), 0.0
        for r in own:
            total += min(r[4], 10.0) - 1.015 if r[4] is not None else 0.0
            peak = max(peak, total)
            fall = min(fall, total - peak)
        told = [r[4] for r in own if r[4] is not None]
        assert (g.n, g.n_hits) == (len(own), sum(r[3] for r in own))
        assert g.cum_r_cap == pytest.approx(total) and g.mean_r_cap == pytest.approx(total / len(told)) and g.dd_r_cap == pytest.approx(fall)
        assert g.cum_r_binary == pytest.approx(sum(8.985 if r[3] else -1.015 for r in own))
        assert g.median_multiple == median(told) and g.median_followup == median(100 - r[2] / DAY for r in own)
        assert g.followup_ge_14 == pytest.approx(sum(100 - r[2] / DAY >= 14 for r in own) / len(own))
        assert g.multiple_ge_20 == pytest.approx(sum((r[4] or 0) >= 20 for r in own) / len(own)) and g.lift == pytest.approx(g.hit_rate / base)
    assert (got["c"].cum_r_cap, got["c"].mean_r_cap, got["c"].median_multiple, got["c"].multiple_ge_10) == (0.0, None, None, 0.0)


def test_report_of_no_rows_is_empty(spark):
    df = spark.createDataFrame([], "rule string, entity long, t0 long, y int, multiple double")
    assert co.strategy_report(ev.strategy_returns(df), ["rule"], df, 0).count() == 0


def test_cohort_flags_and_counts(spark):
    rows = [(1, 0, 1, 5.0), (2, 80 * DAY, 0, 20.0), (3, 10 * DAY, 1, 20.0), (4, None, 0, 1.0), (5, 0, None, 50.0), (6, 0, 1, None)]
    flagged = co.cohort_flags(spark.createDataFrame(rows, "entity long, t0 long, hit int, top double"), 100 * DAY, 30, "hit", "top", 10.0)
    got = {r.entity: (r.followup_days, r.primary_ready, r.inconsistent) for r in flagged.collect()}
    assert got == {1: (100.0, True, True), 2: (20.0, False, True), 3: (90.0, True, False), 4: (None, False, False), 5: (100.0, True, False), 6: (100.0, True, False)}
    assert tuple(co.cohort_counts(flagged, "hit").first()) == (6, 3, 2, 3, 0, 2)


def test_overlay_by_hand(spark):
    nan = float("nan")
    live = spark.createDataFrame([(1, 3, 10.0, 1.0), (2, 3, 10.0, 1.0), (3, 3, 10.0, 1.0), (4, 2, None, nan), (5, None, 1.0, 1.0)], "k long, n long, usd double, age double")
    store = spark.createDataFrame([(1, 3, 12.5, 1.0), (2, 4, 9.0, 3.0), (4, 2, 7.0, None), (5, None, 2.0, 1.0)], "k long, buys long, usd double, age double")
    changed = cmp.overlay_changes(live, store, "k", ["usd", "age"], "n", "buys")
    wide = {r.k: (r.usd, r.usd_base, r.age_base) for r in cmp.overlay_wide(changed, ["usd", "age"]).collect()}
    assert wide == {1: (12.5, 10.0, None), 2: (10.0, None, None), 3: (10.0, None, None), 4: (7.0, None, None), 5: (1.0, None, None)}
    assert sorted(tuple(r) for r in cmp.overlay_long(changed, "k").collect()) == [(1, "usd", 10.0, 12.5, -2.5), (4, "usd", None, 7.0, None)]
    notes = {r.k: tuple(r)[1:] for r in cmp.overlay_notes(changed, "k").collect()}
    assert notes == {1: ("overlaid", 1, 1, 2.5, "usd"), 2: ("trades_not_exact", 2, 0, 2.0, "age"), 3: ("missing_in_store", 0, 0, None, None), 4: ("overlaid", 1, 1, None, None), 5: ("trades_not_exact", 1, 0, 1.0, "usd")}


@pytest.mark.parametrize("base, pack", [([1, 2], [1, 1]), ([1, 1], [1, 2])])
def test_merges_are_one_to_one(spark, base, pack):
    table = lambda keys: spark.createDataFrame([(k, 5, 1) for k in keys], "entity long, t0 long, n long")
    with pytest.raises(Exception, match="entity repeats"):
        ev.merge_pack(table(base).drop("n"), table(pack), ["n"], 2).collect()
    assert ev.merge_pack(table([1, 2, 3, None, None]).drop("n"), table([3, 1, 4, None, None]), ["n"], 2).where("matched").count() == 2


def test_time_or_slot(spark):
    rows = [(1, 5, 9, 5, 1), (2, 6, 0, 5, 1), (3, None, 1, 5, 1), (4, None, 2, 5, 1), (5, None, None, 5, 1), (6, None, 0, 5, None), (7, 4, None, None, 1)]
    got = {r.k: r.rule for r in gt.feature_time_gate(spark.createDataFrame(rows, "k long, ts long, slot long, t0 long, slot0 long")).collect()}
    assert got == {2: "after_t0", 4: "after_slot0", 5: "not_auditable", 6: "not_auditable", 7: "after_t0"}


def test_capture_audit_tells_fields_and_late_reads(spark):
    good = {"capture_id": "a", "complete": False, "mc0": 5.0, "t0": 100, "definition_version": "v", "capture_quality": "HIGH", "sol_usd_source": "pyth", "slot0": 1}
    rows = [good, good | {"capture_id": "b", "slot0": None}, good | {"capture_id": "c", "complete": True}]
    events = spark.createDataFrame(rows, "capture_id string, complete boolean, mc0 double, t0 long, definition_version string, capture_quality string, sol_usd_source string, slot0 long")
    reads = spark.createDataFrame([("a", 100), ("b", 101), ("b", 102), ("c", None), ("z", 500)], "capture_id string, at long")
    got = sorted(tuple(r) for r in gt.capture_audit(events, reads, ("slot0",), 1.0, 9.0, "v").collect())
    assert got == [("b", "future_read"), ("b", "missing_slot0"), ("c", "complete"), ("c", "future_read")]
    absent = gt.capture_audit(events.limit(1), reads.limit(0), ("slot0", "sig0"), 1.0, 9.0, "v").collect()
    assert [tuple(r) for r in absent] == [("a", "missing_sig0")]


def test_score_rows(spark):
    rows = [(1, "dune_cohort_x", True, 0.99), (2, " train_store_v1 ", True, 0.99), (3, "none", True, 0.98), (4, None, False, None), (5, "", None, 0.99)]
    got = defaultdict(list)
    for r in gt.score_row_gates(spark.createDataFrame(rows, "k long, creator_prior_source string, t0_refined boolean, score_threshold double"), "k", 0.99).collect():
        got[r.k].append(r.rule)
    every = ["prior_not_train", "t0_not_refined", "threshold_differs"]
    assert got == {3: every[::2], 4: every, 5: every[:2]}


def test_projects_are_listed(spark):
    rows = [("x", "SOL", 1.0, 2.0, 5.0, p) for p in ("a", "b", None)]
    pairs = spark.createDataFrame(rows, "bought string, sold string, bought_amount double, sold_amount double, usd double, project string")
    assert [r.project for r in cap.normalize_swaps(pairs, projects=("a", "c")).collect()] == ["a"] and cap.normalize_swaps(pairs).count() == 3


@pytest.mark.parametrize("sizes, cap", [([50, 30, 1, 1, 1, 1, 1, 1, 1, 1], 20), ([7, 7, 7, 7, 7, 7], 20), ([40, 40, 3, 1], 10), ([90, 5, 5], 33), ([3, 3, 3, 3], 2), ([5, 5], 100)])
def test_negatives_by_repeated_taking(spark, sizes, cap):
    rows = [(w * 1000 + i, w * 7 * DAY, 0) for w, n in enumerate(sizes) for i in range(n)] + [(10**6 + i, 0, 1) for i in range(5)] + [(10**7, None, None)]
    got = defaultdict(int)
    kept = sm.negatives_cap(spark.createDataFrame(rows, "entity long, t0 long, y int"), "y", cap, "entity").collect()
    for r in kept:
        got[r.entity // 1000] += r.y == 0
    want, goal = [max(round(n / sum(sizes) * min(cap, sum(sizes))), 1) for n in sizes], min(cap, sum(sizes))
    while sum(want) != goal:
        want[want.index(max(want))] += 1 if sum(want) < goal else -1
    want = sizes if sum(sizes) <= cap else [min(a, n) for a, n in zip(want, sizes, strict=True)]
    assert [got[w] for w in range(len(sizes))] == want and sum(r.y != 0 for r in kept if r.y is not None) == 5 and len(kept) == sum(want) + 6
