"""Work that must not grow faster than the input: batches of a replay, payloads parsed once, tables written once."""

from pyspark.sql import functions as F

from vantage.operators import normalize as nz
from vantage.sources import files


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_a_replay_stay_near_a_hundred(spark, tmp_path):
    assert files.batch_size(0, 1000) == files.batch_size(100_000, 1000) == 1000
    assert files.batch_size(6_000_000, 1000) == 60_000
    rows = spark.range(3000).withColumnRenamed("id", "k")
    files.write_batches(rows, str(tmp_path / "b"), files.batch_size(3000, 10), "k")
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.select("batch").distinct().count() <= 2 * files.BATCHES and back.agg(F.sum("k")).first()[0] == 2999 * 1500


TRANSFERS = "array<struct<mint:string,sender:string,receiver:string,amount:double>>"


def test_transfer_lists_are_filtered_once_a_row(spark):
    t = "array(named_struct('mint', 'm', 'sender', 'pool', 'receiver', 'a', 'amount', 2D), named_struct('mint', 'q', 'sender', 'a', 'receiver', 'pool', 'amount', 5D))"
    rows = spark.range(1).selectExpr("id as tx", "'SWAP' as kind", "false as err", "'m' as mint", "'p' as payer", f"{t} as transfers")
    out = nz.transfer_legs(rows, "q")
    assert [tuple(r) for r in out.collect()] == [(0, "buy", "a", 2.0, 5.0)]
    lists = spark.createDataFrame([], f"tx long, kind string, err boolean, mint string, payer string, transfers {TRANSFERS}")
    assert nz.transfer_legs(lists, "q")._jdf.queryExecution().analyzed().toString().count("Generate inline") == 4


def test_payloads_are_parsed_once_a_row(spark):
    rows = spark.createDataFrame([(1, 9, '{"timestamp": "5", "side": "Buy", "valueUsd": "2"}'), (1, 9, None)], "entity long, t0 long, payload string")
    out = nz.frontend_trades(rows.repartition(1))
    assert [(r.ts, r.side, r.usd) for r in out.collect()] == [(5, "buy", 2.0)]
    assert _plan(out).count("from_json") == 1
    assert _plan(nz.gql_trades(rows.repartition(1), "a", "b", 150.0)).count("from_json") == 1


def test_labels_are_computed_once_for_all_that_reads_them(spark):
    from vantage.plans import registry

    data = "/root/testdata/sf0.001"
    for df in (registry.predictions(spark, data), *registry.derived._scores(spark, data)):
        assert "Join" not in _plan(df) and "Aggregate" not in _plan(df)


def test_trades_shuffle_times_and_sums_instead_of_their_columns(spark):
    from vantage.sources.bindings import trades

    plan = _plan(trades(spark, "/root/testdata/sf0.001").select("entity", "ts", "usd", "trader"))
    below = plan[plan.index("Join") :].splitlines()[1]
    assert "Project" in below and "l_discount" not in below.split(" AS ")[-1] and " AS usd" in below and " AS ts" in below


def test_trades_before_a_capture_are_computed_once_for_all_that_reads_them(spark):
    from vantage.plans import registry

    for name in ("a6_repriced_usd_pack", "a38_curve_catalogue"):
        assert "l_orderkey" not in _plan(registry.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_prices_and_times_are_shuffled_once(spark):
    from vantage.plans import registry

    for name in ("a13_relabel_two_sources", "w10_capture_aligned"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan[: plan.find("Initial Plan")] and "REPARTITION_BY_COL" in plan, name


def test_the_order_of_a_trade_table_is_sorted_by_plain_columns(spark):
    from vantage.plans import registry

    window = _plan(registry.queries()["g14_trade_table"](spark, "/root/testdata/sf0.001"))
    assert "Window" in window and "struct" not in window and "pumpdotfun, venue" not in window
