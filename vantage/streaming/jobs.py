"""Streams over events. Sinks are folders keyed by batch, so a batch that runs again replaces itself, and views over them
give the state; a restart goes on from the checkpoint. Where the folders would grow without end, they are merged into
a keyed table every few batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantage.sources.keyed import KeyedTable

#: Batches whose folders are merged into the keyed table at once.
EVERY = 16


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A table of files as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, checkpoint: str, mode: str, **start) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.foreachBatch(sink) if sink else writer.format(start["format"]).option("path", start["path"])).start()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table of a sink; empty where no batch has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _sightings(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/table", "entity long, first struct<ts:bigint,event_id:bigint,value:double>", ["entity"], {"first": F.min("first")})


def _peaks(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/table", "entity long, peak double, n long", ["entity"], {"peak": F.max("peak"), "n": F.sum("n")})


def _deltas(table: KeyedTable, path: str, after: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return _stored(table.spark, f"{path}/deltas", f"{schema}, batch int").where(F.col("batch") > after).drop("batch")


def _keep(table: KeyedTable, path: str, rows: Callable[[DataFrame], DataFrame], every: int) -> Callable[[DataFrame, int], None]:
    """A sink without stream state: a batch is reduced to a row for each of its keys and written to a folder of its own;
    every so many batches the folders are merged into the table, which then names the last batch it holds. Folders that the
    table held at the merge before are deleted, so readers see at most twice as many. A batch that the table holds is not
    written again."""

    def sink(batch: DataFrame, number: int) -> None:
        held = table.manifest().batch
        if number <= held:
            return
        table.merged(rows(batch)).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
        if number - held >= every:
            table.upsert(_deltas(table, path, held), number)
            table.drop_folders(f"{path}/deltas", held)
            table.vacuum()

    return sink


def first_sighting(events: DataFrame, inside: Column, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Keeps, for each entity, its least (ts, event_id) among events inside the band. Read with sightings().

    The least is merged and not remembered, so the stream has no state and an event may come as late as it likes.
    """
    point = F.struct("ts", "event_id", "value").alias("first")
    return _run(events.where(inside), _keep(_sightings(events.sparkSession, path), path, lambda b: b.select("entity", point), every), checkpoint, "append")


def sightings(spark: SparkSession, path: str) -> DataFrame:
    """(entity, ts, event_id, value): the earliest sighting of each entity, late ones included."""
    table = _sightings(spark, path)
    return table.merged(table.read().unionByName(_deltas(table, path, table.manifest().batch))).select("entity", "first.*")


def followup_peak(events: DataFrame, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Keeps each entity's largest value and number of events so far, without stream state. Read with peaks()."""
    one = F.lit(1).cast("long").alias("n")
    return _run(events, _keep(_peaks(events.sparkSession, path), path, lambda b: b.select("entity", F.col("value").alias("peak"), one), every), checkpoint, "append")


def peaks(spark: SparkSession, path: str, target: float) -> DataFrame:
    """(entity, peak, n, hit): a peak never falls, as the largest of all batches counts."""
    table = _peaks(spark, path)
    return table.merged(table.read().unionByName(_deltas(table, path, table.manifest().batch))).withColumn("hit", F.col("peak") >= target)


def flow_windows(events: DataFrame, captures: DataFrame, window: int, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """Joins the events (entity, at timestamp, ...) of a stream with captures (entity, t0 timestamp) of another, where the event lies
    in [t0 - window, t0]; rows leave the state once the watermark has passed. Sums follow in flows()."""
    left = events.withWatermark("at", late).alias("e")
    right = captures.withWatermark("t0", late).alias("c")
    near = (F.col("e.entity") == F.col("c.entity")) & (F.col("e.at") <= F.col("c.t0")) & (F.col("e.at") >= F.col("c.t0") - F.expr(f"interval {window} seconds"))
    joined = left.join(right, near).select("c.entity", "c.t0", "e.event_id", "e.side", "e.value")
    return _run(joined, None, checkpoint, "append", format="parquet", path=path)


def flows(spark: SparkSession, path: str) -> DataFrame:
    """(entity, t0, n, total) of the joined rows so far."""
    rows = _stored(spark, path, "entity long, t0 timestamp, event_id long, side string, value double")
    return rows.groupBy("entity", "t0").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def score_and_enter(events: DataFrame, priors: DataFrame, score: Column, threshold: float, cap: int, window: int, top_k: int, path: str, checkpoint: str, counters: str | None = None) -> StreamingQuery:
    """Each micro-batch: scores with static priors, keeps new entities at or above the threshold, ranks them by score, and
    accepts the best top_k within what the trailing window leaves of the cap. The batch's time is its largest ts.

    Accepted rows are appended; the room is counted over those of earlier batches, so running a batch again
    gives the same rows. The sum read from the table is one number. With `counters`, a folder, each batch leaves a
    row of what became of its rows, read with cycle_counters(); the numbers are observed while the batch is written, so
    they cost no pass of their own. A stage that is run again for a lost executor may be observed twice.
    """
    schema = "entity long, ts long, event_id long, score double, now long, batch int"

    def enter(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("ts")).first()[0]
        if now is None:
            return
        seen, best, fresh, entered = (Observation(f"{name}-{number}") for name in ("seen", "best", "fresh", "entered"))
        accepted = _stored(spark, path, schema).where(F.col("batch") < number)
        room = top_k if cap < 0 else min(top_k, max(0, cap - accepted.where(F.col("now") >= now - window).count()))
        scored = batch.join(priors, "entity", "left").withColumn("score", score)
        scored = scored.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score").isNull()).alias("n_unscored"), F.count_if(F.col("score") < threshold).alias("n_below")).where(F.col("score") >= threshold)
        one = scored.groupBy("entity").agg(F.max_by(F.struct("ts", "event_id", "score"), F.struct("score", -F.col("ts"), -F.col("event_id"))).alias("r")).select("entity", "r.*").observe(best, F.count(F.lit(1)).alias("n"))
        new = one.join(accepted.select("entity"), "entity", "left_anti").observe(fresh, F.count(F.lit(1)).alias("n"))
        if room:
            ranked = new.orderBy(F.desc("score"), "ts", "entity").limit(room).withColumn("now", F.lit(now))
            ranked.observe(entered, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        else:  # nothing enters; the rows are read for the counters only
            spark.createDataFrame([], schema.removesuffix(", batch int")).write.mode("overwrite").parquet(f"{path}/batch={number}")
            if counters is not None:
                new.write.format("noop").mode("overwrite").save()
        if counters is not None:
            told = [_observed(o) for o in (seen, best, fresh, *([entered] if room else []))]
            if told[0] is None:
                told[0] = batch.join(priors, "entity", "left").withColumn("score", score).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("score").isNull()).alias("n_unscored"), F.count_if(F.col("score") < threshold).alias("n_below")).first().asDict()
            n_best, n_new, n_in = ((t or {}).get("n", 0) for t in [*told[1:], None][:3])
            a = told[0]
            row = (number, now, a["n_rows"], a["n_unscored"], a["n_below"], a["n_rows"] - a["n_unscored"] - a["n_below"] - n_best, n_best - n_new, n_new - n_in, n_in)
            spark.createDataFrame([row], CYCLE).coalesce(1).write.mode("overwrite").parquet(f"{counters}/cycle={number}")

    return _run(events, enter, checkpoint, "append")


def _observed(one: Observation, seconds: float = 5.0) -> dict | None:
    """The numbers of an observation whose query has ended; None where the plan was cut short, as it is behind an empty input."""
    got: list[dict] = []
    waiter = threading.Thread(target=lambda: got.append(one.get), daemon=True)
    waiter.start()
    waiter.join(seconds)
    return got[0] if got and got[0] else None


#: What became of the rows of a batch; the last six add up to n_rows.
CYCLE = "batch long, now long, n_rows long, n_unscored long, n_below long, n_repeated long, n_known long, n_over_capacity long, n_entered long"


def cycle_counters(spark: SparkSession, counters: str) -> DataFrame:
    """A row for each batch: its rows without a score, below the threshold, of an entity that has a better row in the
    batch, of one that was accepted before, beyond the room, and entered."""
    return _stored(spark, counters, CYCLE + ", cycle int").drop("cycle")


def monitor(captures: DataFrame, start: int, end: int, slot: int = 900, low: float = 0.4) -> DataFrame:
    """(slot, n, n_low, problem) of slots of time with no captures, with a share of LOW quality above `low`, or with a
    complete one: slots are made from the range, so that silent ones show."""
    slots = captures.sparkSession.range(start - start % slot, end, slot).select(F.col("id").alias("slot"))
    seen = captures.groupBy((F.col("ts") - F.col("ts") % slot).alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == "LOW").alias("n_low"), F.count_if("complete").alias("n_complete"))
    return _problems(slots.join(seen, "slot", "left").na.fill(0, ["n", "n_low", "n_complete"]), low)


def monitor_stream(captures: DataFrame, heartbeats: DataFrame, late: str, path: str, checkpoint: str, slot: int = 900) -> StreamingQuery:
    """Counts a stream of captures (at timestamp, quality, complete) by slots of time, once the watermark has closed a slot.

    Heartbeats (at timestamp), one a slot from any clock, stand in the same windows and count nothing, so that a slot
    without captures shows. State is a row for each open slot. Rows that come more than `late` after the latest one may
    be dropped; rows without a time are. A closed slot is written once, also over restarts. Read with monitored().
    """
    seen = captures.select("at", (F.col("quality") == "LOW").alias("low"), "complete", F.lit(1).alias("k"))
    beats = heartbeats.select("at", F.lit(False).alias("low"), F.lit(False).alias("complete"), F.lit(0).alias("k"))
    rows = seen.unionByName(beats).where("at is not null").withWatermark("at", late)
    closed = rows.groupBy(F.window("at", f"{slot} seconds")).agg(F.sum("k").alias("n"), F.count_if("low").alias("n_low"), F.count_if("complete").alias("n_complete"))
    return _run(closed.select(F.unix_timestamp("window.start").alias("slot"), "n", "n_low", "n_complete"), None, checkpoint, "append", format="parquet", path=path)


def _problems(slots: DataFrame, low: float) -> DataFrame:
    problem = F.when(F.col("n") == 0, "silent").when(F.col("n_complete") > 0, "complete").when(F.col("n_low") > low * F.col("n"), "low_share")
    return slots.select("slot", "n", "n_low", problem.alias("problem")).where("problem is not null")


def monitored(spark: SparkSession, path: str, low: float = 0.4) -> DataFrame:
    """(slot, n, n_low, problem) of the closed slots that monitor() would list."""
    return _problems(_stored(spark, path, "slot long, n long, n_low long, n_complete long"), low)
