"""Agent event streams: routing, progress, fencing and windows, as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planwright.plans.registry import query
from planwright.sources.drawings import DERIVED, drawing_sql
from planwright.staging import shared_dir


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent events of ``events.parquet`` as a stream, with event times in the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").load(sf_dir, format="parquet")
    columns = DERIVED["agent_events"][2]
    rows = raw.selectExpr(*(f"{e.replace('//', 'div')} AS `{c}`" for c, e in columns.items()))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(out: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now, and return its result table."""
    spark, name = out.sparkSession, f"stream_{uuid.uuid4().hex}"
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{shared_dir(spark)}/planwright/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def route(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a query that hands each batch's events of a type to that type's writer."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for kind, write in handlers.items():
            write(batch.where(F.col("type") == kind), epoch)
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_EV = drawing_sql("agent_events")


@query(_EV + " SELECT type, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM agent_events WHERE type IN ('view', 'error', 'purchase', 'signup') GROUP BY 1")
def x1_x2_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables by type, written batch by batch; counted afterwards."""
    base = f"{shared_dir(spark)}/planwright/route-{uuid.uuid4().hex}"
    kinds = ("view", "error", "purchase", "signup")
    # a batch that is run again overwrites what it wrote
    handlers = {k: (lambda df, epoch, k=k: df.write.mode("overwrite").parquet(f"{base}/{k}/epoch={epoch}")) for k in kinds}
    route(stream(spark, sf_dir), handlers, f"{base}/checkpoint").awaitTermination()
    tables = [spark.read.parquet(f"{base}/{k}").select("type", "id") for k in kinds]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(_EV + " SELECT layout_id, count(*) AS defects, max(CASE WHEN type = 'purchase' THEN 1 ELSE 0 END) AS report FROM agent_events GROUP BY 1")
def x3_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals and flags of each layout."""
    s = stream(spark, sf_dir).groupBy("layout_id").agg(F.count("*").alias("defects"), F.max(F.when(F.col("type") == "purchase", 1).otherwise(0)).alias("report"))
    return drain(s, "complete")


@query(_EV + ", r AS (SELECT layout_id, arg_max(run_id, id) AS run_id FROM agent_events GROUP BY 1) SELECT e.id, e.run_id FROM agent_events e JOIN r USING (layout_id, run_id)")
def x4_run_fencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of stale runs go: only a layout's latest run counts."""
    from planwright.sources.drawings import drawing

    e = drawing(spark, sf_dir, "agent_events")
    active = e.groupBy("layout_id").agg(F.max_by("run_id", "id").alias("run_id"))
    return e.join(active, ["layout_id", "run_id"], "left_semi").select("id", "run_id")


@query(_EV + " SELECT layout_id, max(id) AS id, arg_max(type, id) AS type FROM agent_events GROUP BY 1")
def x5_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir).groupBy("layout_id").agg(F.max("id").alias("id"), F.max_by("type", "id").alias("type"))
    return drain(s, "complete")


@query(_EV + """, g AS (SELECT type, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY type ORDER BY ts)) < 60 THEN 0 ELSE 1 END AS new FROM agent_events),
s AS (SELECT type, ts, sum(new) OVER (PARTITION BY type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), b AS (SELECT type, k, count(*) AS n FROM s GROUP BY ALL)
SELECT type, count(*) AS bursts, CAST(sum(n) AS BIGINT) AS events, max(n) AS largest FROM b GROUP BY 1""")
def x8_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events less than 60 s apart, as session windows."""
    s = stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "60 seconds"), "type").agg(F.count("*").alias("n"))
    return drain(s, "complete").groupBy("type").agg(F.count("*").alias("bursts"), F.sum("n").alias("events"), F.max("n").alias("largest"))


@query(_EV + " SELECT type, date_trunc('day', ts) AS day, count(*) AS n FROM agent_events GROUP BY ALL")
def x9_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows under a watermark."""
    s = stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "type").agg(F.count("*").alias("n"))
    return drain(s, "complete").select("type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query(_EV + """ SELECT id, layout_id, count(*) FILTER (type = 'error') OVER w AS errors, min(id) OVER w AS oldest FROM agent_events WINDOW w AS (PARTITION BY layout_id ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def x10_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: of each event and the four before it in its layout, the errors and the least id."""
    from planwright.sources.drawings import drawing

    w = Window.partitionBy("layout_id").orderBy("ts", "id").rowsBetween(-4, 0)
    return drawing(spark, sf_dir, "agent_events").select("id", "layout_id", F.count_if(F.col("type") == "error").over(w).alias("errors"), F.min("id").over(w).alias("oldest"))


HEARTBEAT = "key string, kind string, seen long, beats long"


def heartbeats(events: DataFrame, key: str, idle_ms: int) -> DataFrame:
    """(key, kind, seen, beats): for each key a row ``events`` when some came, and a row ``idle`` whenever none came for ``idle_ms``, again and again until some do.

    ``seen`` counts the key's events so far, ``beats`` its idle rows since the last one. A key without events has no rows; a null key is a key. The clock is that of
    processing, so use an append sink and a processing-time trigger.
    """

    def beat(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, beats = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            kind, beats = "idle", beats + 1
        else:
            kind, beats = "events", 0
            seen += sum(len(b) for b in batches)
        state.update((seen, beats))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [k[0]], "kind": [kind], "seen": [seen], "beats": [beats]})

    keyed = events.select(F.col(key).cast("string").alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(beat, HEARTBEAT, "seen long, beats long", "append", GroupStateTimeout.ProcessingTimeTimeout)
