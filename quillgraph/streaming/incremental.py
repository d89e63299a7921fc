"""Incremental ingestion on Structured Streaming: watermarked scans, late data, and ledgers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, pattern: str, time: str = "ts") -> DataFrame:
    """A file stream with its event time as a timestamp: watermarks take no other type."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each key once within the delay: what arrives again, also late, is dropped; state older than the watermark goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, and reads what it wrote; both lie in the cluster's shared folder."""
    spark = stream.sparkSession
    shared = folder or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def merge_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Each batch goes to `merge`, which upserts it; a repeated batch has the same number, so merges can be made idempotent."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_violations(events: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """run_id, order, problem of ledger rows (run_id, order, event_id, type, payload map): unknown types, missing fields, repeated ids, gaps, and a first event that is no manifest."""
    from pyspark.sql import Window as W

    known = F.create_map(*[x for t, fields in required.items() for x in (F.lit(t), F.array(*map(F.lit, fields)))])
    fields = F.element_at(known, F.col("type"))
    missing = F.filter(fields, lambda f: ~F.map_contains_key("payload", f))
    run = W.partitionBy("run_id")
    checked = events.withColumn("at", F.row_number().over(run.orderBy("order", "event_id"))).withColumn("same", F.count("*").over(W.partitionBy("run_id", "event_id")))
    problems = F.array_compact(F.array(
        F.when(fields.isNull(), F.concat(F.lit("unknown type "), "type")), F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.concat_ws(",", missing))), F.when(F.col("same") > 1, F.lit("repeated event id")),
        F.when(F.col("order") != F.col("at"), F.lit("order is not contiguous")), F.when((F.col("at") == 1) & (F.col("type") != "manifest"), F.lit("no manifest first")),
    ))
    return checked.select("run_id", "order", F.explode(problems).alias("problem"))


def next_watermark(watermarks: DataFrame, scans: DataFrame) -> DataFrame:
    """topic, watermark: the scan's day where any source succeeded, else the old one."""
    s = scans.groupBy("topic").agg(F.max(F.when(F.col("ok"), F.col("scanned"))).alias("scanned"))
    return watermarks.join(s, "topic", "full_outer").select("topic", F.coalesce("scanned", "watermark").alias("watermark"))


def scan_from(watermark, today, overlap: int = 7, first: int = 30):
    """The day from which to scan: some days before the watermark, or a month back at first."""
    return F.coalesce(F.date_sub(watermark, overlap), F.date_sub(today, first))
