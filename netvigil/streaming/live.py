"""The detection pipeline over streams: one query stores events, another raises alerts.

``ingest_stream`` writes each batch of a source as a part of the event table. Events are
numbered by their place in the source; lines that can't be read go to ``quarantine``,
rows too far behind the newest event to ``late``; none is lost. A part is written once:
a batch that runs again finds it, or writes it anew with the same numbers.

``detect_stream`` reads the event table as it grows. Window features are keyed state
(``windows``), so a batch costs what its own events and keys cost. When each key last
raised an alert, and the latest alerts of each source, go on from batch to batch in two
small tables. Alerts, their hash chain and the metrics are stored before the offsets of
the source move on, and a batch that runs again replaces its own parts.

Tables at ``path``: events, late, quarantine, alerts, heads, metrics; state of the last
two batches: newest, emitted, sources.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netvigil.operators import alerts, detectors, store
from netvigil.operators.detectors import Config
from netvigil.operators.reputation import Owners, prepare
from netvigil.sources import logs
from netvigil.streaming import windows

#: Seconds that a row may come behind the newest event.
DELAY_SECONDS = 60
#: Seconds that a key's last alert is kept: the longest time in which a repeat is dropped, twice.
EMITTED_SECONDS = 600
#: The state store that keyed windows need.
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a part was written to its end."""
    place, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def _drop(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def _folder(spark: SparkSession, path: str) -> str:
    """The path of a folder, which is there now, so that a stream can wait for its files."""
    place, files = _path(spark, path)
    files.mkdirs(place)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _written(spark, path) else None


def _keep(rows: DataFrame, path: str, name: str, number: int) -> DataFrame:
    """Writes the state after a batch, and drops that of the last but two: a batch that runs again needs the one before it."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/{name}/{number}")
    if number > 1:
        _drop(spark, f"{path}/{name}/{number - 2}")
    return spark.read.parquet(f"{path}/{name}/{number}")


def _started(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def ingest_stream(events: DataFrame, path: str, once: bool = True, delay_s: int = DELAY_SECONDS) -> StreamingQuery:
    """Stores a stream of events (``logs.EVENT``, or with position and corrupt as sources give them) at ``path``/events."""

    def batch(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        if _written(spark, f"{path}/events/batch={number}"):
            return
        frame.persist()
        try:
            rows = logs.numbered(frame, number) if "position" in frame.columns else frame
            if "corrupt" in rows.columns:
                bad = rows.where("corrupt is not null").select("corrupt", *(["seq", "position.source"] if "position" in rows.columns else []))
                bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
                rows = rows.where("corrupt is null")
            rows = rows.drop("corrupt", "position")
            before = _read(spark, f"{path}/newest/{number - 1}")
            known = before.first()["ts_us"] if before is not None else None
            bound = None if known is None else known - delay_s * 1_000_000
            newest = rows.agg(F.max("ts_us").alias("ts_us")).select(F.greatest("ts_us", F.lit(known).cast("long")).alias("ts_us"))
            _keep(newest, path, "newest", number)
            if bound is not None:
                rows.where(F.col("ts_us") <= bound).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
                rows = rows.where(F.col("ts_us") > bound)
            rows.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        finally:
            frame.unpersist()

    return _started(events.writeStream.option("checkpointLocation", f"{path}/checkpoint-ingest").foreachBatch(batch), once)


def detect_stream(spark: SparkSession, path: str, cfg: Config = Config(), asn: DataFrame | Owners | None = None, once: bool = True, delay_s: int = DELAY_SECONDS, per_batch: int = 100) -> StreamingQuery:
    """Raises alerts of the events stored at ``path`` into its alert table; per_batch: files of events in a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    asn = prepare(asn)
    fields = ", ".join(f"{c} {t}" for c, t in (windows.CARRIED | {"tcp_flags": "string"}).items())
    stored = spark.readStream.schema(fields).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(_folder(spark, f"{path}/events"))

    def batch(frame: DataFrame, number: int) -> None:
        session, started = frame.sparkSession, time.monotonic()
        found = frame.persist()
        fresh = None
        try:
            last, sources = (_read(session, f"{path}/{name}/{number - 1}") for name in ("emitted", "sources"))
            newest, rows = found.agg(F.max("ts_us"), F.count_distinct("seq")).first()
            fresh = alerts.with_ids(alerts.refractory(_candidates(found, cfg, asn), last=last)).persist()
            emitted = alerts.last_emitted(fresh, last)
            if newest is not None:
                emitted = emitted.where(F.col("ts_us") >= newest - EMITTED_SECONDS * 1_000_000)
            _keep(emitted, path, "emitted", number)
            _keep(alerts.correlation_state(fresh, sources), path, "sources", number)
            added = store.append_batch(alerts.with_correlated(fresh, sources), path, number)
            seconds = max(time.monotonic() - started, 1e-4)
            stamp = F.date_format(F.timestamp_micros(F.lit(newest or 0)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            figures = session.range(1).select(stamp.alias("metric_ts"), F.lit(rows).alias("events_total"), F.lit(added).alias("alerts_total"), F.lit(0).alias("stream_lag"), F.lit(seconds * 1000).alias("p95_latency_ms"), F.lit(rows / seconds).alias("throughput_eps"))
            store.write_metrics(figures, f"{path}/metrics", number)
        finally:
            if fresh is not None:
                fresh.unpersist()
            found.unpersist()

    features = windows.windowed(stored, cfg, delay_s)
    return _started(features.writeStream.option("checkpointLocation", f"{path}/checkpoint-detect").outputMode("append").foreachBatch(batch), once)


def _candidates(found: DataFrame, cfg: Config, asn: Owners) -> DataFrame:
    """Alert candidates of all detectors, from rows of ``windows.windowed``."""
    of = lambda family: windows.of_set(found, family, cfg)
    parts = [
        detectors.ddos_rules(of("ddos"), cfg), detectors.c2_rules(of("c2"), cfg, asn), detectors.recon_rules(of("recon").where(detectors.recon_gate(cfg)), cfg, asn),
        detectors.exfil_rules(of("exfil"), cfg, asn), detectors.dns_rules(of("dns"), cfg), detectors.encrypted_rules(of("tls"), cfg, asn),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_stream(events: DataFrame, path: str, cfg: Config = Config(), asn: DataFrame | Owners | None = None, once: bool = True, delay_s: int = DELAY_SECONDS) -> StreamingQuery:
    """Both queries: once, one after the other; else side by side, and the one that detects is returned."""
    spark = events.sparkSession
    ingest = ingest_stream(events, path, once, delay_s)
    if once:
        ingest.awaitTermination()
    return detect_stream(spark, path, cfg, asn, once, delay_s)


def late_rows(events: DataFrame, delay_us: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows more than the delay behind the newest row before them, by arrival."""
    from pyspark.sql import Window

    before = F.max("ts_us").over(Window.partitionBy("src_ip").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("_late", F.coalesce(F.col("ts_us") < before - delay_us, F.lit(False)))
    return marked.where("not _late").drop("_late"), marked.where("_late").drop("_late")


def live_feed(stored: DataFrame, newest: int = 100) -> tuple[DataFrame, DataFrame]:
    """What a dashboard shows: the newest alerts and the summary."""
    return store.list_alerts(stored, limit=newest), store.summary(stored)


def follow_feed(spark: SparkSession, path: str, out: str, newest: int = 100, once: bool = True) -> StreamingQuery:
    """Follows the alert table at ``path`` and writes ``live_feed`` at ``out`` when there is a newer alert than it shows."""

    def batch(frame: DataFrame, number: int) -> None:
        session = frame.sparkSession
        stored = store.read(session, f"{path}/alerts")
        head = None if stored is None else stored.agg(F.max_by("alert_id", "seq")).first()[0]
        shown = _read(session, f"{out}/shown/{number - 1}")
        known = shown.first()["alert_id"] if shown is not None else None
        _keep(session.createDataFrame([(head,)], "alert_id string"), out, "shown", number)
        if head is None or head == known:
            return
        for name, rows in zip(("alerts", "summary"), live_feed(stored, newest), strict=True):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    changes = spark.readStream.schema(store.SCHEMA).option("recursiveFileLookup", True).parquet(_folder(spark, f"{path}/alerts"))
    return _started(changes.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(batch), once)
