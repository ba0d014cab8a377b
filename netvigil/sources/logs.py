"""Readers of telemetry logs and flow tables, and writers of events and alerts."""

from __future__ import annotations

from collections.abc import Iterator

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions import fixed
from netvigil.functions import scalars as S

_EVENT = (
    "seq long, ts_us long, kind string, src_ip string, src_port int, dst_ip string, dst_port int, proto string, uid string, "
    "orig_bytes long, resp_bytes long, conn_state string, tcp_flags string, duration double, query string, qtype string, rcode string, answers_count int, "
    "tls boolean, resumed boolean, established boolean, tls_version string, sni string, ja3 string, ja4 string, cipher string, "
    "certificate_subject string, certificate_issuer string, certificate_validity string, suspicious_fingerprint boolean"
)
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
#: Headers that the driver asks for at the same time.
HEADERS = 16
#: The normalized event.
EVENT = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in _EVENT.split(", "))])
#: A log line as sensors write it; ids come flat, dotted or nested.
RAW = (
    "ts double, kind string, uid string, src_ip string, src_port string, dst_ip string, dst_port string, `id.orig_h` string, `id.orig_p` string, `id.resp_h` string, `id.resp_p` string, "
    "id struct<orig_h:string,orig_p:string,resp_h:string,resp_p:string>, proto string, orig_bytes long, resp_bytes long, orig_ip_bytes long, resp_ip_bytes long, conn_state string, history string, duration double, "
    "query string, qtype_name string, qtype string, rcode_name string, rcode string, answers array<string>, answers_count int, tls boolean, version string, tls_version string, server_name string, sni string, ja3 string, ja4 string, cipher string, "
    "resumed boolean, established boolean, subject string, issuer string, `certificate.version` string, tcp_flags string, suspicious_fingerprint boolean, _corrupt_record string"
)


def _text(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns], F.lit(""))


def _port(*columns: str) -> Column:
    return F.coalesce(F.split(F.coalesce(*[F.col(c) for c in columns]), "/")[0].try_cast("int"), F.lit(0))


def normalize(raw: DataFrame, log: Column, order: Column, **more: Column) -> DataFrame:
    """Log lines as events; ``log`` names the log of a line that has no kind, ``order`` its place, ``more`` further columns."""
    kind = F.coalesce("kind", F.when(log == "dns", "dns").when(log.isin("ssl", "tls"), "tls").when(log == "x509", "tls_certificate").when(log == "early", "early_event").otherwise("conn"))
    given, tls, conn = F.col("kind").isNotNull(), kind == "tls", kind == "conn"
    values = {
        "seq": order, "ts_us": S.rounded(F.coalesce("ts", F.lit(0.0)) * 1_000_000).cast("long"), "kind": kind,
        "src_ip": _text("src_ip", "`id.orig_h`", "id.orig_h"), "src_port": _port("src_port", "`id.orig_p`", "id.orig_p"),
        "dst_ip": _text("dst_ip", "`id.resp_h`", "id.resp_h"), "dst_port": _port("dst_port", "`id.resp_p`", "id.resp_p"),
        "proto": _text("proto"), "uid": _text("uid"),
        "orig_bytes": F.coalesce("orig_bytes", F.when(conn, F.col("orig_ip_bytes")), F.lit(0)), "resp_bytes": F.coalesce("resp_bytes", F.when(conn, F.col("resp_ip_bytes")), F.lit(0)),
        "conn_state": _text("conn_state"), "tcp_flags": F.when(given, _text("tcp_flags")).when(conn, F.substring(_text("history"), 1, 1)).otherwise(F.lit("")),
        "duration": F.coalesce("duration", F.lit(0.0)), "query": _text("query"), "qtype": _text("qtype_name", "qtype"), "rcode": _text("rcode_name", "rcode"),
        "answers_count": F.coalesce("answers_count", F.size(F.coalesce("answers", F.array().cast("array<string>")))),
        "tls": F.coalesce("tls", kind.isin("tls", "tls_certificate")), "resumed": F.coalesce("resumed", F.lit(False)), "established": F.coalesce("established", F.lit(False)),
        "tls_version": F.coalesce("tls_version", "version", F.when(tls, "unknown"), F.lit("")), "sni": _text("sni", "server_name"), "ja3": _text("ja3"), "ja4": _text("ja4"), "cipher": _text("cipher"),
        "certificate_subject": _text("subject"), "certificate_issuer": _text("issuer"), "certificate_validity": _text("`certificate.version`"),
        "suspicious_fingerprint": F.coalesce("suspicious_fingerprint", F.lit(False)),
    }
    return raw.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in EVENT.fields], *[c.alias(n) for n, c in more.items()])


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of one or more logs; a file's name tells its log, a line's place its order."""
    raw = spark.read.schema(RAW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return normalize(raw.where("_corrupt_record is null").withColumn("_stem", _stem(F.input_file_name())), F.col("_stem"), F.monotonically_increasing_id())


def follow_event_logs(spark: SparkSession, path: str, per_batch: int = 100, archive: str | None = None) -> DataFrame:
    """The same as a stream over files that appear in a folder; read ones may be moved to an archive.

    A row's ``position`` is its place in the source: when its file was written, the file
    and the block of it, and a number that grows along the block. ``numbered`` makes seq
    of it, so no two lines are one event, whatever they say. Lines that can't be read
    come with their text in ``corrupt`` and belong in quarantine.
    """
    reader = spark.readStream.schema(RAW).option("maxFilesPerTrigger", per_batch).option("columnNameOfCorruptRecord", "_corrupt_record")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    file = {"_arrived": F.unix_micros("_metadata.file_modification_time"), "_source": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    raw = _counted(reader.json(path).withColumns(file))
    position = _position(F.col("_arrived"), F.col("_source"), F.col("_block"), F.col("_place"))
    return normalize(raw, _stem(F.col("_source")), F.lit(None), position=position, corrupt=F.col("_corrupt_record"))


def _counted(rows: DataFrame) -> DataFrame:
    """rows with _place, which counts those of a task as they come; a block's rows come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(place, place + batch.num_rows), pa.int64())], [*batch.schema.names, "_place"])
            place += batch.num_rows

    names = [*rows.columns, "_place"]  # some have dots, by which mapInArrow can't find them
    fields = [*[f.dataType for f in rows.schema.fields], T.LongType()]
    plain = [f"_{n}" for n in range(len(names) - 1)] + ["_place"]
    return rows.toDF(*plain[:-1]).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(plain, fields, strict=True)])).toDF(*names)


def _position(arrived: Column, source: Column, block: Column, place: Column) -> Column:
    return F.struct(arrived.cast("long").alias("arrived"), source.cast("string").alias("source"), block.cast("long").alias("block"), place.cast("long").alias("place"))


def numbered(batch: DataFrame, number: int) -> DataFrame:
    """A batch with seq: the batch's number first, then sources by time and name, then the place in each.

    A batch that runs again has the same positions, so the same numbers. Only one row for
    each file block or topic partition of the batch is ordered as a whole.
    """
    key = [F.col(f"position.{k}").alias(f"_{k}") for k in ("source", "block")]
    places = batch.groupBy(*key).agg(F.min("position.arrived").alias("_arrived"), F.min("position.place").alias("_first"), (F.max("position.place") + 1 - F.min("position.place")).alias("_size"))
    order = Window.orderBy("_arrived", "_source", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = places.select("_source", "_block", "_first", F.coalesce(F.sum("_size").over(order), F.lit(0)).alias("_start"))
    rows = batch.withColumns({"_source": F.col("position.source"), "_block": F.col("position.block")}).join(starts, ["_source", "_block"])
    seq = F.lit(number << 40) + F.col("_start") + F.col("position.place") - F.col("_first")
    return rows.withColumn("seq", seq).select(*batch.columns)


def alias_map(columns: list[str]) -> dict[str, str]:
    """Our field names and the columns that carry them."""
    normal = {c.replace("﻿", "").strip().lower(): c for c in columns}
    return {field: next(normal[a] for a in options if a in normal) for field, options in fixed.CSV_ALIASES.items() if any(a in normal for a in options)}


def has_endpoints(columns: list[str]) -> bool:
    return {"src_ip", "dst_ip"} <= set(alias_map(columns))


def read_flow_table(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A headed text table with our field names where a column is known, all text, and seq."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    known = alias_map(raw.columns)
    rows = raw.select(*[F.col(f"`{c}`").cast("string").alias(f) for f, c in known.items()]) if known else raw
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return rows.withColumn("_micro", F.lit(known.get("duration", "").strip().lower() == "flow duration"))


def read_flow_tables(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame | None, DataFrame | None]:
    """(connection events, flow rows without endpoints) of headed text files, each read by its own header; None where no file is of that kind.

    Files with the same header are one scan; only first lines are read for the plan.
    """
    files = sorted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles())
    with ThreadPoolExecutor(HEADERS) as pool:
        headers = list(pool.map(lambda f: tuple(spark.read.option("header", True).option("sep", sep).csv(f).columns), files))
    events = flows = None
    for n, header in enumerate(sorted(set(headers))):
        rows = read_flow_table(spark, [f for f, h in zip(files, headers, strict=True) if h == header], sep)
        far = F.col("seq") + (n << 54)  # numbers of one header's files stay below that
        if has_endpoints(list(header)):
            own = flow_events(rows).withColumn("seq", far)
            events = own if events is None else events.unionByName(own)
        else:
            rows = rows.withColumn("seq", far)
            flows = rows if flows is None else flows.unionByName(rows, allowMissingColumns=True)
    return events, flows


def flow_events(rows: DataFrame, base_us: int = 0, max_rows: int | None = None) -> DataFrame:
    """Connection events of a flow table with endpoints."""
    missing = [c for c in ("src_ip", "dst_ip") if c not in rows.columns]
    if missing:
        raise ValueError(f"no endpoint columns ({', '.join(missing)}); use the aggregate assessment")
    if max_rows is not None:
        rows = rows.orderBy("seq").limit(max_rows)
    get = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    state = S.conn_state_from_flags(*[S.num(get(c)) for c in ("syn", "ack", "fin", "rst")])
    seconds = S.num(get("duration"))
    values = {
        "seq": F.col("seq"), "ts_us": S.parse_ts_us(get("ts"), F.lit(base_us) + F.col("seq") * 1000), "kind": F.lit("conn"),
        "src_ip": F.trim(get("src_ip")), "src_port": S.num(get("src_port")), "dst_ip": F.trim(get("dst_ip")), "dst_port": S.num(get("dst_port")),
        "proto": S.proto_name(F.coalesce(get("proto"), F.lit(""))), "orig_bytes": S.num(get("orig_bytes")), "resp_bytes": S.num(get("resp_bytes")),
        "conn_state": state, "tcp_flags": F.substring(state, 1, 1), "duration": F.when(F.col("_micro") & (seconds >= 1000), seconds / 1e6).otherwise(seconds),
    }
    return rows.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from comma or tab separated text, by which of them the beginning has more of; header in lower case."""
    head = "".join(r[0] + "\n" for r in spark.read.text(path).limit(20).collect())[:4096]
    sep = "\t" if head.count("\t") > head.count(",") else ","
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip().lower()) for c in raw.columns]).withColumn("pos", F.monotonically_increasing_id())


def publish(events: DataFrame) -> DataFrame:
    """Events as compact JSON values, for a message bus or a file sink."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def consume(messages: DataFrame) -> DataFrame:
    """Events from published values; with topic, partition, offset and timestamp, as a bus gives them, also position and corrupt."""
    text = F.col("value").cast("string")
    if not {"topic", "partition", "offset", "timestamp"} <= set(messages.columns):
        return messages.select(F.from_json(text, EVENT).alias("e")).select("e.*")
    position = _position(F.unix_micros("timestamp"), F.concat_ws("-", "topic", "partition"), F.lit(0), F.col("offset"))
    read = messages.select(F.from_json(text, EVENT).alias("e"), position.alias("position"), text.alias("_text"))
    usable = F.col("e.ts_us").isNotNull() & F.col("e.kind").isNotNull()
    return read.select("e.*", "position", F.when(~F.coalesce(usable, F.lit(False)), F.coalesce("_text", F.lit(""))).alias("corrupt"))


def write_alert_lines(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def union_sorted(connections: DataFrame, names: DataFrame) -> DataFrame:
    return connections.unionByName(names, allowMissingColumns=True).orderBy("ts_us", "seq")
