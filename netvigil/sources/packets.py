"""Flows and DNS events from a packet-header table.

Packets: ts_us, seq, src, sport, dst, dport, ip_proto, tcp_flags (FIN 1, SYN 2, RST 4,
ACK 16), payload_len, dns_qr, dns_qdcount, dns_qname.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions import scalars as S


def _keyed(packets: DataFrame) -> DataFrame:
    """TCP and UDP packets with the two ends in one order, and flags as booleans."""
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    bit = lambda n: F.col("tcp_flags").bitwiseAND(n) != 0
    tcp = F.col("ip_proto") == 6
    return packets.where(F.col("ip_proto").isin(6, 17)).select(
        "ts_us", "seq", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.when(tcp, "tcp").otherwise("udp").alias("proto"), a.alias("sender"),
        F.coalesce("payload_len", F.lit(0)).cast("long").alias("bytes"),
        (tcp & bit(2) & ~bit(16)).alias("syn"), (tcp & bit(2) & bit(16)).alias("synack"), (tcp & bit(1)).alias("fin"), (tcp & bit(4)).alias("rst"),
    )


def _aggregated(groups) -> DataFrame:
    """Sums of both directions; the originator is the sender of the first packet."""
    low = F.col("sender") == F.col("low")
    rows = groups.agg(
        F.min_by("sender", F.struct("ts_us", "seq")).alias("originator"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.min("seq").alias("seq"),
        F.sum(F.when(low, F.col("bytes")).otherwise(0)).alias("low_bytes"), F.sum(F.when(~low, F.col("bytes")).otherwise(0)).alias("high_bytes"),
        F.sum(F.when(low, 1).otherwise(0)).alias("low_n"), F.sum(F.when(~low, 1).otherwise(0)).alias("high_n"),
        *[F.bool_or(c).alias(c) for c in ("syn", "synack", "fin", "rst")],
    )
    by_low = F.col("originator") == F.col("low")
    pick = lambda a, b: F.when(by_low, F.col(a)).otherwise(F.col(b))
    sent, got = pick("low_bytes", "high_bytes"), pick("high_bytes", "low_bytes")
    state = S.conn_state_from_flow(F.col("proto"), F.col("synack"), pick("high_n", "low_n"), F.col("fin"), F.col("rst"), sent, got)
    other = pick("high", "low")
    return rows.select(
        "seq", F.col("first").alias("ts_us"), F.lit("conn").alias("kind"), F.col("originator.ip").alias("src_ip"), F.col("originator.port").alias("src_port"),
        other["ip"].alias("dst_ip"), other["port"].alias("dst_port"), "proto", sent.alias("orig_bytes"), got.alias("resp_bytes"), state.alias("conn_state"),
        S.rounded((F.col("last") - F.col("first")) / 1e6, 6).alias("duration"), F.when((F.col("proto") == "tcp") & F.col("syn"), "S").otherwise("").alias("tcp_flags"),
    )


def assemble_flows(packets: DataFrame) -> DataFrame:
    """Two-way flows of a whole capture."""
    return _aggregated(_keyed(packets).groupBy("low", "high", "proto"))


def assemble_flows_stream(packets: DataFrame, idle: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Two-way flows of a stream (with a timestamp column ts); a flow ends when it is idle."""
    keyed = _keyed(packets).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return _aggregated(keyed.groupBy("low", "high", "proto", F.session_window("ts", idle)))


def dns_queries(packets: DataFrame) -> DataFrame:
    """DNS events: questions over UDP port 53."""
    asked = (F.col("ip_proto") == 17) & ((F.col("sport") == 53) | (F.col("dport") == 53)) & (F.col("dns_qr") == 0) & (F.col("dns_qdcount") > 0)
    return packets.where(asked).select("seq", "ts_us", F.lit("dns").alias("kind"), F.col("src").alias("src_ip"), F.col("sport").alias("src_port"), F.col("dst").alias("dst_ip"), F.col("dport").alias("dst_port"), F.lit("udp").alias("proto"), F.regexp_replace("dns_qname", r"\.+$", "").alias("query"))
