"""Registered queries over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import fixed
from netvigil.functions import scalars as S
from netvigil.functions.scratch import scratch_path
from netvigil.operators import alerts, detectors, evaluate, features, learning, reputation, store
from netvigil.plans.adapter import BEACONS_SQL, NAMES_SQL, TELEMETRY_SQL, beacons, names, telemetry
from netvigil.sources import logs, packets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch = scratch_path


# Windows: a frame over one integer that has the time first and the arrival second.
_N = 4096


def _frame(view: str, keys: str, seconds: int) -> str:
    return f"""WITH tele AS ({view}), placed AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, ts_us ORDER BY seq) - 1 AS r FROM tele
), keyed AS (SELECT *, ts_us * {2 * _N} + r AS okey FROM placed)
"""


def _over(keys: str, seconds: int) -> str:
    return f"(PARTITION BY {keys} ORDER BY okey RANGE BETWEEN {2 * _N * seconds * 1_000_000 + _N - 1} PRECEDING AND CURRENT ROW)"


_DDOS = _frame(TELEMETRY_SQL, "dst_ip", 5) + f""", feat AS (SELECT keyed.*,
  count(*) OVER w AS n, sum(CASE WHEN tcp_flags = 'S' THEN 1 ELSE 0 END) OVER w AS syn_count, sum(CASE WHEN proto = 'udp' THEN 1 ELSE 0 END) OVER w AS udp_count,
  sum(CASE WHEN conn_state = 'SF' THEN 1 ELSE 0 END) OVER w AS completed, sum(orig_bytes) OVER w AS inbound_bytes, sum(resp_bytes) OVER w AS outbound_bytes,
  count(DISTINCT src_ip) OVER w AS unique_sources, round_even(greatest(0, entropy(src_ip) OVER w), 3) AS source_ip_entropy
  FROM keyed WINDOW w AS {_over("dst_ip", 5)})"""


@query("c1_ddos_features", _DDOS + """ SELECT seq, dst_ip, n / 5.0 AS packet_rate, CAST(syn_count AS BIGINT) AS syn_count, CAST(udp_count AS BIGINT) AS udp_count, unique_sources, source_ip_entropy,
  round_even(completed / greatest(1, n), 3) AS completion_ratio, CAST(inbound_bytes AS BIGINT) AS inbound_bytes, CAST(outbound_bytes AS BIGINT) AS outbound_bytes FROM feat""")
def c1(spark, d):
    return features.ddos_features(telemetry(spark, d)).select("seq", "dst_ip", "packet_rate", "syn_count", "udp_count", "unique_sources", "source_ip_entropy", "completion_ratio", "inbound_bytes", "outbound_bytes")


def _c2_sql(view: str) -> str:
    return _frame(view, "src_ip, dst_ip", 300) + f""", gaps AS (SELECT *, okey - 0 AS o, CAST(ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY okey) AS HUGEINT) AS gap FROM keyed
), sums AS (SELECT *, count(*) OVER w AS n, count(DISTINCT dst_port) OVER w AS destination_port_count, sum(orig_bytes) OVER w AS outbound_bytes, sum(resp_bytes) OVER w AS inbound_bytes,
  ts_us - first_value(ts_us) OVER w AS g, sum(gap * gap) OVER w - coalesce(first_value(gap) OVER w * first_value(gap) OVER w, 0) AS g2
  FROM gaps WINDOW w AS {_over("src_ip, dst_ip", 300)}), feat AS (
SELECT *, n AS session_count, CASE WHEN n > 1 THEN round_even(g / (n - 1) / 1e6, 3) ELSE 0 END AS iat_mean,
  CASE WHEN n > 2 AND g > 0 THEN round_even(sqrt(CAST((n - 1) * coalesce(g2, 0) - CAST(g AS HUGEINT) * g AS DOUBLE)) / g, 3) ELSE 1.0 END AS iat_cv,
  round_even(g / 1e6, 3) AS persistence_seconds, round_even(outbound_bytes / greatest(1, inbound_bytes), 2) AS outbound_inbound_ratio,
  round_even(outbound_bytes / n, 1) AS mean_outbound_bytes, round_even(inbound_bytes / n, 1) AS mean_inbound_bytes FROM sums)"""


@query("c2_pair_features", _c2_sql(TELEMETRY_SQL) + " SELECT seq, session_count, iat_mean, iat_cv, persistence_seconds, destination_port_count, CAST(outbound_bytes AS BIGINT) AS outbound_bytes, CAST(inbound_bytes AS BIGINT) AS inbound_bytes, outbound_inbound_ratio, mean_outbound_bytes, mean_inbound_bytes FROM feat")
def c2(spark, d):
    return features.c2_features(telemetry(spark, d)).select("seq", "session_count", "iat_mean", "iat_cv", "persistence_seconds", "destination_port_count", "outbound_bytes", "inbound_bytes", "outbound_inbound_ratio", "mean_outbound_bytes", "mean_inbound_bytes")


_PARENT = "CASE WHEN strpos(query, '.') > 0 THEN substr(query, strpos(query, '.') + 1) ELSE query END"
_DNS = _frame(f"SELECT *, {_PARENT} AS parent, split_part(query, '.', 1) AS label FROM ({NAMES_SQL})", "src_ip, parent", 60) + f""", feat AS (SELECT *, length(label) AS label_length,
  round_even(coalesce((SELECT entropy(c) FROM (SELECT unnest(string_split(label, '')) AS c)), 0), 3) AS label_entropy, count(*) OVER w / 60.0 AS query_rate, count(DISTINCT query) OVER w AS unique_subdomains
  FROM keyed WINDOW w AS {_over("src_ip, parent", 60)})"""


@query("c3_dns_features", _DNS + " SELECT seq, query, label_length, label_entropy, query_rate, unique_subdomains FROM feat")
def c3(spark, d):
    return features.dns_features(names(spark, d)).select("seq", "query", "label_length", "label_entropy", "query_rate", "unique_subdomains")


_TLS = _frame(f"SELECT * FROM ({TELEMETRY_SQL}) WHERE tls", "src_ip", 30) + f""", feat AS (SELECT *, round_even(orig_bytes / greatest(1, resp_bytes), 2) AS outbound_inbound_ratio, count(*) OVER w AS host_sessions
  FROM keyed WINDOW w AS {_over("src_ip", 30)})"""


@query("c4_tls_features", _TLS + " SELECT seq, outbound_inbound_ratio, host_sessions FROM feat")
def c4(spark, d):
    return features.tls_features(telemetry(spark, d)).select("seq", "outbound_inbound_ratio", "host_sessions")


_RECON = _frame(TELEMETRY_SQL, "src_ip", 30) + f""", feat AS (SELECT *, count(DISTINCT dst_ip) OVER w AS unique_dst_hosts, count(DISTINCT dst_port) OVER w AS unique_dst_ports, count(*) OVER w / 30.0 AS scan_rate,
  round_even(sum(CASE WHEN conn_state IN ('S0', 'REJ') THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 2) AS failure_ratio FROM keyed WINDOW w AS {_over("src_ip", 30)})"""


@query("c5_recon_features", _RECON + " SELECT seq, unique_dst_hosts, unique_dst_ports, scan_rate, failure_ratio FROM feat")
def c5(spark, d):
    return features.recon_features(telemetry(spark, d)).select("seq", "unique_dst_hosts", "unique_dst_ports", "scan_rate", "failure_ratio")


@query("c5_recon_targets", _RECON + """, gated AS (SELECT seq, src_ip, ts_us FROM feat WHERE unique_dst_ports >= 12 AND failure_ratio >= 0.5), hosts AS (
  SELECT g.seq, t.dst_ip, sum(CASE WHEN conn_state IN ('S0', 'REJ') THEN 1 ELSE 0 END) AS failed, count(*) AS n FROM gated g JOIN tele t ON t.src_ip = g.src_ip AND t.ts_us >= g.ts_us - 30000000 AND (t.ts_us < g.ts_us OR (t.ts_us = g.ts_us AND t.seq <= g.seq)) GROUP BY ALL)
  SELECT seq, string_agg(dst_ip, ',' ORDER BY dst_ip) AS dst_hosts, first(dst_ip ORDER BY failed / n DESC, failed DESC, dst_ip) AS anchor_dst FROM hosts GROUP BY seq""")
def c5_targets(spark, d):
    events = telemetry(spark, d)
    gated = features.recon_features(events).where("unique_dst_ports >= 12 AND failure_ratio >= 0.5")
    return features.recon_targets(gated, events).select("seq", F.array_join("dst_hosts", ",").alias("dst_hosts"), "anchor_dst")


_EXFIL = _frame(TELEMETRY_SQL, "src_ip, dst_ip", 300) + f""", feat AS (SELECT *, sum(orig_bytes) OVER w AS outbound_bytes, sum(resp_bytes) OVER w AS inbound_bytes, count(*) OVER w AS session_count,
  round_even(sum(orig_bytes) OVER w / greatest(1, sum(resp_bytes) OVER w), 2) AS outbound_inbound_ratio FROM keyed WINDOW w AS {_over("src_ip, dst_ip", 300)})"""


@query("c6_exfil_features", _EXFIL + " SELECT seq, CAST(outbound_bytes AS BIGINT) AS outbound_bytes, CAST(inbound_bytes AS BIGINT) AS inbound_bytes, session_count, outbound_inbound_ratio FROM feat")
def c6(spark, d):
    return features.exfil_features(telemetry(spark, d)).select("seq", "outbound_bytes", "inbound_bytes", "session_count", "outbound_inbound_ratio")


# Detectors.
_SEV = "CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END"
_DDOS_FOUND = _DDOS + """, cand AS (SELECT seq, ts_us, src_ip, dst_ip, CASE WHEN udp_count >= 20 AND unique_sources >= 8 THEN 'udp_reflection_amplification'
  WHEN syn_count >= 20 AND round_even(completed / n, 3) <= 0.5 THEN CASE WHEN source_ip_entropy >= 3.5 THEN 'spoof_like_source_flood' ELSE 'syn_flood' END END AS subtype,
  round_even(least(1.0, (syn_count + udp_count) / 40), 3) AS confidence, 'dst=' || dst_ip AS aggregation_key FROM feat)"""
_RECON_FOUND = _RECON + """, cand AS (SELECT seq, ts_us, src_ip, 'vertical_scan' AS subtype, round_even(least(0.97, 0.70 + 0.22 * greatest(0.0, least(1.0, (unique_dst_ports - 12) / 28.0)) + 0.08 * greatest(0.0, least(1.0, (failure_ratio - 0.5) * 2))), 3) AS confidence,
  'src=' || src_ip AS aggregation_key FROM feat WHERE unique_dst_ports >= 12 AND failure_ratio >= 0.5)"""
_EXFIL_FOUND = _EXFIL + """, cand AS (SELECT seq, ts_us, src_ip, dst_ip, 'sustained_outbound_anomaly' AS subtype, round_even(least(0.97, 0.6 + 0.37 * greatest(
  greatest(0.0, least(1.0, (outbound_bytes - 500000) / 4500000.0)), greatest(0.0, least(1.0, (outbound_inbound_ratio - 5) / 45.0)), greatest(0.0, least(1.0, (session_count - 3) / 27.0)))), 3) AS confidence,
  src_ip || '|' || dst_ip AS aggregation_key FROM feat WHERE outbound_bytes >= 500000 AND outbound_inbound_ratio >= 5 AND session_count >= 3)"""
_SHOWN = f" SELECT seq, subtype, confidence, {_SEV} AS severity, aggregation_key FROM cand WHERE subtype IS NOT NULL"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("seq", "subtype", "confidence", "severity", "aggregation_key")


@query("d1_ddos", _DDOS_FOUND + _SHOWN)
def d1(spark, d):
    return _shown(detectors.detect_ddos(telemetry(spark, d)))


def _ports(ports: list[int]) -> str:
    return "(" + ", ".join(map(str, sorted(set(ports)))) + ")"


@query("d4_c2", _c2_sql(BEACONS_SQL) + f""", gated AS (SELECT *, dst_ip LIKE '10.%' AS local FROM feat WHERE session_count >= 5 AND iat_cv <= 0.12 AND persistence_seconds >= 120 AND destination_port_count <= 2 AND mean_outbound_bytes <= 1500 AND (inbound_bytes = 0 OR mean_inbound_bytes <= 1500)
  AND (dst_ip LIKE '203.0.113.%' OR (dst_ip NOT LIKE '%.255' AND src_ip NOT LIKE '%.255' AND dst_port NOT IN {_ports(fixed.NOISE_PORTS)}))
), cand AS (SELECT seq, CASE WHEN local AND dst_port NOT IN {_ports([*fixed.INTERNAL_SERVICE_PORTS, *fixed.LONG_IDLE_PORTS])} THEN 'lateral_beacon'
  WHEN NOT local AND dst_port IN {_ports(fixed.LONG_IDLE_PORTS)} THEN 'periodic_session' WHEN NOT local AND dst_port <= 1024 THEN 'periodic_beacon' END AS subtype, src_ip || '|' || dst_ip AS aggregation_key FROM gated
), scored AS (SELECT *, CASE subtype WHEN 'lateral_beacon' THEN 0.85 WHEN 'periodic_session' THEN 0.45 ELSE 0.8 END AS confidence FROM cand WHERE subtype IS NOT NULL)
  SELECT seq, subtype, CAST(confidence AS DOUBLE) AS confidence, {_SEV} AS severity, aggregation_key FROM scored""")
def d4(spark, d):
    return _shown(detectors.detect_c2(beacons(spark, d)))


@query("d5_dns", _DNS + f""", cand AS (SELECT seq, CASE WHEN query_rate >= 0.05 AND unique_subdomains >= 3 THEN 'dns_tunnel' ELSE 'dga_domain' END AS subtype, round_even(least(0.95, label_entropy / 5), 3) AS confidence, src_ip || '|' || dst_ip AS aggregation_key
  FROM feat WHERE label_length >= 18 AND label_entropy >= 3.3){_SHOWN}""")
def d5(spark, d):
    return _shown(detectors.detect_dns(names(spark, d)))


@query("d6_encrypted", _TLS + f""", cand AS (SELECT seq, CASE WHEN suspicious_fingerprint THEN 'metadata_anomaly' WHEN ja3 = '' AND outbound_inbound_ratio >= 8 AND host_sessions <= 2 THEN 'upload_channel_anomaly' END AS subtype,
  CASE WHEN suspicious_fingerprint THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, src_ip || '|' || dst_ip AS aggregation_key FROM feat){_SHOWN}""")
def d6(spark, d):
    return _shown(detectors.detect_encrypted(telemetry(spark, d)))


@query("d7_recon", _RECON_FOUND + _SHOWN)
def d7(spark, d):
    return _shown(detectors.detect_recon(telemetry(spark, d)))


@query("d9_exfil", _EXFIL_FOUND + _SHOWN)
def d9(spark, d):
    return _shown(detectors.detect_exfil(telemetry(spark, d)))


def _dedup_sql(found: str, window_us: int) -> str:
    """Greedy refractory filter: from each emitted row to the first one at least a window later."""
    return found.replace("WITH tele", "WITH RECURSIVE tele", 1) + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY subtype, aggregation_key ORDER BY ts_us, seq) AS i FROM cand WHERE subtype IS NOT NULL), emitted AS (
  SELECT subtype, aggregation_key, ts_us, seq, i, confidence FROM numbered WHERE i = 1
  UNION ALL SELECT x.subtype, x.aggregation_key, x.ts_us, x.seq, x.i, x.confidence FROM (
    SELECT n.*, row_number() OVER (PARTITION BY n.subtype, n.aggregation_key ORDER BY n.i) AS first FROM emitted e JOIN numbered n ON n.subtype = e.subtype AND n.aggregation_key = e.aggregation_key AND n.i > e.i AND n.ts_us - e.ts_us >= {window_us}) x WHERE first = 1)
  SELECT subtype, aggregation_key, seq FROM emitted"""


@query("e1_alert_dedup", _dedup_sql(_DDOS_FOUND, 30_000_000))
def e1(spark, d):
    return alerts.refractory(detectors.detect_ddos(telemetry(spark, d))).select("subtype", "aggregation_key", "seq")


def _all_alerts(spark: SparkSession, d: str) -> DataFrame:
    tele = telemetry(spark, d)
    rows = tele.unionByName(names(spark, d).withColumn("ts_us", F.col("ts_us") + 47_000_000_000), allowMissingColumns=True)
    return alerts.detect_all(rows)


@query("e2_correlate")
def e2(spark, d):
    found = _all_alerts(spark, d).where("subtype = 'correlated_multi_signal'")
    return found.select(F.col("flow_id.src_ip").alias("src_ip"), "seq", "confidence", F.array_join("classes", ",").alias("classes"))


@query("e4_pipeline")
def e4(spark, d):
    return _all_alerts(spark, d).select("alert_id", "threat_class", "subtype", "confidence", "severity", "aggregation_key", "seq")


@query("b15_validate", None)
def b15(spark, d):
    found = alerts.validate(alerts.with_ids(detectors.detect_exfil(telemetry(spark, d))))
    return found.groupBy("threat_class", F.coalesce("rejected", F.lit("valid")).alias("state")).agg(F.count("*").alias("n"))


# The store, over customers as alerts: many rows, given order.
def _rows_to_store(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ts_us"), F.concat(F.lit("a"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("alert_id"), F.lit("2024").alias("timestamp"),
        F.element_at(F.array(*map(F.lit, fixed.THREATS)), (F.col("o_custkey") % 6 + 1).cast("int")).alias("threat_class"),
        S.rounded(F.col("o_custkey") % 100 / 100.0, 2).alias("confidence"), F.concat(F.lit("10.1.1."), (F.col("o_custkey") % 50).cast("string")).alias("src_ip"), F.lit("10.2.2.2").alias("dst_ip"),
        F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("record_json"))
    return rows.withColumn("severity", S.severity_of(F.col("confidence")))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "chain")
    store.chain(_rows_to_store(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return store.numbered(_rows_to_store(spark, d), _scratch(spark, "numbered"))


_STORED = f"""WITH RECURSIVE rows AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, 'a' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS alert_id,
  list_extract([{", ".join(f"'{t}'" for t in fixed.THREATS)}], CAST(o_custkey % 6 + 1 AS INT)) AS threat_class, round_even(o_custkey % 100 / 100.0, 2) AS confidence, '10.1.1.' || CAST(o_custkey % 50 AS VARCHAR) AS src_ip, '{{"key":' || CAST(o_orderkey AS VARCHAR) || '}}' AS record_json FROM orders
), stored AS (SELECT *, {_SEV} AS severity FROM rows)"""


@query("f1_chain", _STORED + f""", linked AS (SELECT seq, alert_id, sha256('{store.GENESIS}' || record_json) AS record_hash FROM rows WHERE seq = 1
  UNION ALL SELECT r.seq, r.alert_id, sha256(l.record_hash || r.record_json) FROM linked l JOIN rows r ON r.seq = l.seq + 1) SELECT seq, alert_id, record_hash FROM linked""")
def f1(spark, d):
    return _stored(spark, d).select("seq", "alert_id", "record_hash")


@query("f2_verify_chain", "SELECT true AS valid, count(*) AS checked FROM orders")
def f2(spark, d):
    return store.verify_chain(_stored(spark, d)).select("valid", "checked")


@query("f2_verify_tampered", "SELECT false AS valid, CAST(101 AS BIGINT) AS failed_sequence")
def f2_bad(spark, d):
    rows = _stored(spark, d).withColumn("record_json", F.when(F.col("seq") == 101, F.lit("{}")).otherwise(F.col("record_json")))
    return store.verify_chain(rows).select("valid", "failed_sequence")


@query("f3_list_alerts", _STORED + " SELECT seq, alert_id, confidence FROM stored WHERE threat_class = 'ddos' AND severity = 'high' ORDER BY seq DESC LIMIT 250")
def f3(spark, d):
    return store.list_alerts(_numbered(spark, d), "ddos", "high").select("seq", "alert_id", "confidence")


@query("f4_summary", _STORED + """ SELECT 'threat_class' AS "by", threat_class AS name, count(*) AS n FROM stored GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM stored GROUP BY ALL UNION ALL SELECT 'all', '', count(*) FROM stored""")
def f4(spark, d):
    return store.summary(_numbered(spark, d))


@query("f5_incidents", _STORED + """, newest AS (SELECT * FROM stored ORDER BY seq DESC LIMIT 1000) SELECT src_ip, CAST(least(100, sum(CAST(round_even(confidence * 18, 0) AS BIGINT))) AS BIGINT) AS risk, string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS classes, max(seq) AS newest FROM newest GROUP BY src_ip""")
def f5(spark, d):
    return store.incidents(_numbered(spark, d)).select("src_ip", "risk", F.array_join("classes", ",").alias("classes"), F.col("alerts")[0]["seq"].alias("newest"))


@query("f7_health", "SELECT count(*) AS alerts, true AS valid, count(*) AS checked FROM orders")
def f7(spark, d):
    return store.health(_stored(spark, d)).select("alerts", "valid", "checked")


@query("f8_metrics", """WITH l AS (SELECT list(l_quantity ORDER BY l_quantity) AS v FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 10000))
  SELECT (SELECT count(*) FROM lineitem) AS events_total, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50_ms, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95_ms, v[CAST(floor((len(v) - 1) * 0.99) AS BIGINT) + 1] AS p99_ms FROM l""")
def f8(spark, d):
    rows = _table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("latency_ms"), F.lit(0).alias("alerts"), F.lit(1.0).alias("ended_s"))
    return store.metrics_snapshot(rows).select("events_total", "p50_ms", "p95_ms", "p99_ms")


# Evaluation.
def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem")
    return rows.select(F.struct("l_orderkey", "l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "DDoS").when(F.col("l_returnflag") == "N", "BENIGN").otherwise(" ").alias("label"), F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("syn"), F.when(F.col("l_tax") == 0, "Infinity").otherwise((F.col("l_suppkey") * 100).cast("string")).alias("duration"), F.col("l_linenumber").cast("string").alias("flow_rate"), F.col("l_partkey").cast("string").alias("orig_bytes"), F.concat((F.col("l_suppkey") % 40).cast("string"), F.lit(".0")).alias("dst_port"))


_LAB = "(SELECT *, CASE l_returnflag WHEN 'R' THEN 'DDoS' WHEN 'N' THEN 'BENIGN' ELSE 'UNKNOWN' END AS label FROM lineitem)"


@query("g1_label_census", f"SELECT label, count(*) AS n FROM {_LAB} GROUP BY label")
def g1(spark, d):
    return evaluate.label_census(_labelled(spark, d))


@query("g4_flow_summary", f"""SELECT count(*) AS rows, round_even(avg(CASE WHEN label = 'DDoS' THEN 1.0 ELSE 0 END), 4) AS attack_share, count(*) FILTER (WHERE l_linestatus = 'O') AS syn_heavy_flows, round_even(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END), 4) AS syn_heavy_share,
  round_even(avg(CASE WHEN l_suppkey * 100 >= 1000 THEN l_suppkey * 100 / 1e6 ELSE l_suppkey * 100 END) FILTER (WHERE l_tax <> 0), 3) AS mean_duration_s, round_even(avg(l_linenumber), 1) AS mean_packets_per_s, round_even(avg(l_partkey), 1) AS mean_fwd_bytes FROM {_LAB}""")
def g4(spark, d):
    return evaluate.flow_summary(_labelled(spark, d))


@query("g5_top_ports", f"""SELECT CAST(l_suppkey % 40 AS VARCHAR) AS port, count(*) AS flows, round_even(avg(CASE WHEN label = 'DDoS' THEN 1.0 ELSE 0 END), 4) AS attack_share FROM {_LAB} GROUP BY 1 ORDER BY flows DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 10""")
def g5(spark, d):
    return evaluate.top_ports(_labelled(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "labels")
    return rows.select(F.when(F.col("toxic") == 1, "ddos").otherwise("recon_scan").alias("truth"), F.when(F.col("quality") == 1, "recon_scan").otherwise("ddos").alias("predicted"))


_PAIRS = "(SELECT CASE WHEN toxic = 1 THEN 'ddos' ELSE 'recon_scan' END AS truth, CASE WHEN quality = 1 THEN 'recon_scan' ELSE 'ddos' END AS predicted FROM labels)"


@query("g7_confusion_matrix", f"SELECT truth, count(*) FILTER (WHERE predicted = 'ddos') AS ddos, count(*) FILTER (WHERE predicted = 'recon_scan') AS recon_scan FROM {_PAIRS} GROUP BY truth")
def g7(spark, d):
    return evaluate.confusion_matrix(_pairs(spark, d), ["ddos", "recon_scan"])


@query("g8_alert_precision", f"""SELECT predicted, count(*) AS alerts, count(*) FILTER (WHERE truth = predicted) AS "right", round_even(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0 END), 3) AS precision FROM {_PAIRS} GROUP BY predicted""")
def g8(spark, d):
    return evaluate.alert_precision(_pairs(spark, d))


def _truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tele = telemetry(spark, d).select("seq", "src_ip", "ts_us")
    base = 47_333_880_000
    windows = spark.createDataFrame([(0, "ddos", base * 1 + 5_000_000, base + 20_000_000), (1, None, base, base + 90_000_000), (2, "recon_scan", base + 15_000_000, base + 40_000_000)], "window_pos long, class string, start_us long, end_us long")
    users = tele.select("src_ip").distinct()
    return tele, evaluate.truth_join(tele, windows, users.where("src_ip LIKE '%1'"), users.where("src_ip LIKE '%2'"), 3), windows


_TRUTH_SQL = f"""WITH tele AS ({TELEMETRY_SQL}), truth AS (SELECT seq, src_ip, CASE WHEN src_ip LIKE '%1' THEN
  CASE WHEN ts_us BETWEEN 47333880000 + 2000000 AND 47333880000 + 23000000 THEN 'ddos' WHEN ts_us BETWEEN 47333880000 + 12000000 AND 47333880000 + 43000000 THEN 'recon_scan' ELSE 'unknown' END ELSE 'benign' END AS truth FROM tele WHERE src_ip LIKE '%1' OR src_ip LIKE '%2')"""


@query("g11_truth_join", _TRUTH_SQL + " SELECT seq, src_ip, truth FROM truth")
def g11(spark, d):
    return _truth(spark, d)[1].select("seq", "src_ip", "truth")


def _named(spark: SparkSession, d: str) -> DataFrame:
    return telemetry(spark, d).where("src_ip IN ('10.0.0.1', '10.0.0.3')").select("src_ip", F.when(F.col("src_ip") == "10.0.0.1", "ddos").otherwise("recon_scan").alias("threat_class"))


@query("g13_class_scores", _TRUTH_SQL + """, f AS (SELECT truth AS class, count(*) FILTER (WHERE src_ip = '10.0.0.1' AND truth = 'ddos') AS tp, count(*) AS n FROM truth WHERE truth NOT IN ('benign', 'unknown') GROUP BY truth), p AS (SELECT *, tp / n AS s, 1 + 1.96 * 1.96 / n AS dd FROM f)
  SELECT class, tp, CAST(0 AS BIGINT) AS fp, n - tp AS fn, CASE WHEN tp > 0 THEN 1.0 END AS precision, round_even(tp / n, 4) AS recall, round_even(2 * tp / (tp + n), 4) AS f1,
  round_even(greatest(0, (s + 1.96 * 1.96 / (2 * n)) / dd - 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n)) / dd), 4) AS recall_low, round_even(least(1, (s + 1.96 * 1.96 / (2 * n)) / dd + 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n)) / dd), 4) AS recall_high, n >= 10 AS sufficient_sample FROM p""")
def g13(spark, d):
    return evaluate.class_scores(evaluate.fired(_truth(spark, d)[1], _named(spark, d)))


@query("g15_join_quality", _TRUTH_SQL + " SELECT (SELECT count(*) FROM tele) AS events, count(*) AS joined, (SELECT count(*) FROM tele) - count(*) AS excluded, round_even(count(*) / (SELECT count(*) FROM tele), 4) AS join_rate, true AS reportable, (SELECT count(*) FROM tele WHERE src_ip = '10.0.0.3') AS unscored_alerts FROM truth")
def g15(spark, d):
    tele, truth, _ = _truth(spark, d)
    return evaluate.join_quality(tele, truth, _named(spark, d))


@query("g16_dataset_census", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def g16(spark, d):
    return evaluate.label_census(_table(spark, d, "documents"), "lang")


@query("g19_replay_report", _EXFIL_FOUND + """ SELECT 'kind' AS what, kind AS name, count(*) AS n FROM tele GROUP BY kind
  UNION ALL SELECT 'alert', 'exfiltration/' || subtype, count(*) FROM cand GROUP BY subtype
  UNION ALL SELECT 'span_s', '', CAST(floor((max(ts_us) - min(ts_us)) / 1e6) AS BIGINT) FROM tele""")
def g19(spark, d):
    tele = telemetry(spark, d)
    return evaluate.replay_report(tele, alerts.with_ids(detectors.detect_exfil(tele)))


# Sources, over lines and packets that Spark writes from the given tables.
@query("a1_event_logs", f"SELECT ts_us, src_ip, src_port, dst_ip, dst_port, proto, orig_bytes, resp_bytes, conn_state, 'conn' AS kind, tcp_flags FROM ({TELEMETRY_SQL})")
def a1(spark, d):
    path = _scratch(spark, "logs") + "/conn.log"
    tele = telemetry(spark, d)
    tele.select((F.col("ts_us") / 1e6).alias("ts"), F.struct(F.col("src_ip").alias("orig_h"), F.concat(F.col("src_port").cast("string"), F.lit("/tcp")).alias("orig_p"), F.col("dst_ip").alias("resp_h"), F.col("dst_port").cast("string").alias("resp_p")).alias("id"), "proto", F.col("orig_bytes").alias("orig_ip_bytes"), "resp_bytes", "conn_state", F.concat("tcp_flags", F.lit("ha")).alias("history")).write.json(path)
    out = logs.read_event_logs(spark, path)
    return out.select("ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "orig_bytes", "resp_bytes", "conn_state", "kind", F.when(F.col("tcp_flags") == "h", "").otherwise(F.col("tcp_flags")).alias("tcp_flags"))


@query("a14_csv_events", f"""SELECT ts_us // 1000000 * 1000000 AS ts_us, src_ip, dst_ip, dst_port, proto, orig_bytes, CASE WHEN conn_state = 'REJ' THEN 'REJ' WHEN conn_state = 'S0' THEN 'S0' ELSE 'SF' END AS conn_state FROM ({TELEMETRY_SQL})""")
def a14(spark, d):
    path = _scratch(spark, "csv")
    tele = telemetry(spark, d)
    tele.select(F.col("src_ip").alias(" Source IP"), F.col("dst_ip").alias("Destination IP"), F.col("dst_port").alias("Destination Port"), F.when(F.col("proto") == "udp", "17").otherwise("6").alias("Protocol"), F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("orig_bytes").alias("Total Length of Fwd Packets"), F.lit("1").alias("SYN Flag Count"), F.when(F.col("conn_state") == "SF", "1").otherwise("0").alias("ACK Flag Count"), F.when(F.col("conn_state") == "REJ", "1").otherwise("0").alias("RST Flag Count")).write.option("header", True).csv(path)
    return logs.flow_events(logs.read_flow_table(spark, path)).select("ts_us", "src_ip", "dst_ip", "dst_port", "proto", "orig_bytes", "conn_state")


_PACKETS = """SELECT l_orderkey * 1000 + l_linenumber AS ts_us, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, CASE WHEN l_linenumber % 2 = 1 THEN '10.9.0.' ELSE '10.8.0.' END || CAST(l_orderkey % 200 AS {t}) AS src, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 40000 + l_orderkey % 10000 ELSE 443 END AS INT) AS sport,
  CASE WHEN l_linenumber % 2 = 1 THEN '10.8.0.' ELSE '10.9.0.' END || CAST(l_orderkey % 200 AS {t}) AS dst, CAST(CASE WHEN l_linenumber % 2 = 1 THEN 443 ELSE 40000 + l_orderkey % 10000 END AS INT) AS dport, CAST(6 AS INT) AS ip_proto,
  CAST(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 18 ELSE 16 END AS INT) AS tcp_flags, CAST(l_suppkey AS INT) AS payload_len FROM lineitem"""


@query("a16_flow_assembly", f"""WITH p AS ({_PACKETS.format(t="VARCHAR")}), k AS (SELECT *, CASE WHEN sport = 443 THEN dst ELSE src END AS client, CASE WHEN sport = 443 THEN dport ELSE sport END AS cport FROM p),
  f AS (SELECT client, cport, arg_min(src, ts_us) AS src_ip, sum(payload_len) FILTER (WHERE sport <> 443) AS up, sum(payload_len) FILTER (WHERE sport = 443) AS down, count(*) FILTER (WHERE sport = 443) AS dn, count(*) FILTER (WHERE sport <> 443) AS un, bool_or(tcp_flags = 18) AS synack, min(ts_us) AS ts_us, max(ts_us) - min(ts_us) AS dur, arg_min(sport, ts_us) AS fp FROM k GROUP BY client, cport)
  SELECT ts_us, src_ip, CAST(CASE WHEN fp = 443 THEN coalesce(down, 0) ELSE coalesce(up, 0) END AS BIGINT) AS orig_bytes, CAST(CASE WHEN fp = 443 THEN coalesce(up, 0) ELSE coalesce(down, 0) END AS BIGINT) AS resp_bytes, round_even(dur / 1e6, 6) AS duration,
  CASE WHEN NOT synack AND (CASE WHEN fp = 443 THEN un ELSE dn END) = 0 THEN 'S0' WHEN synack AND coalesce(up, 0) + coalesce(down, 0) > 0 THEN 'SF' ELSE 'OTH' END AS conn_state FROM f""")
def a16(spark, d):
    _table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return packets.assemble_flows(spark.sql(_PACKETS.format(t="STRING"))).select("ts_us", "src_ip", "orig_bytes", "resp_bytes", "duration", "conn_state")


@query("b1_ip_to_u32", f"SELECT src_ip, CAST(167772160 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS BIGINT) AS u32, true AS local, false AS test_net, count(*) AS n FROM ({TELEMETRY_SQL}) GROUP BY src_ip")
def b1(spark, d):
    ip = F.col("src_ip")
    return telemetry(spark, d).select("src_ip", S.ip_to_u32(ip).alias("u32"), S.is_local_dest(ip).alias("local"), S.is_test_net(ip).alias("test_net")).groupBy("src_ip", "u32", "local", "test_net").agg(F.count("*").alias("n"))


@query("b4_noise", f"""SELECT seq, (src_ip LIKE '%.255' OR dst_ip LIKE '%.255' OR dst_port IN {_ports(fixed.NOISE_PORTS)}) AND dst_ip NOT LIKE '203.0.113.%' AS noise FROM ({BEACONS_SQL})""")
def b4(spark, d):
    rows = beacons(spark, d)
    return rows.select("seq", S.is_noise_traffic(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")).alias("noise"))


@query("b9_asn_lookup", f"""SELECT seq, CASE WHEN CAST(split_part(dst_ip, '.', 4) AS INT) < 3 THEN 'AS13335' WHEN CAST(split_part(dst_ip, '.', 4) AS INT) < 5 THEN 'AS64500' END AS asn,
  CASE WHEN CAST(split_part(dst_ip, '.', 4) AS INT) < 3 THEN 'provider' ELSE 'unknown' END AS reputation FROM ({TELEMETRY_SQL})""")
def b9(spark, d):
    base = 198 * 2**24 + 51 * 2**16 + 100 * 256
    asn = spark.createDataFrame([(base, base + 2, "AS13335", "one"), (base + 3, base + 4, "AS64500", "two")], reputation.SCHEMA)
    return reputation.describe(telemetry(spark, d), "dst_ip", asn).select("seq", "asn", "reputation")


@query("b16_names", f"SELECT seq, query, split_part(query, '.', 1) AS label, {_PARENT} AS parent FROM ({NAMES_SQL})")
def b16(spark, d):
    q = F.col("query")
    return names(spark, d).select("seq", "query", S.first_label(q).alias("label"), S.parent_domain(q).alias("parent"))


@query("k2_string_entropy", "SELECT doc_id, round_even(CASE WHEN length(s) > 0 THEN (SELECT entropy(c) FROM (SELECT unnest(string_split(s, '')) AS c)) ELSE 0 END, 6) AS entropy FROM (SELECT doc_id, source || lang || CAST(n_chars AS VARCHAR) AS s FROM documents)")
def k2(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.rounded(S.string_entropy(F.concat("source", "lang", F.col("n_chars").cast("string"))), 6).alias("entropy"))


@query("a21_curate", """SELECT 'AS' || CAST(n_nationkey AS VARCHAR) AS asn, n_nationkey * 100 AS "start" FROM nation WHERE n_nationkey <> 0 AND n_nationkey % 3 = 0""")
def a21(spark, d):
    dump = _table(spark, d, "nation").select((F.col("n_nationkey") * 100).alias("start"), (F.col("n_nationkey") * 100 + 99).alias("end"), F.col("n_nationkey").alias("asn"))
    wanted = _table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("AS"), F.col("n_nationkey").cast("string")).alias("asn"))
    return reputation.curate(dump, wanted)[0].select("asn", "start")


@query("h2_dga_model")
def h2(spark, d):
    """A model of machine-made labels, fitted on half of the page names and scored on the other half."""
    labels = names(spark, d).select(S.first_label(F.col("query")).alias("label"), (F.col("seq") % 2 == 0).cast("int").alias("dga"), (F.xxhash64("query") % 2 == 0).alias("train"))
    model = learning.dga_train(labels.where("train").select("label", "dga"))
    test = labels.where("not train").select("label", "dga").distinct()
    return learning.dga_eval(test.join(learning.dga_score(model, test), "label"))


@query("h5_exfil_anomaly")
def h5(spark, d):
    rows = features.exfil_features(telemetry(spark, d))
    out = learning.exfil_anomaly(rows, learning.exfil_train(rows))
    return out.select("seq", "exfil_anomaly_score", "exfil_anomaly_flag")
