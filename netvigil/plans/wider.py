"""More registered queries over the given tables: scopes, routing, wide scans, contract, scores and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import fixed
from netvigil.functions import scalars as S
from netvigil.operators import alerts, detectors, evaluate, features, learning, reputation, store
from netvigil.plans import queries as base
from netvigil.plans.adapter import BEACONS_SQL, NAMES_SQL, TELEMETRY_SQL, beacons, names, telemetry
from netvigil.plans.queries import ORACLE_SQL, query
from netvigil.sources import tables

#: Addresses of many kinds, one by event.
_ADDRESSES = """
SELECT event_id AS seq, CASE event_id % 19 WHEN 0 THEN '10.1.2.' || o WHEN 1 THEN '100.64.3.' || o WHEN 2 THEN '100.128.3.' || o WHEN 3 THEN '127.0.0.' || o WHEN 4 THEN '169.254.9.' || o
  WHEN 5 THEN '172.16.5.' || o WHEN 6 THEN '172.32.5.' || o WHEN 7 THEN '192.168.7.' || o WHEN 8 THEN '192.0.2.' || o WHEN 9 THEN '224.0.0.' || o WHEN 10 THEN '8.8.4.' || o WHEN 11 THEN '203.0.113.' || o
  WHEN 12 THEN 'ff02::' || o WHEN 13 THEN 'fe80::' || o WHEN 14 THEN '300.1.1.' || o WHEN 15 THEN '' WHEN 16 THEN '2001:db8::' || o WHEN 17 THEN '1.2.3' ELSE '245.7.7.' || o END AS ip,
  CAST(CASE event_id % 5 WHEN 0 THEN 5353 WHEN 1 THEN 123 ELSE 443 END AS INT) AS port
FROM (SELECT event_id, CAST(event_id % 256 AS {text}) AS o FROM events) e
"""
#: Wide scans: each source tries one port of many hosts, every 0.8 s.
_SWEEP = """
SELECT event_id AS seq, event_id * 200000 AS ts_us, 'conn' AS kind, '10.50.0.' || CAST(event_id % 4 AS {text}) AS src_ip, CAST(40000 + event_id % 100 AS INT) AS src_port,
  CASE WHEN event_id % 4 < 2 THEN '203.0.113.' ELSE '8.8.4.' END || CAST((event_id {div} 4) * 7 % (20 + event_id {div} 4 {div} 97 % 41) AS {text}) AS dst_ip, CAST(445 AS INT) AS dst_port, 'tcp' AS proto,
  CAST(60 AS BIGINT) AS orig_bytes, CAST(0 AS BIGINT) AS resp_bytes, CASE WHEN event_id {div} 4 % 4 = 3 THEN 'SF' ELSE 'S0' END AS conn_state, 'S' AS tcp_flags
FROM events
"""


def _events(spark: SparkSession, d: str, sql: str) -> DataFrame:
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(sql.format(text="STRING", div="DIV"))


_DUCK = {"text": "VARCHAR", "div": "//"}


@query("b2_address_scopes", f"""WITH v AS ({_ADDRESSES.format(**_DUCK)}), n AS (SELECT *, regexp_full_match(ip, '[0-9]+(\\.[0-9]+){{3}}') AND coalesce(greatest({', '.join(f"TRY_CAST(split_part(ip, '.', {k}) AS INT)" for k in (1, 2, 3, 4))}) < 256, false) AS four FROM v),
  k AS (SELECT *, CASE WHEN four THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS u32 FROM n),
  m AS (SELECT *, coalesce(ip LIKE '192.0.2.%' OR ip LIKE '203.0.113.%', false) AS test_net,
    four AND (split_part(ip, '.', 1) IN ('127') OR ip LIKE '169.254.%' OR u32 >= 3758096384 OR ip LIKE '%.255') OR ip LIKE 'ff02:%' OR ip LIKE 'fe80:%' AS quiet FROM k)
  SELECT seq, ip, u32, four AND regexp_matches(ip, '^(10|127|169\\.254|192\\.168|22[4-9]|23[0-9]|172\\.(1[6-9]|2[0-9]|3[01])|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\\.') AS local, test_net,
    NOT test_net AND (quiet OR port IN {base._ports(fixed.NOISE_PORTS)}) AS noise FROM m""")
def b2(spark, d):
    ip = F.col("ip")
    noise = S.is_noise_traffic(F.lit("10.1.1.1"), F.lit(40000), ip, F.col("port"))
    return _events(spark, d, _ADDRESSES).select("seq", "ip", S.ip_to_u32(ip).alias("u32"), S.is_local_dest(ip).alias("local"), S.is_test_net(ip).alias("test_net"), noise.alias("noise"))


_GOOD = "|".join(p.replace(".", "\\.") for p in fixed.KNOWN_GOOD_PARENTS)
_WANTED = "CASE seq % 6 WHEN 0 THEN query || '.akamai.net' WHEN 1 THEN 'google.com' WHEN 2 THEN 'notgoogle.com' WHEN 3 THEN query || '.CloudFront.net.' WHEN 4 THEN 'akamai.net.' || query ELSE query END"


@query("b8_known_good", f"SELECT seq, name, regexp_matches(rtrim(lower(name), '.'), '(^|\\.)({_GOOD})$') AS good FROM (SELECT seq, {_WANTED} AS name FROM ({NAMES_SQL}))")
def b8(spark, d):
    return names(spark, d).select("seq", F.expr(_WANTED).alias("name")).select("seq", "name", S.is_known_good_domain(F.col("name")).alias("good"))


# Scans of many hosts, some of networks that deliver content.
def _net(a: int, b: int, c: int) -> int:
    return a * 2**24 + b * 2**16 + c * 256


_SWEEP_FOUND = base._RECON.replace(TELEMETRY_SQL, _SWEEP.format(**_DUCK)) + """, gated AS (SELECT * FROM feat WHERE greatest(unique_dst_ports, unique_dst_hosts) >= 12 AND failure_ratio >= 0.5), hosts AS (
  SELECT g.seq, t.dst_ip, sum(CASE WHEN t.conn_state IN ('S0', 'REJ') THEN 1 ELSE 0 END) AS failed, count(*) AS n FROM gated g JOIN tele t ON t.src_ip = g.src_ip AND t.ts_us >= g.ts_us - 30000000 AND (t.ts_us < g.ts_us OR (t.ts_us = g.ts_us AND t.seq <= g.seq)) GROUP BY ALL
), shares AS (SELECT seq, count(*) AS n_hosts, sum(CASE WHEN dst_ip LIKE '203.0.113.%' AND CAST(split_part(dst_ip, '.', 4) AS INT) < 16 THEN 1 ELSE 0 END) / count(*) AS share, first(dst_ip ORDER BY failed / n DESC, failed DESC, dst_ip) AS anchor_dst FROM hosts GROUP BY seq
), wide AS (SELECT g.*, n_hosts, share, anchor_dst, 0.25::DOUBLE * greatest(0.0, least(1.0, (unique_dst_hosts - 12) / 48.0)) + 0.10::DOUBLE * greatest(0.0, least(1.0, (failure_ratio - 0.5) * 2)) AS wide FROM gated g JOIN shares USING (seq)
), cand AS (SELECT *, 'horizontal_scan' AS subtype, 'src=' || src_ip AS aggregation_key, round_even(CASE WHEN share >= 0.5 THEN least(0.75::DOUBLE, (0.60::DOUBLE + wide) * 0.65::DOUBLE) ELSE least(0.95::DOUBLE, 0.62::DOUBLE + wide) END, 3) AS confidence FROM wide)"""


@query("d7_horizontal", _SWEEP_FOUND + f""" SELECT seq, subtype, confidence, {base._SEV} AS severity, aggregation_key, round_even(share, 3) AS provider_spread, CAST(n_hosts AS INT) AS n_hosts, share >= 0.5 AS downgraded, src_ip, src_port, anchor_dst AS dst_ip, dst_port, proto,
  CASE WHEN anchor_dst LIKE '203.0.113.%' AND CAST(split_part(anchor_dst, '.', 4) AS INT) < 16 THEN 'provider' ELSE 'unknown' END AS reputation FROM cand""")
def d7_horizontal(spark, d):
    asn = spark.createDataFrame([(_net(203, 0, 113), _net(203, 0, 113) + 15, "AS13335", "one")], reputation.SCHEMA)
    found = detectors.detect_recon(_events(spark, d, _SWEEP), asn=asn)
    e = F.col("supporting_evidence")
    return found.select("seq", "subtype", "confidence", "severity", "aggregation_key", e["provider_spread"].alias("provider_spread"), F.size(e["dst_hosts"]).alias("n_hosts"), e["downgrade_reason"].isNotNull().alias("downgraded"), "flow_id.*", e["reputation"].alias("reputation"))


_PROVIDED = base._EXFIL_FOUND.replace(", cand AS (", ", plain AS (SELECT *, CAST(split_part(dst_ip, '.', 4) AS INT) < 3 AS provider FROM feat), cand AS (").replace("round_even(least(0.97", "CASE WHEN provider THEN round_even(0.35::DOUBLE + 0.25::DOUBLE * least(1.0, (session_count - 3) / 17.0), 3) ELSE round_even(least(0.97").replace("27.0)))), 3) AS confidence", "27.0)))), 3) END AS confidence, provider").replace("FROM feat WHERE outbound", "FROM plain WHERE outbound")


@query("d9_exfil_provider", _PROVIDED + f" SELECT seq, confidence, {base._SEV} AS severity, provider FROM cand")
def d9_provider(spark, d):
    asn = spark.createDataFrame([(_net(198, 51, 100), _net(198, 51, 100) + 2, "AS15169", "one")], reputation.SCHEMA)
    found = detectors.detect_exfil(telemetry(spark, d), asn=asn)
    return found.select("seq", "confidence", "severity", (F.col("supporting_evidence")["reputation"] == "provider").alias("provider"))


# All detectors over events of all kinds.
_ROUTED = {"ddos": "d1_ddos", "c2_beaconing": "d4_c2", "recon_scan": "d7_recon", "exfiltration": "d9_exfil", "dga_dns_tunnel": "d5_dns", "encrypted_malware": "d6_encrypted"}


@query("b12_route", " UNION ALL ".join(f"SELECT '{threat}' AS threat_class, CAST({rank} AS INT) AS detector_rank, subtype, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, round_even(max(confidence), 3) AS highest FROM ({ORACLE_SQL[name]}) GROUP BY subtype" for rank, (threat, name) in enumerate(_ROUTED.items())))
def b12(spark, d):
    rows = telemetry(spark, d).unionByName(beacons(spark, d), allowMissingColumns=True).unionByName(names(spark, d), allowMissingColumns=True)
    found = detectors.candidates(rows)
    return found.groupBy("threat_class", "detector_rank", "subtype").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("confidence").alias("highest"))


ORACLE_SQL["b15_validate"] = base._EXFIL_FOUND + " SELECT 'exfiltration' AS threat_class, 'valid' AS state, count(*) AS n FROM cand HAVING count(*) > 0"


@query("b15_contract", base._EXFIL_FOUND + """ SELECT CASE seq % 11 WHEN 0 THEN 'missing field' WHEN 1 THEN 'threat class' WHEN 2 THEN 'severity' WHEN 3 THEN 'confidence' WHEN 4 THEN 'confidence' WHEN 5 THEN 'missing field' WHEN 6 THEN 'flow' WHEN 7 THEN 'threat class' ELSE 'valid' END AS state, count(*) AS n, min(seq) AS first_seq FROM cand GROUP BY 1""")
def b15_contract(spark, d):
    """Alerts that break each rule of the contract, by seq."""
    found = alerts.with_ids(detectors.detect_exfil(telemetry(spark, d)))
    k = F.col("seq") % 11
    broken = found.withColumns({
        "alert_id": F.when(k != 0, F.col("alert_id")), "threat_class": F.when(k.isin(1, 7), F.lit("mischief")).otherwise(F.col("threat_class")),
        "severity": F.when(k.isin(2, 7), F.lit("huge")).otherwise(F.col("severity")),
        "confidence": F.when(k == 3, F.lit(1.5)).when(k == 4, F.lit(float("nan"))).otherwise(F.col("confidence")),
        "supporting_evidence": F.when(k != 5, F.col("supporting_evidence")),
        "flow_id": F.when(k == 6, F.col("flow_id").withField("proto", F.lit(None).cast("string"))).otherwise(F.col("flow_id")),
    })
    return alerts.validate(broken).groupBy(F.coalesce("rejected", F.lit("valid")).alias("state")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# Evaluation of scenarios: each source is one.
def _scenarios(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tele = telemetry(spark, d)
    found = detectors.detect_exfil(tele).select(F.col("flow_id.src_ip").alias("scenario"), "threat_class")
    return tele.select(F.col("src_ip").alias("scenario")), found


_SCENARIOS = base._EXFIL_FOUND + """, per AS (SELECT src_ip AS scenario, CASE WHEN src_ip LIKE '%1' THEN 'exfiltration' WHEN src_ip LIKE '%2' THEN 'benign' ELSE 'ddos' END AS expected, count(*) AS events FROM tele GROUP BY src_ip
), hits AS (SELECT src_ip AS scenario, count(*) AS alerts FROM cand GROUP BY src_ip), both_ AS (SELECT scenario, expected, events, coalesce(alerts, 0) AS alerts, CASE WHEN expected = 'exfiltration' THEN coalesce(alerts, 0) ELSE 0 END AS matched FROM per LEFT JOIN hits USING (scenario))"""


@query("g6_scenario_eval", _SCENARIOS + """ SELECT scenario, expected, events, alerts, CAST(matched AS BIGINT) AS matched, CASE WHEN expected = 'benign' THEN alerts = 0 ELSE matched > 0 END AS detected, CASE WHEN alerts > matched THEN 'exfiltration' ELSE '' END AS unexpected FROM both_""")
def g6(spark, d):
    events, found = _scenarios(spark, d)
    s = F.col("scenario")
    truth = events.distinct().withColumn("expected", F.when(s.endswith("1"), "exfiltration").when(s.endswith("2"), "benign").otherwise("ddos"))
    return evaluate.scenario_eval(events, found, truth).withColumn("unexpected", F.array_join("unexpected", ","))


@query("g8_benign_fpr", _SCENARIOS + " SELECT round_even(sum(alerts) / greatest(1, sum(events)), 4) AS benign_fpr FROM both_ WHERE expected = 'benign'")
def g8_benign(spark, d):
    events, found = _scenarios(spark, d)
    quiet = F.col("scenario").endswith("2")
    counts = events.where(quiet).agg(F.count("*").alias("events")).crossJoin(found.where(quiet).agg(F.count("*").alias("alerts")))
    return evaluate.benign_rate(counts)


@query("g9_scenario_score", "SELECT 'dga_dns_tunnel' AS ground_truth, count(*) AS alerts, count(*) FILTER (WHERE c = 'dga_dns_tunnel') AS true_positive_alerts, count(*) FILTER (WHERE c <> 'dga_dns_tunnel') AS false_positive_alerts, count(*) FILTER (WHERE c = 'dga_dns_tunnel') > 0 AS detected FROM " f"(SELECT 'dga_dns_tunnel' AS c FROM ({ORACLE_SQL['d5_dns']}) UNION ALL SELECT 'exfiltration' FROM ({ORACLE_SQL['d9_exfil']}))")
def g9(spark, d):
    found = detectors.detect_dns(names(spark, d)).select("threat_class").unionByName(detectors.detect_exfil(telemetry(spark, d)).select("threat_class"))
    return evaluate.scenario_score(found, "dga_dns_tunnel")


@query("g10_label_windows", """SELECT doc_id AS window_pos, CASE WHEN toxic = 1 THEN 'ddos' WHEN quality = 1 THEN 'recon_scan' END AS class, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 1000000 END AS start_us, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 1000000 + 60500000 END AS end_us FROM labels""")
def g10(spark, d):
    rows = base._table(spark, d, "labels").select(
        F.col("doc_id").alias("pos"), F.when(F.col("toxic") == 1, " DDoS").when(F.col("quality") == 1, "PortScan ").otherwise("BENIGN").alias("label"),
        F.col("doc_id").cast("string").alias("start_time"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") + 60.5).cast("string")).alias("to"))
    return evaluate.label_windows(rows)


@query("g18_replay_latency", """WITH l AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS v FROM (SELECT round_even(CAST(l_extendedprice AS DOUBLE), 3) AS l_extendedprice FROM lineitem))
  SELECT (SELECT count(*) FROM events) AS events, len(v) AS alerts, round_even((SELECT count(*) FROM events) / 12.5::DOUBLE, 2) AS events_per_second, v[CAST(floor((len(v) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, v[CAST(floor((len(v) - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99 FROM l""")
def g18(spark, d):
    found = base._table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("latency_ms"))
    return evaluate.replay_latency(base._table(spark, d, "events"), found, 12.5)


@query("a26_metrics_sink", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS metric_ts, count(*) AS events_total, count(*) FILTER (WHERE o_orderstatus = 'F') AS alerts_total, round_even(max(CAST(o_totalprice AS DOUBLE)), 2) AS p95_latency_ms FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 1""")
def a26(spark, d):
    """Snapshots of orders by day, written in two batches, one of them twice; the newest one."""
    path = base._scratch(spark, "metrics")
    rows = base._table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("metric_ts")).agg(F.count("*").alias("events_total"), F.count_if(F.col("o_orderstatus") == "F").alias("alerts_total"), F.lit(0).alias("stream_lag"), S.rounded(F.max("o_totalprice"), 2).alias("p95_latency_ms"), F.lit(0.0).alias("throughput_eps"))
    early = F.col("metric_ts") < "1996-01-01"
    for batch, part in ((0, early), (1, ~early), (1, ~early)):
        store.write_metrics(rows.where(part), path, batch)
    return store.latest_metrics(store.read_metrics(spark, path)).select("metric_ts", "events_total", "alerts_total", "p95_latency_ms")


# The whole pipeline: repeats dropped key by key, then the signals of each source folded in order.
_SHIFT = f"SELECT * REPLACE (ts_us + 47000000000 AS ts_us) FROM ({NAMES_SQL})"
_DNS_FOUND = base._DNS.replace(NAMES_SQL, _SHIFT) + """, cand AS (SELECT seq, ts_us, src_ip, CASE WHEN query_rate >= 0.05 AND unique_subdomains >= 3 THEN 'dns_tunnel' ELSE 'dga_domain' END AS subtype, round_even(least(0.95, label_entropy / 5), 3) AS confidence, src_ip || '|' || dst_ip AS aggregation_key
  FROM feat WHERE label_length >= 18 AND label_entropy >= 3.3)"""
_TLS_FOUND = base._TLS + """, cand AS (SELECT seq, ts_us, src_ip, CASE WHEN suspicious_fingerprint THEN 'metadata_anomaly' WHEN ja3 = '' AND outbound_inbound_ratio >= 8 AND host_sessions <= 2 THEN 'upload_channel_anomaly' END AS subtype,
  CASE WHEN suspicious_fingerprint THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, src_ip || '|' || dst_ip AS aggregation_key FROM feat)"""
_EACH = {"ddos": (0, base._DDOS_FOUND), "recon_scan": (2, base._RECON_FOUND), "exfiltration": (3, base._EXFIL_FOUND), "dga_dns_tunnel": (4, _DNS_FOUND), "encrypted_malware": (5, _TLS_FOUND)}
_FRESH = "WITH RECURSIVE cand AS (" + " UNION ALL ".join(f"SELECT '{threat}' AS threat_class, {rank} AS detector_rank, subtype, confidence, aggregation_key, ts_us, seq, src_ip FROM ({found} SELECT * FROM cand WHERE subtype IS NOT NULL)" for threat, (rank, found) in _EACH.items()) + """
), numbered AS (SELECT *, row_number() OVER (PARTITION BY subtype, aggregation_key ORDER BY ts_us, seq) AS i FROM cand), emitted AS (
  SELECT * FROM numbered WHERE i = 1
  UNION ALL SELECT x.* EXCLUDE (place) FROM (SELECT n.*, row_number() OVER (PARTITION BY n.subtype, n.aggregation_key ORDER BY n.i) AS place FROM emitted e JOIN numbered n ON n.subtype = e.subtype AND n.aggregation_key = e.aggregation_key AND n.i > e.i AND n.ts_us - e.ts_us >= 30000000) x WHERE place = 1
), signals AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, seq, detector_rank) AS place FROM emitted), folded AS (
  SELECT DISTINCT src_ip, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS threats, CAST([] AS DOUBLE[]) AS levels, CAST(NULL AS BIGINT) AS last, false AS hit, CAST(NULL AS BIGINT) AS ts_us, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS best, CAST(NULL AS VARCHAR) AS classes FROM signals
  UNION ALL SELECT src_ip, place, CASE WHEN hit THEN list_append(threats, 'c2_beaconing')[-8:] ELSE threats END, CASE WHEN hit THEN list_append(levels, best)[-8:] ELSE levels END, CASE WHEN hit THEN ts_us ELSE last END, hit, ts_us, seq, best, classes FROM (
    SELECT *, len(list_distinct(threats)) >= 3 AND (last IS NULL OR ts_us - last >= 3600000000) AS hit, least(0.9::DOUBLE, list_max(levels)) AS best, array_to_string(list_sort(list_distinct(threats)), ',') AS classes FROM (
      SELECT n.src_ip, n.place, n.ts_us, n.seq, f.last, list_append(f.threats, n.threat_class)[-8:] AS threats, list_append(f.levels, n.confidence)[-8:] AS levels FROM folded f JOIN signals n ON n.src_ip = f.src_ip AND n.place = f.place + 1))
), linked AS (SELECT src_ip, ts_us, seq, best AS confidence, classes FROM folded WHERE hit)"""

ORACLE_SQL["e2_correlate"] = _FRESH + " SELECT src_ip, seq, confidence, classes FROM linked"
ORACLE_SQL["e4_pipeline"] = _FRESH + f""", found AS (SELECT threat_class, subtype, confidence, aggregation_key, ts_us, seq FROM emitted UNION ALL SELECT 'c2_beaconing', 'correlated_multi_signal', confidence, 'src=' || src_ip, ts_us, seq FROM linked)
  SELECT sha256(concat_ws('|', threat_class, subtype, aggregation_key, ts_us, seq)) AS alert_id, threat_class, subtype, confidence, {base._SEV} AS severity, aggregation_key, seq FROM found"""


# Files of one table under different headers.
@query("a23_parquet_scan", """SELECT label, count(*) AS n, count(port) AS ports, CAST(sum(port) AS BIGINT) AS port_sum, CAST(sum(span) AS DOUBLE) AS span_sum FROM (
  SELECT lang AS label, CASE WHEN doc_id % 3 <> 1 THEN doc_id % 1000 END AS port, CASE WHEN doc_id % 3 = 2 THEN n_chars + 0.5 ELSE n_chars END AS span FROM documents) GROUP BY label""")
def a23(spark, d):
    """The census of documents, written as three files with different spellings, types and columns, and scanned as one."""
    path = base._scratch(spark, "tables")
    docs = base._table(spark, d, "documents")
    k, port, span = F.col("doc_id") % 3, F.col("doc_id") % 1000, F.col("n_chars")
    docs.where(k == 0).select(F.col("lang").alias(" Label "), port.cast("int").alias("Dst Port"), span.cast("int").alias("Flow Duration")).coalesce(1).write.parquet(f"{path}/monday")
    docs.where(k == 1).select(span.cast("long").alias("FLOW DURATION"), F.col("lang").alias("LABEL")).coalesce(1).write.parquet(f"{path}/tuesday")
    docs.where(k == 2).select(F.col("lang").alias("label"), (span + 0.5).alias(" flow duration"), port.alias("dst port ")).coalesce(1).write.parquet(f"{path}/friday")
    rows = tables.parquet_scan(spark, path)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count("dst port").alias("ports"), F.sum("dst port").alias("port_sum"), F.sum("flow duration").alias("span_sum"))


# The chain in segments.
_PLACED = base._STORED + """, placed AS (SELECT seq, alert_id, record_json, (seq - 1) // 500 AS segment, (seq - 1) % 500 AS pos FROM rows
), linked AS (SELECT segment, pos, seq, alert_id, sha256('0000000000000000000000000000000000000000000000000000000000000000' || record_json) AS record_hash FROM placed WHERE pos = 0
  UNION ALL SELECT p.segment, p.pos, p.seq, p.alert_id, sha256(l.record_hash || p.record_json) FROM linked l JOIN placed p ON p.segment = l.segment AND p.pos = l.pos + 1
), heads AS (SELECT segment, min(seq) AS first_seq, count(*) AS n, arg_max(record_hash, seq) AS head FROM linked GROUP BY segment
), chained AS (SELECT segment, first_seq, n, head, sha256('0000000000000000000000000000000000000000000000000000000000000000' || '{"first_seq":' || first_seq || ',"head":"' || head || '","n":' || n || ',"segment":' || segment || '}') AS link FROM heads WHERE segment = 0
  UNION ALL SELECT h.segment, h.first_seq, h.n, h.head, sha256(c.link || '{"first_seq":' || h.first_seq || ',"head":"' || h.head || '","n":' || h.n || ',"segment":' || h.segment || '}') FROM chained c JOIN heads h ON h.segment = c.segment + 1)"""


def _segmented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = base._scratch(spark, "segments")
    store.chain_segments(base._numbered(spark, d), each=500).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    store.link_heads(store.segment_heads(rows)).write.parquet(f"{path}/heads")
    return rows, spark.read.parquet(f"{path}/heads")


@query("f1_segments", _PLACED + " SELECT l.segment, l.seq, l.alert_id, l.record_hash, c.link FROM linked l JOIN chained c USING (segment)")
def f1_segments(spark, d):
    rows, heads = _segmented(spark, d)
    return rows.join(heads.select("segment", "link"), "segment").select("segment", "seq", "alert_id", "record_hash", "link")


@query("f2_segments", _PLACED + " SELECT true AS valid, (SELECT count(*) FROM rows) AS checked, (SELECT arg_max(link, segment) FROM chained) AS head")
def f2_segments(spark, d):
    return store.verify_segments(*_segmented(spark, d)).select("valid", "checked", "head")


@query("f2_segments_tampered", _PLACED + """ SELECT kind, false AS valid, CASE kind WHEN 'gone' THEN 503 WHEN 'tail' THEN (SELECT max(seq) FROM rows) ELSE 777 END AS failed_sequence FROM (SELECT unnest(['changed', 'doubled', 'gone', 'tail']) AS kind)""")
def f2_segments_bad(spark, d):
    """What is found after one row is changed, doubled, taken away, or the last one cut off."""
    rows, heads = _segmented(spark, d)
    last = rows.agg(F.max("seq").alias("_last"))
    broken = {
        "changed": rows.withColumn("record_json", F.when(F.col("seq") == 777, F.lit("{}")).otherwise(F.col("record_json"))), "doubled": rows.unionByName(rows.where("seq = 777")),
        "gone": rows.where("seq <> 503"), "tail": rows.crossJoin(F.broadcast(last)).where("seq < _last").drop("_last"),
    }
    out = [store.verify_segments(r, heads).select(F.lit(kind).alias("kind"), "valid", "failed_sequence") for kind, r in broken.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("f4_dashboard", base._STORED + """, m AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS metric_ts, count(*) AS events_total, count(*) FILTER (WHERE o_orderstatus = 'F') AS alerts_total FROM orders GROUP BY o_orderdate ORDER BY metric_ts DESC LIMIT 1)
  SELECT (SELECT count(*) FROM stored) AS total, (SELECT string_agg(threat_class || ':' || n, ',' ORDER BY threat_class) FROM (SELECT threat_class, count(*) AS n FROM stored GROUP BY ALL)) AS by_class,
    (SELECT string_agg(severity || ':' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM stored GROUP BY ALL)) AS by_severity, metric_ts, events_total, alerts_total FROM m""")
def f4_dashboard(spark, d):
    rows = base._table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("metric_ts")).agg(F.count("*").alias("events_total"), F.count_if(F.col("o_orderstatus") == "F").alias("alerts_total"))
    metrics = rows.select("*", F.lit(0).cast("long").alias("stream_lag"), F.lit(0.0).alias("p95_latency_ms"), F.lit(0.0).alias("throughput_eps"))
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    board = store.dashboard(base._numbered(spark, d), metrics)
    return board.select("total", text(F.col("by_class")).alias("by_class"), text(F.col("by_severity")).alias("by_severity"), "metrics.metric_ts", "metrics.events_total", "metrics.alerts_total")


@query("c5_scan_targets", base._RECON + """, gated AS (SELECT seq, src_ip, ts_us FROM feat WHERE unique_dst_ports >= 12 AND failure_ratio >= 0.5), hosts AS (
  SELECT g.seq, t.dst_ip, sum(CASE WHEN conn_state IN ('S0', 'REJ') THEN 1 ELSE 0 END) AS failed, count(*) AS n
  FROM gated g JOIN tele t ON t.src_ip = g.src_ip AND t.ts_us >= g.ts_us - 30000000 AND (t.ts_us < g.ts_us OR (t.ts_us = g.ts_us AND t.seq <= g.seq)) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY failed / n DESC, failed DESC, dst_ip) AS rank FROM hosts)
  SELECT seq, CAST(rank AS INT) AS rank, dst_ip, CAST(failed AS BIGINT) AS failed, n AS attempts, round_even(failed / n, 2) AS failure_ratio FROM ranked WHERE rank <= 8""")
def c5_scan_targets(spark, d):
    """The eight hosts that each scanning event's source failed at most."""
    tele = telemetry(spark, d)
    gated = features.recon_features(tele).where("unique_dst_ports >= 12 AND failure_ratio >= 0.5")
    return features.recon_targets(gated, tele).select("seq", F.explode("scan_targets").alias("t")).select("seq", "t.*")


@query("b9_nested_ranges", f"""WITH ip AS (SELECT seq, o, net FROM (SELECT event_id AS seq, event_id % 256 AS o, event_id // 256 % 64 AS net FROM events))
  SELECT seq, CASE WHEN net % 2 = 0 AND o BETWEEN 16 AND 31 THEN CASE WHEN o = 20 THEN 'AS3' ELSE 'AS13335' END WHEN net < 48 THEN 'AS2' END AS asn,
    CASE WHEN net % 2 = 0 AND o BETWEEN 16 AND 31 AND o <> 20 THEN 'provider' ELSE 'unknown' END AS reputation FROM ip""")
def b9_nested(spark, d):
    """Addresses of one busy /16 against ranges within ranges; the innermost owner counts, in the shuffled and in the broadcast form."""
    rows = base._table(spark, d, "events").select(F.col("event_id").alias("seq"), F.format_string("7.7.%d.%d", (F.col("event_id") / 256).cast("long") % 64, F.col("event_id") % 256).alias("ip"))
    nets = base._table(spark, d, "events").select((F.col("event_id") % 64).alias("n")).distinct().where("n % 2 = 0").select((F.col("n") * 256 + _net(7, 7, 0)).alias("at"))
    span = lambda a, b, asn: nets.select((F.col("at") + a).alias("start"), (F.col("at") + b).alias("end"), F.lit(asn).alias("asn"), F.lit("").alias("asn_name"))
    whole = spark.createDataFrame([(_net(7, 7, 0), _net(7, 7, 47) + 255, "AS2", ""), (_net(7, 7, 0), _net(7, 7, 47) + 255, "AS2", "")], reputation.SCHEMA)
    owners = reputation.prepare(whole.unionByName(span(16, 31, "AS13335")).unionByName(span(20, 20, "AS3")))
    by_24 = reputation.Owners(owners.ranges.withColumn("net", F.explode(F.sequence(F.shiftright("start", 8), F.shiftright("end", 8)))), 24)
    half = F.col("seq") % 2 == 0
    found = reputation.describe(rows.where(half), "ip", owners).unionByName(reputation.describe(rows.where(~half), "ip", by_24))
    return found.select("seq", "asn", "reputation")


@query("h3_vocabulary_split", f"""WITH named AS (SELECT seq, lower(split_part(query, '.', 1)) AS label FROM ({NAMES_SQL})),
  words AS (SELECT seq, label, CASE WHEN len(w) > 0 THEN w ELSE [label] END AS w FROM (SELECT *, list_distinct(regexp_extract_all(label, '[a-z]{{3,}}')) AS w FROM named)),
  dealt AS (SELECT seq, label, unnest(w) AS word FROM words), sides AS (SELECT seq, label, word, CAST('0x' || substr(md5(word), 1, 4) AS INT) < 32768 AS test FROM dealt)
  SELECT seq, label, CASE WHEN bool_and(test) THEN 'test' WHEN bool_or(test) THEN 'between' ELSE 'train' END AS part FROM sides GROUP BY seq, label""")
def h3_split(spark, d):
    labels = names(spark, d).select("seq", F.lower(S.first_label(F.col("query"))).alias("label"))
    return learning.split_by_vocabulary(labels)


@query("f8_sketches", """SELECT count(*) AS events_total, CAST(sum(l_linenumber) AS BIGINT) AS alerts_total, true AS p50, true AS p95, true AS p99 FROM lineitem""")
def f8_sketches(spark, d):
    """Quantiles from one sketch for each ship date, merged; whether each is within half a percent of its rank."""
    rows = base._table(spark, d, "lineitem").select("l_shipdate", F.col("l_extendedprice").cast("double").alias("latency_ms"), F.col("l_linenumber").cast("long").alias("alerts"))
    found = store.quantiles_over(store.latency_sketches(rows, "l_shipdate"))
    near = lambda q: (F.avg((F.col("latency_ms") < F.col(f"p{q}_ms")).cast("double")) <= q / 100 + 0.005) & (F.avg((F.col("latency_ms") <= F.col(f"p{q}_ms")).cast("double")) >= q / 100 - 0.005)
    totals = [F.max(c).alias(c) for c in ("events_total", "alerts_total")]
    return rows.drop("alerts").crossJoin(F.broadcast(found)).agg(*totals, *[near(q).alias(f"p{q}") for q in (50, 95, 99)])


#: Beacons of which every fifth user calls a discovery port, and some a broadcast address.
_NOISY = BEACONS_SQL.replace("WHEN 0 THEN 443", "WHEN 0 THEN 5353").replace("THEN '10.0.0.99'", "THEN CASE WHEN user_id % 2 = 0 THEN '10.0.0.99' ELSE '10.0.0.255' END")


@query("d4_c2_noise", ORACLE_SQL["d4_c2"].replace(BEACONS_SQL, _NOISY))
def d4_noise(spark, d):
    """Beacons among discovery and broadcast traffic, which raises nothing."""
    rows = beacons(spark, d).withColumn("_user", F.floor(F.col("seq") / 100))
    port = F.when(F.col("_user") % 5 == 0, F.lit(5353)).otherwise(F.col("dst_port")).cast("int")
    host = F.when((F.col("_user") % 3 == 0) & (F.col("_user") % 2 != 0), "10.0.0.255").otherwise(F.col("dst_ip"))
    return base._shown(detectors.detect_c2(rows.withColumns({"dst_port": port, "dst_ip": host}).drop("_user")))
