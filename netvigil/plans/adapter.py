"""The given tables as telemetry: one view, written once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TELEMETRY = """
SELECT event_id AS seq, {micros} {div} 36000 AS ts_us, 'conn' AS kind,
  '10.0.0.' || CAST(user_id % 16 AS {text}) AS src_ip, CAST(40000 + user_id % 1000 AS INT) AS src_port,
  '198.51.100.' || CAST({k} % 8 AS {text}) AS dst_ip, CAST(1000 + {k} AS INT) AS dst_port,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'udp' ELSE 'tcp' END AS proto,
  CAST(floor(value * 1000) AS BIGINT) AS orig_bytes, CAST({k} * 10 AS BIGINT) AS resp_bytes,
  CASE event_type WHEN 'error' THEN 'REJ' WHEN 'click' THEN 'S0' WHEN 'signup' THEN 'S0' ELSE 'SF' END AS conn_state,
  CASE WHEN event_type IN ('click', 'error', 'signup') THEN 'S' ELSE '' END AS tcp_flags,
  event_type = 'purchase' AS tls, CASE WHEN {k} % 3 = 0 THEN 'ja3-' || CAST({k} AS {text}) ELSE '' END AS ja3,
  event_type = 'purchase' AND {k} % 29 = 0 AS suspicious_fingerprint, CAST(NULL AS {text}) AS query, CAST(NULL AS {text}) AS sni
FROM events
"""
_SPARK = {"micros": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "div": "DIV", "text": "STRING", "k": "CAST(get_json_object(props, '$.k') AS INT)"}
_DUCK = {"micros": "epoch_us(ts)", "div": "//", "text": "VARCHAR", "k": "CAST(json_extract_string(props, '$.k') AS INT)"}
#: Regular exchanges, which random events never are: each user calls one host every 30 s.
_BEACONS = """
SELECT CAST(user_id * 100 + i AS BIGINT) AS seq, CAST(1000000000 + i * 30000000 AS BIGINT) AS ts_us, 'conn' AS kind,
  '10.30.' || CAST(user_id {div} 250 AS {text}) || '.' || CAST(user_id % 250 AS {text}) AS src_ip, CAST(50000 AS INT) AS src_port,
  CASE WHEN user_id % 3 = 0 THEN '10.0.0.99' ELSE '203.0.113.' || CAST(user_id % 7 AS {text}) END AS dst_ip,
  CAST(CASE user_id % 5 WHEN 0 THEN 443 WHEN 1 THEN 4444 WHEN 2 THEN 993 WHEN 3 THEN 445 ELSE 80 END AS INT) AS dst_port,
  'tcp' AS proto, CAST(100 + user_id % 50 AS BIGINT) AS orig_bytes, CAST(150 AS BIGINT) AS resp_bytes, 'SF' AS conn_state, 'S' AS tcp_flags
FROM (SELECT DISTINCT user_id FROM events) u, {steps}
"""
_NAMES = """
SELECT page_id AS seq, page_id * 250000 AS ts_us, 'dns' AS kind, '10.40.0.' || CAST(page_id % 4 AS {text}) AS src_ip, CAST(50001 AS INT) AS src_port,
  '8.8.8.8' AS dst_ip, CAST(53 AS INT) AS dst_port, 'udp' AS proto,
  CASE WHEN page_id % 2 = 0 THEN substr({sha}, 1, 20) || '.' ELSE '' END || {host} AS query
FROM pages
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_TELEMETRY.format(**_SPARK))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(_BEACONS.format(**_SPARK, steps="(SELECT explode(sequence(0, 11)) AS i) s"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("pages")
    return spark.sql(_NAMES.format(text="STRING", sha="sha2(url, 256)", host="regexp_extract(url, '://([^/?#]+)', 1)"))


TELEMETRY_SQL = _TELEMETRY.format(**_DUCK)
BEACONS_SQL = _BEACONS.format(**_DUCK, steps="range(0, 12) AS s(i)")
NAMES_SQL = _NAMES.format(text="VARCHAR", sha="sha256(url)", host="regexp_extract(url, '://([^/?#]+)', 1)")
