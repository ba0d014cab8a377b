"""Sensor logs of each kind, flow tables, labels, owner tables, sinks and sets of parquet files."""

import json

import pytest
from pyspark.sql import functions as F

from netvigil.functions import scalars as S
from netvigil.operators import reputation, store
from netvigil.sources import logs, packets, tables

ENDS = {"ts": 10.5, "uid": "C1", "id.orig_h": "10.0.0.1", "id.orig_p": 50000, "id.resp_h": "192.0.2.1", "id.resp_p": 443, "proto": "tcp"}


def log(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_each_log_kind_by_its_file_name(spark, tmp_path):
    log(tmp_path, "ssl.log", {**ENDS, "version": "TLSv13", "server_name": "a.example", "ja3": "j3", "ja4": "j4", "cipher": "c", "resumed": True, "established": True}, ENDS)
    log(tmp_path, "tls.json", ENDS)
    log(tmp_path, "x509.log", {**ENDS, "subject": "CN=a", "issuer": "CN=b", "certificate.version": "3"})
    log(tmp_path, "early.log", {"ts": 1.0, "uid": "C2", "src_ip": "10.0.0.2", "src_port": 1, "dst_ip": "192.0.2.2", "dst_port": 2, "proto": "tcp"})
    log(tmp_path, "dns.log", {**ENDS, "query": "a.example", "qtype_name": "A", "rcode_name": "NOERROR", "answers": ["1.2.3.4", "1.2.3.5"]})
    rows = logs.read_event_logs(spark, str(tmp_path)).collect()
    kinds = {k: [r for r in rows if r.kind == k] for k in ("tls", "tls_certificate", "early_event", "dns")}
    full = next(r for r in kinds["tls"] if r.sni)
    assert len(kinds["tls"]) == 3 and (full.tls, full.tls_version, full.sni, full.ja3, full.ja4, full.cipher, full.resumed, full.established) == (True, "TLSv13", "a.example", "j3", "j4", "c", True, True)
    assert {(r.tls, r.tls_version, r.resumed) for r in kinds["tls"] if not r.sni} == {(True, "unknown", False)}
    cert = kinds["tls_certificate"][0]
    assert (cert.certificate_subject, cert.certificate_issuer, cert.certificate_validity, cert.tls, cert.dst_port) == ("CN=a", "CN=b", "3", True, 443)
    early = kinds["early_event"][0]
    assert (early.src_ip, early.src_port, early.dst_ip, early.dst_port, early.ts_us, early.orig_bytes) == ("10.0.0.2", 1, "192.0.2.2", 2, 1_000_000, 0)
    name = kinds["dns"][0]
    assert (name.query, name.qtype, name.rcode, name.answers_count) == ("a.example", "A", "NOERROR", 2)


def test_published_values_and_union(spark, tmp_path):
    log(tmp_path, "conn.log", {**ENDS, "orig_bytes": 5}, {**ENDS, "ts": 3.0})
    log(tmp_path, "dns.log", {**ENDS, "ts": 7.0, "query": "q"})
    events = logs.read_event_logs(spark, str(tmp_path / "conn.log"))
    names = logs.read_event_logs(spark, str(tmp_path / "dns.log"))
    values = logs.publish(events)
    assert values.columns == ["value"] and ": " not in values.first().value
    assert sorted(logs.consume(values).collect()) == sorted(events.collect())
    assert [r.ts_us for r in logs.union_sorted(events, names.drop("uid")).collect()] == [3_000_000, 7_000_000, 10_500_000]


def test_row_cap_takes_the_first_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Source IP,Destination IP\n" + "".join(f"10.0.0.{k},192.0.2.1\n" for k in range(9)))
    rows = logs.read_flow_table(spark, str(tmp_path / "f.csv"))
    assert [r.src_ip for r in logs.flow_events(rows, max_rows=4).orderBy("seq").collect()] == [f"10.0.0.{k}" for k in range(4)]
    assert logs.flow_events(rows).count() == 9


def test_a_folder_of_tables_with_headers_of_their_own(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Source IP,Destination IP,Destination Port\n10.0.0.1,192.0.2.1,80\n")
    (folder / "b.csv").write_text("Destination Port, dst_ip ,src_ip\n443,192.0.2.2,10.0.0.2\n")
    (folder / "c.csv").write_text("Destination Port,Flow Duration,Label\n80,1000000,BENIGN\n80,5,DDoS\n")
    events, flows = logs.read_flow_tables(spark, str(folder))
    assert sorted((r.src_ip, r.dst_ip, r.dst_port) for r in events.collect()) == [("10.0.0.1", "192.0.2.1", 80), ("10.0.0.2", "192.0.2.2", 443)]
    assert events.select("seq").distinct().count() == 2
    assert sorted((r.dst_port, r.duration, r.label) for r in flows.collect()) == [("80", "1000000", "BENIGN"), ("80", "5", "DDoS")]
    (folder / "c.csv").unlink()
    assert logs.read_flow_tables(spark, str(folder))[1] is None


def test_flows_of_a_stream_close_after_silence(spark, tmp_path):
    schema = "ts_us long, seq long, src string, sport int, dst string, dport int, ip_proto int, tcp_flags int, payload_len int, dns_qr int, dns_qdcount int, dns_qname string"
    rows = [(k * 1_000_000, k, "10.0.0.1", 1000, "192.0.2.1", 80, 6, 2 if k == 0 else 16, 10, None, None, None) if k % 2 == 0 else (k * 1_000_000, k, "192.0.2.1", 80, "10.0.0.1", 1000, 6, 18 if k == 1 else 16, 20, None, None, None) for k in range(4)]
    rows += [(30_000_000 + k, 10 + k, "10.0.0.1", 1000, "192.0.2.1", 80, 6, 2, 5, None, None, None) for k in range(2)] + [(99_000_000, 20, "10.0.0.9", 1, "192.0.2.9", 2, 17, 0, 1, None, None, None)]
    folder = str(tmp_path / "packets")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    query = packets.assemble_flows_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "flows")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.ts_us, r.src_ip, r.orig_bytes, r.resp_bytes, r.conn_state) for r in spark.read.parquet(str(tmp_path / "flows")).collect())
    assert got == [(0, "10.0.0.1", 20, 40, "SF"), (30_000_000, "10.0.0.1", 10, 0, "S0")]


def test_owner_table_good_missing_and_broken(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"prefixes": [[16, 31, "AS13335"], [64, 64, "AS1"]], "asn_to_name": {"AS13335": "one"}}))
    (tmp_path / "bad.json").write_text("{nonsense")
    good = {(r.start, r.end, r.asn, r.asn_name) for r in reputation.load_asn_table(spark, str(tmp_path / "good.json")).collect()}
    assert {(16, 31, "AS13335", "one")} <= good and len(good) == 2
    for name in ("bad.json", "none.json"):
        empty = reputation.load_asn_table(spark, str(tmp_path / name))
        assert empty.count() == 0
        one = spark.createDataFrame([("8.8.8.8",)], "ip string")
        assert reputation.describe(one, "ip", empty).first().reputation == "unavailable"


@pytest.mark.parametrize("sep", [",", "\t"])
def test_labels_by_their_separator(spark, tmp_path, sep):
    (tmp_path / "l").write_text("﻿ Label " + sep + "START\n DDoS " + sep + "10\nx" + sep + "\n")
    rows = logs.read_labels(spark, str(tmp_path / "l")).orderBy("pos").collect()
    assert [(r.label, r.start) for r in rows] == [("DDoS", "10"), ("x", None)]


def test_alert_lines_and_evidence(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("ts_us"), F.format_string("a%d", "id").alias("alert_id"), F.lit("2024").alias("timestamp"), F.lit("ddos").alias("threat_class"), F.lit("high").alias("severity"), F.lit(0.8).alias("confidence"), F.lit("s").alias("src_ip"), F.lit("d").alias("dst_ip"), F.format_string('{"k":%d}', "id").alias("record_json"))
    logs.write_alert_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 5
    store.chain(rows).write.parquet(str(tmp_path / "table"))
    stored = spark.read.parquet(str(tmp_path / "table"))
    manifest = {r.name: r.sha256 for r in store.export_evidence(stored, str(tmp_path / "out")).collect()}
    assert set(manifest) == {"summary", "chain", "alerts"} and spark.read.json(str(tmp_path / "out" / "alerts")).count() == 5
    changed = stored.withColumn("severity", F.when(F.col("seq") == 2, "low").otherwise(F.col("severity")))
    other = {r.name: r.sha256 for r in store.export_evidence(changed, str(tmp_path / "out2")).collect()}
    assert other["alerts"] != manifest["alerts"] and other["chain"] == manifest["chain"]


def test_canonical_json(spark):
    row = spark.sql("SELECT 2 AS b, CAST(NULL AS INT) AS a, named_struct('z', 1, 'y', 'é') AS c")
    assert row.select(S.canonical_json("a", "b", "c")).first()[0] == '{"a":null,"b":2,"c":{"z":1,"y":"é"}}'


def test_parquet_files_of_many_headers(spark, tmp_path):
    spark.sql("SELECT 1 AS `Dst Port`, 'x' AS ` Label`, 1.5F AS Rate").write.parquet(str(tmp_path / "a"))
    spark.sql("SELECT 'y' AS `LABEL `, 5000000000 AS `dst port`, true AS extra").write.parquet(str(tmp_path / "deep" / "b"))
    spark.sql("SELECT CAST(NULL AS STRING) AS `label`, 'z' AS ` Label`, 7 AS rate").write.parquet(str(tmp_path / "c"))
    spark.sql("SELECT 'w' AS label, 'text' AS rate").where("false").write.parquet(str(tmp_path / "d"))
    rows = tables.parquet_scan(spark, str(tmp_path))
    assert dict(rows.dtypes) == {"dst port": "bigint", "label": "string", "rate": "string", "extra": "boolean"}
    assert sorted((r["dst port"] or 0, r.label, r.rate, r.extra) for r in rows.collect()) == [(0, "z", "7", None), (1, "x", "1.5", None), (5_000_000_000, "y", None, True)]
    from netvigil.operators import evaluate

    assert {(r.label, r.n) for r in evaluate.label_census(rows).collect()} == {("x", 1), ("y", 1), ("z", 1)}
    assert evaluate.field_coverage(spark, rows.columns).count() > 0
    plan = rows.where("label = 'x'").select("label")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "Rate" not in plan[plan.rindex("Physical Plan") :]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.parquet_scan(spark, str(tmp_path / "empty"))
    assert [tables.common_type([a, b]).simpleString() for a, b in (("tinyint", "bigint"), ("int", "float"), ("string", "int"), ("date", "date")) for a, b in [(spark.sql(f"SELECT CAST(NULL AS {a}) AS x").schema[0].dataType, spark.sql(f"SELECT CAST(NULL AS {b}) AS x").schema[0].dataType)]] == ["bigint", "double", "string", "date"]
