"""Streams: event numbers, late and unreadable rows, keyed windows, restarts and the live feed."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from netvigil.operators import alerts, features, store
from netvigil.sources import logs
from netvigil.streaming import live, windows

FLOW = {"kind": "conn", "src_ip": "10.10.0.5", "src_port": 50000, "dst_ip": "198.51.100.10", "dst_port": 443, "proto": "tcp", "orig_bytes": 120, "resp_bytes": 200, "conn_state": "SF"}


def hours(seed=4):
    """Three hours of traffic by time: noise, a flood and scan in one second, a slow scan, a beacon, an upload, names."""
    rnd = random.Random(seed)
    rows = [{**FLOW, "ts": 1000 + rnd.randrange(0, 10_800), "src_ip": f"10.1.0.{rnd.randrange(5)}", "dst_ip": f"203.0.113.{rnd.randrange(3)}", "orig_bytes": rnd.randrange(400)} for _ in range(150)]
    rows += [{**FLOW, "ts": 2000, "kind": "early_event", "src_ip": "10.60.0.5", "dst_ip": "203.0.113.9", "dst_port": 1000 + i, "tcp_flags": "S", "conn_state": "S0"} for i in range(20)]
    rows += [{**FLOW, "ts": 5000 + i, "kind": "early_event", "src_ip": "10.60.0.6", "dst_ip": f"203.0.113.{i}", "dst_port": 445, "tcp_flags": "S", "conn_state": "REJ"} for i in range(40)]
    rows += [{**FLOW, "ts": 3000 + 30 * i, "src_ip": "10.30.0.5", "dst_ip": "198.51.100.88", "orig_bytes": 100, "resp_bytes": 150} for i in range(60)]
    rows += [{**FLOW, "ts": 9000 + 20 * i, "src_ip": "10.60.0.6", "dst_ip": "198.51.100.200", "orig_bytes": 110_000, "resp_bytes": 1000} for i in range(12)]
    rows += [{**FLOW, "ts": 5100 + i, "kind": "dns", "src_ip": "10.60.0.6", "dst_ip": "8.8.8.8", "dst_port": 53, "proto": "udp", "query": f"a9f3k2m8q1z7x5v2n{i}.example.net"} for i in range(6)]
    rows += [{**FLOW, "ts": 5200, "src_ip": "10.60.0.6", "tls": True, "ja3": "unknown", "orig_bytes": 9000, "resp_bytes": 50, "suspicious_fingerprint": True}]
    return sorted(rows, key=lambda r: r["ts"])


def write(folder, name, rows, extra=()):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join([json.dumps(r) + "\n" for r in rows] + list(extra)))


def shown(rows):
    return sorted((r.threat_class, r.subtype, r.confidence, r.timestamp, r.src_ip, r.dst_ip) for r in rows)


def in_table(spark, path):
    body = F.from_json("record_json", "subtype string")
    return shown(store.read(spark, f"{path}/alerts").withColumn("subtype", body["subtype"]).collect())


def in_one_batch(spark, rows):
    """What one batch over the rows in this order raises."""
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "place long, line string")
    raw = lines.select("place", F.from_json("line", logs.RAW).alias("r")).select("place", "r.*")
    found = alerts.detect_all(logs.normalize(raw, F.lit("conn"), F.col("place")))
    out = found.select("threat_class", "subtype", "confidence", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "flow_id.src_ip", "flow_id.dst_ip")
    out = shown(out.collect())
    return out


def cached(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_many_batches_equal_one(spark, tmp_path, monkeypatch):
    rows, folder, path = hours(), tmp_path / "in", str(tmp_path / "out")
    want = in_one_batch(spark, rows)
    assert {w[1] for w in want} >= {"syn_flood", "vertical_scan", "horizontal_scan", "periodic_beacon", "sustained_outbound_anomaly", "dns_tunnel", "metadata_anomaly", "correlated_multi_signal"}
    cuts = [0, 90, 200, len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        late = [{**FLOW, "ts": 900 + n, "src_ip": "10.99.0.1"} for n in range(3)] if k == 2 else []
        write(folder, f"conn-{k}.log", rows[a:b] + late, ["{broken\n", "\n"] if k == 1 else [])
    write(folder, "conn-9.log", [], ["\n"])
    before = cached(spark)
    run = lambda: live.run_stream(logs.follow_event_logs(spark, str(folder), per_batch=1), path).awaitTermination()

    failing, real = [True], store.write_metrics

    def write_metrics(*args):
        if failing and args[2] == 1:
            failing.clear()
            raise RuntimeError("lost after the alerts were stored")
        real(*args)

    monkeypatch.setattr(store, "write_metrics", write_metrics)
    events = logs.follow_event_logs(spark, str(folder), per_batch=1)
    live.ingest_stream(events, path).awaitTermination()
    with pytest.raises(Exception, match="lost after the alerts were stored"):
        live.detect_stream(spark, path, per_batch=2).awaitTermination()
    live.detect_stream(spark, path, per_batch=2).awaitTermination()
    assert in_table(spark, path) == want
    stored = spark.read.parquet(f"{path}/events")
    assert stored.count() == len(rows) and stored.select("seq").distinct().count() == len(rows)
    in_order = [r.src_port + r.dst_port for r in stored.orderBy("ts_us", "seq").collect()]
    assert in_order == [r["src_port"] + r["dst_port"] for r in rows]
    assert sorted(r.src_ip for r in spark.read.parquet(f"{path}/late").collect()) == ["10.99.0.1"] * 3
    assert [r.corrupt.strip() for r in spark.read.parquet(f"{path}/quarantine").collect()] == ["{broken"]
    assert store.verify_segments(spark.read.parquet(f"{path}/alerts"), store.read_heads(spark, path)).first()[:2] == (True, len(want))
    assert sum(r.events_total for r in store.read_metrics(spark, f"{path}/metrics").collect()) == len(rows)
    assert len(list((tmp_path / "out" / "emitted").iterdir())) <= 2 and cached(spark) == before

    run()  # nothing new
    assert in_table(spark, path) == want
    more = [{**FLOW, "ts": 12_500 + n, "kind": "early_event", "src_ip": "10.60.0.7", "dst_ip": "203.0.113.9", "dst_port": n, "tcp_flags": "S", "conn_state": "S0"} for n in range(13)]
    write(folder, "conn-a.log", more)
    run()
    assert in_table(spark, path) == sorted([*want, ("recon_scan", "vertical_scan", 0.78, "1970-01-01T03:28:31.000000", "10.60.0.7", "203.0.113.9")])

    out = str(tmp_path / "feed")
    for _ in range(2):
        live.follow_feed(spark, path, out).awaitTermination()
    assert len(list((tmp_path / "feed" / "alerts").iterdir())) == 1
    (tmp_path / "out" / "alerts" / "batch=99").mkdir()
    spark.read.parquet(f"{path}/alerts").limit(1).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/alerts/batch=99")
    live.follow_feed(spark, path, out).awaitTermination()  # a file without a newer alert
    assert len(list((tmp_path / "feed" / "alerts").iterdir())) == 1


def test_sliding_windows_are_the_running_sums(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.randrange(40) * 500_000, "conn", f"a{rnd.randrange(2)}", f"b{rnd.randrange(4)}", rnd.randrange(5), rnd.choice(["tcp", "udp"]), rnd.randrange(100), rnd.randrange(100), rnd.choice(["S0", "SF"]), "S") for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, ts_us long, kind string, src_ip string, dst_ip string, dst_port int, proto string, orig_bytes long, resp_bytes long, conn_state string, tcp_flags string")
    for family in ("ddos", "c2", "recon"):
        frame = features.FRAMES[family]
        names = [*frame.sums, *frame.distinct, *([frame.entropy] if frame.entropy else []), *(["gap_n", "gap_sum", "gap_squares"] if frame.gaps else [])]
        want = {r.seq: [r.window_n, *[r[n] for n in names]] for r in frame.over(df, 5).collect()}
        sums = [F.expr(x).cast("long") for x in frame.sums.values()] + [F.lit(0).cast("long")] * (windows.SUMS - len(frame.sums))
        values = [F.expr(x).cast("string") for x in frame.distinct.values()] + [F.lit("")] * (windows.DISTINCT - len(frame.distinct))
        slim = df.select(F.concat_ws("|", *[F.expr(k) for k in frame.keys]), "ts_us", "seq", *[x.alias(f"v{n}") for n, x in enumerate(sums + values)]).collect()
        sliding = {}
        for key, *row in sorted(map(tuple, slim), key=lambda r: r[1:3]):
            window = sliding.setdefault(key, windows.Sliding(5_000_000))
            window.add(tuple(row))
            found = dict(zip([x.split()[0] for x in windows.FOUND.split(", ")], window.found()))
            got = [found["window_n"], *[found[f"s{n}"] for n in range(len(frame.sums))], *[found[f"d{n}"] for n in range(len(frame.distinct))]]
            got += [found["entropy"]] if frame.entropy else []
            got += [found["gap_n"], found["gap_sum"], int(found["gap_squares"])] if frame.gaps else []
            assert [float(x) for x in got] == pytest.approx([float(x) for x in want[row[1]]], abs=1e-9)


def test_bus_values_keep_their_offsets(spark):
    good = {**FLOW, "ts_us": 5, "seq": 9}
    rows = [("t", p, o, json.dumps(good | {"dst_port": 10 * p + o})) for p in (1, 0) for o in (7, 3, 5)] + [("t", 0, 8, "{nonsense"), ("t", 0, 9, None)]
    bus = spark.createDataFrame(rows, "topic string, partition int, offset long, value string").withColumn("timestamp", F.timestamp_micros(F.col("partition") * 1000))
    read = logs.numbered(logs.consume(bus), 2)
    events = read.where("corrupt is null").orderBy("seq").collect()
    assert [r.dst_port for r in events] == [3, 5, 7, 13, 15, 17] and [r.seq - (2 << 40) for r in events] == [0, 2, 4, 7, 9, 11]
    assert sorted(r.corrupt for r in read.where("corrupt is not null").collect()) == ["", "{nonsense"]
    assert logs.consume(logs.publish(read.where("corrupt is null").drop("position", "corrupt"))).count() == 6


def test_segments(spark, tmp_path):
    n = 57
    rows = spark.range(n).select(F.col("id").alias("ts_us"), F.format_string("a%04d", "id").alias("alert_id"), F.format_string('{"k":%d}', "id").alias("record_json"))
    numbered = store.numbered(rows.repartition(4), str(tmp_path / "rows"))
    chained = store.chain_segments(numbered, each=10)
    chained.select("segment", "seq", "alert_id", "record_json", "prev_hash", "record_hash").write.parquet(str(tmp_path / "chained"))
    good = spark.read.parquet(str(tmp_path / "chained"))
    store.link_heads(store.segment_heads(good)).withColumn("batch", F.lit(0)).write.parquet(str(tmp_path / "heads"))
    heads = spark.read.parquet(str(tmp_path / "heads"))
    check = lambda rows, heads=heads: tuple(store.verify_segments(rows, heads).first())
    assert check(good)[:3] == (True, n, None) and heads.count() == 6
    one = store.GENESIS
    for k in range(10):
        one = hashlib.sha256((one + f'{{"k":{k}}}').encode()).hexdigest()
    assert heads.where("segment = 0").first()["head"] == one  # a segment is a chain
    swapped = F.when(F.col("seq") == 33, 35).when(F.col("seq") == 35, 33).otherwise(F.col("seq"))
    cases = {
        33: [good.withColumn("record_json", F.when(F.col("seq") == 33, "{}").otherwise(F.col("record_json"))), good.where("seq <> 33"), good.withColumn("seq", swapped), good.unionByName(good.where("seq = 33"))],
        1: [good.where("seq <> 1"), good.where("segment > 0")], 20: [good.where("seq <> 20")], 57: [good.where("seq < 57")], 51: [good.where("segment < 5")], 31: [good.where("segment <> 3")],
    }
    for at, broken in cases.items():
        for rows in broken:
            assert check(rows)[:3] == (False, at, at)
    assert check(good, heads.where("segment <> 2"))[2] == 21
    assert check(good, heads.withColumn("head", F.when(F.col("segment") == 4, "0").otherwise(F.col("head"))))[2] == 41
    assert check(good.where("false"), heads.where("false"))[:3] == (True, 0, None)
