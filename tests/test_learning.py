"""Models: vocabulary split, evaluation, a saved and gated forest, and its say in detection; latency sketches."""

import random

from pyspark.sql import functions as F

from netvigil.operators import detectors, learning, store


def test_halves_have_no_word_in_common(spark):
    rnd = random.Random(6)
    words = ["mail", "news", "shop", "cdn", "img", "api", "blog", "wiki", "auth", "login"]
    labels = [("-".join(rnd.sample(words, rnd.randint(1, 2))) + str(rnd.randrange(9)), 0) for _ in range(300)] + [("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=16)), 1) for _ in range(300)] + [("a1", 0), ("", 0), ("Ab", 1)]
    rows = learning.split_by_vocabulary(spark.createDataFrame(labels, "label string, dga int"))
    assert rows.count() == len(labels)
    stems = {p: {r[0] for r in rows.where(F.col("part") == p).select(F.explode(learning.stems(F.col("label")))).collect()} for p in ("train", "test")}
    assert stems["train"] and stems["test"] and not stems["train"] & stems["test"]
    parts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    assert parts["between"] > 0 and parts["test"] > 50 and parts["train"] > 50

    model = learning.dga_train(rows.where("part = 'train'").select("label", "dga"))
    test = rows.where("part = 'test'").select("label", "dga").distinct()
    scored = test.join(learning.dga_score(model, test), "label").collect()
    got = learning.dga_eval(spark.createDataFrame(scored)).first()
    hits = [(r.dga_char_ngram_score >= 0.8, r.dga == 1) for r in scored]
    tp, fp, fn = hits.count((True, True)), hits.count((True, False)), hits.count((False, True))
    assert (got.tp, got.fp, got.fn, got.tn) == (tp, fp, fn, hits.count((False, False)))
    assert got.recall == round(tp / (tp + fn), 4) and got.f1 == round(2 * tp / (2 * tp + fp + fn), 4)


def test_saved_forest_is_gated_and_heard(spark, tmp_path):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.randrange(1000, 9000), rnd.random() * 3) for _ in range(500)] + [(900_000_000, 900.0)], "outbound_bytes long, outbound_inbound_ratio double")
    model = learning.IsolationForest(trees=10).fit(rows)
    model.limit = 0.4
    path = str(tmp_path / "forest")
    model.save(path)
    manifest = learning.manifest_of(spark, {"exfil": path})
    loaded = learning.load_gated(spark, path, "exfil", manifest, learning.IsolationForestModel.load)
    scores = lambda m: [r.exfil_anomaly_score for r in m.transform(rows).orderBy("outbound_bytes", "outbound_inbound_ratio").collect()]
    assert scores(loaded) == scores(model) and loaded.limit == 0.4
    assert learning.load_gated(spark, path, "exfil", manifest | {"exfil": "0"}, learning.IsolationForestModel.load) is None

    columns = "seq long, ts_us long, kind string, src_ip string, src_port int, dst_ip string, dst_port int, proto string, orig_bytes long, resp_bytes long"
    flows = spark.createDataFrame([(i, i * 1_000_000, "conn", "10.0.0.1", 1, "198.51.100.200", 443, "tcp", 200_000, 8000) for i in range(5)], columns)
    plain = detectors.detect_exfil(flows).orderBy("seq").collect()
    heard = detectors.detect_exfil(flows, anomaly=loaded.transform).orderBy("seq").collect()
    assert [r.model_version for r in plain] == ["exfil-rules-v3"] * 3 and [r.model_version for r in heard] == ["exfil-baseline-ml-v1"] * 3
    for a, b in zip(plain, heard):
        e = b.supporting_evidence
        assert e.exfil_anomaly_score is not None and b.confidence == (round(min(0.99, a.confidence + 0.03), 3) if e.exfil_anomaly_flag else a.confidence)
    assert any(r.supporting_evidence.exfil_anomaly_flag for r in heard)


def test_sketches_of_batches_merge(spark):
    rnd = random.Random(2)
    values = [(k % 23, rnd.lognormvariate(3, 1), k % 2) for k in range(20_000)]
    kept = store.latency_sketches(spark.createDataFrame(values, "batch int, latency_ms double, alerts int"), "batch")
    for some in (range(23), range(5, 9)):
        own = sorted(v for b, v, _ in values if b in some)
        got = store.quantiles_over(kept.where(F.col("batch").isin(list(some)))).first()
        assert (got.events_total, got.alerts_total) == (len(own), sum(a for b, _, a in values if b in some))
        for q in (0.5, 0.95, 0.99):
            low, high = sum(v < got[f"p{round(q * 100)}_ms"] for v in own), sum(v <= got[f"p{round(q * 100)}_ms"] for v in own)
            assert low / len(own) <= q + 0.005 and high / len(own) >= q - 0.005
