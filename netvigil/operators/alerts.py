"""Alerts: identity, contract, repeats, correlation, and the whole detection pipeline.

Repeats and correlation depend on what was decided before for the same key, so each
runs over rows sorted within their key, one row after the other, with a few values of
state for a key: no key's rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions import fixed
from netvigil.functions.scratch import stored
from netvigil.operators.detectors import Config, candidates
from netvigil.operators.reputation import Owners

REFRACTORY = {"c2_beaconing": 300}
CONTEXT, DISTINCT, COOLDOWN = 8, 3, 3600


def with_ids(found: DataFrame) -> DataFrame:
    """Candidates with an id that a second run gives again, and the event time as timestamp."""
    key = F.concat_ws("|", "threat_class", "subtype", "aggregation_key", "ts_us", "seq")
    return found.withColumns({"alert_id": F.sha2(key, 256), "timestamp": F.timestamp_micros("ts_us")})


def validate(alerts: DataFrame, strict: bool = False) -> DataFrame:
    """alerts with ``rejected``: the first rule of the contract that a row breaks, or null; strict ones fail instead."""
    needed = ["alert_id", "timestamp", "flow_id", "threat_class", "subtype", "confidence", "severity", "supporting_evidence", "mitre_attack", "model_version"]
    flow = ["src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    checks: list[tuple[str, Column]] = [
        ("missing field", reduce(or_, [F.col(n).isNull() for n in needed])),
        ("flow", reduce(or_, [F.col(f"flow_id.{n}").isNull() for n in flow])),
        ("threat class", ~F.coalesce(F.col("threat_class").isin(fixed.THREATS), F.lit(False))),
        ("severity", ~F.coalesce(F.col("severity").isin(fixed.SEVERITIES), F.lit(False))),
        ("confidence", ~F.coalesce(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"), F.lit(False))),
    ]
    broken = F.coalesce(*[F.when(fails, F.lit(name)) for name, fails in checks])
    if strict:
        broken = F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("invalid alert: "), broken)).cast("string"))
    return alerts.withColumn("rejected", broken)


def _key() -> Column:
    return F.concat_ws("|", "threat_class", "subtype", "aggregation_key")


def refractory(found: DataFrame, windows: dict[str, int] | None = None, otherwise: int = 30, last: DataFrame | None = None) -> DataFrame:
    """Drops what repeats an emitted alert of its key within the key's window; dropped rows don't extend it.

    last: (key, ts_us) of what earlier runs emitted, see ``last_emitted``. A row older than
    that, which comes late, repeats it.
    """
    windows = REFRACTORY if windows is None else windows
    seconds = F.lit(otherwise)
    for name, length in windows.items():
        seconds = F.when(F.col("threat_class") == name, length).otherwise(seconds)
    keyed = found.withColumns({"_key": _key(), "_span": (seconds * 1_000_000).cast("long")})
    slim = keyed.select("_key", "_span", "ts_us", "seq", "detector_rank", F.lit(1).alias("_new"))
    if last is not None:
        slim = slim.unionByName(last.select(F.col("key").alias("_key"), F.lit(0).cast("long").alias("_span"), "ts_us", F.lit(-1).cast("long").alias("seq"), F.lit(-1).alias("detector_rank"), F.lit(0).alias("_new")))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before = None, 0
        for frame in frames:
            keep = []
            for k, span, ts, new in zip(frame["_key"], frame["_span"], frame["ts_us"], frame["_new"], strict=True):
                fresh = k != key or not new or ts - before >= span
                if fresh:
                    key, before = k, ts
                keep.append(fresh and bool(new))
            yield frame[keep][["_key", "ts_us", "seq", "detector_rank"]]

    ordered = slim.repartition("_key").sortWithinPartitions("_key", "_new", "ts_us", "seq", "detector_rank")
    kept = ordered.mapInPandas(emit, "_key string, ts_us long, seq long, detector_rank int")
    return keyed.join(kept, ["_key", "ts_us", "seq", "detector_rank"], "left_semi").drop("_key", "_span")


def last_emitted(fresh: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, ts_us): the newest alert of each key, with those of earlier runs."""
    own = fresh.select(_key().alias("key"), "ts_us")
    return (own if before is None else own.unionByName(before)).groupBy("key").agg(F.max("ts_us").alias("ts_us"))


STATE = "src_ip string, ids array<string>, threats array<string>, confidences array<double>, last long"


def _linked(alerts: DataFrame, context: int, distinct: int, cooldown: int, before: DataFrame | None) -> DataFrame:
    """Rows of correlated alerts (kind 1) and the state of each source after its last alert (kind 2)."""
    names = ["src_ip", "ts_us", "seq", "detector_rank", "alert_id", "threat_class", "confidence", "ids", "threats", "confidences", "last"]
    types = dict(x.split(" ", 1) for x in STATE.split(", "))
    slim = alerts.select(F.col("flow_id.src_ip").alias("src_ip"), "ts_us", "seq", "detector_rank", "alert_id", "threat_class", "confidence", *[F.lit(None).cast(types[n]).alias(n) for n in names[7:]], F.lit(1).alias("_new"))
    if before is not None:  # only sources with new alerts need their state
        known = before.join(alerts.select(F.col("flow_id.src_ip").alias("src_ip")).distinct(), "src_ip", "left_semi")
        slim = slim.unionByName(known.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    schema = "kind int, ts_us long, seq long, detector_rank int, confidence double, underlying_alert_ids array<string>, classes array<string>, " + STATE

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, recent, last, any_yet = None, [], None, False
        columns = [x.split()[0] for x in schema.split(", ")]

        def state() -> tuple:
            return (2, None, None, None, None, None, None, source, [i for i, _, _ in recent], [c for _, c, _ in recent], [x for _, _, x in recent], last)

        for frame in frames:
            out = []
            for src, ts, seq, rank, alert_id, threat, confidence, ids, threats, confidences, until, new in frame[[*names, "_new"]].itertuples(index=False):
                if not any_yet or src != source:
                    if any_yet:
                        out.append(state())
                    source, recent, last, any_yet = src, [], None, True
                if not new:
                    recent, last = list(zip(ids, threats, confidences, strict=True)), None if pd.isna(until) else int(until)
                    continue
                ts, seq, rank = int(ts), int(seq), int(rank)
                recent = [*recent, (alert_id, threat, confidence)][-context:]
                classes = sorted({c for _, c, _ in recent})
                if len(classes) >= distinct and (last is None or ts - last >= cooldown * 1_000_000):
                    last, best = ts, round(min(0.9, max(c for _, _, c in recent)), 3)
                    out.append((1, ts, seq, rank, best, [i for i, _, _ in recent], classes, src, None, None, None, None))
                    recent = [*recent, (f"correlated|{src}|{ts}|{seq}", "c2_beaconing", best)][-context:]
            yield _framed(out, columns)
        if any_yet:
            yield _framed([state()], columns)

    return slim.repartition("src_ip").sortWithinPartitions("src_ip", "_new", "ts_us", "seq", "detector_rank").mapInPandas(link, schema)


def _framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({"ts_us": "Int64", "seq": "Int64", "detector_rank": "Int32", "last": "Int64", "confidence": "Float64"})


def correlation_state(alerts: DataFrame, before: DataFrame | None = None, context: int = CONTEXT, distinct: int = DISTINCT, cooldown: int = COOLDOWN) -> DataFrame:
    """The state (``STATE``) that correlation of later alerts starts from: the latest alerts of each source, and when it was last correlated."""
    names = [x.split()[0] for x in STATE.split(", ")]
    own = _linked(alerts, context, distinct, cooldown, before).where("kind = 2").select(*names)
    return own if before is None else own.unionByName(before.join(own.select("src_ip"), "src_ip", "left_anti"))


def correlate(alerts: DataFrame, context: int = CONTEXT, distinct: int = DISTINCT, cooldown: int = COOLDOWN, before: DataFrame | None = None) -> DataFrame:
    """One alert for a source whose latest alerts are of several classes, then none for a while.

    The result has the same columns as its input plus underlying_alert_ids and classes.
    before: the state that earlier runs left, see ``correlation_state``.
    """
    linked = _linked(alerts, context, distinct, cooldown, before).where("kind = 1").select("src_ip", "ts_us", "seq", "detector_rank", "confidence", "underlying_alert_ids", "classes")
    flows = alerts.select(F.col("flow_id.src_ip").alias("_src"), F.col("ts_us").alias("_ts"), F.col("seq").alias("_seq"), F.col("detector_rank").alias("_rank"), "flow_id")
    joined = linked.join(flows, (F.col("src_ip") == F.col("_src")) & (F.col("ts_us") == F.col("_ts")) & (F.col("seq") == F.col("_seq")) & (F.col("detector_rank") == F.col("_rank")))
    from netvigil.functions.scalars import severity_of

    values = {
        "threat_class": F.lit("c2_beaconing"), "subtype": F.lit("correlated_multi_signal"), "severity": severity_of(F.col("confidence")),
        "mitre_attack": F.array(F.lit("T1071.001")), "model_version": F.lit("correlation-v1"), "aggregation_key": F.concat(F.lit("src="), "src_ip"),
        "detector_rank": F.lit(6),
    }
    out = with_ids(joined.withColumns(values))
    same = {f.name: f.dataType for f in alerts.schema.fields}
    have = set(out.columns)
    filled = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in same.items()]
    return out.select(*filled, "underlying_alert_ids", "classes")


def detect_all(events: DataFrame, cfg: Config = Config(), asn: DataFrame | Owners | None = None, dga_scores: DataFrame | None = None) -> DataFrame:
    """Normalized events to fresh and correlated alerts."""
    return with_correlated(stored(fresh_alerts(events, cfg, asn, dga_scores), "fresh"))


def fresh_alerts(events: DataFrame, cfg: Config = Config(), asn: DataFrame | Owners | None = None, dga_scores: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """Alerts of the events, repeats dropped; last: what earlier runs emitted, see ``refractory``.

    Candidates are read by the filter and by its join, so they are written once in between.
    """
    found = candidates(events, cfg, asn, dga_scores, thin=lambda rows: refractory(stored(rows, "scans"), last=last))
    return with_ids(refractory(stored(found, "candidates"), last=last))


def with_correlated(fresh: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Fresh alerts and those that correlation adds."""
    none = F.lit(None).cast(T.ArrayType(T.StringType()))
    return fresh.withColumns({"underlying_alert_ids": none, "classes": none}).unionByName(correlate(fresh, before=before))
