"""The six windowed feature sets: one row out for each row in.

What a set sums and counts is stated once, as SQL over events, so that a batch (running
sums over sorted rows) and a stream (state of each key) keep the same things; what is
derived from them is the same code for both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions import scalars as S
from netvigil.operators.windows import BUCKET_WINDOWS, trailing

CONNECTIONS = "kind IN ('conn', 'early_event')"
PARENT = "CASE WHEN instr(query, '.') > 0 THEN substring(query, instr(query, '.') + 1) ELSE query END"


@dataclass(frozen=True)
class Frame:
    """Which events a set is about, what keys them, and what is kept of a window."""

    rows: str
    keys: tuple[str, ...]
    sums: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    entropy: str | None = None  # the name; the values are those of the first distinct one
    gaps: bool = False

    def over(self, events: DataFrame, seconds: int) -> DataFrame:
        """events, all of which the set is about, with what their windows hold."""
        values = {k: F.expr(v) for k, v in self.distinct.items()}
        return trailing(
            events, [F.expr(k) for k in self.keys], seconds, sums={k: F.expr(v) for k, v in self.sums.items()}, distinct=values,
            entropy={self.entropy: next(iter(values.values()))} if self.entropy else None, gaps=self.gaps,
        )


FRAMES = {
    "ddos": Frame(
        CONNECTIONS, ("dst_ip",),
        {
            "syn_count": "int(coalesce(tcp_flags = 'S', false))", "udp_count": "int(coalesce(proto = 'udp', false))",
            "completed": "int(coalesce(conn_state = 'SF', false))", "inbound_bytes": "orig_bytes", "outbound_bytes": "resp_bytes",
        },
        {"unique_sources": "src_ip"}, entropy="source_ip_entropy",
    ),
    "c2": Frame(CONNECTIONS, ("src_ip", "dst_ip"), {"outbound_bytes": "orig_bytes", "inbound_bytes": "resp_bytes"}, {"destination_port_count": "dst_port"}, gaps=True),
    "dns": Frame("kind = 'dns'", ("src_ip", PARENT), {}, {"unique_subdomains": "query"}),
    "tls": Frame("coalesce(tls, false)", ("src_ip",)),
    "recon": Frame(CONNECTIONS, ("src_ip",), {"failed": "int(coalesce(conn_state IN ('S0', 'REJ'), false))"}, {"unique_dst_hosts": "dst_ip", "unique_dst_ports": "dst_port"}),
    "exfil": Frame(CONNECTIONS, ("src_ip", "dst_ip"), {"outbound_bytes": "orig_bytes", "inbound_bytes": "resp_bytes"}),
}


def ddos_derived(out: DataFrame, seconds: int) -> DataFrame:
    n = F.col("window_n")
    ratio = S.rounded(F.col("completed") / F.greatest(F.lit(1), n), 3)
    more = {"packet_rate": n / seconds, "completion_ratio": ratio, "source_ip_entropy": S.rounded("source_ip_entropy", 3), "dst_concentration": F.col("dst_ip")}
    return out.withColumns(more).drop("completed", "window_n")


def c2_derived(out: DataFrame, seconds: int) -> DataFrame:
    m, g = F.col("gap_n"), F.col("gap_sum")
    spread = (m.cast("decimal(10,0)") * F.col("gap_squares").cast("decimal(28,0)") - g.cast("decimal(19,0)") * g.cast("decimal(19,0)")).cast("double")
    cv = F.when((m >= 2) & (g > 0), S.rounded(F.sqrt(spread) / g, 3)).otherwise(F.lit(1.0))
    n = F.col("window_n")
    return out.withColumns({
        "session_count": n, "iat_mean": F.when(m > 0, S.rounded(g / m / 1e6, 3)).otherwise(F.lit(0.0)), "iat_cv": cv,
        "persistence_seconds": S.rounded(g / 1e6, 3),
        "outbound_inbound_ratio": S.rounded(F.col("outbound_bytes") / F.greatest(F.lit(1), F.col("inbound_bytes")), 2),
        "mean_outbound_bytes": S.rounded(F.col("outbound_bytes") / n, 1), "mean_inbound_bytes": S.rounded(F.col("inbound_bytes") / n, 1),
    }).drop("window_n", "gap_n", "gap_sum", "gap_squares")


def dns_derived(out: DataFrame, seconds: int) -> DataFrame:
    label = S.first_label(F.col("query"))
    return out.withColumns({"label_length": F.length(label), "label_entropy": S.rounded(S.string_entropy(label), 3), "query_rate": F.col("window_n") / seconds}).drop("window_n")


def tls_derived(out: DataFrame, seconds: int) -> DataFrame:
    ratio = S.rounded(F.col("orig_bytes") / F.greatest(F.lit(1), F.col("resp_bytes")), 2)
    return out.withColumns({"outbound_inbound_ratio": ratio, "host_sessions": F.col("window_n")}).drop("window_n")


def recon_derived(out: DataFrame, seconds: int) -> DataFrame:
    return out.withColumns({"scan_rate": F.col("window_n") / seconds, "failure_ratio": S.rounded(F.col("failed") / F.col("window_n"), 2)}).drop("failed", "window_n")


def exfil_derived(out: DataFrame, seconds: int) -> DataFrame:
    ratio = S.rounded(F.col("outbound_bytes") / F.greatest(F.lit(1), F.col("inbound_bytes")), 2)
    return out.withColumns({"outbound_inbound_ratio": ratio, "session_count": F.col("window_n")}).drop("window_n")


DERIVED: dict[str, Callable[[DataFrame, int], DataFrame]] = {"ddos": ddos_derived, "c2": c2_derived, "dns": dns_derived, "tls": tls_derived, "recon": recon_derived, "exfil": exfil_derived}


def ddos_features(events: DataFrame, seconds: int = 5) -> DataFrame:
    """By destination: rates, handshakes and the spread of sources."""
    return ddos_derived(FRAMES["ddos"].over(events, seconds), seconds)


def c2_features(events: DataFrame, seconds: int = 300) -> DataFrame:
    """By pair: the regularity, size and length of an exchange."""
    return c2_derived(FRAMES["c2"].over(events, seconds), seconds)


def dns_features(events: DataFrame, seconds: int = 60) -> DataFrame:
    """By source and parent domain: the name itself, and the rate and variety of names."""
    return dns_derived(FRAMES["dns"].over(events, seconds), seconds)


def tls_features(events: DataFrame, seconds: int = 30) -> DataFrame:
    """By source, over encrypted sessions only."""
    return tls_derived(FRAMES["tls"].over(events.where(FRAMES["tls"].rows), seconds), seconds)


def recon_features(events: DataFrame, seconds: int = 30) -> DataFrame:
    """By source: fan-out over hosts and ports, and failures. Lists come from recon_targets."""
    return recon_derived(FRAMES["recon"].over(events, seconds), seconds)


def exfil_features(events: DataFrame, seconds: int = 300) -> DataFrame:
    """By pair: volume, ratio and sessions."""
    return exfil_derived(FRAMES["exfil"].over(events, seconds), seconds)


_TARGETS = "dst_hosts array<string>, scan_targets array<struct<rank: int, dst_ip: string, failed: bigint, attempts: bigint, failure_ratio: double>>, anchor_dst string, spread double"


def _lists(batches: Iterator[pa.RecordBatch], hosts: int, targets: int) -> Iterator[pa.RecordBatch]:
    """The marked rows with the lists of their windows; counts of one source's hosts at a time, which rows raise and lower in order."""
    key, counts = None, {}
    for batch in batches:
        marked, ends, names, ranks, ranked, anchors, shares = [], [0], [], [0], [], [], []
        steps = zip(*(batch.column(n).to_pylist() for n in ("src_ip", "bucket", "dst_ip", "failed", "provider", "step")), strict=True)
        for at, (src, bucket, dst, failed, provider, step) in enumerate(steps):
            if (src, bucket) != key:
                key, counts = (src, bucket), {}
            if step:
                own = counts.get(dst)
                if own is None:
                    counts[dst] = [step, failed, provider]
                elif own[0] + step:
                    own[0] += step
                    own[1] += failed
                else:
                    del counts[dst]
            elif counts:
                found = sorted(counts, key=lambda h: (h is None, h or ""))[:hosts] if None in counts else sorted(counts)[:hosts]
                places = [(-f / n, -f, h is not None, h) for h, (n, f, _) in counts.items()]
                marked.append(at)
                names += found
                ends.append(len(names))
                anchors.append(min(places)[3])
                shares.append(sum(counts[h][2] for h in found) / len(found))
                if targets:
                    ranked += [(k, h, -f, counts[h][0], round(-f / counts[h][0] * 100.0) / 100.0) for k, (_, f, _, h) in enumerate(sorted(places)[:targets], 1)]
                ranks.append(len(ranked))
        fields = zip(*ranked, strict=True) if ranked else [[]] * 5
        kinds = {"rank": pa.int32(), "dst_ip": pa.string(), "failed": pa.int64(), "attempts": pa.int64(), "failure_ratio": pa.float64()}
        scans = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(fields, kinds.values(), strict=True)], list(kinds))
        lists = [pa.ListArray.from_arrays(pa.array(n, pa.int32()), x) for n, x in ((ends, pa.array(names, pa.string())), (ranks, scans))]
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(marked, pa.int64())), *lists, pa.array(anchors, pa.string()), pa.array(shares, pa.float64())], ["row", "dst_hosts", "scan_targets", "anchor_dst", "spread"])


def recon_targets(gated: DataFrame, events: DataFrame, seconds: int = 30, hosts: int = 64, targets: int = 8) -> DataFrame:
    """gated rows (behind a detector's gate) with dst_hosts, scan_targets and anchor_dst of their windows.

    ``spread`` is the share of dst_hosts whose events have a true column ``provider``,
    0 if events have none. Sources are cut into overlapping time buckets, as in
    ``trailing``; in each bucket's order of time, events come, leave a window later, and
    gated rows read the counts that hold at their place. A task holds the hosts of one
    window, not its events, and the work is that of events and of gated rows times hosts.
    """
    span = seconds * 1_000_000
    size = BUCKET_WINDOWS * span
    own = F.floor(F.col("ts_us") / size).cast("long")
    failed = F.coalesce(F.col("conn_state").isin("S0", "REJ"), F.lit(False)).cast("long")
    provider = F.coalesce("provider", F.lit(False)) if "provider" in events.columns else F.lit(False)
    reach = F.explode(F.when(F.col("ts_us") >= (own + 1) * size - span, F.array(own, own + 1)).otherwise(F.array(own))).alias("bucket")
    seen = events.where("src_ip is not null").select("src_ip", "dst_ip", F.col("ts_us").alias("t"), F.col("seq").alias("s"), failed.alias("failed"), provider.alias("provider"), reach)
    turn = lambda t, phase, step: F.struct(t.alias("t"), F.lit(phase).alias("phase"), F.lit(step).alias("step"))
    turns = seen.withColumn("turn", F.explode(F.array(turn(F.col("t"), 1, 1), turn(F.col("t") + span, 2, -1)))).where(F.col("turn.t") < (F.col("bucket") + 1) * size)
    whole = F.struct(*[F.col(f"`{c}`") for c in gated.columns])
    moves = turns.select("src_ip", "bucket", "turn.t", "turn.phase", "s", "turn.step", "dst_ip", (F.col("failed") * F.col("turn.step")).alias("failed"), "provider", F.lit(None).cast(gated.schema).alias("row"))
    marks = gated.where("src_ip is not null").select(
        "src_ip", own.alias("bucket"), F.col("ts_us").alias("t"), F.lit(1).alias("phase"), F.col("seq").alias("s"), F.lit(0).alias("step"),
        F.lit(None).cast("string").alias("dst_ip"), F.lit(0).cast("long").alias("failed"), F.lit(False).alias("provider"), whole.alias("row"),
    )
    # Of rows at one place events come first, so that a gated row counts itself.
    placed = moves.unionByName(marks).repartition("src_ip", "bucket").sortWithinPartitions("src_ip", "bucket", "t", "phase", "s", F.desc("step"))
    rows = placed.mapInArrow(partial(_lists, hosts=hosts, targets=targets), T.StructType([T.StructField("row", gated.schema), *T.StructType.fromDDL(_TARGETS).fields]))
    return rows.select("row.*", "dst_hosts", "scan_targets", "anchor_dst", "spread")
