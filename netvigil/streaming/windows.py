"""Window features of a stream: the rows of each key's window are keyed state.

``windowed`` gives for each event and feature set what ``features.Frame.over`` gives in a
batch, in flat columns; ``of_set`` names them again. A key's state is the rows of its
last window and of the time that rows may come late; each batch reads and writes the
state of its own keys only, and a timer drops the state of a key that falls silent. A row
that comes late finds the rows of its own window; rows that were given out before stay as
they were.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from netvigil.operators import features
from netvigil.operators.detectors import Config

#: Columns of an event that rules read, and what stands for a null in them.
CARRIED = {
    "seq": "long", "ts_us": "long", "kind": "string", "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int", "proto": "string", "orig_bytes": "long",
    "resp_bytes": "long", "conn_state": "string", "query": "string", "tls": "boolean", "ja3": "string", "sni": "string", "suspicious_fingerprint": "boolean",
}
_NULLS = {"long": 0, "int": 0, "string": "", "boolean": False}
SUMS = max(len(f.sums) for f in features.FRAMES.values())
DISTINCT = max(len(f.distinct) for f in features.FRAMES.values())
_VALUES = [f"s{n}" for n in range(SUMS)] + [f"d{n}" for n in range(DISTINCT)]
STATE = "ts_us long, seq long, " + ", ".join([f"s{n} long" for n in range(SUMS)] + [f"d{n} string" for n in range(DISTINCT)])
FOUND = (
    "window_n long, " + ", ".join([f"s{n} long" for n in range(SUMS)] + [f"d{n} long" for n in range(DISTINCT)])
    + ", entropy double, gap_n long, gap_sum long, gap_squares string, dst_hosts array<string>, anchor_dst string"
)
SCHEMA = "family string, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items()) + ", " + FOUND


def seconds_of(cfg: Config) -> dict[str, int]:
    return {"ddos": cfg.ddos_seconds, "c2": cfg.c2_seconds, "dns": cfg.dns_seconds, "tls": cfg.tls_seconds, "recon": cfg.recon_seconds, "exfil": cfg.exfil_seconds}


def _weight(c: int) -> int:
    return round(c * math.log2(c) * 1e9) if c > 1 else 0


class Sliding:
    """A window that moves over rows (ts_us, seq, sums, values) in order and knows what it holds."""

    def __init__(self, span: int, hosts: bool = False):
        self.span, self.hosts = span, hosts
        self.rows: deque = deque()
        self.sums, self.seen = [0] * SUMS, [Counter() for _ in range(DISTINCT)]
        self.entropy = self.squares = 0
        self.failed: Counter = Counter()

    def _count(self, row: tuple, step: int) -> None:
        for n in range(SUMS):
            self.sums[n] += step * row[2 + n]
        for n, seen in enumerate(self.seen):
            value = row[2 + SUMS + n]
            before = seen[value]
            if n == 0:
                self.entropy += _weight(before + step) - _weight(before)
            if before + step:
                seen[value] = before + step
            else:
                del seen[value]
        if self.hosts and row[2]:
            self.failed[row[2 + SUMS]] += step

    def add(self, row: tuple) -> None:
        while self.rows and self.rows[0][0] < row[0] - self.span:
            gone = self.rows.popleft()
            self._count(gone, -1)
            if self.rows:
                self.squares -= (self.rows[0][0] - gone[0]) ** 2
        if self.rows:
            self.squares += (row[0] - self.rows[-1][0]) ** 2
        self.rows.append(row)
        self._count(row, 1)

    def found(self) -> list:
        n = len(self.rows)
        entropy = max(0.0, math.log2(n) - self.entropy / 1e9 / n)
        return [n, *self.sums, *[len(s) for s in self.seen], entropy, n - 1, self.rows[-1][0] - self.rows[0][0], str(self.squares)]

    def targets(self, hosts: int = 64) -> tuple[list[str], str]:
        """The first hosts in order, and the one that failed most."""
        attempts = self.seen[0]
        return sorted(attempts)[:hosts], min(attempts, key=lambda h: (-self.failed[h] / attempts[h], -self.failed[h], h))


class WindowState(StatefulProcessor):
    """Windows of one key of one feature set."""

    def __init__(self, cfg: Config, delay_s: int):
        self.cfg, self.delay, self.spans = cfg, delay_s * 1_000_000, {k: v * 1_000_000 for k, v in seconds_of(cfg).items()}

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getListState("rows", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        family = key[0]
        span = self.spans[family]
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"], ignore_index=True)
        own = list(new[["ts_us", "seq", *_VALUES]].itertuples(index=False, name=None))
        known = [tuple(r) for r in self.kept.get()]
        merged = sorted([(*r, None) for r in known] + [(*r, n) for n, r in enumerate(own)], key=lambda r: (r[0], r[1]))
        window, out = Sliding(span, family == "recon"), [None] * len(own)
        for *row, at in merged:
            window.add(tuple(row))
            if at is not None:
                out[at] = [*window.found(), *self._lists(family, window)]
        newest = merged[-1][0]
        self.kept.put([tuple(r[:-1]) for r in merged if r[0] >= newest - span - self.delay])
        self.handle.registerTimer((newest + span + self.delay) // 1000 + 1)
        found = pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])
        yield pd.concat([new[["family", *CARRIED]], found], axis=1)

    def _lists(self, family: str, window: Sliding) -> tuple:
        if family != "recon":
            return None, None
        n, cfg = len(window.rows), self.cfg
        wide = max(len(s) for s in window.seen[:2]) >= cfg.recon_fanout
        return window.targets() if wide and round(window.sums[0] / n * 100) / 100 >= cfg.recon_failures else (None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Each batch of a key sets a timer; only the one behind its newest row finds nothing that a later window needs.
        newest = max((r[0] for r in self.kept.get()), default=None)
        if newest is not None and (newest + self.spans[key[0]] + self.delay) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        return iter(())


def windowed(events: DataFrame, cfg: Config = Config(), delay_s: int = 60) -> DataFrame:
    """What the windows of each event hold, for each set that the event belongs to: rows of ``SCHEMA``.

    delay_s: how far behind the newest event a row may come; later ones must not be in
    events, or they are dropped (see ``live.ingest_stream``, which sets them aside).
    """
    have = set(events.columns)
    carried = [F.coalesce(F.col(c) if c in have else F.lit(None), F.lit(_NULLS[t])).cast(t).alias(c) for c, t in CARRIED.items()]
    parts = []
    for family, frame in features.FRAMES.items():
        sums, values = list(frame.sums.values()), list(frame.distinct.values())
        part = [F.lit(family).alias("family"), F.to_json(F.array(*[F.coalesce(F.expr(k).cast("string"), F.lit("")) for k in frame.keys])).alias("key")]
        part += [(F.coalesce(F.expr(sums[n]), F.lit(0)) if n < len(sums) else F.lit(0)).cast("long").alias(f"s{n}") for n in range(SUMS)]
        part += [F.coalesce((F.expr(values[n]) if n < len(values) else F.lit("")).cast("string"), F.lit("")).alias(f"d{n}") for n in range(DISTINCT)]
        parts.append(F.when(F.expr(frame.rows), F.struct(*part)))
    dealt = events.withColumn("_part", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())))
    rows = dealt.select("_part.*", *carried, F.timestamp_micros("ts_us").alias("at")).withWatermark("at", f"{delay_s + 1} seconds")
    return rows.groupBy("family", "key").transformWithStateInPandas(WindowState(cfg, delay_s), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def of_set(found: DataFrame, family: str, cfg: Config = Config()) -> DataFrame:
    """The features of one set, from rows of ``windowed``."""
    frame = features.FRAMES[family]
    rows = found.where(F.col("family") == family)
    names = {f"s{n}": k for n, k in enumerate(frame.sums)} | {f"d{n}": k for n, k in enumerate(frame.distinct)}
    more = [F.col(a).alias(b) for a, b in names.items()]
    if frame.entropy:
        more.append(F.col("entropy").alias(frame.entropy))
    if frame.gaps:
        more += ["gap_n", "gap_sum", F.col("gap_squares").cast("decimal(38,0)").alias("gap_squares")]
    lists = ["dst_hosts", "anchor_dst"] if family == "recon" else []
    return features.DERIVED[family](rows.select(*CARRIED, "window_n", *more, *lists), seconds_of(cfg)[family])
