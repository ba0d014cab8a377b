"""Who owns an address: prefix tables, range lookup and reputation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import fixed
from netvigil.functions import scalars as S

SCHEMA = "start long, end long, asn string, asn_name string"
#: Up to so many (range, /16) rows a prefix table is broadcast.
BROADCAST_ROWS = 500_000


def empty_asn_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def load_asn_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file {prefixes: [[start, end, asn]], asn_to_name: {}}; empty where there is none."""
    try:
        raw = spark.read.schema("prefixes array<array<string>>, asn_to_name map<string,string>").json(path, multiLine=True)
    except Exception as error:  # a missing table must not make a detector quieter
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty_asn_table(spark)
    rows = raw.select(F.explode("prefixes").alias("p"), "asn_to_name")
    return rows.select(F.col("p")[0].cast("long").alias("start"), F.col("p")[1].cast("long").alias("end"), F.col("p")[2].alias("asn"), F.try_element_at("asn_to_name", F.col("p")[2]).alias("asn_name"))


def curate(dump: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges of curated networks, curated networks that the dump lacks), from (start, end, asn) rows."""
    rows = dump.where(F.col("asn").cast("string") != "0").withColumn("asn", F.concat(F.lit("AS"), F.col("asn").cast("string")))
    number = F.substring("asn", 3, 20).cast("long")
    return rows.join(curated, "asn", "left_semi").orderBy(number, "start"), curated.join(rows, "asn", "left_anti").orderBy(number)


@dataclass(frozen=True)
class Owners:
    """A prefix table made ready once: disjoint ranges, dealt by the first bits of an address; without ranges it is unavailable."""

    ranges: DataFrame | None
    bits: int = 16


def _innermost(rows: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one /16 as disjoint ones: an address belongs to its narrowest range, then the one that begins first."""
    base = int(rows["net"].iloc[0]) << 16
    low, high = (rows["start"].clip(base, base + 65535) - base).to_numpy(), (rows["end"].clip(base, base + 65535) - base).to_numpy()
    order = np.lexsort((rows["asn"], -rows["start"], -(rows["end"] - rows["start"])))  # the widest first, painted over by the others
    owner = np.full(65536, -1, np.int64)
    for k in order:
        owner[low[k] : high[k] + 1] = k
    first = np.flatnonzero(np.diff(owner, prepend=-2))
    last = np.append(first[1:], 65536) - 1
    own = owner[first]
    held = own >= 0
    names = rows.iloc[own[held]]
    return pd.DataFrame({"net": base >> 16, "start": first[held] + base, "end": last[held] + base, "asn": names["asn"].to_numpy(), "asn_name": names["asn_name"].to_numpy()})


def prepare(asn: DataFrame | Owners | None) -> Owners:
    """The table as ``asn_lookup`` wants it; ranges may nest and overlap.

    Up to ``BROADCAST_ROWS`` ranges are broadcast by /16; more of them meet addresses in a
    shuffle by /24, so that one busy /16 is many keys.
    """
    if isinstance(asn, Owners):
        return asn
    n = 0 if asn is None else asn.count()
    if not n:
        return Owners(None)
    nets = F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))).alias("net")
    ranges = asn.where("start <= end").select("start", "end", "asn", "asn_name", nets).groupBy("net").applyInPandas(_innermost, "net long, " + SCHEMA)
    if n <= BROADCAST_ROWS and ranges.count() <= BROADCAST_ROWS:
        return Owners(F.broadcast(ranges))
    return Owners(ranges.withColumn("net", F.explode(F.sequence(F.shiftright("start", 8), F.shiftright("end", 8)))), 24)


def asn_lookup(rows: DataFrame, ip: str, asn: DataFrame | Owners) -> DataFrame:
    """rows with asn and asn_name, one for each: an address meets the disjoint ranges of its network."""
    owners = prepare(asn)
    none = F.lit(None).cast("string")
    if owners.ranges is None:
        return rows.withColumns({"asn": none, "asn_name": none})
    ranges = owners.ranges.select(F.col("net").alias("_net"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("asn").alias("_asn"), F.col("asn_name").alias("_name"))
    own = rows.withColumn("_u32", S.ip_to_u32(F.col(ip))).withColumn("_own", F.shiftright("_u32", 32 - owners.bits))
    out = own.join(ranges, (F.col("_own") == F.col("_net")) & F.col("_u32").between(F.col("_start"), F.col("_end")), "left")
    return out.withColumn("asn", F.col("_asn")).withColumn("asn_name", F.col("_name")).drop("_u32", "_own", "_net", "_start", "_end", "_asn", "_name")


def describe(rows: DataFrame, ip: str, asn: DataFrame | Owners | None) -> DataFrame:
    """rows with asn, asn_name and reputation: provider, unknown, or unavailable without a table."""
    owners = prepare(asn)
    found = asn_lookup(rows, ip, owners)
    known = F.when(F.col("asn").isin(fixed.PROVIDER_ASNS), "provider").otherwise("unknown")
    return found.withColumn("reputation", F.lit("unavailable") if owners.ranges is None else known)
