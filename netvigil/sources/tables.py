"""Sets of parquet files that spell and type their columns in different ways."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Footers that the driver asks for at the same time.
FOOTERS = 16
_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_REAL = [T.FloatType(), T.DoubleType(), T.DecimalType()]


def folded(name: str) -> str:
    """A column's name without byte-order mark and outer blanks, in lower case."""
    return name.replace("﻿", "").strip().lower()


def common_type(types: Iterable[T.DataType]) -> T.DataType:
    """The least type that holds all of these: whole numbers the widest of them, mixed numbers double, else text."""
    types = [t for t in types if not isinstance(t, T.NullType)]
    if len({t.simpleString() for t in types}) <= 1:
        return types[0] if types else T.StringType()
    if all(t in _WHOLE for t in types):
        return max(types, key=_WHOLE.index)
    if all(t in _WHOLE or isinstance(t, tuple(type(r) for r in _REAL)) for t in types):
        return T.DoubleType()
    return T.StringType()


def _files(spark: SparkSession, glob: str) -> list[str]:
    """The parquet files of a glob, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(glob)
    return sorted(found.inputFiles())


def parquet_scan(spark: SparkSession, glob: str) -> DataFrame:
    """All rows of the parquet files of a glob, under one set of trimmed, lower-case columns.

    Only footers are read for the plan: files with the same footer schema are one scan with
    its own column pruning and pushed filters, and the scans are united. A column that some
    files lack is null there; one that they type differently takes the common type; spellings
    of one name within a file fill each other's nulls, from left to right. No file is an error.
    """
    files = _files(spark, glob)
    if not files:
        raise FileNotFoundError(f"no parquet files at {glob}")
    with ThreadPoolExecutor(FOOTERS) as pool:
        schemas = list(pool.map(lambda f: spark.read.parquet(f).schema, files))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for file, schema in zip(files, schemas, strict=True):
        groups.setdefault(schema.json(), (schema, []))[1].append(file)
    types: dict[str, list[T.DataType]] = {}
    for schema, _ in groups.values():
        for field in schema:
            types.setdefault(folded(field.name), []).append(field.dataType)
    target = {name: common_type(ts) for name, ts in types.items()}
    out = None
    for schema, own in groups.values():
        columns: dict[str, list[str]] = {}
        for n, field in enumerate(schema):
            columns.setdefault(folded(field.name), []).append(f"_{n}")
        rows = spark.read.schema(schema).parquet(*own).toDF(*[f"_{n}" for n in range(len(schema))])
        shaped = rows.select(*[(F.coalesce(*[F.col(c).cast(t) for c in columns[name]]) if name in columns else F.lit(None).cast(t)).alias(name) for name, t in target.items()])
        out = shaped if out is None else out.unionByName(shaped)
    return out
