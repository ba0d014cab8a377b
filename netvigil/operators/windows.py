"""Trailing time windows as running sums.

Every event enters the sums at its own time and leaves them after ``seconds``; one
ordered pass keeps them, so a full window costs no more per row than an empty one. A
window holds the rows of its key with ``ts - seconds <= their ts``, that came no later
in (ts_us, seq) order. Keys are cut into overlapping time buckets, so one hot key
spreads over many tasks: each bucket also holds the rows of the window before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions import scalars as S

#: Length of a bucket in windows.
BUCKET_WINDOWS = 4


def trailing(
    events: DataFrame,
    keys: list[str | Column],
    seconds: int,
    sums: dict[str, Column] | None = None,
    distinct: dict[str, Column] | None = None,
    entropy: dict[str, Column] | None = None,
    gaps: bool = False,
) -> DataFrame:
    """events (with ts_us, seq) and, for each row, n, sums, distinct counts, entropies and gap sums of its window.

    ``gaps`` adds gap_n, gap_sum (long) and gap_squares (decimal) of the microseconds
    between neighbours in the window.
    """
    sums, distinct, entropy = sums or {}, distinct or {}, entropy or {}
    span = seconds * 1_000_000
    size = BUCKET_WINDOWS * span
    own = F.floor(F.col("ts_us") / size).cast("long")
    names = events.columns
    row = events.select(
        F.struct(*names).alias("row"),
        *[(F.col(k) if isinstance(k, str) else k).alias(f"key{n}") for n, k in enumerate(keys)],
        F.col("ts_us").alias("t"), F.col("seq").alias("s"),
        *[F.coalesce(x.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"sum_{n}") for n, x in sums.items()],
        *[x.alias(f"val_{n}") for n, x in (distinct | entropy).items()],
        own.alias("own"),
        F.explode(F.when(F.col("ts_us") >= (own + 1) * size - span, F.array(own, own + 1)).otherwise(F.array(own))).alias("bucket"),
    )
    part = [f"key{n}" for n in range(len(keys))] + ["bucket"]
    order = [F.col("t"), F.col("s")]
    in_key = Window.partitionBy(*part).orderBy(*order)
    plus = {f"sum_{n}": F.col(f"sum_{n}") for n in sums} | {"n": F.lit(1).cast("long")}
    minus = {k: -v for k, v in plus.items()}
    for n in distinct:
        same = Window.partitionBy(*part, f"val_{n}").orderBy(*order)
        row = row.withColumn(f"last_{n}", F.lag("t").over(same)).withColumn(f"next_{n}", F.lead("t").over(same))
        plus[f"dist_{n}"] = F.when(F.col(f"last_{n}") >= F.col("t") - span, 0).otherwise(1).cast("long")
        minus[f"dist_{n}"] = F.when(F.col(f"next_{n}") <= F.col("t") + span, 0).otherwise(-1).cast("long")
    if gaps:
        row = row.withColumn("from_last", F.col("t") - F.lag("t").over(in_key)).withColumn("to_next", F.lead("t").over(in_key) - F.col("t"))
        for name, f in (("gap_n", lambda g: F.lit(1).cast("long")), ("gap_sum", lambda g: g), ("gap_squares", lambda g: g.cast("decimal(19,0)") * g.cast("decimal(19,0)"))):
            zero = F.lit(0).cast("decimal(38,0)" if name == "gap_squares" else "long")
            plus[name] = F.when(F.col("from_last") <= span, f(F.col("from_last"))).otherwise(zero)
            minus[name] = F.when(F.col("to_next") <= span, -f(F.col("to_next"))).otherwise(zero)
    carried = [*part, "own", "s", *[f"val_{n}" for n in entropy]]
    arriving = row.select("row", *carried, "t", F.lit(1).alias("phase"), *[x.alias(k) for k, x in plus.items()])
    leaving = row.select(F.lit(None).cast(row.schema["row"].dataType).alias("row"), *carried, (F.col("t") + span).alias("t"), F.lit(2).alias("phase"), *[x.alias(k) for k, x in minus.items()])
    steps = arriving.unionByName(leaving)
    times = [F.col("t"), F.col("phase"), F.col("s")]
    for n in entropy:
        step = F.when(F.col("phase") == 1, 1).otherwise(-1)
        steps = steps.withColumn("c", F.sum(step).over(Window.partitionBy(*part, f"val_{n}").orderBy(*times).rowsBetween(Window.unboundedPreceding, 0)))
        weight = lambda c: F.when(c > 1, S.rounded(c * F.log2(c.cast("double")) * 1e9).cast("long")).otherwise(F.lit(0).cast("long"))
        steps = steps.withColumn(f"ent_{n}", weight(F.col("c")) - weight(F.col("c") - step)).drop("c")
        plus[f"ent_{n}"] = F.col(f"ent_{n}")
    running = Window.partitionBy(*part).orderBy(*times).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select("row", "own", "bucket", *[F.sum(k).over(running).alias(k) for k in plus])
    out = out.where(F.col("row").isNotNull() & (F.col("own") == F.col("bucket")))
    n = F.col("n").cast("double")
    return out.select(
        "row.*", F.col("n").alias("window_n"),
        *[F.col(f"sum_{k}").cast("long").alias(k) for k in sums],
        *[F.col(f"dist_{k}").alias(k) for k in distinct],
        *[F.greatest(F.lit(0.0), F.log2(n) - F.col(f"ent_{k}") / 1e9 / n).alias(k) for k in entropy],
        *(["gap_n", "gap_sum", "gap_squares"] if gaps else []),
    )
