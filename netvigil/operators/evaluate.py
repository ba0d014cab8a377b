"""Census of labelled flows and evaluation of alerts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netvigil.functions import fixed
from netvigil.functions import scalars as S


def _label(name: str) -> Column:
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    return F.when(text == "", "UNKNOWN").otherwise(text)


def label_census(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(_label(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def flow_summary(rows: DataFrame, label: str = "label", syn: str = "syn", duration: str = "duration", rate: str = "flow_rate", sent: str = "orig_bytes") -> DataFrame:
    """One row: rows, attack and SYN shares, and means of the finite values."""
    attack = ~F.lower(_label(label)).isin("benign", "unknown")
    heavy = S.num(F.col(syn).cast("string")) >= 1
    seconds = S.finite_num(F.col(duration).cast("string"))
    seconds = F.when(seconds >= 1000, seconds / 1e6).otherwise(seconds)
    mean = lambda x, digits: S.rounded(F.avg(x), digits)
    return rows.agg(
        F.count("*").alias("rows"), F.coalesce(S.rounded(F.avg(attack.cast("double")), 4), F.lit(0.0)).alias("attack_share"),
        F.coalesce(F.sum(heavy.cast("long")), F.lit(0)).alias("syn_heavy_flows"), F.coalesce(S.rounded(F.avg(heavy.cast("double")), 4), F.lit(0.0)).alias("syn_heavy_share"),
        mean(seconds, 3).alias("mean_duration_s"), mean(S.finite_num(F.col(rate).cast("string")), 1).alias("mean_packets_per_s"), mean(S.finite_num(F.col(sent).cast("string")), 1).alias("mean_fwd_bytes"),
    )


def top_ports(rows: DataFrame, port: str = "dst_port", label: str = "label", order: str = "seq", limit: int = 10) -> DataFrame:
    """The ports with most flows, and the share of attacks among them; ties by first appearance."""
    name = F.substring_index(F.trim(F.col(port).cast("string")), ".", 1)
    attack = (~F.lower(F.trim(F.coalesce(F.col(label), F.lit("")))).isin("benign", "")).cast("double")
    out = rows.select(name.alias("port"), attack.alias("attack"), F.col(order).alias("o")).where("port <> ''").groupBy("port").agg(F.count("*").alias("flows"), S.rounded(F.avg("attack"), 4).alias("attack_share"), F.min("o").alias("o"))
    return out.orderBy(F.desc("flows"), "o").limit(limit).drop("o")


def scenario_eval(events: DataFrame, alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """By scenario: events, alerts, matches and whether it was detected. truth: (scenario, expected); benign expects none."""
    counts = alerts.groupBy("scenario").agg(F.count("*").alias("alerts"), F.collect_list("threat_class").alias("found"))
    rows = truth.join(events.groupBy("scenario").agg(F.count("*").alias("events")), "scenario", "left").join(counts, "scenario", "left")
    n = F.coalesce("alerts", F.lit(0)).cast("long")
    matched = F.coalesce(F.size(F.filter("found", lambda c: c == F.col("expected"))), F.lit(0)).cast("long")
    return rows.select("scenario", "expected", F.coalesce("events", F.lit(0)).cast("long").alias("events"), n.alias("alerts"), matched.alias("matched"), F.when(F.col("expected") == "benign", n == 0).otherwise(matched > 0).alias("detected"), F.array_sort(F.array_distinct(F.filter(F.coalesce("found", F.array()), lambda c: c != F.col("expected")))).alias("unexpected"))


def confusion_matrix(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """Truth by predicted class, from (truth, predicted) rows."""
    return pairs.groupBy("truth").pivot("predicted", classes).agg(F.count(F.lit(1))).fillna(0)


def alert_precision(pairs: DataFrame) -> DataFrame:
    """By predicted class: alerts, right ones and their share."""
    return pairs.groupBy("predicted").agg(F.count("*").alias("alerts"), F.sum((F.col("truth") == F.col("predicted")).cast("long")).alias("right"), S.rounded(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 3).alias("precision"))


def benign_rate(counts: DataFrame) -> DataFrame:
    """Alerts for each event over benign (events, alerts) rows."""
    return counts.agg(S.rounded(F.sum("alerts") / F.greatest(F.lit(1), F.sum("events")), 4).alias("benign_fpr"))


def label_windows(labels: DataFrame) -> DataFrame:
    """(window_pos, class, start_us, end_us) of label rows (pos and text columns); without times the row holds at any time."""
    names = set(labels.columns)
    text = lambda options: F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in map(F.col, [o for o in options if o in names])], F.lit("")) if any(o in names for o in options) else F.lit("")
    when = lambda options: F.coalesce(*[F.coalesce(S.rounded(F.trim(c).try_cast("double") * 1_000_000).cast("long"), F.unix_micros(F.try_to_timestamp(F.replace(F.trim(c), F.lit("Z"), F.lit("+00:00"))))) for c in map(F.col, [o for o in options if o in names])], F.lit(None).cast("long"))
    mapping = F.create_map(*[x for k, v in fixed.LABEL_CLASSES.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    raw = text(["label", "class", "category"])
    rows = labels.select(F.col("pos").alias("window_pos"), F.lower(raw).alias("raw"), when(["start", "start_time", "begin", "from"]).alias("start_us"), when(["end", "end_time", "to"]).alias("end_us")).where("raw <> ''")
    both = F.col("start_us").isNotNull() & F.col("end_us").isNotNull()
    return rows.select("window_pos", F.try_element_at(mapping, F.col("raw")).alias("class"), F.when(both, F.col("start_us")).alias("start_us"), F.when(both, F.col("end_us")).alias("end_us"))


def truth_join(events: DataFrame, windows: DataFrame, attackers: DataFrame, victims: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """events with truth: an attacker's first matching window, else its first row without times, else unknown; benign for victims; others are left out.

    Windows and attackers meet in time slots as long as the tolerance, so no event is compared with all windows.
    """
    slot = tolerance_s * 1_000_000 or 1
    attack = events.join(attackers.select("src_ip").distinct(), "src_ip", "left_semi")
    timed = windows.where("start_us is not null and class is not null")
    low, high = F.floor((F.col("start_us") - slot) / slot), F.floor((F.col("end_us") + slot) / slot)
    spread = timed.select("window_pos", "class", (F.col("start_us") - tolerance_s * 1_000_000).alias("a"), (F.col("end_us") + tolerance_s * 1_000_000).alias("b"), F.explode(F.sequence(low, high)).alias("slot"))
    slotted = attack.withColumn("slot", F.floor(F.col("ts_us") / slot))
    hits = slotted.join(spread, "slot").where(F.col("ts_us").between(F.col("a"), F.col("b"))).groupBy("seq").agg(F.min_by("class", "window_pos").alias("timed"))
    always = windows.where("start_us is null and class is not null").agg(F.min_by("class", "window_pos").alias("always"))
    bad = attack.join(hits, "seq", "left").crossJoin(F.broadcast(always)).withColumn("truth", F.coalesce("timed", "always", F.lit("unknown"))).drop("timed", "always")
    good = events.join(attackers.select("src_ip").distinct(), "src_ip", "left_anti").join(victims.select("src_ip").distinct(), "src_ip", "left_semi").withColumn("truth", F.lit("benign"))
    return bad.unionByName(good)


def fired(truth: DataFrame, alerts: DataFrame) -> DataFrame:
    """truth rows with fired: whether an alert names their source and class, and any: whether one names their source."""
    named = alerts.select("src_ip", F.col("threat_class").alias("truth")).distinct().withColumn("fired", F.lit(True))
    some = alerts.select("src_ip").distinct().withColumn("any", F.lit(True))
    return truth.join(named, ["src_ip", "truth"], "left").join(some, "src_ip", "left").fillna(False, ["fired", "any"])


def class_scores(scored: DataFrame, strict: bool = False, least: int = 10) -> DataFrame:
    """By class: TP, FN, precision, recall, F1 and recall's Wilson interval. Strict: alerts on other sources' rows count as false."""
    attack = scored.where(~F.col("truth").isin("benign", "unknown"))
    out = attack.groupBy(F.col("truth").alias("class")).agg(F.sum(F.col("fired").cast("long")).alias("tp"), F.sum((~F.col("fired")).cast("long")).alias("fn"))
    if strict:
        fp = scored.where((F.col("truth") == "benign") & F.col("any")).agg(F.count("*").alias("fp"))
        out = out.crossJoin(F.broadcast(fp))
    else:
        out = out.withColumn("fp", F.lit(0).cast("long"))
    ratio = lambda a, b: F.when(b > 0, S.rounded(a / b, 4))
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return out.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), S.wilson(tp, tp + fn, False).alias("recall_low"), S.wilson(tp, tp + fn, True).alias("recall_high"), (tp + fn >= least).alias("sufficient_sample"))


def join_quality(events: DataFrame, truth: DataFrame, alerts: DataFrame, least_joined: int = 50, least_class: int = 10) -> DataFrame:
    """One row: events, joined, excluded, join_rate, reportable, unscored_alerts."""
    known = truth.select("src_ip").distinct()
    per_class = truth.where(~F.col("truth").isin("benign", "unknown")).groupBy("truth").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    rows = events.agg(F.count("*").alias("events")).crossJoin(truth.agg(F.count("*").alias("joined"))).crossJoin(per_class).crossJoin(alerts.join(known, "src_ip", "left_anti").agg(F.count("*").alias("unscored_alerts")))
    return rows.select("events", "joined", (F.col("events") - F.col("joined")).alias("excluded"), S.rounded(F.col("joined") / F.greatest(F.lit(1), F.col("events")), 4).alias("join_rate"), ((F.col("joined") >= least_joined) & (F.col("most") >= least_class)).alias("reportable"), "unscored_alerts")


def field_coverage(spark: SparkSession, columns: list[str]) -> DataFrame:
    """(detector, missing, can_run) for a table with these columns."""
    have = {c.strip().lower() for c in columns}
    needed = spark.createDataFrame([(d, f) for d, fs in fixed.REQUIRED_FIELDS.items() for f in fs], "detector string, field string")
    present = spark.createDataFrame([(f,) for f, cs in fixed.FIELD_COLUMNS.items() if have & set(cs)], "field string")
    missing = needed.join(present, "field", "left_anti").groupBy("detector").agg(F.array_sort(F.collect_list("field")).alias("missing"))
    return needed.select("detector").distinct().join(missing, "detector", "left").select("detector", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.col("missing").isNull().alias("can_run"))


def replay_report(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """(what, name, n): events by kind, alerts by class and subtype, and the span of time in whole seconds."""
    kinds = events.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    found = alerts.groupBy(F.lit("alert").alias("what"), F.concat_ws("/", "threat_class", "subtype").alias("name")).agg(F.count("*").alias("n"))
    span = events.agg(F.floor((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("n")).select(F.lit("span_s").alias("what"), F.lit("").alias("name"), "n")
    return kinds.unionByName(found).unionByName(span)


def scenario_score(alerts: DataFrame, expected: str | None) -> DataFrame:
    """One row: alerts of the expected class, other alerts, and whether the scenario was detected; None expects no alert."""
    right = F.coalesce(F.sum((F.col("threat_class") == F.lit(expected)).cast("long")), F.lit(0)) if expected else F.lit(0).cast("long")
    counts = alerts.agg(F.count("*").alias("alerts"), right.alias("true_positive_alerts"))
    wrong = F.col("alerts") - F.col("true_positive_alerts")
    return counts.select(F.lit(expected or "benign").alias("ground_truth"), "alerts", "true_positive_alerts", wrong.alias("false_positive_alerts"), (F.col("true_positive_alerts") > 0 if expected else wrong == 0).alias("detected"))


def replay_latency(events: DataFrame, alerts: DataFrame, elapsed_s: float) -> DataFrame:
    """One row: events, alerts, events_per_second and lower quantiles of the alerts' latency_ms to the microsecond.

    Latencies are counted by value before they are ordered, so the ordering task sees values, not alerts.
    """
    values = alerts.where("latency_ms is not null").groupBy(S.rounded("latency_ms", 3).alias("ms")).agg(F.count("*").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)))
    total = values.agg(F.sum("n").alias("total"))
    place = lambda q: F.floor((F.col("total") - 1) * q)
    quantiles = upto.crossJoin(F.broadcast(total)).agg(*[F.min(F.when(F.col("upto") > place(q), F.col("ms"))).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])
    counts = events.agg(F.count("*").alias("events")).crossJoin(alerts.agg(F.count("*").alias("alerts")))
    rate = S.rounded(F.col("events") / F.lit(max(elapsed_s, 0.0001)), 2)
    return counts.crossJoin(quantiles).select("events", "alerts", rate.alias("events_per_second"), "p50", "p95", "p99")
