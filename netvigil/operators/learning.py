"""Optional models: names that machines made, and uploads that stand out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, SQLTransformer
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import scalars as S

SEED = 26145


def _grams(label: str) -> F.Column:
    """All runs of 2 to 5 characters."""
    low = F.lower(F.col(label))
    runs = [F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda k, n=n: F.substring(low, k, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in (2, 3, 4, 5)]
    return F.concat(*runs)


def dga_train(labels: DataFrame) -> PipelineModel:
    """A model over (label, dga 0/1): weighted character runs and balanced logistic regression."""
    rows = labels.withColumn("grams", _grams("label"))
    share = rows.agg(F.avg(F.col("dga").cast("double"))).first()[0] or 0.5
    rows = rows.withColumn("w", F.when(F.col("dga") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    stages = [SQLTransformer(statement="SELECT * FROM __THIS__"), HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features")]
    return Pipeline(stages=[*stages, LogisticRegression(labelCol="dga", weightCol="w", maxIter=100)]).fit(rows)


def dga_score(model: PipelineModel | None, labels: DataFrame) -> DataFrame:
    """(label, dga_char_ngram_score) of the distinct labels; null scores without a model."""
    own = labels.select("label").distinct()
    if model is None:
        return own.withColumn("dga_char_ngram_score", F.lit(None).cast("double"))
    from pyspark.ml.functions import vector_to_array

    return model.transform(own.withColumn("grams", _grams("label"))).select("label", vector_to_array("probability")[1].alias("dga_char_ngram_score"))


def dga_eval(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1 of (dga, dga_char_ngram_score)."""
    hit, true = F.col("dga_char_ngram_score") >= threshold, F.col("dga") == 1
    n = scored.agg(*[F.sum(c.cast("long")).alias(k) for k, c in (("tp", hit & true), ("fp", hit & ~true), ("fn", ~hit & true), ("tn", ~hit & ~true))])
    ratio = lambda a, b: F.when(b > 0, S.rounded(a / b, 4))
    return n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def stems(label: F.Column) -> F.Column:
    """The words of a name: runs of at least three letters, in lower case; the whole name where it has none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lower(label)))


def split_by_vocabulary(labels: DataFrame, test_share: float = 0.5) -> DataFrame:
    """labels (label, ...) with part: train, test, or between, so that train and test have no word in common.

    Words are dealt by hash, and a name goes where all its words are; names with words on
    both sides are between and belong to neither half. No names are compared with others.
    """
    tests = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") < int(test_share * 65536)
    words = stems(F.col("label"))
    return labels.withColumn("part", F.when(F.forall(words, tests), "test").when(F.exists(words, tests), "between").otherwise("train"))


def exfil_train(rows: DataFrame, trees: int = 50, sample: int = 256) -> pd.DataFrame:
    """Isolation trees over (outbound_bytes, outbound_inbound_ratio): each is grown by a task from a sample of rows."""
    share = min(1.0, 2.0 * sample * trees / max(1, rows.count()))
    dealt = rows.sample(share, SEED).select("outbound_bytes", "outbound_inbound_ratio", F.explode(F.array(*[F.lit(k) for k in range(trees)])).alias("tree"))
    dealt = dealt.where(F.pmod(F.xxhash64("outbound_bytes", "outbound_inbound_ratio", "tree"), F.lit(trees)) < max(1, trees // 10))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(SEED + int(frame["tree"].iloc[0]))
        points = frame[["outbound_bytes", "outbound_inbound_ratio"]].to_numpy(float)
        points = points[rng.permutation(len(points))[:sample]]
        nodes, todo = [], [(points, 0, -1, 0)]
        while todo:
            own, depth, parent, side = todo.pop()
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(2)
            leaf = len(own) <= 1 or depth >= 8 or not spread.any()
            axis = int(rng.choice(np.flatnonzero(spread))) if not leaf else -1
            cut = float(rng.uniform(own[:, axis].min(), own[:, axis].max())) if not leaf else 0.0
            here = len(nodes)
            nodes.append((int(frame["tree"].iloc[0]), here, parent, side, axis, cut, depth, len(own)))
            if not leaf:
                todo += [(own[own[:, axis] < cut], depth + 1, here, 0), (own[own[:, axis] >= cut], depth + 1, here, 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "parent", "side", "axis", "cut", "depth", "size"])

    return dealt.groupBy("tree").applyInPandas(grow, "tree int, node int, parent int, side int, axis int, cut double, depth int, size int").toPandas()  # trees x sample nodes


def exfil_anomaly(rows: DataFrame, model: pd.DataFrame | None, limit: float = 0.6) -> DataFrame:
    """rows with exfil_anomaly_score and exfil_anomaly_flag; null without a model."""
    if model is None or not len(model):
        return rows.withColumns({"exfil_anomaly_score": F.lit(None).cast("double"), "exfil_anomaly_flag": F.lit(None).cast("boolean")})
    trees = []
    for _, t in model.groupby("tree"):
        t = t.sort_values("node").reset_index(drop=True)
        children = np.zeros((len(t), 2), int)
        inner = t["parent"].to_numpy() >= 0
        children[t["parent"].to_numpy()[inner], t["side"].to_numpy()[inner]] = t["node"].to_numpy()[inner]
        trees.append((children, t["axis"].to_numpy(), t["cut"].to_numpy(), t["depth"].to_numpy(float), t["size"].to_numpy(float)))
    rest = lambda n: 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772) - 2 * (n - 1) / np.maximum(n, 1)
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(sent: pd.Series, ratio: pd.Series) -> pd.Series:
        points = np.stack([sent.to_numpy(float), ratio.to_numpy(float)], 1)
        total = np.zeros(len(points))
        for children, axis, cut, depth, sizes in shared.value:
            at = np.zeros(len(points), int)
            for _ in range(9):
                live = np.flatnonzero(axis[at] >= 0)
                if not len(live):
                    break
                right = points[live, axis[at[live]]] >= cut[at[live]]
                at[live] = children[at[live], right.astype(int)]
            total += depth[at] + np.where(sizes[at] > 1, rest(sizes[at]), 0)
        top = max(2.0, float(max(sizes[0] for *_, sizes in shared.value)))
        return pd.Series(2 ** (-(total / len(shared.value)) / rest(top)))

    out = rows.withColumn("exfil_anomaly_score", S.rounded(score(F.col("outbound_bytes").cast("double"), F.col("outbound_inbound_ratio")), 3))
    return out.withColumn("exfil_anomaly_flag", F.col("exfil_anomaly_score") >= limit)


class IsolationForest(Estimator):
    """Fits ``IsolationForestModel`` to rows with outbound_bytes and outbound_inbound_ratio."""

    def __init__(self, trees: int = 50, sample: int = 256):
        super().__init__()
        self.trees, self.sample = trees, sample

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        return IsolationForestModel(exfil_train(dataset, self.trees, self.sample))


class IsolationForestModel(Model, MLWritable, MLReadable):
    """Adds exfil_anomaly_score and exfil_anomaly_flag; its nodes (trees times a bounded sample) are written as a table."""

    def __init__(self, nodes: pd.DataFrame | None = None, limit: float = 0.6):
        super().__init__()
        self.nodes, self.limit = nodes, limit

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return exfil_anomaly(dataset, self.nodes, self.limit)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        nodes = self.sparkSession.createDataFrame(self.model.nodes.assign(limit=self.model.limit))
        nodes.coalesce(1).sortWithinPartitions("tree", "node").write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return IsolationForestModel(nodes.drop(columns="limit"), float(nodes["limit"].iloc[0]))


def artifact_digest(spark: SparkSession, path: str) -> str | None:
    """One digest over the names and bytes of a model's files, or none where there are none; tasks hash the files."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    # Part files have random names; the folder and the bytes tell them apart.
    own = files.select(F.concat_ws(":", F.element_at(F.split("path", "/"), -2), F.sha2("content", 256)).alias("file"))
    row = own.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("file"))), 256).alias("digest")).first()
    return row["digest"] if row["n"] else None


def manifest_of(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The manifest of models by name: their digests and the version of the library that wrote them."""
    return {"library": spark.version} | {name: digest for name, path in paths.items() if (digest := artifact_digest(spark, path))}


def gate(manifest: dict[str, str], name: str, digest: str | None, version: str) -> bool:
    """Whether an artifact is the one that the manifest names; fails closed."""
    return bool(manifest) and digest is not None and manifest.get(name) == digest and manifest.get("library") == version


def load_gated(spark: SparkSession, path: str, name: str, manifest: dict[str, str], load: Callable[[str], Model] = PipelineModel.load) -> Model | None:
    """The model at path if its files are those that the manifest names; none, and it is never read, if not."""
    return load(path) if gate(manifest, name, artifact_digest(spark, path), spark.version) else None
