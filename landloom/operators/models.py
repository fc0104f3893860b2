"""Feature tables and models: splits, ablation, importance and partial dependence, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats

C = F.col
#: Boosting rounds and depth of the ablation and of the importance models (the operators take others).
ROUNDS, DEPTH = 20, 4


PLACES = 256


def _place(df: DataFrame, keys: Sequence[str], row_id: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with the place of each row among those of its keys, in the order of a hash of its id.

    The hash's order is cut into ``PLACES`` parts that are ordered alone and counted before: no key is one task's."""
    order = F.conv(F.substring(F.md5(F.concat_ws(" ", C(row_id).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long")
    parted = df.withColumn("place order", order).withColumn("place part", F.expr(f"`place order` div {2**32 // PLACES}"))
    sizes = parted.groupBy(*keys, "place part").agg(F.count("*").alias("place own"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("place part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(*keys, "place part", F.coalesce(F.sum("place own").over(before), F.lit(0)).alias("place earlier"))  # PLACES rows a key
    inside = F.row_number().over(Window.partitionBy(*keys, "place part").orderBy("place order", row_id))
    return parted.join(earlier, [*keys, "place part"]).withColumn(name, inside + C("place earlier")).drop("place order", "place part", "place earlier")


def stratified_split(df: DataFrame, label: str, row_id: str, train: float = 0.65, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """``is_train``: the given share of each class (of each key), by hash; repeated runs agree."""
    sizes = df.groupBy(*keys, label).agg(F.count("*").alias("size"))
    placed = _place(df, [*keys, label], row_id, seed)
    return placed.join(sizes, [*keys, label]).withColumn("is_train", C("place") <= F.round(C("size") * F.lit(train))).drop("place", "size")


def stratified_cap(df: DataFrame, label: str, row_id: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows with the class shares kept: a sampling operator of the model stage."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    total = sum(counts.values())
    if total <= most:
        return df
    quota = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, max(1, round(most * n / total)))))
    return _place(df, [label], row_id, seed).where(C("place") <= quota[C(label)]).drop("place")


def pooled_sample(df: DataFrame, key: str, label: str, row_id: str, most: int = 3000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each key (a sampling operator), the class shares of each key kept."""
    sizes = df.groupBy(key, label).agg(F.count("*").alias("size")).withColumn("total", F.sum("size").over(Window.partitionBy(key)))
    quota = F.when(C("total") <= most, C("size")).otherwise(F.greatest(F.lit(1.0), F.round(C("size") * F.lit(float(most)) / C("total"))))
    placed = _place(df, [key, label], row_id, seed)
    return placed.join(sizes.select(key, label, quota.alias("quota")), [key, label]).where(C("place") <= C("quota")).select(*df.columns)


def chosen_set(results: DataFrame, prefix: str | None = None) -> str:
    """The set whose name is or begins with ``prefix``; without one, or where none does, the set of the best AUC."""
    rows = results.select("model", "auc").collect()  # sets
    fits = sorted(r.model for r in rows if prefix and (r.model == prefix or r.model.startswith(f"{prefix} ")))
    return fits[0] if fits else max(rows, key=lambda r: (-1.0 if r.auc is None else r.auc, r.model)).model


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight``: rows over twice the class's rows."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    total = sum(counts.values())
    return df.withColumn("weight", F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, total / (2.0 * n))))[C(label)])


def boosted(features: Sequence[str], label: str, rounds: int = 80, depth: int = 5, step: float = 0.05) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep"), GBTClassifier(featuresCol="x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=42)])


def forest(features: Sequence[str], label: str, trees: int = 120, depth: int = 12, leaf: int = 20) -> Pipeline:
    model = RandomForestClassifier(featuresCol="x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep"), model])


def logistic(features: Sequence[str], label: str, rows: int) -> Pipeline:
    filled = [f"{f}__filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=1.0 / max(1, rows), elasticNetParam=0.0),
    ])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def evaluate(model: PipelineModel, df: DataFrame, label: str) -> tuple[float | None, float | None]:
    own = scored(model, df).select(label, F.round("score", 12).alias("score"))
    return stats.auc(own, label, "score").first()[0], stats.average_precision(own, label, "score").first()[0]


def ablation(train: DataFrame, test: DataFrame, label: str, configs: Mapping[str, Sequence[str]], rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    """(model, auc, ap, n_dim, delta) of each feature set; delta is the AUC less that of the second set."""
    rows = []
    for name, features in configs.items():
        auc, ap = evaluate(boosted(features, label, rounds, depth).fit(train), test, label)
        rows.append([name, auc, ap, len(features)])
    base = rows[min(1, len(rows) - 1)][1]
    out = [(n, a, p, d, None if a is None or base is None else a - base) for n, a, p, d in rows]
    return train.sparkSession.createDataFrame(out, "model string, auc double, ap double, n_dim int, delta double")


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, features: Sequence[str], row_id: str, most: int = 8000, seed: int = 42) -> DataFrame:
    """(feature, delta_auc, rank): the AUC lost when a column is dealt anew among the sampled rows.

    One plan for all features: each row is scored once per feature, with that feature from another row of a hash order."""
    sample = stratified_cap(df, label, row_id, most, seed).select(row_id, label, *features)
    placed = _place(_place(sample, [], row_id, seed, "a"), [], row_id, seed + 1, "b")
    donor = placed.select(C("b").alias("a"), *(C(f).alias(f"{f}__other") for f in features))
    pairs = placed.join(donor, "a").withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, features))))
    shuffled = pairs.select(row_id, label, "feature", *(F.when(C("feature") == f, C(f"{f}__other")).otherwise(C(f)).alias(f) for f in features))
    aucs = stats.auc(scored(model, shuffled).select("feature", label, F.round("score", 12).alias("score")), label, "score", ["feature"])
    base = aucs.where("feature = ''").select(C("auc").alias("base"))  # one row
    lost = aucs.where("feature <> ''").join(F.broadcast(base)).select("feature", (C("base") - C("auc")).alias("delta_auc"), F.lit(1).alias("one"))
    return lost.withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("delta_auc"), "feature"))).drop("one")


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, points: Sequence[float]) -> DataFrame:
    """(value, mean_score): the mean score with the feature set to each of its quantiles."""
    values = sorted(set(df.agg(F.percentile(feature, F.array(*map(F.lit, points)))).first()[0]))
    grid = df.drop(feature).withColumn(feature, F.explode(F.array(*map(F.lit, values))))
    return scored(model, grid).groupBy(C(feature).alias("value")).agg(F.avg("score").alias("mean_score"))
