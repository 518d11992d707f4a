"""Models by walk-forward folds on Spark ML, importances, masks and recalibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.sources.shared import materialize

from .ordered import curve_metrics, exact_quantiles
from .records import mask_features
from .samples import numbered
from .scores import compare_to_baseline


def classifier(kind: str, seed: int = 7):
    """logistic, boosted or forest, each with the weights of column w."""
    if kind == "logistic":
        return LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="w", maxIter=50, regParam=0.01)
    if kind == "boosted":
        return GBTClassifier(featuresCol="scaled", labelCol="y", weightCol="w", maxIter=20, maxDepth=3, seed=seed)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="scaled", labelCol="y", weightCol="w", numTrees=30, maxDepth=5, seed=seed)
    raise ValueError(f"unknown model {kind}")


def fit(train: DataFrame, features: list[str], kind: str = "logistic", balanced: bool = True, seed: int = 7) -> PipelineModel:
    """Medians of the train rows for missing values, scaling, classifier. balanced: both classes weigh the same.

    A feature without any value in the train rows is an error, as it has no median.
    """
    rows = train.select(F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    share = rows.agg(F.avg("y").alias("_p"))
    weight = F.when(F.col("y") == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p"))) if balanced else F.lit(1.0)
    rows = rows.join(F.broadcast(share)).withColumn("w", weight).drop("_p")  # one row
    filled = [f"{c}__filled" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), classifier(kind, seed)]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep and score, the probability of class 1."""
    given = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c not in keep])
    return model.transform(given).select(*keep, vector_to_array("probability")[1].alias("score"))


def walk_forward_scores(folded: DataFrame, features: list[str], kind: str = "logistic", balanced: bool = True, seed: int = 7) -> DataFrame:
    """(entity, t0, fold, y, score) out of sample: for each fold of (entity, t0, y, fold, part, features), a model of its train
    rows scores its test rows. Folds whose train rows hold one class only are left out. Folds are few."""
    folded = materialize(folded, "folds")
    usable = folded.where("part = 'train'").groupBy("fold").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a <> b")
    out = None
    for fold in sorted(r.fold for r in usable.select("fold").collect()):
        rows = folded.where(F.col("fold") == fold)
        model = fit(rows.where("part = 'train'"), features, kind, balanced, seed)
        one = score(model, rows.where("part = 'test'"), features, ["entity", "t0", "fold", "y"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no fold holds both classes in its train rows")
    return out


def model_zoo(folded: DataFrame, features: list[str], kinds: tuple[str, ...] = ("logistic", "boosted", "forest")) -> DataFrame:
    """walk_forward_scores of each kind, with model. A kind that ends in _natural weighs all rows alike; others balance
    the classes."""
    folded, out = materialize(folded, "folds"), None
    for kind in kinds:
        one = walk_forward_scores(folded, features, kind.removesuffix("_natural"), not kind.endswith("_natural")).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def best_model(scored: DataFrame) -> DataFrame:
    """(model, folds, auc, ap, best): means over the folds of scores with model, fold and y; best is the largest mean AP,
    ties by AUC, then name. Folds of one class have no AUC and are left out of its mean."""
    per_fold = curve_metrics(scored, ["model", "fold"])
    mean = per_fold.groupBy("model").agg(F.count("*").alias("folds"), F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))
    top = mean.agg(F.max_by("model", F.struct(F.coalesce("ap", F.lit(-1.0)), F.coalesce("auc", F.lit(-1.0)), F.col("model"))).alias("_top"))  # a row for each model
    return mean.crossJoin(F.broadcast(top)).withColumn("best", F.col("model") == F.col("_top")).drop("_top")


def ablation(folded: DataFrame, sets: dict[str, list[str]], baseline: str, kind: str = "logistic", small: float = 0.005) -> DataFrame:
    """(features, auc, ap, delta_auc, delta_ap, prefer_simpler): out-of-sample scores of models on each set of features, all
    folds pooled, less those of the baseline set. The simpler set will do where both deltas are below `small`."""
    folded, scored = materialize(folded, "folds"), None
    for name, features in sets.items():
        one = walk_forward_scores(folded, features, kind).select(F.lit(name).alias("features"), "score", "y")
        scored = one if scored is None else scored.unionByName(one)
    pooled = curve_metrics(scored, ["features"]).select("features", "auc", "ap")
    return compare_to_baseline(pooled, "features", baseline, ["auc", "ap"], small)


def lite_fit(folded: DataFrame, features: list[str], kind: str = "logistic") -> DataFrame:
    """Scores of the last fold's test rows by a model of its train rows, so no row is scored by a model that saw it."""
    folded = materialize(folded, "folds")
    last = folded.where(F.col("part").isNotNull()).agg(F.max("fold")).first()[0]
    if last is None:
        raise ValueError("there are no folds")
    return walk_forward_scores(folded.where(F.col("fold") == last), features, kind)


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): average precision, null without hits; equal scores count as one step. Scores are grouped in 4096 buckets of the unit interval
    first, so that no group is sorted in one task."""
    from pyspark.sql import Window

    steps = scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("h")).withColumn("_b", F.floor(-F.col("score") * 4096))
    sizes = steps.groupBy(*by, "_b").agg(F.sum("n").alias("bn"), F.sum("h").alias("bh"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("bn").over(ahead), F.lit(0)).alias("on"), F.coalesce(F.sum("bh").over(ahead), F.lit(0)).alias("oh"))
    inner = Window.partitionBy(*by, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.withColumn("cn", F.sum("n").over(inner)).withColumn("ch", F.sum("h").over(inner)).join(sizes, [*by, "_b"])
    return cum.groupBy(*by).agg((F.sum(F.col("h") * (F.col("ch") + F.col("oh")) / (F.col("cn") + F.col("on"))) / F.nullif(F.sum("h"), F.lit(0))).alias("ap"))


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], key: str = "entity", repeats: int = 3, seed: int = 7) -> DataFrame:
    """(feature, drop): mean loss of average precision when a feature's values are dealt anew by two hash orders of the rows."""
    place = lambda df, salt, name: numbered(df.withColumn("_g", F.lit(0)).withColumn("_h", F.xxhash64(F.lit(salt), key)), ["_g"], F.shiftright("_h", 52), "_h", key).withColumnRenamed("_i", name).drop("_g", "_h")
    base = score(model, rows, features, [key, "y"]).withColumn("feature", F.lit("")).withColumn("turn", F.lit(0))
    for turn in range(repeats):
        own = place(rows, seed, "_at")
        other = place(rows.select(key, *features), seed + 1 + turn, "_at")
        for c in features:
            dealt = own.drop(c).join(other.select("_at", c), "_at").drop("_at")
            base = base.unionByName(score(model, dealt, features, [key, "y"]).withColumn("feature", F.lit(c)).withColumn("turn", F.lit(turn)))
    ap = average_precision(base, ["feature", "turn"])
    whole = ap.where("feature = ''").select(F.col("ap").alias("whole"))
    return ap.where("feature <> ''").join(F.broadcast(whole)).groupBy("feature").agg(F.avg(F.col("whole") - F.col("ap")).alias("drop"))  # one row


def perturbation(model: PipelineModel, rows: DataFrame, features: list[str], groups: dict[str, list[str]], key: str = "entity", live: DataFrame | None = None) -> DataFrame:
    """(entity, group, before, after): scores with all features, and with a group of them set to null, hence to train medians.

    With live rows, the group is set to its exact medians over those instead; a feature that they lack is null.
    """
    before = score(model, rows, features, [key]).withColumnRenamed("score", "before")
    medians = {}
    if live is not None:
        long = live.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "v").where("v is not null")
        medians = {r["feature"]: r["q"][0] for r in exact_quantiles(long, ["feature"], "v", [0.5]).collect()}  # a row for each feature
    out = None
    for name, columns in groups.items():
        moved = mask_features(rows, columns) if live is None else rows.withColumns({c: F.lit(medians.get(c)).cast("double") for c in columns})
        one = before.join(score(model, moved, features, [key]), key).select(key, F.lit(name).alias("group"), "before", F.col("score").alias("after"))
        out = one if out is None else out.unionByName(one)
    return out


def recalibrate(model: PipelineModel, before: DataFrame, after: DataFrame, features: list[str], threshold: float, key: str = "entity") -> DataFrame:
    """(version, n, mean, largest, n_pass) of the scores of rows before and after a repair."""
    both = score(model, before, features, [key]).withColumn("version", F.lit("before")).unionByName(score(model, after, features, [key]).withColumn("version", F.lit("after")))
    return both.groupBy("version").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("largest"), F.count_if(F.col("score") >= threshold).alias("n_pass"))
