"""Supervised models: class weights, random forests, the multi-class family model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.functions.numbers import clean_features
from threatlake.ml import boosting, grower
from threatlake.session import TASK_ROWS, cut_lineage, spread

# fixed values: trees and depth of the three binary forests
FLOW_FOREST = {"numTrees": 100, "maxDepth": 20}
USER_DAY_FOREST = {"numTrees": 200, "maxDepth": 15}
USER_FOREST = {"numTrees": 300, "maxDepth": 10}
BINS = 256  # split candidates per feature, as fine as histogram boosting


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows and balanced weight n / (classes * rows of class) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return df.join(class_weights(df, label).select(label, F.col("weight").alias(out)), label)


def assembler(features, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out)


def _bare(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which would hold the training rows and the session and travel to every task."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def _large(stored: DataFrame) -> bool:
    """Whether stored rows are more than one task holds: then ``grower`` takes the place of Spark's forest, whose passes and histograms grow with the nodes."""
    return stored.limit(TASK_ROWS + 1).count() > TASK_ROWS


def _grown(stored: DataFrame, features, label: str, labels: list, balanced: bool, seed: int, trees: int, depth: int, bins: int = BINS) -> grower.GrownForest:
    """A forest over stored clean rows, whose label is one of ``labels`` or null; rows without a label are left out."""
    sizes = {r[0]: r[1] for r in stored.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    weights = [sum(sizes.values()) / (len(sizes) * sizes[x]) if balanced and x in sizes else 1.0 for x in labels]
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    return grower.fit(stored.where(F.col(label).isNotNull()).withColumn("y", code), list(features), labels, weights, trees, depth, bins, seed)


def train_binary(
    df: DataFrame, features, label: str, balanced: bool = True, seed: int = 42, **forest,
) -> PipelineModel | grower.GrownForest:
    """Random forest over cleaned features; ``balanced`` weighs classes inversely to their size.

    Fitting reads its input several times, so the feature columns are checkpointed first, one part a core. Up to ``TASK_ROWS``
    rows Spark's forest is fitted, beyond that one whose smaller nodes are finished by single tasks.
    """
    clean = clean_features(df, features).withColumn(label, F.col(label).cast("double"))
    params = {**FLOW_FOREST, "maxBins": BINS, **forest}
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, cacheNodeIds=False, **params)
    clean = cut_lineage(spread(clean.select(*features, label), waves=1))
    if set(forest) <= {"numTrees", "maxDepth"} and _large(clean) and clean.where(~F.col(label).isin(0.0, 1.0)).isEmpty():
        return _grown(clean, features, label, [0.0, 1.0], balanced, seed, params["numTrees"], params["maxDepth"])
    if balanced:
        clean, rf = with_class_weight(clean, label), rf.setWeightCol("weight")
    return _bare(Pipeline(stages=[assembler(features), rf]).fit(clean))


def positive_probability(model: PipelineModel | grower.GrownForest, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, grower.GrownForest):
        scored = model.transform(clean_features(df, model.features))
        return scored.withColumn(out, F.col("probability")[1]).drop("probability")
    features = model.stages[0].getInputCols()
    scored = model.transform(clean_features(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def train_family(
    df: DataFrame, features, label: str, booster: bool | str = False, seed: int = 42, trees: int = 100, depth: int = 8,
) -> PipelineModel | boosting.SoftmaxBooster | grower.GrownForest:
    """Multi-class model with balanced weights and alphabetic label codes.

    The default is a multinomial forest, grown as in ``train_binary``; ``booster`` takes softmax boosting of ``trees`` rounds, "one_against_rest" one
    gradient-boosted model per class.
    """
    if booster is True:
        weighed = with_class_weight(cut_lineage(df.select(*features, label)), label, "_weight")
        return boosting.fit(weighed, features, label, "_weight", rounds=trees, depth=depth)
    stored = cut_lineage(spread(clean_features(df, features).select(*features, label), waves=1))
    if not booster and _large(stored):
        labels = [r[0] for r in stored.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias(label)).distinct().orderBy(label).collect()]
        if 1 < len(labels) <= grower.CLASSES:
            return _grown(stored.withColumn(label, F.col(label).cast("string")), features, label, labels, True, seed, trees, depth)
    clean = with_class_weight(stored, label)
    codes = StringIndexer(inputCol=label, outputCol="_code", stringOrderType="alphabetAsc").fit(clean)
    if booster:
        gbt = GBTClassifier(maxDepth=depth, maxBins=BINS, maxIter=trees, stepSize=0.1, seed=seed, weightCol="weight", labelCol="_code")
        model = OneVsRest(classifier=gbt, labelCol="_code", weightCol="weight", rawPredictionCol="rawPrediction")
    else:
        model = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, maxBins=BINS, seed=seed, weightCol="weight", labelCol="_code",
            featuresCol="features")
    names = IndexToString(inputCol="prediction", outputCol="predicted_family", labels=codes.labels)
    return _bare(Pipeline(stages=[assembler(features), codes.setHandleInvalid("keep"), model, names]).fit(clean))


def _one_against_rest(stage, df: DataFrame) -> DataFrame:
    """Probabilities of one-against-rest models: the positive probability of each, scaled to sum to one; equal shares if all are zero."""
    names = [f"_p{i}" for i in range(len(stage.models))]
    for name, inner in zip(names, stage.models):
        df = inner.transform(df).withColumn(name, vector_to_array(inner.getProbabilityCol())[1]).drop(
            inner.getRawPredictionCol(), inner.getProbabilityCol(), inner.getPredictionCol())
    total = sum((F.col(n) for n in names), F.lit(0.0))
    shares = F.array(*[F.when(total > 0, F.col(n) / total).otherwise(1.0 / len(names)) for n in names])
    best = F.array_position(shares, F.array_max(shares)) - 1
    return df.withColumns({"probability": array_to_vector(shares), "rawPrediction": array_to_vector(shares), "prediction": best.cast("double")}).drop(*names)


def family_probabilities(model: PipelineModel | boosting.SoftmaxBooster | grower.GrownForest, df: DataFrame, benign: str = "Benign") -> DataFrame:
    """1 - P(benign) and the most likely family (ties: the first); labels are not needed at scoring time."""
    if isinstance(model, grower.GrownForest):
        p = F.col("probability")
        named = F.element_at(F.array(*[F.lit(x) for x in model.labels]), F.array_position(p, F.array_max(p)).cast("int"))
        scored = model.transform(clean_features(df, model.features)).withColumn("predicted_family", named)
        return scored.withColumn("family_attack_proba", 1.0 - p[model.labels.index(benign)]).drop("probability")
    if isinstance(model, boosting.SoftmaxBooster):
        scored = model.transform(clean_features(df, model.features))
        return scored.withColumn("family_attack_proba", 1.0 - F.col("probability")[model.labels.index(benign)]).drop("probability")
    stages = [s for s in model.stages if not hasattr(s, "labelsArray")]
    labels = next(s for s in model.stages if hasattr(s, "labelsArray")).labels
    scored = clean_features(df, model.stages[0].getInputCols())
    for stage in stages:
        scored = _one_against_rest(stage, scored) if isinstance(stage, OneVsRestModel) else stage.transform(scored)
    probability = vector_to_array("probability")
    return scored.withColumn("family_attack_proba", 1.0 - probability[labels.index(benign)]).drop(
        "features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel | grower.GrownForest, limit: int | None = None) -> DataFrame:
    spark = SparkSession.active()
    if isinstance(model, grower.GrownForest):
        rows = zip(model.features, (float(v) for v in model.importances()))
    else:
        forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
        rows = zip(model.stages[0].getInputCols(), (float(v) for v in forest.featureImportances.toArray()))
    ranked = spark.createDataFrame(list(rows), "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked.limit(limit) if limit else ranked
