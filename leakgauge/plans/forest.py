"""The random forest: input vector, fit, score, and the saved model with its contract."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from leakgauge.contract import (
    FIRST_INTERVAL, MODEL_FEATURES, WINDOW_SECONDS, DataError, check_model_inputs,
)
from leakgauge.operators.ranking import ranked_importances
from leakgauge.session import ensure_checkpoint_dir, stored

DEEPEST = 30  # the deepest tree MLlib grows; stands for "no limit"
#: Rows times trees in one partition of a fit. MLlib keeps a count and a node of every row for every tree, 8 bytes together.
ROW_TREES = 30_000_000
MANIFEST = "manifest"
MODEL = "model"


@dataclass(frozen=True)
class ForestSpec:
    """Settings of one candidate forest."""

    depth: int = 12
    leaf: int = 1
    balanced: bool = False
    trees: int = 150
    seed: int = 42
    bins: int = 32


def wide_grid(trees=150, seed=42):
    """Candidates of the single-split selection."""
    return [ForestSpec(d, leaf, b, trees, seed) for d in (12, DEEPEST) for leaf in (1, 5) for b in (False, True)]


def regular_grid(trees=150, seed=42):
    """Candidates of the cross-validated selection: shallower trees, larger leaves."""
    return [ForestSpec(d, leaf, b, trees, seed) for d in (8, 12) for leaf in (5, 20) for b in (False, True)]


def model_input(df, features=MODEL_FEATURES):
    """The features as doubles; an absent column or a value that is not finite is an error."""
    check_model_inputs(features)
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise DataError(f"features are missing: {', '.join(absent)}")

    def finite(name):
        value = F.col(name).cast("double")
        good = value.isNotNull() & (F.abs(value) < float("inf"))
        return F.when(good, value).otherwise(F.raise_error(F.lit(f"{name} must be a finite number")).cast("double"))

    return df.withColumns({name: finite(name) for name in features})


def _with_weights(df, balanced):
    """Weight n / (2 * rows of the class), taken from the whole training table."""
    if not balanced:
        return df.withColumn("__weight", F.lit(1.0))
    counts = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (2.0 * n)).otherwise(weight)
    return df.withColumn("__weight", weight)


def fit_forest(df, spec):
    """Fit on prepared rows (features and label); trees grow on Spark, nothing is collected.

    The rows are written first, since a fit reads them several times, and dealt over partitions in proportion to rows and
    trees, so that what a task keeps and reads does not grow with the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = stored(df.select("label", *MODEL_FEATURES), "fit")
    n = rows.count()
    parts = max(min(spark.sparkContext.defaultParallelism, n // 2000 + 1), -(-n * spec.trees // ROW_TREES))
    rows = _with_weights(rows, spec.balanced).repartition(parts)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", weightCol="__weight",
        numTrees=spec.trees, maxDepth=min(spec.depth, DEEPEST), minInstancesPerNode=spec.leaf,
        featureSubsetStrategy="sqrt", maxBins=spec.bins, seed=spec.seed,
        maxMemoryInMB=512, cacheNodeIds=spec.depth > 8, checkpointInterval=10,
    )
    assembler = VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, forest]).fit(rows)


def with_score(df, model):
    """Probability of class 1 as ``score``."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def with_prediction(df, model, threshold):
    """Score and decision at the saved threshold (never at one half by default)."""
    return with_score(model_input(df), model).withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def forest_of(model):
    return model.stages[-1]


def importances(spark, model):
    return ranked_importances(spark, list(MODEL_FEATURES), [float(v) for v in forest_of(model).featureImportances.toArray()])


@dataclass(frozen=True)
class Bundle:
    """A fitted model with everything needed to use it the same way again."""

    model: PipelineModel
    threshold: float
    window_seconds: float = WINDOW_SECONDS
    features: tuple = MODEL_FEATURES
    schema_version: int = 1
    first_interval: float = FIRST_INTERVAL

    def check(self):
        forest = forest_of(self.model)
        if self.schema_version != 1 or tuple(self.features) != MODEL_FEATURES:
            raise DataError("unknown model format or feature order")
        if forest.numFeatures != len(MODEL_FEATURES):
            raise DataError("the model does not take the ten features")
        if forest.numClasses != 2:
            raise DataError("the model must know the classes 0 and 1")
        if not 0 < self.threshold < 1:
            raise DataError("the threshold must lie between 0 and 1")
        return self


def save_bundle(spark, bundle, path):
    """Model and manifest side by side; an existing path is refused."""
    bundle.check()
    facts = {name: getattr(bundle, name) for name in bundle.__dataclass_fields__ if name != "model"}
    facts["features"] = list(bundle.features)
    bundle.model.write().save(f"{path}/{MODEL}")
    spark.createDataFrame(
        [tuple(facts.values())],
        "threshold double, window_seconds double, features array<string>, schema_version int, first_interval double",
    ).write.mode("errorifexists").parquet(f"{path}/{MANIFEST}")


def load_bundle(spark, path):
    facts = spark.read.parquet(f"{path}/{MANIFEST}").first().asDict()
    facts["features"] = tuple(facts["features"])
    return Bundle(model=PipelineModel.load(f"{path}/{MODEL}"), **facts).check()
