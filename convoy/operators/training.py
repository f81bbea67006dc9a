"""Splitting, fitting, storing and judging the three failure models with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.numeric import any_missing
from convoy.operators.blocks import number_rows
from convoy.operators.features import BASIC_FEATURES, TEMPORAL_FEATURES
from convoy.operators.scoring import BASIC_CLASSES, TTF_HIGH, guarded_ttf
from convoy.settings import CLASS_LABELS

SPLIT_MODULUS = 1_000_003
# Hash values in a range: some 62,500 ranges, so a stratum of any size spreads.
RANGE = 16


def _doubles(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _assembled(df: DataFrame, names: list[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=names, outputCol="_vector", handleInvalid="keep")
    return assembler.transform(_doubles(df, names))


def _filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing features count as 0 in training."""
    return _doubles(df, names).fillna(0.0, subset=names)


def stratified_split(df: DataFrame, stratum: str, order: Column, tie: list[str], fraction: float = 0.8) -> DataFrame:
    """Add ``is_train``: exactly the first ``fraction`` of each stratum in hash order.

    ``order`` is an integer hash in [0, SPLIT_MODULUS). Ranks are taken per hash range and
    carried across ranges, so a stratum holding most rows is still spread over many tasks.
    """
    keyed = df.withColumn("_order", order).withColumn("_range", F.floor(F.col("_order") / RANGE))
    ranked = number_rows(keyed, [stratum], "_range", ["_order", *tie], "_rank")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    return ranked.join(sizes, ranked[stratum].eqNullSafe(sizes[stratum])).select(
        *[ranked[c] for c in df.columns], (F.col("_rank") <= F.col("_size") * fraction).alias("is_train")
    )


def entity_split(df: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Add ``is_train`` per entity, so neighbouring slices never fall on both sides."""
    return df.withColumn("is_train", F.pmod(F.xxhash64("entity_id"), F.lit(1000)) < int(fraction * 1000))


def plain_split(df: DataFrame, order: Column, tie: list[str], fraction: float = 0.8) -> DataFrame:
    """Add ``is_train``: exactly the first ``fraction`` of all rows in hash order."""
    return stratified_split(df.withColumn("_all", F.lit(0)), "_all", order, tie, fraction).drop("_all")


def _write_facts(path: str, **facts: list[str]) -> None:
    """What a stored model needs to be used rightly, as one JSON row beside it."""
    SparkSession.active().createDataFrame([tuple(facts.values())], ", ".join(f"{k} array<string>" for k in facts)).write.mode("overwrite").json(f"{path}/facts")


def _read_facts(path: str, *names: str) -> tuple[list[str], ...]:
    row = SparkSession.active().read.schema(", ".join(f"{n} array<string>" for n in names)).json(f"{path}/facts").first()
    return tuple(list(row[n]) for n in names)


@dataclass
class FailureClassifier:
    """A forest over the basic features; ``labels`` names its classes by number.

    Without any training row there is no forest, and every row counts as the first label.
    """

    model: RandomForestClassificationModel | None
    labels: list[str]
    features: list[str]

    def classify(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "predicted_failure_type"]
        if self.model is None:
            return df.select(*kept, F.lit(self.labels[0]).alias("predicted_failure_type"))
        model = self.model.copy().setFeaturesCol("_vector").setRawPredictionCol("").setProbabilityCol("").setPredictionCol("_class")
        scored = model.transform(_assembled(df, self.features))
        names = F.array(*[F.lit(label) for label in self.labels])
        kind = F.when(any_missing(self.features), "NORMAL").otherwise(names[F.col("_class").cast("int")])
        return scored.select(*kept, kind.alias("predicted_failure_type"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _write_facts(path, labels=self.labels, features=self.features)

    @classmethod
    def load(cls, path: str) -> FailureClassifier:
        labels, features = _read_facts(path, "labels", "features")
        return cls(RandomForestClassificationModel.load(f"{path}/model"), labels, features)


@dataclass
class TtfModel:
    """Boosted regression of hours to failure; without any training row the estimate is the upper bound."""

    model: GBTRegressionModel | None
    features: list[str]

    def estimate(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raw, scored = F.lit(TTF_HIGH), df
        else:
            raw = F.col("_ttf")
            scored = self.model.copy().setFeaturesCol("_vector").setPredictionCol("_ttf").transform(_assembled(df, self.features))
        return scored.select(*df.columns, guarded_ttf(raw, self.features).alias("predicted_ttf"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _write_facts(path, features=self.features)

    @classmethod
    def load(cls, path: str) -> TtfModel:
        (features,) = _read_facts(path, "features")
        return cls(GBTRegressionModel.load(f"{path}/model"), features)


def train_classifier(train: DataFrame, trees: int = 100, depth: int = 6, labels: list[str] = CLASS_LABELS) -> FailureClassifier:
    """One forest for all classes; rows of other labels are left out."""
    number = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("failure_type")) - 1
    rows = _filled(train, BASIC_FEATURES).withColumn("_label", number.cast("double")).filter("_label >= 0")
    if rows.isEmpty():
        return FailureClassifier(None, list(labels), list(BASIC_FEATURES))
    learner = RandomForestClassifier(featuresCol="_vector", labelCol="_label", numTrees=trees, maxDepth=depth, seed=42)
    return FailureClassifier(learner.fit(_assembled(rows, BASIC_FEATURES).select("_vector", "_label")), list(labels), list(BASIC_FEATURES))


def _train_ttf(train: DataFrame, features: list[str], rounds: int, depth: int, rate: float) -> TtfModel:
    ready = _assembled(_filled(train, features), features).select(
        "_vector", F.coalesce("time_to_failure", F.lit(0.0)).alias("_label")
    )
    if ready.isEmpty():
        return TtfModel(None, list(features))
    learner = GBTRegressor(featuresCol="_vector", labelCol="_label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42)
    return TtfModel(learner.fit(ready), list(features))


def train_ttf_basic(train: DataFrame, rounds: int = 100, depth: int = 5, rate: float = 0.1) -> TtfModel:
    return _train_ttf(train.filter(F.col("failure_type").isin(BASIC_CLASSES)), BASIC_FEATURES, rounds, depth, rate)


def train_ttf_temporal(train: DataFrame, rounds: int = 120, depth: int = 6, rate: float = 0.08) -> TtfModel:
    return _train_ttf(train.filter(F.col("failure_type") == "ELECTRICAL_FAILURE"), TEMPORAL_FEATURES, rounds, depth, rate)


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    Rows are reduced to the confusion matrix first; all else works on at most classes² rows.
    A ratio with an empty base is 0.
    """
    confusion = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    )

    def ratio(top: Column, base: Column) -> Column:
        return F.when(base > 0, top / base).otherwise(0.0)

    precision, recall = F.col("precision"), F.col("recall")
    per_class = (
        sides.groupBy(F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "guessed", "hits")])
        .withColumn("precision", ratio(F.col("hits"), F.col("guessed")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1_score", ratio(2 * precision * recall, precision + recall))
    )
    measures = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    overall = per_class.agg(
        total.alias("support"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
    )
    unknown = F.lit(None).cast("double")
    summary = overall.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), unknown.alias("precision"), unknown.alias("recall"), F.col("accuracy").alias("f1_score"), "support"),
                F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{m}").alias(m) for m in measures], "support"),
                F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{m}").alias(m) for m in measures], "support"),
            )
        ).alias("r")
    ).select("r.*")
    return per_class.select("label", *measures, "support").unionByName(summary)


def regression_mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean absolute error over rows where both sides are known."""
    known = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return known.agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"), F.count(F.lit(1)).alias("row_count"))
