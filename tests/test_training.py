import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import scoring, training
from convoy.operators.features import BASIC_FEATURES, TEMPORAL_FEATURES
from convoy.settings import CLASS_LABELS


@pytest.fixture(scope="module")
def labelled(spark):
    """Classes that the temperature, pressure and voltage deviation tell apart."""
    rnd = random.Random(3)
    data = []
    for i in range(240):
        kind = CLASS_LABELS[i % 4]
        row = {n: rnd.random() for n in TEMPORAL_FEATURES}
        row["avg_engine_temp"] += 10 * (kind == "ENGINE_FAILURE")
        row["avg_trans_oil_pressure"] += 10 * (kind == "TRANSMISSION_FAILURE")
        row["stddev_battery_voltage"] += 10 * (kind == "ELECTRICAL_FAILURE")
        data.append((f"T{i % 12}", i, kind, 5.0 + 10 * (row["avg_battery_voltage"] > 0.5), *[row[n] for n in TEMPORAL_FEATURES]))
    schema = "entity_id string, id int, failure_type string, time_to_failure double, " + ", ".join(f"{n} double" for n in TEMPORAL_FEATURES)
    return spark.createDataFrame(data, schema).withColumn("prediction_timestamp", F.current_timestamp().cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def models(labelled):
    return (
        training.train_classifier(labelled, trees=5, depth=3),
        training.train_ttf_basic(labelled, rounds=2, depth=2),
        training.train_ttf_temporal(labelled, rounds=2, depth=2),
    )


def test_classifier_learns_and_survives_storage(spark, tmp_path, labelled, models, rows):
    classifier = models[0]
    report = training.classification_report(classifier.classify(labelled), "failure_type", "predicted_failure_type")
    assert report.filter("label = 'accuracy'").first().f1_score > 0.95
    classifier.save(str(tmp_path / "classes"))
    loaded = training.FailureClassifier.load(str(tmp_path / "classes"))
    assert loaded.labels == CLASS_LABELS and loaded.features == BASIC_FEATURES
    picked = ["id", "predicted_failure_type"]
    assert rows(loaded.classify(labelled), *picked) == rows(classifier.classify(labelled), *picked)


def test_missing_features_mean_normal_and_zero(labelled, models):
    classifier, basic, _ = models
    holes = labelled.filter("failure_type = 'ENGINE_FAILURE'").limit(2).withColumn(
        "slope_engine_temp", F.when(F.col("id") % 8 == 1, F.lit(None).cast("double")).otherwise(float("nan"))
    )
    assert [r.predicted_failure_type for r in classifier.classify(holes).collect()] == ["NORMAL", "NORMAL"]
    assert [r.predicted_ttf for r in basic.estimate(holes).collect()] == [0.0, 0.0]


def test_hours_are_clamped_and_stored(spark, tmp_path, labelled, models, rows):
    basic = models[1]
    high = training.train_ttf_basic(labelled.withColumn("time_to_failure", F.lit(90.0)), rounds=1, depth=1)
    low = training.train_ttf_basic(labelled.withColumn("time_to_failure", F.lit(0.01)), rounds=1, depth=1)
    assert {r.predicted_ttf for r in high.estimate(labelled).collect()} == {24.0}
    assert {r.predicted_ttf for r in low.estimate(labelled).collect()} == {0.1}
    basic.save(str(tmp_path / "ttf"))
    loaded = training.TtfModel.load(str(tmp_path / "ttf"))
    assert loaded.features == BASIC_FEATURES
    assert rows(loaded.estimate(labelled), "id", "predicted_ttf") == rows(basic.estimate(labelled), "id", "predicted_ttf")


def test_hybrid_routes_each_class_to_its_model(labelled, models):
    scored = scoring.score_hybrid(labelled, *models)
    assert scored.count() == labelled.count()
    used = {(r.predicted_failure_type, r.ttf_model_used, r.predicted_hours_to_failure is None) for r in scored.collect()}
    assert used == {
        ("NORMAL", "none", True), ("ENGINE_FAILURE", "basic_11_features", False),
        ("TRANSMISSION_FAILURE", "basic_11_features", False), ("ELECTRICAL_FAILURE", "temporal_16_features", False),
    }


def test_split_is_exact_per_class(labelled):
    uneven = labelled.filter("failure_type != 'NORMAL' OR id < 44")
    split = training.stratified_split(uneven, "failure_type", F.pmod(F.col("id") * 7919, F.lit(training.SPLIT_MODULUS)), ["id"])
    counts = {r.failure_type: (r.n, r.train) for r in split.groupBy("failure_type").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("train")).collect()}
    assert counts == {kind: (n, int(n * 0.8)) for kind, n in [("NORMAL", 11), *[(k, 60) for k in CLASS_LABELS[1:]]]}
    sides = training.entity_split(labelled).groupBy("entity_id").agg(F.countDistinct("is_train").alias("n"))
    assert sides.filter("n > 1").isEmpty()


def test_report_matches_hand_counts(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")]
    report = {r.label: r for r in training.classification_report(spark.createDataFrame(pairs, "label string, prediction string")).collect()}
    assert (report["a"].precision, report["a"].recall, report["a"].support) == (3 / 4, 3 / 4, 4)
    assert (report["c"].precision, report["c"].recall, report["c"].f1_score) == (0.0, 0.0, 0.0)
    assert (report["d"].precision, report["d"].support) == (0.0, 0)
    assert report["accuracy"].f1_score == 5 / 8
    assert report["macro avg"].precision == pytest.approx((3 / 4 + 2 / 3) / 4)
    assert report["weighted avg"].recall == pytest.approx(5 / 8)


def test_mae_skips_unknown_pairs(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (None, 1.0)], "label double, prediction double")
    assert tuple(training.regression_mae(df).first()) == (1.5, 2)


def test_probes_of_constant_vectors(spark, labelled, models):
    """A vector of zeros and one of large values get a class and hours within the bounds."""
    classifier, basic, temporal = models
    rows = [("p", float(v), *[float(v)] * len(TEMPORAL_FEATURES)) for v in (0, 100)]
    probes = spark.createDataFrame(rows, "entity_id string, v double, " + ", ".join(f"{n} double" for n in TEMPORAL_FEATURES))
    assert all(r.predicted_failure_type in CLASS_LABELS for r in classifier.classify(probes).collect())
    assert all(0.1 <= r.predicted_ttf <= 24 for m in (basic, temporal) for r in m.estimate(probes).collect())


def test_models_without_rows(labelled):
    none = labelled.limit(0)
    assert {r.predicted_failure_type for r in training.train_classifier(none).classify(labelled).collect()} == {"NORMAL"}
    assert {r.predicted_ttf for r in training.train_ttf_basic(none).estimate(labelled).collect()} == {24.0}


def test_plain_split_is_exact(labelled):
    split = training.plain_split(labelled, F.pmod(F.col("id") * 7919, F.lit(training.SPLIT_MODULUS)), ["id"])
    assert split.columns == [*labelled.columns, "is_train"] and split.filter("is_train").count() == 192
