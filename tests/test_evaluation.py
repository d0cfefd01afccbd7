import math

import pytest
from pyspark.sql import functions as F

from notecode.functions import scores as Q
from notecode.operators import ensembling as N
from notecode.operators import evaluation as V

PRED = "row_id long, label_id long, score double"
PAIRS = "row_id long, label_id long"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_transforms(spark):
    assert value(spark, Q.sigmoid(F.lit(0.0))) == 0.5
    assert value(spark, Q.log_sigmoid(F.lit(-800.0))) == -800.0
    assert value(spark, Q.lp_hinge(3)(F.lit(2.0))) == 1.0
    assert value(spark, Q.lp_hinge(2)(F.lit(0.0))) == pytest.approx(math.exp(-1))
    assert value(spark, Q.COMBINERS["noisyor"](F.lit(0.5), F.lit(0.5))) == 0.75
    assert Q.post_processor(True).transform is not None
    with pytest.raises(ValueError):
        Q.post_processor("l9-hinge")
    with pytest.raises(ValueError):
        Q.transform_prediction(F.lit(0.0), "other")


@pytest.fixture
def case(spark):
    truth = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], PAIRS)
    pred = spark.createDataFrame([(1, 5, 0.9), (1, 9, 0.8), (2, 8, 0.7), (2, 7, 0.6), (3, 1, 0.5)], PRED)
    instances = spark.createDataFrame([(1,), (2,), (3,), (4,)], "row_id long")
    return truth, pred, instances


def test_short_predictions_divide_by_k(case):
    truth, pred, instances = case
    m = {r["k"]: r for r in V.precision_recall_at_k(truth, pred, instances, 5).collect()}
    assert [m[k]["precision"] for k in (1, 2, 5)] == pytest.approx([1 / 4, 2 / 8, 2 / 20])
    assert m[1]["recall"] == pytest.approx(0.5 / 2) and m[5]["recall"] == pytest.approx(1.5 / 2)


def test_empty_truth_options(case):
    truth, pred, instances = case
    zero = V.precision_recall_at_k(truth, pred, instances, 1, "zero").first()
    assert zero["recall"] == pytest.approx(0.5 / 4)
    assert math.isnan(V.precision_recall_at_k(truth, pred, instances, 1, "nan").first()["recall"])
    with pytest.raises(ValueError):
        V.precision_recall_at_k(truth, pred, instances, 1, "drop")


def test_round_robin_interleaves(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], PRED)
    b = spark.createDataFrame([(1, 20, 0.3), (1, 21, 0.2)], PRED)
    order = [r["label_id"] for r in N.ensemble_round_robin(a, b).orderBy(F.desc("score")).collect()]
    assert order == [10, 20, 11, 21]
    mean = {r["label_id"]: r["score"] for r in N.ensemble_average(a, b).collect()}
    assert mean[10] == pytest.approx(0.45)
    ranked = {r["label_id"]: r["score"] for r in N.ensemble_rank_average(a, b).collect()}
    assert ranked == {10: 1.0, 11: 0.5, 20: 1.0, 21: 0.5}


def test_compare_ensembles_lists_all_models(case):
    truth, pred, instances = case
    out = N.compare_ensembles(truth, {"a": pred, "b": pred}, instances, 2)
    assert {r["model"] for r in out.select("model").distinct().collect()} == {"a", "b", "average", "rank_average", "round_robin"}


def test_hinge_loss_counts_absent_cells(spark):
    instances = spark.createDataFrame([(1,), (2,)], "row_id long")
    labels = spark.createDataFrame([(0,), (1,)], "label_id long")
    pred = spark.createDataFrame([(1, 0, 0.5)], PRED)
    truth = spark.createDataFrame([(1, 0), (2, 1)], PAIRS)
    # cells: hit at 0.5, missed truth, two absent negatives
    assert V.hinge_loss(pred, truth, instances, labels).first()["loss"] == pytest.approx((0.25 + 1 + 1 + 1) / 4)


def test_classification_scores(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "truth int, predicted int")
    r = V.classification_scores(pairs).first()
    assert (r["accuracy"], r["jaccard"]) == pytest.approx((0.75, (0.5 * 2 + 2 / 3 * 2) / 4))
    assert r["fbeta"] == pytest.approx((2 / 3 * 2 + 0.8 * 2) / 4)
