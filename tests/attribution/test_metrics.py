import numpy as np
import pytest

from gradloom.functions import stats
from gradloom.operators import metrics, retrain


def long(spark, m, names):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], f"{names[0]} int, {names[1]} int, {names[2]} double")


def test_lds_golden(spark):
    scores = long(spark, np.array([[0.1, 0.2, 0.3, 0.4], [0.2, 0.1, 0.3, 0.4]]).T, ("train_id", "test_id", "score"))
    truth = long(spark, [[0.3, 0.3], [0.4, 0.4], [0.5, 0.3]], ("subset_id", "test_id", "value"))
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (2, 2)], "subset_id int, train_id int")
    got = {r.test_id: (r.corr, r.p) for r in metrics.lds(scores, members, truth).collect()}
    assert np.allclose([got[0], got[1]], [(1.0, 0.0), (0.8660254, 0.3333333)], atol=1e-6)


def test_loo_golden(spark):
    scores = long(spark, [[0.1, 0.4], [0.2, 0.3], [0.3, 0.2], [0.4, 0.1]], ("train_id", "test_id", "score"))
    truth = long(spark, [[1, 1], [2, 3], [3, 2], [4, 4]], ("train_id", "test_id", "value"))
    got = {r.test_id: (r.corr, r.p) for r in metrics.loo_correlation(scores, truth).collect()}
    assert np.allclose([got[0], got[1]], [(1.0, 0.0), (-0.8, 0.2)], atol=1e-6)


@pytest.mark.parametrize("noisy,want", [(range(90, 100), 1.0), (range(80, 90), 8 / 9)])
def test_auc_golden(spark, noisy, want):
    rows = spark.createDataFrame([(i, float(i), int(i in noisy)) for i in range(100)], "id int, score double, noisy int")
    assert np.isclose(metrics.detection_auc(rows).first().auc, want)
    curve = {r.checked: r.found for r in metrics.found_curve(rows, 10).collect()}
    assert curve[100] == 10 and curve[10] == (10 if want == 1 else 0)
    assert metrics.detection_auc(rows.limit(0)).first().auc is None


def test_correlation_p():
    assert np.isclose(stats.correlation_p(0.5, 10), 0.1411, atol=1e-4)
    assert stats.correlation_p(1.0, 5) == 0 and np.isnan(stats.correlation_p(0.3, 2))


def test_brittleness(spark):
    train = spark.createDataFrame([(i, [float(i % 2), 0.0], i % 2) for i in range(8)], "id long, x array<double>, y int")
    test = spark.createDataFrame([(100, [0.9, 0.0], 1)], "id long, x array<double>, y int")
    scores = spark.createDataFrame([(i, 100, float(i % 2)) for i in range(8)], "train_id long, test_id long, score double")
    assert [tuple(r) for r in metrics.centroid_brittleness(scores, train, test, [0, 2, 4, 6]).collect()] == [(100, 4)]


def test_leave_one_out_and_sample(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "id int, g string, v double")
    assert {r.id: r["mean"] for r in retrain.leave_one_out_means(df, "v", "g").collect()} == {1: 3.0, 2: 1.0, 3: None}
    assert {r.id: r["mean"] for r in retrain.leave_one_out_means(df, "v").collect()} == {1: 4.0, 2: 3.0, 3: 2.0}
    rows = spark.range(500).selectExpr("id", "cast(id % 3 as int) as label")
    got = retrain.stratified_sample(rows, "label", 0.2, 1)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 34, 1: 34, 2: 34}
