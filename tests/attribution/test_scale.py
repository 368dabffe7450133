"""What a task holds, and what is shuffled, when many training rows meet many test rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.operators import block_influence, influence, metrics, pairs, representer, shapley, tracin, trajectory, trak
from gradloom.operators.tasks import MLPTask, SoftmaxTask
from gradloom.plans import queries

SMALL = "/root/testdata/sf0.001"
TESTS, TRAIN = 2100, 300


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    """300 training and 2,100 test rows, each table in one partition."""
    r = np.random.default_rng(4)

    def rows(n):
        return spark.createDataFrame([(i, v.tolist(), int(v[0] > 0)) for i, v in enumerate(r.normal(size=(n, 2)))], "vec_id long, embedding array<double>, label int").coalesce(1).cache()

    return rows(TRAIN), rows(TESTS)


@pytest.fixture
def frames(spark, monkeypatch):
    """Fails a task that yields more than 262,144 pairs or, for several training rows, 1,024 test rows at once."""
    kind = type(spark.range(1))
    plain = kind.mapInPandas

    def watched(self, f, schema, *a, **k):
        def run(batches):
            for out in f(batches):
                if "test_id" in out and "train_id" in out:
                    assert len(out) <= 1 << 18 and (out["test_id"].nunique() <= 1024 or out["train_id"].nunique() == 1), len(out)
                yield out

        return plain(self, run, schema, *a, **k)

    monkeypatch.setattr(kind, "mapInPandas", watched)


def vectors(df):
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("g"))


BOUNDED = {
    "datainf": lambda t, a, b: influence.datainf(vectors(a), vectors(b), ["g"], 0.1),
    "if_conjugate_gradient": lambda t, a, b: influence.fisher_influence(vectors(a), vectors(b), 2, "cg", 0.01),
    "if_summed_batches": lambda t, a, b: influence.fisher_influence(vectors(a).withColumn("batch", F.col("id") % 4), vectors(b), 2, regularization=0.01, batch_col="batch"),
    "if_arnoldi": lambda t, a, b: influence.fisher_influence(vectors(a), vectors(b), 2, "arnoldi", 0.01, max_iter=2, top_k=2),
    "if_lissa": lambda t, a, b: influence.fisher_influence(vectors(a), vectors(b), 2, "lissa", 0.01, depth=10, scaling=20.0),
    "if_explicit": lambda t, a, b: influence.fisher_influence(vectors(a), vectors(b), 2, "explicit", 0.01),
    "representer_points": lambda t, a, b: representer.representer_points(t, a, b, t.checkpoints[0]),
    "relatif_theta": lambda t, a, b: influence.fisher_influence(vectors(a), vectors(b), 2, "explicit", 0.01, "theta"),
    "logra": lambda t, a, b: block_influence.attribute(*[vectors(x).withColumn("layer", F.explode(F.array(F.lit("p"), F.lit("q")))) for x in (a, b)], {"p": np.eye(2), "q": np.eye(2)}),
    "trak_dropout": lambda t, a, b: trak.trak([vectors(a)] * 2, [vectors(b)] * 2, [t.correct_probability(a)] * 2, 2, 0.1),
    "grad_cosine": lambda t, a, b: tracin.grad_cosine(t, a, b),
    "tracin": lambda t, a, b: tracin.tracin(t, a, b, [0.5, 0.5]),
    "ekfac": lambda t, a, b: influence.ekfac(MLPTask([[np.ones((2, 3)), np.eye(2, 3)]]), a, b, 0.1),
}


@pytest.mark.parametrize("name", BOUNDED)
def test_frames_are_bounded(wide, frames, name):
    task = SoftmaxTask(2, 2, [np.zeros((2, 3)), np.ones((2, 3))] if name == "tracin" else [])
    found = BOUNDED[name](task, *wide)
    assert found.agg(F.count("score"), F.countDistinct("train_id"), F.countDistinct("test_id")).first()[:] == (TRAIN * TESTS, TRAIN, TESTS)


def test_tiles_are_put_in_place(spark, wide):
    """Tiles and steps of a score, summed over parts with repeated ids, against one product."""
    a, b = (vectors(x) for x in wide)
    a, b = a.unionByName(a.where("id < 7")), b.unionByName(b.where("id % 100 = 99"))
    got = pairs.score_sum([a, a], [b, b], ["g"], [pairs.dots] * 2, [0.25, 0.5]).toPandas()
    x, y = (np.zeros((n, 2)) for n in (TRAIN, TESTS))
    for m, t in ((x, a), (y, b)):
        for r in t.collect():
            m[r.id] += r.g
    assert len(got) == TRAIN * TESTS and np.allclose(got["score"], (0.75 * x @ y.T)[got["train_id"], got["test_id"]])


def test_training_rows_are_dealt_out(wide, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 40_000)
    found = influence.fisher_influence(*map(vectors, wide), 2, "explicit", 0.01, "l")
    assert found.rdd.getNumPartitions() == 16 and found.count() == TRAIN * TESTS


def test_relatif_joins_nothing(wide):
    a, b = map(vectors, wide)
    found = influence.fisher_influence(a, b.where("id < 4"), 2, "explicit", 0.01, "l")
    assert "Join" not in plan_of(found) and "Exchange" not in plan_of(found)
    g = np.array([r.g for r in a.orderBy("id").collect()])
    h = np.array([r.g for r in b.where("id < 4").orderBy("id").collect()])
    inv = np.linalg.inv(g.T @ g / len(g) + 0.01 * np.eye(2))
    got = found.toPandas()
    want = g @ inv @ h.T / np.sqrt(((g @ inv) * g).sum(axis=1))[:, None]
    assert np.allclose(got["score"], want[got["train_id"], got["test_id"]])


def test_summed_batches_hold_no_batch(wide):
    """Each batch's matrix comes of partial sums; the result is that of the batches' own rows."""
    a, b = (vectors(x) for x in wide)
    a = a.repartition(3).withColumn("batch", F.col("id") % 4)
    got = influence.fisher_influence(a, b.where("id < 3"), 2, regularization=0.01, batch_col="batch")
    own = a.toPandas()
    total = sum(np.linalg.inv(m.T @ m / len(m) + 0.01 * np.eye(2)) for m in (np.array(x["g"].tolist()) for _, x in own.groupby("batch")))
    g = np.array(own.sort_values("id")["g"].tolist())
    h = np.array([r.g for r in b.where("id < 3").orderBy("id").collect()])
    got = got.toPandas()
    assert np.allclose(got["score"], (g @ total @ h.T)[got["train_id"], got["test_id"]])
    inverses = influence._batch_inverses(a, "batch", 2, 0.01)
    assert plan_of(inverses).index("Exchange") < plan_of(inverses).index("MapInPandas")  # only sums reach a batch's task


def test_trajectory_shuffles_no_pairs(spark):
    r = np.random.default_rng(3)
    e = spark.createDataFrame([(k, i, r.normal(size=2).tolist()) for k in range(3) for i in range(5)], "epoch int, id long, g array<double>")
    t = spark.createDataFrame([(i, r.normal(size=2).tolist()) for i in (0, 1, 1)], "id long, g array<double>")
    found = trajectory.attribute(e, t)
    assert plan_of(found).index("MapInPandas") < plan_of(found).index("Exchange")
    x = np.zeros((5, 2))
    for row in e.collect():
        x[row.id] += row.g
    y = np.zeros((2, 2))
    for row in t.collect():
        y[row.id] += row.g
    rows = found.collect()
    assert len(rows) == 10 and all(np.isclose(z.score, x[z.train_id] @ y[z.test_id]) for z in rows)


@pytest.mark.parametrize("name", [str, int])
def test_shapley_ranks_without_shuffling_pairs(spark, name):
    """More rows than a file's batch, in several files, with many equal distances, against the definition."""
    n, k = 1500, 4
    r = np.random.default_rng(8)
    x, y = r.integers(0, 6, size=(n, 2)).astype(float), r.integers(0, 3, n)
    ids = sorted(name(i) for i in range(n))
    kind = "string" if name is str else "long"
    rows = spark.createDataFrame([(ids[i], x[i].tolist(), int(y[i])) for i in r.permutation(n)], f"id {kind}, x array<double>, y int").repartition(5)
    found = shapley.knn_shapley(rows, rows.where(F.col("id").isin([ids[0], ids[700]])), k)
    assert "Window" not in plan_of(found) and plan_of(found).index("MapInPandas") < plan_of(found).index("Exchange")
    got = {(a, b): s for a, b, s in found.collect()}
    assert len(got) == 2 * n
    for t in (0, 700):
        order = np.lexsort((np.arange(n), np.round(np.sqrt(((x - x[t]) ** 2).sum(axis=1)), 9)))
        m, v = (y[order] == y[t]).astype(float), np.zeros(n)
        v[-1] = m[-1] / n
        for i in range(n - 2, -1, -1):
            v[i] = v[i + 1] + (m[i] - m[i + 1]) / k * min(k, i + 1) / (i + 1)
        assert np.allclose([got[ids[i], ids[t]] for i in order], v)


def test_shapley_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, [0.0], 1)], "id long, x array<double>, y int")
    assert shapley.knn_shapley(rows.limit(0), rows, 3).count() == shapley.knn_shapley(rows, rows.limit(0), 3).count() == 0


def test_top_pairs(wide, monkeypatch):
    """With ties, several partitions, blocks and narrowings, as the window over all pairs."""
    a, b = (vectors(x).withColumn("g", F.transform("g", lambda v: F.floor(v))).withColumn("g", F.col("g").cast("array<double>")) for x in wide)
    a = a.repartition(3)
    want = metrics.top_ranked(pairs.score_pairs(a, b, ["g"]), 7)
    monkeypatch.setattr(pairs, "TOP_HELD", 3000)
    top = pairs.top_pairs(a, b, ["g"], 7)
    assert top.count() <= 3 * 7 * TESTS
    got = metrics.top_ranked(top, 7)
    assert got.count() == 7 * TESTS and got.exceptAll(want).count() == 0


def test_subset_totals(spark, wide):
    a, b = (vectors(x) for x in wide)
    a = a.unionByName(a.where("id < 3"))
    members = spark.createDataFrame([(s, i) for s in (2, 5) for i in range(TRAIN) if i % 3 != s % 3] + [(5, 1)], "subset_id int, train_id long")
    want = metrics.subset_sums(pairs.score_pairs(a, b, ["g"]), members).withColumnRenamed("total", "w")
    both = pairs.subset_totals(a, members, b, ["g"]).join(want, ["subset_id", "test_id"])
    assert both.count() == 2 * TESTS and both.agg(F.max(F.abs(F.col("total") - F.col("w")))).first()[0] < 1e-9


def test_correlations_far_from_zero(wide):
    """Moments joined over steps, tiles and tasks lose no digits to a large mean."""
    a, b = (vectors(x) for x in wide)
    score, value = pairs.dots, lambda c, t: 1e8 - ((c[0][:, None] - t[0][None]) ** 2).sum(axis=2)
    got = {r.test_id: (r.corr, r.p) for r in metrics.loo_correlation_of(a.repartition(3), b, ["g"], score, value).collect()}
    g, h = (np.array([r.g for r in t.orderBy("id").collect()]) for t in (a, b))
    s, v = g @ h.T, -((g[:, None] - h[None]) ** 2).sum(axis=2)
    assert len(got) == TESTS and all(abs(got[j][0] - np.corrcoef(s[:, j], v[:, j])[0, 1]) < 1e-6 for j in range(TESTS))
    flat = metrics.loo_correlation_of(a, b.where("id = 0"), ["g"], score, lambda c, t: np.ones((len(c[0]), len(t[0])))).first()
    assert np.isnan(flat["corr"])


@pytest.mark.parametrize("name", ["loo_correlation", "lds", "brittleness", "strongest_influence"])
def test_queries_that_list_no_pairs(spark, monkeypatch, name):
    """They ask a little of each test row, so the pairs never leave the tasks that form them."""

    def refuse(*a, **k):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(pairs, "score_pairs", refuse)
    assert queries.QUERIES[name](spark, SMALL).count() == 10
