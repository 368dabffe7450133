import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.operators import block_influence, influence, pairs, projections, representer, shapley, solvers, tracin, trajectory, trak
from gradloom.operators.tasks import MLPTask, SoftmaxTask, flat, softmax_rows

C, D, N = 3, 4, 40


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    y = r.integers(0, C, N)
    x = r.normal(size=(N, D)) + y[:, None]
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], int(y[i])) for i in range(N)], "vec_id long, embedding array<double>, label int").repartition(3).cache()
    return df, np.concatenate((x, np.ones((N, 1))), axis=1), y


def grads(x, y, w):
    e = softmax_rows(x @ w.T) - np.eye(C)[y]
    return np.einsum("ic,id->icd", e, x).reshape(len(x), -1)


def matrix(df, n=N, m=None):
    out = np.full((n, m or n), np.nan)
    for a, b, s in df.select("train_id", "test_id", "score").collect():
        out[a, b] = s
    return out


@pytest.fixture(scope="module")
def task(data):
    return SoftmaxTask(C, D).train(data[0], 2, 0.5)


def test_training_steps(data, task):
    _, x, y = data
    w = np.zeros((C, D + 1))
    for got in task.checkpoints:
        assert np.allclose(got, w)
        w = w - 0.5 * grads(x, y, w).mean(axis=0).reshape(w.shape)


@pytest.mark.parametrize("cosine", [False, True])
def test_tracin(data, task, cosine, monkeypatch):
    df, x, y = data
    monkeypatch.setattr(pairs, "BLOCK_BYTES", 700)  # several blocks of test rows
    want = 0
    for w, weight in zip(task.checkpoints, (0.2, 0.3, 0.5)):
        g = grads(x, y, w)
        if cosine:
            g = g / np.linalg.norm(g, axis=1, keepdims=True)
        want = want + weight * g @ g.T
    assert np.allclose(matrix(tracin.tracin(task, df, df, [0.2, 0.3, 0.5], cosine)), want)
    own = dict(tracin.self_tracin(task, df, [0.2, 0.3, 0.5], cosine).collect())
    assert np.allclose([own[i] for i in range(N)], np.diag(want))
    with pytest.raises(ValueError):
        tracin.tracin(task, df, df, [1.0])


def hessian(x, w, reg):
    h = np.zeros((w.size, w.size))
    for p, v in zip(softmax_rows(x @ w.T), x):
        h += np.kron(np.diag(p) - np.outer(p, p), np.outer(v, v))
    return h / len(x) + reg * np.eye(w.size)


@pytest.mark.parametrize("held", [1024, 1])
@pytest.mark.parametrize("kind,how", [("explicit", {}), ("cg", {"max_iter": 30}), ("lissa", {"depth": 150, "scaling": 3.0}), ("arnoldi", {"max_iter": 15, "top_k": 15})])
def test_influence(data, task, kind, how, held, monkeypatch):
    if held == 1 and kind == "lissa":
        how = {"depth": 12, "scaling": 3.0}
    monkeypatch.setattr(influence, "HELD_WIDTH", held)
    df, x, y = data
    w = task.checkpoints[1]
    g, h = grads(x, y, w), hessian(x, w, 0.3)
    test = df.where("vec_id < 4")
    got = matrix(influence.softmax_influence(task, df, test, kind, 0.3, 1, **how), m=4)
    if kind == "lissa" and held == 1:
        v = g[:4].copy()
        for _ in range(12):
            v = g[:4] + v - v @ h / 3.0
        assert np.allclose(got, g @ (v / 3.0).T)
    else:
        assert np.allclose(got, g @ np.linalg.solve(h, g[:4].T), atol=1e-6)


@pytest.mark.parametrize("method", ["l", "theta"])
def test_relatif(data, task, method):
    df, x, y = data
    g, h = grads(x, y, task.checkpoints[0]), hessian(x, task.checkpoints[0], 0.3)
    moved = np.linalg.solve(h, g.T).T
    denom = np.sqrt((g * moved).sum(axis=1)) if method == "l" else np.linalg.norm(moved, axis=1)
    got = matrix(influence.softmax_influence(task, df, df.where("vec_id < 3"), "explicit", 0.3, relatif_method=method), m=3)
    assert np.allclose(got, g @ moved[:3].T / denom[:, None])
    with pytest.raises(ValueError):
        influence.softmax_influence(task, df, df, "arnoldi", 0.3, relatif_method=method)


def test_datainf(data, task):
    df, x, y = data
    g = grads(x, y, task.checkpoints[1])
    want = np.zeros((N, N))
    for j in range(N):
        v = np.mean([(g[j] - (g[j] @ k) * k / (0.1 + k @ k)) / 0.1 for k in g], axis=0)
        want[:, j] = g @ v
    reps = task.reps(df, 1)
    assert np.allclose(matrix(influence.datainf(reps, reps, ["e", "x"], 0.1)), want)
    assert np.allclose(matrix(influence.datainf(flat(reps), flat(reps), ["g"], 0.1)), want)
    with pytest.raises(ValueError):
        influence.datainf(reps, reps, ["e", "x"], 0.0)


def mlp():
    r = np.random.default_rng(5)
    return MLPTask([[r.normal(size=(6, D + 1)) * 0.4, r.normal(size=(C, 7)) * 0.4]])


def test_mlp_gradients(data):
    df, x, y = data
    task = mlp()
    layers = task.checkpoints[0]
    loss = lambda a: -np.log(MLPTask.forward(x, a)[1][np.arange(N), y])
    rows = {(r.id, r.layer): np.outer(r.b, r.a) for r in task.factors(df).collect()}
    for k, name in enumerate(task.names):
        for i, j in ((0, 0), (2, 3)):
            up = [w.copy() for w in layers]
            up[k][i, j] += 1e-6
            numeric = (loss(up) - loss(layers)) / 1e-6
            assert np.allclose([rows[n, name][i, j] for n in range(N)], numeric, atol=1e-4)
    trained = task.train(df, 3)
    assert loss(trained.checkpoints[-1]).mean() < loss(layers).mean()


def test_ekfac(data):
    df, x, y = data
    task = mlp()
    want = np.zeros((N, N))
    for b, a in MLPTask.backward(x, y, task.checkpoints[0]):
        qa, qb = np.linalg.eigh(a.T @ a / N)[1], np.linalg.eigh(b.T @ b / N)[1]
        r = np.einsum("im,id->imd", b @ qb, a @ qa).reshape(N, -1)
        want += r @ (r / ((r**2).mean(axis=0) + 0.1)).T
    assert np.allclose(matrix(influence.ekfac(task, df, df, 0.1)), want)


def test_block_influence_and_compressors(data):
    df, x, y = data
    task = mlp()
    comps = {n: projections.logra(*w.shape, 4, 1, i) for i, (n, w) in enumerate(zip(task.names, task.checkpoints[0]))}
    rows = projections.compress_factors(task.factors(df), comps)
    inv = block_influence.preconditioners(rows, dict.fromkeys(comps, 4), 0.1)
    want = np.zeros((N, N))
    for (b, a), c, name in zip(MLPTask.backward(x, y, task.checkpoints[0]), comps.values(), comps):
        full = np.einsum("ik,id->ikd", b, a)
        g = np.einsum("pk,ikd,qd->ipq", c.left.dense, full, c.right.dense).reshape(N, -1)
        f = g.T @ g / N
        want += g @ np.linalg.inv(f + 0.1 * np.trace(f) / 4 * np.eye(4)) @ g.T
    assert np.allclose(matrix(block_influence.attribute(rows, rows, inv)), want)
    own = dict(block_influence.self_attribute(rows, inv).collect())
    assert np.allclose([own[i] for i in range(N)], np.diag(want))
    with pytest.raises(ValueError):
        projections.logra(3, 4, 5)


def test_trak(data, task):
    df, x, y = data
    p = projections.Projector(C * (D + 1), projections.ProjectionParams(4, "normal", 1))
    tables, correct, kernel, q = [], [], 0, 0
    for k in (0, 1):
        tables.append(projections.project_column(flat(task.reps(df, k)), "g", p))
        correct.append(task.correct_probability(df, k))
        g = grads(x, y, task.checkpoints[k]) @ p.dense.T
        kernel = kernel + g @ np.linalg.inv(g.T @ g + 0.1 * np.eye(4)) @ g.T / 2
        q = q + (1 - softmax_rows(x @ task.checkpoints[k].T)[np.arange(N), y]) / 2
    want = kernel * q[:, None]
    assert np.allclose(matrix(trak.trak(tables, tables, correct, 4, 0.1)), want)
    own = dict(trak.self_trak(tables, correct, 4, 0.1).collect())
    assert np.allclose([own[i] for i in range(N)], np.diag(want))


def test_representer_points_sum_to_logits(data):
    df, x, y = data
    task = SoftmaxTask(C, D)
    theta = representer.refit(task, df, 0.5, 40, 1e-7)
    for k in range(C):
        test = df.withColumn("label", F.lit(k))
        got = matrix(representer.representer_points(task, df, test, theta, 0.5))
        assert np.allclose(got.sum(axis=0), x @ theta[k], atol=1e-3)


def test_trajectory(spark):
    r = np.random.default_rng(2)
    rows, g = [], {}
    for e in range(2):
        for s in range(3):
            for i in range(4):
                g[e, s, i] = r.normal(size=3)
                rows.append((e, s, (s * 4 + i) % 7, 0.1, [float(v) for v in g[e, s, i]]))
    m, want = np.zeros((3, 3)), {}
    for e in (1, 0):
        for s in (2, 1, 0):
            b = 0.1 * np.stack([g[e, s, i] for i in range(4)])
            emb = b - b @ m.T
            for i in range(4):
                key = (e, (s * 4 + i) % 7)
                want[key] = want.get(key, 0) + emb[i]
            m = m + emb.T @ np.stack([g[e, s, i] for i in range(4)])
    got = {(x.epoch, x.id): np.array(x.g) for x in trajectory.trajectory_embeddings(spark.createDataFrame(rows, "epoch int, step int, id long, eta double, g array<double>"), 3).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_shapley_axioms(data):
    df, x, y = data
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    got = matrix(shapley.knn_shapley(rows, rows.where("id < 5"), 3), m=5)
    for j in range(5):
        d = np.round(np.sqrt(((x[:, :-1] - x[j, :-1]) ** 2).sum(axis=1)), 9)
        order = np.lexsort((np.arange(N), d))
        m = (y[order] == y[j]).astype(float)
        v = np.zeros(N)
        v[order[-1]] = m[-1] / N
        for i in range(N - 2, -1, -1):
            v[order[i]] = v[order[i + 1]] + (m[i] - m[i + 1]) / 3 * min(3, i + 1) / (i + 1)
        assert np.allclose(got[:, j], v)
        assert np.isclose(v.sum(), m[:3].mean())


def test_solver_edges():
    m = np.diag([1.0, 2.0, 4.0])
    v = np.array([[1.0, 1, 1], [0, 0, 0]])
    assert np.allclose(solvers.conjugate_gradient(solvers.matrix_product(m), v, 5), v / [1, 2, 4])
    values, vectors = solvers.arnoldi(solvers.matrix_product(m), 3, 3, 2)
    assert np.allclose(values, [4, 2]) and np.allclose(np.abs(vectors @ m @ vectors.T), np.diag([4, 2]), atol=1e-8)
    assert np.allclose(solvers.stable_inverse(m, 0.0), np.linalg.inv(m))


@pytest.mark.parametrize("kind", projections.TYPES)
def test_projections_keep_products(kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(6, 200))
    p = projections.Projector(200, projections.ProjectionParams(50, kind, 9))
    y = p.project(x)
    assert y.shape == (6, p.out_dim) and np.allclose(y, p.project(x[:, :80]) + p.project(x[:, 80:], 80))
    if kind in ("normal", "rademacher", "sjlt"):
        assert np.allclose((y**2).sum(axis=1) / (x**2).sum(axis=1), 1, atol=0.6)


def test_factgrass_is_mask_then_hash():
    r = np.random.default_rng(6)
    b, a = r.normal(size=(5, 10)), r.normal(size=(5, 12))
    c = projections.factgrass(10, 12, 4, 4, 3)
    got = c.compress(b, a)
    kept = np.einsum("ik,id->ikd", b[:, c.left.index], a[:, c.right.index]).reshape(5, -1)
    want = np.zeros((5, 4))
    for j in range(kept.shape[1]):
        want[:, c.second.bucket[j]] += c.second.sign[j] * kept[:, j]
    assert got.shape == (5, 4) and np.allclose(got, want)
    with pytest.raises(ValueError):
        projections.factgrass(10, 12, 3, 4)


def test_partial_sums_are_added_in_a_tree(spark, monkeypatch):
    from gradloom.operators import pairs

    monkeypatch.setattr(pairs, "FAN_IN", 3)
    table = spark.range(0, 240, 1, 24).selectExpr("array(double(id), 1d) as v")
    got = pairs.partial_matrix(table, ["v"], lambda c: c[0].sum(axis=0), (2,))
    assert got.tolist() == [240 * 239 / 2, 240]
    empty = table.where("false")
    assert pairs.partial_matrix(empty, ["v"], lambda c: c[0].sum(axis=0), (2,)).tolist() == [0, 0]


def test_sums_of_parts_shuffle_no_pairs(spark):
    import numpy as np

    from gradloom.operators import pairs

    r = np.random.default_rng(1)
    tables, values = [], []
    for n in (30, 7, 30, 7):
        values.append(r.normal(size=(n, 3)))
        tables.append(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values[-1])], "id long, g array<double>"))
    got = pairs.score_sum(tables[::2], tables[1::2], ["g"], [pairs.dots] * 2, [0.5, 2.0])
    want = 0.5 * values[0] @ values[1].T + 2 * values[2] @ values[3].T
    rows = got.collect()
    assert len(rows) == 210 and all(abs(x.score - want[x.train_id, x.test_id]) < 1e-12 for x in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Exchange")


def test_flips_with_repeated_ids(spark):
    from gradloom.sources.labels import flip_labels

    rows = [(1, i % 10) for i in range(100)]
    got = flip_labels(spark.createDataFrame(rows, "id long, label int"), 0.1, 10).collect()
    assert sum(x.flipped for x in got) == 10 and all((x.label != x.new_label) == x.flipped for x in got)
