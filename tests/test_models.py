"""Matrix products, label trees and linear models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notecode.operators import embedding as E
from notecode.operators import features as X
from notecode.operators import indexing as I
from notecode.operators import linear as L
from notecode.operators import matrix as M
from notecode.operators import ranking as R
from notecode.operators.decomposition import project, truncated_svd
from notecode.operators.skew import hot_keys


def long(spark, dense, row="row_id", col="col_id"):
    r, c = np.nonzero(dense)
    data = [(int(i), int(j), float(dense[i, j])) for i, j in zip(r, c)]
    return spark.createDataFrame(data, f"{row} long, {col} long, val double")


def dense(df, shape, row, col, val="val"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[row], r[col]] = r[val]
    return out


@pytest.fixture(scope="module")
def problem():
    """40 instances, 12 features, 10 labels in two clusters; label j prefers feature j."""
    rng = np.random.default_rng(7)
    x = np.round(rng.random((40, 12)) * (rng.random((40, 12)) < 0.5), 3)
    y = (x[:, :10] > 0.55).astype(float)
    return x, y


def test_matmul_and_vectors(spark, problem):
    x, _ = problem
    b = np.round(np.random.default_rng(1).random((12, 5)), 3)
    bx = long(spark, b, "col_id", "label_id")
    lx = long(spark, x)
    for hot in (None, hot_keys(lx, ["col_id"], 2)):
        assert np.allclose(dense(M.matmul(lx, bx, hot=hot), (40, 5), "row_id", "label_id"), x @ b)
    v = spark.createDataFrame([(j, float(j)) for j in range(12)], "col_id long, val double")
    assert np.allclose([r[1] for r in M.matvec(lx, v).orderBy("row_id").collect()], (x @ np.arange(12))[x.any(axis=1)])
    u = spark.createDataFrame([(i, 1.0) for i in range(40)], "row_id long, val double")
    sums = M.rmatvec(lx, u, add=v).orderBy("col_id").collect()
    assert np.allclose([r[1] for r in sums], x.sum(axis=0) + np.arange(12))


def test_score_pairs_without_common_columns_is_zero(spark, rows):
    x = spark.createDataFrame([(1, 0, 2.0)], "row_id long, col_id long, val double")
    w = spark.createDataFrame([(5, 0, 3.0), (6, 1, 1.0)], "label_id long, col_id long, val double")
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "row_id long, label_id long")
    assert rows(M.score_pairs(x, w, pairs)) == [(1, 5, 6.0), (1, 6, 0.0), (2, 5, 0.0)]


def test_empty_instance_gets_only_the_bias(spark, rows):
    x = spark.createDataFrame([(1, 0, 2.0)], "row_id long, col_id long, val double")
    instances = spark.createDataFrame([(1,), (2,)], "row_id long")
    biased = M.append_bias(x, instances, 0.5, F.lit(9).cast("long"))
    assert rows(biased) == [(1, 0, 2.0), (1, 9, 0.5), (2, 9, 0.5)]


def test_score_all_takes_any_number_of_labels(spark, problem):
    x = long(spark, problem[0])
    w = long(spark, problem[1].T[:, :12], "label_id", "col_id")
    instances = spark.range(40).withColumnRenamed("id", "row_id")
    labels = spark.range(10).withColumnRenamed("id", "label_id")
    assert M.score_all(x, w, instances, labels).count() == 400
    many = spark.range(1500).withColumnRenamed("id", "label_id")
    assert M.score_all(x, w, instances, many).count() == 60_000


def test_clusters_without_weights_are_predicted(spark):
    """A root label whose weights all fell under the threshold keeps its place in the beam."""
    x = spark.createDataFrame([(1, 0, 1.0)], "row_id long, col_id long, val double")
    weights = spark.createDataFrame([(0, 0, 0, 2.0), (1, 10, 0, 1.0)], "level int, label_id long, col_id long, val double")
    clusters = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "level int, label_id long, code long")
    roots = spark.createDataFrame([(0,), (1,)], "label_id long")
    model = L.Model(weights, clusters, 2, 0.0, roots=roots)
    instances = spark.createDataFrame([(1,)], "row_id long")
    for blocks in (False, True):
        found = L.predict_beam(x, model, instances, blocks=blocks)
        assert sorted(r["label_id"] for r in found.collect()) == [10, 11]
    top = L.predict_beam(x, model, instances, max_depth=1)
    assert sorted(r["label_id"] for r in top.collect()) == [0, 1]


def test_zero_cluster_score_keeps_its_labels(spark, rows):
    z = spark.createDataFrame([(1, 0, 0.0)], "row_id long, code long, val double")
    c = spark.createDataFrame([(4, 0), (5, 1)], "label_id long, code long")
    assert rows(M.expand_candidates(z, c)) == [(1, 4, 0, 0.0)]


def test_elementwise(spark, rows):
    kind = "row_id long, col_id long, val double"
    a = spark.createDataFrame([(0, 0, -1.0), (0, 1, 2.0), (1, 0, -3.0)], kind)
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, -2.0), (1, 1, 4.0)], kind)
    assert rows(M.elementwise_add(a, b)) == [(0, 1, 2.0), (1, 0, -5.0), (1, 1, 4.0)]
    assert rows(M.elementwise_max(a, b)) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, -2.0), (1, 1, 4.0)]


def test_tfidf(spark):
    train = spark.createDataFrame([(0, "aa bb aa"), (1, "bb cc"), (2, "")], "row_id long, text string")
    test = spark.createDataFrame([(7, "aa zz"), (8, "zz")], "row_id long, text string")
    terms = X.fit_tfidf(train)
    idf = {r["term"]: r["idf"] for r in terms.collect()}
    assert idf["bb"] == pytest.approx(np.log(4 / 3) + 1) and idf["aa"] == pytest.approx(np.log(4 / 2) + 1)
    values = {(r[0], r[1]): r[2] for r in X.tfidf(X.term_counts(train), terms).collect()}
    norm = np.hypot(2 * idf["aa"], idf["bb"])
    assert values[(0, "aa")] == pytest.approx(2 * idf["aa"] / norm)
    assert [tuple(r) for r in X.tfidf(X.term_counts(test), terms).collect()] == [(7, "aa", 1.0)]


def test_normalise_keeps_zero_rows(spark, rows):
    x = spark.createDataFrame([(0, 0, 0.0), (1, 0, 3.0), (1, 1, 4.0)], "row_id long, col_id long, val double")
    assert rows(X.normalize_rows(x)) == [(0, 0, 0.0), (1, 0, 0.6), (1, 1, 0.8)]


def test_pifa_and_homer(spark, problem):
    x, y = problem
    yl = long(spark, y, "row_id", "label_id")
    sizes = np.maximum(np.sqrt(y.sum(axis=1, keepdims=True)), 1e-12)
    raw = (y / sizes).T @ x
    got = dense(E.pifa(yl, long(spark, x)), (10, 12), "label_id", "col_id")
    assert np.allclose(got, raw / np.linalg.norm(raw, axis=1, keepdims=True))
    assert np.allclose(dense(E.homer(yl), (10, 40), "label_id", "col_id"), y.T)


def test_embed_text_with_an_encoder(spark):
    texts = spark.createDataFrame([(0, "ab"), (1, "cdef")], "label_id long, text string")
    make = lambda: lambda batch: np.array([[len(t), 1.0] for t in batch])
    got = dense(E.embed_text(texts, make), (2, 2), "label_id", "col_id")
    want = np.array([[2.0, 1.0], [4.0, 1.0]])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True))


def test_truncated_svd(spark, problem):
    x, _ = problem
    lx = long(spark, x)
    components, values = truncated_svd(lx, 3, iterations=6, oversample=6)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-3)
    scores = np.array([r["vec"] for r in project(lx, components, 3).collect()])
    assert np.allclose(np.linalg.norm(scores, axis=0), values, rtol=1e-3)


def test_balanced_split_of_seven(spark):
    features = spark.createDataFrame([(i, 0, float(i)) for i in range(7)], "label_id long, col_id long, val double")
    codes = dict(I.balanced_2means(features, 1).collect())
    assert sorted(codes.values()) == [0, 0, 0, 1, 1, 1, 1]
    assert len({codes[i] for i in range(3)}) == 1  # neighbours stay together
    tree = dict(I.kdtree(features, 2, 1).collect())
    assert tree == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3}


def test_two_means_separates_directions(spark):
    data = [(i, int(i >= 4), 1.0 + 0.01 * i) for i in range(8)]
    features = spark.createDataFrame(data, "label_id long, col_id long, val double")
    codes = dict(I.balanced_skmeans(features, 1).collect())
    assert {codes[i] for i in range(4)} != {codes[i] for i in range(4, 8)}
    assert len({codes[i] for i in range(4)}) == 1
    same = dict(I.balanced_skmeans(features.repartition(17), 1).collect())
    assert same == codes


@pytest.mark.parametrize("spherical", [False, True])
def test_nodes_split_in_a_task_equal_those_split_by_joins(spark, spherical):
    rng = np.random.default_rng(12)
    x = np.round(rng.random((41, 6)) * (rng.random((41, 6)) < 0.5), 3)
    features, labels = long(spark, x, "label_id", "col_id"), spark.range(45).withColumnRenamed("id", "label_id")
    whole = dict(I.balanced_2means(features, 2, 6, 3, spherical, labels).collect())
    assert len(whole) == 45 and sorted(np.bincount(list(whole.values()))) == [11, 11, 11, 12]
    assert whole == dict(I.balanced_2means(features, 2, 6, 3, spherical, labels, node_entries=90).collect())


def test_uniform_codes_reach_the_upper_bin_at_the_maximum_only(spark):
    features = spark.createDataFrame([(i, 0, float(i + 1)) for i in range(5)], "label_id long, col_id long, val double")
    codes = dict(I.uniform_codes(features, 2, 1).collect())
    assert sorted(codes.values()) == [0, 0, 0, 0, 1]


def _rows_of(problem):
    x, y = problem
    code = np.arange(10) // 5
    z = np.stack([y[:, code == k].sum(axis=1) for k in (0, 1)], axis=1)
    return x, y, code, z


def _reference(x, t, solver, rounds=20000):
    """Best objective for one label by plain subgradient-free long descent."""
    w = np.zeros(x.shape[1])
    lam = np.linalg.eigvalsh(x.T @ x).max()
    if solver == "L2R_L1LOSS_SVC_DUAL":
        a = np.zeros(len(t))
        for _ in range(rounds):
            a = np.clip(a - (t * (x @ (x.T @ (a * t))) - 1) / lam, 0, 1)
        return x.T @ (a * t)
    for _ in range(rounds):
        f = t * (x @ w)
        if solver == "L2R_LR_DUAL":
            w -= (w - x.T @ (t / (1 + np.exp(f)))) / (1 + 0.25 * lam)
        else:
            g = -2 * x.T @ (t * np.maximum(1 - f, 0))
            if solver == "L1R_L2LOSS_SVC":
                s = 1 / (2 * lam)
                w = w - s * g
                w = np.sign(w) * np.maximum(np.abs(w) - s, 0)
            else:
                w -= (w + g) / (1 + 2 * lam)
    return w


def _loss(x, t, w, solver):
    f = t * (x @ w)
    hinge = np.maximum(1 - f, 0)
    if solver == "L2R_LR_DUAL":
        return 0.5 * w @ w + np.log1p(np.exp(-f)).sum()
    if solver == "L2R_L1LOSS_SVC_DUAL":
        return 0.5 * w @ w + hinge.sum()
    if solver == "L1R_L2LOSS_SVC":
        return np.abs(w).sum() + (hinge**2).sum()
    return 0.5 * w @ w + (hinge**2).sum()


@pytest.mark.parametrize("solver", list(L.SOLVERS))
def test_fit_reaches_the_optimum(spark, problem, solver):
    x, y, code, z = _rows_of(problem)
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    zl = long(spark, z, "row_id", "code")
    fit = L.Fit(solver, threshold=0.0, max_iter=400, tolerance=1e-4)
    w = L.train_linear(long(spark, x), long(spark, y, "row_id", "label_id"), c, zl, fit)
    got = dense(w, (12, 10), "col_id", "label_id")
    rows_ = L.training_rows(long(spark, y, "row_id", "label_id"), c, zl)
    reported = dict(L.objective(long(spark, x), rows_, w, fit).collect())
    for j in range(10):
        use = z[:, code[j]] > 0
        t = np.where(y[use, j] > 0, 1.0, -1.0)
        best = _loss(x[use], t, _reference(x[use], t, solver), solver)
        mine = _loss(x[use], t, got[:, j], solver)
        assert mine <= best * 1.01 + 1e-6
        assert reported[j] == pytest.approx(mine)


@pytest.mark.parametrize("solver", [s for s in L.SOLVERS if s not in L.SMOOTH])
def test_large_clusters_get_the_same_weights(spark, problem, solver):
    """Every cluster is over the limit, so no task sees one whole; the weights are those of the blocks."""
    x, y, code, z = _rows_of(problem)
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    yl, zl, xl = long(spark, y, "row_id", "label_id"), long(spark, z, "row_id", "code"), long(spark, x)
    fit = L.Fit(solver, c_pos=2.0, threshold=0.0, max_iter=3, tolerance=0.05)
    a = dense(L.train_linear(xl, yl, c, zl, fit), (12, 10), "col_id", "label_id")
    b = dense(L.train_linear(xl.repartition(7), yl, c, zl, fit, block_entries=1), (12, 10), "col_id", "label_id")
    assert np.abs(a).max() > 0.01 and np.allclose(a, b, atol=1e-6)


@pytest.mark.parametrize("solver", L.SMOOTH)
def test_certificates_hold(spark, problem, solver):
    """Clusters of many blocks and of one end with the gap asked for, near the same weights."""
    x, y, code, z = _rows_of(problem)
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    yl, zl, xl = long(spark, y, "row_id", "label_id"), long(spark, z, "row_id", "code"), long(spark, x)
    fit = L.Fit(solver, c_pos=2.0, threshold=0.0, max_iter=60, tolerance=1e-9)
    found = {}
    for entries in (250, 500_000):
        w, notes = L.train_certified(xl.repartition(7), yl, c, zl, fit, block_entries=entries)
        notes = {r["label_id"]: r for r in notes.collect()}
        assert sorted(notes) == list(range(10))
        assert all(-1e-9 <= r["gap"] <= 1e-9 * r["objective"] for r in notes.values())
        found[entries] = dense(w, (12, 10), "col_id", "label_id")
        reached = dict(L.objective(xl, L.training_rows(yl, c, zl), w, fit).collect())
        assert all(reached[j] == pytest.approx(notes[j]["objective"]) for j in range(10))
    assert np.allclose(found[250], found[500_000], atol=1e-3)


def test_labels_in_parts_get_the_same_weights(spark, problem, monkeypatch):
    x, y, code, z = _rows_of(problem)
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    yl, zl, xl = long(spark, y, "row_id", "label_id"), long(spark, z, "row_id", "code"), long(spark, x)
    fit = L.Fit(threshold=0.0, max_iter=400, tolerance=1e-9)
    whole = dense(L.train_linear(xl, yl, c, zl, fit), (12, 10), "col_id", "label_id")
    monkeypatch.setattr(L, "BLOCK_CELLS", 1500)
    assert np.allclose(whole, dense(L.train_linear(xl, yl, c, zl, fit), (12, 10), "col_id", "label_id"), atol=1e-3)


def test_top_products_equal_the_whole_product(spark):
    rng = np.random.default_rng(9)
    z, m = np.round(rng.normal(size=(60, 7)) * (rng.random((60, 7)) < 0.6), 2), np.round(rng.pareto(1, (7, 300)) * (rng.random((7, 300)) < 0.7), 2)
    m[5] -= 1.0
    m[6] = 0.5  # ties
    zl, ml = long(spark, z, "row_id", "code"), long(spark, m, "code", "label_id")
    for block_rows in (3, 1000):
        got = M.top_products(zl, ml, 5, 6, block_rows).collect()
        want = R.topk_per_row(M.matmul(zl, ml, "row_id", "code", "label_id").withColumn("score", F.round("val", 6)).drop("val"), 5).collect()
        assert sorted((r["row_id"], r["rank"], r["label_id"], r["score"]) for r in got) == sorted((r["row_id"], r["rank"], r["label_id"], r["score"]) for r in want)


def test_spectral_bound_covers_the_largest_eigenvalue(spark, problem):
    x, _ = problem
    top = np.linalg.eigvalsh(x.T @ x).max()
    bound = L.spectral_bound(long(spark, x))
    assert top <= bound <= 1.5 * top


def test_positive_rows_outside_the_active_clusters_are_not_used(spark, rows):
    y = spark.createDataFrame([(1, 0), (2, 0)], "row_id long, label_id long")
    c = spark.createDataFrame([(0, 0), (1, 0)], "label_id long, code long")
    z = spark.createDataFrame([(1, 0, 1.0), (3, 0, 1.0)], "row_id long, code long, val double")
    assert rows(L.training_rows(y, c, z)) == [(0, 1, 1.0), (0, 3, -1.0), (1, 1, -1.0), (1, 3, -1.0)]


def test_threshold_keeps_equal_weights(spark, rows):
    w = spark.createDataFrame([(0, 0, 0.01), (0, 1, -0.01), (0, 2, 0.0)], "label_id long, col_id long, val double")
    assert len(rows(L.sparsify(w, 0.01))) == 2
    assert len(rows(L.sparsify(w, 0.0))) == 3


def test_blocks_score_like_pairs(spark, problem, rows):
    x, y, code, z = _rows_of(problem)
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    xl, zl = long(spark, x), long(spark, z, "row_id", "code")
    w = long(spark, np.round(np.random.default_rng(3).normal(size=(10, 12)), 3), "label_id", "col_id")
    pairs = M.expand_candidates(zl, c)
    want = pairs.join(M.score_pairs(xl, w, pairs), ["row_id", "label_id"])
    keep = ["row_id", "label_id", "parent_score", F.round("score", 6).alias("score")]
    for entries in (1, 10, 10**6):  # 1 and 10 also cut the labels of a cluster
        assert rows(L.score_blocks(xl, w, c, zl, entries).select(*keep)) == rows(want.select(*keep))


def test_model_chain_and_beam(spark, problem):
    x, y, code, _ = _rows_of(problem)
    instances = spark.range(40).withColumnRenamed("id", "row_id")
    labels = spark.range(10).withColumnRenamed("id", "label_id")
    c = spark.createDataFrame([(j, int(code[j])) for j in range(10)], "label_id long, code long")
    xl = M.append_bias(long(spark, x), instances, 1.0, F.lit(12).cast("long"))
    yl = long(spark, y, "row_id", "label_id")
    fit = L.Fit(threshold=0.0, max_iter=200)
    model = L.train_model(xl, yl, c, labels, instances, fit=fit, bias_col=12)
    assert model.depth == 2
    a = L.predict_beam(xl, model, instances, beam=2, k=3, digits=6).collect()
    b = L.predict_beam(xl, model, instances, beam=2, k=3, blocks=True, digits=6).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 120
    best = {r["row_id"]: r["label_id"] for r in a if r["rank"] == 1}
    judged = [i for i in range(40) if y[i].any()]
    assert np.mean([y[i, best[i]] for i in judged]) > 0.7
    assert L.train_model(xl, yl, c, labels, instances, mode="ranker", fit=fit).depth == 1
    assert L.train_model(xl, yl, c, labels, instances, mode="matcher", fit=fit).depth == 1
    merged = L.merge_models(L.train_model(xl, yl, c, labels, instances, mode="matcher", fit=fit), L.last_level(model))
    assert merged.depth == 2


def test_label_features_dispatch(spark, problem):
    yl = long(spark, problem[1], "row_id", "label_id")
    xl = long(spark, problem[0])
    assert E.label_features("none", yl, xl) is None
    with pytest.raises(ValueError):
        E.label_features("bert", yl, xl)
    with pytest.raises(ValueError):
        E.label_features(xl.withColumnRenamed("row_id", "label_id"), yl, xl, n_labels=3)
