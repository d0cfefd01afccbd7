"""Whole results of the matrix queries on small tables of their own, and plans that stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import labels, matrices, rankings, views
from notecode.functions.scores import post_processor
from notecode.operators import baseline as B
from notecode.operators import blocks
from notecode.operators import embedding as E
from notecode.operators import ensembling as N
from notecode.operators import evaluation as V
from notecode.operators import indexing as I
from notecode.operators import linear as L
from notecode.operators import matrix as M
from notecode.operators import ranking as R
from notecode.operators import skew
from notecode.operators.decomposition import normal_row, random_normal
from notecode.session import checkpointed, materialised


@pytest.fixture
def bought(spark, tmp_path):
    """Orders, items and parts of three customers."""
    spark.createDataFrame(
        [(1, 1, 10.0, "1995-01-03"), (2, 1, 20.0, "1995-01-05"), (3, 2, 30.0, "1995-02-07"), (4, 3, 5.0, "1995-02-07")],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string",
    ).selectExpr("o_orderkey", "o_custkey", "o_totalprice", "CAST(o_orderdate AS DATE) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [(1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (3, 0), (4, 3)], "l_orderkey long, l_partkey long"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(0, "A", "x", 1), (1, "A", "y", 2), (2, "B", "x", 3), (3, None, "x", 3)], "p_partkey long, p_brand string, p_type string, p_size int"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_feature_format_keeps_every_entry(spark, bought):
    found = matrices.feature_format(spark, bought)
    assert found.columns == ["row_id", "col_id", "val", "format"]
    counts = {r["format"]: r["count"] for r in found.groupBy("format").count().collect()}
    assert counts == {0: 10, 1: 6, 2: 4, 3: 10, 4: 6}


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def cells(df, *keys):
    return sorted((tuple(r[k] for k in keys) + (round(r[df.columns[-1]], 9),) for r in df.collect()), key=repr)


def entries(spark):
    a = spark.createDataFrame([(1, 7, 2.0), (1, 8, 1.0), (2, 8, -1.0), (None, 7, 3.0), (2, None, 9.0)], "row_id long, inner long, val double")
    b = spark.createDataFrame([(7, "p", 1.0), (7, None, 2.0), (8, "p", 3.0), (8, "q", None), (9, "r", 1.0)], "inner long, col_id string, val double")
    return a, b


def test_packed_products_equal_joined_ones(spark, monkeypatch):
    a, b = entries(spark)
    want = sorted(M.joined_products(a, b, "row_id", "inner", "col_id").collect(), key=repr)
    assert sorted(M.matmul(a, b, "row_id", "inner", "col_id").collect(), key=repr) == want
    monkeypatch.setattr(M, "FREQUENT", 1)  # row 1 and row 2 are summed from all tasks
    assert sorted(M.matmul(a, b, "row_id", "inner", "col_id").collect(), key=repr) == want


def test_products_are_not_shuffled_by_cell(spark):
    a, b = entries(spark)
    rest, _ = M.packed_products(a, b, "row_id", "inner", "col_id")
    assert "hashpartitioning(row_id#" in plan(rest)
    assert not [x for x in plan(rest).splitlines() if "Exchange hashpartitioning(row_id#" in x and "col_id#" in x]


@pytest.mark.parametrize("cells_", [0, 10**6])
def test_pairs_in_groups_score_like_joins(spark, monkeypatch, cells_):
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(int(i), f"c{j}", float(i + j)) for i in range(9) for j in rng.choice(12, 4, False)] + [(1, None, 5.0), (2, "c0", None)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(int(k), f"c{j}", float(k - j)) for k in range(5) for j in rng.choice(14, 6, False)] + [(0, "c1", 1.5), (0, "c1", 1.5)], "label_id long, col_id string, val double")
    pairs = spark.createDataFrame([(i, k) for i in range(11) for k in range(7)] + [(1, 1), (None, 1), (3, None)], "row_id long, label_id long")
    want = cells(M.joined_scores(x, w, pairs), "row_id", "label_id")
    for size in (3, 10**6):  # with 3, every label is dealt to several groups
        monkeypatch.setattr(M, "PAIRS", size)
        monkeypatch.setattr(M, "MAX_CELLS", cells_)
        assert cells(M.score_pairs(x, w, pairs), "row_id", "label_id") == want


def test_labels_of_several_clusters_are_predicted_once(spark):
    x = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(5, "a", 3.0), (6, "b", 1.0)], "label_id long, col_id string, val double")
    c = spark.createDataFrame([(5, 0), (5, 1), (6, 1), (6, 1)], "label_id long, code long")
    z = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.2), (1, 1, 0.2), (2, 1, 1.0)], "row_id long, code long, val double")
    found = {(r["row_id"], r["label_id"], r["score"], r["rank"]) for r in L.predict_with_codes(x, w, c, z, 5).collect()}
    assert found == {(1, 5, 6.0, 1), (1, 6, 0.0, 2), (2, 6, 1.0, 1), (2, 5, 0.0, 2)}
    assert L.predict_with_codes(x, w, c, z, 5).count() == 4


def test_random_rows_equal_the_expression(spark):
    keys = ["Brand#1/x", "", "7"]
    df = spark.createDataFrame([(k, i) for k in keys for i in range(3)], "k string, i int")
    want = {(r["k"], r["i"]): r["g"] for r in df.select("k", "i", random_normal(F.col("k"), F.col("i"), 4).alias("g")).collect()}
    assert all(abs(normal_row(k, 3, 4)[i] - g) < 1e-12 for (k, i), g in want.items())


def test_projection_makes_no_row_for_each_dimension_of_an_entry(spark):
    features = spark.createDataFrame([(1, "a", 2.0), (1, None, 1.0), (2, "a", None), (None, "b", 1.0)], "label_id long, col_id string, val double")
    labels = spark.createDataFrame([(1,), (2,), (3,)], "label_id long")
    found = {(r["label_id"], r["dim"]): r["val"] for r in I.random_projection(features, 2, 0, labels).collect()}
    a, b = normal_row("a", 2, 0), normal_row("b", 2, 0)
    want = {(1, i): round(2 * a[i], 6) for i in range(2)} | {(k, i): 0.0 for k in (2, 3) for i in range(2)} | {(None, i): round(b[i], 6) for i in range(2)}
    assert found == want
    assert "MapInArrow" in plan(I.random_projection(features, 2, 0, labels))


def test_training_rows_are_not_shuffled_after_they_are_expanded(spark):
    y = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "row_id long, label_id long")
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "label_id long, code long")
    z = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0), (None, 1, 1.0)], "row_id long, code long, val double")
    rows = L.training_rows(y, c, z)
    assert sorted(rows.collect(), key=repr) == sorted(
        [(1, 1, 1.0), (2, 1, -1.0), (1, 2, -1.0), (2, 2, 1.0), (3, 2, -1.0), (3, None, -1.0)], key=repr
    )
    assert not [x for x in plan(rows).splitlines() if "Exchange hashpartitioning(row_id#" in x and "label_id#" in x and "_own" in x]


def test_pairs_are_shuffled_once_by_row(spark, bought, monkeypatch):
    monkeypatch.setattr(views, "ITEMS_OF_A_TASK", 2)
    found = views.pairs(spark, bought)
    assert found.count() == len({(r["row_id"], r["label_id"]) for r in found.collect()})
    assert "REPARTITION_BY_NUM" in plan(found)
    assert not [x for x in plan(found).splitlines() if "Exchange hashpartitioning(row_id#" in x and "label_id#" in x]


def test_label_weights_are_unit_rows(spark, bought):
    sizes = E.pifa(views.y(spark, bought), views.x(spark, bought)).groupBy("label_id").agg(F.sum(F.col("val") * F.col("val")).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in sizes.collect())


def test_ensembles_of_rows_in_place_shuffle_nothing(spark, bought, monkeypatch):
    monkeypatch.setattr(views, "ITEMS_OF_A_TASK", 2)
    found = N.ensemble_round_robin(*[views.pred(spark, bought, t) for t in "abc"])
    assert "REPARTITION_BY_NUM" in plan(found)
    assert not [x for x in plan(found).splitlines() if "ENSURE_REQUIREMENTS" in x and "hashpartitioning" in x and "label_id#" in x]
    assert found.count() == views.pairs(spark, bought).count()


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in blocks.mkString("\n").split("\n") if "/shuffle_" in f}


def test_stored_steps_leave_no_shuffle_files(spark):
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffle_files(spark)
    for stored in (materialised(counted), checkpointed(counted), checkpointed(counted)):
        assert shuffle_files(spark) <= before
        assert sum(r["count"] for r in stored.collect()) == 1000
    assert counted.count() == 7


def test_names_are_numbered_as_short_as_they_allow(spark, monkeypatch):
    _, b = entries(spark)
    assert M._coded(b, "inner", "col_id")[0].schema["col_id"].dataType.simpleString() == "smallint"
    monkeypatch.setattr(M, "SHORT", 2)
    assert M._coded(b, "inner", "col_id")[0].schema["col_id"].dataType.simpleString() == "int"


def test_packed_rows_are_sorted_by_value(spark):
    b = spark.createDataFrame([(1, 5, 2.0), (1, 9, 1.0), (1, 3, 2.0), (1, 7, 1.0)], "inner long, col_id long, val double")
    row = M.pack_rows(b, "inner", "col_id").first()
    assert (row["_vals"], row["_cols"]) == ([1.0, 1.0, 2.0, 2.0], [7, 9, 3, 5])


def test_blocks_are_scored_with_numbered_columns(spark):
    x = spark.createDataFrame([(1, "p", 2.0), (1, None, 5.0), (2, "q", 1.0), (3, None, 1.0)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(10, "p", 3.0), (10, None, 7.0), (11, "r", 4.0), (11, "q", 0.5)], "label_id long, col_id string, val double")
    own, weights = M.same_columns(x, w)
    assert {d.schema["col_id"].dataType.simpleString() for d in (own, weights)} == {"smallint"}
    c = spark.createDataFrame([(10, 0), (11, 0), (12, 0)], "label_id long, code long")
    z = spark.createDataFrame([(i, 0, 1.0) for i in (1, 2, 3, 4)], "row_id long, code long, val double")
    found = {(r["row_id"], r["label_id"]): r["score"] for r in L.score_blocks(x, w, c, z).collect()}
    assert len(found) == 12 and {k: s for k, s in found.items() if s} == {(1, 10): 6.0, (2, 11): 0.5}


def test_bought_labels_are_joined_in_as_many_partitions_as_items_need(spark, bought, monkeypatch):
    monkeypatch.setattr(views, "ITEMS_OF_A_TASK", 2)
    asked = [line for line in plan(views._bought(spark, bought)).splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(asked) == 2 and all(", 4), " in line for line in asked)


def test_texts_are_projected_once_for_all_codes(spark):
    texts = spark.createDataFrame([(i, f"word{i % 3} other{i % 2}") for i in range(12)], "row_id long, text string")
    codes = spark.createDataFrame([(i, f"c{i % 3}") for i in range(12)], "row_id long, code string")
    scores = B.kiss_score(texts, B.kiss_train(texts, codes, n_codes=2, rank=2, trees=2))
    assert scores.count() == 24 and "Join" not in plan(scores)


def test_blocks_hold_every_entry_once_and_score_their_labels(spark):
    data = [(i, j, float(i + j + 1)) for i in range(4) for j in range(3)] + [(9, j, 0.5) for j in range(30)]
    features = spark.createDataFrame(data, "label_id long, col_id long, val double")
    members = [(i, 1, 4, 1) for i in range(4)] + [(9, 1, 31, 2), (7, 1, 1, 1)]  # label 9 comes twice, label 7 has no features
    state = spark.createDataFrame(members, "label_id long, node long, _n long, _copies long")
    blocks, known, columns = I._blocks_of(features, state, 20)
    stored = blocks.collect()
    assert sum(len(b["vals"]) for b in stored) == len(data) and len(stored) > 1
    assert known.filter("label_id = 9").count() > 1  # longer than a block
    centre = spark.createDataFrame([(1, j, 1.0 + j) for j in range(40)], "node long, col_id long, _c double")
    scores = {r["_label"]: r["_score"] for r in I._scores(blocks, columns, centre).collect()}
    expected = {i: sum((1.0 + j) * v * (2 if i == 9 else 1) for k, j, v in data if k == i) for i in (0, 1, 2, 3, 9)}
    assert scores == expected


def test_candidates_meet_lists_of_labels(spark, monkeypatch):
    met = []
    plain = M.skew_join
    monkeypatch.setattr(M, "skew_join", lambda big, small, on: met.append(small.count()) or plain(big, small, on))
    z = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.0), (3, 2, 1.0), (4, None, 1.0)], "row_id long, code long, val double")
    c = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, 1)], "label_id long, code long")
    expected = sorted([(1, i, 0, 0.5) for i in range(0, 20, 2)] + [(2, i, 1, 0.0) for i in [*range(1, 20, 2), 3, None]], key=repr)
    found = M.expand_candidates(z, c).select("row_id", "label_id", "code", "parent_score")
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert met == [2]  # a row for each cluster, not for each label
    monkeypatch.setattr(M, "LISTED", 4)
    found = M.expand_candidates(z, c).select("row_id", "label_id", "code", "parent_score")
    assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_embedded_texts_are_cut_into_terms_once(spark, monkeypatch):
    from notecode.operators import embedding, features

    plain, calls = features.term_counts, []
    for module in (embedding, features):
        monkeypatch.setattr(module, "term_counts", lambda *a: calls.append(1) or plain(*a))
    texts = spark.createDataFrame([(1, "a b b c"), (2, "a c"), (3, None), (4, "")], "row_id long, text string")
    got = embedding.hashed_tfidf(texts).collect()
    assert len(calls) == 1
    monkeypatch.undo()
    entries = features.tfidf(features.term_counts(texts), features.fit_tfidf(texts)).collect()
    want = {}
    for r in entries:
        at = (r["row_id"], embedding_column(r["col_id"]))
        want[at] = want.get(at, 0.0) + r["val"]
    norms = {row: sum(v * v for (k, _), v in want.items() if k == row) ** 0.5 for row, _ in want}
    assert {(r["row_id"], r["col_id"]): round(r["val"], 9) for r in got} == {k: round(v / norms[k[0]], 9) for k, v in want.items()}


def embedding_column(term, width=256):
    from notecode.operators.sampling import hash_of

    return hash_of(term, "hash") % width


def test_grid_search_packs_its_blocks_once(spark, bought, monkeypatch):
    calls, packing = [], blocks.blocks_of
    monkeypatch.setattr(blocks, "blocks_of", lambda *a: calls.append(1) or packing(*a))
    found = labels.grid_search(spark, bought).collect()
    assert sorted((r["params"], r["n_k"], r["in_range"]) for r in found) == [(f"c_pos={c},tolerance=0.01", 20, True) for c in (1.0, 2.0)]
    assert len(calls) == 1


def test_stored_blocks_give_the_same_weights(spark, bought):
    x, y, c = labels._training(spark, bought)
    z = L.active_clusters(y, c)
    stored = L.training_blocks(x, y, c, z)
    for fit in (L.Fit(c_pos=2.0), L.Fit("L2R_LR_DUAL")):
        want = cells(L.train_linear(x, y, c, z, fit), "label_id", "col_id")
        assert want and cells(L.train_linear(x, y, c, z, fit, stored=stored), "label_id", "col_id") == want


@pytest.mark.parametrize("at_once", [1, 7, 10**6])
def test_rows_of_a_block_in_turn_sum_like_all_of_them(monkeypatch, at_once):
    rng = np.random.default_rng(5)
    row = {"ends": np.arange(1, 10) * 3, "cols": rng.integers(0, 6, 27), "vals": rng.normal(size=27), "labels": [3, 4], "col_ids": list("abcdef"), "true_at": [0, 5, 11]}
    w = rng.normal(size=(6, 2))
    block = blocks.Block(row, L.Fit(c_pos=3.0, c_neg=0.5))
    monkeypatch.setattr(blocks, "CELLS_AT_ONCE", at_once)
    margin = block.y * (block.dense @ w)
    hinge = np.maximum(1 - margin, 0)
    want = (block.dense.T @ (2 * block.cost * hinge * block.y), (block.cost * hinge**2).sum(0), (2 * block.cost * hinge - block.cost * hinge**2).sum(0))
    for found, expected in zip(block.visit(w), want):
        np.testing.assert_allclose(found, expected, rtol=1e-12)


def test_precision_stays_where_the_rows_are(spark, bought):
    m = V.precision_recall_at_k(views.y(spark, bought), views.pred(spark, bought), views.instances(spark, bought), 3)
    assert not [x for x in plan(m).splitlines() if "Exchange hashpartitioning(row_id#" in x and "label_id#" in x]
    assert len(m.collect()) == 3


def test_precision_with_repeats_and_nulls(spark):
    kind = "row_id long, label_id long"
    truth = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None), (2, 5), (None, 1), (None, None)], kind)
    pred = spark.createDataFrame([(1, 2, 0.9), (1, 2, 0.8), (1, None, 0.7), (2, 4, 0.5), (2, 5, 0.4), (3, 1, 1.0), (None, 1, 2.0), (None, None, 1.0)], kind + ", score double")
    found = V.precision_recall_at_k(truth, pred, spark.createDataFrame([(1,), (2,), (3,)], "row_id long"), 3).orderBy("k").collect()
    # hits: row 1 at ranks 1 and 2 (three true labels, one of them null), row 2 at rank 2 (one true label)
    assert [round(r["precision"], 9) for r in found] == [round(h / 3 / k, 9) for k, h in ((1, 1), (2, 3), (3, 3))]
    assert [round(r["recall"], 9) for r in found] == [round(s / 2, 9) for s in (1 / 3, 5 / 3, 5 / 3)]


def test_ranked_ensembles_are_not_counted(spark, bought, monkeypatch):
    longest = views.pairs(spark, bought).groupBy("row_id").count().agg(F.max("count")).first()[0]
    assert longest <= views.most_pairs(spark, bought)
    asked, rank = [], skew.rank_in_groups
    monkeypatch.setattr(skew, "rank_in_groups", lambda *a, **k: asked.append(k.get("largest")) or rank(*a, **k))
    found = rankings.ensemble_average(spark, bought)
    assert asked == [views.most_pairs(spark, bought)]
    assert found.count() == views.pairs(spark, bought).count()
    assert found.groupBy("row_id").agg(F.max("rank").alias("a"), F.count("*").alias("b")).filter("a <> b").isEmpty()


def test_empty_orders_have_an_empty_ensemble(spark, bought, tmp_path):
    for name in ("orders", "lineitem", "part", "customer"):
        df = spark.read.parquet(f"{bought}/{name}.parquet")
        (df.limit(0) if name == "lineitem" else df).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert rankings.ensemble_average(spark, f"{tmp_path}/none").isEmpty()


def test_scores_of_pairs_are_rounded_quotients(spark):
    # quotients that end in a five at the seventh place among them
    hashes = [j << 25 for j in range(128)] + [(1 << 32) - 1, 1, 2147, 2148] + np.random.default_rng(2).integers(0, 1 << 32, 20000).tolist()
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    quotient = F.round(F.col("h") / F.lit(float(1 << 32)), 6)
    assert df.filter(~views.six_places(F.col("h")).eqNullSafe(quotient)).isEmpty()


def test_all_scores_shuffle_no_cell(spark, monkeypatch):
    x = spark.createDataFrame([(1, "p", 2.0), (1, "p", 1.0), (1, None, 5.0), (2, "q", None), (2, "r", -1.0), (None, "p", 4.0)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(10, "p", 3.0), (10, None, 7.0), (11, "r", 4.0), (11, "s", 0.5), (None, "p", 1.0)], "label_id long, col_id string, val double")
    instances = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "row_id long")
    labels = spark.createDataFrame([(10,), (11,), (11,), (12,), (None,)], "label_id long")
    want = sorted([(r, k, {(1, 10): 9.0, (2, 11): -4.0}.get((r, k), 0.0)) for r in (1, 2, 2, 3, None) for k in (10, 11, 12, None)], key=repr)
    for cells_, least in ((10**6, 10**6), (1, 1)):  # with 1, every label and every instance is a block of its own
        monkeypatch.setattr(M, "GRID_CELLS", cells_)
        monkeypatch.setattr(M, "GRID_LEAST", least)
        monkeypatch.setattr(M, "GRID_ROWS", cells_)
        found = M.score_all(x, w, instances, labels)
        assert sorted(found.collect(), key=repr) == want
        assert not [line for line in plan(found).splitlines() if "Exchange" in line and "row_id#" in line and "label_id#" in line]


@pytest.mark.parametrize("post, digits", [(True, None), ("l1-hinge", 1), ("sigmoid", 6), ("log-l2-hinge", None), (None, None)])
def test_beams_take_only_the_best_cells_of_a_block(spark, monkeypatch, post, digits):
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(int(i), f"c{j}", float(rng.integers(-3, 4))) for i in range(12) for j in rng.choice(9, 4, False)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(int(k), f"c{j}", float(rng.integers(-2, 3))) for k in range(30) for j in rng.choice(9, 5, False)], "label_id long, col_id string, val double")
    instances, labels = spark.range(14).withColumnRenamed("id", "row_id"), spark.range(33).withColumnRenamed("id", "label_id")
    monkeypatch.setattr(M, "GRID_CELLS", 60)
    monkeypatch.setattr(M, "GRID_LEAST", 50)
    model = L.Model(w.select(F.lit(0).alias("level"), "*"), w.limit(0).select(F.lit(0).alias("level"), "label_id", F.lit(0).alias("code")), 1, 0.0, None, labels)
    left = M.score_all(x, w, instances, labels, 4, post_processor(post).values)
    assert left.count() < 14 * 33
    score = post_processor(post).transform(F.col("score"))
    whole = M.score_all(x, w, instances, labels).withColumn("score", score if digits is None else F.round(score, digits))
    want = [(r["row_id"], r["label_id"], r["rank"]) for r in R.topk_per_row(whole, 4).collect()]
    found = L.predict_beam(x, model, instances, k=4, post=post, digits=digits)
    assert sorted((r["row_id"], r["label_id"], r["rank"]) for r in found.collect()) == sorted(want)


def test_best_labels_send_every_cell_to_one_block(spark, monkeypatch):
    z = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, None, 9.0), (2, 1, -1.0), (None, 0, 1.0), (3, 7, 1.0)], "row_id long, code long, val double")
    m = spark.createDataFrame([(0, 5, 0.2), (0, 6, 0.4), (1, 6, 0.2), (1, 7, 0.5), (1, None, 0.5), (2, 8, 1.0), (None, 9, 1.0)], "code long, label_id long, val double")
    want = [(1, 6, 0.5, 1), (1, 7, 0.25, 2), (1, None, 0.25, 3), (2, 6, -0.2, 1), (2, 7, -0.5, 2), (2, None, -0.5, 3)]
    for cells_, dense in ((1, 10**6), (10**6, 10**6), (10**6, 0)):
        monkeypatch.setattr(M, "MAX_CELLS", dense)
        found = M.top_products(z, m, 3, 6, cells_)
        assert sorted(found.collect(), key=repr) == sorted(want, key=repr)
        # the cells of m are dealt once: no list of them is made for a group of instances
        assert "collect_list" not in plan(found) and "label_id#" in plan(found)


def test_training_blocks_are_shuffled_with_numbered_columns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(int(i), f"column {j}", float(rng.normal())) for i in range(40) for j in rng.choice(9, 5, False)], "row_id long, col_id string, val double")
    y = spark.createDataFrame([(int(i), int(i) % 4) for i in range(40)], "row_id long, label_id long")
    c = spark.createDataFrame([(k, k // 2) for k in range(4)], "label_id long, code long")
    z, seen, dealt = L.active_clusters(y, c), [], blocks._dealt
    monkeypatch.setattr(blocks, "_dealt", lambda df, n: seen.append(df.schema) or dealt(df, n))
    stored = L.training_blocks(x, y, c, z)
    assert seen[0]["col_ids"].dataType.simpleString() == "array<smallint>"
    assert {n for r in stored.collect() for n in r["col_ids"]} == {f"column {j}" for j in range(9)}
    entries = sorted((r["col_ids"][at], v) for r in stored.collect() for at, v in zip(r["cols"], r["vals"]))
    assert entries == sorted((r["col_id"], r["val"]) for r in x.collect())
    monkeypatch.setattr(blocks, "SHORT", 2)  # too many names for two bytes: they stay as they are
    same = L.training_blocks(x, y, c, z)
    assert sorted(map(repr, ((r["code"], r["col_ids"], r["true_at"]) for r in same.collect()))) == sorted(map(repr, ((r["code"], r["col_ids"], r["true_at"]) for r in stored.collect())))


def test_weights_under_the_threshold_are_not_stored(spark, monkeypatch):
    x = spark.createDataFrame([(i, f"c{j}", float(i % 2 + j * i / 50) if j < 2 else 0.0001 * (i % 3 - i % 2)) for i in range(20) for j in range(4)], "row_id long, col_id string, val double")
    y = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id long, label_id long")
    c = spark.createDataFrame([(0, 0), (1, 0)], "label_id long, code long")
    held, stored = [], blocks.materialised
    monkeypatch.setattr(blocks, "materialised", lambda df, name="table": held.append((name, stored(df, name))) or held[-1][1])
    whole = {(r["label_id"], r["col_id"]): r["val"] for r in L.train_linear(x, y, c, L.active_clusters(y, c), L.Fit(threshold=0.0)).collect()}
    held.clear()
    found = {(r["label_id"], r["col_id"]): r["val"] for r in L.train_linear(x, y, c, L.active_clusters(y, c), L.Fit(threshold=0.1)).collect()}
    assert found == {k: w for k, w in whole.items() if abs(w) >= 0.1} and len(found) < len(whole)
    alone = next(df for name, df in held if name == "alone")
    assert all(abs(w) >= 0.1 for r in alone.collect() for w in r["d_val"])


@pytest.mark.parametrize("solver", ["L2R_L2LOSS_SVC_DUAL", "L2R_L1LOSS_SVC_DUAL", "L1R_L2LOSS_SVC", "L2R_LR_DUAL"])
def test_objectives_shuffle_no_scored_pair(spark, monkeypatch, solver):
    rng = np.random.default_rng(6)
    x = spark.createDataFrame([(int(i), f"c{j}", float(rng.normal())) for i in range(9) for j in rng.choice(7, 4, False)] + [(1, None, 5.0), (2, "c0", None), (None, "c1", 1.0)], "row_id long, col_id string, val double")
    w = spark.createDataFrame([(int(k), f"c{j}", float(rng.normal())) for k in range(5) for j in rng.choice(9, 5, False)] + [(0, "c1", 1.5), (None, "c1", 1.0)], "label_id long, col_id string, val double")
    pairs = [(k, i, 1.0 if (i + k) % 3 else -1.0) for i in range(11) for k in range(7)] + [(1, 1, -1.0), (1, None, 1.0), (None, 1, 1.0)]
    rows = spark.createDataFrame(pairs, "label_id long, row_id long, target double")
    fit = L.Fit(solver, c_pos=2.0)
    asked, score = [], L.score_pairs
    monkeypatch.setattr(L, "score_pairs", lambda *a: asked.append(1) or score(*a))
    monkeypatch.setattr(L, "WHOLE_ENTRIES", 0)
    want = cells(L.objective(x, rows, w, fit), "label_id")
    assert asked == [1] and len(want) == 7
    monkeypatch.setattr(L, "WHOLE_ENTRIES", 10**6)
    for pairs_, dense in ((10**6, 10**6), (4, 10**6), (10**6, 0)):  # with 4, a label is dealt to several groups
        monkeypatch.setattr(L, "LOSS_PAIRS", pairs_)
        monkeypatch.setattr(L, "MAX_CELLS", dense)
        assert cells(L.objective(x, rows, w, fit), "label_id") == want
    assert asked == [1]
