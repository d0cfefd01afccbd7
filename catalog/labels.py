"""Queries of label embeddings, label trees and the models over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.matrices import BIAS, cluster_weights, rounded
from catalog.rankings import DEPTH, metrics_sql
from catalog.views import query, sql_hash
from notecode.operators import baseline as B
from notecode.operators import embedding as E
from notecode.operators import evaluation as V
from notecode.operators import indexing as I
from notecode.operators import linear as L
from notecode.operators import matrix as M
from notecode.operators import ranking as R
from notecode.operators.decomposition import gram
from notecode.operators.features import normalize_rows
from notecode.session import materialised, scratch_path

# --- embeddings -------------------------------------------------------------------------------


@query("SELECT label_id, col_id, round(val, 6) AS val FROM fx_pifa")
def pifa(spark, d):
    return rounded(E.pifa(v.y(spark, d), v.x(spark, d)))


@query("SELECT label_id, col_id, round(val, 6) AS val FROM fx_pifa_raw")
def label_features_pifa(spark, d):
    return rounded(E.label_features("pifa", v.y(spark, d), v.x(spark, d)))


@query(
    "SELECT label_id, col_id, round(val / sqrt(sum(val * val) OVER (PARTITION BY label_id)), 6) AS val FROM "
    "(SELECT label AS label_id, col_id, sum(val) AS val FROM fx_dense_long JOIN fx_dense USING (row_id) GROUP BY ALL)"
)
def pifa_dense(spark, d):
    dense = v.dense(spark, d)
    return rounded(E.pifa_dense(dense.select("row_id", F.col("label").alias("label_id")), dense))


@query("SELECT label_id, row_id AS col_id, 1.0::DOUBLE AS val FROM fx_y")
def homer(spark, d):
    return E.homer(v.y(spark, d))


@query(
    "SELECT row_id, label_id, round(1 / sqrt(count(*) OVER (PARTITION BY row_id)) / sqrt(count(*) OVER (PARTITION BY label_id)), 6) AS val FROM fx_y"
)
def scale_normalize(spark, d):
    return rounded(E.scale_normalize(v.y(spark, d)))


@query("SELECT i AS dim, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS product, j AS other FROM range(0, 3) a(i), range(0, 3) b(j)")
def spectral_products(spark, d):
    """Inner products of the spectral dimensions for 8 clusters: they are orthonormal."""
    vectors = E.spectral(v.y(spark, d), 8)
    wide = vectors.groupBy("label_id").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("col_id") == i, F.col("val"))), F.lit(0.0)) for i in range(3)]).alias("vec")
    )
    vec = lambda i: F.get(F.col("vec"), i)
    cells = [F.struct(F.lit(i).alias("dim"), F.lit(j).alias("other"), (vec(i) * vec(j)).alias("p")) for i in range(3) for j in range(3)]
    sums = wide.select(F.inline(F.array(*cells))).groupBy("dim", "other").agg(F.sum("p").alias("p"))
    return sums.select(F.col("dim").cast("long"), F.round(F.abs("p"), 4).alias("product"), F.col("other").cast("long"))


v.VIEWS["fx_hashed"] = (
    f"SELECT row_id, ({sql_hash('term', 'hash')} % 256)::INT AS col_id, sum(n * idf) AS val FROM fx_tf JOIN "
    "(SELECT term, ln((1.0 + (SELECT count(*) FROM fx_docs)) / (1.0 + count(*))) + 1.0 AS idf FROM fx_tf GROUP BY term) USING (term) GROUP BY ALL"
)


@query("SELECT row_id AS label_id, col_id, round(val / sqrt(sum(val * val) OVER (PARTITION BY row_id)), 6) AS val FROM fx_hashed")
def embed_text(spark, d):
    return rounded(E.embed_text(v.docs(spark, d).select(F.col("row_id").alias("label_id"), "text")))


# --- label trees ------------------------------------------------------------------------------


@query("SELECT count(*) AS n_labels, floor(log2(count(*) // 100 + 1))::INT AS depth, floor(log2(count(*) // 100 + 1))::INT + 1 AS deeper FROM fx_labels")
def tree_depth(spark, d):
    labels = v.labels(spark, d)
    n = labels.count()
    depth, deeper = I.tree_depth(n), I.tree_depth(n, extra=1)
    return labels.agg(F.count("*").alias("n_labels"), F.lit(depth).alias("depth"), F.lit(deeper).alias("deeper"))


# sizes of balanced halves: the left one gets the smaller half
HALVES_SQL = (
    "WITH RECURSIVE halves AS (SELECT 0 AS level, 0 AS code, (SELECT count(*) FROM fx_labels) AS n UNION ALL "
    "SELECT level + 1, code * 2 + s, CASE WHEN s = 0 THEN n // 2 ELSE n - n // 2 END FROM halves, range(2) r(s), fx_depth WHERE level < depth) "
    "SELECT code, n AS n_labels FROM halves, fx_depth WHERE level = depth"
)


def _embedded(spark, d):
    return materialised(E.pifa(v.y(spark, d), v.x(spark, d)), "label_features")


def _leaf_sizes(codes):
    return I.cluster_sizes(codes).withColumn("code", F.col("code").cast("long"))


@query(HALVES_SQL)
def balanced_2means_sizes(spark, d):
    codes = I.balanced_2means(_embedded(spark, d), v.depth(spark, d), labels=v.labels(spark, d))
    return _leaf_sizes(codes)


@query(HALVES_SQL)
def index_labels_sizes(spark, d):
    """The default indexer: balanced spherical two-means."""
    return _leaf_sizes(I.index_labels("skmeans", _embedded(spark, d), labels=v.labels(spark, d)))


v.VIEWS["fx_projected"] = (
    "SELECT label_id, dim, round(sum(val * sqrt(-2 * ln(("
    + sql_hash("col_id || '/' || dim", "0a")
    + f" + 1.0) / {float(2**32)})) * cos(2 * pi() * "
    + sql_hash("col_id || '/' || dim", "0b")
    + f" / {float(2**32)})), 6) AS val FROM fx_pifa, (SELECT unnest(range(depth)) AS dim FROM fx_depth) GROUP BY label_id, dim"
)


@query("SELECT label_id, dim, val FROM fx_projected")
def random_projection(spark, d):
    features = E.pifa(v.y(spark, d), v.x(spark, d))
    return I.random_projection(features, v.depth(spark, d), labels=v.labels(spark, d))


@query(
    "SELECT label_id, sum(bin << dim)::BIGINT AS code FROM (SELECT label_id, dim, "
    "(row_number() OVER (PARTITION BY dim ORDER BY val, label_id) - 1) // ((SELECT count(*) + 1 FROM fx_labels) // 2) AS bin FROM fx_projected) GROUP BY label_id"
)
def ordinal_codes(spark, d):
    return I.ordinal_codes(E.pifa(v.y(spark, d), v.x(spark, d)), 2, v.depth(spark, d), labels=v.labels(spark, d))


@query(
    "SELECT label_id, sum((bin * pow(4, dim))::BIGINT)::BIGINT AS code FROM (SELECT label_id, dim, CASE WHEN val >= hi THEN 3 ELSE "
    "least(floor((val - lo) / ((hi - lo) / 3)), 2) END AS bin FROM fx_projected JOIN "
    "(SELECT dim, min(val) AS lo, max(val) AS hi FROM fx_projected GROUP BY dim) USING (dim)) GROUP BY label_id"
)
def uniform_codes(spark, d):
    return I.uniform_codes(E.pifa(v.y(spark, d), v.x(spark, d)), 4, v.depth(spark, d), labels=v.labels(spark, d))


def _kd_sql(dim_of_level: str) -> str:
    """Median splits of the projected features, one level after the other."""
    return (
        "WITH RECURSIVE kd AS (SELECT 0 AS level, label_id, 1::BIGINT AS node FROM fx_labels UNION ALL "
        "SELECT level + 1, label_id, node * 2 + (CASE WHEN row_number() OVER (PARTITION BY node ORDER BY v, label_id) > count(*) OVER (PARTITION BY node) // 2 THEN 1 ELSE 0 END) "
        f"FROM (SELECT k.level, k.label_id, k.node, coalesce(p.val, 0) AS v FROM kd k, fx_depth JOIN fx_projected p ON p.label_id = k.label_id AND p.dim = {dim_of_level} "
        "WHERE k.level < depth)) SELECT label_id, node - (1 << depth) AS code FROM kd, fx_depth WHERE level = depth"
    )


@query(_kd_sql("k.level % depth"))
def kdtree(spark, d):
    depth, labels = v.depth(spark, d), v.labels(spark, d)
    projected = I.random_projection(E.pifa(v.y(spark, d), v.x(spark, d)), depth, labels=labels)
    return I.kdtree(materialised(projected.withColumnRenamed("dim", "col_id")), depth, depth, labels=labels)


@query(_kd_sql("k.level"))
def balanced_ordinal_codes(spark, d):
    return I.balanced_ordinal_codes(E.pifa(v.y(spark, d), v.x(spark, d)), 2, v.depth(spark, d), labels=v.labels(spark, d))


@query("SELECT label_id, code FROM fx_c")
def random_codes(spark, d):
    return v.c(spark, d)


@query("SELECT label_id, level, code >> (depth - level) AS code FROM fx_c, (SELECT depth, unnest(range(1, depth + 1)) AS level FROM fx_depth)")
def code_paths(spark, d):
    return I.code_paths(v.c(spark, d), v.depth(spark, d))


@query("SELECT label_id, label_id // 2 AS code FROM fx_labels")
def consecutive_merge(spark, d):
    return I.consecutive_merge(v.labels(spark, d))


@query(
    "SELECT seed, label_id, code FROM (SELECT 0 AS seed, label_id, code FROM fx_c UNION ALL "
    + " UNION ALL ".join(f"SELECT {s}, label_id, {sql_hash('label_id', f's{s}')} % (1 << depth) FROM fx_labels, fx_depth" for s in (1, 2))
    + ")"
)
def cached_codes(spark, d):
    folder = scratch_path(spark, "codes")
    labels = v.labels(spark, d)
    features = labels.select("label_id", F.lit(0).alias("col_id"), F.lit(1.0).alias("val"))
    I.cached_codes(spark, folder, features, "none", "random", seeds=(0, 1), depth=v.depth(spark, d))
    both = I.cached_codes(spark, folder, features, "none", "random", seeds=(0, 1, 2), depth=v.depth(spark, d))
    return both.select("seed", "label_id", "code")


@query("SELECT code, count(*) AS n_labels FROM fx_c GROUP BY code")
def cluster_sizes(spark, d):
    return I.cluster_sizes(v.c(spark, d))


@query("SELECT code, row_number() OVER (PARTITION BY code ORDER BY label_id) AS place, label_id FROM fx_c")
def cluster_members(spark, d):
    return I.cluster_members(v.c(spark, d))


# --- instances and clusters -------------------------------------------------------------------

v.VIEWS["fx_own"] = "SELECT row_id, code, count(*)::DOUBLE AS val FROM fx_y JOIN fx_c USING (label_id) GROUP BY ALL"


@query("SELECT row_id, code, val FROM fx_own")
def instance_clusters(spark, d):
    return L.instance_clusters(v.y(spark, d), v.c(spark, d))


@query(
    "SELECT 1 AS scheme, row_id, code, val FROM fx_own UNION ALL SELECT 2, row_id, code, val FROM fx_z UNION ALL "
    "SELECT 0, row_id, code, round(sum(val), 6) FROM (SELECT * FROM fx_own UNION ALL SELECT * FROM fx_z) GROUP BY row_id, code"
)
def active_clusters(spark, d):
    y, c, z = v.y(spark, d), v.c(spark, d), v.z(spark, d)
    parts = [rounded(L.active_clusters(y, c, z, s)).select(F.lit(s).alias("scheme"), "row_id", "code", "val") for s in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "SELECT c.label_id, count(*) AS n_rows, count(y.row_id) AS n_positive, sum(CASE WHEN y.row_id IS NULL THEN -z.row_id ELSE z.row_id END)::BIGINT AS signed_ids "
    "FROM fx_z z JOIN fx_c c USING (code) LEFT JOIN fx_y y ON y.row_id = z.row_id AND y.label_id = c.label_id GROUP BY c.label_id"
)
def training_rows(spark, d):
    rows = L.training_rows(v.y(spark, d), v.c(spark, d), v.z(spark, d))
    return rows.groupBy("label_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("target") > 0).alias("n_positive"),
        F.sum(F.col("row_id") * F.col("target").cast("long")).alias("signed_ids"),
    )


@query("SELECT row_id, code, round(val / sum(val) OVER (PARTITION BY row_id), 6) AS val FROM fx_own")
def optimal_codes(spark, d):
    return rounded(L.optimal_codes(v.y(spark, d), v.c(spark, d)))


@query(
    "SELECT row_id, code, round(val / sum(val) OVER (PARTITION BY row_id), 6) AS val FROM "
    "(SELECT * FROM fx_own QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY val DESC, code) <= 3)"
)
def optimal_codes_top(spark, d):
    return rounded(L.optimal_codes(v.y(spark, d), v.c(spark, d), 3))


# --- counting model ---------------------------------------------------------------------------

v.VIEWS["fx_counted"] = "SELECT code, label_id, sum(val) AS val FROM fx_own JOIN fx_y USING (row_id) GROUP BY ALL"
v.VIEWS["fx_counts"] = "SELECT code, label_id, val / sum(val) OVER (PARTITION BY code) AS val FROM fx_counted"


@query("SELECT code, label_id, round(val, 6) AS val FROM fx_counts")
def count_model(spark, d):
    return rounded(L.count_model(L.instance_clusters(v.y(spark, d), v.c(spark, d)), v.y(spark, d)))


def _predicted_counts_sql(weight: str) -> str:
    return (
        f"SELECT row_id, label_id, score, rank FROM (SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM "
        f"(SELECT row_id, label_id, round(sum({weight} * m.val), 9) AS score FROM fx_z_top z JOIN fx_counts m USING (code) GROUP BY row_id, label_id)) WHERE rank <= 10"
    )


def _counts(spark, d):
    return L.count_model(L.instance_clusters(v.y(spark, d), v.c(spark, d)), v.y(spark, d))


@query(_predicted_counts_sql("z.val"))
def predict_counts(spark, d):
    return L.predict_counts(_top_clusters(spark, d), _counts(spark, d), 10, digits=9)


@query(_predicted_counts_sql("1"))
def predict_counts_unweighted(spark, d):
    return L.predict_counts(_top_clusters(spark, d), _counts(spark, d), 10, weighted=False, digits=9)


# Flagship: embed labels, build a label tree, count labels per cluster, predict from the best clusters, judge.
v.VIEWS["fx_tree"] = (
    "/*RECURSIVE*/SELECT 0 AS level, label_id, 1::BIGINT AS node FROM fx_labels UNION ALL "
    "SELECT level + 1, label_id, node * 2 + (CASE WHEN row_number() OVER (PARTITION BY node ORDER BY v, label_id) > count(*) OVER (PARTITION BY node) // 2 THEN 1 ELSE 0 END) "
    "FROM (SELECT k.level, k.label_id, k.node, p.val AS v FROM fx_tree k, fx_depth JOIN fx_projected p ON p.label_id = k.label_id AND p.dim = k.level WHERE k.level < depth)"
)
v.VIEWS["fx_tree_codes"] = "SELECT label_id, node - (1 << depth) AS code FROM fx_tree, fx_depth WHERE level = depth"
v.VIEWS["fx_tree_own"] = "SELECT row_id, code, count(*)::DOUBLE AS val FROM fx_y JOIN fx_tree_codes USING (label_id) GROUP BY ALL"
v.VIEWS["fx_tree_counts"] = (
    "SELECT code, label_id, val / sum(val) OVER (PARTITION BY code) AS val FROM "
    "(SELECT code, label_id, sum(val) AS val FROM fx_tree_own JOIN fx_y USING (row_id) GROUP BY ALL)"
)
v.VIEWS["fx_tree_best"] = (
    "SELECT row_id, code, val / sum(val) OVER (PARTITION BY row_id) AS val FROM "
    "(SELECT * FROM fx_tree_own QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY val DESC, code) <= 10)"
)
v.VIEWS["fx_tree_pred"] = (
    "SELECT row_id, label_id, round(sum(z.val * m.val), 9) AS score FROM fx_tree_best z JOIN fx_tree_counts m USING (code) GROUP BY row_id, label_id"
)


@query(metrics_sql("fx_tree_pred"))
def label_tree_metrics(spark, d):
    y = materialised(v.y(spark, d), "y")
    x = v.x(spark, d)
    codes = I.balanced_ordinal_codes(E.pifa(y, x), 2, v.depth(spark, d), labels=v.labels(spark, d))
    counts = L.count_model(L.instance_clusters(y, codes), y)
    pred = L.predict_counts(L.optimal_codes(y, codes, 10), counts, DEPTH, digits=9)
    metrics = V.precision_recall_at_k(y, pred.drop("rank"), v.instances(spark, d), DEPTH)
    return rounded(metrics, "precision", "recall")


# --- linear models ----------------------------------------------------------------------------


@query("SELECT label_id, col_id, val FROM fx_w WHERE abs(val) >= 0.1")
def sparsify(spark, d):
    return L.sparsify(v.w(spark, d), 0.1)


@query(
    "SELECT label_id, round(sum(pow(greatest(1 - t * score, 0), 2)) + size / 2, 4) AS objective FROM "
    "(SELECT s.label_id, score, CASE WHEN y.row_id IS NULL THEN -1 ELSE 1 END AS t FROM fx_scored s LEFT JOIN fx_y y ON y.row_id = s.row_id AND y.label_id = s.label_id) "
    "JOIN (SELECT label_id, sum(val * val) AS size FROM fx_w GROUP BY label_id) USING (label_id) GROUP BY label_id, size"
)
def training_objective(spark, d):
    marks = v.y(spark, d).withColumn("_t", F.lit(True))
    target = F.when(F.col("_t"), 1.0).otherwise(-1.0).alias("target")
    rows = v.pairs(spark, d).join(marks, ["row_id", "label_id"], "left").select("row_id", "label_id", target)
    return rounded(L.objective(v.x(spark, d), rows, v.w(spark, d)), "objective", digits=4)


v.VIEWS["fx_candidates"] = "SELECT row_id, label_id, val AS parent FROM fx_z_top JOIN fx_c USING (code)"
v.VIEWS["fx_z_top"] = "SELECT * FROM fx_z QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY val DESC, code) <= 10"
v.VIEWS["fx_candidate_scores"] = (
    "SELECT c.row_id, c.label_id, parent, round(coalesce(s, 0), 6) AS score FROM fx_candidates c LEFT JOIN "
    "(SELECT row_id, label_id, sum(x.val * w.val) AS s FROM fx_candidates JOIN fx_x x USING (row_id) JOIN fx_w w USING (label_id, col_id) GROUP BY row_id, label_id) "
    "USING (row_id, label_id)"
)


def _top_clusters(spark, d):
    return R.topk_matcher(v.z(spark, d)).select("row_id", "code", "val")


def _ranked_candidates_sql(score: str) -> str:
    return (
        "SELECT row_id, label_id, score, rank FROM (SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM "
        f"(SELECT row_id, label_id, round({score}, 6) AS score FROM fx_candidate_scores)) WHERE rank <= 10"
    )


@query(_ranked_candidates_sql("score"))
def predict_with_codes(spark, d):
    return L.predict_with_codes(v.x(spark, d), v.w(spark, d), v.c(spark, d), _top_clusters(spark, d), 10, digits=6)


@query(
    "SELECT row_id, label_id, score, rank FROM (SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM fx_scored) WHERE rank <= 10"
)
def predict_with_labels(spark, d):
    return L.predict_with_labels(v.x(spark, d), v.w(spark, d), v.pairs(spark, d), 10, digits=6)


@query("SELECT row_id, label_id, score, parent AS parent_score FROM fx_candidate_scores")
def score_blocks(spark, d):
    """Candidate scores with each cluster's weights and a block of its instances in one task."""
    blocks = L.score_blocks(v.x(spark, d), v.w(spark, d), v.c(spark, d), _top_clusters(spark, d))
    return rounded(blocks.select("row_id", "label_id", "score", "parent_score"), "score")


def _model(spark, d):
    """A two-level chain: cluster weights at the root, label weights below."""
    w = materialised(v.w(spark, d), "w")
    both = cluster_weights(spark, d, w).select(F.lit(0).alias("level"), "label_id", "col_id", "val")
    both = both.unionByName(w.select(F.lit(1).alias("level"), "label_id", "col_id", "val"))
    clusters = v.c(spark, d).select(F.lit(1).alias("level"), "label_id", "code")
    return L.Model(materialised(both), materialised(clusters), 2, 0.0)


BEAM_SQL = (
    "SELECT row_id, label_id, score, rank FROM (SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM "
    "(SELECT b.row_id, c.label_id, round(exp(-pow(greatest(1 - coalesce(s, 0), 0), 3)) * b.score, 6) AS score FROM fx_beam b JOIN fx_c c ON c.code = b.label_id LEFT JOIN "
    "(SELECT x.row_id, w.label_id, sum(x.val * w.val) AS s FROM fx_beam b JOIN fx_c c ON c.code = b.label_id JOIN fx_x x ON x.row_id = b.row_id "
    "JOIN fx_w w ON w.label_id = c.label_id AND w.col_id = x.col_id GROUP BY x.row_id, w.label_id) t ON t.row_id = b.row_id AND t.label_id = c.label_id)) WHERE rank <= 10"
)
v.VIEWS["fx_beam"] = (
    "SELECT row_id, label_id, score FROM (SELECT row_id, label_id, round(exp(-pow(greatest(1 - score / 1000, 0), 3)), 6) AS score FROM fx_root) "
    "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) <= 10"
)


def _scaled_model(spark, d):
    model = _model(spark, d)
    scale = F.when(F.col("level") == 0, F.lit(1000.0)).otherwise(F.lit(1.0))
    return L.Model(model.weights.withColumn("val", F.col("val") / scale), model.clusters, 2, 0.0)


@query(BEAM_SQL)
def predict_beam(spark, d):
    return L.predict_beam(v.x(spark, d), _scaled_model(spark, d), v.instances(spark, d), k=10, digits=6)


@query(BEAM_SQL)
def predict_beam_blocks(spark, d):
    return L.predict_beam(v.x(spark, d), _scaled_model(spark, d), v.instances(spark, d), k=10, blocks=True, digits=6)


@query(
    "SELECT row_id, label_id, round(score / sum(score) OVER (PARTITION BY row_id), 6) AS score, rank FROM (SELECT * FROM fx_ranked_a WHERE rank <= 10)"
)
def normalize_prediction(spark, d):
    top = R.topk_per_row(v.pred(spark, d), 10)
    return rounded(L.l1_prediction(top), "score")


ROOT_BLOCK = 4000  # feature entries of a block, so that the root is trained in several blocks at every size


# training: instances with their features, unit rows, and a bias column
def _training(spark, d):
    x = M.append_bias(normalize_rows(v.x(spark, d)), v.instances(spark, d), 1.0, F.lit(BIAS))
    return materialised(x, "x"), materialised(v.y(spark, d), "y"), materialised(v.c(spark, d), "c")


v.VIEWS["fx_trained"] = (
    "SELECT c.label_id, count(*) AS n_rows, count(y.row_id) AS n_positive, true AS optimal FROM fx_own z JOIN fx_c c USING (code) "
    "LEFT JOIN fx_y y ON y.row_id = z.row_id AND y.label_id = c.label_id GROUP BY c.label_id"
)


def _trained(spark, d, fit):
    """Whether each label's objective, computed anew from its weights, is the one of a gap of at most 1 %.

    Solvers without a certificate: whether it is below that of zero weights, which is the number of rows.
    """
    x, y, c = _training(spark, d)
    z = L.active_clusters(y, c)
    if fit.solver in L.SMOOTH:
        w, notes = L.train_certified(x, y, c, z, fit)
        near = (F.col("gap") <= F.col("objective") * 0.01) & (F.abs(F.col("objective") - F.col("_told")) <= F.col("_told") * 1e-6)
    else:
        w, notes = L.train_linear(x, y, c, z, fit), c.select("label_id", F.lit(0.0).alias("objective"))
        near = F.col("objective") < F.col("n_rows")
    rows = L.training_rows(y, c, z)
    reached = L.objective(x, rows, materialised(w, "w"), fit).join(notes.withColumnRenamed("objective", "_told"), "label_id")
    start = rows.groupBy("label_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("target") > 0).alias("n_positive"))
    return start.join(reached, "label_id").select("label_id", "n_rows", "n_positive", near.alias("optimal"))


@query("SELECT label_id, n_rows, n_positive, optimal FROM fx_trained")
def train_svm(spark, d):
    return _trained(spark, d, L.Fit(threshold=0.0))


@query("SELECT label_id, n_rows, n_positive, optimal FROM fx_trained")
def train_svm_l1loss(spark, d):
    return _trained(spark, d, L.Fit("L2R_L1LOSS_SVC_DUAL", threshold=0.0))


@query("SELECT label_id, n_rows, n_positive, optimal FROM fx_trained")
def train_svm_sparse(spark, d):
    return _trained(spark, d, L.Fit("L1R_L2LOSS_SVC", threshold=0.0))


@query("SELECT label_id, n_rows, n_positive, optimal FROM fx_trained")
def train_logistic(spark, d):
    return _trained(spark, d, L.Fit("L2R_LR_DUAL", threshold=0.0))


@query("SELECT DISTINCT code AS label_id, (SELECT count(*) FROM fx_instances) AS n_rows, true AS optimal FROM fx_c")
def train_distributed(spark, d):
    """The root level of the tree in many blocks: every cluster against all instances, to a gap of 1 %."""
    x, y, c = _training(spark, d)
    cluster_y = L.instance_clusters(y, c).select("row_id", F.col("code").alias("label_id"))
    everywhere = c.select(F.col("code").alias("label_id"), F.lit(0).cast("long").alias("code")).distinct()
    z = v.instances(spark, d).select("row_id", F.lit(0).cast("long").alias("code"), F.lit(1.0).alias("val"))
    fit = L.Fit(threshold=0.0, tolerance=0.01)
    w, notes = L.train_certified(x, cluster_y, everywhere, z, fit, block_entries=ROOT_BLOCK)
    rows = L.training_rows(cluster_y, everywhere, z)
    reached = L.objective(x, rows, materialised(w, "w"), fit).join(notes.withColumnRenamed("objective", "_told"), "label_id")
    joined = rows.groupBy("label_id").agg(F.count("*").alias("n_rows")).join(reached, "label_id")
    near = (F.col("gap") <= F.col("objective") * 0.01) & (F.abs(F.col("objective") - F.col("_told")) <= F.col("_told") * 1e-6)
    return joined.select("label_id", "n_rows", near.alias("optimal"))


def _chain(spark, d, mode, shallow=False):
    x, y, c = _training(spark, d)
    model = L.train_model(
        x, y, c, v.labels(spark, d), v.instances(spark, d), mode=mode, shallow=shallow, bias_col=BIAS
    )
    return x, y, model


@query(
    "SELECT 0 AS level, count(DISTINCT code) AS n_labels, 1::BIGINT AS n_codes FROM fx_c UNION ALL SELECT 1, count(*), count(DISTINCT code) FROM fx_c"
)
def train_full_model_levels(spark, d):
    """Labels and clusters on each level of a shallow full model."""
    _, _, model = _chain(spark, d, "full-model", shallow=True)
    weights = model.weights.groupBy("level").agg(F.count_distinct("label_id").alias("n_labels"))
    clusters = model.clusters.groupBy("level").agg(F.count_distinct("code").alias("n_codes"))
    return weights.join(clusters, "level", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(1).cast("long")))


@query("SELECT c_custkey AS row_id, 10 AS n_labels, true AS in_range FROM customer")
def predict_full_model(spark, d):
    """Ten labels per instance from a trained two-level model, with scores in (0, 1]."""
    x, _, model = _chain(spark, d, "full-model", shallow=True)
    pred = L.predict_beam(x, model, v.instances(spark, d), k=10, blocks=True)
    good = (F.col("score") > 0) & (F.col("score") <= 1)
    return pred.groupBy("row_id").agg(F.count("*").alias("n_labels"), F.bool_and(good).alias("in_range"))


@query("SELECT unnest(['c_pos=1.0,tolerance=0.01', 'c_pos=2.0,tolerance=0.01']) AS params, 20 AS n_k, true AS in_range")
def grid_search(spark, d):
    x, y, c = _training(spark, d)
    z = L.active_clusters(y, c)
    best = materialised(R.topk_matcher(v.z(spark, d)).select("row_id", "code", "val"), "best")
    stored = L.training_blocks(x, y, c, z)  # once for all points of the grid

    def run(beam, k, c_pos, tolerance):
        w = L.train_linear(x, y, c, z, L.Fit(c_pos=c_pos, tolerance=tolerance), stored=stored)
        model = L.Model(
            materialised(w.select(F.lit(0).alias("level"), "*")), c.select(F.lit(0).alias("level"), "*"), 1, 1.0, BIAS
        )
        pred = L.predict_beam(x, model, v.instances(spark, d), beam=beam, k=k, codes=best, blocks=True)
        return V.precision_recall_at_k(y, pred.drop("rank"), v.instances(spark, d), k)

    metrics = L.grid_search({"c_pos": [1.0, 2.0], "tolerance": [0.01]}, run)
    fine = F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
    return metrics.groupBy("params").agg(F.count("*").alias("n_k"), F.bool_and(fine).alias("in_range"))


@query("SELECT level + 1 AS level, count(DISTINCT label_id) AS n_labels FROM (SELECT -1 AS level, code AS label_id FROM fx_c UNION ALL SELECT 0, label_id FROM fx_c) GROUP BY level")
def merge_models(spark, d):
    model = _model(spark, d)
    upper = L.Model(model.weights.filter("level = 0"), model.clusters.filter("level = 0"), 1, 0.0)
    merged = L.merge_models(upper, L.last_level(model))
    return merged.weights.groupBy("level").agg(F.count_distinct("label_id").alias("n_labels"))


# --- baseline ---------------------------------------------------------------------------------


def _kiss_inputs(spark, d):
    texts = v.docs(spark, d).select("row_id", "text")
    return texts, v.diag(spark, d).select(F.col("hadm_id").alias("row_id"), "code")


@query("SELECT code, (SELECT count(*) FROM fx_docs) AS n_texts, (SELECT count(*) FROM fx_docs) AS n_valid FROM fx_top")
def kiss_scores(spark, d):
    """Train the baseline on all coded texts and score every text: one valid probability per common code."""
    texts, codes = _kiss_inputs(spark, d)
    model = B.kiss_train(texts, codes)
    scores = B.kiss_score(texts, model)
    return scores.groupBy("code").agg(
        F.count("*").alias("n_texts"), F.count_if(F.col("probability").between(0, 1)).alias("n_valid")
    )
