"""Queries of features, sparse matrix operators, joins over matrices and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.cases import TRAIN_SQL
from catalog.views import query
from notecode.operators import features as X
from notecode.operators import matrix as M
from notecode.operators import sampling as S
from notecode.session import materialised

BIAS = "bias"


def rounded(df, *columns, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in (columns or ("val",))})


# --- tf-idf -----------------------------------------------------------------------------------

v.VIEWS["fx_tf"] = "SELECT row_id, term, count(*) AS n FROM fx_token GROUP BY row_id, term"
v.VIEWS["fx_df"] = f"SELECT term, count(*) AS df FROM fx_tf WHERE {TRAIN_SQL} GROUP BY term"
v.VIEWS["fx_idf"] = (
    f"SELECT term, df, ln((1.0 + (SELECT count(*) FROM fx_docs WHERE {TRAIN_SQL})) / (1.0 + df)) + 1.0 AS idf FROM fx_df"
)
v.VIEWS["fx_tfidf"] = (
    "SELECT row_id, term, val / sqrt(sum(val * val) OVER (PARTITION BY row_id)) AS val FROM "
    "(SELECT row_id, term, n * idf AS val FROM fx_tf JOIN fx_idf USING (term))"
)


def _split_texts(spark, d):
    return S.split_train_test(v.docs(spark, d).select("row_id", "text"))


@query("SELECT term, df, round(idf, 6) AS idf FROM fx_idf")
def document_frequency(spark, d):
    train, _ = _split_texts(spark, d)
    return rounded(X.fit_tfidf(train), "idf")


@query(f"SELECT row_id, term AS col_id, round(val, 6) AS val FROM fx_tfidf WHERE {TRAIN_SQL}")
def tfidf_train(spark, d):
    train, _ = _split_texts(spark, d)
    return rounded(X.tfidf(X.term_counts(train), X.fit_tfidf(train)))


@query(f"SELECT row_id, term AS col_id, round(val, 6) AS val FROM fx_tfidf WHERE NOT ({TRAIN_SQL})")
def tfidf_test(spark, d):
    train, test = _split_texts(spark, d)
    return rounded(X.tfidf(X.term_counts(test), X.fit_tfidf(train)))


@query("SELECT row_id, col_id, round(val / sqrt(sum(val * val) OVER (PARTITION BY row_id)), 6) AS val FROM fx_x")
def normalize_rows_l2(spark, d):
    return rounded(X.normalize_rows(v.x(spark, d)))


@query("SELECT row_id, col_id, round(val / sum(abs(val)) OVER (PARTITION BY row_id), 6) AS val FROM fx_x")
def normalize_rows_l1(spark, d):
    return rounded(X.normalize_rows(v.x(spark, d), "l1"))


# two integer-indexed feature sets: part sizes bought, and days of the month of the orders
v.VIEWS["fx_x1"] = (
    "SELECT o_custkey AS row_id, p_size AS col_id, count(*)::DOUBLE AS val FROM orders JOIN lineitem ON o_orderkey = l_orderkey "
    "JOIN part ON l_partkey = p_partkey GROUP BY ALL"
)
v.VIEWS["fx_x2"] = (
    "SELECT o_custkey AS row_id, day(o_orderdate)::INT AS col_id, sum(o_totalprice) / 1000 AS val FROM orders GROUP BY ALL"
)
OFFSET = 100


def x1(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("row_id"))
    items = v.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = v.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("col_id"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("row_id", "col_id").agg(F.count("*").cast("double").alias("val"))


def x2(spark, d):
    orders = v.table(spark, d, "orders")
    key = [F.col("o_custkey").alias("row_id"), F.dayofmonth("o_orderdate").alias("col_id")]
    return orders.groupBy(*key).agg((F.sum("o_totalprice") / 1000).alias("val"))


v.VIEWS["fx_n1"] = "SELECT row_id, col_id, val / sqrt(sum(val * val) OVER (PARTITION BY row_id)) AS val FROM fx_x1"
v.VIEWS["fx_n2"] = "SELECT row_id, col_id + 100 AS col_id, val / sqrt(sum(val * val) OVER (PARTITION BY row_id)) AS val FROM fx_x2"
v.VIEWS["fx_n12"] = "SELECT * FROM fx_n1 UNION ALL SELECT * FROM fx_n2"


@query("SELECT row_id, col_id, round(val, 6) AS val FROM fx_x1 UNION ALL SELECT row_id, col_id + 100, round(val, 6) FROM fx_x2")
def hstack(spark, d):
    return rounded(X.hstack(x1(spark, d), x2(spark, d), OFFSET))


def _formats(spark, d):
    first, second = materialised(x1(spark, d), "x1"), materialised(x2(spark, d), "x2")
    stacked = [X.feature_format(f, first, second, OFFSET).withColumn("format", F.lit(f)) for f in (0, 1, 2, 3, 4)]
    out = stacked[0]
    for s in stacked[1:]:
        out = out.unionByName(s)
    return out


@query(
    "SELECT 0 AS format, row_id, col_id, round(val / sqrt(sum(val * val) OVER (PARTITION BY row_id)), 6) AS val FROM fx_n12 "
    "UNION ALL SELECT 1, row_id, col_id, round(val, 6) FROM fx_n1 UNION ALL SELECT 2, row_id, col_id - 100, round(val, 6) FROM fx_n2 "
    "UNION ALL SELECT 3, row_id, col_id, round(val, 6) FROM fx_n12 UNION ALL SELECT 4, row_id, col_id, val FROM fx_x1"
)
def feature_format(spark, d):
    """Every entry of every format."""
    return rounded(_formats(spark, d))


# --- shapes and subsets -----------------------------------------------------------------------


@query("SELECT row_id, col_id, val FROM fx_x UNION ALL SELECT row_id, 'bias', 0.5 FROM fx_instances")
def append_bias(spark, d):
    return M.append_bias(v.x(spark, d), v.instances(spark, d), 0.5, F.lit(BIAS))


@query("SELECT row_id, col_id, round(val, 6) AS val FROM fx_dense_long")
def dense_to_long(spark, d):
    return rounded(M.dense_to_long(v.dense(spark, d)))


@query(
    "SELECT row_id, string_agg(col_id, ',' ORDER BY col_id) AS cols, string_agg(val::INT::VARCHAR, ',' ORDER BY col_id) AS vals FROM fx_x GROUP BY row_id"
)
def long_to_vectors(spark, d):
    packed = M.long_to_vectors(v.x(spark, d))
    vals = F.transform("vals", lambda e: e.cast("int").cast("string"))
    return packed.select("row_id", F.array_join("col_ids", ",").alias("cols"), F.array_join(vals, ",").alias("vals"))


@query("SELECT col_id AS row_id, row_id AS col_id, val FROM fx_x")
def transpose(spark, d):
    return M.transpose(v.x(spark, d))


v.VIEWS["fx_rich"] = "SELECT c_custkey AS row_id FROM customer WHERE c_acctbal > 5000"


@query("SELECT row_id, col_id, val FROM fx_x WHERE row_id IN (SELECT row_id FROM fx_rich)")
def row_subset(spark, d):
    rich = v.table(spark, d, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("row_id"))
    return M.row_subset(v.x(spark, d), rich)


@query("SELECT row_id, col_id, val FROM fx_x WHERE starts_with(col_id, 'Brand#1/')")
def col_subset(spark, d):
    x = v.x(spark, d)
    return M.col_subset(x, x.select("col_id").distinct().filter(F.col("col_id").startswith("Brand#1/")))


@query("SELECT row_id, col_id, round(val * c_acctbal, 6) AS val FROM fx_x JOIN customer ON row_id = c_custkey")
def row_scale(spark, d):
    factors = v.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("factor"))
    return rounded(M.row_scale(v.x(spark, d), factors))


@query("SELECT row_id, col_id, round(val * length(col_id), 6) AS val FROM fx_x")
def col_scale(spark, d):
    x = v.x(spark, d)
    factors = x.select("col_id").distinct().withColumn("factor", F.length("col_id").cast("double"))
    return rounded(M.col_scale(x, factors))


@query("SELECT DISTINCT l_orderkey AS row_id, l_partkey AS label_id FROM lineitem WHERE l_returnflag <> 'R'")
def padded_ids_to_matrix(spark, d):
    entry = F.struct("l_partkey", (F.col("l_returnflag") != "R").cast("int").alias("on"))
    lists = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(entry).alias("e"))
    padded = lists.select(
        "row_id",
        F.concat(F.transform("e", lambda e: e["l_partkey"]), F.array_repeat(F.lit(0).cast("long"), 3)).alias("ids"),
        F.concat(F.transform("e", lambda e: e["on"]), F.array_repeat(F.lit(0), 3)).alias("mask"),
    )
    return M.padded_ids_to_matrix(padded)


@query("SELECT round(avg(val), 6) AS mean FROM fx_x")
def matrix_mean(spark, d):
    return rounded(M.matrix_mean(v.x(spark, d)), "mean")


@query("SELECT row_id, col_id, round(val - (SELECT avg(val) FROM fx_x), 6) AS val FROM fx_x")
def subtract_mean(spark, d):
    return rounded(M.subtract_mean(v.x(spark, d)))


# --- products ---------------------------------------------------------------------------------


@query("SELECT label_id, col_id, round(sum(x.val), 6) AS val FROM fx_y y JOIN fx_x x USING (row_id) GROUP BY ALL")
def matmul(spark, d):
    y = v.y(spark, d).withColumn("val", F.lit(1.0))
    return rounded(M.matmul(y, v.x(spark, d), "label_id", "row_id", "col_id"))


@query("SELECT row_id, round(sum(val * length(col_id)), 6) AS val FROM fx_x GROUP BY row_id")
def matvec(spark, d):
    x = v.x(spark, d)
    return rounded(M.matvec(x, x.select("col_id").distinct().withColumn("val", F.length("col_id").cast("double"))))


@query("SELECT col_id, round(sum(val * c_acctbal) + length(col_id), 4) AS val FROM fx_x JOIN customer ON row_id = c_custkey GROUP BY col_id")
def rmatvec(spark, d):
    x = v.x(spark, d)
    u = v.table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("val"))
    start = x.select("col_id").distinct().withColumn("val", F.length("col_id").cast("double"))
    return rounded(M.rmatvec(x, u, add=start), digits=4)


v.VIEWS["fx_scored"] = (
    "SELECT p.row_id, p.label_id, round(coalesce(s, 0), 6) AS score FROM fx_pairs p LEFT JOIN "
    "(SELECT row_id, label_id, sum(x.val * w.val) AS s FROM fx_pairs JOIN fx_x x USING (row_id) JOIN fx_w w USING (label_id, col_id) GROUP BY row_id, label_id) "
    "USING (row_id, label_id)"
)


@query("SELECT row_id, label_id, score FROM fx_scored")
def score_pairs(spark, d):
    return rounded(M.score_pairs(v.x(spark, d), v.w(spark, d), v.pairs(spark, d)), "score")


# cluster weights: the mean of the label weights of each cluster
v.VIEWS["fx_cw"] = "SELECT code AS label_id, col_id, round(sum(val), 4) AS val FROM fx_w JOIN fx_c USING (label_id) GROUP BY ALL"
v.VIEWS["fx_codes"] = "SELECT DISTINCT code AS label_id FROM fx_c"


def cluster_weights(spark, d, w=None):
    joined = (v.w(spark, d) if w is None else w).join(v.c(spark, d), "label_id")
    return joined.groupBy(F.col("code").alias("label_id"), "col_id").agg(F.round(F.sum("val"), 4).alias("val"))


v.VIEWS["fx_root"] = (
    "SELECT i.row_id, l.label_id, round(coalesce(s, 0), 6) AS score FROM fx_instances i CROSS JOIN fx_codes l LEFT JOIN "
    "(SELECT row_id, label_id, sum(x.val * w.val) AS s FROM fx_x x JOIN fx_cw w USING (col_id) GROUP BY row_id, label_id) t "
    "ON t.row_id = i.row_id AND t.label_id = l.label_id"
)


@query("SELECT row_id, label_id, score FROM fx_root")
def score_all(spark, d):
    labels = v.c(spark, d).select(F.col("code").alias("label_id")).distinct()
    return rounded(M.score_all(v.x(spark, d), cluster_weights(spark, d), v.instances(spark, d), labels), "score")


@query(
    "SELECT row_id, code, count(*) AS n_labels, sum(label_id)::BIGINT AS label_sum, round(max(val), 6) AS parent_score "
    "FROM fx_z JOIN fx_c USING (code) GROUP BY row_id, code"
)
def expand_candidates(spark, d):
    candidates = M.expand_candidates(v.z(spark, d), v.c(spark, d))
    return candidates.groupBy("row_id", "code").agg(
        F.count("*").alias("n_labels"), F.sum("label_id").alias("label_sum"), F.round(F.max("parent_score"), 6).alias("parent_score")
    )


# --- elementwise ------------------------------------------------------------------------------


@query(
    "SELECT row_id, label_id, round(sum(score), 6) AS val FROM (SELECT * FROM fx_pred_a UNION ALL SELECT row_id, label_id, 1 FROM fx_y) "
    "GROUP BY ALL HAVING sum(score) <> 0"
)
def elementwise_add(spark, d):
    a = v.pred(spark, d).withColumnRenamed("score", "val")
    return rounded(M.elementwise_add(a, v.y(spark, d).withColumn("val", F.lit(1.0))))


@query(
    "SELECT row_id, label_id, round(greatest(max(s), CASE WHEN count(*) < 2 THEN 0 ELSE -1e9 END), 6) AS val FROM "
    "(SELECT row_id, label_id, score - 0.5 AS s FROM fx_pred_a UNION ALL SELECT row_id, label_id, 0.25 FROM fx_y) GROUP BY ALL "
    "HAVING greatest(max(s), CASE WHEN count(*) < 2 THEN 0 ELSE -1e9 END) <> 0"
)
def elementwise_max(spark, d):
    a = v.pred(spark, d).select("row_id", "label_id", (F.col("score") - 0.5).alias("val"))
    return rounded(M.elementwise_max(a, v.y(spark, d).withColumn("val", F.lit(0.25))))
