"""Queries of ranked predictions, score transforms, metrics and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.matrices import rounded
from catalog.views import query
from notecode.functions import scores as Q
from notecode.operators import baseline as B
from notecode.operators import ensembling as N
from notecode.operators import evaluation as E
from notecode.operators import ranking as R

K = 5
DEPTH = 10

v.VIEWS["fx_ranked_a"] = "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM fx_pred_a"


@query(f"SELECT row_id, label_id, score, rank FROM fx_ranked_a WHERE rank <= {K}")
def topk_per_row(spark, d):
    return R.topk_per_row(v.pred(spark, d), K)


@query("SELECT row_id, label_id, score, rank FROM fx_ranked_a")
def rank_all(spark, d):
    return R.topk_per_row(v.pred(spark, d))


@query(
    f"SELECT * FROM (SELECT row_id, label_id, score, row_number() OVER (PARTITION BY label_id ORDER BY score DESC, row_id) AS rank FROM fx_pred_a) WHERE rank <= {K}"
)
def topk_per_column(spark, d):
    return R.topk_per_column(v.pred(spark, d), K)


def _relevance_view(tag, longest):
    return (
        f"SELECT row_id, label_id, ({longest} - row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) + 1)::DOUBLE AS score FROM fx_pred_{tag}"
    )


v.VIEWS["fx_longest"] = (
    "SELECT max(n) AS n FROM ("
    + " UNION ALL ".join(f"SELECT count(*) AS n FROM fx_pred_{t} GROUP BY row_id" for t in "abc")
    + ")"
)
for _t in "abc":
    v.VIEWS[f"fx_rel_{_t}"] = _relevance_view(_t, "(SELECT n FROM fx_longest)")


@query(_relevance_view("a", "(SELECT max(n) FROM (SELECT count(*) AS n FROM fx_pred_a GROUP BY row_id))"))
def relevance(spark, d):
    return R.relevance(v.pred(spark, d)).select("row_id", "label_id", "score")


@query("SELECT * FROM (SELECT row_id, code, val, row_number() OVER (PARTITION BY row_id ORDER BY val DESC, code) AS rank FROM fx_z) WHERE rank <= 10")
def topk_matcher(spark, d):
    return R.topk_matcher(v.z(spark, d), 10)


# --- score transforms: applied to centred scores between -2 and 2 --------------------------------

v.VIEWS["fx_v"] = f"SELECT row_id, label_id, round(4 * {v.score_sql('a')} - 2, 6) AS v, {v.score_sql('b')} AS parent FROM fx_pairs"


def _v(spark, d):
    centred = F.round(v.pair_score("a") * 4 - 2, 6).alias("v")
    return v.pairs(spark, d).select("row_id", "label_id", centred, v.pair_score("b").alias("parent"))


TRANSFORM_SQL = {
    "identity": "v",
    "sigmoid": "1 / (1 + exp(-v))",
    "log_sigmoid": "ln(1 / (1 + exp(-v)))",
    **{f"l{p}_hinge": f"exp(-pow(greatest(1 - v, 0), {p}))" for p in Q.HINGE_POWERS},
    **{f"log_l{p}_hinge": f"-pow(greatest(1 - v, 0), {p})" for p in Q.HINGE_POWERS},
}


@query("SELECT row_id, label_id, " + ", ".join(f"round({s}, 6) + 0.0 AS {n}" for n, s in TRANSFORM_SQL.items()) + " FROM fx_v")
def score_transforms(spark, d):
    table = {"identity": Q.identity, "sigmoid": Q.sigmoid, "log_sigmoid": Q.log_sigmoid}
    table.update({f"l{p}_hinge": Q.lp_hinge(p) for p in Q.HINGE_POWERS})
    table.update({f"log_l{p}_hinge": Q.log_lp_hinge(p) for p in Q.HINGE_POWERS})
    score = F.col("v")
    return _v(spark, d).select("row_id", "label_id", *[(F.round(f(score), 6) + 0.0).alias(n) for n, f in table.items()])


@query(
    "SELECT row_id, label_id, v AS noop, round(v + parent, 6) AS added, round(v * parent, 6) AS multiplied, greatest(v, parent) AS largest, "
    "round(1 - (1 - v) * (1 - parent), 6) AS noisyor FROM fx_v"
)
def score_combiners(spark, d):
    names = {"noop": "noop", "add": "added", "mul": "multiplied", "max": "largest", "noisyor": "noisyor"}
    child, parent = F.col("v"), F.col("parent")
    return _v(spark, d).select(
        "row_id", "label_id", *[F.round(Q.COMBINERS[k](child, parent), 6).alias(n) for k, n in names.items()]
    )


POST_SQL = {
    "noop": "v",
    "sigmoid": "parent / (1 + exp(-v))",
    "log-sigmoid": "ln(1 / (1 + exp(-v))) + parent",
    "l3-hinge": "exp(-pow(greatest(1 - v, 0), 3)) * parent",
    "log-l2-hinge": "-pow(greatest(1 - v, 0), 2) + parent",
    "l2-hinge-noisyor": "1 - (1 - exp(-pow(greatest(1 - v, 0), 2))) * (1 - parent)",
}


@query("SELECT row_id, label_id, " + ", ".join(f'round({s}, 6) AS {n.replace("-", "_")}' for n, s in POST_SQL.items()) + " FROM fx_v")
def post_processors(spark, d):
    columns = []
    for name in POST_SQL:
        p = Q.post_processor(name)
        columns.append(F.round(p.combine(p.transform(F.col("v")), F.col("parent")), 6).alias(name.replace("-", "_")))
    return _v(spark, d).select("row_id", "label_id", *columns)


@query(
    "SELECT row_id, label_id, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(exp(-pow(greatest(1 - v, 0), 2)), 6) AS l2, "
    "round(exp(-pow(greatest(1 - v, 0), 3)), 6) AS l3 FROM fx_v"
)
def transform_prediction(spark, d):
    names = {"sigmoid": "sigmoid", "lpsvm-l2": "l2", "lpsvm-l3": "l3"}
    columns = [F.round(Q.transform_prediction(F.col("v"), k), 6).alias(n) for k, n in names.items()]
    return _v(spark, d).select("row_id", "label_id", *columns)


# --- metrics ----------------------------------------------------------------------------------


def metrics_sql(pred: str, truth: str = "fx_y", n: str = "(SELECT count(*) FROM fx_instances)") -> str:
    """Metrics of a relation (row_id, label_id, score) in SQL."""
    return (
        f"SELECT k, round(coalesce(sum(hit), 0) / {n} / k, 6) AS precision, round(coalesce(sum(hit / size), 0) / (SELECT count(DISTINCT row_id) FROM {truth}), 6) AS recall "
        f"FROM range(1, {DEPTH + 1}) r(k) LEFT JOIN (SELECT p.row_id, rank, 1.0::DOUBLE AS hit, size FROM "
        f"(SELECT row_id, label_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM {pred}) p "
        f"JOIN {truth} USING (row_id, label_id) JOIN (SELECT row_id, count(*) AS size FROM {truth} GROUP BY row_id) USING (row_id)) ON rank <= k GROUP BY k"
    )


@query(metrics_sql("fx_pred_a"))
def precision_recall_at_k(spark, d):
    m = E.precision_recall_at_k(v.y(spark, d), v.pred(spark, d), v.instances(spark, d), DEPTH)
    return rounded(m, "precision", "recall")


@query(" UNION ALL ".join(f"SELECT '{t}' AS model, * FROM ({metrics_sql(f'fx_pred_{t}')})" for t in "ab"))
def evaluate_predictions(spark, d):
    preds = {t: v.pred(spark, d, t) for t in "ab"}
    return rounded(E.evaluate(v.y(spark, d), preds, v.instances(spark, d), DEPTH), "precision", "recall")


v.VIEWS["fx_ens_average"] = (
    "SELECT row_id, label_id, sum(score) / 3 AS score FROM (SELECT * FROM fx_pred_a UNION ALL SELECT * FROM fx_pred_b UNION ALL SELECT * FROM fx_pred_c) GROUP BY ALL"
)
v.VIEWS["fx_ens_rank_average"] = (
    "SELECT row_id, label_id, sum(score) / 3 AS score FROM (SELECT * FROM fx_rel_a UNION ALL SELECT * FROM fx_rel_b UNION ALL SELECT * FROM fx_rel_c) GROUP BY ALL"
)
v.VIEWS["fx_ens_round_robin"] = (
    "SELECT row_id, label_id, max(score) / 3 AS score FROM (SELECT row_id, label_id, score + 0.75 AS score FROM fx_rel_a UNION ALL "
    "SELECT row_id, label_id, score + 0.5 FROM fx_rel_b UNION ALL SELECT row_id, label_id, score + 0.25 FROM fx_rel_c) GROUP BY ALL"
)


def _ranked_sql(name: str) -> str:
    return (
        "SELECT row_id, label_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label_id) AS rank FROM "
        f"(SELECT row_id, label_id, round(score, 6) AS score FROM fx_ens_{name})"
    )


def _preds(spark, d):
    return {t: v.pred(spark, d, t) for t in "abc"}


def _ranked(spark, d, df):
    # counting the rows of an ensemble would compute all of its predictions once more
    return R.topk_per_row(rounded(df, "score"), largest=v.most_pairs(spark, d))


@query(_ranked_sql("average"))
def ensemble_average(spark, d):
    return _ranked(spark, d, N.ensemble_average(*_preds(spark, d).values()))


@query(_ranked_sql("rank_average"))
def ensemble_rank_average(spark, d):
    return _ranked(spark, d, N.ensemble_rank_average(*_preds(spark, d).values()))


@query(_ranked_sql("round_robin"))
def ensemble_round_robin(spark, d):
    return _ranked(spark, d, N.ensemble_round_robin(*_preds(spark, d).values()))


def _rounded_relation(name: str) -> str:
    return f"(SELECT row_id, label_id, round(score, 9) AS score FROM {name})"


@query(
    " UNION ALL ".join(
        [f"SELECT '{t}' AS model, * FROM ({metrics_sql(f'fx_pred_{t}')})" for t in "abc"]
        + [f"SELECT '{n}' AS model, * FROM ({metrics_sql(_rounded_relation('fx_ens_' + n))})" for n in N.ENSEMBLES]
    )
)
def compare_ensembles(spark, d):
    m = N.compare_ensembles(v.y(spark, d), _preds(spark, d), v.instances(spark, d), DEPTH)
    return rounded(m, "precision", "recall")


@query(
    "SELECT round((sum(pow(greatest(1 - CASE WHEN t THEN f ELSE -f END, 0), 2)) + (cells - count(*))) / cells, 6) AS loss FROM "
    "(SELECT coalesce(score, 0) AS f, y.row_id IS NOT NULL AS t FROM fx_pred_a p FULL JOIN fx_y y ON p.row_id = y.row_id AND p.label_id = y.label_id), "
    "(SELECT (SELECT count(*) FROM fx_instances) * (SELECT count(*) FROM fx_labels) AS cells) GROUP BY cells"
)
def hinge_loss(spark, d):
    loss = E.hinge_loss(v.pred(spark, d), v.y(spark, d), v.instances(spark, d), v.labels(spark, d))
    return rounded(loss, "loss")


v.VIEWS["fx_classes"] = f"SELECT doc_id AS row_id, quality AS truth, ({v.sql_hash('doc_id', 'dummy0')} % 2)::INT AS predicted FROM labels"


@query("SELECT row_id, truth, predicted FROM fx_classes")
def dummy_classifier(spark, d):
    truth = v.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("truth"))
    return truth.join(B.dummy_classifier(truth.select("row_id")), "row_id").select("row_id", "truth", "predicted")


@query(
    "SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(coalesce(tp / nullif(tp + fp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS jaccard, "
    "round(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS fbeta FROM "
    "(SELECT cls, count(*) FILTER (truth = cls AND predicted = cls) AS tp, count(*) FILTER (truth <> cls AND predicted = cls) AS fp, "
    "count(*) FILTER (truth = cls AND predicted <> cls) AS fn FROM fx_classes, (SELECT DISTINCT unnest([truth, predicted]) AS cls FROM fx_classes) GROUP BY cls)"
)
def classification_scores(spark, d):
    scores = E.classification_scores(dummy_classifier(spark, d))
    return rounded(scores, "accuracy", "jaccard", "fbeta")
