"""Queries of readers and writers: derived tables are written in the reader's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import labels as _labels
from catalog import views as v
from catalog.matrices import rounded
from catalog.rankings import metrics_sql
from catalog.views import query
from notecode.functions.text import single_line
from notecode.operators import evaluation as E
from notecode.operators import hierarchy as H
from notecode.sources import files as S
from notecode.session import scratch_path


@query("SELECT row_id, hadm_id, trim(category) AS category, md5(text) AS digest FROM fx_notes")
def read_notes(spark, d):
    """Notes with line breaks through gz CSV, then spread over parquet files."""
    path = scratch_path(spark, "notes")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in S.NOTES_SCHEMA}
    columns.update({n: F.col(n) for n in ("row_id", "hadm_id", "category", "text")})
    rows = v.notes(spark, d).select(*[c.alias(n) for n, c in columns.items()])
    S.write_table(rows, path, "csv", header=True, quoteAll=True, escape='"', compression="gzip")
    notes = S.land_notes(S.read_notes(spark, path), scratch_path(spark, "landed"), 8)
    return notes.select("row_id", "hadm_id", F.trim("category").alias("category"), F.md5("text").alias("digest"))


def _stored_codes(spark, d):
    path = scratch_path(spark, "codes")
    rows = v.diag(spark, d).select(F.col("hadm_id").alias("row_id"), F.lit(0).alias("subject_id"), "hadm_id", "seq_num", "code")
    S.write_table(rows, path, "csv", header=True)
    return path


@query("SELECT hadm_id, seq_num, code FROM fx_diag")
def read_codes(spark, d):
    return S.read_codes(spark, _stored_codes(spark, d))


@query("SELECT hadm_id, seq_num, code FROM fx_diag WHERE seq_num = 1")
def read_first_codes(spark, d):
    return S.read_codes(spark, _stored_codes(spark, d), seq=1)


@query("SELECT replace(src, '.', '') AS src, tgt, title FROM fx_map")
def read_equivalence_map(spark, d):
    path = scratch_path(spark, "map")
    dotted = F.concat(F.substring("src", 1, 2), F.lit("."), F.substring("src", 3, 20)).alias("src")
    S.write_table(v.mapping(spark, d).select(dotted, "tgt", "title"), path, "csv", sep="|")
    return S.read_equivalence_map(spark, path)


@query("SELECT path_ord, depth, code, descr, parent_depth, parent_code FROM fx_links")
def read_hierarchy(spark, d):
    path = scratch_path(spark, "paths")
    S.write_table(v.paths(spark, d), path, "json")
    return H.path_links(S.read_hierarchy(spark, path))


@query("SELECT row_id, label::DOUBLE AS label, col_id, round(val, 6) AS val FROM fx_dense_long JOIN fx_dense USING (row_id)")
def read_sparse_lines(spark, d):
    path = scratch_path(spark, "lines")
    numbers = F.transform("embedding", lambda e, i: F.concat((i + 1).cast("string"), F.lit(":"), e.cast("double").cast("string")))
    line = F.concat(F.col("label").cast("string"), F.lit(" "), F.array_join(numbers, " "))
    in_order = v.dense(spark, d).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
    in_order.select(line.alias("value")).write.text(path)
    instances, x = S.read_sparse_lines(spark, path)
    return rounded(x.join(instances, "row_id")).select("row_id", "label", "col_id", "val")


@query("SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, md5(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '^\\s+', ''), '\\s+$', '')) AS digest FROM fx_docs")
def read_raw_texts(spark, d):
    path = scratch_path(spark, "texts")
    in_order = v.docs(spark, d).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
    in_order.select(single_line(F.col("text")).alias("value")).write.text(path)
    return S.read_raw_texts(spark, path).select("row_id", F.md5("text").alias("digest"))


@query("SELECT row_id, col_id, round(val, 6) AS val FROM fx_dense_long")
def read_matrix(spark, d):
    path = scratch_path(spark, "dense")
    S.write_table(v.dense(spark, d).select("row_id", "embedding"), path)
    return rounded(S.read_matrix(spark, path))


@query(
    "SELECT 'X' AS part, count(*) AS n, count(DISTINCT row_id) AS ids, round(sum(val), 3) AS total FROM fx_x "
    "UNION ALL SELECT 'Y', count(*), count(DISTINCT row_id), sum(label_id)::DOUBLE FROM fx_y "
    "UNION ALL SELECT 'instances', count(*), count(DISTINCT row_id), sum(row_id)::DOUBLE FROM fx_instances "
    "UNION ALL SELECT 'label_map', count(*), count(DISTINCT p_partkey), sum(length(p_name))::DOUBLE FROM part"
)
def write_dataset(spark, d):
    folder = scratch_path(spark, "dataset")
    names = v.table(spark, d, "part").select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("label_text"))
    S.write_dataset(v.x(spark, d), v.y(spark, d), v.instances(spark, d), names, folder)
    parts = S.read_dataset(spark, folder)
    sums = {"X": ("row_id", F.round(F.sum("val"), 3)), "Y": ("row_id", F.sum("label_id"))}
    sums |= {"instances": ("row_id", F.sum("row_id")), "label_map": ("label_id", F.sum(F.length("label_text")))}
    rows = [
        parts[name].agg(F.count("*").alias("n"), F.countDistinct(key).alias("ids"), total.cast("double").alias("total")).withColumn("part", F.lit(name))
        for name, (key, total) in sums.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    "SELECT level, label_id, n, total FROM (SELECT 0 AS level, label_id, count(*) AS n, round(sum(val), 4) AS total FROM fx_cw GROUP BY label_id "
    "UNION ALL SELECT 1, label_id, count(*), round(sum(val), 4) FROM fx_w GROUP BY label_id)"
)
def save_and_load_model(spark, d):
    folder = scratch_path(spark, "model")
    S.save_model(_labels._model(spark, d), folder)
    weights = S.load_model(spark, folder).weights
    return weights.groupBy("level", "label_id").agg(F.count("*").alias("n"), F.round(F.sum("val"), 4).alias("total"))


@query(metrics_sql("fx_pred_a"))
def write_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    S.write_metrics(E.precision_recall_at_k(v.y(spark, d), v.pred(spark, d), v.instances(spark, d)), path)
    return rounded(S.read_metrics(spark, path), "precision", "recall").select("k", "precision", "recall")
