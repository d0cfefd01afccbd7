"""Queries of admission building, code mapping, label matrices, sampling and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.views import query, sql_hash
from notecode.operators import admissions as A
from notecode.operators import sampling as S
from notecode.operators.skew import number_rows

ROLES = ("user", "assistant", "system")


@query("SELECT doc_id, quality FROM labels RIGHT JOIN documents USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing(spark, d):
    joined = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels"), "doc_id", "left")
    return A.drop_missing(joined, ["quality"]).select("doc_id", "quality")


@query("SELECT row_id, hadm_id, trim(category) AS category, length(text) AS n_chars FROM fx_notes WHERE trim(category) = 'assistant'")
def filter_category(spark, d):
    kept = A.filter_category(v.notes(spark, d), "assistant", known=ROLES)
    return kept.select("row_id", "hadm_id", "category", F.length("text").cast("long").alias("n_chars"))


v.VIEWS["fx_first"] = "SELECT * FROM fx_docs QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1"


@query("SELECT row_id, md5(text) AS digest FROM fx_first")
def first_by_text(spark, d):
    return A.first_by_text(v.docs(spark, d)).select("row_id", F.md5("text").alias("digest"))


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(spark, d):
    return A.distinct_rows(v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"))


TRAIN_SQL = f"{sql_hash('row_id', '42')} < {int(0.66 * 2**32)}"


@query(f"SELECT row_id, CASE WHEN {TRAIN_SQL} THEN 'train' ELSE 'test' END AS side FROM fx_docs")
def split_train_test(spark, d):
    train, test = S.split_train_test(v.docs(spark, d).select("row_id"))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY h, row_id) <= round(0.66 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS side "
    f"FROM (SELECT row_id, {sql_hash('row_id', '42')} AS h FROM fx_docs)"
)
def split_train_test_exact(spark, d):
    train, test = S.split_train_test(v.docs(spark, d).select("row_id"), exact=True)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(f"SELECT row_id, source FROM fx_docs ORDER BY {sql_hash('row_id', '42')}, row_id LIMIT 80")
def subsample(spark, d):
    return S.subsample(v.docs(spark, d), 80).select("row_id", "source")


@query(f"SELECT row_id, source FROM fx_docs WHERE NOT ({TRAIN_SQL})")
def complement(spark, d):
    everything = v.docs(spark, d)
    train, _ = S.split_train_test(everything)
    return S.complement(everything, train).select("row_id", "source")


v.VIEWS["fx_top"] = "SELECT code, count(*) AS n FROM fx_diag GROUP BY code ORDER BY n DESC, code LIMIT 10"


@query("SELECT code, n FROM fx_top")
def top_codes(spark, d):
    return A.top_codes(v.diag(spark, d), 10)


@query("SELECT doc_id AS row_id FROM documents WHERE 'lang:' || lang IN (SELECT code FROM fx_top) OR 'src:' || source IN (SELECT code FROM fx_top)")
def rows_with_any_label(spark, d):
    codes = v.diag(spark, d)
    y = codes.withColumnRenamed("hadm_id", "row_id")
    return A.rows_with_any_label(y, A.top_codes(codes).select("code"), v.docs(spark, d).select("row_id"))


@query(
    "SELECT hadm_id, md5(string_agg(text, ' ' ORDER BY row_id)) AS digest, string_agg(category, ' ' ORDER BY row_id) AS category "
    "FROM fx_notes GROUP BY hadm_id"
)
def concat_notes(spark, d):
    return A.concat_notes(v.notes(spark, d)).select("hadm_id", F.md5("text").alias("digest"), "category")


@query("SELECT hadm_id, string_agg(code, ',' ORDER BY seq_num) AS codes FROM fx_proc GROUP BY hadm_id")
def codes_per_admission(spark, d):
    return A.codes_per_admission(v.proc(spark, d))


v.VIEWS["fx_admissions"] = (
    "SELECT f.hadm_id, f.text, f.category, (SELECT string_agg(code, ',' ORDER BY seq_num) FROM fx_diag g WHERE g.hadm_id = f.hadm_id) AS codes "
    "FROM fx_first f WHERE f.hadm_id IN (SELECT hadm_id FROM fx_proc)"
)


@query("SELECT hadm_id, md5(text) AS digest, category, codes FROM fx_admissions")
def build_admissions(spark, d):
    notes = A.first_by_text(v.docs(spark, d))
    built = A.build_admissions(notes, v.diag(spark, d), v.proc(spark, d))
    return built.select("hadm_id", F.md5("text").alias("digest"), "category", "codes")


@query(
    "SELECT hadm_id, string_agg(code, ',' ORDER BY seq_num) AS codes FROM fx_proc "
    "WHERE hadm_id IN (SELECT hadm_id FROM fx_first) GROUP BY hadm_id"
)
def build_admissions_procedures(spark, d):
    notes = A.first_by_text(v.docs(spark, d))
    return A.build_admissions(notes, v.diag(spark, d), v.proc(spark, d), which="proc").select("hadm_id", "codes")


@query(
    "SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, ',')) AS code FROM fx_admissions) GROUP BY code ORDER BY n DESC, code LIMIT 10"
)
def common_codes_of_admissions(spark, d):
    """The ten most common codes of admissions with a first-seen text and both kinds of code."""
    notes = A.first_by_text(v.docs(spark, d))
    built = A.build_admissions(notes, v.diag(spark, d), v.proc(spark, d))
    return A.top_codes(built.select(F.explode(F.split("codes", ",")).alias("code")), 10)


@query("SELECT src, string_agg(tgt, ',' ORDER BY tgt) AS targets FROM (SELECT DISTINCT src, tgt FROM fx_map) GROUP BY src")
def map_sets(spark, d):
    return A.map_sets(v.mapping(spark, d)).select("src", F.array_join("targets", ",").alias("targets"))


@query(
    "SELECT row_id, code, targets FROM fx_coded JOIN "
    "(SELECT src AS code, string_agg(tgt, ',' ORDER BY tgt) AS targets FROM (SELECT DISTINCT src, tgt FROM fx_map) GROUP BY src) USING (code)"
)
def map_codes(spark, d):
    mapped = A.map_codes(v.coded(spark, d), A.map_sets(v.mapping(spark, d)))
    return mapped.select("row_id", "code", F.array_join("targets", ",").alias("targets"))


@query(
    "SELECT count(*) AS n_codes, count(*) FILTER (known) AS n_mapped_codes, sum(n)::BIGINT AS n_rows, "
    "coalesce(sum(n) FILTER (known), 0)::BIGINT AS n_mapped_rows FROM "
    "(SELECT code, count(*) AS n, code IN (SELECT src FROM fx_map) AS known FROM fx_coded GROUP BY code)"
)
def mapping_coverage(spark, d):
    return A.mapping_coverage(v.coded(spark, d), v.mapping(spark, d))


# dictionary of source codes only, so language codes are unknown to it
v.VIEWS["fx_source_labels"] = (
    "SELECT row_number() OVER (ORDER BY code) - 1 AS label_id, code FROM (SELECT DISTINCT code FROM fx_diag WHERE starts_with(code, 'src:'))"
)


@query(
    "SELECT DISTINCT hadm_id AS row_id, label_id FROM (SELECT hadm_id, unnest(string_split(codes, ',')) AS code FROM fx_admissions) "
    "JOIN fx_source_labels USING (code)"
)
def label_matrix(spark, d):
    codes = v.diag(spark, d)
    known = codes.select("code").distinct().filter(F.col("code").startswith("src:"))
    labels = number_rows(known, [F.col("code")], "label_id")
    built = A.build_admissions(A.first_by_text(v.docs(spark, d)), codes, v.proc(spark, d))
    return A.label_matrix(built.withColumnRenamed("hadm_id", "row_id"), labels)


@query("SELECT n.row_id, n.hadm_id, code FROM fx_docs n JOIN fx_proc p USING (hadm_id)")
def notes_with_codes(spark, d):
    joined = A.notes_with_codes(v.docs(spark, d), v.proc(spark, d))
    return joined.select("row_id", "hadm_id", "code")


@query(
    "SELECT hadm_id AS row_id, (list_contains(codes, 'lang:en'))::INT AS en, (list_contains(codes, 'lang:fr'))::INT AS fr, "
    "(list_contains(codes, 'src:src7'))::INT AS src7 FROM (SELECT hadm_id, list(code) AS codes FROM fx_diag GROUP BY hadm_id)"
)
def indicator_columns(spark, d):
    listed = A.codes_per_admission(v.diag(spark, d))
    flagged = A.indicator_columns(listed, ["lang:en", "lang:fr", "src:src7"], ["en", "fr", "src7"])
    return flagged.select(F.col("hadm_id").alias("row_id"), "en", "fr", "src7")


@query(
    "SELECT hadm_id, md5(text) AS digest, bool_or(code = 'q:1') AS good, bool_or(code = 'tox:1') AS toxic FROM fx_proc JOIN "
    "(SELECT hadm_id, arg_max(text, row_id) AS text FROM fx_docs GROUP BY hadm_id) USING (hadm_id) "
    "WHERE code IN ('q:1', 'tox:1') GROUP BY hadm_id, text"
)
def one_hot_by_admission(spark, d):
    flags = A.one_hot_by_admission(v.docs(spark, d), v.proc(spark, d), ["q:1", "tox:1"], ["good", "toxic"])
    return flags.select("hadm_id", F.md5("text").alias("digest"), "good", "toxic")


@query(
    "SELECT (SELECT count(DISTINCT label_id) FROM fx_y) AS n_codes, count(*) AS n_instances, max(n) AS max_codes, round(avg(n), 6) AS mean_codes "
    "FROM (SELECT row_id, count(*) AS n FROM fx_y GROUP BY row_id)"
)
def label_stats(spark, d):
    codes = v.y(spark, d).select(F.col("row_id").alias("hadm_id"), F.col("label_id").alias("code"))
    return A.label_stats(codes).withColumn("mean_codes", F.round("mean_codes", 6))


@query(
    "SELECT unnest(['columns', 'duplicates', 'nulls', 'empty_columns', 'size']) AS \"check\", "
    "unnest([true, dup = 0, nul = 0, true, n > 100]) AS passed, unnest([0, dup, nul, 0, n]) AS detail FROM "
    "(SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS dup, count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL) AS nul FROM documents)"
)
def dataset_checks(spark, d):
    table = v.table(spark, d, "documents").select("doc_id", "text", "lang", F.lit(None).cast("string").alias("iserror"))
    return A.dataset_checks(table, ["doc_id", "text", "lang", "iserror"], ["doc_id"], empty_columns=["iserror"])


@query(
    f"SELECT n_train, n_test, abs(2 * n_test - n_train) / n_train < 0.5 AS within_tolerance FROM "
    f"(SELECT count(*) FILTER ({TRAIN_SQL}) AS n_train, count(*) FILTER (NOT ({TRAIN_SQL})) AS n_test FROM fx_docs)"
)
def split_ratio_check(spark, d):
    train, test = S.split_train_test(v.docs(spark, d).select("row_id"))
    sides = train.select(F.lit(1).alias("t")).unionByName(test.select(F.lit(0).alias("t")))
    counts = sides.agg(F.sum("t").alias("n_train"), F.sum(F.lit(1) - F.col("t")).alias("n_test"))
    return counts.withColumn("within_tolerance", F.abs(F.col("n_test") * 2 - F.col("n_train")) / F.col("n_train") < 0.5)
