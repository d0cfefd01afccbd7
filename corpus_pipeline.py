"""The corpus pipeline: documents through language, line, near-duplicate, benchmark and mixing stages.

A stage takes (spark, docs, sf_dir) and gives a DataFrame. ``run`` writes each stage's rows to the
shared folder and reads them again as the next stage's documents, so a lost executor never costs more
than one stage. All stages but the last give the columns of ``documents``.

A row whose doc_id is null has no identity: it is kept by the stages that look for duplicates and
benchmark items. Extra columns are carried along; a stage's own columns never enter the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.llm import decontamination, language, lines, mixing, near
from notecode.session import materialised

#: Stages learn and hash, which SQL does not express: tests compare them with brute force.
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the learned languages.

    Rejected are null texts, texts without letters, and texts none of whose n-grams is in any profile.
    Profiles are learned from all rows that carry a language; without such rows all documents stay.
    Rows with a null id stay; of rows repeated with their id all go if one does.
    """
    profiles = language.learn(docs.select("text", "lang"))
    if not profiles:
        return docs
    found = language.identify(docs.select("doc_id", "text"), profiles, flag=True)
    bad = found.filter((F.col("lang_pred") == language.UNKNOWN) | ~F.col("known")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are similar to an earlier line; n_chars is counted anew."""
    found = lines.removed_lines(docs.select("doc_id", "text")).filter(F.size("removed") > 0)
    doc, gone = _unused(docs, "_doc"), _unused(docs, "_removed")
    found = found.select(F.col("doc_id").alias(doc), F.col("removed").alias(gone)).dropDuplicates([doc])
    joined = docs.join(found, F.col("doc_id") == F.col(doc), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(lines.without_lines(F.col("text"), F.col(gone)))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return joined.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    found = near.near_duplicates(docs.select("doc_id", "text"))
    return docs.join(found.filter("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs.select("doc_id", "text"), items)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a document's row as often as the mix holds it, numbered by ``copy`` from 0
    (``copy_`` where the documents have a column ``copy`` in any case of letters, and so on).

    Rows repeated with their id are each there as often as the one of them that is taken most.
    """
    found = mixing.mix_sources(docs.select("doc_id", "text", "source")).filter("copies > 0")
    doc, copies = _unused(docs, "_doc"), _unused(docs, "_copies")
    found = found.groupBy(F.col("doc_id").alias(doc)).agg(F.max("copies").alias(copies))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)))
    copy = F.explode(F.sequence(F.lit(0), F.col(copies).cast("int") - 1)).alias(_unused(docs, "copy"))
    return joined.select(*docs.columns, copy)


STAGES = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents that the filters keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), "stage")
    return docs
