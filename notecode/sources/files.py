"""Readers and writers for note tables, code maps, hierarchies, matrices, models and metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.functions.text import strip_spaces
from notecode.operators.linear import Model
from notecode.sources.store import publish, published

NOTES_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("chartdate", T.StringType()),
        T.StructField("charttime", T.StringType()),
        T.StructField("storetime", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cgid", T.LongType()),
        T.StructField("iserror", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
CODES_SCHEMA = "row_id long, subject_id long, hadm_id long, seq_num int, code string"
MAP_SCHEMA = "src string, tgt string, title string"
PATH_SCHEMA = "code string, descr string, href string, depth int"


def read_notes(spark: SparkSession, path: str, columns: tuple[str, ...] = ("row_id", "hadm_id", "category", "text")) -> DataFrame:
    """Notes from CSV files with quoted line breaks. A gz file is one task: land it as parquet first."""
    rows = spark.read.schema(NOTES_SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.select(*columns)


def land_notes(notes: DataFrame, path: str, files: int) -> DataFrame:
    """Spread notes over ``files`` parquet files, so that later stages read them in parallel."""
    notes.repartition(files, "row_id").write.parquet(path)
    return notes.sparkSession.read.schema(notes.schema).parquet(path)


def read_codes(spark: SparkSession, path: str, seq: int | str = "all") -> DataFrame:
    """Coded events (hadm_id, seq_num, code); codes stay strings, so leading zeros survive.

    A missing code reads as the string ``nan``; ``seq`` keeps one sequence number only.
    """
    rows = spark.read.schema(CODES_SCHEMA).csv(path, header=True)
    rows = rows.select("hadm_id", "seq_num", F.coalesce("code", F.lit("nan")).alias("code"))
    return rows if seq == "all" else rows.filter(F.col("seq_num") == int(seq))


def read_equivalence_map(spark: SparkSession, path: str) -> DataFrame:
    """Complete rows of a ``|``-separated code map, without dots in the source code."""
    rows = spark.read.schema(MAP_SCHEMA).csv(path, sep="|").na.drop()
    return rows.withColumn("src", F.replace("src", F.lit("."), F.lit("")))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Paths (path_ord, links) from JSON lines ``{"path_ord": n, "links": [{code, descr}, …]}``."""
    return spark.read.schema(f"path_ord long, links array<struct<{_fields(PATH_SCHEMA)}>>").json(path)


def read_hierarchy_array(spark: SparkSession, path: str) -> DataFrame:
    """The same from one JSON document that is an array of paths, in document order."""
    whole = spark.read.text(path, wholetext=True)
    kind = f"array<array<struct<{_fields(PATH_SCHEMA)}>>>"
    parsed = whole.select(F.from_json("value", kind).alias("paths"))
    return parsed.select(F.posexplode("paths").alias("path_ord", "links")).withColumn("path_ord", F.col("path_ord").cast("long"))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in schema.split(", ")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their 0-based number over all files in path order: (row_id, value).

    Each file split counts its lines; the number of a line is the lines of earlier splits plus its
    place in its own. Nothing is sorted and no task sees all lines.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.min("_seen").alias("_first"), F.count("*").alias("_n"))
    earlier = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)  # one row per file split
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(offsets, ["_file", "_start"]).select((F.col("_seen") + F.col("_shift")).alias("row_id"), "value")


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """One instance per line, trimmed: (row_id, text). Blank lines stay as empty texts."""
    return numbered_lines(spark, path).select("row_id", strip_spaces(F.col("value")).alias("text"))


def read_sparse_lines(
    spark: SparkSession, path: str, zero_based: bool = False, labelled: bool = True, skip_lines: int = 0, keep_zeros: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Lines of ``label idx:val idx:val …``: (instances with their label, entries (row_id, col_id, val)).

    Indices become 0-based. Without ``labelled`` all tokens are entries and the label is null;
    ``skip_lines`` leaves out header lines; ``keep_zeros=False`` drops explicit zeros.
    """
    lines = numbered_lines(spark, path).filter(F.col("row_id") >= skip_lines)
    lines = lines.select((F.col("row_id") - skip_lines).alias("row_id"), F.split(F.trim("value"), r"\s+").alias("tokens"))
    first = F.try_element_at("tokens", F.lit(1)).try_cast("double") if labelled else F.lit(None).cast("double")
    instances = lines.select("row_id", first.alias("label"))
    feature_tokens = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))) if labelled else F.col("tokens")
    entries = lines.select("row_id", F.explode(F.filter(feature_tokens, lambda t: t.contains(":"))).alias("token"))
    pair = F.split("token", ":")
    base = 0 if zero_based else 1
    x = entries.select("row_id", (pair[0].cast("int") - base).alias("col_id"), pair[1].cast("double").alias("val"))
    return instances, x if keep_zeros else x.filter(F.col("val") != 0)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Stored features as long triples, from long (row_id, col_id, val) or dense (row_id, embedding) parquet."""
    stored = spark.read.parquet(path)
    if "embedding" in stored.columns:
        entries = stored.select("row_id", F.posexplode("embedding").alias("col_id", "val"))
        return entries.withColumn("val", F.col("val").cast("double"))
    return stored.withColumn("val", F.col("val").cast("double"))


def write_dataset(
    x: DataFrame, y: DataFrame, instances: DataFrame, label_map: DataFrame, folder: str, texts: DataFrame | None = None
) -> None:
    """Store texts (row_id, text), if given, features, label matrix and label map of one split, after checking their rows.

    Every row of X and Y must belong to an instance. The tables are published together (``store.publish``).
    """
    for name, matrix in (("X", x), ("Y", y)):
        if not matrix.join(instances.select("row_id"), "row_id", "left_anti").isEmpty():
            raise ValueError(f"{name} has rows that are not instances")
    tables = {"X": x, "Y": y, "instances": instances, "label_map": label_map}
    if texts is not None:
        tables["texts"] = texts.select("row_id", "text")
    publish(tables, folder)


def read_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a stored split by name; a folder that was never written to its end is refused."""
    tables = published(spark, folder)
    if not tables:
        raise FileNotFoundError(f"no complete data set in {folder}")
    return tables


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Store a table as parquet, (gzip) json or csv."""
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    df.write.options(**options).format(kind).save(path)


def save_model(model: Model, folder: str, nr_features: int | None = None) -> None:
    """Store weights, clusters, root labels and one row of parameters.

    Labels and clusters are counted from their own lists. ``nr_features`` is the width of the features;
    without it only the columns that kept a weight are counted.
    """
    model.weights.write.parquet(f"{folder}/weights")
    model.clusters.write.parquet(f"{folder}/clusters")
    if model.roots is not None:
        model.roots.write.parquet(f"{folder}/roots")
    bottom_c = model.level(model.depth - 1)[1]
    params = {
        "depth": model.depth,
        "nr_features": nr_features if nr_features is not None else model.weights.select("col_id").distinct().count(),
        "nr_labels": model.labels(model.depth - 1).count(),
        "nr_codes": bottom_c.select("code").distinct().count(),
        "bias": model.bias,
        "bias_col": json.dumps(model.bias_col),
        "has_roots": model.roots is not None,
    }
    kinds = "depth int, nr_features long, nr_labels long, nr_codes long, bias double, bias_col string, has_roots boolean"
    spark = model.weights.sparkSession
    spark.createDataFrame([tuple(params.values())], kinds).write.json(f"{folder}/params")


def load_model(spark: SparkSession, folder: str) -> Model:
    params = spark.read.json(f"{folder}/params").first()
    return Model(
        spark.read.parquet(f"{folder}/weights"),
        spark.read.parquet(f"{folder}/clusters"),
        int(params["depth"]),
        float(params["bias"]),
        json.loads(params["bias_col"]),
        spark.read.parquet(f"{folder}/roots") if params["has_roots"] else None,
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines, one per model and k."""
    metrics.write.json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
