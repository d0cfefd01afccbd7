"""Tables published together: written to a fresh folder each time, and listed in a manifest last."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, part string, n_rows long, digest string"


def content_of(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of all values, whatever the order and the partitioning of the rows."""
    columns = sorted(df.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")) for seed in (1, 2)]
    n, *totals = df.agg(F.count("*"), *sums).first()
    return n, ",".join([f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns] + [str(t or 0) for t in totals])


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifest of ``folder``, or None if nothing was published there; other failures are raised."""
    try:
        listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if listed.isEmpty() else listed


def publish(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Store tables together; readers see all of them or none.

    Each attempt writes below a part folder of its own. The manifest, one file that Spark's committer moves
    into place at its end, comes last, so what a killed attempt left is never read and need not be removed.
    It holds the rows and the digest of each table as stored. A folder is published once.
    """
    spark = next(iter(tables.values())).sparkSession
    if manifest(spark, folder) is not None:
        raise FileExistsError(f"{folder} is published already")
    part = f"part-{uuid.uuid4().hex}"
    listed = []
    for name, table in tables.items():
        path = f"{folder}/{part}/{name}"
        table.write.parquet(path)
        listed.append((name, part, *content_of(spark.read.schema(table.schema).parquet(path))))
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def published(spark: SparkSession, folder: str, check: bool = False) -> dict[str, DataFrame]:
    """The tables of ``folder`` by name, none if it has no manifest; ``check`` compares them with it."""
    listed = manifest(spark, folder)
    tables = {}
    for row in listed.collect() if listed is not None else ():
        table = spark.read.parquet(f"{folder}/{row['part']}/{row['name']}")
        if check and content_of(table) != (row["n_rows"], row["digest"]):
            raise ValueError(f"{row['name']} in {folder} is not what was published")
        tables[row["name"]] = table
    return tables
