"""Label embeddings (label_id, col_id, val) from instances, label texts or the label matrix itself."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.operators.decomposition import project, truncated_svd
from notecode.operators.features import document_frequency, idf, normalize_rows, term_counts
from notecode.operators.matrix import dense_to_long, matmul, packed_products
from notecode.operators.sampling import seeded_hash
from notecode.operators.skew import hottest, skew_join
from notecode.session import materialised


def _with_val(y: DataFrame) -> DataFrame:
    return y if "val" in y.columns else y.withColumn("val", F.lit(1.0))


def pifa(y: DataFrame, x: DataFrame, normalise: bool = True) -> DataFrame:
    """Mean direction of a label's instances: rows of Y to unit length, ``Yᵀ·X``, rows to unit length."""
    weights = normalize_rows(_with_val(y).select("row_id", "label_id", "val"))
    if not normalise:
        return matmul(weights, x, "label_id", "row_id", "col_id")
    # a label has all its cells in one of the parts, which is partitioned by label
    parts = packed_products(weights, x, "label_id", "row_id", "col_id")
    return reduce(DataFrame.unionByName, [normalize_rows(p, row="label_id") for p in parts])


def pifa_dense(y: DataFrame, dense: DataFrame, normalise: bool = True) -> DataFrame:
    """The same for dense instance embeddings (row_id, embedding)."""
    return pifa(y, dense_to_long(dense), normalise)


def homer(y: DataFrame) -> DataFrame:
    """The instances of a label are its features."""
    return _with_val(y).select("label_id", F.col("row_id").alias("col_id"), "val")


def scale_normalize(y: DataFrame) -> DataFrame:
    """Divide each entry by the square roots of its row sum and its column sum; a zero sum counts as 1."""
    source = _with_val(y).select("row_id", "label_id", "val")
    entries = source
    for key in ("row_id", "label_id"):
        sums = source.groupBy(key).agg(F.sum("val").alias("_sum"))
        root = F.sqrt(F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum")))
        joined = skew_join(entries, sums, [key])
        entries = joined.withColumn("val", F.col("val") / root).drop("_sum")
    return entries.select("row_id", "label_id", "val")


def spectral(y: DataFrame, n_clusters: int, iterations: int = 4) -> DataFrame:
    """Left singular vectors of the scaled label × instance matrix, without the first one."""
    size = 1 + math.ceil(math.log2(n_clusters))
    scaled = scale_normalize(y).select(F.col("label_id").alias("row_id"), F.col("row_id").alias("col_id"), "val")
    scaled = materialised(scaled, "scaled")  # read in every iteration
    components, values = truncated_svd(scaled, size, iterations)
    image = project(scaled, components, len(values))
    scale = F.array(*[F.lit(float(1.0 / v)) if v > 1e-9 else F.lit(0.0) for v in values])
    unit = F.zip_with("vec", scale, lambda a, b: a * b)
    entries = image.select(F.col("row_id").alias("label_id"), F.posexplode(unit).alias("_dim", "val"))
    return entries.filter(F.col("_dim") > 0).select("label_id", (F.col("_dim") - 1).alias("col_id"), "val")


def hashed_tfidf(texts: DataFrame, width: int = 256) -> DataFrame:
    """TF-IDF of (row_id, text) folded into ``width`` hashed columns, unit length: (row_id, col_id, val).

    Texts are cut into terms once: their counts are stored and read for the weights and for the entries. A
    term is hashed with its weight, and rows are folded and get unit length, once, after one shuffle.
    """
    counts = materialised(term_counts(texts), "counts")
    weights = idf(document_frequency(counts), texts.agg(F.count("*")).scalar())
    column = F.pmod(seeded_hash(F.col("term"), "hash"), F.lit(width)).cast("int").alias("col_id")
    weights = materialised(weights.select("term", "df", "idf", column), "weights")
    joined = skew_join(counts, weights.drop("df"), ["term"], hot=hottest(weights, ["term"], "df"))
    folded = joined.repartition("row_id").groupBy("row_id", "col_id").agg(F.sum(F.col("n") * F.col("idf")).alias("val"))
    return normalize_rows(folded)


def embed_text(
    texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, width: int = 256
) -> DataFrame:
    """Embed the text of each label: (label_id, text) to (label_id, col_id, val), unit length.

    ``make_encoder`` is called once per task and returns a function from a list of texts to one
    vector per text. Without one, TF-IDF hashed to ``width`` columns is used.
    """
    if make_encoder is None:
        rows = hashed_tfidf(texts.withColumnRenamed("label_id", "row_id"), width)
        return rows.withColumnRenamed("row_id", "label_id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch["text"].tolist()), dtype=float)
            yield pd.DataFrame({"row_id": batch["label_id"], "embedding": list(vectors)})

    kind = texts.schema["label_id"].dataType.simpleString()
    dense = texts.select("label_id", "text").mapInPandas(encode, f"row_id {kind}, embedding array<double>")
    return normalize_rows(dense_to_long(dense)).withColumnRenamed("row_id", "label_id")


def label_features(
    method: str | DataFrame | None, y: DataFrame, x: DataFrame, n_labels: int | None = None, n_clusters: int = 16384
) -> DataFrame | None:
    """Label features by name (pifa, homer, spectral, none) or from a stored table.

    A stored table must have as many labels as ``n_labels``.
    """
    if isinstance(method, DataFrame):
        if n_labels is not None:
            found = method.select("label_id").distinct().count()
            if found != n_labels:
                raise ValueError(f"label features have {found} labels, not {n_labels}")
        return method
    name = (method or "none").lower()
    if name == "none":
        return None
    if name == "pifa":
        return pifa(y, x, normalise=False)
    if name == "homer":
        return homer(y)
    if name == "spectral":
        return spectral(y, n_clusters)
    raise ValueError(f"unknown label embedding {method!r}; known: pifa, homer, spectral, none")
