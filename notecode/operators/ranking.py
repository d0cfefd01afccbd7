"""Ranked predictions. Equal scores are ranked by label, so results are the same on every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.operators.skew import rank_in_groups, top_in_groups


def topk_per_row(
    pred: DataFrame,
    k: int | None = None,
    row: str = "row_id",
    col: str = "label_id",
    score: str = "score",
    largest: int | None = None,
) -> DataFrame:
    """The ``k`` best entries of each row, with ``rank`` from 1; ``None`` keeps all, 0 keeps none.

    ``largest`` is the longest row, or more, if it is known: it is not counted then.
    """
    return top_in_groups(pred, [row], [F.desc(score), F.col(col)], k, largest=largest)


def topk_per_column(pred: DataFrame, k: int | None = None, row: str = "row_id", col: str = "label_id") -> DataFrame:
    return topk_per_row(pred, k, row=col, col=row)


def longest_row(*preds: DataFrame) -> int:
    """The largest number of entries of any row in any of the predictions: one counting job for all."""
    lengths = [p.groupBy("row_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")) for p in preds]
    return reduce(DataFrame.unionByName, lengths).agg(F.max("n")).first()[0] or 0


def relevance(pred: DataFrame, longest: int | None = None) -> DataFrame:
    """Replace scores by ``longest - rank + 1``: the best of a row gets ``longest``, and none gets 0.

    The longest row also tells how large a group the ranking has to handle.
    """
    if longest is None:
        longest = longest_row(pred)
    ranked = rank_in_groups(pred, ["row_id"], [F.desc("score"), F.col("label_id")], largest=longest)
    return ranked.withColumn("score", (F.lit(longest) - F.col("rank") + 1).cast("double"))


def ordinal_rank(projected: DataFrame, n_labels: int, bins: int) -> DataFrame:
    """Bin of each label in each dimension by rank: (label_id, dim, bin)."""
    size = -(-n_labels // bins)
    ranked = rank_in_groups(projected, ["dim"], [F.col("val"), F.col("label_id")], largest=n_labels)
    return ranked.select("label_id", "dim", F.floor((F.col("rank") - 1) / size).cast("long").alias("bin"))


def topk_matcher(scores: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best clusters of each instance from matcher scores (row_id, code, val)."""
    return topk_per_row(scores, k, col="code", score="val")
