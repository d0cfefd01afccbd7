"""Ensembles of several predictions (row_id, label_id, score) of the same instances and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.operators.evaluation import precision_recall_at_k
from notecode.operators.skew import rank_in_groups
from notecode.session import materialised

CELL = ("row_id", "label_id")


def _stack(preds: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*CELL, "score") for p in preds])


def ensemble_average(*preds: DataFrame) -> DataFrame:
    """Mean score, where a label missing from a prediction counts as 0."""
    return _stack(preds).groupBy(*CELL).agg((F.sum("score") / len(preds)).alias("score"))


def _ranked(preds: Sequence[DataFrame]) -> tuple[DataFrame, int]:
    """All predictions in one table, numbered, with the rank of each label in its row, and the longest row.

    The predictions are read twice: the longest row is counted first, and tells the ranking how large a group
    it has to handle. Nothing is stored, so that predictions partitioned by row are counted, ranked and combined
    without another shuffle.
    """
    numbered = [p.select(F.lit(i).alias("model"), *CELL, "score") for i, p in enumerate(preds)]
    stacked = reduce(DataFrame.unionByName, numbered)
    longest = stacked.groupBy("model", "row_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return rank_in_groups(stacked, ["model", "row_id"], [F.desc("score"), F.col("label_id")], largest=longest), longest


def combined(preds: Sequence[DataFrame]) -> DataFrame:
    """The scores of all ensembles by one ranking and one sum: (row_id, label_id, average, rank_average, round_robin)."""
    ranked, longest = _ranked(preds)
    n = len(preds)
    relevance = (F.lit(longest) - F.col("rank") + 1).cast("double")
    lead = (F.lit(float(n)) - F.col("model")) / F.lit(n + 1.0)
    return ranked.groupBy(*CELL).agg(
        (F.sum("score") / n).alias("average"),
        (F.sum(relevance) / n).alias("rank_average"),
        (F.max(relevance + lead) / n).alias("round_robin"),
    )


def ensemble_rank_average(*preds: DataFrame) -> DataFrame:
    """Mean of rank-based relevances, counted down from the longest row of all predictions."""
    return combined(preds).select(*CELL, F.col("rank_average").alias("score"))


def ensemble_round_robin(*preds: DataFrame) -> DataFrame:
    """Interleave: first choices of all predictions in order, then second choices, and so on."""
    return combined(preds).select(*CELL, F.col("round_robin").alias("score"))


ENSEMBLES = {
    "average": ensemble_average,
    "rank_average": ensemble_rank_average,
    "round_robin": ensemble_round_robin,
}


def compare_ensembles(
    truth: DataFrame, preds: Mapping[str, DataFrame], instances: DataFrame, depth: int = 10
) -> DataFrame:
    """Metrics of each prediction and of each ensemble of them: (model, k, precision, recall)."""
    together = materialised(combined(list(preds.values())), "ensembles")
    candidates = dict(preds) | {name: together.select(*CELL, F.col(name).alias("score")) for name in ENSEMBLES}
    results = [
        precision_recall_at_k(truth, pred, instances, depth).select(F.lit(name).alias("model"), "k", "precision", "recall")
        for name, pred in candidates.items()
    ]
    return reduce(DataFrame.unionByName, results)
