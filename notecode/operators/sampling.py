"""Seeded splits and samples that do not depend on how the data is partitioned."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.operators.skew import number_rows

HASH_RANGE = 2**32


def seeded_hash(key: Column, seed: int | str) -> Column:
    """A uniform integer below 2**32 that depends only on the key and the seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_of(key: str, seed: int | str) -> int:
    """``seeded_hash`` of one key, inside a task."""
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16)


def split_train_test(
    df: DataFrame, fraction: float = 0.66, seed: int = 42, key: str = "row_id", exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key into (train, test).

    By default each row is drawn on its own. With ``exact`` the train side has exactly
    ``round(fraction * rows)`` rows: those with the smallest hashes.
    """
    if not exact:
        chosen = seeded_hash(F.col(key), seed) < F.lit(int(fraction * HASH_RANGE))
        return df.filter(chosen), df.filter(~chosen)
    keyed = df.select(key, seeded_hash(F.col(key), seed).alias("_hash"))
    numbered = number_rows(keyed, [F.col("_hash"), F.col(key)], "_place")
    size = round(fraction * df.count())
    train_keys = numbered.filter(F.col("_place") < size).select(key)
    return df.join(train_keys, key, "left_semi"), complement(df, train_keys, key)


def subsample(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``n`` random rows: those with the smallest hash of the key, which must be unique.

    Rows are numbered in ranges of the hash, so no task sorts or holds all ``n``.
    """
    keyed = df.select(key, seeded_hash(F.col(key), seed).alias("_hash"))
    numbered = number_rows(keyed, [F.col("_hash"), F.col(key)], "_place")
    return df.join(numbered.filter(F.col("_place") < n).select(key), key, "left_semi")


def complement(df: DataFrame, subset: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is not in ``subset``."""
    return df.join(subset.select(key), key, "left_anti")
