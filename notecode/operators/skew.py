"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notecode.session import checkpointed

HOT_KEYS = 64  # most frequent keys that are salted; any other key holds less than 1/65 of the rows
SALTS = 32  # pieces per hot key
MAX_GROUP_ROWS = 1_000_000  # largest group ranked by one window task
PRUNED_RANK = 1000  # up to here Spark prunes a ranked window before its shuffle


def hottest(counts: DataFrame, keys: Sequence[str], by: str, n: int = HOT_KEYS) -> DataFrame:
    """The ``n`` keys with the largest ``by``: never more than ``n`` rows, so always safe to broadcast."""
    return counts.orderBy(F.desc(by), *keys).limit(n).select(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str], n: int = HOT_KEYS) -> DataFrame:
    """The ``n`` most frequent keys of ``df``; counts are combined before the shuffle."""
    return hottest(df.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, "_rows", n)


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``big ⋈ small`` where some keys may hold a large share of the rows of ``big``.

    Without ``hot`` this is a plain join, whose oversized partitions adaptive execution splits at run
    time from the sizes it measured; nothing is counted beforehand. Where the frequent keys are known
    anyway, ``hot`` names them (at most a few dozen rows, for all or some of the key columns): their
    rows are then spread over ``salts`` tasks whatever the session settings, and only the hot keys of
    ``small`` are repeated. The salt is a hash of the row itself, so a retried task makes the same
    choice. ``how`` may be any join that keeps or drops rows of ``big``: inner, left, left_semi,
    left_anti.
    """
    on = list(on)
    if hot is None:
        return big.join(small, on, how)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    hot_on = hot.columns
    rest = [c for c in big.columns if c not in on]
    spread = F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int") if rest else F.lit(0)
    left = big.join(marked, hot_on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    every_salt = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(marked, hot_on, "left").withColumn("_salt", F.explode(every_salt)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def rank_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    max_group: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of every row within its group. ``order`` must be a total order.

    Groups up to ``max_group`` rows use a plain window. If the largest group is bigger (its size
    is counted, unless the caller knows it and passes ``largest``), rows are range-partitioned by
    (keys, order), so that a group may span many tasks: the rank is the rank inside one range plus
    the rows of the same group in earlier ranges. Both ways give the same ranks.
    """
    keys = list(keys)
    if largest is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= max_group:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # the range bounds are sampled: both uses below must see the same ones
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_inside").cast("long") + F.col("_offset"))
        .drop("_inside", "_offset", "_range")
    )


def top_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank", largest: int | None = None
) -> DataFrame:
    """Rank rows within their group and keep the first ``k`` (all of them when ``k`` is None).

    For small ``k`` the window is pruned to ``k`` rows per group and input partition before the
    shuffle, so a hot group never reaches one task whole. Otherwise the largest group is counted, unless
    the caller passes it, or a number that it cannot exceed, as ``largest``.
    """
    if k is not None and k <= PRUNED_RANK:
        window = W.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
        return ranked.withColumn(name, F.col(name).cast("long"))
    ranked = rank_in_groups(df, keys, order, name, largest=largest)
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows in ``order`` (a total order) without a one-task sort."""
    sort_range = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(sort_range, *order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    # one row per range, so this window sees at most `sort_range` rows
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, "_range")
        .withColumn(name, F.col("_inside").cast("long") + F.col("_offset") + F.lit(start - 1))
        .drop("_inside", "_offset", "_range")
    )
