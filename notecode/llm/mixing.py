"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through ``max_repeats`` times. The
virtual finish time of a document is the number of words its source has sent up to its end, divided by
the source's target. All queues are merged in the order of finish times and cut where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notecode.llm.texts import words_of
from notecode.session import materialised

GROUP_ROWS = 50_000  # aimed rows of one bucket of a queue, and of one bucket of finish times


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all words, dealt out by weight.

    Sources by code point, null last, take ``weights`` in turn. No target exceeds ``max_repeats`` times
    the words of its source; the excess is dealt out again by weight until none does. That end point is
    min(weight * level, cap) for one common level, found by going through the sources in the order of
    cap / weight: one row per source, so these windows are as small as the list of sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("long"))
    sources = sources.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    everyone = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everyone) * F.lit(share)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sharing = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("level", left / sharing)
    open_ended = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    # the level grows up to the first source that it leaves below its cap, and falls from there on
    sources = sources.withColumn("level", F.max(open_ended).over(everyone))
    target = F.least("cap", F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return sources.select("source", "source_size", target.alias("target"))


def shuffle_key(row_id: Column, seed: str) -> Column:
    """Hexadecimal digest of seed and id: the shuffled order, the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row for each input row.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix holds the document and
    ``taken`` the words it takes. Documents are taken whole, so a source misses its target by about a
    document. The order within a source is that of a digest of the id; rows repeated with their id
    follow each other, so which of them is taken is the same in every run only if they are alike. A
    null source is a source of its own, a null id is ordered by the digest of "null". Documents
    without words take part with size 0 and are never taken. Other columns are ignored; an empty table
    gives no rows.

    A source of any size is spread over many tasks: its queue is cut into buckets by the leading digits
    of the digest, only bucket totals are summed along the queue, and rows are summed inside a bucket.
    Likewise finish times fall into buckets, whose totals show in which one the budget ends; only the
    rows of that bucket are sorted.
    """
    sizes = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")
    )
    sizes = sizes.withColumn("key", shuffle_key(F.col("doc_id"), seed))
    sizes = materialised(sizes, "sizes")
    targets = materialised(source_targets(sizes, weights, share, max_repeats), "targets")
    rows = sizes.count()
    digits = 1
    while 16**digits * group_rows < rows:
        digits += 1

    queue = sizes.withColumn("bucket", F.substring("key", 1, digits))
    totals = queue.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    upto = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queue = queue.withColumn("inside", F.sum("size").over(upto))
    queue = queue.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s")
    queue = queue.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    sent = F.col("before") + F.col("inside")
    queue = queue.select("doc_id", "source", "size", "source_size", "target", "key", sent.alias("sent"))
    queue = materialised(queue, "queue")

    rounds = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    sending = queue.filter("size > 0 AND target > 0").withColumn("round", rounds)
    finish = (F.col("round") * F.col("source_size") + F.col("sent")) / F.col("target")
    sending = sending.withColumn("finish", finish.cast("double"))
    steps = max(1, -(-rows * max_repeats // group_rows))
    # finish times beyond the end of the budget share the last bucket, which is never sorted
    sending = sending.withColumn("step", F.least(F.floor(F.col("finish") * steps), F.lit(4 * steps)))
    per_step = sending.groupBy("step").agg(F.sum("size").alias("n"))
    ahead = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)  # one row per step
    per_step = per_step.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    budget = float(targets.agg(F.sum("target")).first()[0] or 0.0)
    full = F.col("ahead") + F.col("n") <= budget
    per_step = materialised(per_step.select("step", "ahead", full.alias("full")).filter(F.col("ahead") <= budget), "steps")
    marked = sending.join(per_step, "step")
    order = W.partitionBy("step").orderBy("finish", "key", "doc_id", "round").rowsBetween(W.unboundedPreceding, 0)
    edge = marked.filter("NOT full").withColumn("total", F.col("ahead") + F.sum("size").over(order))
    whole = marked.filter("full").select("doc_id", "key", "source", "sent", "round")
    taken = whole.union(edge.filter(F.col("total") <= budget).select("doc_id", "key", "source", "sent", "round"))
    taken = taken.groupBy(F.col("key").alias("_k"), F.col("source").alias("_s"), F.col("sent").alias("_n")).agg(F.count("*").alias("copies"))
    same = (F.col("key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("sent") == F.col("_n")) & (F.col("size") > 0)
    out = queue.join(taken, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies")
    )
    return out.withColumn("taken", F.col("copies") * F.col("size"))
