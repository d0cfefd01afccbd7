"""Label indexing: a cluster code for every label, (label_id, code).

A code of depth ``d`` is a path in a binary tree: bit by bit from the most significant one, 0 is the
left and 1 the right child.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notecode.operators.decomposition import normal_row
from notecode.operators.features import normalize_rows
from notecode.operators.matrix import numbered_columns
from notecode.operators.ranking import ordinal_rank
from notecode.operators.sampling import hash_of, seeded_hash
from notecode.operators.skew import rank_in_groups, skew_join, top_in_groups
from notecode.session import checkpointed, materialised
from notecode.sources.store import content_of, publish, published

NODE_ENTRIES = 500_000  # most feature entries and labels of a node that is split in one task
SENT_ROWS = 1_000_000  # most rows that are sent to all blocks of a level at once
KNOWN_COLUMNS = 100_000  # rows of a random matrix that a task remembers
SCORE_DIGITS = 6  # scores are rounded before they are ranked, so that summation order cannot matter


def tree_depth(n_labels: int, cluster_size: int = 100, extra: int = 0) -> int:
    """Depth that leaves about ``cluster_size`` labels per cluster, and ``extra`` levels below that."""
    return int(math.log2(n_labels // cluster_size + 1)) + extra


def labels_of(features: DataFrame) -> DataFrame:
    return features.select("label_id").distinct()


# --- balanced two-means ----------------------------------------------------------------------


def balanced_2means(
    features: DataFrame,
    depth: int,
    max_iter: int = 20,
    seed: int = 0,
    spherical: bool = False,
    labels: DataFrame | None = None,
    node_entries: int = NODE_ENTRIES,
) -> DataFrame:
    """Split the labels ``depth`` times into a left half of ⌊n/2⌋ and a right half.

    All nodes of a level are split in the same jobs. A node starts from two random labels; then the
    direction between the two halves' means (or, ``spherical``, between their unit sums) scores
    every label, and the halves are taken in score order until they no longer change.

    Nodes are counted first: one of up to ``node_entries`` feature entries is split down to the last
    level in one task. The larger ones above, at most a few levels, are packed into blocks of about that
    size, once for each level; a round reads the blocks twice, for the halves' sums and for the scores.
    """
    labels = labels_of(features) if labels is None else labels.select("label_id")
    lengths = features.groupBy("label_id").agg(F.count("*").alias("_n"))
    first = labels.join(lengths, "label_id", "left").select("label_id", (F.coalesce("_n", F.lit(0)) + 1).alias("_n"))
    state = materialised(first.select("label_id", F.lit(1).cast("long").alias("node"), F.col("label_id").alias("place"), "_n"), "state")
    done = []
    named = True
    for level in range(depth):
        sizes = state.groupBy("node").agg(F.sum("_n").alias("_entries"), F.count("*").alias("_labels"))
        sizes = materialised(sizes, "sizes")  # a row for each node
        small = sizes.filter(F.col("_entries") <= node_entries).select("node")
        large = materialised(sizes.filter(F.col("_entries") > node_entries), "large")
        largest = large.agg(F.max("_labels")).first()[0]
        if largest is not None and named:  # entries are read in every level from here on: numbers are shorter than names
            features, named = materialised(numbered_columns(features), "features"), False
        done.append(_split_nodes(features, state.join(small, "node", "left_semi"), depth - level, max_iter, seed, spherical))
        if largest is None:
            break
        kept = state.join(large.select("node"), "node", "left_semi").groupBy("label_id", "node", "_n")
        kept = materialised(kept.agg(F.min("place").alias("place"), F.count("*").alias("_copies")), "kept")
        split = _split_level(features, kept, largest, max_iter, seed, spherical, node_entries)
        again = F.explode(F.array_repeat(F.col("_n"), F.col("_copies").cast("int"))).alias("_n")
        state = materialised(split.select("label_id", "node", "place", again), "state")
    else:
        done.append(state.select("label_id", "node"))
    return reduce(DataFrame.unionByName, done).select("label_id", (F.col("node") - F.lit(2**depth)).cast("long").alias("code"))


def _split_nodes(features: DataFrame, state: DataFrame, levels: int, max_iter: int, seed: int, spherical: bool) -> DataFrame:
    """All ``levels`` splits of nodes that fit in a task each: (label_id, node)."""
    rows = state.join(features, "label_id", "left").select("node", "label_id", "place", "col_id", "val")
    kind = state.schema["label_id"].dataType.simpleString()
    return rows.groupBy("node").applyInPandas(_subtree(levels, max_iter, seed, spherical), f"label_id {kind}, node long")


def _subtree(levels: int, max_iter: int, seed: int, spherical: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows.drop_duplicates("label_id").sort_values(["place", "label_id"])
        ids = heads["label_id"].to_numpy()
        known = rows[rows["col_id"].notna()].sort_values(["label_id", "col_id"])
        at, cols = pd.Index(ids).get_indexer(known["label_id"]), pd.factorize(known["col_id"])[0]
        vals, width = known["val"].to_numpy(np.float64), int(cols.max()) + 1 if len(cols) else 1
        order = np.argsort(at, kind="stable")
        at, cols, vals = at[order], cols[order], vals[order]
        ends = np.searchsorted(at, np.arange(len(ids) + 1))
        out = np.empty(len(ids), np.int64)
        todo = [(int(rows["node"].iloc[0]), np.arange(len(ids)), levels)]
        while todo:
            node, members, left = todo.pop()
            if left == 0:
                out[members] = node
                continue
            side, members = _halves(node, members, ids, (ends, cols, vals, width), max_iter, seed, spherical)
            todo += [(2 * node + s, members[side == bool(s)], left - 1) for s in (0, 1) if (side == bool(s)).any()]
        return pd.DataFrame({"label_id": ids, "node": out})

    return run


def _halves(node: int, members: np.ndarray, ids: np.ndarray, entries: tuple, max_iter: int, seed: int, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """The members of a node in their final order, and which of them go right."""
    n, (ends, cols, vals, width) = len(members), entries
    side = np.arange(n) >= n // 2
    if n < 2:
        return side, members
    size = ends[members + 1] - ends[members]
    place = np.repeat(ends[members] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    owner, col, val = np.repeat(np.arange(n), size), cols[place], vals[place]
    lots = np.array([hash_of(f"{node}/{ids[k]}", seed) for k in members.tolist()], np.int64)
    low, high = np.lexsort((ids[members], lots))[:2]
    weight = np.zeros(n)
    weight[low], weight[high] = -1.0, 1.0
    rank = np.arange(n)
    for step in range(max_iter):
        if step:
            weight = np.where(side, 1.0, -1.0)
            for s in (False, True):
                part = np.bincount(col, np.where(side[owner] == s, val, 0.0), width)
                total = np.sqrt((part * part).sum()) if spherical else float((side == s).sum())
                weight[side == s] /= total if total else 1.0
        centre = np.bincount(col, val * weight[owner], width)
        score = np.round(np.bincount(owner, val * centre[col], n), SCORE_DIGITS)
        order = np.lexsort((ids[members], score))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        new = rank >= n // 2
        same = (new == side).all()
        side = new
        if same:
            break
    order = np.argsort(rank)
    return side[order], members[order]


def balanced_skmeans(features: DataFrame, depth: int, max_iter: int = 20, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """Balanced spherical two-means over unit-length label features (the default indexer)."""
    return balanced_2means(normalize_rows(features, row="label_id"), depth, max_iter, seed, True, labels)


def _split_level(
    features: DataFrame, state: DataFrame, largest: int, max_iter: int, seed: int, spherical: bool, node_entries: int
) -> DataFrame:
    """One split of nodes of any size: (label_id, node, place, _n, _copies)."""
    sizes = state.groupBy("node").agg(F.count("*").alias("_size"))
    by_place = rank_in_groups(state, ["node"], [F.col("place"), F.col("label_id")], "rank", largest=largest).drop("place")
    ready = by_place.join(sizes, "node").withColumn("side", F.col("rank") > F.floor(F.col("_size") / 2))
    # nodes of one label have nothing to split: the label is their right half
    settled = [ready.filter(F.col("_size") < 2)]
    active = materialised(ready.filter(F.col("_size") >= 2), "active")
    blocks, members, columns = _blocks_of(features, state, node_entries)
    for step in range(max_iter):
        centre = _first_centre(features, active, seed) if step == 0 else _centre(blocks, members, active, spherical)
        scores = _scores(blocks, columns, centre)
        same = F.col("label_id").eqNullSafe(F.col("_label"))  # a label without features scores 0
        scored = active.drop("rank").join(scores, same, "left").withColumn("_score", F.coalesce("_score", F.lit(0.0))).drop("_label")
        ranked = rank_in_groups(scored, ["node"], [F.col("_score"), F.col("label_id")], "rank", largest=largest).drop("_score")
        moved = ranked.withColumn("_side", F.col("rank") > F.floor(F.col("_size") / 2))
        changed = F.max(F.col("_side") != F.col("side")).over(W.partitionBy("node"))
        after = materialised(moved.withColumn("_changed", changed).drop("side").withColumnRenamed("_side", "side"), "after")
        settled.append(after.filter(~F.col("_changed")).drop("_changed"))
        active = after.filter("_changed").drop("_changed")
        if active.isEmpty():
            break
    settled.append(active)
    everyone = reduce(DataFrame.unionByName, settled)
    child = F.col("node") * 2 + F.col("side").cast("int")
    return everyone.select("label_id", child.alias("node"), F.col("rank").alias("place"), "_n", "_copies")


def _blocks_of(features: DataFrame, state: DataFrame, block_entries: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries of all nodes in blocks of about ``block_entries``, stored, and which labels and columns a block has.

    Labels are dealt to the blocks of their node by hash; one with more entries than a block is dealt by
    column, and its scores are summed over its blocks.
    """
    counted = state.groupBy("node").agg(F.ceil(F.sum(F.col("_n") * F.col("_copies")) / block_entries).alias("_blocks"))
    counted = materialised(counted, "counted")  # a row for each node
    n_blocks = counted.agg(F.sum("_blocks")).first()[0]
    rows = state.join(counted, "node").select("label_id", "node", "_n", "_copies", "_blocks").join(features, "label_id")
    piece = F.pmod(F.xxhash64("col_id"), F.ceil(F.col("_n") / block_entries))
    block = F.pmod(F.xxhash64("label_id", piece), F.col("_blocks")).cast("int").alias("block")
    rows = rows.select("node", block, "label_id", "col_id", (F.coalesce("val", F.lit(0.0)) * F.col("_copies")).cast("double").alias("val"))
    label, col = (features.schema[n].dataType.simpleString() for n in ("label_id", "col_id"))
    schema = f"node long, block int, ids array<{label}>, owner array<int>, col_ids array<{col}>, cols array<int>, vals array<double>"
    packed = rows.repartition(n_blocks, "node", "block").groupBy("node", "block").applyInPandas(_pack_block, schema)
    packed = materialised(packed, "blocks")
    members = materialised(packed.select("node", "block", F.posexplode("ids").alias("at", "label_id")), "members")
    columns = materialised(packed.select("node", "block", F.posexplode("col_ids").alias("at", "col_id")), "columns")
    return packed, members, columns


def _pack_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["label_id", "col_id"])  # a fixed order, so that sums do not depend on the shuffle
    owner, ids = pd.factorize(rows["label_id"])
    cols, col_ids = pd.factorize(rows["col_id"])
    head = {"node": [rows["node"].iloc[0]], "block": [rows["block"].iloc[0]]}
    return pd.DataFrame(
        head | {"ids": [ids.to_numpy()], "owner": [owner.astype(np.int32)], "col_ids": [col_ids.to_numpy()], "cols": [cols.astype(np.int32)], "vals": [rows["val"].to_numpy()]}
    )


def _visited(blocks: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks beside what their ``values`` (node, block, at, ...) say; ``known`` has as many rows as those at most."""
    rest = [n for n in values.columns if n not in ("node", "block")]
    listed = values.groupBy("node", "block").agg(F.collect_list(F.struct(*rest)).alias("given"))
    given = listed.select("node", "block", *[F.col(f"given.{n}").alias(f"given_{n}") for n in rest])
    return blocks.join(F.broadcast(given) if known.count() <= SENT_ROWS else given, ["node", "block"])


def _scores(blocks: DataFrame, columns: DataFrame, centre: DataFrame) -> DataFrame:
    """Every label's product with the centre of its node: (_label, _score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, owner, cols, vals, width, at, given in zip(*[batch[n] for n in ("ids", "owner", "cols", "vals", "width", "given_at", "given__c")]):
                centre = np.zeros(width)
                centre[at] = given
                yield pd.DataFrame({"_label": ids, "_score": np.bincount(owner, vals * centre[cols], len(ids))})

    visited = _visited(blocks, columns.join(centre, ["node", "col_id"]).drop("col_id"), columns)
    visited = visited.select("ids", "owner", "cols", "vals", F.size("col_ids").alias("width"), "given_at", "given__c")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shares = visited.mapInPandas(run, f"_label {kind}, _score double")
    return shares.groupBy("_label").agg(F.round(F.sum("_score"), SCORE_DIGITS).alias("_score"))


def _first_centre(features: DataFrame, active: DataFrame, seed: int) -> DataFrame:
    """Difference between two random labels of each node."""
    lot = seeded_hash(F.concat_ws("/", F.col("node").cast("string"), F.col("label_id").cast("string")), seed)
    drawn = top_in_groups(active.select("label_id", "node", "_copies", lot.alias("_lot")), ["node"], [F.col("_lot"), F.col("label_id")], 2, "_draw")
    picked = features.join(drawn.select("label_id", "node", "_copies", "_draw"), "label_id").withColumn("val", F.col("val") * F.col("_copies"))
    signed = F.when(F.col("_draw") == 2, F.col("val")).otherwise(-F.col("val"))
    return picked.groupBy("node", "col_id").agg(F.sum(signed).alias("_c"))


def _centre(blocks: DataFrame, members: DataFrame, active: DataFrame, spherical: bool) -> DataFrame:
    """Direction from the left to the right half of each node: (node, col_id, _c)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, owner, col_ids, cols, vals, at, side in zip(*[batch[n] for n in ("node", "owner", "col_ids", "cols", "vals", "given_at", "given_side")]):
                right = np.zeros(len(at))
                right[at] = side
                total, of_right = np.bincount(cols, vals, len(col_ids)), np.bincount(cols, vals * right[owner], len(col_ids))
                yield pd.DataFrame({"node": node, "col_id": col_ids, "_left": total - of_right, "_right": of_right})

    sides = members.join(active.select("label_id", "node", "side"), ["label_id", "node"]).drop("label_id")
    visited = _visited(blocks, sides, members).select("node", "owner", "col_ids", "cols", "vals", "given_at", "given_side")
    kind = blocks.schema["col_ids"].dataType.elementType.simpleString()
    shares = visited.mapInPandas(run, f"node long, col_id {kind}, _left double, _right double")
    sums = materialised(shares.groupBy("node", "col_id").agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right")), "sums")
    halves = ("_left", "_right")
    if spherical:
        norms = sums.groupBy("node").agg(*[F.sqrt(F.sum(F.col(h) * F.col(h))).alias(f"{h}_d") for h in halves])
    else:
        norms = active.groupBy("node").agg(*[F.count_if(F.col("side") == F.lit(h == "_right")).cast("double").alias(f"{h}_d") for h in halves])
    left, right = (F.col(h) / F.when(F.col(f"{h}_d") == 0, 1.0).otherwise(F.col(f"{h}_d")) for h in halves)
    return sums.join(norms, "node").select("node", "col_id", (right - left).alias("_c"))


# --- median splits and random projections ----------------------------------------------------


def kdtree(features: DataFrame, depth: int, n_features: int, cyclic: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """Split at the median of one feature per level: feature ``level mod n_features``.

    ``cyclic`` stays with a feature for ``depth // n_features`` levels before it takes the next one.
    Column ids are 0 .. n_features-1; a missing entry counts as 0.
    """
    labels = labels_of(features) if labels is None else labels.select("label_id")
    n_labels = labels.count()
    state = labels.withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        step = level // max(1, depth // n_features) if cyclic else level
        column = features.filter(F.col("col_id") == step % n_features).select("label_id", F.round("val", SCORE_DIGITS).alias("_v"))
        valued = state.join(column, "label_id", "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
        largest = -(-n_labels // 2**level)
        ranked = rank_in_groups(valued, ["node"], [F.col("_v"), F.col("label_id")], "_rank", largest=largest)
        sizes = state.groupBy("node").agg(F.count("*").alias("_size"))
        right = F.col("_rank") > F.floor(F.col("_size") / 2)
        state = checkpointed(ranked.join(sizes, "node").select("label_id", (F.col("node") * 2 + right.cast("int")).alias("node")))
    return state.select("label_id", (F.col("node") - F.lit(2**depth)).cast("long").alias("code"))


def random_projection(features: DataFrame, dims: int, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """``L·G`` for a seeded Gaussian matrix: (label_id, dim, val), zeros for labels without features.

    The matrix is a function of column, dimension and seed, so nothing is joined or broadcast: a task makes
    the rows of the columns it meets, and sums its entries of a label before they are shuffled.
    """
    labels = labels_of(features) if labels is None else labels.select("label_id")
    kind = features.schema["label_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            cols, ids = batch["col_id"].dictionary_encode(), batch["label_id"].dictionary_encode("encode")
            if len(known) > KNOWN_COLUMNS:
                known.clear()
            for name in cols.dictionary.to_pylist():
                if name not in known:
                    known[name] = normal_row(name, dims, seed)
            rows = np.array([known[name] for name in cols.dictionary.to_pylist()] + [np.zeros(dims)])
            at = cols.indices.fill_null(len(rows) - 1).to_numpy(zero_copy_only=False)
            val, owner = batch["val"].fill_null(0.0).to_numpy(zero_copy_only=False), ids.indices.to_numpy(zero_copy_only=False)
            sums = np.stack([np.bincount(owner, val * rows[at, i], len(ids.dictionary)) for i in range(dims)], axis=1)
            vec = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, dims, dtype=np.int32), sums.ravel())
            yield pa.RecordBatch.from_arrays([ids.dictionary, vec], ["label_id", "vec"])

    if dims < 1:
        return labels.select("label_id", F.lit(0).alias("dim"), F.lit(0.0).alias("val")).limit(0)
    entries = features.select("label_id", F.col("col_id").cast("string").alias("col_id"), F.col("val").cast("double").alias("val"))
    products = entries.mapInArrow(project, f"label_id {kind}, vec array<double>")
    zeros = labels.select("label_id", F.array_repeat(F.lit(0.0), dims).alias("vec"))
    summed = products.unionByName(zeros).groupBy("label_id").agg(F.array(*[F.sum(F.col("vec")[i]) for i in range(dims)]).alias("vec"))
    return summed.select("label_id", F.posexplode("vec").alias("dim", "val")).withColumn("val", F.round("val", SCORE_DIGITS))


def _packed(bins: DataFrame, kdim: int) -> DataFrame:
    weight = F.pow(F.lit(float(kdim)), F.col("dim")).cast("long")
    return bins.groupBy("label_id").agg(F.sum(F.col("bin") * weight).alias("code"))


def ordinal_codes(features: DataFrame, kdim: int, depth: int, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """Random projection, each dimension cut into ``kdim`` bins of equal size."""
    labels = labels_of(features) if labels is None else labels
    projected = materialised(random_projection(features, depth, seed, labels), "projected")
    return _packed(ordinal_rank(projected, labels.count(), kdim), kdim)


def uniform_codes(features: DataFrame, kdim: int, depth: int, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """Random projection, each dimension cut at ``kdim`` evenly spaced points from its minimum to its maximum."""
    projected = materialised(random_projection(features, depth, seed, labels), "projected")
    ranges = projected.groupBy("dim").agg(F.min("val").alias("_lo"), F.max("val").alias("_hi"))
    joined = skew_join(projected, ranges, ["dim"])
    # points lo, lo+step, ..., hi: the bin is the number of points not above the value, minus one
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(max(kdim - 1, 1)))
    inner = F.coalesce(F.floor(F.try_divide(F.col("val") - F.col("_lo"), step)), F.lit(kdim - 1))
    bin_ = F.when(F.col("val") >= F.col("_hi"), F.lit(kdim - 1)).otherwise(F.least(inner, F.lit(max(kdim - 2, 0))))
    return _packed(joined.select("label_id", "dim", bin_.cast("long").alias("bin")), kdim)


def balanced_ordinal_codes(features: DataFrame, kdim: int, depth: int, seed: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """Random projection, then a cyclic kd-tree over the projected dimensions; ``kdim`` is a power of two."""
    bits = int(math.log2(kdim))
    if 2**bits != kdim:
        raise ValueError(f"kdim must be a power of two, not {kdim}")
    projected = checkpointed(random_projection(features, depth, seed, labels).withColumnRenamed("dim", "col_id"))
    return kdtree(projected, depth * bits, depth, True, labels)


def random_codes(labels: DataFrame, depth: int, seed: int = 0, kdim: int = 2) -> DataFrame:
    """A uniformly random cluster per label."""
    return labels.select("label_id", F.pmod(seeded_hash(F.col("label_id"), f"s{seed}"), F.lit(kdim**depth)).alias("code"))


# --- reading and storing codes ---------------------------------------------------------------

# Indexer names and the algorithm each stands for.
ALGORITHMS = {
    "none": "skmeans",
    "skmeans": "skmeans",
    "kmeans": "kmeans",
    "kdtree": "kdtree",
    "random": "random",
    "ordinal": "balanced-ordinal",
    "uniform": "uniform",
}


def index_labels(
    method: str | DataFrame | None,
    features: DataFrame,
    depth: int | None = None,
    seed: int = 0,
    max_iter: int = 20,
    n_features: int | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Codes by indexer name, or a stored table as it is. The default depth is for clusters of 100 labels."""
    if isinstance(method, DataFrame):
        return method.select("label_id", "code")
    name = (method or "none").lower()
    if name not in ALGORITHMS:
        raise ValueError(f"unknown indexer {method!r}; known: {sorted(ALGORITHMS)}")
    labels = labels_of(features) if labels is None else labels
    if depth is None:
        depth = tree_depth(labels.count())
    algorithm = ALGORITHMS[name]
    if algorithm == "skmeans":
        return balanced_skmeans(features, depth, max_iter, seed, labels)
    if algorithm == "kmeans":
        return balanced_2means(features, depth, max_iter, seed, False, labels)
    if algorithm == "kdtree":
        if n_features is None:
            n_features = features.agg(F.max("col_id")).first()[0] + 1
        return kdtree(features, depth, n_features, labels=labels)
    if algorithm == "random":
        return random_codes(labels, depth, seed)
    if algorithm == "balanced-ordinal":
        return balanced_ordinal_codes(features, 2, depth, seed, labels)
    return uniform_codes(features, 2, depth, seed, labels)


def parent_code(code: Column, levels_up: int = 1) -> Column:
    """The cluster of a code some levels further up."""
    return F.shiftright(code, levels_up)


def code_paths(codes: DataFrame, depth: int) -> DataFrame:
    """The ancestor of each label's cluster on every level: (label_id, level, code)."""
    level = F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")
    spread = codes.select("label_id", F.col("code").cast("long").alias("_leaf"), level)
    return spread.select("label_id", "level", F.expr(f"shiftright(_leaf, {depth} - level)").alias("code"))


def consecutive_merge(labels: DataFrame, splits: int = 2) -> DataFrame:
    """Merge every ``splits`` consecutive labels into one cluster."""
    return labels.select("label_id", F.floor(F.col("label_id") / splits).cast("long").alias("code"))


def cluster_sizes(codes: DataFrame) -> DataFrame:
    return codes.groupBy("code").agg(F.count("*").alias("n_labels"))


def cluster_members(codes: DataFrame) -> DataFrame:
    """Labels of each cluster in order: (code, place, label_id)."""
    return rank_in_groups(codes, ["code"], [F.col("label_id")], "place").select("code", "place", "label_id")


def cached_codes(
    spark: SparkSession, folder: str, features: DataFrame, embedding: str, method: str, seeds: tuple[int, ...] = (0, 1, 2), **params
) -> DataFrame:
    """Codes for each seed, built only if ``folder`` does not hold them for the same parameters and content yet.

    The key of a seed is a digest of the parameters and of all values of the label features (and of a table
    among the parameters). Each key is published by itself, so codes half written do not count. Returns
    (key, seed, label_id, code).
    """
    content = {name: list(content_of(v)) if isinstance(v, DataFrame) else v for name, v in params.items()}
    content["features"] = list(content_of(features))
    tables = []
    for seed in seeds:
        settings = json.dumps({"embedding": embedding, "method": method, "seed": seed, **content}, sort_keys=True)
        key = hashlib.md5(settings.encode()).hexdigest()
        if not published(spark, f"{folder}/{key}"):
            codes = index_labels(method, features, seed=seed, **params)
            publish({"codes": codes.select("label_id", "code")}, f"{folder}/{key}")
        stored = published(spark, f"{folder}/{key}")["codes"]
        tables.append(stored.select(F.lit(key).alias("key"), F.lit(seed).alias("seed"), "label_id", "code"))
    return reduce(DataFrame.unionByName, tables)
