"""Sparse matrix operators over long tables (row_id, col_id, val).

Explicit zeros are ordinary rows. A long table has no empty rows or columns, so operators that need
the full shape take the table of instances or labels as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notecode.operators.skew import hottest, number_rows, skew_join, top_in_groups
from notecode.session import checkpointed, materialised

SENT = 100_000  # packed rows that are unpacked and summed by one task
PAIRS = 20_000  # pairs of a row and a label that are scored together
MAX_CELLS = 5_000_000  # largest table of weights kept as a dense array
FREQUENT = 100_000  # entries of a row from which its products are summed in all tasks
PRODUCT_CELLS = 4_000_000  # cells of a matrix whose products are summed and ranked by one task
LISTED = 10_000  # labels of a cluster that are packed together
SHORT = 32_767  # names that are numbered in two bytes
GRID_ROWS = 1000  # instances that are scored together for a block of labels
GRID_CELLS = 2_000_000  # largest dense table of the weights of a block of labels
GRID_TASK = 16_000_000  # scores made by one task where there are many
GRID_LEAST = 250_000  # scores worth a task of their own
AT_ONCE = 250_000  # products that are summed at once


def append_bias(x: DataFrame, instances: DataFrame, value: float, col_id: Column) -> DataFrame:
    """Add a constant column; instances without any feature get it too."""
    return x.unionByName(instances.select("row_id", col_id.alias("col_id"), F.lit(float(value)).alias("val")))


def dense_to_long(dense: DataFrame, vector: str = "embedding") -> DataFrame:
    entries = dense.select("row_id", F.posexplode(vector).alias("col_id", "val"))
    return entries.withColumn("val", F.col("val").cast("double"))


def long_to_vectors(x: DataFrame) -> DataFrame:
    """One row per instance with its column ids and values as arrays, in column order."""
    entries = F.sort_array(F.collect_list(F.struct("col_id", "val")))
    return x.groupBy("row_id").agg(entries.alias("_entries")).select(
        "row_id",
        F.transform("_entries", lambda e: e["col_id"]).alias("col_ids"),
        F.transform("_entries", lambda e: e["val"]).alias("vals"),
    )


def transpose(x: DataFrame) -> DataFrame:
    return x.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "val")


def row_subset(x: DataFrame, rows: DataFrame, column: str = "row_id") -> DataFrame:
    """Entries whose row (or other ``column``) is listed in ``rows``."""
    return skew_join(x, rows.select(column).distinct(), [column], "left_semi")


def col_subset(x: DataFrame, cols: DataFrame) -> DataFrame:
    return row_subset(x, cols, "col_id")


def row_scale(x: DataFrame, factors: DataFrame, column: str = "row_id") -> DataFrame:
    """Multiply each entry by the factor of its row (or other ``column``): factors are (column, factor)."""
    joined = skew_join(x, factors.select(column, "factor"), [column])
    return joined.withColumn("val", F.col("val") * F.col("factor")).select(*x.columns)


def col_scale(x: DataFrame, factors: DataFrame) -> DataFrame:
    return row_scale(x, factors, "col_id")


def padded_ids_to_matrix(padded: DataFrame, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Binary rows from a padded id list and its mask."""
    entries = padded.select("row_id", F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(mask).alias("on"))).alias("e"))
    return entries.filter(F.col("e.on") != 0).select("row_id", F.col("e.id").alias("label_id")).distinct()


def matmul(
    a: DataFrame, b: DataFrame, row: str = "row_id", inner: str = "col_id", col: str = "label_id", hot: DataFrame | None = None
) -> DataFrame:
    """``C[row, col] = Σ_inner a[row, inner] * b[inner, col]``: join on the inner index, sum by cell.

    Every row of ``b`` is packed once and sent to the rows of ``C`` it counts for, where it is unpacked and
    summed at once (:func:`packed_products`): what is shuffled are packed rows, not products. ``hot`` names
    known frequent inner indices, whose rows of ``b`` may be too long to pack; then the products are
    summed per input partition and shuffled by cell.
    """
    if hot is None:
        return reduce(DataFrame.unionByName, packed_products(a, b, row, inner, col))
    return joined_products(a, b, row, inner, col, hot)


def joined_products(a: DataFrame, b: DataFrame, row: str, inner: str, col: str, hot: DataFrame | None = None) -> DataFrame:
    """:func:`matmul` with the products summed per input partition and shuffled by cell: nothing is packed or stored."""
    left = a.select(row, inner, F.col("val").alias("_a"))
    right = b.select(inner, col, F.col("val").alias("_b"))
    products = skew_join(left, right, [inner], hot=hot)
    return products.groupBy(row, col).agg(F.sum(F.col("_a") * F.col("_b")).alias("val"))


def packed_products(a: DataFrame, b: DataFrame, row: str, inner: str, col: str) -> list[DataFrame]:
    """The cells of :func:`matmul` in two tables: those of most rows, partitioned by ``row``, and those of frequent ones.

    Each row of the product is in one of the tables with all its cells. Rows with more than
    ``FREQUENT`` entries in ``a`` (at most 64, so that a broadcast has a fixed bound) are summed by cell from
    all tasks; any other row is summed in the task that its packed rows are sent to.
    """
    b, names = _coded(b, inner, col)
    a = materialised(a.select(row, inner, F.col("val").alias("_a")), "entries")
    n = a.count()
    often = a.groupBy(row).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > FREQUENT)
    often = F.broadcast(hottest(often, [row], "_rows"))
    rest, frequent = a.join(often, row, "left_anti"), a.join(often, row, "left_semi")
    sent = rest.join(pack_rows(b, inner, col), inner).select(row, "_a", "_cols", "_vals").repartition(n // SENT + 1, row)
    product = F.col("_a") * F.get(F.col("_vals"), F.col("_pos"))
    products = sent.select(row, "_a", "_vals", F.posexplode("_cols").alias("_pos", col)).select(row, col, product.alias("val"))
    frequent = frequent.withColumnRenamed("_a", "val")
    cells = [products.groupBy(row, col).agg(F.sum("val").alias("val")), joined_products(frequent, b, row, inner, col)]
    if names is None:
        return cells
    named = names.select(F.col(col).alias("_name"), F.col("_at").alias(col))
    return [c.join(named, col).select(row, F.col("_name").alias(col), "val") for c in cells]


def _coded(b: DataFrame, inner: str, col: str) -> tuple[DataFrame, DataFrame | None]:
    """Entries (inner, col, val) with numbers for the names of their columns, and the names (col, _at); others as they are."""
    b = b.select(inner, col, "val")
    if not isinstance(b.schema[col].dataType, StringType):
        return b, None
    b = materialised(b, "entries")
    names = _numbered(b.select(col).distinct(), col)
    numbers = names.select(F.col(col).alias("_name"), "_at")
    return b.join(numbers, F.col(col).eqNullSafe(F.col("_name"))).select(inner, F.col("_at").alias(col), "val"), names


def numbered_columns(features: DataFrame) -> DataFrame:
    """Label features (label_id, col_id, val) with numbers, in their order, for names of columns; entries without a column are left out."""
    return _coded(features.filter(F.col("col_id").isNotNull()), "label_id", "col_id")[0]


def same_columns(x: DataFrame, w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of ``x`` and weights of ``w`` with the same numbers for the names of their columns; others as they are.

    Entries without a column and weights of columns that ``x`` lacks add nothing to a product and are left out.
    """
    x = x.select("row_id", "col_id", "val")
    if not all(isinstance(d.schema["col_id"].dataType, StringType) for d in (x, w)):
        return x, w
    x, names = _coded(x.filter(F.col("col_id").isNotNull()), "row_id", "col_id")
    return x, w.join(names, "col_id").select("label_id", F.col("_at").alias("col_id"), "val")


def pack_rows(b: DataFrame, inner: str, col: str) -> DataFrame:
    """One row for each inner index with its columns and values as arrays: (inner, _cols, _vals).

    Entries are sorted by value, since runs of equal values take little room where rows are shuffled.
    """
    entries = b.groupBy(inner).agg(F.sort_array(F.collect_list(F.struct(F.col("val").alias("v"), F.col(col).alias("c")))).alias("_e"))
    return entries.select(inner, F.transform("_e", lambda e: e["c"]).alias("_cols"), F.transform("_e", lambda e: e["v"]).alias("_vals"))


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """Distinct values, nulls included, with a number each, as short as they allow, stored: (name, _at)."""
    numbered = checkpointed(number_rows(values, [F.col(name)], "_at"))
    kind = "smallint" if numbered.count() <= SHORT else "int"
    return materialised(numbered.select(name, F.col("_at").cast(kind).alias("_at")), "names")


def matvec(x: DataFrame, v: DataFrame, add: DataFrame | None = None) -> DataFrame:
    """``X·v`` as (row_id, val) for a vector (col_id, val), optionally added to (row_id, val)."""
    return _times_vector(x, v, "row_id", "col_id", add)


def rmatvec(x: DataFrame, u: DataFrame, add: DataFrame | None = None) -> DataFrame:
    """``Xᵀ·u`` as (col_id, val) for a vector (row_id, val), optionally added to (col_id, val)."""
    return _times_vector(x, u, "col_id", "row_id", add)


def _times_vector(x: DataFrame, v: DataFrame, out: str, inner: str, add: DataFrame | None) -> DataFrame:
    joined = skew_join(x.select(out, inner, F.col("val").alias("_x")), v.select(inner, F.col("val").alias("_v")), [inner])
    products = joined.select(out, (F.col("_x") * F.col("_v")).alias("val"))
    if add is not None:
        products = products.unionByName(add.select(out, "val"))
    return products.groupBy(out).agg(F.sum("val").alias("val"))


def score_pairs(x: DataFrame, w: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products of the listed (row_id, label_id) pairs only; pairs without common columns get 0.

    Pairs are dealt by label to groups of about ``PAIRS``, where the packed rows of their instances meet the
    weights of their labels; a label of more pairs is dealt to several groups by a hash of the instance.
    """
    wanted = materialised(pairs.select("row_id", "label_id").distinct(), "pairs")
    x, names = _coded(x, "row_id", "col_id")
    w = w.select("label_id", "col_id", F.col("val").cast("double").alias("val"))
    if names is not None:
        w = w.join(names, "col_id").select("label_id", F.col("_at").alias("col_id"), "val")
    groups = wanted.count() // PAIRS + 1
    pieces = F.ceil(F.count("*") / PAIRS).cast("int").alias("_pieces")
    often = wanted.groupBy("label_id").agg(pieces).filter(F.col("_pieces") > 1)
    often = materialised(often, "often")  # at most a row for each `PAIRS` pairs
    n_pieces = F.coalesce("_pieces", F.lit(1))
    group = F.pmod(F.xxhash64("label_id"), F.lit(groups)).alias("_group")
    rows = wanted.join(often, "label_id", "left").select("row_id", "label_id", group, F.pmod(F.xxhash64("row_id"), n_pieces).cast("int").alias("_piece"))
    packed = pack_rows(x.withColumn("val", F.col("val").cast("double")), "row_id", "col_id")
    left = rows.join(packed, "row_id", "left")
    piece = F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("_piece")
    right = w.join(often, "label_id", "left").select("label_id", "col_id", "val", group, piece)
    fresh = lambda df: df.select(*[F.col(n).alias(n) for n in df.columns])  # noqa: E731  both sides come from the same tables
    kinds = {n: wanted.schema[n].dataType.simpleString() for n in ("row_id", "label_id")}
    key = ["_group", "_piece"]
    both = fresh(left).repartition(groups, *key).groupBy(*key).cogroup(fresh(right).repartition(groups, *key).groupBy(*key))
    return both.applyInArrow(_dots, f"row_id {kinds['row_id']}, label_id {kinds['label_id']}, score double")


def _dots(rows: pa.Table, weights: pa.Table) -> pa.Table:
    """The scores of the pairs of one group."""
    n = rows.num_rows
    labels, columns = (pc.drop_null(pc.unique(weights[c])) for c in ("label_id", "col_id"))
    place = lambda values, known: pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(rows["_cols"]).fill_null(0).to_numpy()
    flat = lambda c: pa.chunked_array([k.flatten() for k in rows[c].chunks], rows[c].type.value_type).combine_chunks()
    pair = np.repeat(np.arange(n), size)
    label, column = place(rows["label_id"].combine_chunks(), labels)[pair], place(flat("_cols"), columns)
    at, both = label * len(columns) + column, (label >= 0) & (column >= 0)
    w_label, w_column = place(weights["label_id"].combine_chunks(), labels), place(weights["col_id"].combine_chunks(), columns)
    held = (w_label >= 0) & (w_column >= 0)
    keys, where = np.unique((w_label * len(columns) + w_column)[held], return_inverse=True)
    sums = np.bincount(where, weights["val"].fill_null(0.0).to_numpy()[held], len(keys))
    pair, at, val = pair[both], at[both], flat("_vals").fill_null(0.0).to_numpy(zero_copy_only=False)[both]
    if len(labels) * len(columns) <= MAX_CELLS:
        dense = np.zeros(len(labels) * len(columns))
        dense[keys] = sums
        weight = dense[at]
    else:
        found = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        weight = np.where(keys[found] == at, sums[found], 0.0)
    score = np.bincount(pair, val * weight, n)
    return pa.table({"row_id": rows["row_id"], "label_id": rows["label_id"], "score": pa.array(score, pa.float64())})


def joined_scores(x: DataFrame, w: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`score_pairs` by joins alone: nothing is packed or stored, but every product is shuffled."""
    wanted = pairs.select("row_id", "label_id").distinct()
    entries = skew_join(wanted, x.select("row_id", "col_id", F.col("val").alias("_x")), ["row_id"])
    weights = w.select("label_id", "col_id", F.col("val").alias("_w"))
    products = skew_join(entries, weights, ["label_id", "col_id"])
    scores = products.groupBy("row_id", "label_id").agg(F.sum(F.col("_x") * F.col("_w")).alias("score"))
    return wanted.join(scores, ["row_id", "label_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top_products(z: DataFrame, m: DataFrame, k: int, digits: int | None = None, block_cells: int = PRODUCT_CELLS) -> DataFrame:
    """The ``k`` best labels of every instance in ``Z·M``: (row_id, label_id, score, rank), without the product.

    ``z`` is (row_id, code, val) and ``m`` (code, label_id, val), of any sign. ``m`` is stored and dealt by label
    to blocks of about ``block_cells`` cells, each cell to one of them, where the packed rows of ``z`` meet it:
    only ``k`` labels of an instance leave a block. ``digits`` rounds scores before they are ranked; equal
    scores are ranked by label, null last. A label that none of the instance's codes lists is no result.
    """
    kinds = {n: d.schema[n].dataType.simpleString() for n, d in (("row_id", z), ("code", z), ("label_id", m))}
    cells = m.filter(F.col("code").isNotNull()).select(F.col("code").cast(kinds["code"]).alias("code"), "label_id", F.col("val").cast("double").alias("val"))
    cells = materialised(cells, "cells")
    n = cells.count()
    blocks = max(n // block_cells, min(8 * n // block_cells, int(z.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    known = z.filter(F.col("row_id").isNotNull() & F.col("code").isNotNull()).select("row_id", "code", F.col("val").cast("double").alias("val"))
    packed = materialised(pack_rows(known, "row_id", "code"), "packed")
    left = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "row_id", "_cols", "_vals")
    right = cells.select(F.pmod(F.xxhash64("label_id"), F.lit(blocks)).cast("int").alias("_block"), F.col("code").alias("code"), "label_id", "val")
    left, right = left.repartition(blocks, "_block"), right.repartition(blocks, "_block")
    schema = f"row_id {kinds['row_id']}, label_id {kinds['label_id']}, score double, rank int"
    found = left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(_block_products(k, digits), schema)
    if blocks == 1:
        return found
    order = [F.desc("score"), F.asc_nulls_last("label_id")]
    return top_in_groups(found.drop("rank"), ["row_id"], order, k).withColumn("rank", F.col("rank").cast("int"))


def _block_products(k: int, digits: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        labels = pc.unique(cells["label_id"].combine_chunks())
        labels = labels.take(pc.array_sort_indices(labels, null_placement="at_end"))
        codes = pc.unique(cells["code"].combine_chunks())
        code = places(cells["code"].combine_chunks(), codes)
        label = pc.index_in(cells["label_id"].combine_chunks(), value_set=labels).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        label, val = label[order].astype(np.int64), cells["val"].fill_null(0.0).to_numpy()[order]
        ends = np.searchsorted(code[order], np.arange(len(codes) + 1))
        n, first = len(labels), 0
        whole = None
        if len(codes) * n <= MAX_CELLS:  # cells that are no entry stay apart from those of 0
            whole, listed = np.zeros((len(codes), n)), np.zeros((len(codes), n), bool)
            np.add.at(whole, (code[order], label), val)
            listed[code[order], label] = True
        for chunk in rows.select(["_cols", "_vals"]).to_batches():
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(chunk["_cols"]).to_numpy(zero_copy_only=False))])
            at, share = places(chunk["_cols"].flatten(), codes), chunk["_vals"].flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            for i in range(chunk.num_rows):
                held = at[starts[i] : starts[i + 1]]
                part = share[starts[i] : starts[i + 1]][held >= 0]
                held = held[held >= 0]
                if not len(held):
                    continue
                if whole is not None:
                    score, met = part @ whole[held], listed[held].any(axis=0)
                else:
                    met, score = np.zeros(n, bool), np.zeros(n)
                    own = np.concatenate([label[ends[c] : ends[c + 1]] for c in held])
                    met[own] = True
                    score = np.bincount(own, np.concatenate([val[ends[c] : ends[c + 1]] * v for c, v in zip(held, part)]), n)
                score = score if digits is None else np.round(score, digits)
                score[~met] = -np.inf
                best = _first(score, k)
                best = best[met[best]]
                out.append((np.full(len(best), first + i), best, score[best]))
            first += chunk.num_rows
        row, best, score = (np.concatenate(parts) if out else np.zeros(0, np.int64) for parts in (zip(*out) if out else [()] * 3))
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        return pa.table({"row_id": rows["row_id"].combine_chunks().take(pa.array(row)), "label_id": labels.take(pa.array(best)), "score": pa.array(score, pa.float64()), "rank": pa.array(rank, pa.int32())})

    return run


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest values in falling order; of equal ones the first."""
    if len(score) > k > 0:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")[:k]]


def score_all(
    x: DataFrame,
    w: DataFrame,
    instances: DataFrame,
    labels: DataFrame,
    keep: int | None = None,
    key: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``X·W`` for every instance and every label, zeros included: (row_id, label_id, score).

    The result is as large as instances times labels: meant for the root of a label tree. Packed weights of
    a block of labels meet packed instances, some at a time, so no product and no cell is shuffled.
    With ``keep`` only the cells of an instance that are among its ``keep`` best of a block leave its task, by
    ``key`` of the scores and then by label: all that a ranking of whole rows by that key can take.
    """
    x, w = (df.select(*names, F.col("val").cast("double").alias("val")) for df, names in ((x, ("row_id", "col_id")), (w, ("label_id", "col_id"))))
    x, w = same_columns(x, w)
    kind = x.select("col_id").unionByName(w.select("col_id")).schema["col_id"].dataType
    packed_w = materialised(pack_rows(w.withColumn("col_id", F.col("col_id").cast(kind)), "label_id", "col_id"), "packed")
    packed_x = materialised(pack_rows(x.withColumn("col_id", F.col("col_id").cast(kind)), "row_id", "col_id"), "packed")
    labels = materialised(labels.select("label_id").distinct(), "labels")
    n_rows, n_labels = instances.count(), labels.count()
    n_columns = packed_w.select(F.explode("_cols")).distinct().count()
    sizes = [p.agg(F.sum(F.size("_cols"))).first()[0] or 1 for p in (packed_x, packed_w)]
    cells = n_rows * n_labels
    tasks = max(cells // GRID_TASK, min(cells // GRID_LEAST, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    # each side is sent to the blocks of the other: as many blocks of each as make both of about one size
    cuts = max(n_labels * n_columns // GRID_CELLS + 1, min(round(math.sqrt(tasks * sizes[1] / sizes[0])), n_labels, tasks))
    groups = -(-tasks // cuts)
    chunks = groups * (n_rows // (GRID_ROWS * groups) + 1)
    chunk = F.pmod(F.xxhash64("row_id"), F.lit(chunks)).alias("_chunk")
    listed = F.collect_list(F.struct("row_id", "_cols", "_vals")).alias("_rows")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = instances.select("row_id").join(packed_x, "row_id", "left").groupBy(chunk).agg(listed)
    rows = rows.select(F.pmod("_chunk", F.lit(groups)).cast("int").alias("_group"), every(cuts).alias("_cut"), "_rows")
    cut = F.pmod(F.xxhash64("label_id"), F.lit(cuts)).cast("int").alias("_cut")
    weights = labels.join(packed_w, "label_id", "left").groupBy(cut).agg(F.collect_list(F.struct("label_id", "_cols", "_vals")).alias("_labels"))
    weights = weights.select("_cut", every(groups).alias("_group"), "_labels")
    both = rows.repartition(tasks, "_group", "_cut").join(weights.repartition(tasks, "_group", "_cut"), ["_group", "_cut"])
    kinds = {n: d.schema[n].dataType.simpleString() for n, d in (("row_id", instances), ("label_id", labels))}
    schema = f"row_id {kinds['row_id']}, label_id {kinds['label_id']}, score double"
    return both.select("_group", "_cut", "_rows", "_labels").mapInArrow(_all_scores(keep, key), schema)


def _unpacked(entries: pa.StructArray) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Of packed rows: their ids, the first entry of each and the end, columns and values."""
    ids, cols, vals = entries.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cols).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ids, ends, cols.flatten(), vals.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)


def _all_scores(keep: int | None, key: Callable[[np.ndarray], np.ndarray] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch["_group"][i].as_py(), batch["_cut"][i].as_py())
                if held is None or held[0] != at:
                    ids, ends, cols, vals = _unpacked(batch["_labels"].slice(i, 1).flatten())
                    order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()  # equal scores are ranked by label
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    known = pc.drop_null(pc.unique(cols))
                    column, owner = places(cols, known), np.repeat(place, np.diff(ends))
                    dense = np.zeros((len(known), len(ids)))
                    np.add.at(dense, (column[column >= 0], owner[column >= 0]), vals[column >= 0])
                    held = at, ids.take(pa.array(order)), known, dense
                _, label_ids, known, dense = held
                row_ids, ends, cols, vals = _unpacked(batch["_rows"].slice(i, 1).flatten())
                scores = _sparse_times(ends, places(cols, known), vals, dense)
                row, label = np.indices(scores.shape).reshape(2, -1) if keep is None else _best(scores if key is None else key(scores), keep)
                yield pa.RecordBatch.from_arrays([row_ids.take(pa.array(row)), label_ids.take(pa.array(label)), pa.array(scores[row, label])], ["row_id", "label_id", "score"])

    return run


def places(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each value is among the known ones; -1 for none."""
    return pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sparse_times(ends: np.ndarray, column: np.ndarray, vals: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Rows of entries (column, or -1 for none) times a dense table, some rows after the other so that they stay in the processor's cache."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[column >= 0]
    column, vals = column[column >= 0], vals[column >= 0]
    ends = np.searchsorted(row, np.arange(len(ends)))
    out = np.zeros((len(ends) - 1, dense.shape[1]))
    start, most = 0, max(AT_ONCE // max(dense.shape[1], 1), 1)
    while start < len(out):
        stop = max(int(np.searchsorted(ends, ends[start] + most, "right")) - 1, start + 1)
        full = start + np.flatnonzero(np.diff(ends[start : stop + 1]))
        if len(full):
            part = slice(ends[start], ends[stop])
            out[full] = np.add.reduceat(dense[column[part]] * vals[part, None], ends[full] - ends[start], axis=0)
        start = stop
    return out


def _best(key: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the ``keep`` largest values of each row; of equal ones the first."""
    if key.shape[1] <= keep:
        return tuple(np.indices(key.shape).reshape(2, -1))
    key = np.where(np.isnan(key), np.inf, key)
    least = -np.partition(-key, keep - 1, axis=1)[:, keep - 1 : keep]
    above, same = key > least, key == least
    return np.nonzero(above | (same & (np.cumsum(same, axis=1) <= keep - above.sum(axis=1, keepdims=True))))


def expand_candidates(z: DataFrame, c: DataFrame) -> DataFrame:
    """Labels of each instance's clusters with the cluster score: (row_id, label_id, code, parent_score).

    Clusters with score 0 are kept. The labels of a cluster are packed into rows of about ``LISTED``, so that
    a candidate cluster meets few rows and its labels are unpacked beside it.
    """
    scored = z.select("row_id", "code", F.col("val").alias("parent_score"))
    c = c.select("label_id", "code")
    pieces = c.groupBy("code").agg(F.ceil(F.count("*") / LISTED).alias("_pieces"))
    piece = F.pmod(F.xxhash64("label_id"), F.col("_pieces")).alias("_piece")
    listed = c.join(pieces, "code").groupBy("code", piece).agg(F.collect_list(F.struct("label_id")).alias("_labels"))  # null labels too
    joined = skew_join(scored, listed.select("code", F.transform("_labels", lambda e: e["label_id"]).alias("_labels")), ["code"])
    return joined.select("row_id", F.explode("_labels").alias("label_id"), "code", "parent_score")


def elementwise_add(*matrices: DataFrame) -> DataFrame:
    """Sum of matrices of one shape; cells that cancel to zero are not stored."""
    cells = [c for c in matrices[0].columns if c != "val"]
    stacked = reduce(DataFrame.unionByName, matrices)
    return stacked.groupBy(*cells).agg(F.sum("val").alias("val")).filter(F.col("val") != 0)


def elementwise_max(*matrices: DataFrame) -> DataFrame:
    """Maximum of matrices of one shape, where a cell missing from one of them counts as 0."""
    cells = [c for c in matrices[0].columns if c != "val"]
    stacked = reduce(DataFrame.unionByName, matrices)
    largest = stacked.groupBy(*cells).agg(F.max("val").alias("val"), F.count("*").alias("_n"))
    against_zero = F.when(F.col("_n") < len(matrices), F.greatest("val", F.lit(0.0))).otherwise(F.col("val"))
    return largest.withColumn("val", against_zero).drop("_n").filter(F.col("val") != 0)


def matrix_mean(x: DataFrame) -> DataFrame:
    """Mean of the stored values, as one row."""
    return x.agg(F.avg("val").alias("mean"))


def subtract_mean(x: DataFrame) -> DataFrame:
    return x.withColumn("val", F.col("val") - matrix_mean(x).scalar())
