"""One linear model per label, trained on the instances of the label's cluster, and its predictions.

Weights are a long table (label_id, col_id, val). A bias is an ordinary feature column of constant
value, so it has a weight like any other column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.functions.scores import post_processor
from notecode.operators import blocks
from notecode.operators.features import normalize_rows
from notecode.operators.indexing import consecutive_merge
from notecode.operators.matrix import (
    MAX_CELLS,
    PAIRS,
    elementwise_add,
    expand_candidates,
    joined_products,
    joined_scores,
    pack_rows,
    packed_products,
    places,
    same_columns,
    score_all,
    score_pairs,
    top_products,
)
from notecode.operators.ranking import topk_per_row
from notecode.operators.skew import hottest, skew_join
from notecode.session import checkpointed, materialised

# Solver names and numbers.
SOLVERS = {"L2R_L2LOSS_SVC_DUAL": 1, "L2R_L1LOSS_SVC_DUAL": 3, "L1R_L2LOSS_SVC": 5, "L2R_LR_DUAL": 7}
SMOOTH = ("L2R_L2LOSS_SVC_DUAL", "L2R_LR_DUAL")  # trained to a duality gap

BLOCK_ENTRIES = 500_000  # most feature entries handled by one task as one block
BLOCK_CELLS = 20_000_000  # most (entry or column) × label cells of one block
DENSE_CELLS = 5_000_000  # largest block kept as a dense array
BOUND_ROUNDS = 4
LOSS_PAIRS = 4_000_000  # pairs of a row and a label whose losses are summed together
WHOLE_ENTRIES = 10_000_000  # most feature entries that are sent to all groups of pairs


@dataclass(frozen=True)
class Fit:
    """Settings of one fit.

    ``tolerance`` ends it: for the smooth solvers the duality gap as a share of the objective, for the two
    others the length of a step as a share of the first one's.
    """

    solver: str = "L2R_L2LOSS_SVC_DUAL"
    c_pos: float = 1.0
    c_neg: float = 1.0
    max_iter: int = 100
    tolerance: float = 0.005
    threshold: float = 0.1

    def __post_init__(self) -> None:
        if self.solver not in SOLVERS:
            raise ValueError(f"unknown solver {self.solver!r}; known: {sorted(SOLVERS)}")


# --- training rows ---------------------------------------------------------------------------


def instance_clusters(y: DataFrame, c: DataFrame) -> DataFrame:
    """``Y·C``: how many labels of each cluster an instance has: (row_id, code, val)."""
    joined = skew_join(y.select("row_id", "label_id"), c.select("label_id", "code"), ["label_id"])
    return joined.groupBy("row_id", "code").agg(F.count("*").cast("double").alias("val"))


def active_clusters(y: DataFrame, c: DataFrame, z_pred: DataFrame | None = None, scheme: int | None = None) -> DataFrame:
    """Clusters whose labels an instance trains: (row_id, code, val).

    Scheme 1 (or None): those of its true labels; 0: those and the predicted ones; 2: the predicted
    ones if there are any predictions.
    """
    if scheme == 2 and z_pred is not None:
        return z_pred.select("row_id", "code", "val")
    own = instance_clusters(y, c)
    if scheme == 0:
        if z_pred is None:
            raise ValueError("scheme 0 needs predicted clusters")
        return elementwise_add(own, z_pred.select("row_id", "code", "val"))
    return own


def training_rows(y: DataFrame, c: DataFrame, z: DataFrame) -> DataFrame:
    """All (label, instance) training pairs: (label_id, row_id, target), target +1 or -1.

    A true label outside the instance's active clusters is not used.
    """
    # the true labels of an instance lie beside its clusters before these are expanded: no expanded row is shuffled
    codes = c.select("label_id", "code")
    true = skew_join(y.select("row_id", "label_id").distinct(), codes, ["label_id"])
    own = true.groupBy("row_id", "code").agg(F.collect_set("label_id").alias("_own"))
    marked = z.select("row_id", "code").join(own, ["row_id", "code"], "left")
    joined = skew_join(marked, codes, ["code"])
    is_true = F.array_contains("_own", F.col("label_id"))
    return joined.select("label_id", "row_id", F.when(is_true, 1.0).otherwise(-1.0).alias("target"))


# --- fitting one block in a task -------------------------------------------------------------


def _nesterov(point: np.ndarray, step: float, gradient: Callable, proximal: Callable, fit: Fit) -> np.ndarray:
    """Accelerated proximal gradient for all columns of ``point`` together."""
    ahead, t, first = point, 1.0, None
    for _ in range(fit.max_iter):
        new = proximal(ahead - step * gradient(ahead))
        moved = np.linalg.norm(new - ahead, axis=0)
        first = moved if first is None else first
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        uphill = ((ahead - new) * (new - point)).sum(axis=0) > 0  # restart the momentum of these columns
        ahead = new + np.where(uphill, 0.0, (t - 1) / t_new) * (new - point)
        point, t = new, t_new
        if np.all(moved <= fit.tolerance * np.maximum(first, 1e-12)):
            break
    return point


def _block_fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, n_cols: int, fit: Fit) -> np.ndarray:
    """Weights (columns × labels) of a block: entries (rows, cols, vals), targets ±1 (rows × labels)."""
    n_rows, n_labels = target.shape
    if n_rows * n_cols <= DENSE_CELLS:
        x = np.zeros((n_rows, n_cols))
        np.add.at(x, (rows, cols), vals)
        score, gather = (lambda w: x @ w), (lambda u: x.T @ u)
    else:

        def score(w: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(rows, vals * w[cols, k], n_rows) for k in range(n_labels)], axis=1)

        def gather(u: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(cols, vals * u[rows, k], n_cols) for k in range(n_labels)], axis=1)

    size = np.abs(vals)
    v = np.ones(n_cols)
    for _ in range(BOUND_ROUNDS):
        image = np.bincount(cols, size * np.bincount(rows, size * v[cols], n_rows)[rows], n_cols)
        bound = float((image / v).max()) if n_cols else 0.0  # at least the largest eigenvalue of XᵀX
        v = np.maximum(image, 1e-12 * max(image.max(), 1e-300))
        v /= v.max()
    cost = np.where(target > 0, fit.c_pos, fit.c_neg)
    largest = max(fit.c_pos, fit.c_neg)
    start = np.zeros((n_cols, n_labels))
    if fit.solver == "L2R_L1LOSS_SVC_DUAL":
        alpha = _nesterov(
            np.zeros(target.shape),
            1.0 / max(bound, 1e-12),
            lambda a: target * score(gather(a * target)) - 1.0,
            lambda a: np.clip(a, 0.0, cost),
            fit,
        )
        return gather(alpha * target)
    step = 1.0 / max(2.0 * largest * bound, 1e-12)
    loss = lambda f: -2.0 * cost * target * np.maximum(1.0 - target * f, 0.0)
    soft = lambda w: np.sign(w) * np.maximum(np.abs(w) - step, 0.0)
    return _nesterov(start, step, lambda w: gather(loss(score(w))), soft, fit)


def _fit_cluster(fit: Fit) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        labels = np.unique(y["label_id"].to_numpy())
        if x.empty or not len(labels):
            return pd.DataFrame({"label_id": labels[:0], "col_id": x["col_id"].iloc[:0], "val": np.zeros(0)})
        x = x.sort_values(["row_id", "col_id"])  # fixed order, so that a fit does not depend on the shuffle
        row_ids, rows = np.unique(x["row_id"].to_numpy(), return_inverse=True)
        col_codes, col_ids = pd.factorize(x["col_id"], sort=True)
        target = np.full((len(row_ids), len(labels)), -1.0)
        true = y[y["row_id"].notna()]
        at = np.searchsorted(row_ids, true["row_id"].to_numpy().astype(row_ids.dtype))
        known = (at < len(row_ids)) & (row_ids[np.minimum(at, len(row_ids) - 1)] == true["row_id"].to_numpy())
        target[at[known], np.searchsorted(labels, true["label_id"].to_numpy())[known]] = 1.0
        w = _block_fit(rows, col_codes, x["val"].to_numpy(), target, len(col_ids), fit)
        keep = np.abs(w) >= max(fit.threshold, 1e-300)
        c, k = np.nonzero(keep)
        return pd.DataFrame({"label_id": labels[k], "col_id": np.asarray(col_ids)[c], "val": w[c, k]})

    return run


def training_blocks(x: DataFrame, y: DataFrame, c: DataFrame, z: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The stored blocks of a training, for several fits of the smooth solvers to the same tables."""
    return blocks.blocks_of(x, y, c, z, block_entries, BLOCK_CELLS)


def train_linear(
    x: DataFrame,
    y: DataFrame,
    c: DataFrame,
    z: DataFrame,
    fit: Fit = Fit(),
    block_entries: int = BLOCK_ENTRIES,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Weights of every label of ``c``, each trained on the instances active in its cluster.

    ``stored`` are the :func:`training_blocks` of the same tables; the two solvers without a gap make no use of them.
    """
    if fit.solver in SMOOTH:
        least = max(fit.threshold, 1e-300)
        return sparsify(blocks.train_certified(x, y, c, z, fit, block_entries, BLOCK_CELLS, stored, least)[0], least)
    return _train_other(x, y, c, z, fit, block_entries)


def train_certified(
    x: DataFrame,
    y: DataFrame,
    c: DataFrame,
    z: DataFrame,
    fit: Fit = Fit(),
    block_entries: int = BLOCK_ENTRIES,
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All weights of every label of ``c`` and the certificates (label_id, objective, gap, rounds), for smooth solvers."""
    if fit.solver not in SMOOTH:
        raise ValueError(f"{fit.solver} has no certificate; solvers with one: {SMOOTH}")
    return blocks.train_certified(x, y, c, z, fit, block_entries, BLOCK_CELLS, stored)


def _train_other(x: DataFrame, y: DataFrame, c: DataFrame, z: DataFrame, fit: Fit, block_entries: int) -> DataFrame:
    """The two solvers without a smooth loss and a squared norm.

    A cluster of up to ``block_entries`` feature entries, and not too many labels for them, is fitted
    in one task for all its labels. Entries and labels are counted first; larger clusters go to
    :func:`train_distributed`, where no task needs a whole cluster.
    """
    active = z.select("row_id", "code")
    lengths = x.groupBy("row_id").agg(F.count("*").alias("_entries"))
    sizes = active.join(lengths, "row_id").groupBy("code").agg(F.sum("_entries").alias("_size"))
    n_labels = c.groupBy("code").agg(F.count("*").alias("_labels"))
    fits = (F.col("_size") <= block_entries) & (F.col("_size") * F.col("_labels") <= BLOCK_CELLS)
    sizes = checkpointed(sizes.join(n_labels, "code").select("code", fits.alias("_fits")))
    small, large = sizes.filter("_fits").select("code"), sizes.filter(~F.col("_fits")).select("code")
    weights = _train_blocks(x, y, c, active.join(small.select("code"), "code", "left_semi"), small, fit)
    if large.isEmpty():
        return weights
    big_c = c.join(large.select("code"), "code", "left_semi")
    rows = training_rows(y, big_c, z.join(large.select("code"), "code", "left_semi"))
    rows = rows.join(big_c.select("label_id", "code"), "label_id")
    return weights.unionByName(train_distributed(x, rows, fit))


def _renewed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).alias(n) for n in df.columns])


def _train_blocks(x: DataFrame, y: DataFrame, c: DataFrame, active: DataFrame, sizes: DataFrame, fit: Fit) -> DataFrame:
    block_x = skew_join(x, active, ["row_id"]).select("code", "row_id", "col_id", "val")
    labelled = c.select("label_id", "code").join(sizes.select("code"), "code", "left_semi")
    row_type = x.schema["row_id"].dataType
    listed = labelled.select("code", "label_id", F.lit(None).cast(row_type).alias("row_id"))
    true = skew_join(y.select("row_id", "label_id").distinct(), labelled, ["label_id"])
    true = true.join(active, ["row_id", "code"], "left_semi").select("code", "label_id", "row_id")
    schema = f"label_id {c.schema['label_id'].dataType.simpleString()}, col_id {x.schema['col_id'].dataType.simpleString()}, val double"
    targets = listed.unionByName(true)
    # both sides come from the same tables: fresh column names keep their keys apart
    block_x, targets = _renewed(block_x), _renewed(targets)
    pairs = block_x.groupBy("code").cogroup(targets.groupBy("code"))
    return pairs.applyInPandas(_fit_cluster(fit), schema)


# --- fitting as joins ------------------------------------------------------------------------


def spectral_bound(x: DataFrame, rounds: int = BOUND_ROUNDS) -> float:
    """An upper bound of the largest eigenvalue of ``XᵀX`` (of the absolute values, by row-sum ratios)."""
    found = cluster_bounds(x.withColumn("code", F.lit(0)), rounds).first()
    return float(found["bound"]) if found else 0.0


def cluster_bounds(x: DataFrame, rounds: int = BOUND_ROUNDS) -> DataFrame:
    """That bound for the rows of each cluster: (code, row_id, col_id, val) to (code, bound)."""
    size = checkpointed(x.select("code", "row_id", "col_id", F.abs("val").alias("val")))
    v = size.select("code", "col_id").distinct().withColumn("v", F.lit(1.0))
    for _ in range(rounds):
        u = size.join(v, ["code", "col_id"]).groupBy("code", "row_id").agg(F.sum(F.col("val") * F.col("v")).alias("u"))
        image = size.join(u, ["code", "row_id"]).groupBy("code", "col_id").agg(F.sum(F.col("val") * F.col("u")).alias("image"))
        image = checkpointed(image.join(v, ["code", "col_id"]))
        tops = image.groupBy("code").agg(F.max("image").alias("top"), F.max(F.col("image") / F.col("v")).alias("bound"))
        tops = checkpointed(tops)
        raised = F.greatest(F.col("image"), F.lit(1e-12) * F.greatest(F.col("top"), F.lit(1e-300)))
        v = image.join(tops, "code").select("code", "col_id", (raised / F.greatest("top", F.lit(1e-300))).alias("v"))
    return tops.select("code", "bound")


def train_distributed(x: DataFrame, rows: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The iteration of the two other solvers as joins and sums over all labels at once: no task holds a cluster.

    ``rows`` are training pairs (label_id, row_id, target) and the cluster ``code`` of the label, if there
    is more than one cluster. Each cluster has its own step, restarts the momentum of a label as the
    fit of a block does, and leaves when all its labels have stopped moving, so the weights do not
    depend on which of the two ways a cluster takes.
    """
    if "code" not in rows.columns:
        rows = rows.withColumn("code", F.lit(0))
    rows = rows.join(x.select("row_id").distinct(), "row_id", "left_semi")
    rows = checkpointed(rows.select("code", "label_id", "row_id", "target"))
    members = rows.select("code", "row_id").distinct()
    used = x.join(members.select("row_id").distinct(), "row_id", "left_semi")
    bounds = cluster_bounds(skew_join(used, members, ["row_id"]))
    largest = max(fit.c_pos, fit.c_neg)
    if fit.solver == "L2R_L1LOSS_SVC_DUAL":
        size = F.col("bound")
    else:
        size = F.lit(2.0 * largest) * F.col("bound")
    steps = bounds.select("code", (F.lit(1.0) / F.greatest(size, F.lit(1e-12))).alias("step"))
    labels = checkpointed(rows.select("code", "label_id").distinct().join(steps, "code"))
    descent = _dual_descent if fit.solver == "L2R_L1LOSS_SVC_DUAL" else _primal_descent
    return sparsify(descent(used, rows, labels, fit), fit.threshold)


def _moves(moved: DataFrame) -> DataFrame:
    """Of each label: how far its point went, and whether its momentum points uphill."""
    return moved.groupBy("label_id").agg(F.sqrt(F.sum("_moved")).alias("_now"), (F.sum("_uphill") > 0).alias("_restart"))


def _stopped(moves: DataFrame, first: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """Labels of the clusters whose labels have all stopped; a label that never moved has."""
    known = labels.join(moves, "label_id", "left").join(first, "label_id", "left")
    still = F.coalesce(F.col("_now"), F.lit(0.0)) <= F.lit(fit.tolerance) * F.greatest(F.coalesce("_first", F.lit(0.0)), F.lit(1e-12))
    done = known.groupBy("code").agg(F.bool_and(still).alias("_still")).filter("_still").select("code")
    return labels.join(done, "code", "left_semi").select("label_id")


def _cost(fit: Fit) -> Column:
    return F.when(F.col("target") > 0, F.lit(float(fit.c_pos))).otherwise(F.lit(float(fit.c_neg)))


def _primal_descent(x: DataFrame, rows: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    margin = F.col("target") * F.col("score")
    slope = F.lit(-2.0) * _cost(fit) * F.col("target") * F.greatest(F.lit(1.0) - margin, F.lit(0.0))
    # w is the current point, v the extrapolated one; both are sparse and start at zero
    state = first = None
    finished = []
    t = 1.0
    for _ in range(fit.max_iter):
        if state is None:
            scored = rows.withColumn("score", F.lit(0.0))
        else:
            ahead = state.select("label_id", "col_id", F.col("v").alias("val"))
            scored = rows.join(joined_scores(x, ahead, rows), ["row_id", "label_id"])
        errors = scored.select("row_id", "label_id", slope.alias("val")).filter(F.col("val") != 0)
        gradient = joined_products(errors, x, "label_id", "row_id", "col_id")
        if state is None:
            merged = gradient.select("label_id", "col_id", F.lit(0.0).alias("w"), F.lit(0.0).alias("v"), F.col("val").alias("g"))
        else:
            merged = state.join(gradient.withColumnRenamed("val", "g"), ["label_id", "col_id"], "full")
            merged = merged.select("label_id", "col_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("w", "v", "g")])
        merged = merged.join(labels.select("label_id", "step"), "label_id")
        new = F.col("v") - F.col("step") * F.col("g")
        new = F.signum(new) * F.greatest(F.abs(new) - F.col("step"), F.lit(0.0))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        change = F.col("_new") - F.col("w")
        moved = merged.withColumn("_new", new).select(
            "label_id",
            "col_id",
            F.col("_new").alias("w"),
            change.alias("_change"),
            ((F.col("_new") - F.col("v")) * (F.col("_new") - F.col("v"))).alias("_moved"),
            ((F.col("v") - F.col("_new")) * change).alias("_uphill"),
        )
        moved = checkpointed(moved)
        moves = checkpointed(_moves(moved))
        if first is None:
            first = moves.select("label_id", F.col("_now").alias("_first"))
        push = F.when(F.col("_restart"), F.lit(0.0)).otherwise(F.lit((t - 1) / t_new))
        t = t_new
        state = moved.join(moves, "label_id").select("label_id", "col_id", "w", (F.col("w") + push * F.col("_change")).alias("v"))
        done = checkpointed(_stopped(moves, first, labels, fit))
        if not done.isEmpty():
            finished.append(state.join(done, "label_id", "left_semi"))
            labels = checkpointed(labels.join(done, "label_id", "left_anti"))
            rows = checkpointed(rows.join(done, "label_id", "left_anti"))
            state = state.join(done, "label_id", "left_anti")
        state = checkpointed(state)
        if labels.isEmpty():
            break
    parts = [*finished, state]
    return reduce(DataFrame.unionByName, parts).select("label_id", "col_id", F.col("w").alias("val"))


def _dual_descent(x: DataFrame, rows: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    state = rows.select("row_id", "label_id", "target", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    t = 1.0
    first = None
    finished = []

    def weights(pairs: DataFrame, column: str) -> DataFrame:
        signed = pairs.select("row_id", "label_id", (F.col(column) * F.col("target")).alias("val")).filter(F.col("val") != 0)
        return joined_products(signed, x, "label_id", "row_id", "col_id")

    for _ in range(fit.max_iter):
        if first is None:
            scored = state.withColumn("score", F.lit(0.0))
        else:
            scored = state.join(joined_scores(x, weights(state, "b"), state), ["row_id", "label_id"])
        scored = scored.join(labels.select("label_id", "step"), "label_id")
        raw = F.col("b") - F.col("step") * (F.col("target") * F.col("score") - F.lit(1.0))
        new = F.greatest(F.lit(0.0), F.least(raw, _cost(fit)))
        change = F.col("_new") - F.col("a")
        moved = scored.withColumn("_new", new).select(
            "row_id",
            "label_id",
            "target",
            F.col("_new").alias("a"),
            change.alias("_change"),
            ((F.col("_new") - F.col("b")) * (F.col("_new") - F.col("b"))).alias("_moved"),
            ((F.col("b") - F.col("_new")) * change).alias("_uphill"),
        )
        moved = checkpointed(moved)
        moves = checkpointed(_moves(moved))
        if first is None:
            first = moves.select("label_id", F.col("_now").alias("_first"))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = F.when(F.col("_restart"), F.lit(0.0)).otherwise(F.lit((t - 1) / t_new))
        t = t_new
        state = moved.join(moves, "label_id").select("row_id", "label_id", "target", "a", (F.col("a") + push * F.col("_change")).alias("b"))
        done = checkpointed(_stopped(moves, first, labels, fit))
        if not done.isEmpty():
            finished.append(state.join(done, "label_id", "left_semi"))
            labels = checkpointed(labels.join(done, "label_id", "left_anti"))
            state = state.join(done, "label_id", "left_anti")
        state = checkpointed(state)
        if labels.isEmpty():
            break
    return weights(reduce(DataFrame.unionByName, [*finished, state]), "a")


def sparsify(w: DataFrame, threshold: float) -> DataFrame:
    """Keep weights of at least ``threshold`` in absolute value."""
    return w.filter(F.abs("val") >= threshold)


def objective(x: DataFrame, rows: DataFrame, w: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Training objective per label: (label_id, objective)."""
    packed, weights = same_columns(x, w)
    packed = materialised(pack_rows(packed, "row_id", "col_id"), "packed")
    if (packed.agg(F.sum(F.size("_cols"))).first()[0] or 0) <= WHOLE_ENTRIES:
        losses = _pair_losses(packed, rows, weights, fit)
    else:
        scored = rows.join(score_pairs(x, w, rows), ["row_id", "label_id"])
        margin = F.col("target") * F.col("score")
        hinge = F.greatest(F.lit(1.0) - margin, F.lit(0.0))
        loss = {
            "L2R_LR_DUAL": F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))),
            "L2R_L1LOSS_SVC_DUAL": hinge,
        }.get(fit.solver, hinge * hinge)
        losses = scored.groupBy("label_id").agg(F.sum(_cost(fit) * loss).alias("_loss"))
    lasso = fit.solver == "L1R_L2LOSS_SVC"
    size = F.sum(F.abs("val")) if lasso else F.sum(F.col("val") * F.col("val")) / 2
    sizes = w.groupBy("label_id").agg(size.alias("_size"))
    joined = losses.join(sizes, "label_id", "left")
    return joined.select("label_id", (F.col("_loss") + F.coalesce("_size", F.lit(0.0))).alias("objective"))


def _pair_losses(packed: DataFrame, rows: DataFrame, w: DataFrame, fit: Fit) -> DataFrame:
    """The summed loss of each label: (label_id, _loss), for features (packed) that one task can hold.

    Pairs are dealt by label to groups of about ``LOSS_PAIRS``, each of which gets the features once, however many
    pairs a row has in it; a label of more pairs is dealt to several groups by a hash of the instance.
    """
    rows = rows.select("row_id", "label_id", "target").filter(F.col("row_id").isNotNull() & F.col("label_id").isNotNull())
    counts = materialised(rows.groupBy("label_id").agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    groups = max(total // LOSS_PAIRS, min(total // PAIRS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    often = counts.filter(F.col("_n") > LOSS_PAIRS).select("label_id", F.ceil(F.col("_n") / LOSS_PAIRS).cast("int").alias("_pieces"))
    often = materialised(often, "often")  # at most a row for each `LOSS_PAIRS` pairs
    group, n_pieces = F.pmod(F.xxhash64("label_id"), F.lit(groups)).cast("int"), F.coalesce("_pieces", F.lit(1))
    row, label = (rows.schema[n].dataType for n in ("row_id", "label_id"))
    # pieces of a label lie in the groups after its own
    piece = F.pmod(F.xxhash64("row_id", F.lit(1)), n_pieces)
    pairs = rows.join(F.broadcast(often), "label_id", "left").select(F.pmod(group + piece, F.lit(groups)).cast("int").alias("_group"), "row_id", "label_id", "target")
    features = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.col("row_id").cast(row).alias("row_id"), F.lit(None).cast(label).alias("label_id"), "_cols", "_vals")
    spread = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n_pieces - 1), lambda i: F.pmod(group + i, F.lit(groups)).cast("int")))).alias("_group")
    weights = pack_rows(w.withColumn("label_id", F.col("label_id").cast(label)).filter("label_id IS NOT NULL"), "label_id", "col_id").join(F.broadcast(often), "label_id", "left")
    weights = weights.select(spread, F.lit(None).cast(row).alias("row_id"), "label_id", "_cols", "_vals")
    sent = features.filter("row_id IS NOT NULL").unionByName(weights)
    pairs, sent = (_renewed(df).repartition(groups, "_group").groupBy("_group") for df in (pairs, sent))
    shares = pairs.cogroup(sent).applyInArrow(_group_losses(fit), f"label_id {label.simpleString()}, loss double")
    return shares.groupBy("label_id").agg(F.sum("loss").alias("_loss"))


def _group_losses(fit: Fit) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.table({"label_id": pairs["label_id"], "loss": pa.array([], pa.float64())})
        weights = sent.filter(pc.is_valid(sent["label_id"])).combine_chunks()
        features = sent.filter(pc.is_valid(sent["row_id"])).combine_chunks()
        labels, columns = pc.unique(pairs["label_id"].combine_chunks()), pc.unique(_flat(weights, "_cols"))
        entry = lambda t, name, known: np.repeat(places(t[name].combine_chunks(), known), pc.list_value_length(t["_cols"]).to_numpy())
        owner, at = entry(weights, "label_id", labels), places(_flat(weights, "_cols"), columns)
        held = owner >= 0
        n, m, d = features.num_rows, len(labels), len(columns)
        label, row = places(pairs["label_id"].combine_chunks(), labels), places(pairs["row_id"].combine_chunks(), features["row_id"].combine_chunks())
        vals = _flat(features, "_vals").fill_null(0.0).to_numpy(zero_copy_only=False)
        place, of_weight = places(_flat(features, "_cols"), columns), _flat(weights, "_vals").fill_null(0.0).to_numpy(zero_copy_only=False)[held]
        size = pc.list_value_length(features["_cols"]).to_numpy().astype(np.int64)
        score = np.zeros(pairs.num_rows)
        if m * d <= MAX_CELLS and n * d <= MAX_CELLS:
            dense, whole = np.zeros((d, m)), np.zeros((n, d))
            np.add.at(dense, (at[held], owner[held]), of_weight)
            np.add.at(whole, (np.repeat(np.arange(n), size)[place >= 0], place[place >= 0]), vals[place >= 0])
            order = np.argsort(row, kind="stable")
            step = max(MAX_CELLS // (10 * m), 1)
            for first in range(0, n, step):
                part = order[np.searchsorted(row, first, sorter=order) : np.searchsorted(row, first + step, sorter=order)]
                if len(part):
                    score[part] = (whole[first : first + step] @ dense)[row[part] - first, label[part]]
        else:
            keys, where = np.unique(owner[held] * d + at[held], return_inverse=True)
            sums, starts = np.bincount(where, of_weight, len(keys)), np.concatenate([[0], np.cumsum(size)])
            for first in range(0, pairs.num_rows if len(keys) else 0, PAIRS):
                part = slice(first, first + PAIRS)
                own = np.where(row[part] >= 0, np.append(size, 0)[row[part]], 0)
                pair = np.repeat(np.arange(len(own)), own)
                e = np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own) + starts[row[part]][pair]
                key = np.where(place[e] >= 0, label[part][pair] * d + place[e], -1)
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                score[part] = np.bincount(pair, vals[e] * np.where(keys[found] == key, sums[found], 0.0), len(own))
        target = pairs["target"].to_numpy()
        margin, cost = target * score, np.where(target > 0, float(fit.c_pos), float(fit.c_neg))
        if fit.solver == "L2R_LR_DUAL":
            loss = np.maximum(-margin, 0.0) + np.log1p(np.exp(-np.abs(margin)))
        else:
            loss = np.maximum(1.0 - margin, 0.0)
            loss = loss if fit.solver == "L2R_L1LOSS_SVC_DUAL" else loss * loss
        return pa.table({"label_id": labels, "loss": pa.array(np.bincount(label, cost * loss, m))})

    return run


def _flat(packed: pa.Table, name: str) -> pa.Array:
    column = packed[name]
    return pa.chunked_array([k.flatten() for k in column.chunks], column.type.value_type).combine_chunks()


# --- model chains ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A chain of levels, root first: weights (level, label_id, col_id, val), clusters (level, label_id, code).

    The cluster codes of a level are the labels of the level above it; the root level of a full
    chain has no clusters, so its labels are listed in ``roots`` (label_id): a label whose weights all
    fell under the threshold is still there. ``bias`` is the value of the constant column ``bias_col``;
    0 means none.
    """

    weights: DataFrame
    clusters: DataFrame
    depth: int
    bias: float
    bias_col: int | str | None = None
    roots: DataFrame | None = None

    def labels(self, d: int) -> DataFrame:
        """All labels of a level (label_id), with weights or without."""
        w, c = self.level(d)
        listed = [w.select("label_id"), c.select("label_id")]
        if d == 0 and self.roots is not None:
            listed.append(self.roots.select("label_id"))
        return reduce(DataFrame.unionByName, listed).distinct()

    def level(self, d: int) -> tuple[DataFrame, DataFrame]:
        at = F.col("level") == d
        return self.weights.filter(at).drop("level"), self.clusters.filter(at).drop("level")


def train_model(
    x: DataFrame,
    y: DataFrame,
    c: DataFrame,
    labels: DataFrame,
    instances: DataFrame,
    mode: str = "full-model",
    shallow: bool = False,
    fit: Fit = Fit(),
    z_pred: DataFrame | None = None,
    scheme: int | None = None,
    bias: float = 1.0,
    bias_col: int | str | None = None,
    min_labels: int = 2,
    splits: int = 2,
) -> Model:
    """Train a model chain; ``x`` already has the bias column if there is one.

    ``full-model`` trains the labels within ``c`` and, above them, the clusters merged pairwise up to
    at most ``min_labels`` at the root. ``matcher`` trains that upper part only. ``ranker`` trains the
    labels within ``c`` only. ``shallow`` trains all clusters as one root level.
    """
    if mode not in ("full-model", "matcher", "ranker"):
        raise ValueError(f"unknown mode {mode!r}")
    code_type = labels.schema["label_id"].dataType
    codes = c.select("label_id", F.col("code").cast(code_type).alias("code"))
    levels: list[tuple[DataFrame, DataFrame | None]] = []
    if mode != "matcher":
        z = active_clusters(y, codes, z_pred, scheme)
        levels.append((train_linear(x, y, codes, z, fit), codes))
    if mode == "ranker":
        return _chain(levels, None, bias, bias_col)
    cur_labels = checkpointed(codes.select(F.col("code").alias("label_id")).distinct())
    cur_y = checkpointed(instance_clusters(y, codes).select("row_id", F.col("code").alias("label_id")))
    n = (cur_labels.agg(F.max("label_id")).first()[0] or 0) + 1
    smallest = n if shallow else min_labels
    while True:
        if n <= smallest:
            everywhere = cur_labels.select("label_id", F.lit(0).cast(code_type).alias("code"))
            z = instances.select("row_id", F.lit(0).cast(code_type).alias("code"), F.lit(1.0).alias("val"))
            levels.append((train_linear(x, cur_y, everywhere, z, fit), None))
            return _chain(levels, cur_labels, bias, bias_col)
        merged = consecutive_merge(cur_labels, splits).select("label_id", F.col("code").cast(code_type).alias("code"))
        levels.append((train_linear(x, cur_y, merged, active_clusters(cur_y, merged), fit), merged))
        above = instance_clusters(cur_y, merged)
        cur_y = checkpointed(above.select("row_id", F.col("code").alias("label_id")))
        cur_labels = checkpointed(merged.select(F.col("code").alias("label_id")).distinct())
        n = -(-n // splits)


def _chain(
    levels: Sequence[tuple[DataFrame, DataFrame | None]], roots: DataFrame | None, bias: float, bias_col: int | str | None
) -> Model:
    ordered = list(reversed(levels))
    weights = [w.select(F.lit(d).alias("level"), "label_id", "col_id", "val") for d, (w, _) in enumerate(ordered)]
    clusters = [c.select(F.lit(d).alias("level"), "label_id", "code") for d, (_, c) in enumerate(ordered) if c is not None]
    all_weights = checkpointed(reduce(DataFrame.unionByName, weights))
    if clusters:
        all_clusters = reduce(DataFrame.unionByName, clusters)
    else:
        label = all_weights.schema["label_id"].dataType
        all_clusters = all_weights.limit(0).select("level", "label_id", F.lit(0).cast(label).alias("code"))
    return Model(all_weights, checkpointed(all_clusters), len(ordered), bias, bias_col, roots)


def merge_models(upper: Model, lower: Model) -> Model:
    """Put the levels of ``lower`` below those of ``upper``, whose last labels must be its clusters."""
    first_c = lower.level(0)[1]
    n_labels = upper.labels(upper.depth - 1).count()
    n_codes = first_c.select("code").distinct().count()
    if n_labels != n_codes:
        raise ValueError(f"{n_labels} labels of the upper model do not match {n_codes} clusters of the lower one")
    shift = F.col("level") + F.lit(upper.depth)
    return Model(
        upper.weights.unionByName(lower.weights.withColumn("level", shift)),
        upper.clusters.unionByName(lower.clusters.withColumn("level", shift)),
        upper.depth + lower.depth,
        lower.bias,
        lower.bias_col,
        upper.roots,
    )


# --- prediction ------------------------------------------------------------------------------


def score_blocks(x: DataFrame, w: DataFrame, c: DataFrame, z: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Scores of all labels of each instance's clusters: (row_id, label_id, code, parent_score, score).

    The same result as expanding candidates and scoring the pairs, but the weights of a cluster meet
    a block of its instances in one task. A large cluster is cut by a hash of the instance, so that
    no block has more than about ``block_entries`` feature entries or too many scores, and by a hash
    of the label if it has very many weights, however many instances and labels it has.
    """
    x, w = same_columns(x, w)
    packed = materialised(pack_rows(x, "row_id", "col_id"), "packed")
    lengths = packed.select("row_id", F.size("_cols").alias("_entries"))
    active = z.select("row_id", "code", F.col("val").alias("parent_score")).join(lengths, "row_id", "left")
    active = materialised(active, "active")
    c = c.select("label_id", "code").distinct()
    weighted = c.join(w, "label_id", "left").select("code", "label_id", "col_id", "val")
    weighted = materialised(weighted, "weighted")
    sizes = active.groupBy("code").agg(F.coalesce(F.sum("_entries"), F.lit(0)).alias("_size"), F.count("*").alias("_rows"))
    per_column = weighted.groupBy("code", "col_id").agg(F.count("*").alias("_n"))
    heights = per_column.groupBy("code").agg(F.sum("_n").alias("_weights"), F.count("*").alias("_columns"))
    widths = c.groupBy("code").agg(F.count("*").alias("_labels"))
    cuts = sizes.join(heights, "code").join(widths, "code")
    # a block's weights are kept as columns × labels: the columns of a cluster are at most its weights
    cells = F.least(F.col("_weights"), F.col("_columns")) * F.col("_labels")
    label_blocks = F.floor(F.greatest(F.col("_weights") / (4 * block_entries), cells / BLOCK_CELLS)) + 1
    scores = F.col("_rows") * F.col("_labels") / label_blocks
    blocks = cuts.select(
        "code",
        "_rows",
        (F.floor(F.greatest(F.col("_size") / block_entries, scores / DENSE_CELLS)) + 1).cast("int").alias("_blocks"),
        label_blocks.cast("int").alias("_label_blocks"),
    )
    blocks = checkpointed(blocks)  # one row per cluster, used on both sides
    hot = hottest(blocks, ["code"], "_rows")
    placed = skew_join(active.drop("_entries"), blocks.drop("_rows"), ["code"], hot=hot)
    placed = placed.select(
        "row_id",
        "code",
        "parent_score",
        F.pmod(F.xxhash64("row_id"), F.col("_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("_label_blocks") - 1)).alias("label_block"),
    )
    key = ["code", "block", "label_block"]
    features = placed.join(packed, "row_id", "left").select(*key, "row_id", "parent_score", "_cols", "_vals")
    spread = weighted.join(blocks, "code").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    label_block = F.pmod(F.xxhash64("label_id"), F.col("_label_blocks")).cast("int").alias("label_block")
    spread = spread.select("code", "block", label_block, "label_id", "col_id", "val")
    kinds = {n: d.schema[n].dataType.simpleString() for n, d in (("row_id", z), ("label_id", c), ("code", z))}
    schema = f"row_id {kinds['row_id']}, label_id {kinds['label_id']}, code {kinds['code']}, parent_score double, score double"
    features, spread = _renewed(features), _renewed(spread)
    pairs = features.groupBy(*key).cogroup(spread.groupBy(*key))
    return pairs.applyInPandas(_score_block, schema)


def _score_block(x: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
    labels = np.unique(w["label_id"].to_numpy())
    x = x.sort_values("row_id")
    row_ids, parents = x["row_id"].to_numpy(), x["parent_score"].to_numpy()
    scores = np.zeros((len(row_ids), len(labels)))
    known_w = w[w["col_id"].notna()]
    index = pd.Index(known_w["col_id"].unique())
    entries = [(i, e, f) for i, (e, f) in enumerate(zip(x["_cols"], x["_vals"])) if e is not None and len(e)]
    if entries and len(index):
        rows = np.repeat([i for i, _, _ in entries], [len(e) for _, e, _ in entries])
        at, vals = index.get_indexer(np.concatenate([e for _, e, _ in entries])), np.concatenate([f for _, _, f in entries])
        rows, vals, at = rows[at >= 0], vals[at >= 0], at[at >= 0]
        dense = np.zeros((len(index), len(labels)))
        dense[index.get_indexer(known_w["col_id"]), np.searchsorted(labels, known_w["label_id"].to_numpy())] = known_w["val"]
        if len(row_ids) * len(index) <= DENSE_CELLS:
            features = np.zeros((len(row_ids), len(index)))
            np.add.at(features, (rows, at), vals)
            scores = features @ dense
        else:
            for k in range(len(labels)):
                scores[:, k] = np.bincount(rows, vals * dense[at, k], len(row_ids))
    code = x["code"].iloc[0] if len(x) else (w["code"].iloc[0] if len(w) else 0)
    n, m = scores.shape
    return pd.DataFrame(
        {
            "row_id": np.repeat(row_ids, m),
            "label_id": np.tile(labels, n),
            "code": np.full(n * m, code),
            "parent_score": np.repeat(parents, m),
            "score": scores.ravel(),
        }
    )


def predict_beam(
    x: DataFrame,
    model: Model,
    instances: DataFrame,
    beam: int = 10,
    k: int | None = 10,
    post: str | bool | None = True,
    codes: DataFrame | None = None,
    normalised: bool = False,
    blocks: bool = False,
    digits: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Walk down the chain, keeping the best ``beam`` clusters per instance, then the best ``k`` labels.

    ``codes`` (row_id, code, val) are cluster scores from elsewhere for the first level of the chain.
    Returns (row_id, label_id, score, rank). ``digits`` rounds scores before they are ranked.
    ``max_depth`` ends the walk after so many levels, with the clusters reached there as labels.
    Every level below the first is scored in blocks of a cluster, with or without ``blocks``.
    """
    depth = model.depth if max_depth is None else min(model.depth, max_depth)
    if depth < 1:
        raise ValueError("max_depth must be at least 1")
    processor = post_processor(post)
    z = codes
    ranked = None
    for d in range(depth):
        w, c = model.level(d)
        kept = k if d == depth - 1 else beam
        if z is None:
            # labels of one rank differ by no more than what is ranked: transformed and rounded scores
            key = processor.values if digits is None else lambda v: np.round(processor.values(v), digits)
            scored = score_all(x, w, instances, model.labels(d), kept or None, key)
            scored = scored.withColumn("score", processor.transform(F.col("score")))
        else:
            pairs = score_blocks(x, w, c, z)
            combined = processor.combine(processor.transform(F.col("score")), F.col("parent_score"))
            scored = pairs.select("row_id", "label_id", combined.alias("score"))
        if digits is not None:
            scored = scored.withColumn("score", F.round("score", digits))
        ranked = topk_per_row(scored, kept)
        z = ranked.select("row_id", F.col("label_id").alias("code"), F.col("score").alias("val"))
    return l1_prediction(ranked) if normalised else ranked


def last_level(model: Model) -> Model:
    """Only the bottom level: the ranker used when cluster scores come from elsewhere."""
    w, c = model.level(model.depth - 1)
    zero = F.lit(0).alias("level")
    return Model(w.select(zero, "*"), c.select(zero, "*"), 1, model.bias, model.bias_col)


def l1_prediction(pred: DataFrame) -> DataFrame:
    """Scale the scores of each row to an absolute sum of 1."""
    scaled = normalize_rows(pred.withColumnRenamed("score", "val"), "l1")
    return scaled.withColumnRenamed("val", "score")


def predict_with_labels(
    x: DataFrame, w: DataFrame, pairs: DataFrame, k: int | None = None, digits: int | None = None
) -> DataFrame:
    """Score and rank the listed (row_id, label_id) pairs; ``digits`` rounds scores before they are ranked."""
    scored = score_pairs(x, w, pairs)
    return topk_per_row(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k)


def predict_with_codes(
    x: DataFrame, w: DataFrame, c: DataFrame, z: DataFrame, k: int | None = None, digits: int | None = None
) -> DataFrame:
    """Score and rank the labels of each instance's clusters; the cluster scores do not matter.

    They are scored in blocks of a cluster, so that no table of candidates is stored or shuffled; a label of
    several clusters is scored in each and kept once.
    """
    scored = score_blocks(x, w, c, z.select("row_id", "code", F.lit(0.0).alias("val")).distinct())
    scored = scored.select("row_id", "label_id", "score" if digits is None else F.round("score", digits).alias("score"))
    if not c.select("label_id", "code").distinct().groupBy("label_id").count().filter("count > 1").isEmpty():
        scored = scored.groupBy("row_id", "label_id").agg(F.max("score").alias("score"))
    return topk_per_row(scored, k)


# --- counting model --------------------------------------------------------------------------


def count_model(z: DataFrame, y: DataFrame) -> DataFrame:
    """How the labels of a cluster's instances are distributed: (code, label_id, val), rows of sum 1."""
    labelled = y.select("row_id", "label_id").withColumn("val", F.lit(1.0))
    parts = packed_products(z, labelled, "code", "row_id", "label_id")
    return reduce(DataFrame.unionByName, [normalize_rows(p, "l1", "code") for p in parts])


def predict_counts(codes: DataFrame, counts: DataFrame, k: int | None = None, weighted: bool = True, digits: int | None = None) -> DataFrame:
    """Labels by the distribution of each instance's clusters, weighted by the cluster scores or not.

    With ``k`` the product of scores and distributions is never built (``matrix.top_products``).
    """
    z = codes if weighted else codes.withColumn("val", F.lit(1.0))
    if k is not None:
        return top_products(z, counts, k, digits)
    scores = joined_products(z, counts, "row_id", "code", "label_id").withColumnRenamed("val", "score")
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return topk_per_row(scores, k)


def optimal_codes(y: DataFrame, c: DataFrame, k: int | None = None) -> DataFrame:
    """The clusters with most true labels of each instance, as shares: (row_id, code, val)."""
    best = topk_per_row(instance_clusters(y, c), k, col="code", score="val")
    return normalize_rows(best.select("row_id", "code", "val"), "l1")


# --- parameter search ------------------------------------------------------------------------


def grid_search(
    grid: Mapping[str, Iterable], run: Callable[..., DataFrame], beam: int = 10, k: int = 20
) -> DataFrame:
    """Run ``run(beam=…, k=…, **params)`` for every combination of the grid and stack its metrics.

    ``run`` trains, predicts and evaluates; its metric rows get one string column ``params``.
    """
    names = sorted(grid)
    results = []
    for values in product(*[list(grid[n]) for n in names]):
        params = dict(zip(names, values))
        shown = ",".join(f"{n}={v}" for n, v in params.items())
        results.append(run(beam=beam, k=k, **params).select(F.lit(shown).alias("params"), "*"))
    return reduce(DataFrame.unionByName, results)
