"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled into the unit ball and lifted onto the sphere by one more component, so that the
largest inner product is the smallest angle. Three rounds of random signs and a fast Hadamard transform
rotate it; its hash is the nearest signed axis. A table's key is a chain of such axes, as many as give
buckets of a wanted size. Queries look into several keys of every table, nearest first; what they meet
there is ranked by exact inner products, bucket by bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notecode.llm.texts import map_rows
from notecode.session import materialised

TABLES = 6
PROBES = 16  # keys of each table that a query looks into
BUCKET = 400  # vectors of a bucket, on average
PIECE = 4096  # a bucket with more vectors, or more queries, is met in pieces of about so many
_ROWS = 256  # query rows multiplied at once


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (a power of two wide), scaled to keep lengths."""
    n, width = rows.shape
    step = 1
    while step < width:
        pair = rows.reshape(n, -1, 2, step)
        rows = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotated(rows: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """``rows`` under the pseudo-rotation that ``seed`` names: three rounds of signs and transform."""
    random = np.random.default_rng(seed)
    for _ in range(3):
        rows = hadamard(rows * (random.integers(0, 2, rows.shape[1]) * 2.0 - 1.0))
    return rows


def axes_needed(count: int, dims: int, bucket: int) -> list[int]:
    """For each hash of a key, the number of axes to choose from: so many that buckets hold about ``bucket``."""
    wanted, out = max(1.0, count / bucket), []
    while wanted > 1:
        axes = int(min(dims, -(-wanted // 2)))
        out.append(axes)
        wanted /= 2 * axes
    return out


def keys_of(rows: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """The ``probes`` best keys of every row in one table, best first; -1 where there are not so many.

    A key is as good as the sum of squares by which its axes fall short of the nearest ones.
    """
    keys, loss = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
    for place, count in enumerate(axes):
        turned = rotated(rows, (table, place, rows.shape[1]))[:, :count]
        signed = np.concatenate([turned, -turned], axis=1)
        best = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        value = np.take_along_axis(signed, best, axis=1)
        more = (value[:, :1] - value) ** 2
        every = (loss[:, :, None] + more[:, None, :]).reshape(len(rows), -1)
        named = (keys[:, :, None] * (2 * count) + best[:, None, :]).reshape(len(rows), -1)
        order = np.argsort(every, axis=1, kind="stable")[:, :probes]
        keys, loss = np.take_along_axis(named, order, axis=1), np.take_along_axis(every, order, axis=1)
    return np.pad(keys, ((0, 0), (0, probes - keys.shape[1])), constant_values=-1)


def lifted(rows: np.ndarray, longest: float | None) -> np.ndarray:
    """Rows on the unit sphere, padded to a power of two: points (with the longest length) or directions (None)."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    width = 1 << max(1, (rows.shape[1]).bit_length())
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows / (length if longest is None else longest)
    if longest is not None:
        out[:, rows.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (length[:, 0] / longest) ** 2))
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total = total + left[:, k] * right[:, k]
    return total


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    bucket: int = BUCKET,
    piece: int = PIECE,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the largest inner product found.

    ``queries`` are rows of the same table; a query never finds rows of its own id. Scores are exact
    (double precision, components in order); equal scores are ranked by id. What is approximate is only
    which vectors are met: with the defaults at least 97 % of the true neighbours among up to 51,000 random directions
    in 64 dimensions, more where neighbours are nearer.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do
    rows with a null id. Rows repeated with their id and vector count once. Vectors of different length
    are never compared. Other columns are ignored; an empty table gives no rows.

    Equal vectors form a class, which is hashed and compared once and stands for its ``k + 1`` least ids,
    so any number of copies costs one row. Buckets are counted first; a crowded one is met in pieces
    of both sides, all of which are compared.
    """
    spark = vectors.sparkSession
    whole = "{0} IS NOT NULL AND size({0}) > 0 AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists({0}, x -> x <> 0)"

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL").filter(whole.format("v"))
        return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))  # -0.0 equals 0.0

    rows = materialised(usable(vectors), "vectors")
    classes = rows.groupBy("v").agg(F.min("id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    classes = materialised(classes.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "classes")
    state = classes.agg(F.count("*").alias("n"), F.coalesce(F.max("length"), F.lit(1.0)).alias("longest")).first()
    count, longest = state["n"], state["longest"]
    named = materialised(rows.join(classes.select("v", "class"), "v").select("class", "id"), "named")
    asked = usable(queries).join(classes.select("v", "class"), "v").select("class", F.col("id").alias("query_id"))
    asked = materialised(asked.distinct(), "asked")

    kind = rows.schema["v"].dataType.simpleString()

    def hashed(df: DataFrame, look: int, direction: bool) -> DataFrame:
        """``(dims, tab, key, class, least, v)`` for the ``look`` best keys of each vector in each table."""

        def keyed(batch):
            batch = pa.Table.from_batches([batch])
            dims = pc.list_value_length(batch.column("v")).to_numpy()
            for width in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == width))
                matrix = lifted(_matrix(part.column("v")), None if direction else longest)
                axes = axes_needed(count, matrix.shape[1], bucket)
                for table in range(tables):
                    keys = keys_of(matrix, table, axes, look)
                    who, at = np.nonzero(keys >= 0)
                    out = part.take(pa.array(who))
                    columns = {c: out.column(c).combine_chunks() for c in ("class", "least", "v")}
                    yield {"dims": np.full(len(who), width), "tab": np.full(len(who), table), "key": keys[who, at]} | columns

        return map_rows(df.select("class", "least", "v"), keyed, f"dims int, tab int, key long, class long, least long, v {kind}")

    place = ["dims", "tab", "key"]
    stored = materialised(hashed(classes, 1, False), "stored")
    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi")
    probed = materialised(hashed(wanted, probes, True), "probed")
    cut = lambda n: F.ceil(F.col(n) / piece).cast("int")
    crowd = probed.groupBy(*place).agg(F.count("*").alias("n_q")).join(stored.groupBy(*place).agg(F.count("*").alias("n_c")), place)
    crowd = materialised(crowd.select(*place, cut("n_q").alias("parts_q"), cut("n_c").alias("parts_c")), "crowd")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own piece, and in all pieces of the other side."""
        df = df.join(crowd, place).withColumn(own, F.pmod(F.xxhash64("class"), F.col(f"parts_{own}").cast("long")))
        return df.select(*place, own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}").cast("long") - 1)).alias(other), "class", "least", "v")

    limit = k + 1

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = _matrix(left.column("v")), _matrix(right.column("v"))
        who, least = right.column("class").to_numpy(), right.column("least").to_numpy()
        asking = left.column("class").to_numpy()
        out = []
        for start in range(0, len(a), _ROWS):
            block = a[start : start + _ROWS]
            rough = block @ b.T
            if rough.shape[1] > limit:  # rounding of the product must not decide who is in
                bound = np.partition(rough, -limit, axis=1)[:, [-limit]] - 1e-9 * (1.0 + np.abs(rough).max())
            else:
                bound = np.full((len(block), 1), -np.inf)
            x, y = np.nonzero(rough >= bound)
            score = products(block[x], b[y])
            order = np.lexsort((least[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            first = np.searchsorted(x, x)  # where the query's rows begin
            best = np.arange(len(x)) - first < limit
            out.append((asking[start + x[best]], who[y[best]], least[y[best]], score[best]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("q", "c", "least", "score"), zip(*out))})

    group = [*place, "q", "c"]
    left, right = dealt(probed, "q", "c"), dealt(stored, "c", "q")
    pairs = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compared, "q long, c long, least long, score double")
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))
    pairs = pairs.withColumn("place", rank).filter(F.col("place") <= limit).dropDuplicates(["q", "c"])
    # a class stands for its first ids: more than k + 1 of them can be in no result
    order = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    members = named.distinct().withColumn("place", order).filter(F.col("place") <= limit).select(F.col("class").alias("c"), "id")
    found = pairs.select("q", "c", "score").join(members, "c")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= limit)
    listed = found.groupBy(F.col("q").alias("class")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("list"))
    own = asked.join(listed, "class").select("query_id", F.filter("list", lambda x: x["id"] != F.col("query_id")).alias("list"))
    own = own.select("query_id", F.posexplode(F.slice("list", 1, k)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
