"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets ``chunks`` x 4 MinHash values of 14 bits. Four values make a chunk
of 56 bits. If two signatures differ in at most 2 * chunks - 1 values, some chunk differs in at most
one (pigeonhole); enumerating the errors allowed there, each of its four values is masked in turn, and
one of the four masked chunks must be equal. So equal (chunk, masked value, rest) keys give every pair
under that distance; shingle sets confirm them.

Beside it a set has a parity sketch: one bit for each of ``PARITY`` classes of hashes, whether it holds an
odd number of them. Two sketches differ in at most as many bits as the sets differ in shingles, so the
sketch rules pairs out, never a pair that is similar enough.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.llm.components import components
from notecode.llm.texts import as_signed, map_rows, mix, shingle_set
from notecode.session import materialised

CHUNKS = 24
LANES = 4  # values in a chunk
BITS = 14  # of a value
FARTHEST = 2 * CHUNKS - 1  # of 96 values, all within the guarantee; two documents at 75 % differ in more with a probability of 1.2e-7
STAR_ROUNDS = 3
PARITY = 2048  # bits of the parity sketch; sets of many more shingles are only tested by their signatures
PIECES = 64  # a text needed by many pairs is sent out in up to so many copies
_ONES = sum(1 << (BITS * k) for k in range(LANES))
_FACTORS = mix(np.arange(1, CHUNKS * LANES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(_FACTORS)
ODD = [f"p{k}" for k in range(PARITY // 64)]  # columns of the parity sketch


def minhash(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of ``BITS`` bits for a set of 64-bit hashes."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 512):
        hashed = values[i : i + 512, None] * _FACTORS[:count] + _SHIFTS[:count]
        np.minimum(least, hashed.min(axis=0), out=least)
    return mix(least) >> np.uint64(64 - BITS)


def packed(signature: np.ndarray) -> np.ndarray:
    """A signature as one number for each chunk."""
    return (signature.reshape(-1, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def parities(values: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of 64-bit hashes, as bytes."""
    return np.packbits(np.bincount((values & np.uint64(PARITY - 1)).view(np.int64), minlength=PARITY) & 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, chunks: int) -> DataFrame:
    """``(id, n, set_a, set_b, s0, s1, ..., p0, p1, ...)``: size, 128-bit identity, signature and parity sketch of the shingle set."""

    def signed(batch):
        sizes, identity, rows, odd = [], [], [], []
        for text in batch.column(1).to_pylist():
            values = shingle_set(text, width)
            sizes.append(len(values))
            identity.append((mix(values).sum(dtype=np.uint64), mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            rows.append(packed(minhash(values, chunks * LANES)))
            odd.append(parities(values))
        found = as_signed(np.array(rows, np.uint64).reshape(len(sizes), chunks))
        pair = as_signed(np.array(identity, np.uint64).reshape(len(sizes), 2))
        bits = np.array(odd, np.uint8).reshape(len(sizes), PARITY // 8).view(np.int64)
        out = {"id": batch.column(0), "n": sizes, "set_a": pair[:, 0].copy(), "set_b": pair[:, 1].copy()}
        yield out | {f"s{k}": found[:, k].copy() for k in range(chunks)} | {name: bits[:, k].copy() for k, name in enumerate(ODD)}

    schema = "id long, n long, set_a long, set_b long, " + ", ".join(f"{name} long" for name in [*(f"s{k}" for k in range(chunks)), *ODD])
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(chosen, signed, schema)


def distance(left: str, right: str, chunks: int) -> Column:
    """Number of signature values in which two rows differ."""
    half = BITS // 2
    low = F.lit(_ONES * ((1 << half) - 1))  # the lower half of each value
    total = F.lit(0)
    for k in range(chunks):
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, half)).bitwiseAND(low)
        any_bit = x
        for shift in range(1, half):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(_ONES)))
    return total


def may_be_similar(left: str, right: str, percent: int) -> Column:
    """Whether sizes and parity sketches of two rows allow ``percent`` %. True for every pair that has it.

    Sets of n and m elements are that similar if and only if their symmetric difference is no larger
    than (n + m) * (100 - percent) / (100 + percent).
    """
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    differ = F.lit(0)
    for name in ODD:
        differ = differ + F.bit_count(F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}")))
    sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    return sizes & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach ``percent`` % of their union.

    The first text of a pair may be wanted by a third of all rows: its copies are dealt over up to
    ``PIECES`` keys, no more than it has pairs.
    """
    pairs = pairs.withColumn("piece", F.pmod(F.xxhash64("b"), F.lit(PIECES)))
    first = pairs.select("a", "piece").distinct().join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(first, ["a", "piece"])

    def compare(batch):
        a, b, links = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        known: dict[int, np.ndarray] = {}
        for i, (x, y) in enumerate(zip(a, b)):
            if x not in known:
                known = {x: shingle_set(batch.column(2)[i].as_py(), width)}
            other = shingle_set(batch.column(3)[i].as_py(), width)
            shared = len(np.intersect1d(known[x], other, assume_unique=True))
            if shared and 100 * shared >= percent * (len(known[x]) + len(other) - shared):
                links.append((x, y))
        yield {"a": [x for x, _ in links], "b": [y for _, y in links]}

    return map_rows(both.select("a", "b", "text_a", "text_b"), compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    chunks: int = CHUNKS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each input row.

    Two documents are linked if the intersection of their sets of ``width``-word shingles (A-Z
    lower-cased) is at least ``percent`` % of the union; ``component_id`` is the smallest id reachable
    over links and ``kept`` says that it is the document's own. A pair at exactly 75 % is missed with a
    probability of 1.2e-7, one above it still less often. Null and blank texts have no
    shingles and are linked with nothing; neither are rows with a null id (component null, kept). Rows
    repeated with their id are marked alike. Other columns are ignored; an empty table gives no rows.

    Equal sets form classes first, so exact copies cost one row of an aggregation. In a bucket of equal
    keys every class is compared with the most central one only, and again among those that do not
    belong to the group found so; what is then still outside the largest group of its bucket is compared
    with the rest of the bucket, if sizes and parity sketches allow the similarity. So a group of n near
    copies gives about n comparisons, not n * n.
    """
    signed = materialised(signatures(docs, id_col, text_col, width, chunks), "signatures")
    lanes = [f"s{k}" for k in range(chunks)]
    filled = signed.filter("n > 0 AND id IS NOT NULL")
    # equal identities have equal sketches: any row's will do
    sketches = [F.first(c).alias(c) for c in [*lanes, *ODD]]
    classes = filled.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), *sketches)
    classes = materialised(classes, "classes")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    keys = classes.select("rep", F.posexplode(F.array(*lanes)).alias("chunk", "value"))
    masks = [((1 << (LANES * BITS)) - 1) ^ (((1 << BITS) - 1) << (BITS * k)) for k in range(LANES)]
    keys = keys.select("rep", "chunk", "value", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("lane", "mask"))
    # a number for (chunk, masked value, rest): if two of them share one, pairs meet that would not have met
    key = F.xxhash64(F.col("chunk") * LANES + F.col("lane"), F.col("value").bitwiseAND(F.col("mask"))).alias("key")
    keys = keys.select(key, "rep").repartition("key")  # one shuffle for the counts and the rows
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size"))
    members = materialised(keys.join(shared.filter("low < high").select("key", "size"), "key"), "members")
    # the original of a group of near copies shares more keys with them than they do with each other
    central = members.groupBy("rep").agg(F.sum("size").alias("central")).join(classes.select("rep", "n"), "rep")
    members = materialised(members.drop("size").join(central, "rep"), "members")

    near = distance("x", "y", chunks) <= FARTHEST * chunks // CHUNKS
    able = may_be_similar("x", "y", percent)
    sketch = classes.select("rep", "n", *lanes, *ODD)

    def checked(pairs: DataFrame) -> DataFrame:
        """Confirmed links among ``(a, na, b, nb)``, after the cheap tests of size, signature and parity."""
        fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        pairs = pairs.filter(fits).select("a", "b").distinct()
        x = sketch.withColumnRenamed("rep", "a").alias("x")
        y = sketch.withColumnRenamed("rep", "b").alias("y")
        pairs = pairs.join(x, "a").join(y, "b").filter(able & near).select("a", "b")
        return materialised(_confirmed(materialised(pairs, "pairs"), texts, width, percent), "links")

    def grouped(links: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` with their component, where their bucket holds more than one."""
        found = components(links).withColumnRenamed("id", "rep")
        rows = rows.drop("component").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        mixed = mixed.filter("low < high").select("key")
        return materialised(rows.join(mixed, "key", "left_semi"), "mixed")

    links, rows = None, members
    for star in range(STAR_ROUNDS):
        lead = rows
        if star:  # the largest groups are done: now those outside the first group of each bucket
            first = rows.groupBy("key").agg(F.min("component").alias("first"))
            lead = rows.join(first, "key").filter("component > first")
        best = F.max(F.struct("central", F.bitwise_not("rep").alias("last"), F.col("n").alias("na"))).alias("best")
        top = lead.groupBy("key").agg(best).select("key", F.bitwise_not("best.last").alias("a"), "best.na")
        pairs = lead.join(top, "key").filter("a <> rep").select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb"))
        new = checked(pairs)
        links = new if links is None else links.union(new)
        rows = grouped(links, rows)
    if not rows.isEmpty():
        sizes = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("largest"))
        wide = rows.select("key", "rep", "component").join(largest.select("key", F.col("largest.component").alias("largest")), "key")
        wide = materialised(wide.join(sketch.drop(*lanes), "rep"), "rest")
        x, y = wide.filter("component <> largest").alias("x"), wide.drop("largest").alias("y")
        once = (F.col("y.component") == F.col("x.largest")) | (F.col("x.rep") < F.col("y.rep"))
        apart = F.col("x.component") != F.col("y.component")
        pairs = x.join(y, [F.col("x.key") == F.col("y.key"), apart & once & able])
        low, high = F.least("x.rep", "y.rep"), F.greatest("x.rep", "y.rep")
        pairs = pairs.select(low.alias("a"), F.col("x.n").alias("na"), high.alias("b"), F.col("y.n").alias("nb"))
        links = links.union(checked(pairs))
    found = components(links).withColumnRenamed("id", "rep")
    named = classes.join(found, "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "set_a", "set_b").join(named, ["set_a", "set_b", "n"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
