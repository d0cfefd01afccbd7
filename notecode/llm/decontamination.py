"""Benchmark decontamination by size-partitioned MinHash containment search. Built-in functions only.

Items of a few shingles are looked up by all their shingles. A short item inside a long document has a tiny Jaccard similarity to it, so items are partitioned by the
size of their shingle set and, for each partition, every document is cut into blocks of about that
size. An item that a document contains shares many shingles with one or two blocks; it becomes a
candidate if any of its MinHash values equals that of a block. Candidates are verified by counting the
item's shingles in the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import words_of
from notecode.session import materialised

HASHES = 32
GROWTH = 4  # sizes of one partition: from ``low`` to below ``low * GROWTH``
SMALLEST = 8  # items with fewer shingles are looked up exactly
ITEMS = 50_000  # items searched for at once; their MinHash values are broadcast (8 bytes x HASHES each)


def _spread(k: int) -> int:
    """A fixed 64-bit constant for each hash function (the finaliser of splitmix64 on k)."""
    mask = (1 << 64) - 1
    z = (k + 1) * 0x9E3779B97F4A7C15 & mask
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
    z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def _ordering(value: Column, k: int) -> Column:
    """The k-th order of hash values: their bits turned by k places and flipped by a constant."""
    turned = F.shiftleft(value, k).bitwiseOR(F.shiftrightunsigned(value, 64 - k)) if k else value
    return turned.bitwiseXOR(F.lit(_spread(k)))


def _gram(width: int) -> list[Column]:
    return [F.get(F.col("words"), F.col("at") + k) for k in range(width)]


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """``texts(id, words)`` -> one row for each place ``at`` where a shingle starts, words kept."""
    last = F.size("words") - width
    return texts.filter(last >= 0).select("id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))


def _least(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(id, value)``: the MinHash values of each group of shingles."""
    hashed = rows.select(*keys, F.xxhash64(*_gram(width)).alias("h"))
    least = hashed.groupBy(*keys).agg(*[F.min(_ordering(F.col("h"), k)).alias(f"m{k}") for k in range(HASHES)])
    return least.select("id", F.explode(F.array(*[f"m{k}" for k in range(HASHES)])).alias("value"))


def _short(texts: DataFrame, marks: DataFrame, width: int, percent: int) -> DataFrame:
    """``(id, item_id)``: documents that hold ``percent`` % of the shingles ``marks(item_id, value, n_item)``.

    ``marks`` is broadcast, so a hot shingle needs no exchange; counting goes by id, as ``texts`` lie.
    """
    hashed = _shingles(texts, width).select("id", F.xxhash64(*_gram(width)).alias("value"))
    held = hashed.join(F.broadcast(marks), "value").groupBy("id", "item_id", "n_item").agg(F.countDistinct("value").alias("n"))
    return held.filter(F.col("n") * 100 >= F.col("n_item") * percent).select("id", "item_id")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item)``: documents that hold ``percent`` % of an item's shingles.

    Shingles are ``width`` consecutive lower-case words; both counts are of distinct ones, over the
    whole document. An item with fewer words has no shingle and is found nowhere; null texts likewise.
    Rows with a null id are ignored; rows repeated with their id count as one document (or item) with
    the shingles of all. Other columns are ignored; with no items or no documents there are no rows.

    Items of less than ``SMALLEST`` shingles are found exactly. Of larger ones, an item contained whole
    is missed with a probability of up to 3e-5, one with the least share that counts with up to 2e-4
    (32 shingles scattered over six blocks). Documents are dealt out once by id and
    summed up there, block by block; items come in parts of ``ITEMS``, so that what is broadcast is
    bounded.
    """
    names = {id_col: "id", text_col: "text"}
    texts = docs.select(*[F.col(a).alias(b) for a, b in names.items()]).filter("id IS NOT NULL")
    texts = texts.repartition("id").select("id", words_of(F.lower("text")).alias("words"))
    wanted = items.select(F.col(item_col).alias("id"), words_of(F.lower(F.col(item_text_col))).alias("words"))
    wanted = materialised(wanted.filter(F.col("id").isNotNull() & (F.size("words") >= width)), "items")
    grams = _shingles(wanted, width).select("id", F.concat_ws(" ", *_gram(width)).alias("gram")).distinct()
    sizes = grams.groupBy("id").agg(F.count("*").alias("n_item"))
    grams = materialised(grams.join(sizes, "id").select(F.col("id").alias("item_id"), "gram", "n_item"), "grams")
    sizes = grams.select(F.col("item_id").alias("id"), "n_item").distinct()
    largest = sizes.agg(F.max("n_item")).first()[0]
    total = sizes.count()

    found = None
    low, upto = 1, SMALLEST
    while largest is not None and low <= largest:
        block = 2 * low
        here = sizes.filter((F.col("n_item") >= low) & (F.col("n_item") < upto)).select("id")
        for part in range(-(-total // ITEMS)):
            some = here.filter(F.pmod(F.xxhash64("id"), F.lit(-(-total // ITEMS))) == part)
            if some.isEmpty():
                continue
            if low < SMALLEST:
                marks = _shingles(wanted.join(some, "id"), width).select(F.col("id").alias("item_id"), F.xxhash64(*_gram(width)).alias("value"))
                marks = marks.distinct().join(sizes.withColumnRenamed("id", "item_id"), "item_id")
                near = _short(texts, materialised(marks, "marks"), width, percent)
                found = near if found is None else found.union(near)
                continue
            marks = _least(_shingles(wanted.join(some, "id"), width), ["id"], width)
            marks = materialised(marks.select(F.col("id").alias("item_id"), "value").distinct(), "marks")
            blocks = _shingles(texts, width).withColumn("block", F.floor(F.col("at") / block))
            near = _least(blocks, ["id", "block"], width).join(F.broadcast(marks), "value").select("id", "item_id").distinct()
            found = near if found is None else found.union(near)
        low, upto = upto, upto * GROWTH
    if found is None:
        kind, other = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {other}, n_shared long, n_item long")
    found = materialised(found.distinct(), "candidates")
    held = docs.select(*[F.col(a).alias(b) for a, b in names.items()]).join(found.select("id").distinct(), "id", "left_semi")
    held = _shingles(held.select("id", words_of(F.lower("text")).alias("words")), width)
    held = held.select("id", F.concat_ws(" ", *_gram(width)).alias("gram")).join(grams, "gram")
    held = held.join(found, ["id", "item_id"], "left_semi")
    counted = held.groupBy("id", "item_id").agg(F.countDistinct("gram").alias("n_shared"), F.max("n_item").alias("n_item"))
    counted = counted.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return counted.select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item")
