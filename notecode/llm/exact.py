"""Exact deduplication over a sharded cuckoo-filter index of text digests.

The index is a log of stored keys plus one small filter per shard. The filters decide what happens to a
delivered digest: a miss becomes a new stored key without any look at the stored ones; a hit is
compared with the stored content of that digest, and either adds to the stored key that it equals or,
if the filter was wrong, becomes a new key as well. The result is read from the stored keys, which are
never merged by their digest again. Digests can be inserted and deleted, and a filter that overflows,
or a shard that grows too large, is built anew from the stored keys. Every step writes a new generation
into the shared folder, so a lost executor costs a recomputation only.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.llm.texts import map_rows
from notecode.session import materialised

SLOTS = 4  # fingerprints in a bucket
MAX_KICKS = 200  # evictions before a filter counts as full
PER_SHARD = 50_000  # digests of a shard at most, before the index is cut into more shards
KEY = ["digest", "content", "born"]  # of a stored key: born is the generation that made it
LOG = "digest binary, content binary, born int, keep_id long, n long, deleted boolean"


class CuckooFilter:
    """A set of digests that may answer "present" wrongly (about once in 8,000), but never "absent".

    A digest has a 16-bit fingerprint and two buckets; either follows from the other and the
    fingerprint, so entries can move without their digest, and one can be removed again.
    """

    def __init__(self, buckets: int, table: bytes | None = None):
        self.mask = buckets - 1
        self.table = array("H", table if table is not None else bytes(2 * SLOTS * buckets))

    @classmethod
    def holding(cls, digests: Iterable[bytes], at_least: int = 16) -> CuckooFilter:
        """A filter over ``digests``, doubled until they all fit."""
        digests = list(digests)
        buckets = max(16, 1 << (max(at_least, len(digests)) * 5 // 4 // SLOTS).bit_length())
        while True:
            new = cls(buckets)
            if all(new.insert(d) for d in digests):
                return new
            buckets *= 2

    @property
    def buckets(self) -> int:
        return self.mask + 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") or 1
        first = int.from_bytes(digest[10:18], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & self.mask)

    def _slot(self, bucket: int, mark: int) -> int:
        """Place of ``mark`` in a bucket, or -1; mark 0 finds a free place."""
        for k in range(bucket * SLOTS, (bucket + 1) * SLOTS):
            if self.table[k] == mark:
                return k
        return -1

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        """False if the filter is full; it must then be built anew, as one entry may be lost."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if (k := self._slot(bucket, 0)) >= 0:
                self.table[k] = mark
                return True
        bucket = a
        for kick in range(MAX_KICKS):
            k = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.table[k] = self.table[k], mark
            bucket = self._other(bucket, mark)
            if (k := self._slot(bucket, 0)) >= 0:
                self.table[k] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Take one entry of ``digest`` out; only for digests known to be in the set."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if (k := self._slot(bucket, mark)) >= 0:
                self.table[k] = 0
                return True
        return False


def _shard(shards: int):
    """The shard of a digest: its first seven bytes as a number, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long"), F.lit(shards)).cast("int")


_FILTERS = "shard int, buckets int, slots binary"
_PROBED = "shard int, digest binary, content binary, hit boolean, full boolean, buckets int, slots binary"


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Hits of a shard's new digests; the misses enter its filter, which is the last row."""
    shard = int((keys if len(keys) else filters)["shard"].iloc[0])
    held = CuckooFilter(int(filters.buckets.iloc[0]), filters.slots.iloc[0]) if len(filters) else CuckooFilter.holding([])
    rows = [(shard, d, c, held.contains(d), None, None, None) for d, c in sorted(zip(keys["digest"], keys["content"]))]
    full = False  # a full filter may lose an entry, so all answers come first
    for row in rows:
        full |= not row[3] and not held.insert(row[1])
    rows.append((shard, None, None, None, full, held.buckets, held.table.tobytes()))
    return pd.DataFrame(rows, columns=["shard", "digest", "content", "hit", "full", "buckets", "slots"])


def _change(delete: bool):
    def apply(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        """Put digests into a shard's filter, or take them out. A full filter is marked by no slots."""
        if not len(filters):
            return filters
        held = CuckooFilter(int(filters.buckets.iloc[0]), filters.slots.iloc[0])
        done = [held.delete(d) if delete else held.insert(d) for d in sorted(keys["digest"])]
        slots = held.table.tobytes() if delete or all(done) else None
        return pd.DataFrame({"shard": filters.shard, "buckets": held.buckets, "slots": [slots]})

    return apply


def _rebuild(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter from its stored keys, twice as large as the one that was full."""
    shard = int((keys if len(keys) else old)["shard"].iloc[0])
    size = SLOTS * 2 * int(old.buckets.iloc[0]) if len(old) else 16
    held = CuckooFilter.holding(sorted(keys["digest"]), at_least=size * 3 // 4)
    return pd.DataFrame({"shard": [shard], "buckets": [held.buckets], "slots": [held.table.tobytes()]})


class CuckooIndex:
    """Live digests with the largest id that carries them and the number of their rows.

    ``insert`` and ``delete`` each take any number of rows; equal digests are combined before the
    shuffle, so a digest that a third of all rows share is one row of its shard. A shard has at most
    about ``per_shard`` digests: beyond that the number of shards doubles. The driver keeps only
    counts and folder names.

    A row may bring a ``content`` (here the length and a second digest of its text), which is stored
    with its key: digests whose contents differ are different keys. Without that column the digest
    alone is compared.
    """

    def __init__(self, spark: SparkSession, per_shard: int = PER_SHARD):
        self.spark, self.per_shard = spark, per_shard
        self.shards, self.generation, self.size = 1, 0, 0
        self.log: list[DataFrame] = []
        self.filters = spark.createDataFrame([], _FILTERS)

    def stored(self) -> DataFrame:
        """``(digest, content, born, keep_id, n)`` of every live stored key: what its log entries add up to."""
        log = self.spark.createDataFrame([], LOG)
        for part in self.log:
            log = log.union(part)
        sums = log.groupBy(*KEY).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.max("deleted").alias("_gone"))
        return sums.filter("NOT _gone").drop("_gone")

    def live(self) -> DataFrame:
        """``(digest, keep_id, n)`` of every live stored key."""
        return self.stored().select("digest", "keep_id", "n")

    def _note(self, entries: DataFrame, deleted: bool = False) -> None:
        """Write log entries ``(digest, content, born, keep_id, n)``."""
        self.log.append(materialised(entries.select(*KEY, "keep_id", "n", F.lit(deleted).alias("deleted")), "log"))

    def _cogroup(self, keys: DataFrame, filters: DataFrame, function, schema: str) -> DataFrame:
        keys = keys.withColumn("shard", _shard(self.shards))
        return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(function, schema)

    def _built(self, full: DataFrame | None = None) -> DataFrame:
        """Filters from the stored keys: of all shards, or of those in ``full`` (shard, buckets, slots)."""
        if full is None:
            return self._cogroup(self.live().select("digest"), self.spark.createDataFrame([], _FILTERS), _rebuild, _FILTERS)
        keys = self.live().withColumn("shard", _shard(self.shards)).join(full.select("shard"), "shard", "left_semi")
        return keys.select("digest", "shard").groupBy("shard").cogroup(full.groupBy("shard")).applyInPandas(_rebuild, _FILTERS)

    def _keep(self, filters: DataFrame) -> None:
        """Store a generation of filters; those without slots were full and are built from the keys."""
        filters = materialised(filters, "filters")
        full = filters.filter("slots IS NULL")
        if not full.isEmpty():
            filters = materialised(filters.filter("slots IS NOT NULL").union(self._built(full)), "filters")
        self.filters = filters

    def insert(self, rows: DataFrame) -> DataFrame:
        """Add rows ``(digest, id)`` or ``(digest, content, id)``; returns ``(digest, known)``, known if it was live before.

        Rows without a digest are ignored.
        """
        self.generation += 1
        content = F.col("content") if "content" in rows.columns else F.lit(b"")
        batch = rows.select("digest", F.coalesce(content, F.lit(b"")).alias("content"), "id").filter("digest IS NOT NULL")
        batch = batch.groupBy("digest", "content").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
        batch = materialised(batch, "batch")
        new = batch.count()
        if self.size + new > self.shards * self.per_shard:
            while self.size + new > self.shards * self.per_shard:
                self.shards *= 2
            self._keep(self._built())
        probed = materialised(self._cogroup(batch.select("digest", "content"), self.filters, _probe, _PROBED), "probed")
        answers = probed.filter("digest IS NOT NULL").select("digest", "content", "hit")
        same = self.stored().select(*KEY)
        verified = answers.filter("hit").join(same, ["digest", "content"], "left")
        born = answers.filter("NOT hit").withColumn("born", F.lit(None).cast("int")).unionByName(verified)
        born = materialised(born, "born")  # the stored key that a digest adds to; none for a new key
        entry = batch.join(born, ["digest", "content"])
        self._note(entry.withColumn("born", F.coalesce("born", F.lit(self.generation))))
        self.size += born.filter("born IS NULL").count()
        now = probed.filter("digest IS NULL").select("shard", "buckets", F.expr("if(full, null, slots)").alias("slots"))
        self._keep(now)
        wrong = born.filter("hit AND born IS NULL").select("digest")
        if not wrong.isEmpty():
            self._keep(self._cogroup(wrong, self.filters, _change(False), _FILTERS))
        return born.groupBy("digest").agg(F.max(F.col("born").isNotNull()).alias("known"))

    def delete(self, digests: DataFrame) -> DataFrame:
        """Remove live digests, with any content; returns those that were live. Others are ignored."""
        self.generation += 1
        gone = self.stored().join(digests.select("digest").distinct(), "digest", "left_semi")
        gone = materialised(gone.select(*KEY), "gone")
        self._note(gone.select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n")), deleted=True)
        self.size -= gone.count()
        self._keep(self._cogroup(gone.select("digest"), self.filters, _change(True), _FILTERS))
        return gone.select("digest").distinct()

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``(digest, keep_id, n)`` of those digests that are live."""
        return digests.select("digest").distinct().join(self.live(), "digest")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, content)`` of each whole text with A-Z lower-cased (null: empty), row by row.

    The digest is SHA-256; the content is the text's length in bytes and a BLAKE2 digest.
    """

    def hashed(batch):
        texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(1).to_pylist()]
        content = [len(t).to_bytes(8, "big") + hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        yield {"id": batch.column(0), "digest": [hashlib.sha256(t).digest() for t in texts], "content": content}

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(chosen, hashed, "id long, digest binary, content binary")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, per_shard: int = PER_SHARD
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, one row for each input row.

    Rows are inserted in ``batches`` deliveries (by a hash of the id); the result does not depend on
    their number. Each row is given the stored key of its text, as the filters' answers and the checks of
    their hits made it. Null text counts as empty, so null and empty texts form one group. Of equal texts the
    largest id stays; a null id never wins against another, and a group of null ids only keeps them
    all. Rows repeated with their id are all marked alike. Other columns are ignored. An empty table
    gives no rows.
    """
    rows = materialised(digests(docs, id_col, text_col), "digests")
    index = CuckooIndex(docs.sparkSession, per_shard)
    delivery = F.pmod(F.xxhash64("id"), F.lit(batches))
    for k in range(batches):
        index.insert(rows.filter(delivery == k))
    keys = materialised(index.stored(), "stored")  # a plain table, so that a join can split the rows of one digest
    return rows.join(keys, ["digest", "content"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )
