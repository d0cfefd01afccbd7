"""Ranked lexical search by no-random-access (NRA) reads of impact-sorted lists.

Documents are dealt to shards of a bounded number of postings. In a shard every query term has a list
of (impact, document), highest impact first. Lists are read in turn from the top only. A document
that was met has a lower bound (the impacts read) and an upper one (that, plus the last impact read of
each list it was not met in); one that was not met is bounded by the sum of the last impacts. Reading
goes on until no interval that reaches the k-th best score is open, so membership, ties and scores are
final. The shards' best k are merged by a window.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notecode.llm.texts import map_rows, slices
from notecode.session import materialised

SHARD = 200_000  # postings of a shard, about
PART = 1 << 20  # bytes of the texts whose terms are in memory at once
FIRST_READ = 64  # entries of each list read at first; later reads double the depth
#: Bytes that belong to a term: digits, letters and everything beyond ASCII; all others become blanks.
_KEPT = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_KEPT).lower().split()


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(uid, id, n, terms, counts)``: one row for every input row, with a row number of its own."""

    def counted(batch):
        for part in slices(batch, 1, PART):
            sizes, terms, counts, ends = [], [], [], [0]
            for raw in part.column(1).to_pylist():
                words = terms_of(raw or b"")
                found = Counter(words)
                sizes.append(len(words))
                terms.extend(found)
                counts.extend(found.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield {
                "id": part.column(0),
                "n": sizes,
                "terms": pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            }

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return map_rows(chosen, counted, "id long, n long, terms array<binary>, counts array<long>").withColumn("uid", F.monotonically_increasing_id())


def resolved(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` documents of impact-sorted ``lists`` of (document, impact): documents, scores, entries read.

    Equal scores go by ascending ``ids`` (one for each document), then by document number.
    """
    lower = np.zeros(len(ids), np.int64)
    met = np.zeros((len(lists), len(ids)), bool)
    last = np.array([impact[0] for _, impact in lists], np.int64)
    read, depth = 0, first_read
    while True:
        for t, (docs, impact) in enumerate(lists):
            part = slice(read, depth)
            lower[docs[part]] += impact[part]
            met[t, docs[part]] = True
            last[t] = impact[depth - 1] if depth < len(impact) else 0
        read, depth = depth, depth * 2
        seen = np.flatnonzero(lower)
        low, unmet = lower[seen], int(last.sum())
        best = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else (low.min() if len(low) == k else 0)
        high = low + (~met[:, seen] * last[:, None]).sum(axis=0)
        open_ = (high >= best) & (high > low)
        if (not unmet) or (len(low) >= k and unmet < best and not open_.any()):
            break
    seen, low = seen[low >= best], low[low >= best]
    order = np.lexsort((seen, ids[seen], -low))[:k]
    return seen[order], low[order], min(read, max(len(docs) for docs, _ in lists))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    shard: int = SHARD,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0.

    N is the number of documents with a term, L all terms with repeats, n those of one document, df the
    documents that hold a term. A term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document
    scores for each distinct term of the item ``weight * (10^9 tf div (1000 tf + 8 m))``, where m is
    ``10 + (90 n N div L)``. Equal scores are ranked by document id.

    Every row is a document, or a query, of its own, also where ids repeat or are null (null ids come
    first among equal scores). Null and blank texts hold no term: such items find nothing. Without
    documents or items there are no rows. Other columns are ignored.

    Everything about a text is stored once; terms that no item has leave by a join. A shard holds about
    ``shard`` postings and never more than one document beyond what its hash deals to it, so its lists
    and score intervals fit in a task whatever the size of the corpus.
    """
    spark = docs.sparkSession
    stored = materialised(term_counts(docs, doc_col, text_col), "terms")
    queries = materialised(term_counts(items, item_col, text_col).select("uid", "id", F.explode("terms").alias("term")), "queries")
    vocabulary = materialised(queries.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    entries = stored.select("uid", "id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
    entries = entries.select("uid", "id", "n", F.col("e.terms").alias("term"), F.col("e.counts").alias("tf"))
    postings = materialised(entries.join(vocabulary, "term").select("uid", "id", "n", "term_id", "tf"), "postings")

    totals = stored.agg(F.count_if(F.col("n") > 0).alias("filled"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    filled, length = F.lit(totals["filled"]), F.lit(max(totals["length"], 1))
    ratio = (filled * 2 + 2).cast("double") / (F.col("df") * 2 + 1).cast("double")
    weights = postings.groupBy("term_id").agg(F.count("*").alias("df")).select("term_id", F.floor(F.log(ratio) * 1000).cast("long").alias("weight"))
    shards = max(1, -(-postings.count() // shard))
    share = F.call_function("div", F.col("n") * 90 * filled, length) + 10
    impact = F.col("weight") * F.call_function("div", F.col("tf") * 1_000_000_000, F.col("tf") * 1000 + share * 8)
    dealt = postings.join(weights, "term_id").select(
        F.pmod(F.xxhash64("uid"), F.lit(shards).cast("long")).alias("shard"), "uid", "id", "term_id", impact.alias("impact")
    )
    dealt = dealt.filter("impact > 0")
    asked = queries.join(vocabulary, "term").select(F.col("uid").alias("item"), "term_id")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "item", "term_id")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        uid, place = np.unique(left.column("uid").to_numpy(), return_inverse=True)
        ids = np.full(len(uid), np.iinfo(np.int64).min)
        raw = left.column("id").combine_chunks()
        ids[place] = raw.fill_null(np.iinfo(np.int64).min).to_numpy()
        term, value = left.column("term_id").to_numpy(), left.column("impact").to_numpy()
        order = np.lexsort((place, -value, term))
        term, value, place = term[order], value[order], place[order]
        terms, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))
        lists = {int(t): (place[s:e], value[s:e]) for t, s, e in zip(terms, starts, ends)}
        item, wanted = right.column("item").to_numpy(), right.column("term_id").to_numpy()
        order = np.argsort(item, kind="stable")
        item, wanted = item[order], wanted[order]
        names, starts = np.unique(item, return_index=True)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        for name, s, e in zip(names, starts, np.append(starts[1:], len(item))):
            own = [lists[t] for t in wanted[s:e].tolist() if t in lists]
            if own:
                found, score, _ = resolved(own, ids, k)
                out.append((np.full(len(found), name), uid[found], score))
        return pa.table({n: np.concatenate(c) for n, c in zip(("item", "uid", "score"), zip(*out))})

    schema = "item long, uid long, score long"
    found = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(searched, schema)
    found = found.join(stored.select("uid", F.col("id").alias("doc_id")), "uid")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "uid"))
    found = found.withColumn("rank", place).filter(F.col("rank") <= k)
    names = queries.select(F.col("uid").alias("item"), F.col("id").alias("item_id")).distinct()
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
