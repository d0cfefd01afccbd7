"""Removal of word passages that another document has already, found by difference-cover anchors.

Words are hashed only at places whose number modulo a period lies in a difference cover: for any two
places there is one shift below the period that brings both into the cover. A common passage of
``length`` words therefore shares an aligned anchor of ``length - period + 1`` words, wherever it
stands in either document. Passages are then extended from shared anchors to full windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import as_signed, map_rows, mix, sequence_hash, split_words, window_hashes
from notecode.session import materialised

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # every residue modulo 31 is a difference of two of these
ROWS = 200_000  # output rows of one Arrow batch


def _sliced(columns: dict[str, list[np.ndarray]]):
    """Join the pieces of each column; nothing is given out for no rows."""
    if columns and any(len(x) for x in next(iter(columns.values()))):
        yield {name: np.concatenate(pieces) for name, pieces in columns.items()}


def _gathered(items, names):
    """Collect column pieces until ``ROWS`` rows are there, then give them out."""
    held, n = {name: [] for name in names}, 0
    for pieces in items:
        for name, piece in zip(names, pieces):
            held[name].append(piece)
        n += len(pieces[0])
        if n >= ROWS:
            yield from _sliced(held)
            held, n = {name: [] for name in names}, 0
    yield from _sliced(held)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_of_each(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first of those places that have the same hash: a text repeating itself sends each only once."""
    return places[np.unique(hashes[places], return_index=True)[1]]


def covered_words(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Which words lie in one of the windows that begin at ``starts``."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row for each input row.

    A window is ``length`` consecutive words, unchanged. Every word covered by a window that also
    starts in a document with a smaller id is removed; windows are judged on the input. Texts with
    fewer words, null texts among them, lose nothing. Rows with a null id neither lose words nor count
    as a document with a smaller id; of rows repeated with their id (and text) none is smaller, so they
    lose the same words. Other columns are ignored; an empty table gives no rows.

    Equal word sequences are one text with the smallest of their ids: its copies lose everything and
    need no windows. Anchors, then windows, are grouped by their hash with the smallest document each,
    never in pairs.
    """
    width = length - PERIOD + 1
    if width < 1:
        raise ValueError(f"length must be at least {PERIOD}")
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def described(batch):
        rows = [(len(w), *sequence_hash(w), _digest(w)) for w in map(split_words, batch.column(1).to_pylist())]
        names = ("n", "seq_a", "seq_b", "sha")
        yield {"id": batch.column(0)} | {name: [r[k] for r in rows] for k, name in enumerate(names)}

    def anchors(batch):
        def items():
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_words(text)
                if i is None or len(words) < length:
                    continue
                hashes = window_hashes(words, width)
                places = _first_of_each(hashes, np.flatnonzero(cover[np.arange(len(hashes)) % PERIOD]))
                sequence = np.full(len(places), sequence_hash(words)[0])
                yield as_signed(hashes[places]), sequence, np.full(len(places), i), places.astype(np.int32)

        yield from _gathered(items(), ("hash", "sequence", "id", "place"))

    texts = materialised(map_rows(chosen, described, "id long, n long, seq_a long, seq_b long, sha string"), "texts")
    same = ["n", "seq_a", "seq_b"]
    first = texts.filter(f"n >= {length} AND id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("first"))
    first = materialised(first, "first")

    # one shuffle serves the grouping and the join: both sides use every column, so both plans of it are equal
    placed = map_rows(chosen, anchors, "hash long, sequence long, id long, place int")
    placed = placed.filter("hash IS NOT NULL AND id IS NOT NULL").repartition("hash")
    low, high = F.min("sequence").alias("low"), F.max("sequence").alias("high")
    shared = placed.groupBy("hash").agg(low, high, F.max("id").alias("top"), F.max("place").alias("far"))
    shared = shared.filter("low < high AND top IS NOT NULL AND far >= 0").select("hash", "low", "high")
    hits = placed.join(shared, "hash").filter("sequence <> low OR sequence <> high").select("id", "place")
    hits = hits.groupBy("id").agg(F.collect_set("place").alias("places"))
    hits = hits.join(first.select(F.col("first").alias("id")), "id")  # one row per id; a semi join would be moved below the shuffle
    found = materialised(chosen.join(hits, "id"), "found")

    def windows(batch):
        def items():
            for i, text, at in zip(*(batch.column(k) for k in range(3))):
                words = split_words(text.as_py())
                hashes = window_hashes(words, length)
                reach = np.zeros(len(hashes) + length, np.int64)  # an anchor lies in windows that start up to period - 1 earlier
                anchor = window_hashes(words, width)
                places = np.flatnonzero(np.isin(anchor, anchor[at.values.to_numpy()]))
                np.add.at(reach, np.maximum(places - (PERIOD - 1), 0), 1)
                np.add.at(reach, places + 1, -1)
                starts = _first_of_each(hashes, np.flatnonzero(np.cumsum(reach[: len(hashes)]) > 0))
                yield as_signed(mix(hashes[starts])), np.full(len(starts), i.as_py()), starts.astype(np.int32)

        yield from _gathered(items(), ("hash", "id", "start"))

    spread = map_rows(found.select("id", "text", "places"), windows, "hash long, id long, start int")
    spread = spread.filter("hash IS NOT NULL AND id IS NOT NULL").repartition("hash")
    earliest = spread.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("start").alias("far"))
    earliest = earliest.filter("low < high AND far >= 0").select("hash", "low")
    later = spread.join(earliest, "hash").filter("id > low").select("id", "start")
    later = later.groupBy("id").agg(F.collect_set("start").alias("starts"))

    def cut(batch):
        rows = []
        for i, text, starts in zip(*(batch.column(k) for k in range(3))):
            words = split_words(text.as_py())
            hashes = window_hashes(words, length)
            every = np.flatnonzero(np.isin(hashes, hashes[starts.values.to_numpy()]))
            gone = covered_words(every, len(words), length)
            rows.append((i.as_py(), int(gone.sum()), _digest([w for w, g in zip(words, gone) if not g])))
        yield {name: [r[k] for r in rows] for k, name in enumerate(("id", "removed", "left_sha"))}

    cuts = map_rows(found.select("id", "text").join(later, "id"), cut, "id long, removed long, left_sha string")
    cuts = cuts.groupBy("id").agg(F.max("removed").alias("removed"), F.min("left_sha").alias("left_sha"))
    out = texts.join(first, same, "left").join(cuts, "id", "left")
    copy = F.col("first") < F.col("id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )
