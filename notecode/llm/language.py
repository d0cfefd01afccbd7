"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.session import materialised

LONGEST = 3  # letters of an n-gram
PROFILE = 400  # n-grams of a profile
CHUNK = 1 << 20  # characters counted at once
MAX_LANGUAGES = 5_000  # profiles travel to every task: 5,000 x 400 rows of 12 bytes at most
UNKNOWN = "und"
_BITS = 21  # of a code point; an n-gram is up to three code points in one number

_folded: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Every code point to its lower-case letter, or to a blank if it is none."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for code in range(0x110000):
            sign = chr(code)
            if sign.isalpha():
                low = sign.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _folded.append(table)
    return _folded[0]


def folded(text: str) -> np.ndarray:
    """Lower-case letters of a text, every run of other characters as one blank, a blank at each end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([32], _letters()[raw], [32])).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def count_ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to ``LONGEST`` signs that hold a letter, and their counts.

    Blanks inside an n-gram would span two words, so they may stand at its ends only. A long text is
    counted in overlapping pieces, so memory does not grow with it.
    """
    grams: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for i in range(0, max(1, len(codes)), CHUNK):
        part = codes[i : i + CHUNK + LONGEST - 1]
        alphabet, dense = np.unique(part, return_inverse=True)
        m = len(alphabet)
        for n in range(1, LONGEST + 1):
            size = min(CHUNK, len(part) - n + 1, len(codes) - i - n + 1)
            if size <= 0:
                continue
            code = dense[:size].astype(np.int64)
            for k in range(1, n):
                code = code * m + dense[k : k + size]
            if m**n <= max(4096, 2 * size):
                tally = np.bincount(code, minlength=m**n)
                found = np.flatnonzero(tally)
                tally = tally[found]
            else:
                found, tally = np.unique(code, return_counts=True)
            signs = []
            for _ in range(n):
                signs.append(alphabet[found % m])
                found = found // m
            signs.reverse()
            fine = np.ones(len(tally), bool)
            if n == 1:
                fine = signs[0] != 32
            elif n == 2:
                fine = (signs[0] != 32) | (signs[1] != 32)
            else:
                fine = signs[1] != 32
            packed = np.zeros(len(tally), np.int64)
            for sign in signs:
                packed = (packed << _BITS) | sign
            grams.append(packed[fine])
            counts.append(tally[fine])
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, where = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first; equal counts by code points."""
    return keys[np.lexsort((keys, -counts))[:size]]


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, gram, place)``: the ``size`` most frequent n-grams of all texts of each language.

    Every task adds its own counts up before the shuffle. Rows with null text or language are ignored.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, texts: list[str]) -> None:
            keys, counts = count_ngrams(folded("\n".join(texts)))
            if lang in totals:
                keys = np.concatenate((totals[lang][0], keys))
                counts = np.concatenate((totals[lang][1], counts))
                keys, where = np.unique(keys, return_inverse=True)
                counts = np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)
            totals[lang] = (keys, counts)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, (keys, counts) in totals.items():
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})
            totals.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                held, chars = [], 0
                for text in texts:
                    held.append(text)
                    chars += len(text)
                    if chars >= CHUNK:
                        add(lang, held)
                        held, chars = [], 0
                if held:
                    add(lang, held)
            if sum(len(k) for k, _ in totals.values()) > 500_000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = rows.dropna().mapInPandas(count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("place", place - 1).filter(F.col("place") < size).select("lang", "gram", "place")


class OutOfPlace:
    """Distance of a text's ranked n-grams to each language profile."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        table = np.array([(r[1], at[r[0]], r[2]) for r in rows], np.int64).reshape(-1, 3)
        self.grams = np.unique(table[:, 0])
        self.places = np.full((len(self.langs), len(self.grams)), -1, np.int32)
        self.places[table[:, 1], np.searchsorted(self.grams, table[:, 0])] = table[:, 2]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and score of ``search``."""
        return self.search(text)[:2]

    def search(self, text: str | None) -> tuple[str, float, bool]:
        """Nearest language and a score from 0 to 1; ``und`` and 0 for a text without letters.

        An n-gram costs the number of places it stands from its place in the profile, or the profile's
        size if it is not there. The score is the relative lead over the second language, 0 if no
        n-gram is known anywhere; equal distances go to the first language by name. Last, whether any n-gram
        is known.
        """
        if not text or not self.langs:
            return UNKNOWN, 0.0, False
        top = ranked(*count_ngrams(folded(text)), self.size)
        if not len(top):
            return UNKNOWN, 0.0, False
        where = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[where] == top
        places = self.places[:, where]
        cost = np.where(known & (places >= 0), np.abs(places - np.arange(len(top))), self.size)
        total = cost.sum(axis=1) / (self.size * len(top))
        best = int(np.argmin(total))
        if not known.any():
            return self.langs[best], 0.0, False
        if len(total) == 1:
            return self.langs[0], float(1 - total[0]), True
        second = float(np.delete(total, best).min())
        return self.langs[best], (second - float(total[best])) / second if second > 0 else 0.0, True


def learn(rows: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """Profiles as rows for every task: ``size`` entries for each of at most ``MAX_LANGUAGES`` languages."""
    table = materialised(profiles(rows, size=size), "profiles")
    languages = table.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; profiles are sent to all tasks, so at most {MAX_LANGUAGES}")
    return [tuple(r) for r in table.collect()]


def identify(docs: DataFrame, rows: list[tuple[str, int, int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, flag: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each input row, by the profiles that ``learn`` gave.

    With ``flag`` a column ``known`` says whether any n-gram of the text is in a profile.

    Null, empty and letterless texts get ``und`` and score 0, so does everything if nothing was
    learned. Whole texts count. Repeated rows give repeated results; null ids are kept; other columns
    are ignored.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("known", T.BooleanType())] * flag
    )
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        model = OutOfPlace(sent.value, size)
        for batch in batches:
            found = [model.search(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            columns += [pa.array([f[2] for f in found], pa.bool_())] * flag
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(predict, schema)


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id, written as text, leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
