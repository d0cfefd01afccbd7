"""Words and rolling hashes of texts, for Spark expressions and for Python inside tasks.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage
return. ``bytes.split()`` cuts UTF-8 at the same six bytes, and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 100_000  # a very long text is hashed in pieces of so many words
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def words_of(text: Column) -> Column:
    """The words of a text as an array, with built-in functions only (null text: no words)."""
    return F.array_remove(pieces_of(text), "")


def pieces_of(text: Column) -> Column:
    """The words and, where separators follow each other or stand at an end, empty strings.

    The six separators become blanks first, because a split at one plain character needs no regular
    expression.
    """
    flat = F.coalesce(text, F.lit(""))
    for separator in "\t\n\x0b\f\r":
        flat = F.replace(flat, F.lit(separator), F.lit(" "))
    return F.split(flat, " ")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of one text as UTF-8 (null: none). Lone surrogates survive."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents 0 to n - 1."""
    if len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_block(words: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], blanks + 1))[: len(words) - width + 1]
    ends = np.concatenate((blanks, [len(data)]))[width - 1 :]
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash for every run of ``width`` words, by the place where it starts.

    The hash is a polynomial in the bytes of the run (words joined by one blank), so it depends on
    nothing outside the run; all runs come from one pass of prefix sums.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if n <= BLOCK_WORDS:
        return _hash_block(words, width)
    pieces = range(0, n, BLOCK_WORDS)
    return np.concatenate([_hash_block(words[i : min(i + BLOCK_WORDS, n) + width - 1], width) for i in pieces])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = split_words(text, lower=True)
    return np.unique(window_hashes(words, min(width, len(words)))) if words else np.empty(0, np.uint64)


def as_signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def sequence_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a whole word sequence, as two signed numbers."""
    import hashlib

    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts (one ``column``) have about ``size`` bytes, one text at least."""
    import pyarrow.compute as pc

    through = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    ends = np.flatnonzero(np.diff(through // size)) + 1
    for start, end in zip([0, *ends.tolist()], [*ends.tolist(), len(batch)]):
        if start < end:
            yield batch.slice(start, end - start)


def map_rows(df: DataFrame, function, schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it yields dicts of columns in the order of ``schema``.

    The rows of one batch may give any number of output batches, so output memory stays bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                arrays = [pa.array(columns[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
