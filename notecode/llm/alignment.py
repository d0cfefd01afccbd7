"""Cross-tokenizer alignment of a byte-level vocabulary A with a piece vocabulary B.

A blank between two characters that are no white space always starts a token of either vocabulary, so a
text falls into units (a blank and what follows it) that are encoded alone and remembered; groups, links and counts of a text are sums over its units.

Most groups are one A token and one B token of the same bytes. Which B id has the bytes of an A id is
known beforehand (the identity map), so these are counted in a vector with one place for each A id.
Only the other links become pairs of ids that are shuffled, summed and joined back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import map_rows, slices
from notecode.session import materialised

FOLDER = "/opt/tokenizers"  # the same folder on every machine
CHUNK = 1 << 19  # bytes of the texts that share one row of links
UNITS = 100_000  # units that a Python worker remembers
SLICE = 16 << 10  # characters encoded at once
#: How byte-level vocabularies cut a text before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both encoders, the bytes of their tokens and the identity map from A to B (-1: no such B token)."""

    def __init__(self, file_a: str, file_b: str) -> None:
        import sentencepiece

        with open(file_a, encoding="utf-8") as file:
            content = json.load(file)
        self.encode_a = self._byte_level(file_a, content)
        pieces = sentencepiece.SentencePieceProcessor(model_file=file_b)
        self.encode_b = lambda text: pieces.encode(text, num_threads=1)
        alphabet = byte_alphabet()
        named = content["model"]["vocab"] | {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.a = [b""] * (1 + max(named.values()))
        for name, k in named.items():
            self.a[k] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        count = pieces.get_piece_size()
        plain = [pieces.id_to_piece(k) for k in range(count)]
        self.b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(plain)]
        of_bytes = {self.b[k]: k for k in reversed(range(count)) if not pieces.is_byte(k)}
        of_bytes = {self.b[k]: k for k in range(count) if pieces.is_byte(k)} | of_bytes
        self.identity = np.array([of_bytes.get(x, -1) if x else -1 for x in self.a], np.int64)
        self.length_a = np.array([len(x) for x in self.a], np.int64)
        self.length_b = np.array([len(x) for x in self.b], np.int64)
        normal = content.get("normalizer") is None and (content.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        # units may be encoded alone if neither vocabulary has a token over a blank that starts one
        self.by_units = normal and not any(re.search("[^▁]▁", p) for k, p in enumerate(plain) if pieces.is_control(k) is False)
        sign = lambda ids, end: np.array([b"%d" % k + end for k in range(ids)], object)
        self.text_a = np.concatenate([sign(len(self.a), b","), sign(len(self.a), b"|")])
        self.text_b = np.concatenate([sign(count, b","), sign(count, b";")])

    @staticmethod
    def _byte_level(file: str, content: dict):
        """An encoder of ``file``: by ranks if its merges are in the order of their ids (several times as fast), else as it is."""
        vocab, merges = content["model"]["vocab"], content["model"]["merges"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        cut = content.get("pre_tokenizer") or {}
        if [vocab.get(m) for m in merged] == list(range(256, 256 + len(merged))) and cut.get("type") == "ByteLevel" and cut.get("use_regex", True):
            import tiktoken

            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in name): k for name, k in vocab.items() if k < 256 + len(merged)}
            encoder = tiktoken.Encoding(os.path.basename(file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return encoder.encode_ordinary
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(file)
        whole.encode_special_tokens = True
        return lambda text: whole.encode(text, add_special_tokens=False).ids


def units_of(text: str) -> list[str]:
    """The units of blank + ``text``, each without the blank it starts with."""
    parts = _CUT.split(" " + text)
    parts[0] = parts[0][1:]
    return parts


class Units:
    """What is known of the units met so far: counts, groups as text, and links as ranges of ``fast`` and ``pairs``."""

    def __init__(self, words: Vocabularies) -> None:
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.used = np.empty(0, np.int64)
        self.groups: list[bytes] = []
        self.stats = np.empty((0, 6), np.int64)  # A and B tokens, groups, links, whether it cannot be encoded, white space at an end
        self.fast_ends, self.fast = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.pair_ends, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.pair_names, self.sorted_names = np.empty(0, np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))

    def forget(self) -> None:
        """Keep what was met twice since the last time, at most half of what may be remembered."""
        kept = np.flatnonzero(self.used > 1)
        kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: UNITS // 2]])
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.groups = [self.groups[k] for k in kept.tolist()]
        self.stats, self.used = self.stats[kept], np.zeros(len(kept), np.int64)
        for name, ends in (("fast", "fast_ends"), ("pairs", "pair_ends")):
            at, size = _ranges(getattr(self, ends), kept)
            setattr(self, name, getattr(self, name)[at])
            setattr(self, ends, np.concatenate([[0], np.cumsum(size)]))
        if len(self.pair_names) > UNITS:
            self.clear()

    def _pair_numbers(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of irregular pairs; ``pair_names`` has the pair of each number."""
        names, inverse = np.unique(pairs, return_inverse=True)
        known, numbers = self.sorted_names
        at = np.searchsorted(known, names)
        old = np.zeros(len(names), bool)
        inside = at < len(known)
        old[inside] = known[at[inside]] == names[inside]
        found = np.empty(len(names), np.int64)
        found[old] = numbers[at[old]]
        found[~old] = len(self.pair_names) + np.arange((~old).sum())
        self.pair_names = np.concatenate([self.pair_names, names[~old]])
        self.sorted_names = np.insert(known, at[~old], names[~old]), np.insert(numbers, at[~old], found[~old])
        return found[inverse]

    def _encoded(self, units: list[str]) -> list[tuple[list[str], list[int], list[int]]]:
        """Runs of units with the ids of both encoders; a unit whose bytes do not come back has none."""
        text = " ".join(units)
        a, b = self.words.encode_a(" " + text), self.words.encode_b(text)
        raw = (" " + text).encode()
        if b"".join(map(self.words.b.__getitem__, b)) == raw and int(self.words.length_a[a].sum()) == len(raw):
            return [(units, a, b)]
        if len(units) == 1:
            return [(units, [], [])]
        half = len(units) // 2
        return self._encoded(units[:half]) + self._encoded(units[half:])

    def learn(self, new: list[str]) -> None:
        """Encode units, many at once where white space at an end of one cannot meet the next."""
        alone = [u for u in new if not u or u.strip() != u]
        runs = [x for u in alone for x in self._encoded([u])]
        if alone:
            apart = set(alone)
            new = [u for u in new if u not in apart]
        cuts = np.cumsum([len(u) + 1 for u in new]) // SLICE
        starts = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(new)]
        runs += [x for i, j in zip(starts, starts[1:]) if i < j for x in self._encoded(new[i:j])]
        for run, _, _ in runs:
            self.place.update(zip(run, range(len(self.place), len(self.place) + len(run))))
        good = np.repeat([bool(a) for _, a, _ in runs], [len(run) for run, _, _ in runs])
        edge = np.arange(len(good)) < len(alone)
        size = np.array([len(u.encode()) + 1 for run, _, _ in runs for u in run], np.int64)
        ids_a = np.concatenate([np.array(a, np.int64) for _, a, _ in runs])
        ids_b = np.concatenate([np.array(b, np.int64) for _, _, b in runs])
        self._add(good, edge, np.cumsum(size[good]), ids_a, ids_b)

    def _add(self, good: np.ndarray, edge: np.ndarray, unit_ends: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        words, count = self.words, len(good)
        ends_a, ends_b = np.cumsum(words.length_a[ids_a]), np.cumsum(words.length_b[ids_b])
        mark = np.zeros(1 + (ends_a[-1] if len(ends_a) else 0), np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        mark[unit_ends] += 4
        cuts = np.flatnonzero(mark)  # a link ends at each of them
        is_a, is_b, common, is_unit = (mark[cuts] & 1) > 0, (mark[cuts] & 2) > 0, (mark[cuts] & 3) == 3, mark[cuts] >= 4
        through_a, through_b, through_group = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(common)
        at_a, at_b, group = through_a - is_a, through_b - is_b, through_group - common
        of_unit = np.flatnonzero(good)[np.cumsum(is_unit) - is_unit]
        link_a, link_b = ids_a[at_a], ids_b[at_b]
        single = common & (words.length_a[link_a] == words.length_b[link_b])
        fast = single & (words.identity[link_a] == link_b)
        per = [np.bincount(of_unit[chosen], minlength=count) for chosen in (is_a, is_b, common, cuts > 0)]
        self.stats = np.concatenate([self.stats, np.stack([*per, ~good, edge], axis=1)])
        for kind, chosen, values in (("fast", fast, link_a), ("pair", ~fast, (link_a << 32) | link_b)):
            name, ends = "fast" if kind == "fast" else "pairs", getattr(self, f"{kind}_ends")
            values = values[chosen] if kind == "fast" else self._pair_numbers(values[chosen])
            setattr(self, name, np.concatenate([getattr(self, name), values]))
            more = np.cumsum(np.bincount(of_unit[chosen], minlength=count))
            setattr(self, f"{kind}_ends", np.concatenate([ends, ends[-1] + more]))
        # tokens in the order of groups, A before B, each with what follows it
        group_a, group_b = group[is_a], group[is_b]
        before_b = np.concatenate([[0], through_b[common]])  # B tokens of earlier groups
        place_a = np.arange(len(ids_a)) + before_b[group_a]
        place_b = np.arange(len(ids_b)) + through_a[common][group_b]
        written = np.empty(len(ids_a) + len(ids_b), object)
        written[place_a] = words.text_a[ids_a + common[is_a] * len(words.a)]
        written[place_b] = words.text_b[ids_b + common[is_b] * len(words.b)]
        written = written.tolist()
        ends = np.cumsum(per[0] + per[1]).tolist()
        self.groups += [b"".join(written[i:j])[:-1] for i, j in zip([0, *ends], ends)]

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the units of each text; unknown ones are learned first."""
        if len(self.place) > UNITS:
            self.forget()
        units = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            unknown = [units[k] for k in missing]
            self.learn(list(dict.fromkeys(unknown)))
            found[missing] = np.fromiter(map(self.place.__getitem__, unknown), np.int64, len(unknown))
        self.used = np.concatenate([self.used, np.zeros(len(self.stats) - len(self.used), np.int64)])
        self.used += np.bincount(found, minlength=len(self.used))
        return np.split(found, np.cumsum([len(x) for x in texts])[:-1])


@lru_cache(maxsize=1)
def known_units(file_a: str, file_b: str) -> Units:
    """The units of this Python worker, which its next tasks find again."""
    return Units(Vocabularies(file_a, file_b))


def _ranges(ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places within the ranges of ``chosen``, one after the other, and the length of each range."""
    start, size = ends[chosen], ends[chosen + 1] - ends[chosen]
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size), size


def _counted(values: np.ndarray, count: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For numbers below ``count``: the sums of those that occur, which those are, and the place of each value among them."""
    sums = np.bincount(values, weight, count).astype(np.int64)
    used = np.flatnonzero(sums)
    place = np.empty(count, np.int64)
    place[used] = np.arange(len(used))
    return sums[used], used, place[values]


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each, after a byte that says how many these are."""
    values = np.asarray(values, np.int64)
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * n) - (n == 8))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_DOCS = "doc_ids array<long>, stats array<long>, groups array<string>"
_LINKS = "unit_counts binary, units binary, pair_sizes binary, pair_at binary, fast_sizes binary, fast binary"
_COUNTS = "pairs array<long>, pair_counts array<long>, fast_ids array<long>, fast_counts array<long>"


def encoded(docs: DataFrame, id_col: str, text_col: str, file_a: str, file_b: str, chunk: int) -> DataFrame:
    """One row for about ``chunk`` bytes of texts: their figures, their units, and the links of those units.

    ``stats`` are four numbers for each text. ``units`` number the distinct units of the row (packed);
    ``pair_at`` points into the distinct irregular ``pairs``, ``fast`` holds A ids of the identity map.
    """

    def run(batch):
        known = known_units(file_a, file_b)
        for part in slices(batch, 1, chunk):
            yield _chunk(known, part.column(0).to_pylist(), part.column(1).to_pylist())

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = map_rows(chosen, run, f"{_DOCS}, {_LINKS}, {_COUNTS}")
    return rows.withColumn("chunk", F.monotonically_increasing_id())


def _chunk(known: Units, ids: list, texts: list[str | None]) -> dict:
    words = known.words
    units = [(t.split(" ") if words.by_units else [t]) if t else [] for t in texts]
    numbers = known.numbers(units)
    if words.by_units:  # a blank beside other white space starts no token: such texts are cut with care
        odd = [k for k, x in enumerate(numbers) if known.stats[x, 5].any()]
        if odd:
            for k in odd:
                units[k] = units_of(texts[k])
            numbers = known.numbers(units)
    stats = [known.stats[x].sum(axis=0) for x in numbers]
    numbers = [x[:0] if s[4] else x for x, s in zip(numbers, stats)]
    stats = [s[:4] * (s[4] == 0) for s in stats]
    groups = [hashlib.sha256(b";".join(map(known.groups.__getitem__, x.tolist()))).hexdigest() if len(x) else "" for x in numbers]
    weight, used, local = _counted(np.concatenate(numbers), len(known.stats))
    at, size = _ranges(known.pair_ends, used)
    pair_counts, pairs, pair_at = _counted(known.pairs[at], len(known.pair_names), np.repeat(weight, size))
    at, fast_size = _ranges(known.fast_ends, used)
    fast = known.fast[at]
    vector = np.bincount(fast, np.repeat(weight, fast_size), len(words.a)).astype(np.int64)  # a place for each A id
    fast_ids = np.flatnonzero(vector)
    columns = {
        "doc_ids": ids,
        "stats": np.concatenate(stats),
        "groups": groups,
        "unit_counts": _packed([len(x) for x in numbers]),
        "units": _packed(local),
        "pair_sizes": _packed(size),
        "pair_at": _packed(pair_at),
        "fast_sizes": _packed(fast_size),
        "fast": _packed(fast),
        "pairs": known.pair_names[pairs],
        "pair_counts": pair_counts,
        "fast_ids": (fast_ids << 32) | words.identity[fast_ids],
        "fast_counts": vector[fast_ids],
    }
    return {name: [value] for name, value in columns.items()}


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_a: str = f"{FOLDER}/byte_bpe_50k.json",
    file_b: str = f"{FOLDER}/piece_bpe_32k.model",
    chunk: int = CHUNK,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row for each input row.

    Blank + text is encoded by the byte-level vocabulary ``file_a``, the text by the pieces of ``file_b``
    (which puts the blank before it), both without special tokens. Where tokens of both end, a group
    ends. A link is an A and a B occurrence whose bytes overlap; the count of two ids is how many links
    of the corpus join them. ``count_sum`` sums the counts of the text's links, ``n_best`` counts those
    whose count is the largest of their B id, and ``groups_sha256`` digests the groups' ids.

    Null and empty texts, and those whose bytes do not come back from both encoders, have no tokens:
    zeros and an empty digest. Ids may repeat or be null; every row has its own result. Other columns
    are ignored; an empty table gives no rows.

    Vectors with a place for each id of a vocabulary are the only data that pass through the driver. A
    text is never split, so the longest one must fit in a task.
    """
    rows = materialised(encoded(docs, id_col, text_col, file_a, file_b, chunk), "encoded")
    summed = lambda ids, counts: rows.select(F.explode(F.arrays_zip(ids, counts)).alias("x")).select(F.col(f"x.{ids}").alias("pair"), F.col(f"x.{counts}").alias("n"))
    fast = summed("fast_ids", "fast_counts").groupBy("pair").agg(F.sum("n").alias("n"))
    fast = materialised(fast, "fast")
    totals = summed("pairs", "pair_counts").union(fast).groupBy("pair").agg(F.sum("n").alias("total"))
    totals = materialised(totals, "totals")
    # no more rows than the vocabularies have ids
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("top")).toPandas()
    same = totals.join(fast.select("pair"), "pair").toPandas()
    top = np.zeros(int(best["b"].max()) + 1 if len(best) else 1, np.int64)
    top[best["b"].to_numpy(np.int64)] = best["top"].to_numpy(np.int64)
    pair = same["pair"].to_numpy(np.int64)
    a, b, n = pair >> 32, pair & 0xFFFFFFFF, same["total"].to_numpy(np.int64)
    of_fast, fast_best = np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64), np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64)
    of_fast[a], fast_best[a] = n, n == top[b]

    wanted = rows.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(totals, "pair").select(F.col("chunk").alias("of_chunk"), "at", "pair", "total")
    kept = rows.select("chunk", *[c.split()[0] for c in f"{_DOCS}, {_LINKS}".split(", ")])

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("at").to_numpy(), kind="stable")
        pairs, total = right.column("pair").to_numpy()[order], right.column("total").to_numpy()[order]
        row = {name: left.column(name).combine_chunks().flatten() for name in ("doc_ids", "stats", "groups")}
        value = {name.split()[0]: _unpacked(left.column(name.split()[0])[0].as_py()) for name in _LINKS.split(", ")}
        is_best = (total == top[pairs & 0xFFFFFFFF]).astype(np.int64)

        def summed_by(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
            through = np.concatenate([[0], np.cumsum(values)])
            return np.diff(through[np.concatenate([[0], np.cumsum(sizes)])])

        at, fast_at, units = value["pair_at"], value["fast"], value["units"]
        sums = summed_by(value["pair_sizes"], total[at]) + summed_by(value["fast_sizes"], of_fast[fast_at])
        bests = summed_by(value["pair_sizes"], is_best[at]) + summed_by(value["fast_sizes"], fast_best[fast_at])
        stats = row["stats"].to_numpy(zero_copy_only=False).reshape(-1, 4)
        columns = {"doc_id": row["doc_ids"], "n_a": stats[:, 0], "n_b": stats[:, 1], "n_groups": stats[:, 2], "n_links": stats[:, 3]}
        columns |= {"n_best": summed_by(value["unit_counts"], bests[units]), "count_sum": summed_by(value["unit_counts"], sums[units])}
        columns["groups_sha256"] = row["groups"]
        return pa.table(columns)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return kept.groupBy("chunk").cogroup(wanted.groupBy("of_chunk")).applyInArrow(finished, schema)
