"""Ranked search, nearest neighbours and token alignment against brute force."""

import bisect
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notecode.llm import alignment, neighbours, ranked

CLASH = ["uid", "id", "n", "terms", "counts", "shard", "item", "class", "least", "v", "chunk", "pair", "tf", "place", "key", "Rank"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# ---- op11


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, k):
    made = [(i, collections.Counter(terms(t))) for i, t in docs]
    filled, length = sum(bool(c) for _, c in made), sum(sum(c.values()) for _, c in made)
    df = collections.Counter(t for _, c in made for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in made:
            m = 100 - 90 + 90 * sum(c.values()) * filled // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, -(10**18) if doc is None else doc, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def searched_rows(seed, n=150):
    rng = random.Random(seed)
    vocab = ["The", "und", "naïve", "x1", "Ünder", "日本"] + [f"w{k}" for k in range(40)]
    weight = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda size: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocab, weight, k=size))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(n)]
    docs += [(500 + k, docs[3][1]) for k in range(15)] + [docs[5], docs[5], (900, None), (901, ""), (902, " .,\t\x00"), (None, docs[7][1])]
    docs += [(950, text(5000)), (951, "the " * 3000)]
    items = [(k, text(rng.randrange(1, 12))) for k in range(12)] + [(50, None), (51, ""), (52, "absent zzz"), (53, docs[3][1]), (53, "The THE the"), (None, "und")]
    return docs, items


@pytest.mark.parametrize("shard", [200, 100_000])
def test_search_against_brute_force(spark, shard):
    docs, items = searched_rows(shard)
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    i = clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = ranked.search(d, i, shard=shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_search(docs, items, 10)
    assert [(i, r, s) for i, r, _, s in got] == [(i, r, s) for i, r, _, s in want]
    assert got == want


def test_search_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ranked.search(d, i).count() == 0
    assert ranked.search(some, i.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(some, i).collect()] == [(1, 1, 1)]  # ln(4/3) is above 0


def test_reads_stop_before_the_lists_end():
    """The best documents are decided without the tails of long lists, and are still exact."""
    rng = np.random.default_rng(2)
    size = 20_000
    lists, total = [], np.zeros(size, np.int64)
    for _ in range(4):
        docs = rng.permutation(size)[: size // 2]
        impact = np.sort((rng.pareto(1.2, len(docs)) * 1000).astype(np.int64) + 1)[::-1]
        lists.append((docs, impact))
        total[docs] += impact
    top = rng.permutation(size)[:10]  # documents that lead all lists
    lists = [(np.concatenate([top, d[~np.isin(d, top)]]), np.concatenate([np.full(10, i.max() * 2), i[~np.isin(d, top)]])) for d, i in lists]
    found, score, read = ranked.resolved(lists, np.arange(size), 10)
    assert sorted(found.tolist()) == sorted(top.tolist()) and read < size // 4
    exact = sum(int(i[0]) for _, i in lists)
    assert score.tolist() == [exact] * 10 and found.tolist() == sorted(top.tolist())


# ---- op12


def product(left, right):
    total = 0.0
    for a, b in zip(left, right):  # sum() would compensate its rounding
        total += a * b
    return total


def brute_nearest(vectors, queries, k):
    usable = lambda v: v is not None and len(v) and None not in v and all(math.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(np.float32(v).tolist())) for i, v in vectors if i is not None and usable(v)})
    out = []
    for q, v in sorted({(i, tuple(np.float32(v).tolist())) for i, v in queries if i is not None and usable(v)}):
        scored = [(-product(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def messy_vectors(n=300, dims=12):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=dims) * rng.choice([0.5, 1, 3])).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[7][1]) for k in range(60)]  # a group of copies larger than k
    rows += [(2000, None), (2001, []), (2002, [0.0] * dims), (2003, [None] + [1.0] * (dims - 1)), (2004, [float("nan")] * dims), (2005, [float("inf")] * dims)]
    rows += [(None, rows[1][1]), (2006, [1.0, 2.0]), (2007, [-1.0, 0.5]), (2020, [0.5, -0.0]), rows[20], rows[20]]
    return rows


def test_nearest_against_brute_force(spark):
    """With one bucket the search is exact, ties, copies and all."""
    rows = messy_vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), piece=50)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute_nearest(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_probes_find_the_neighbours(spark):
    """With many buckets, crowded ones in pieces, recall stays above nine tenths and scores are exact."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32)) * rng.choice([1, 1.5], size=(4000, 1))
    x[1000:1800] = x[1] + rng.normal(size=(800, 32)) * 1e-3  # a crowd
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), bucket=40, piece=100).collect()
    want = brute_nearest(rows, rows[::20], 20)
    kept = {(q, v): s for q, _, v, s in want}
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert len(got) == len(want) == 4000
    assert len(kept.keys() & found.keys()) >= 0.9 * len(kept)
    assert all(found[p] == kept[p] for p in kept.keys() & found.keys())


def test_pseudo_rotation_keeps_angles():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    y = neighbours.rotated(x, (3, 1))
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(x, y)
    assert np.prod([2 * a for a in neighbours.axes_needed(10**9, 128, 400)]) * 400 >= 10**9
    keys = neighbours.keys_of(y, 0, [64, 5], 16)
    nearest = neighbours.keys_of(y, 0, [64, 5], 1)
    assert (keys[:, :1] == nearest).all() and all(len(set(k)) == 16 for k in keys.tolist())


# ---- op13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")
    alphabet = alignment.byte_alphabet()
    made, counts = [], collections.Counter()
    for doc, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text, num_threads=1) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            made.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0] + ends[:-1], ends)))
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((ids_a[i], ids_b[m]))
                m += 1
        counts.update(links)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [(cut, [], []) for cut in cuts]
        for side, ids in ((0, ids_a), (1, ids_b)):
            for k, (_, e) in zip(ids, spans[side]):
                groups[bisect.bisect_left(cuts, e)][1 + side].append(k)
        made.append((doc, ids_a, ids_b, groups, links))
    best = collections.Counter()
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc, ids_a, ids_b, groups, links in made:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in groups)
        out.append(
            (doc, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links))
            + (hashlib.sha256(written.encode()).hexdigest() if links else "",)
        )
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(6)
    syllables = ["the", "ing", "Über", "日本", "naïve", "x1", "don't", "--", "é", "\U0001f600", "12345", "café's", "_", "​", "ß"]
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " ", " \n ", "\r\n", "　", "\x1c", "   "]
    texts = []
    for k in range(120):
        texts.append("".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) + rng.choice(spaces if k % 2 else [" "]) for _ in range(rng.randrange(1, 40))))
    texts += ["", None, " ", "  ", " x", "x ", "\n", "a", "▁", "a ▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "\x00 \x01", "y" * 3000, "no break " * 2000]
    return texts + [texts[4]] * 3


def test_alignment_against_brute_force(spark):
    rows = [(None if k == 9 else k // 2, t) for k, t in enumerate(odd_texts())]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = brute_alignment(rows)
    for chunk in (300, alignment.CHUNK):
        found = alignment.align(df, chunk=chunk)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert alignment.align(df.limit(0)).count() == 0
    assert {r["n_links"] for r in alignment.align(df.filter("text = ''")).collect()} == {0}


def test_alignment_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in alignment.align(docs).collect()), key=repr) == brute_alignment([tuple(r) for r in docs.collect()])


def test_units_are_forgotten_and_learned_again(monkeypatch):
    known = alignment.known_units(f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model")
    assert known.words.by_units
    units = [u for t in odd_texts() if t for u in alignment.units_of(t)]
    numbers = known.numbers([units])[0]
    first = known.stats[numbers].tolist()
    monkeypatch.setattr(alignment, "UNITS", 0)
    numbers = known.numbers([units[:50], [], units])
    assert len(numbers[1]) == 0 and known.stats[numbers[2]].tolist() == first
    assert [" " + " ".join(alignment.units_of(t)) for t in odd_texts() if t] == [" " + t for t in odd_texts() if t]


def test_ranks_equal_the_merges():
    """The fast byte-level encoder gives what the vocabulary's own library gives."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    words = alignment.known_units(f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model").words
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x1FFFF), 32, 10])) for _ in range(rng.randrange(1, 30)))
        assert words.encode_a(text) == whole.encode(text, add_special_tokens=False).ids, repr(text)
