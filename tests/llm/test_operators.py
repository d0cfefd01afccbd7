"""The ten operators against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notecode.llm import chat, decontamination, exact, language, lines, mixing, near, pii, quality, substrings, texts
from notecode.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["id", "n", "doc", "line", "words", "key", "hash", "component", "text_a", "first", "a", "b", "copies", "grades", "copy"]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return WORD.findall(text)


def table(spark, rows, clash=True):
    """documents(doc_id, text, source) and, if wanted, columns named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


def messy(seed=1, n=60, vocabulary=30, longest=120):
    """Documents with exact and near copies, repeated rows, nulls, empty and blank texts."""
    rng = random.Random(seed)
    vocab = [f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(vocabulary)]
    rows = []
    for k in range(n):
        made = [rng.choice(vocab) for _ in range(rng.randrange(0, longest))]
        if rows and k % 3 == 0:
            made = words(rng.choice(rows)[1])
            if made and k % 2:
                made[rng.randrange(len(made))] = "changed"
        rows.append((k * 3 + 1, rng.choice([" ", "\n", "\t "]).join(made), f"s{k % 4}"))
    rows += [(1000, None, None), (1001, "", "s0"), (1002, " \n\t ", "s1"), (None, rows[3][1], "s2"), (None, None, None)]
    return rows + [rows[5], rows[5]]


def shingles(text, k=5):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


# ---- shared helpers


def test_window_hashes_depend_on_the_words_only(monkeypatch):
    rng = random.Random(3)
    made = [rng.choice([b"a", b"bb", "é".encode(), b"cc-d"]) for _ in range(400)]
    hashes = texts.window_hashes(made, 5)
    by_words = {}
    for i, h in enumerate(hashes.tolist()):
        assert by_words.setdefault(tuple(made[i : i + 5]), h) == h
    assert len(set(by_words.values())) == len(by_words)
    monkeypatch.setattr(texts, "BLOCK_WORDS", 7)
    assert (texts.window_hashes(made, 5) == hashes).all()
    assert len(texts.window_hashes(made[:4], 5)) == 0 and len(texts.window_hashes(made[:5], 5)) == 1


def test_words_of_splits_like_python(spark):
    odd = ["a b", "\ta\x0bb\x0c\rc\n", "a b c", None, "", "  ", "é\x1fx"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    got = dict(tuple(r) for r in df.select("k", texts.words_of(F.col("t"))).collect())
    assert [got[k] for k in range(len(odd))] == [words(t) for t in odd]
    assert [[w.decode() for w in texts.split_words(t)] for t in odd] == [words(t) for t in odd]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    pairs += [(500, 600 + k) for k in range(50)] + [(None, 3), (7, 7)]
    root = {}
    for a, b in pairs:
        if a is None:
            continue
        for x in (a, b):
            root.setdefault(x, x)
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: r for x, r in root.items() if x in got} and set(got) == {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 chat formatting

CHATS = [
    (1, 2, "assistant", "two"), (1, 1, "user", "one"), (1, 3, "assistant", "three <part> \\l"), (1, 4, "user", None),
    (2, 0, "sys>tem", "a </turn>\n<turn user>b"), (2, 1, "assistant", ""), (2, 2, "assistant", "\\b\\"), (2, 2, "assistant", "\\b\\"),
    (3, 0, "assistant", "only é𝄞"), (None, 1, "user", "x"), (None, 0, None, "y <turn "), (4, None, "user", "<turn user>"),
]


@pytest.mark.parametrize("chunk", [2, 512])
def test_chats_come_back(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    df = spark.createDataFrame(CHATS, "conv_id long, turn int, role string, text string").select("*", F.lit(1).alias("turns"), F.lit(2).alias("pieces"))
    chats = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(chats).collect()}
    assert set(back) == {1, 2, 3, 4, None}
    for conv, row in back.items():
        want = sorted((c for c in CHATS if c[0] == conv), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(c[2] or "", c[3] or "") for c in want]
        assert row["loss_text"] == "".join(c[3] or "" for c in want if c[2] == "assistant")
        assert row["n_blocks"] == len(list(itertools.groupby(c[2] or "" for c in want)))
    for row in chats.collect():
        spans = [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]]
        assert [s.replace("\\l", "<").replace("\\b", "\\") for s in spans] == [
            c[3] or "" for c in sorted((c for c in CHATS if c[0] == row["conv_id"]), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")) if c[2] == "assistant"
        ]
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- 2 personal data


def base_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in m.group() if d in "0123456789"]
            total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
            if low <= len(digits) <= high and (kind == "phone" or total % 10 == 0):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_rules():
    rng = random.Random(2)
    parts = ["+1 (988) 555-2485", "a.b@c.de", "10.0.0.256", "10.0.0.25.6", "4337166598464399", "4337-1665 9846-4399", "é@x", " ", "7", ".", "-", "x@y", "+", "(", "１"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))
        base, every = pii.find(text)
        assert base == base_spans(text), text
        assert set(base) <= set(every) and len(set(every)) == len(every)


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
        ("write jane at mail dot example dot com now", "email", "jane at mail dot example dot com"),
        ("é jоhn@mаil.example.com", "email", "jоhn@mаil.example.com"),
        ("ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ", "email", "ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ"),
        ("bob(at)mail(dot)com", "email", "bob(at)mail(dot)com"),
        ("host 55 [dot] 63 [dot] 178 [dot] 142.", "ip", "55 [dot] 63 [dot] 178 [dot] 142"),
        ("dial +four nine one two three four five six seven eight ok", "phone", "+four nine one two three four five six seven eight"),
        ("four three three seven one six six five nine eight four six four three nine nine", "card", None),
        ("card ４３３７１６６５９８４６４３９９ 4337-1665-9846-4399", "card", "４３３７１６６５９８４６４３９９"),
    ],
)
def test_disguises_are_found_where_they_stand(text, kind, found):
    base, every = pii.find(text)
    new = [(k, text[i:j]) for k, i, j in every if (k, i, j) not in base]
    assert new == [(kind, found or text)]


@pytest.mark.parametrize("text", ["I was at the house (at) noon. Dot com", "look at example.com and at home dot", "one two buckle my shoe", "un un café deux", "at dot at dot", ""])
def test_plain_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize(
    "text, kind",
    [
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("192 dot 168 dot zero dot one", "ip"),
        ("one nine 2 punkt 168 point zero dot one", "ip"),
        ("+1 555 zero one 0 4477", "phone"),
        ("four 337 166598464399", "card"),
    ],
)
def test_short_runs_of_spelled_digits_count(text, kind):
    base, every = pii.find(f"so {text}; and two more")
    assert (base, every) == ([], [(kind, 3, 3 + len(text))])


@pytest.mark.parametrize("address, plain", [("jоhn.doe@example.com", "hn.doe@example.com"), ("john@mail.exаmple.com", "john@mail.ex")])
def test_disguise_around_a_plain_address(spark, address, plain):
    text = f"to {address}, a@b.co"
    base, every = pii.find(text)
    assert [text[i:j] for _, i, j in base] == [plain, "a@b.co"]
    assert set(every) - set(base) == {("email", 3, 3 + len(address))}
    assert [r["text"] for r in pii.redact(table(spark, [(1, text, "s")])).collect()] == ["to <email>, <email>"]


def test_private_spans_of_a_table(spark):
    rows = [(1, "mail a@b.co", "s"), (1, "mail a@b.co", "s"), (None, "x (at) y.com", "s"), (3, None, "s"), (4, "", "s")]
    got = pii.private_spans(table(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, len(r["base"]), len(r["spans"])) for r in got) == [(0, 0, 1), (1, 1, 1), (1, 1, 1), (3, 0, 0), (4, 0, 0)]
    assert pii.private_spans(table(spark, [])).count() == 0
    assert {r["text"] for r in pii.redact(table(spark, rows)).collect()} == {"mail <email>", "<email>", None, ""}


# ---- 3 benchmark decontamination


def test_contaminated_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    made = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(made(rng.choice([3, 5, 6, 12, 30, 60, 200])))) for k in range(40)] + [(90, None), (91, ""), (None, " ".join(made(9)))]
    items += [items[3]]
    rows = []
    for k in range(60):
        w = made(rng.randrange(0, 900))
        for _ in range(rng.randrange(3)):
            got = words(rng.choice(items)[1])
            keep = rng.choice([1.0, 0.9, 0.6])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in got[: round(len(got) * keep)]]
        rows.append((k, " ".join(w), "s"))
    rows += [(200, None, "s"), (201, "", "s"), (None, items[3][1], "s"), rows[0]]
    want = set()
    by_doc = {d: shingles(t) if len(words(t)) >= 5 else set() for d, t, _ in rows if d is not None}
    for i, t in items:
        s = shingles(t) if len(words(t)) >= 5 else set()
        want |= {(d, i, len(s & x), len(s)) for d, x in by_doc.items() if s and i is not None and 100 * len(s & x) >= 75 * len(s)}
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("gram", F.lit(1))
    got = {tuple(r) for r in decontamination.contaminated(table(spark, rows), bench).collect()}
    assert got == want and len(want) > 10
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    assert decontamination.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_short_items_do_not_hang_on_their_minhash(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HASHES", 1)
    texts = [(k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(t.split()[:5])) for k, t in texts], "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert sorted(tuple(r) for r in got) == [(k, k, 1, 1) for k in range(60)]


# ---- 4 quality


def test_line_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, pair = rng.normal(size=n), rng.normal(size=(2, 2))
        weight, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s for s, y in zip(scores, path) if y) + sum(pair[a, b] for a, b in zip(path, path[1:])))
            weight += w
            good += w * np.array(path)
        assert np.allclose(quality.line_marginals(scores.tolist(), pair), good / weight)


def test_chain_gradient_against_differences():
    rng = np.random.default_rng(2)
    scores, labels, pair = rng.normal(size=(3, 4)), np.array([True, False, True]), rng.normal(size=(2, 2))
    _, good, pairs = quality._chain_gradient(scores, labels, pair)
    value = lambda s, p: quality._chain_gradient(s, labels, p)[0]
    for i, j in itertools.product(range(3), range(4)):
        step = np.zeros((3, 4))
        step[i, j] = 1e-5
        assert np.isclose((value(scores + step, pair) - value(scores - step, pair)) / 2e-5, labels[i] - good[i, j], atol=1e-5)
    seen = np.array([[3 * 1.0, 0], [0, 3 * 2.0]])
    for a, b in itertools.product(range(2), range(2)):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert np.isclose((value(scores, pair + step) - value(scores, pair - step)) / 2e-5, seen[a, b] - pairs[a, b], atol=1e-4)


def test_quality_learns_and_scores(spark):
    rng = random.Random(4)
    prose = lambda: "\n".join(" ".join(rng.choice(["the", "cat", "sat", "under", "old", "trees"]) for _ in range(9)).capitalize() + "." for _ in range(rng.randrange(1, 5)))
    junk = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "NOW###", "$$$", "WIN!!"]) for _ in range(9)) for _ in range(rng.randrange(1, 5)))
    rows = [(k, prose() if k % 2 else junk(), k % 2) for k in range(120)] + [(500, None, 0), (501, "", 0), (502, "x", None), (None, prose(), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(df, df.select("doc_id", "label"), rounds=40)
    docs = table(spark, [(d, t, "s") for d, t, _ in rows] + [(503, "\n \n", "s")])
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs, model).collect()]
    assert len(got) == len(rows) + 1 and all(0 <= s <= 1 for _, s in got)
    label = {d: y for d, _, y in rows}
    assert all((s >= 0.5) == bool(label[d]) for d, s in got if d is not None and d < 500)
    none = quality.learn(df, df.select("doc_id", "label").limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(table(spark, []), model).count() == 0


# ---- 5 mixing


@pytest.mark.parametrize("group_rows", [5, 50_000])
def test_mix_against_brute_force(spark, group_rows):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), rng.choice(["a", "a", "a", "b", "c", "Ä", None])) for k in range(150)]
    rows += [(500, None, "a"), (501, "w w", "z"), (502, "", "empty"), (503, None, "void")]
    got = mixing.mix_sources(table(spark, rows), group_rows=group_rows).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # deal out by weight, cap, deal out the rest again
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    queue = []
    for s in order:
        sent = 0
        for again in (0, 1):
            for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
                sent += len(words(t))
                if words(t):
                    queue.append((sent / target[s], hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, again, len(words(t))))
    total, taken = 0, collections.Counter()
    for _, _, d, _, n in sorted(queue):
        total += n
        if total > budget:
            break
        taken[d] += n
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == taken[r["doc_id"]] and r["taken"] <= 2 * r["size"]
    assert mixing.mix_sources(table(spark, [])).count() == 0
    odd = mixing.mix_sources(table(spark, [(None, "a b", "s"), (None, "a b", "s"), (1, "c", None), (1, "c", None)])).collect()
    assert len(odd) == 4 and sum(r["taken"] for r in odd) <= 9


# ---- 6 substrings


def test_cover_meets_every_shift():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_passages_against_brute_force(spark):
    rng = random.Random(8)
    shared = [[f"p{k}_{i}" for i in range(rng.choice([49, 50, 51, 70, 120]))] for k in range(6)]
    rows = []
    for k in range(50):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [f"u{rng.random()}" for _ in range(rng.randrange(0, 70))]
            w += rng.choice(shared)
        rows.append((rng.randrange(10_000), " ".join(w), "s"))
    rows = list({r[0]: r for r in rows}.values())
    rows += [(20_000, rows[0][1], "s"), (20_001, "x " * 60, "s"), (20_002, "x " * 200, "s"), (20_003, None, "s"), (20_004, "", "s"), (None, rows[1][1], "s")]
    low = {}
    for d, t, _ in rows:
        w = words(t)
        for i in range(len(w) - 49 if d is not None else 0):
            key = tuple(w[i : i + 50])
            low[key] = min(low.get(key, d), d)
    want = []
    for d, t, _ in rows + [rows[2]]:
        w, gone = words(t), set()
        for i in range(len(w) - 49 if d is not None else 0):
            if low[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        want.append((d or -1, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [(r[0] or -1, r[1], r[2], r[3]) for r in substrings.repeated_passages(table(spark, rows + [rows[2]])).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 1000
    assert substrings.repeated_passages(table(spark, [])).count() == 0


# ---- 7 exact duplicates


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_cuckoo_filter_grows_and_forgets():
    small = exact.CuckooFilter(4)
    held = [k for k in range(60) if small.insert(digest(k))]
    assert 4 < len(held) < 60  # 16 places
    big = exact.CuckooFilter.holding(map(digest, range(2000)))
    assert all(big.contains(digest(k)) for k in range(2000))
    assert sum(big.contains(digest(k)) for k in range(2000, 12_000)) < 20
    assert all(big.delete(digest(k)) for k in range(0, 2000, 2))
    assert all(big.contains(digest(k)) for k in range(1, 2000, 2))
    assert sum(big.contains(digest(k)) for k in range(0, 2000, 2)) < 20


@pytest.mark.parametrize("per_shard", [7, 50_000])
def test_index_inserts_and_deletes(spark, per_shard):
    index = exact.CuckooIndex(spark, per_shard)
    frame = lambda pairs: spark.createDataFrame([(bytearray(digest(k)), i) for k, i in pairs], "digest binary, id long")
    index.insert(frame([(k, k) for k in range(40)] + [(3, 99)]))
    known = index.insert(frame([(k, 100 + k) for k in range(30, 60)])).collect()
    assert {bytes(r["digest"]) for r in known if r["known"]} == {digest(k) for k in range(30, 40)}
    gone = index.delete(frame([(k, 0) for k in range(0, 10)] + [(777, 0)]))
    assert gone.count() == 10
    again = index.insert(frame([(5, 500), (50, 501)])).collect()
    assert {bytes(r["digest"]): r["known"] for r in again} == {digest(5): False, digest(50): True}
    live = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.live().collect()}
    want = {digest(k): (k, 1) for k in range(10, 30)} | {digest(k): (100 + k, 2) for k in range(30, 40)}
    want |= {digest(k): (100 + k, 1) for k in range(40, 60)} | {digest(5): (500, 1), digest(50): (501, 2)}
    assert live == want and index.size == len(live)
    assert index.lookup(frame([(5, 0), (0, 0)])).count() == 1


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_against_brute_force(spark, batches):
    rows = messy() + [(2000, "ABC é", "s"), (2001, "abc é", "s"), (2002, "abc É", "s"), (2003, "abc  é", "s")]
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[lower(t)].append(d)
    want = []
    for d, t, _ in rows:
        ids = groups[lower(t)]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact.exact_duplicates(table(spark, rows), batches=batches).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact.exact_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("answer", [True, False])
def test_result_of_exact_passes_through_the_filters(spark, monkeypatch, answer):
    rows = messy()
    marked = lambda: sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(table(spark, rows), batches=3).collect()), key=repr)
    right, truthful = marked(), exact._probe

    def always(keys, filters):
        out = truthful(keys, filters)
        out.loc[out["digest"].notna(), "hit"] = answer
        return out

    monkeypatch.setattr(exact, "_probe", always)
    assert (marked() == right) is answer  # wrong hits are found out by their content, wrong misses change the result


def test_digests_with_other_contents_are_other_keys(spark):
    index = exact.CuckooIndex(spark)
    frame = lambda rows: spark.createDataFrame([(bytearray(digest(k)), bytearray(c), i) for k, c, i in rows], "digest binary, content binary, id long")
    index.insert(frame([(1, b"x", 1), (1, b"y", 2), (2, b"x", 3)]))
    assert {bytes(r["digest"]): r["known"] for r in index.insert(frame([(1, b"y", 4), (1, b"z", 5), (3, b"x", 6)])).collect()} == {digest(1): True, digest(3): False}
    live = sorted((bytes(r["digest"]), bytes(r["content"]), r["keep_id"], r["n"]) for r in index.stored().collect())
    assert live == sorted([(digest(1), b"x", 1, 1), (digest(1), b"y", 4, 2), (digest(1), b"z", 5, 1), (digest(2), b"x", 3, 1), (digest(3), b"x", 6, 1)])
    assert index.delete(frame([(1, b"", 0)])).count() == 1 and index.size == 2 == index.live().count()


# ---- 8 near duplicates


def grouped(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def test_near_against_brute_force(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = messy(n=40)
    for k in range(60):  # one large group of near copies, some of them too far from others
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((3000 + rng.randrange(100_000), " ".join(w), "s"))
    rows = list({r[0]: r for r in rows if r[0] is not None}.values()) + [(None, "a b c d e f", "s"), rows[0]]
    sets = {d: shingles(t) for d, t, _ in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = grouped(links, ids)
    got = near.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert len(set(root.values())) < len(ids) - 40
    assert near.near_duplicates(table(spark, [])).count() == 0


def test_parity_sketch_never_rules_out_a_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([1, 2, 5, 30, 300, 3000, 20_000]):
        for shared in (0.5, 0.75, 0.86, 1.0):  # of each set; 6/7 of it is a similarity of 75 %
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            other = rng.integers(0, 2**63, n - int(n * shared)).astype(np.uint64)
            b = np.concatenate([a[: int(n * shared)], other])
            similar = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
            odd = [near.parities(v).view(np.int64).tolist() for v in (a, b)]
            rows.append((n, similar, *odd[0], *odd[1]))
    names = [f"{side}_{c}" for side in "xy" for c in near.ODD]
    df = spark.createDataFrame(rows, "n long, similar boolean, " + ", ".join(f"{c} long" for c in names))
    sides = [F.struct("n", *[F.col(f"{side}_{c}").alias(c) for c in near.ODD]).alias(side) for side in "xy"]
    got = df.select("n", "similar", *sides).select("n", "similar", near.may_be_similar("x", "y", 75).alias("able")).collect()
    assert all(r["able"] for r in got if r["similar"]) and any(r["similar"] for r in got)
    assert not any(r["able"] for r in got if not r["similar"] and 30 <= r["n"] <= 300)


def test_every_pair_near_enough_has_a_chunk_with_at_most_one_error():
    rng, size = np.random.default_rng(8), near.CHUNKS * near.LANES
    for wrong in (near.FARTHEST, *rng.integers(0, near.FARTHEST, 20)):
        spread = np.argsort(np.arange(size) % near.LANES, kind="stable")[:wrong]  # over as many chunks as can be
        errors = np.bincount(spread // near.LANES, minlength=near.CHUNKS)
        assert errors.sum() == wrong and errors.min() <= 1
    miss = sum(math.comb(size, k) * 0.25**k * 0.75 ** (size - k) for k in range(near.FARTHEST + 1, size + 1))
    assert miss < 2e-7


# ---- 9 lines


@pytest.mark.parametrize("hot", [3, 64])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rng = random.Random(10)
    pool = [[f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    rows = []
    for d in range(40):
        made = []
        for _ in range(rng.randrange(0, 6)):
            w = list(rng.choice(pool))
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            if rng.random() < 0.3:  # words of one line only
                w += [f"only{d}x{len(made)}y{k}" for k in range(rng.randrange(1, 4))]
            rng.shuffle(w)
            made.append(rng.choice(["", "  "]) + " ".join(w))
        rows.append((d, "\n".join(made), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n \n", "s"), (None, rows[1][1], "s"), rows[2]]
    seen = sorted({(d, k, tuple(sorted(set(words(x))))) for d, t, _ in rows if d is not None for k, x in enumerate((t or "").split("\n"))})
    gone = collections.defaultdict(list)
    for j, (d, k, w) in enumerate(seen):
        if w and any(x and 100 * len({*w} & {*x}) >= 90 * len({*w} | {*x}) for _, _, x in seen[:j]):
            gone[d].append(k)
    got = lines.removed_lines(table(spark, rows)).collect()
    want = [(d, len((t or "").split("\n")), gone[d] if d is not None else []) for d, t, _ in rows]
    assert sorted(((r["doc_id"], r["n_lines"], list(r["removed"])) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(map(len, gone.values())) > 20
    assert lines.removed_lines(table(spark, [])).count() == 0


# ---- 10 language


def test_ngram_counts_against_brute_force(monkeypatch):
    text = "Das ist, ÉTÉ été 12 x-y  Ὀδυσσεύς 中文字"
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    want = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                want[g] += 1
    for chunk in (1 << 20, 5):
        monkeypatch.setattr(language, "CHUNK", chunk)
        keys, counts = language.count_ngrams(language.folded(text))
        unpack = lambda k: "".join(chr(c) for c in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if c)
        assert {unpack(k): c for k, c in zip(keys.tolist(), counts.tolist())} == dict(want)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.held_out("doc_id", 5, 0)
    got = language.identify(docs, language.learn(docs.filter(~out))).join(docs, "doc_id").filter(out).select("doc_id", "lang", "lang_pred").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_edges(spark):
    learned = spark.createDataFrame([("the cat", "en"), ("die Katze", "de"), (None, "de"), ("x", None)], "text string, lang string")
    rows = [(1, None, "s"), (2, "12 !?", "s"), (3, "the cat", "s"), (4, "Катя", "s"), (None, "die katze", "s"), (3, "the cat", "s")]
    model = language.learn(learned)
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in language.identify(table(spark, rows), model).collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "en", True), (3, "en", True), (4, "de", False)]
    assert {r["lang_pred"] for r in language.identify(table(spark, rows), language.learn(learned.limit(0))).collect()} == {"und"}
    assert language.identify(table(spark, []), model).count() == 0


# ---- op2: time and reach


def _seconds(text):
    import time

    start = time.time()
    found = pii.find(text)
    return time.time() - start, found


def test_hostile_texts_take_linear_time():
    chain = "x " + "a-dot-" * 40 + "b dot c"
    run, digits = "a" * 1_000_000 + " @ b@c.de", "1" * 1_000_000 + " 1.2.3.4"
    many = " ".join(f"u{k}@h{k}.org" for k in range(50_000))
    for text, count in ((chain, 0), (run, 1), (digits, 1), (many, 50_000)):
        took, (base, _) = _seconds(text)
        assert took < 8 and len(base) == count


def test_addresses_from_the_at_sign_equal_the_pattern():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.-_ %\n") for _ in range(rng.randrange(1, 40)))
        assert list(pii.emails(text)) == [m.span() for m in pattern.finditer(text)], text
        text = "".join(rng.choice("12. x") for _ in range(rng.randrange(1, 40)))
        ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
        assert [m.span() for m in pii.PATTERNS["ip"].finditer(text)] == [m.span() for m in ip.finditer(text)], text


@pytest.mark.parametrize("text", ["john At example Dot com", "john arroba example punto com", "n" * 450 + " (at) example (dot) com", "a-dot-b-at-example-dot-com"])
def test_more_disguises_are_found_whole(text):
    assert ("email", 0, len(text)) in pii.find(f"{text}\nnext line")[1]


def test_spelled_digits_are_part_of_an_address():
    assert ("email", 5, 31) in pii.find("john one two at example dot com")[1]
