"""The pipeline against brute force, its stages on odd tables, and the registered queries against SQL."""

import collections
import hashlib
import itertools
import re

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from notecode.llm import queries
from notecode.session import materialised

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def ngrams(text):
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    found = collections.Counter(flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1))
    found = {g: c for g, c in found.items() if g.strip() and not (len(g) == 3 and g[1] == " ")}
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][:400]


def by_language(docs, _):
    texts = collections.defaultdict(list)
    for d in docs:
        texts[d["lang"]].append(d["text"])
    profiles = {lang: {g: k for k, g in enumerate(ngrams("\n".join(t)))} for lang, t in texts.items()}
    known = {g for p in profiles.values() for g in p}
    kept = []
    for d in docs:
        top = ngrams(d["text"])
        costs = sorted(sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(top)) for p in profiles.values())
        if top and known & set(top) and costs[0] < costs[1]:
            kept.append(d)
    return kept


def by_lines(docs, _):
    seen, out = [], []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        kept = []
        for line in d["text"].split("\n"):
            w = set(WORD.findall(line))
            if w and any(100 * len(w & x) >= 90 * len(w | x) for x in seen if 0.89 * len(w) <= len(x) <= len(w) / 0.89):
                seen.append(w)
                continue
            seen.append(w)
            kept.append(line)
        text = "\n".join(kept)
        out.append(d | {"text": text, "n_chars": d["n_chars"] if text == d["text"] else len(text)})
    return out


def by_copies(docs, _):
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return [d for d in docs if root[d["doc_id"]] == d["doc_id"]]


def by_benchmark(docs, items):
    wanted = []
    for t in items:
        w = WORD.findall(t.lower())
        wanted.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    kept = []
    for d in docs:
        w = WORD.findall(d["text"].lower())
        has = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if not any(s and 100 * len(s & has) >= 75 * len(s) for s in wanted):
            kept.append(d)
    return kept


def by_weight(docs, _):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    source = collections.Counter()
    for d in docs:
        source[d["source"]] += size[d["doc_id"]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(source))}
    budget, target, free = 1.5 * sum(source.values()), {}, set(source)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * source[s]}
        if not over:
            break
        target |= {s: 2.0 * source[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    key = lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()
    queue, sent = [], collections.Counter()
    for again in (0, 1):
        for d in sorted(docs, key=lambda d: key(d["doc_id"])):
            n = size[d["doc_id"]]
            sent[d["source"]] += n
            if n:
                queue.append((sent[d["source"]] / target[d["source"]], key(d["doc_id"]), d["doc_id"], n))
    total, out, at = 0, [], {d["doc_id"]: d for d in docs}
    copies = collections.Counter()
    for _, _, i, n in sorted(queue):
        total += n
        if total > budget:
            break
        out.append(at[i] | {"copy": copies[i]})
        copies[i] += 1
    return out


def as_rows(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = [r.asDict() for r in docs.collect()]
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (by_language, by_lines, by_copies, by_benchmark, by_weight)):
        docs = materialised(stage(spark, docs, SF_DIR))
        want = brute(want, items)
        assert as_rows(r.asDict() for r in docs.collect()) == as_rows(want), name
        if name != "mixing sources":
            assert docs.columns == columns


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_tables(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    long = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (2, long, "en", None, None), (3, None, None, "a", 0), (4, "", "de", "b", 0), (5, "12 34", "en", "a", 5)]
    rows += [(None, long, "en", "a", 1), (6, "the cat sat\n\nthe cat sat\nunder a tree", "en", "b", 1), (7, "die Katze saß unter dem Baum", "de", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["id", "text_a", "component_id", "kept", "removed", "_removed", "line", "score", "copies", "size", "n", "hash", "key", "words"]
    docs = docs.select("*", *[F.lit("x").alias(c) for c in extra])
    out = stage(spark, docs, SF_DIR)
    assert out.columns[: len(docs.columns)] == docs.columns
    ids = collections.Counter(r["doc_id"] for r in out.collect())
    want = {
        "language ID": {1: 2, 2: 1, None: 1, 6: 1, 7: 1},
        "line dedup": {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1},
        "MinHash near-dedup": {1: 2, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1},
        "benchmark decontamination": {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1},
    }
    if name in want:
        assert ids == want[name]
    else:
        assert ids and not ids.keys() & {3, 4}
    if name == "line dedup":
        texts = {r["doc_id"]: r["text"] for r in out.collect()}
        assert texts[6] == "the cat sat\n\nunder a tree" and texts[2] == "" and texts[3] is None and texts[1] == long
    empty = stage(spark, docs.limit(0), SF_DIR)
    assert empty.count() == 0 and empty.columns == out.columns


def test_entry_registers_every_operator():
    found = registered.queries()
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in found) if m)
    assert numbers == list(range(1, 14)) and found["pipeline"] is corpus_pipeline.run
    assert set(queries.SQL) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name]) is None


def test_texts_that_tie_between_two_languages_stay(spark):
    same = "der hund und die katze"
    rows = [(1, same, "de"), (2, same, "nl"), (3, "hund", None), (4, "жжж", None), (5, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", ["copy", "Copy"])
def test_mix_keeps_a_column_named_copy(spark, tmp_path, name):
    docs = spark.createDataFrame([(k, f"word{k} and more", "ab"[k % 2], f"own{k}") for k in range(12)], f"doc_id long, text string, source string, {name} string")
    got = corpus_pipeline.mixed_sources(spark, docs, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source", name, "copy_"]
    rows = got.collect()
    assert rows and all(r[name] == f"own{r['doc_id']}" for r in rows)
    assert len({(r["doc_id"], r["copy_"]) for r in rows}) == len(rows)
