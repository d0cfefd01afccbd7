"""Registered queries over the operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.llm import alignment, chat, decontamination, exact, language, lines, mixing, near, neighbours, pii, quality, ranked, substrings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The words of documents.text in SQL.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS more, role IS NOT DISTINCT FROM lead(role) OVER w AS goes_on,
    replace(replace(replace(replace(text, '\', '\b'), '<turn ', '\lturn '), '</turn>', '\l/turn>'), '<part>', '\lpart>') AS body
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN more THEN 0 ELSE length('<turn >') + length(role) END
    + CASE WHEN goes_on THEN length('<part>') ELSE length('</turn>') + 1 END)::BIGINT AS formatted_chars,
  count(*) FILTER (NOT more) AS n_blocks
FROM e GROUP BY conv_id""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    chats = chat.format_chats(turns.unionByName(extra))
    back = chat.read_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias(
            "turns_sha256"
        ),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )
    return back


@query(f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5('mix:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN cap / weight >= level THEN level END) OVER (), 'inf'::DOUBLE)) AS target
  FROM l
), q AS (
  SELECT d.*, source_size, target,
    sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t USING (source)
), r AS (
  SELECT *, (round * source_size + sent)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS v(round) WHERE size > 0
), x AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, doc_id, round ROWS UNBOUNDED PRECEDING) AS total FROM r
), k AS (
  SELECT doc_id, count(*) AS copies FROM x WHERE total <= (SELECT sum(target) FROM t) GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (coalesce(copies, 0) * size)::BIGINT AS taken
FROM q LEFT JOIN k USING (doc_id)""")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2 and 1 in turn."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group of equal texts that stays."""
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM d
), n AS (SELECT doc_id, len(grams) AS n FROM s
), e AS (SELECT doc_id, unnest(grams) AS gram FROM s
), g AS (SELECT doc_id, gram, n FROM e JOIN n USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  WITH RECURSIVE t(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT p.b, t.root FROM t JOIN p ON p.a = t.id WHERE t.root < p.b)
  SELECT id, min(root) AS component_id FROM t GROUP BY id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN r ON r.id = n.doc_id""")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents
), v AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d
), x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM v
), m AS (SELECT win, min(doc_id) AS low FROM x GROUP BY win HAVING min(doc_id) < max(doc_id)
), k AS (SELECT x.doc_id, list(i) AS starts FROM x JOIN m USING (win) WHERE doc_id > low GROUP BY x.doc_id
), o AS (
  SELECT doc_id, unnest(list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50))))) AS place FROM k
), c AS (SELECT doc_id, list(place) AS gone FROM o GROUP BY doc_id
), t AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)
), l AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM t
), y AS (
  SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.place) AS kept FROM l ANTI JOIN o ON o.doc_id = l.doc_id AND o.place = l.place GROUP BY l.doc_id
)
SELECT t.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN y USING (doc_id)""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that an earlier document has."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op2_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    found = pii.private_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"),
    )


@query()
def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language.held_out("doc_id", 3, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~out)
    model = quality.learn(docs, labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles of the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out("doc_id", 5, 0)
    found = language.identify(docs, language.learn(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: Distinct lower-case 5-word shingles of a table's texts in SQL.
GRAMS = WORDS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")


@query(f"""
WITH d AS (SELECT doc_id, {GRAMS} AS w FROM documents), i AS (SELECT item_id, {GRAMS} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS gram FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS gram FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM dg JOIN ig USING (gram) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75""")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents
), l AS (SELECT doc_id, line, list_sort(list_distinct({WORDS})) AS w FROM t
), c AS (SELECT w, min(struct_pack(d := doc_id, l := line)) AS low, len(w)::BIGINT AS n FROM l WHERE len(w) > 0 GROUP BY w
), e AS (SELECT low, n, w, unnest(w) AS word FROM c
), f AS (SELECT word, count(*) AS df FROM e GROUP BY word
), r AS (SELECT low, n, w, word, row_number() OVER (PARTITION BY low ORDER BY df, word) AS place FROM e JOIN f USING (word)
), p AS (SELECT * FROM r WHERE place <= n - (n * 90 + 99) // 100 + 1
), m AS (
  SELECT DISTINCT y.low AS low FROM p AS x JOIN p AS y ON x.word = y.word AND x.low < y.low AND x.n * 100 >= y.n * 90 AND y.n * 100 >= x.n * 90
  WHERE len(list_intersect(x.w, y.w)) * 100 >= (x.n + y.n - len(list_intersect(x.w, y.w))) * 90
), g AS (
  SELECT doc_id, line FROM l JOIN c USING (w) WHERE low <> struct_pack(d := doc_id, l := line) OR low IN (SELECT low FROM m)
), o AS (SELECT doc_id, count(*) AS n_removed, string_agg(line, ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, any_value(coalesce(n_removed, 0)) AS n_removed, any_value(coalesce(removed, '')) AS removed
FROM l LEFT JOIN o USING (doc_id) GROUP BY doc_id""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that are similar to an earlier line of the corpus."""
    found = lines.removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


#: A text's terms in SQL.
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents
), c AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS length FROM d
), q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
), p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d
), f AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length)))))::BIGINT AS score
  FROM f JOIN w USING (term) JOIN q USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of the benchmark."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in two vocabularies, cut into groups and linked."""
    return alignment.align(table(spark, sf_dir, "documents"))
