"""Queries of text cleaning, tokenising and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.views import query
from notecode.functions import text as T
from notecode.operators import features
from notecode.sources import pages as P

SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _deid_sql(text: str) -> str:
    return rf"regexp_replace({text}, '\[.*?\]', '', 'g')"


def _phrases_sql(text: str, mode: str = "regex") -> str:
    for phrase in T.ADMIN_PHRASES:
        pattern = mode == "regex" and len(phrase) > 1 and any(s in T.REGEX_SIGNS for s in phrase)
        text = f"regexp_replace({text}, {_quoted(phrase)}, '', 'g')" if pattern else f"replace({text}, {_quoted(phrase)}, '')"
    return text


def _normal_sql(text: str) -> str:
    text = f"replace(replace(replace(replace({text}, chr(10), ' '), 'w/', 'with'), '_', ''), '#', '')"
    return rf"trim(regexp_replace(regexp_replace({text}, '\p{{Nd}}+', '', 'g'), '{SPACES}+', ' ', 'g'))"


def _digest(text: str, source: str) -> str:
    return f"SELECT row_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT row_id, {text} AS t FROM {source})"


def _digested(df, text):
    t = df.select("row_id", text.alias("t"))
    return t.select("row_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(_digest(_deid_sql("text"), "fx_marked"))
def strip_deid(spark, d):
    return _digested(v.marked(spark, d), T.strip_deid(F.col("text")))


@query(_digest(_phrases_sql("text"), "fx_marked"))
def strip_phrases(spark, d):
    return _digested(v.marked(spark, d), T.strip_phrases(F.col("text")))


@query(_digest(_phrases_sql("text", "literal"), "fx_marked"))
def strip_phrases_literal(spark, d):
    return _digested(v.marked(spark, d), T.strip_phrases(F.col("text"), mode="literal"))


@query(_digest(_normal_sql("text"), "fx_marked"))
def normalise_text(spark, d):
    return _digested(v.marked(spark, d), T.normalise_text(F.col("text")))


@query(_digest(_normal_sql(_phrases_sql(_deid_sql("text"))), "fx_marked"))
def clean_notes(spark, d):
    return _digested(v.marked(spark, d), T.clean_note(F.col("text")))


@query(_digest("replace(text, chr(10), ' ')", "fx_docs"))
def single_line(spark, d):
    return _digested(v.docs(spark, d), T.single_line(F.col("text")))


LABEL_SQL = rf"regexp_replace(regexp_replace(text, '[,.:;\\''/@#?!\[\]&$_*]+', ' ', 'g'), '^{SPACES}+|{SPACES}+$', '', 'g')"


@query(_digest(LABEL_SQL, "fx_docs"))
def clean_label(spark, d):
    return _digested(v.docs(spark, d), T.clean_label(F.col("text")))


@query(
    "SELECT code, substr(code, 1, 3) AS category, substr(code, 1, 2) || '.' || substr(code, 3, 1) AS procedure_category "
    "FROM fx_dictionary"
)
def code_prefix(spark, d):
    code = F.col("code")
    return v.dictionary(spark, d).select(
        "code", T.code_prefix(code).alias("category"), T.code_prefix(code, procedure=True).alias("procedure_category")
    )


@query(
    "SELECT hadm_id, len(string_split(codes, ',')) AS n_codes, array_to_string(list_reverse(string_split(codes, ',')), ',') AS back "
    "FROM (SELECT hadm_id, string_agg(code, ',' ORDER BY seq_num) AS codes FROM fx_diag GROUP BY hadm_id)"
)
def split_and_join_codes(spark, d):
    listed = v.diag(spark, d).groupBy("hadm_id").agg(F.sort_array(F.collect_list(F.struct("seq_num", "code"))).alias("c"))
    text = listed.select("hadm_id", T.join_codes(F.transform("c", lambda e: e["code"])).alias("codes"))
    split = T.split_codes(F.col("codes"))
    return text.select("hadm_id", F.size(split).cast("long").alias("n_codes"), T.join_codes(F.reverse(split)).alias("back"))


v.VIEWS["fx_words"] = r"SELECT row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM fx_docs"
v.VIEWS["fx_token"] = "SELECT row_id, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM fx_words"


@query("SELECT row_id, len(words) AS n_words, md5(array_to_string(words, ' ')) AS digest FROM fx_words")
def tokenize_words(spark, d):
    words = v.docs(spark, d).select("row_id", T.tokenize_words(F.col("text")).alias("words"))
    return words.select("row_id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(
    "SELECT gram, count(*) AS n FROM (SELECT unnest(words) AS gram FROM fx_words UNION ALL "
    "SELECT a.term || ' ' || b.term FROM fx_token a JOIN fx_token b ON a.row_id = b.row_id AND a.pos + 1 = b.pos) GROUP BY gram"
)
def word_ngrams(spark, d):
    grams = T.ngrams(T.tokenize_words(F.col("text")), longest=2)
    return v.docs(spark, d).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


MAX_LEN = 128
v.VIEWS["fx_vocab"] = (
    "SELECT term, row_number() OVER (ORDER BY term) + 9 AS id FROM (SELECT term FROM fx_token GROUP BY term HAVING count(DISTINCT row_id) >= 2)"
)
v.VIEWS["fx_encoded"] = (
    "SELECT row_id, list_concat(list_concat([1], coalesce(ids, [])), [2]) AS ids FROM fx_docs LEFT JOIN "
    "(SELECT row_id, list(coalesce(id, 3) ORDER BY pos) AS ids FROM fx_token LEFT JOIN fx_vocab USING (term) "
    f"WHERE pos <= {MAX_LEN - 2} GROUP BY row_id) USING (row_id)"
)


def _encoded(spark, d, pad_left=False):
    texts = v.docs(spark, d).select("row_id", "text")
    frequency = features.document_frequency(features.term_counts(texts)).filter(F.col("df") >= 2)
    vocab = features.vocabulary(frequency, first_id=10)
    return features.encode_tokens(texts, vocab, MAX_LEN, pad_left=pad_left)


def _joined(column):
    return F.array_join(F.transform(column, lambda e: e.cast("string")), ",")


@query(
    "SELECT row_id, len(ids) AS length, "
    f"array_to_string(list_concat(ids, list_transform(range({MAX_LEN} - len(ids)), lambda i: 0)), ',') AS input_ids, "
    f"array_to_string(list_transform(range({MAX_LEN}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask, "
    f"array_to_string(list_transform(range({MAX_LEN}), lambda i: 0), ',') AS token_type_ids FROM fx_encoded"
)
def encode_tokens(spark, d):
    e = _encoded(spark, d)
    arrays = [_joined(n).alias(n) for n in ("input_ids", "attention_mask", "token_type_ids")]
    return e.select("row_id", F.col("length").cast("long").alias("length"), *arrays)


@query(
    "SELECT row_id, "
    f"array_to_string(list_concat(list_transform(range({MAX_LEN} - len(ids)), lambda i: 0), ids), ',') AS input_ids FROM fx_encoded"
)
def encode_tokens_left(spark, d):
    return _encoded(spark, d, pad_left=True).select("row_id", _joined("input_ids").alias("input_ids"))


@query(
    "SELECT min(len(ids)) AS min_len, max(len(ids)) AS max_len, round(avg(len(ids)), 6) AS mean_len, "
    "median(len(ids))::DOUBLE AS median_len FROM fx_encoded"
)
def length_stats(spark, d):
    s = features.length_stats(_encoded(spark, d))
    return s.select(
        F.col("min_len").cast("long").alias("min_len"),
        F.col("max_len").cast("long").alias("max_len"),
        F.round("mean_len", 6).alias("mean_len"),
        "median_len",
    )


# headings like "12. TITLE (001-139)" made from parts, some of them without an end or without a code
v.VIEWS["fx_headings"] = (
    "SELECT p_partkey AS row_id, p_partkey || '. ' || p_name || CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN ' (V' || p_size || ')' "
    "ELSE ' (' || p_size || '-' || p_partkey || ')' END AS heading, "
    "CASE WHEN p_size > 40 THEN p_name ELSE ' ' || p_size || '.' || p_partkey || ' ' || p_name END AS entry FROM part"
)


def _headings(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    tail = (
        F.when(F.col("p_size") > 40, F.lit(""))
        .when(F.col("p_size") > 20, F.concat(F.lit(" (V"), size, F.lit(")")))
        .otherwise(F.concat(F.lit(" ("), size, F.lit("-"), key, F.lit(")")))
    )
    entry = F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(
        F.concat(F.lit(" "), size, F.lit("."), key, F.lit(" "), "p_name")
    )
    return v.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat(key, F.lit(". "), "p_name", tail).alias("heading"), entry.alias("entry")
    )


@query(
    "SELECT row_id, CASE WHEN s <> '' THEN CASE WHEN e <> '' THEN s || '-' || e ELSE s END END AS code, "
    "CASE WHEN s <> '' THEN t END AS descr FROM (SELECT row_id, "
    + ", ".join(f"coalesce(regexp_extract(heading, {_quoted(T.CHAPTER_PATTERN)}, {g}), '') AS {n}" for g, n in ((3, "s"), (5, "e"), (2, "t")))
    + " FROM fx_headings)"
)
def extract_ranged_code(spark, d):
    found = _headings(spark, d).select("row_id", T.extract_ranged_code(F.col("heading")).alias("f"))
    return found.select("row_id", "f.code", "f.descr")


@query(
    "SELECT row_id, CASE WHEN s <> '' THEN s END AS code, CASE WHEN s <> '' THEN t END AS descr FROM (SELECT row_id, "
    + ", ".join(f"coalesce(regexp_extract(entry, {_quoted(T.SINGLE_CODE_PATTERN)}, {g}), '') AS {n}" for g, n in ((1, "s"), (3, "t")))
    + " FROM fx_headings)"
)
def extract_single_code(spark, d):
    found = _headings(spark, d).select("row_id", T.extract_single_code(F.col("entry")).alias("f"))
    return found.select("row_id", "f.code", "f.descr")


v.VIEWS["fx_first_pages"] = (
    "SELECT * FROM (SELECT page_id, html, "
    f"regexp_extract(url, {_quoted(P.PATH)}, 1) || '?' || coalesce(regexp_extract(url, {_quoted(P.QUERY)}, 1), '') AS page_key "
    "FROM pages) QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY page_id) = 1"
)


@query("SELECT page_id, page_key, length(html) AS n_chars FROM fx_first_pages")
def first_pages(spark, d):
    return P.first_pages(v.pages(spark, d)).select("page_id", "page_key", F.length("html").cast("long").alias("n_chars"))


def _decoded(text: str) -> str:
    for name, sign in (("quot", "34"), ("copy", "169"), ("middot", "183"), ("amp", "38")):
        text = f"replace({text}, '&{name};', chr({sign}))"
    return text


NAV = (
    "SELECT page_id, CAST(place AS BIGINT) AS place, split_part(piece, '\"', 1) AS href, "
    f"{_decoded("split_part(split_part(piece, '>', 2), '<', 1)")} AS text "
    "FROM (SELECT page_id, unnest(pieces[2:]) AS piece, unnest(range(len(pieces) - 1)) AS place FROM "
    "(SELECT page_id, string_split(html, '<a href=\"') AS pieces FROM fx_first_pages WHERE {where}))"
)


@query(NAV.format(where="true"))
def page_links(spark, d):
    links = P.page_links(P.first_pages(v.pages(spark, d)))
    return links.withColumn("place", F.col("place").cast("long"))


@query(
    NAV.format(where="strpos(html, '<html lang=\"fr\"') > 0") + " UNION ALL SELECT page_id, 0 AS place, NULL AS href, "
    f"{_decoded("split_part(split_part(html, '<h1>', 2), '</h1>', 1)")} AS text "
    "FROM fx_first_pages WHERE strpos(html, '<html lang=\"fr\"') = 0 AND strpos(html, '<h1>') > 0"
)
def page_links_by_rule(spark, d):
    """Menu entries of the pages in one language; of the others, where that rule finds none, the heading."""
    rules = [P.LinkRule("html[lang=fr] nav > ul > li", "a"), P.LinkRule("article h1")]
    links = P.page_links(P.first_pages(v.pages(spark, d)).withColumn("depth", F.lit(0)), rules, "depth")
    return links.withColumn("place", F.col("place").cast("long"))
