"""Inputs of the registered queries, derived from the given tables: once in Spark, once in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.operators.hierarchy import path_links
from notecode.operators.indexing import random_codes, tree_depth
from notecode.operators.sampling import HASH_RANGE, seeded_hash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# SQL text of each view; a statement pulls in the views it names, see `with_views`.
VIEWS: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the definitions of all views it uses, directly or not."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    recursive = "RECURSIVE " if any("RECURSIVE" in VIEWS[n] for n in needed) else ""
    head = ", ".join(f"{n} AS ({VIEWS[n].replace('/*RECURSIVE*/', '')})" for n in needed)
    if not head:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {recursive}{head}, {body.lstrip()[len('WITH'):]}"
    return f"WITH {recursive}{head} {body}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL (views not yet expanded) if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash(key: str, seed: str) -> str:
    """SQL twin of `seeded_hash`."""
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT)"


# --- texts and codes --------------------------------------------------------------------------

VIEWS["fx_notes"] = (
    "SELECT conv_id * 1000 + turn AS row_id, conv_id AS hadm_id, ' ' || role || ' ' AS category, text FROM conversations"
)


def notes(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" "), "role", F.lit(" ")).alias("category")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id")
    return table(spark, d, "conversations").select(key, F.col("conv_id").alias("hadm_id"), padded, "text")


VIEWS["fx_docs"] = "SELECT doc_id AS row_id, doc_id AS hadm_id, lang AS category, text, source FROM documents"


def docs(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, d, "documents").select(
        doc.alias("row_id"), doc.alias("hadm_id"), F.col("lang").alias("category"), "text", "source"
    )


# the given texts hold no de-identification marks or administrative phrases, so every text gets some
BEFORE, AFTER = "Admission Date: ", " given w/ IV fluid_ #3 at 10 am [end] M.D. Phone 0.5 % Drops"
VIEWS["fx_marked"] = f"SELECT doc_id AS row_id, '[**' || doc_id || '**] {BEFORE}' || text || '{AFTER}' AS text FROM documents"


def marked(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[**"), F.col("doc_id").cast("string"), F.lit("**] " + BEFORE), "text", F.lit(AFTER))
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), text.alias("text"))


VIEWS["fx_diag"] = (
    "SELECT doc_id AS hadm_id, 1 AS seq_num, 'lang:' || lang AS code FROM documents "
    "UNION ALL SELECT doc_id, 2, 'src:' || source FROM documents"
)
VIEWS["fx_proc"] = (
    "SELECT doc_id AS hadm_id, 1 AS seq_num, 'q:' || quality AS code FROM labels "
    "UNION ALL SELECT doc_id, 2, 'tox:' || toxic FROM labels"
)


def _coded(df: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("seq_num"), F.concat(F.lit(prefix), F.col(column).cast("string")).alias("code"))
        for i, (prefix, column) in enumerate((first, second), 1)
    ]
    return df.select(F.col("doc_id").alias("hadm_id"), F.inline(F.array(*rows)))


def diag(spark: SparkSession, d: str) -> DataFrame:
    return _coded(table(spark, d, "documents"), ("lang:", "lang"), ("src:", "source"))


def proc(spark: SparkSession, d: str) -> DataFrame:
    return _coded(table(spark, d, "labels"), ("q:", "quality"), ("tox:", "toxic"))


# --- matrices ---------------------------------------------------------------------------------

VIEWS["fx_items"] = (
    "SELECT o_custkey AS row_id, l_partkey AS label_id, p_brand || '/' || p_type AS col_id "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"
)
VIEWS["fx_y"] = "SELECT DISTINCT o_custkey AS row_id, l_partkey AS label_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
VIEWS["fx_x"] = "SELECT row_id, col_id, count(*)::DOUBLE AS val FROM fx_items GROUP BY ALL"
VIEWS["fx_instances"] = "SELECT c_custkey AS row_id FROM customer"
VIEWS["fx_labels"] = "SELECT p_partkey AS label_id FROM part"
VIEWS["fx_dense"] = "SELECT vec_id AS row_id, embedding, label FROM embeddings"
VIEWS["fx_dense_long"] = (
    "SELECT row_id, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS col_id, unnest(embedding)::DOUBLE AS val FROM fx_dense"
)


ITEMS_OF_A_TASK = 100_000


def _tasks(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").count() // ITEMS_OF_A_TASK + 1


def _bought(spark: SparkSession, d: str) -> DataFrame:
    """Bought labels of each row, joined in as many partitions as the items need."""
    n = _tasks(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    if n > 1:  # sorted pieces of a join that stay as large as they are, however many items there are
        orders, items = orders.repartition(n, "o_orderkey"), items.repartition(n, "l_orderkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("row_id"), F.col("l_partkey").alias("label_id")
    )


def _by_row(spark: SparkSession, d: str) -> DataFrame:
    """Bought labels partitioned by row, in as many partitions as the items need.

    What follows for each row (distinct labels, ranks, counts) needs no other shuffle, and the memory of a task
    does not grow with the tables.
    """
    return _bought(spark, d).repartition(_tasks(spark, d), "row_id")


def y(spark: SparkSession, d: str) -> DataFrame:
    return _by_row(spark, d).distinct()


def x(spark: SparkSession, d: str) -> DataFrame:
    kind = F.concat("p_brand", F.lit("/"), "p_type").alias("col_id")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("label_id"), kind)
    counted = _bought(spark, d).join(parts, "label_id").groupBy("row_id", "col_id").agg(F.count("*").cast("double").alias("val"))
    return counted


def instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("label_id"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")


VIEWS["fx_depth"] = "SELECT floor(log2(count(*) // 100 + 1))::INT AS depth FROM part"
VIEWS["fx_c"] = f"SELECT label_id, {sql_hash('label_id', 's0')} % (1 << depth) AS code FROM fx_labels, fx_depth"


def depth(spark: SparkSession, d: str) -> int:
    return tree_depth(labels(spark, d).count())


def c(spark: SparkSession, d: str) -> DataFrame:
    """Random clusters of about 100 labels."""
    return random_codes(labels(spark, d), depth(spark, d))


# Predictions: every true pair, and for each of them one more label that is mostly wrong. Scores are hashes.
VIEWS["fx_pairs"] = (
    "SELECT row_id, label_id FROM fx_y UNION "
    "SELECT row_id, (label_id * 31 + 7) % (SELECT count(*) FROM fx_labels) FROM fx_y"
)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    n = labels(spark, d).agg(F.count("*")).scalar()
    label = F.col("label_id")
    both = F.explode(F.array(label, F.pmod(label * 31 + 7, n))).alias("label_id")
    return _by_row(spark, d).select("row_id", both).distinct()


def most_pairs(spark: SparkSession, d: str) -> int:
    """A number of pairs that no row exceeds: two for each item it bought."""
    return 2 * (_bought(spark, d).groupBy("row_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)


def score_sql(tag: str) -> str:
    """The same score in SQL."""
    key = chr(39).join(["row_id || ", ":", " || label_id"])
    return f"round({sql_hash(key, tag)} / {float(HASH_RANGE)}, 6)"


for _tag in "abc":
    VIEWS[f"fx_pred_{_tag}"] = (
        f"SELECT row_id, label_id, {score_sql(_tag)} AS score FROM fx_pairs"
    )


def six_places(h: Column) -> Column:
    """A hash as a share of its range, rounded half up to six places, without the decimals that ``round`` goes through."""
    return F.floor(h * F.lit(1e6 / HASH_RANGE) + 0.5) / F.lit(1e6)


def pair_score(tag: str) -> Column:
    """A made-up score of a pair, by its hash."""
    key = F.concat(F.col("row_id").cast("string"), F.lit(":"), F.col("label_id").cast("string"))
    return six_places(seeded_hash(key, tag))


def pred(spark: SparkSession, d: str, tag: str = "a") -> DataFrame:
    return pairs(spark, d).select("row_id", "label_id", pair_score(tag).alias("score"))


# Cluster scores as a matcher would give them: the best score of any predicted label of the cluster.
VIEWS["fx_z"] = "SELECT row_id, code, max(score) AS val FROM fx_pred_a JOIN fx_c USING (label_id) GROUP BY ALL"


def z(spark: SparkSession, d: str) -> DataFrame:
    return pred(spark, d).join(c(spark, d), "label_id").groupBy("row_id", "code").agg(F.max("score").alias("val"))


# Weights: label embeddings stand in for trained weights.
VIEWS["fx_y_unit"] = "SELECT row_id, label_id, 1 / sqrt(count(*) OVER (PARTITION BY row_id)) AS val FROM fx_y"
VIEWS["fx_pifa_raw"] = (
    "SELECT label_id, col_id, sum(a.val * b.val) AS val FROM fx_y_unit a JOIN fx_x b USING (row_id) GROUP BY ALL"
)
VIEWS["fx_pifa"] = "SELECT label_id, col_id, val / sqrt(sum(val * val) OVER (PARTITION BY label_id)) AS val FROM fx_pifa_raw"
VIEWS["fx_w"] = "SELECT label_id, col_id, round(val, 4) AS val FROM fx_pifa"


def w(spark: SparkSession, d: str) -> DataFrame:
    from notecode.operators.embedding import pifa

    return pifa(y(spark, d), x(spark, d)).withColumn("val", F.round("val", 4))


# --- hierarchy and mapping --------------------------------------------------------------------

# Region > nation > customer. Customers in debt have no nation link, which leaves a gap in their path.
VIEWS["fx_people"] = (
    "SELECT c_custkey AS path_ord, 'R' || r_regionkey AS r, r_name, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS n, n_name, "
    "'C' || c_custkey AS c, c_name, c_acctbal < 0 AS gap "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
VIEWS["fx_links"] = (
    "SELECT path_ord, 0 AS depth, r AS code, r_name AS descr, -1 AS parent_depth, 'ROOT' AS parent_code FROM fx_people "
    "UNION ALL SELECT path_ord, 1, n, n_name, 0, r FROM fx_people WHERE NOT gap "
    "UNION ALL SELECT path_ord, 2, c, c_name, CASE WHEN gap THEN 0 ELSE 1 END, CASE WHEN gap THEN r ELSE n END FROM fx_people"
)
VIEWS["fx_nodes"] = (
    "SELECT depth, code, arg_min(descr, path_ord) AS descr, arg_max(parent_depth, path_ord) AS parent_depth, "
    "arg_max(parent_code, path_ord) AS parent_code, min(path_ord) AS first_path FROM fx_links GROUP BY depth, code"
)
VIEWS["fx_edges"] = (
    "SELECT parent_depth, parent_code, depth, code, min(path_ord) AS first_path FROM fx_links "
    "GROUP BY parent_depth, parent_code, depth, code"
)


def paths(spark: SparkSession, d: str) -> DataFrame:
    people = (
        table(spark, d, "customer")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def link(code, descr):
        return F.struct(code.alias("code"), descr.alias("descr"))

    nation = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    links = F.array(
        link(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.col("r_name")),
        link(F.when(F.col("c_acctbal") >= 0, nation), F.col("n_name")),
        link(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.col("c_name")),
    )
    return people.select(F.col("c_custkey").alias("path_ord"), links.alias("links"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return path_links(paths(spark, d))


# A code dictionary whose category prefixes are nations (customers) or unknown (suppliers).
VIEWS["fx_dictionary"] = (
    "SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') || c_custkey AS code, c_name AS title FROM customer "
    "UNION ALL SELECT 'S' || lpad(s_nationkey::VARCHAR, 2, '0') || s_suppkey, s_name FROM supplier"
)


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    def codes(name: str, letter: str, nation: str, key: str, title: str) -> DataFrame:
        padded = F.lpad(F.col(nation).cast("string"), 2, "0")
        code = F.concat(F.lit(letter), padded, F.col(key).cast("string"))
        return table(spark, d, name).select(code.alias("code"), F.col(title).alias("title"))

    return codes("customer", "N", "c_nationkey", "c_custkey", "c_name").unionByName(
        codes("supplier", "S", "s_nationkey", "s_suppkey", "s_name")
    )


VIEWS["fx_map"] = (
    "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, s_name AS title "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
)
# coded rows: the codes of seventh lines are unknown to the map
VIEWS["fx_coded"] = (
    "SELECT DISTINCT l_orderkey AS row_id, CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'p' END || l_partkey AS code FROM lineitem"
)


def mapping(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("title"))
    pairs_ = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(suppliers, "l_suppkey")
    return pairs_.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt"),
        "title",
    ).distinct()


def coded(spark: SparkSession, d: str) -> DataFrame:
    letter = F.when(F.col("l_linenumber") == 7, F.lit("x")).otherwise(F.lit("p"))
    code = F.concat(letter, F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), code.alias("code")).distinct()


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")
