"""Queries of the code hierarchy and the label texts built from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.views import query
from notecode.operators import hierarchy as H

# depth-first sort keys: the first-seen path of every edge from the root to the node
v.VIEWS["fx_preorder"] = (
    "/*RECURSIVE*/SELECT depth, code, [first_path] AS place FROM fx_edges WHERE parent_depth = -1 "
    "UNION ALL SELECT e.depth, e.code, list_append(p.place, e.first_path) FROM fx_preorder p "
    "JOIN fx_edges e ON e.parent_depth = p.depth AND e.parent_code = p.code"
)


def _all(spark, d):
    links = v.links(spark, d)
    return links, H.hierarchy_nodes(links), H.hierarchy_edges(links), H.tree_levels(links)


@query("SELECT depth, code, descr, parent_depth, parent_code, first_path FROM fx_nodes")
def hierarchy_nodes(spark, d):
    return H.hierarchy_nodes(v.links(spark, d))


@query("SELECT parent_depth, parent_code, depth, code, first_path FROM fx_edges")
def hierarchy_edges(spark, d):
    return H.hierarchy_edges(v.links(spark, d))


@query("SELECT code, depth FROM fx_preorder QUALIFY row_number() OVER (PARTITION BY code ORDER BY place) = 1")
def find_node(spark, d):
    _, _, edges, levels = _all(spark, d)
    return H.find_nodes(edges, levels)


@query(
    "SELECT n.depth, n.code, n.parent_code, CASE WHEN n.parent_depth = -1 THEN NULL ELSE p.parent_code END AS grandparent_code, "
    "CASE WHEN n.parent_depth = -1 THEN 'ROOT/' || n.code WHEN p.parent_depth = -1 THEN 'ROOT/' || n.parent_code || '/' || n.code "
    "ELSE 'ROOT/' || p.parent_code || '/' || n.parent_code || '/' || n.code END AS root_path "
    "FROM fx_nodes n LEFT JOIN fx_nodes p ON n.parent_depth = p.depth AND n.parent_code = p.code"
)
def ancestors(spark, d):
    _, nodes, _, levels = _all(spark, d)
    return H.ancestors(nodes, levels)


v.VIEWS["fx_leaves"] = (
    "/*RECURSIVE*/SELECT depth, code, depth AS leaf_depth, code AS leaf_code FROM fx_edges e "
    "WHERE NOT EXISTS (SELECT 1 FROM fx_edges k WHERE k.parent_depth = e.depth AND k.parent_code = e.code) "
    "UNION SELECT e.parent_depth, e.parent_code, l.leaf_depth, l.leaf_code FROM fx_leaves l "
    "JOIN fx_edges e ON e.depth = l.depth AND e.code = l.code"
)


@query("SELECT depth, code, leaf_depth, leaf_code FROM fx_leaves")
def leaves(spark, d):
    _, _, edges, levels = _all(spark, d)
    return H.leaves(edges, levels)


@query("SELECT depth, code, count(*) AS n_leaves FROM fx_leaves WHERE leaf_depth = 2 GROUP BY depth, code")
def leaves_at_depth(spark, d):
    _, _, edges, levels = _all(spark, d)
    below = H.leaves_at_depth(H.leaves(edges, levels), 2)
    return below.groupBy("depth", "code").agg(F.count("*").alias("n_leaves"))


@query(
    "SELECT depth, code, parent_depth, parent_code, row_number() OVER (PARTITION BY parent_depth, parent_code ORDER BY first_path, depth, code) AS place, "
    "count(*) OVER (PARTITION BY parent_depth, parent_code) AS n_siblings FROM fx_edges"
)
def siblings(spark, d):
    _, nodes, edges, _ = _all(spark, d)
    return H.sibling_groups(nodes, edges)


v.VIEWS["fx_described"] = (
    "SELECT d.code, substr(d.code, 1, 3) AS category, "
    "coalesce(nullif(coalesce(g.descr, CASE WHEN p.parent_depth = -1 THEN 'ROOT' END), 'ROOT'), '') || ' ' || coalesce(p.descr, '') || ' ' || "
    "coalesce(n.descr, '') || ' ' || d.title AS label_text, "
    "n.descr IS NOT NULL AND p.descr IS NOT NULL AND (g.descr IS NOT NULL OR p.parent_depth = -1) AS covered FROM fx_dictionary d "
    "LEFT JOIN fx_nodes n ON n.code = substr(d.code, 1, 3) "
    "LEFT JOIN fx_nodes p ON p.depth = n.parent_depth AND p.code = n.parent_code "
    "LEFT JOIN fx_nodes g ON g.depth = p.parent_depth AND g.code = p.parent_code"
)


@query("SELECT code, category, label_text, covered FROM fx_described")
def describe_labels(spark, d):
    return H.describe_labels(v.dictionary(spark, d), v.links(spark, d))


@query(
    "SELECT count(*) AS n_categories, count(*) FILTER (NOT ok) AS n_uncovered FROM "
    "(SELECT category, bool_and(covered) AS ok FROM fx_described GROUP BY category)"
)
def coverage_report(spark, d):
    return H.coverage_report(H.describe_labels(v.dictionary(spark, d), v.links(spark, d)))


@query("SELECT row_number() OVER (ORDER BY code, label_text) - 1 AS label_id, code, label_text FROM fx_described")
def label_map_described(spark, d):
    return H.label_map("9", described=H.describe_labels(v.dictionary(spark, d), v.links(spark, d)))


@query(
    "SELECT row_number() OVER (ORDER BY code, label_text) - 1 AS label_id, code, label_text FROM "
    "(SELECT DISTINCT tgt AS code, title AS label_text FROM fx_map)"
)
def label_map_mapped(spark, d):
    return H.label_map("10", mapping=v.mapping(spark, d))
