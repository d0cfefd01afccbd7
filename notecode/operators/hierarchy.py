"""Code hierarchies given as root-to-leaf paths, and label texts built from them.

A node is (depth, code), where depth is the position in the path. Depth -1 is the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.functions.text import code_prefix
from notecode.operators.skew import number_rows, rank_in_groups

ROOT = "ROOT"
NODE = ["depth", "code"]
PARENT = ["parent_depth", "parent_code"]


def path_links(paths: DataFrame) -> DataFrame:
    """One row per link of each path (path_ord, links): (path_ord, depth, code, descr, parent_depth, parent_code).

    Links without a code are skipped but still count for the depth of the links behind them.
    """
    numbered = F.transform(
        "links",
        lambda link, i: F.struct(
            i.cast("int").alias("depth"),
            link["code"].alias("code"),
            F.coalesce(F.nullif(link["descr"], F.lit("")), link["code"]).alias("descr"),
        ),
    )
    kept = paths.select("path_ord", F.filter(numbered, lambda e: F.coalesce(e["code"], F.lit("")) != "").alias("kept"))
    root = F.struct(F.lit(-1).alias("depth"), F.lit(ROOT).alias("code"), F.lit(ROOT).alias("descr"))
    links = kept.select("path_ord", "kept", F.posexplode("kept").alias("pos", "link"))
    parent = F.when(F.col("pos") == 0, root).otherwise(F.get("kept", F.col("pos") - 1))
    return links.select(
        "path_ord",
        F.col("link.depth").alias("depth"),
        F.col("link.code").alias("code"),
        F.col("link.descr").alias("descr"),
        parent["depth"].alias("parent_depth"),
        parent["code"].alias("parent_code"),
    )


def hierarchy_nodes(links: DataFrame) -> DataFrame:
    """Nodes with the description of the first and the parent of the last path through them."""
    return links.groupBy(*NODE).agg(
        F.min_by("descr", "path_ord").alias("descr"),
        F.max_by(F.struct(*PARENT), "path_ord").alias("_parent"),
        F.min("path_ord").alias("first_path"),
    ).select(*NODE, "descr", "_parent.parent_depth", "_parent.parent_code", "first_path")


def hierarchy_edges(links: DataFrame) -> DataFrame:
    """Distinct parent-child links with the first path that has them. A node may have several parents here."""
    return links.groupBy(*PARENT, *NODE).agg(F.min("path_ord").alias("first_path"))


def tree_levels(links: DataFrame) -> int:
    """The largest depth: how many rounds a walk over the tree needs at most."""
    return (links.agg(F.max("depth")).first()[0] or 0) + 1


def preorder(edges: DataFrame, levels: int) -> DataFrame:
    """Sort key of each node in depth-first order, children in first-seen order: (depth, code, place).

    ``place`` is the array of sibling ordinals on the way down; a prefix sorts before its extensions.
    """
    frontier = edges.filter(F.col("parent_depth") == -1).select(*NODE, F.array("first_path").alias("place"))
    found = [frontier]
    for _ in range(levels - 1):
        above = frontier.select(F.col("depth").alias("parent_depth"), F.col("code").alias("parent_code"), "place")
        below = above.join(edges, PARENT).select(*NODE, F.concat("place", F.array("first_path")).alias("place"))
        frontier = below.groupBy(*NODE).agg(F.min("place").alias("place"))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).groupBy(*NODE).agg(F.min("place").alias("place"))


def find_nodes(edges: DataFrame, levels: int) -> DataFrame:
    """For every code the node that a depth-first search finds first: (code, depth)."""
    return preorder(edges, levels).groupBy("code").agg(F.min_by("depth", "place").alias("depth"))


def ancestors(nodes: DataFrame, levels: int) -> DataFrame:
    """Parent, grandparent and the path from the root, following the parent of each node."""
    walk = nodes.select(
        *NODE,
        *PARENT,
        F.col("parent_depth").alias("_at_depth"),
        F.col("parent_code").alias("_at_code"),
        F.array("code").alias("_path"),
    )
    up = nodes.select(
        F.col("depth").alias("_at_depth"),
        F.col("code").alias("_at_code"),
        F.col("parent_depth").alias("_next_depth"),
        F.col("parent_code").alias("_next_code"),
    )
    for _ in range(levels):
        walk = walk.join(up, ["_at_depth", "_at_code"], "left").select(
            *NODE,
            *PARENT,
            F.when(F.col("_at_code").isNotNull(), F.concat(F.array("_at_code"), "_path")).otherwise(F.col("_path")).alias("_path"),
            F.col("_next_depth").alias("_at_depth"),
            F.col("_next_code").alias("_at_code"),
        )
    grandparent = F.get("_path", F.size("_path") - 3)
    return walk.select(*NODE, "parent_code", grandparent.alias("grandparent_code"), F.array_join("_path", "/").alias("root_path"))


def leaves(edges: DataFrame, levels: int) -> DataFrame:
    """Every (node, leaf below it); a leaf is below itself: (depth, code, leaf_depth, leaf_code)."""
    inner = edges.select(F.col("parent_depth").alias("depth"), F.col("parent_code").alias("code")).distinct()
    leaf_nodes = edges.select(*NODE).distinct().join(inner, NODE, "left_anti")
    frontier = leaf_nodes.select(*NODE, F.col("depth").alias("leaf_depth"), F.col("code").alias("leaf_code"))
    found = [frontier]
    up = edges.select(*NODE, *PARENT)
    for _ in range(levels):
        frontier = (
            frontier.join(up, NODE)
            .select(F.col("parent_depth").alias("depth"), F.col("parent_code").alias("code"), "leaf_depth", "leaf_code")
            .distinct()
        )
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).distinct()


def leaves_at_depth(below: DataFrame, depth: int) -> DataFrame:
    return below.filter(F.col("leaf_depth") == depth)


def sibling_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The sibling list of each node in compact form: its parent, its place among the children, their number.

    The siblings of a node, itself included, are the edges with the same parent; they are not listed
    once per node, which would be quadratic in the number of children.
    """
    order = [F.col("first_path"), F.col("depth"), F.col("code")]
    placed = rank_in_groups(edges, PARENT, order, "place").select(*PARENT, *NODE, "place")
    sizes = edges.groupBy(*PARENT).agg(F.count("*").alias("n_siblings"))
    return nodes.select(*NODE, *PARENT).join(placed, [*PARENT, *NODE]).join(sizes, PARENT)


def siblings_of(nodes: DataFrame, edges: DataFrame, depth: int, code: str) -> DataFrame:
    """The children of one node's parent, the node included; nothing for the root."""
    here = nodes.filter((F.col("depth") == depth) & (F.col("code") == code)).select(*PARENT)
    return edges.join(here, PARENT, "left_semi").select(*NODE)


def describe_labels(dictionary: DataFrame, links: DataFrame, procedure: bool = False) -> DataFrame:
    """Full label text of each code of the dictionary (code, title).

    The text is grandparent, parent and category description, then the title, joined by single
    spaces; a description that is missing or the root leaves its place empty but keeps the space.
    ``covered`` tells whether all three descriptions were found.
    """
    nodes = hierarchy_nodes(links)
    first = find_nodes(hierarchy_edges(links), tree_levels(links))
    by_node = nodes.select(*NODE, F.col("descr").alias("cat"), *PARENT)
    up = nodes.select(
        F.col("depth").alias("parent_depth"),
        F.col("code").alias("parent_code"),
        F.col("descr").alias("_above"),
        F.col("parent_depth").alias("_next_depth"),
        F.col("parent_code").alias("_next_code"),
    )
    top = nodes.select(F.col("depth").alias("_next_depth"), F.col("code").alias("_next_code"), F.col("descr").alias("_top"))
    found = first.join(by_node, NODE).join(up, PARENT, "left").join(top, ["_next_depth", "_next_code"], "left")
    categories = found.select(
        F.col("code").alias("category"),
        "cat",
        F.when(F.col("parent_depth") == -1, F.lit(ROOT)).otherwise(F.col("_above")).alias("_parent"),
        F.when(F.col("_next_depth") == -1, F.lit(ROOT)).otherwise(F.col("_top")).alias("_grandparent"),
    )

    def shown(column: str) -> Column:
        value = F.coalesce(column, F.lit(""))
        return F.when(value == ROOT, F.lit("")).otherwise(value)

    labelled = dictionary.withColumn("category", code_prefix(F.col("code"), procedure)).join(categories, "category", "left")
    title = F.concat(
        shown("_grandparent"), F.lit(" "), shown("_parent"), F.lit(" "), F.coalesce("cat", F.lit("")), F.lit(" "), "title"
    )
    raw_grandparent = F.coalesce("_grandparent", F.lit(""))
    covered = (F.coalesce("cat", F.lit("")) != "") & (shown("_parent") != "") & (raw_grandparent != "")
    return labelled.select("code", "category", title.alias("label_text"), covered.alias("covered"))


def coverage_report(described: DataFrame) -> DataFrame:
    """How many categories lack a description on some level."""
    per_category = described.groupBy("category").agg(F.bool_and("covered").alias("_covered"))
    return per_category.agg(F.count("*").alias("n_categories"), F.count_if(~F.col("_covered")).alias("n_uncovered"))


def label_map(version: str, described: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """The label dictionary (label_id, code, label_text), numbered in code order.

    Version 9 takes described codes, version 10 the distinct, complete (tgt, title) rows of the
    equivalence map.
    """
    if version == "9":
        rows = described.select("code", "label_text")
    elif version == "10":
        rows = mapping.select(F.col("tgt").alias("code"), F.col("title").alias("label_text")).distinct().na.drop()
    else:
        raise ValueError(f"version must be '9' or '10', not {version!r}")
    return number_rows(rows, [F.col("code"), F.col("label_text")], "label_id").select("label_id", "code", "label_text")
