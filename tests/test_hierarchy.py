import pytest
from pyspark.sql import functions as F

from notecode.operators import hierarchy as H

PATHS = "path_ord long, links array<struct<code: string, descr: string>>"


@pytest.fixture
def links(spark):
    """Child c hangs below a and later below b; one link without a code."""
    paths = [
        (0, [("a", "A"), ("c", "C first"), ("l1", "")]),
        (1, [("b", "B"), ("d", None), ("l2", "L2")]),
        (2, [("b", "B"), ("c", "C later"), ("l3", "L3")]),
        (3, [("a", "A"), (None, "gap"), ("l4", "L4")]),
    ]
    return H.path_links(spark.createDataFrame(paths, PATHS))


def test_last_parent_wins_and_depth_is_kept(links, rows):
    nodes = rows(H.hierarchy_nodes(links), "depth", "code", "descr", "parent_code")
    assert (1, "c", "C first", "b") in nodes
    assert (2, "l4", "L4", "a") in nodes
    assert (2, "l1", "l1", "c") in nodes
    assert (1, "d", "d", "b") in nodes


def test_both_parents_list_the_child(links, rows):
    edges = H.hierarchy_edges(links).filter("code = 'c'")
    assert rows(edges, "parent_code") == [("a",), ("b",)]
    nodes = H.hierarchy_nodes(links)
    assert rows(H.siblings_of(nodes, H.hierarchy_edges(links), 1, "c"), "code") == [("c",), ("d",)]
    groups = H.sibling_groups(nodes, H.hierarchy_edges(links))
    assert rows(groups.filter("depth = 1"), "code", "parent_code", "place", "n_siblings") == [("c", "b", 2, 2), ("d", "b", 1, 2)]


def test_ancestors_and_leaves(links, rows):
    levels = H.tree_levels(links)
    up = H.ancestors(H.hierarchy_nodes(links), levels)
    found = {r["code"]: (r["parent_code"], r["grandparent_code"], r["root_path"]) for r in up.collect()}
    assert found["l1"] == ("c", "b", "ROOT/b/c/l1")
    assert found["l4"] == ("a", "ROOT", "ROOT/a/l4")
    assert found["a"] == ("ROOT", None, "ROOT/a")
    below = H.leaves(H.hierarchy_edges(links), levels)
    assert rows(below.filter("code = 'a'"), "leaf_code") == [("l1",), ("l3",), ("l4",)]
    assert rows(H.leaves_at_depth(below, 2).filter("code = 'd'"), "leaf_code") == [("l2",)]


def test_find_takes_first_in_depth_first_order(spark, rows):
    paths = [(0, [("a", "A"), ("x", "X")]), (1, [("b", "B"), ("q", "Q low"), ("y", "Y")]), (2, [("a", "A"), ("m", "M"), ("q", "Q deep")])]
    links = H.path_links(spark.createDataFrame(paths, PATHS))
    found = dict(rows(H.find_nodes(H.hierarchy_edges(links), H.tree_levels(links)), "code", "depth"))
    assert found["q"] == 2  # below a, which was seen before b, although on a later path


def test_describe_labels_keeps_spaces(spark, rows):
    paths = [(0, [("001-139", "Infections"), ("001-009", "Intestinal"), ("001", "Cholera")]), (1, [("V01", "Contact")])]
    links = H.path_links(spark.createDataFrame(paths, PATHS))
    words = spark.createDataFrame([("0010", "Cholera due"), ("V0179", "Viral"), ("999", "Odd")], "code string, title string")
    described = H.describe_labels(words, links)
    assert rows(described, "code", "label_text", "covered") == [
        ("0010", "Infections Intestinal Cholera Cholera due", True),
        ("999", "   Odd", False),
        ("V0179", "  Contact Viral", False),
    ]
    assert rows(H.coverage_report(described)) == [(3, 2)]
    numbered = H.label_map("9", described=described)
    assert rows(numbered, "label_id", "code") == [(0, "0010"), (1, "999"), (2, "V0179")]
    mapping = spark.createDataFrame([("a", "T1", "one"), ("b", "T1", "one"), ("c", "T2", None)], "src string, tgt string, title string")
    assert rows(H.label_map("10", mapping=mapping)) == [(0, "T1", "one")]
