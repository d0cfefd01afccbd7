"""Files, checkpoints and a whole run from raw notes to metrics."""

import time

import pytest
from pyspark.sql import functions as F

from notecode.operators import indexing
from notecode.operators.linear import Fit
from notecode.plans import stages
from notecode.plans.config import RunConfig
from notecode.session import checkpoint_folder, scratch_path
from notecode.sources import files, pages, store


def test_checkpoint_folder_follows_the_session(spark):
    folder = checkpoint_folder(spark)
    assert scratch_path(spark, "t").startswith(folder)
    assert scratch_path(spark, "t") != scratch_path(spark, "t")


def test_notes_with_line_breaks(spark, tmp_path, rows):
    (tmp_path / "n.csv").write_text(
        "ROW_ID,SUBJECT_ID,HADM_ID,CHARTDATE,CHARTTIME,STORETIME,CATEGORY,DESCRIPTION,CGID,ISERROR,TEXT\n"
        '1,1,7,,,,ECG,,,,"two\nlines, ""quoted"""\n'
    )
    assert rows(files.read_notes(spark, str(tmp_path / "n.csv"))) == [(1, 7, "ECG", 'two\nlines, "quoted"')]


def test_codes_keep_leading_zeros_and_nan(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_text("ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,1,7,1,0066\n2,1,7,2,\n")
    assert rows(files.read_codes(spark, str(tmp_path / "c.csv"))) == [(7, 1, "0066"), (7, 2, "nan")]
    assert rows(files.read_codes(spark, str(tmp_path / "c.csv"), seq=1)) == [(7, 1, "0066")]


def test_equivalence_map_drops_blank_lines_and_dots(spark, tmp_path, rows):
    (tmp_path / "m.txt").write_text("011.93|A15.0|Tuberculosis of lung\n\n276.1|E87.1|Hyponatremia\n486|J18.9|\n")
    assert rows(files.read_equivalence_map(spark, str(tmp_path / "m.txt"))) == [
        ("01193", "A15.0", "Tuberculosis of lung"),
        ("2761", "E87.1", "Hyponatremia"),
    ]


def test_hierarchy_as_one_document(spark, tmp_path, rows):
    (tmp_path / "h.json").write_text('[[{"code": "a", "descr": "A", "depth": 1}, {"code": null}], [{"code": "b"}]]')
    got = files.read_hierarchy_array(spark, str(tmp_path / "h.json"))
    assert rows(got.select("path_ord", F.col("links.code"))) == [(0, ["a", None]), (1, ["b"])]


def test_sparse_lines(spark, tmp_path, rows):
    (tmp_path / "s.txt").write_text("3 2\n1 1:0.5 3:2\n-1\n0 2:0\n")
    instances, x = files.read_sparse_lines(spark, str(tmp_path / "s.txt"), skip_lines=1)
    assert rows(instances) == [(0, 1.0), (1, -1.0), (2, 0.0)]
    assert rows(x) == [(0, 0, 0.5), (0, 2, 2.0), (2, 1, 0.0)]
    _, nonzero = files.read_sparse_lines(spark, str(tmp_path / "s.txt"), skip_lines=1, keep_zeros=False)
    assert rows(nonzero) == [(0, 0, 0.5), (0, 2, 2.0)]


def test_line_numbers_continue_over_files(spark, tmp_path, rows):
    for i in range(3):
        (tmp_path / f"part-{i}").write_text("".join(f" line {i}.{j}\t\n" if j else "\n" for j in range(4)))
    texts = rows(files.read_raw_texts(spark, str(tmp_path)))
    assert [t[0] for t in texts] == sorted(range(12), key=lambda i: repr((i,)))
    assert dict(texts)[4] == "" and dict(texts)[11] == "line 2.3"


def test_page_links_and_first_pages(spark, rows):
    html = '<a href="/x">one</a> <a class="k" href="/y?z=1">two</a>'
    df = spark.createDataFrame(
        [(1, "http://h/a?p=1#t", html), (2, "https://other/a?p=1", html), (3, "http://h", "none")], "page_id long, url string, html string"
    )
    assert rows(pages.first_pages(df), "page_id", "page_key") == [(1, "/a?p=1"), (3, "?")]
    assert rows(pages.page_links(pages.first_pages(df))) == [(1, 0, "/x", "one"), (1, 1, "/y?z=1", "two")]
    odd = "<A id=k HREF='/q'><b>t</b> u</A> <a href=/bare title=x>v\nw</a> <abbr href='n'>z</abbr>"
    more = spark.createDataFrame([(7, "http://h", odd)], "page_id long, url string, html string")
    assert rows(pages.page_links(more)) == [(7, 0, "/q", "t u"), (7, 1, "/bare", "v\nw")]


def test_anchors_left_open_end_at_the_next(spark, rows):
    html = '<a href="1">one<li><a href="2">two</a><p><a href="3">three'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(pages.page_links(df)) == [(1, 0, "1", "one"), (1, 1, "2", "two"), (1, 2, "3", "three")]


def links_of(html, *rules):
    return pages.LinkReader(rules or (pages.LinkRule(),)).read(html)


def test_pages_without_what_is_no_link():
    html = """<!-- <a href=1>x</a> --><script>var t = "<a href='2'>y</a>";</script><style>a[href="3"] {}</style>
        <a href="/q?a=1&amp;b=2">R&amp;D &#169;<!-- z --><script>w</script></a><a name="n">no</a></i><a href>e</a>"""
    assert links_of(html) == [[("/q?a=1&b=2", "R&D ©"), ("", "e")]]
    assert links_of("<a href=1>open <b>bold") == [[("1", "open bold")]] and links_of("a < b") == [[]]


@pytest.mark.parametrize(
    ("select", "texts"),
    [
        ("li", ["one", "two", "three", "in"]),
        ("ul > li", ["one", "two", "three"]),
        ("div.k li, #m", ["three", "in", "end"]),
        ("div.k > ul li[data-x^=a]", ["three"]),
        ("body * > ol > li", ["in"]),
        ("[title='a b'], p.none", ["two"]),
        ("h1 li", []),
    ],
)
def test_selectors(select, texts):
    html = "<body><ul><li>one<li title='a b'>two</ul><div class='j k'><ul><li data-x=abc>three</ul><ol><li>in</ol></div><p id=m>end<br></body>"
    assert [text for _, text in links_of(html, pages.LinkRule(select))[0]] == texts


def test_text_of_a_rule_lies_in_its_links():
    html = "<div class=r><span>9</span><a href=x>t<span> u</span></a> v</div><span>w</span><div class=r><span>n</span></div>"
    assert links_of(html, pages.LinkRule(".r", "a"), pages.LinkRule("div", "span")) == [[("x", "t u"), (None, "")], [("x", "9 u"), (None, "n")]]


def test_unreadable_selectors_are_refused():
    for bad in ("", "a >", "a,,b", "a[", "a:first"):
        with pytest.raises(ValueError):
            pages.Selector(bad)


def test_rules_by_depth_with_the_next_as_fallback(spark, rows):
    html = "<h1>t</h1><a href=1>x</a>"
    given = [(1, html, 0), (2, html, 1), (3, html, 2), (4, html, None), (5, None, 0), (6, "", 0), (7, "<i>i</i>", 0)]
    df = spark.createDataFrame(given, "page_id long, html string, depth int")
    rules = [pages.LinkRule("h2"), pages.LinkRule("h1"), pages.LinkRule("a")]
    assert rows(pages.page_links(df, rules, "depth")) == [(1, 0, None, "t"), (2, 0, None, "t"), (3, 0, "1", "x")]
    assert rows(pages.page_links(df.limit(0))) == []


def test_long_pages_are_read_in_linear_time():
    began = time.monotonic()
    assert links_of("<b>" * 50_000 + "</i>" * 50_000 + "<a href=1>x") == [[("1", "x")]]
    assert len(links_of("<li><a href=1>x" * 50_000)[0]) == 50_000
    assert time.monotonic() - began < 20


def test_half_written_tables_are_not_read(spark, tmp_path, rows):
    folder = str(tmp_path / "set")
    good = spark.createDataFrame([(1, "a"), (2, None)], "row_id long, text string")
    broken = good.withColumn("text", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):
        store.publish({"first": good, "second": broken}, folder)
    assert store.published(spark, folder) == {}
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, folder)
    store.publish({"first": good, "second": good.limit(0)}, folder)
    read = store.published(spark, folder, check=True)
    assert rows(read["first"]) == rows(good) and rows(read["second"]) == []
    with pytest.raises(FileExistsError):
        store.publish({"first": good}, folder)
    read["second"].sparkSession.createDataFrame([(9, "x")], "row_id long, text string").write.mode("append").parquet(
        f"{folder}/{store.manifest(spark, folder).first()['part']}/first"
    )
    with pytest.raises(ValueError):
        store.published(spark, folder, check=True)


def test_content_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(i % 5, float(i)) for i in range(40)], "a long, b double")
    assert store.content_of(df) == store.content_of(df.repartition(7, "b").select("b", "a"))
    assert store.content_of(df) != store.content_of(df.filter("b < 39").unionByName(df.filter("b = 38")))


def test_cached_codes_follow_the_labels(spark, tmp_path, rows):
    folder, make = str(tmp_path / "codes"), lambda n: spark.range(n).selectExpr("id AS label_id", "0L AS col_id", "1D AS val")
    first = rows(indexing.cached_codes(spark, folder, make(8), "none", "random", seeds=(0, 1), depth=2))
    assert rows(indexing.cached_codes(spark, folder, make(8), "none", "random", seeds=(0, 1), depth=2)) == first
    assert len(list((tmp_path / "codes").iterdir())) == 2
    more = rows(indexing.cached_codes(spark, folder, make(9), "none", "random", seeds=(0,), depth=2))
    assert len(more) == 9 and len(list((tmp_path / "codes").iterdir())) == 3


def test_config_is_checked():
    for bad in ({"version": "11"}, {"kind": "x"}, {"version": "10", "kind": "proc"}, {"category": "Poetry"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.raises(ValueError):
        Fit("NEWTON")


@pytest.mark.parametrize("variant", ["9", "10", "ranker"])
def test_whole_run(spark, tmp_path, variant):
    """Texts name their codes, so a trained model must find them again, under the codes they map to."""
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "sigma"]
    note_rows, code_rows, proc_rows = [], [], []
    for i in range(120):
        a, b = i % 6, (i * 7 + 1) % 6
        note_rows.append((i, i, " Echo ", f"[**x**] {words[a]} {words[b]} note{'abcdefghij'[i % 10]} {words[a]} {'z' * (i + 2)}"))
        code_rows += [(i, 1, f"c{a}"), (i, 2, f"c{b}")]
        proc_rows.append((i, 1, "p"))
    notes = spark.createDataFrame(note_rows, "row_id long, hadm_id long, category string, text string")
    diag = spark.createDataFrame(code_rows, "hadm_id long, seq_num int, code string")
    proc = spark.createDataFrame(proc_rows, "hadm_id long, seq_num int, code string")
    mapping = spark.createDataFrame([(f"c{j}", f"t{j}", words[j]) for j in range(6)], "src string, tgt string, title string")
    labels = spark.createDataFrame([(j, f"c{j}", words[j]) for j in range(6)], "label_id long, code string, label_text string")
    config = RunConfig(
        version="10" if variant == "10" else "9", category="Echo", cluster_size=2, index_iterations=3, extra_depth=0,
        mode="ranker" if variant == "ranker" else "full-model", scheme=2 if variant == "ranker" else 1,
        label_features="text" if variant == "10" else "pifa", fit=Fit(threshold=0.01, max_iter=50), top_k=5, depth=5,
    )
    if variant == "10":
        labels = stages.label_stage(None, None, config, mapping)
    folder = str(tmp_path / "run")
    cleaned = stages.clean_stage(notes, folder)
    stages.prepare_stage(cleaned, diag, proc, labels, config, folder, mapping)
    given = None
    if variant == "ranker":  # an external matcher that names every cluster
        every = F.array(*[F.lit(c).cast("long") for c in range(2**2)])  # 6 labels, 2 to a cluster: a tree of depth 2
        given = notes.select(F.col("hadm_id").alias("row_id"), F.explode(every).alias("code"), F.lit(1.0).alias("val"))
        with pytest.raises(ValueError):
            stages.predict_stage(spark, config, folder) if stages.train_stage(spark, config, folder, given) else None
    else:
        model = stages.train_stage(spark, config, folder)
        assert model.depth == 2
    stages.predict_stage(spark, config, folder, given)
    data = files.read_dataset(spark, f"{folder}/test")
    assert data["texts"].count() == data["instances"].count()
    metrics = {r["k"]: r for r in stages.evaluate_stage(spark, config, folder).collect()}
    assert metrics[1]["precision"] > 0.8
    assert metrics[5]["recall"] > 0.8
