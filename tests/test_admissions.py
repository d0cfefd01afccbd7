import pytest
from pyspark.sql import functions as F

from notecode.operators import admissions as A
from notecode.operators import sampling as S

NOTES = "row_id long, hadm_id long, category string, text string"
CODES = "hadm_id long, seq_num int, code string"


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(
        [(1, 1, "ECG", "same"), (2, 2, "ECG", "same"), (3, 2, "ECG", "b"), (4, 3, "ECG", "c"), (5, 1, "Echo", "d"), (6, 1, "Echo", "e")],
        NOTES,
    )


@pytest.fixture
def diag(spark):
    return spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 1, "x"), (3, 1, "z"), (1, 3, "w")], CODES)


@pytest.fixture
def proc(spark):
    return spark.createDataFrame([(1, 1, "p"), (2, 1, "q"), (9, 1, "r")], CODES)


def test_first_by_text_over_all_admissions(notes, rows):
    assert rows(A.first_by_text(notes), "row_id") == [(1,), (3,), (4,), (5,), (6,)]


def test_category_is_trimmed_and_checked(spark, rows):
    df = spark.createDataFrame([(1, 1, " ECG ", "a"), (2, 1, "Echo", "b")], NOTES)
    assert rows(A.filter_category(df, "ECG"), "row_id", "category") == [(1, "ECG")]
    with pytest.raises(ValueError):
        A.filter_category(df, "Poetry")


def test_admissions_need_note_diagnosis_and_procedure(notes, diag, proc, rows):
    built = A.build_admissions(notes, diag, proc)
    assert rows(built, "hadm_id", "text", "codes") == [(1, "same d e", "x,y,w"), (2, "same b", "x")]
    long = A.admission_codes(notes, diag, proc)
    assert rows(long) == [(1, "w"), (1, "x"), (1, "y"), (2, "x")]
    assert rows(A.build_admissions(notes, diag, proc, "proc"), "hadm_id", "codes") == [(1, "p"), (2, "q")]


def test_map_codes_inner_and_left(spark, rows):
    mapping = spark.createDataFrame([("a", "t2"), ("a", "t1"), ("b", "t1"), ("a", "t1")], "src string, tgt string")
    coded = spark.createDataFrame([(1, "a", "A"), (2, "zz", "Z")], "row_id long, code string, long_title string")
    mapped = A.map_codes(coded, A.map_sets(mapping))
    assert rows(mapped, "row_id", "targets", "long_title_source") == [(1, ["t1", "t2"], "A")]
    assert A.map_codes(coded, A.map_sets(mapping), "left").count() == 2
    assert rows(A.mapping_coverage(coded, mapping)) == [(2, 1, 2, 1)]
    assert rows(A.map_sets(mapping)) == [("a", ["t1", "t2"]), ("b", ["t1"])]


def test_label_matrix_ignores_unknown_codes_and_repeats(spark, rows):
    coded = spark.createDataFrame([(1, "a,b,a"), (2, "zz")], "row_id long, codes string")
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label_id long, code string")
    assert rows(A.label_matrix(coded, labels)) == [(1, 0), (1, 1)]


def test_top_codes_break_ties_by_code(spark, rows):
    codes = spark.createDataFrame([(1, 1, c) for c in "bbaac"], CODES)
    assert [tuple(r) for r in A.top_codes(codes, 2).collect()] == [("a", 2), ("b", 2)]


def test_one_hot_takes_last_text(notes, diag, rows):
    flags = A.one_hot_by_admission(notes, diag, ["x", "z"])
    assert rows(flags) == [(1, "e", True, False), (2, "b", True, False), (3, "c", False, True)]


def test_split_is_stable_under_repartitioning(spark, rows):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    sides = [S.split_train_test(df.repartition(n)) for n in (1, 17)]
    assert rows(sides[0][0]) == rows(sides[1][0])
    train, test = sides[0]
    assert train.count() + test.count() == 1000
    assert abs(2 * test.count() - train.count()) / train.count() < 0.5
    exact, rest = S.split_train_test(df, exact=True)
    assert (exact.count(), rest.count()) == (660, 340)
    assert rows(S.subsample(df.repartition(7), 5)) == rows(S.subsample(df.repartition(2), 5))


def test_dataset_checks(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (1, None, "x")], "k long, t string, e string")
    checks = dict((r[0], (r[1], r[2])) for r in A.dataset_checks(df, ["k", "t", "e"], ["k"], ["e"], min_rows=1).collect())
    assert checks == {
        "columns": (True, 0),
        "duplicates": (False, 1),
        "nulls": (False, 1),
        "empty_columns": (False, 1),
        "size": (True, 2),
    }


def test_rows_with_any_label(spark, rows):
    y = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "row_id long, code string")
    instances = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    wanted = spark.createDataFrame([("b",)], "code string")
    assert rows(A.rows_with_any_label(y, wanted, instances)) == [(2,)]
    stats = A.label_stats(y.withColumnRenamed("row_id", "hadm_id")).withColumn("mean_codes", F.round("mean_codes", 2))
    assert rows(stats) == [(2, 2, 2, 1.5)]
