import pytest
from pyspark.sql import functions as F

from notecode.functions import text as T


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_shortest_bracket_match_within_a_line(spark):
    assert apply(spark, T.strip_deid, "a [x] b [y] c", "a [x\ny] b", "a [x\ry] b") == ["a  b  c", "a [x\ny] b", "a  b"]


def test_phrases_go_in_order_and_inside_words(spark):
    assert apply(spark, T.strip_phrases, "T VIII", "an amount", "MD. Phone") == ["TII", "anount", "MD. "]


@pytest.mark.parametrize("mode,expected", [("regex", ["", " Drops"]), ("literal", ["0X5 % Drops ", " Drops"])])
def test_phrase_dots_are_wildcards_in_regex_mode_only(spark, mode, expected):
    assert apply(spark, lambda c: T.strip_phrases(c, mode=mode), "0X5 % Drops ", "ID Drops") == expected


def test_unknown_phrase_mode(spark):
    with pytest.raises(ValueError):
        T.strip_phrases(F.col("t"), mode="glob")


def test_normalise(spark):
    assert apply(spark, T.normalise_text, " a_b #3\nw/ 12٣\t c ", "") == ["ab with c", ""]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("Tuberculous peritonitis", "Tuberculous peritonitis"),
        ("Tuberculosis of eye, unspecified", "Tuberculosis of eye  unspecified"),
        ("Tuberculosis of (inner) (middle) ear", "Tuberculosis of (inner) (middle) ear"),
        ("Chronic myeloid leukemia, BCR/ABL-positive, in relapse", "Chronic myeloid leukemia  BCR ABL-positive  in relapse"),
        ("\t.a,,b* ", "a b"),
    ],
)
def test_clean_label(spark, raw, expected):
    assert apply(spark, T.clean_label, raw) == [expected]


def test_code_prefix(spark):
    assert apply(spark, T.code_prefix, "25001", "V1") == ["250", "V1"]
    assert apply(spark, lambda c: T.code_prefix(c, procedure=True), "3310") == ["33.1"]


def test_tokens_have_two_characters_or_more(spark):
    assert apply(spark, T.tokenize_words, "A bc, D_3 é ÉA x1-yz") == [["bc", "d_3", "éa", "x1", "yz"]]


def test_ngrams(spark):
    grams = apply(spark, lambda c: T.ngrams(F.split(c, " "), 3), "a b c", "a b", "a")
    assert grams == [["a", "b", "c", "a b", "b c", "a b c"], ["a", "b", "a b"], ["a"]]
    assert apply(spark, lambda c: T.ngrams(F.split(c, " "), 3, 2), "a b c") == [["a b", "b c", "a b c"]]


def test_extract_codes(spark):
    found = apply(spark, T.extract_ranged_code, "1. INFECTIONS, X (001-139)", "KIDNEY (V20)", "none")
    assert [tuple(f) for f in found] == [("001-139", "INFECTIONS, X "), ("V20", "KIDNEY "), (None, None)]
    found = apply(spark, T.extract_single_code, " 001.0 Cholera due", "none here")
    assert [tuple(f) for f in found] == [("001.0", "Cholera due"), (None, None)]
