"""TF-IDF features, row normalisation and feature concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notecode.functions.text import ngrams, tokenize_words
from notecode.operators.skew import hottest, number_rows, skew_join


def term_counts(texts: DataFrame, longest: int = 1) -> DataFrame:
    """Occurrences of each term (word or n-gram) in each row: (row_id, term, n)."""
    terms = texts.select("row_id", F.explode(ngrams(tokenize_words(F.col("text")), longest)).alias("term"))
    return terms.groupBy("row_id", "term").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """In how many rows each term occurs: (term, df)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(frequency: DataFrame, n_rows: Column, min_df: int = 1) -> DataFrame:
    """Smooth inverse document frequency ``ln((1+n)/(1+df)) + 1``: (term, df, idf)."""
    weight = F.log((n_rows + F.lit(1.0)) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)
    return frequency.filter(F.col("df") >= min_df).select("term", "df", weight.alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Counts times idf, unit length per row: (row_id, col_id, val). Terms without a weight drop out.

    The terms of most rows are salted in the join; ``df`` already tells which ones they are.
    """
    hot = hottest(weights, ["term"], "df")
    joined = skew_join(counts, weights.select("term", "idf"), ["term"], hot=hot)
    raw = joined.select("row_id", F.col("term").alias("col_id"), (F.col("n") * F.col("idf")).alias("val"))
    return normalize_rows(raw)


def fit_tfidf(train: DataFrame, longest: int = 1, min_df: int = 1) -> DataFrame:
    """Term weights learnt from the training rows (row_id, text); empty texts count as rows."""
    n_rows = train.agg(F.count("*")).scalar()
    return idf(document_frequency(term_counts(train, longest)), n_rows, min_df)


def normalize_rows(x: DataFrame, norm: str = "l2", row: str = "row_id") -> DataFrame:
    """Scale each row to unit length (l2) or unit absolute sum (l1); rows of zeros are unchanged.

    A window sums up each row, so the input is computed and shuffled once.
    """
    if norm == "l2":
        size = F.sqrt(F.sum(F.col("val") * F.col("val")).over(W.partitionBy(row)))
    elif norm == "l1":
        size = F.sum(F.abs("val")).over(W.partitionBy(row))
    else:
        raise ValueError(f"norm must be 'l1' or 'l2', not {norm!r}")
    scaled = F.coalesce(F.col("val") / F.nullif(F.col("_norm"), F.lit(0.0)), F.col("val"))
    return x.withColumn("_norm", size).withColumn("val", scaled).select(*x.columns)


def hstack(left: DataFrame, right: DataFrame, offset: int) -> DataFrame:
    """Put the columns of ``right`` behind the ``offset`` columns of ``left``."""
    return left.unionByName(right.withColumn("col_id", F.col("col_id") + F.lit(offset)))


def feature_format(code: int, x1: DataFrame | None, x2: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """Combine two feature sets.

    ``code % 3``: 0 joins both after normalising each, 1 takes the first, 2 the second.
    ``code // 3 == 0``: the result is normalised once more.
    """
    kind = code % 3
    needed = {0: (x1, x2), 1: (x1,), 2: (x2,)}[kind]
    if any(x is None for x in needed):
        raise ValueError(f"feature format {code} lacks an input")
    x = hstack(normalize_rows(x1), normalize_rows(x2), offset) if kind == 0 else needed[0]
    return normalize_rows(x) if code // 3 == 0 else x


def vocabulary(frequency: DataFrame, first_id: int = 0) -> DataFrame:
    """Number the terms in sorted order: (term, id, df)."""
    return number_rows(frequency, [F.col("term")], "id", first_id)


def encode_tokens(
    texts: DataFrame,
    vocab: DataFrame,
    max_len: int,
    pad_left: bool = False,
    pad_id: int = 0,
    begin_id: int = 1,
    end_id: int = 2,
    unknown_id: int = 3,
    pad_segment: int = 0,
) -> DataFrame:
    """Word ids between a begin and an end id, cut and padded to ``max_len``.

    Returns (row_id, input_ids, attention_mask, token_type_ids, length); ``length`` is the number of
    ids before padding. Words are cut before they are looked up, so a row never gathers more than
    ``max_len`` ids, whatever the length of its text.
    """
    kept = texts.select("row_id", F.slice(tokenize_words(F.col("text")), 1, max_len - 2).alias("words"))
    words = kept.select("row_id", F.posexplode("words").alias("pos", "term"))
    known = skew_join(words, vocab.select("term", "id"), ["term"], "left", hot=hottest(vocab, ["term"], "df"))
    found = F.coalesce(F.col("id"), F.lit(unknown_id)).cast("int")
    ids = known.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", found.alias("id")))).alias("_ids"))
    body = F.coalesce(F.transform("_ids", lambda e: e["id"]), F.array().cast("array<int>"))
    encoded = kept.select("row_id").join(ids, "row_id", "left").select(
        "row_id", F.concat(F.array(F.lit(begin_id)), body, F.array(F.lit(end_id))).alias("ids")
    )
    length = F.size("ids")

    def padded(values: Column, filler: int) -> Column:
        pad = F.array_repeat(F.lit(filler), F.lit(max_len) - length)
        return F.concat(pad, values) if pad_left else F.concat(values, pad)

    return encoded.select(
        "row_id",
        padded(F.col("ids"), pad_id).alias("input_ids"),
        padded(F.array_repeat(F.lit(1), length), 0).alias("attention_mask"),
        padded(F.array_repeat(F.lit(0), length), pad_segment).alias("token_type_ids"),
        length.alias("length"),
    )


def length_stats(encoded: DataFrame) -> DataFrame:
    return encoded.agg(
        F.min("length").alias("min_len"),
        F.max("length").alias("max_len"),
        F.avg("length").alias("mean_len"),
        F.median("length").alias("median_len"),
    )
