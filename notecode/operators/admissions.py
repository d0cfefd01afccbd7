"""From notes and coded events to one text and one code list per admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.functions.text import join_codes
from notecode.operators.skew import skew_join

# The known note categories.
NOTE_CATEGORIES = (
    "Case Management",
    "Consult",
    "Discharge summary",
    "ECG",
    "Echo",
    "General",
    "Nursing",
    "Nursing/other",
    "Nutrition",
    "Pharmacy",
    "Physician",
    "Radiology",
    "Rehab Services",
    "Respiratory",
    "Social Work",
)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def filter_category(
    notes: DataFrame, category: str, known: Sequence[str] = NOTE_CATEGORIES, column: str = "category"
) -> DataFrame:
    """Notes whose trimmed category equals ``category``, which must be a known one."""
    if category not in known:
        raise ValueError(f"unknown note category {category!r}; known: {list(known)}")
    return notes.withColumn(column, F.trim(column)).filter(F.col(column) == category)


def first_by_text(notes: DataFrame, text: str = "text", order: str = "row_id") -> DataFrame:
    """Keep the first row of each distinct text, over all admissions. ``order`` must be unique.

    Only a digest and the row id are shuffled to find the first copies, combined before the
    shuffle: copies of one text cost one row per input partition, however many there are.
    """
    firsts = notes.groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min(order).alias(order))
    return notes.join(firsts.select(order), order, "left_semi")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _ordered(columns: Sequence[str], value: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(*columns, value)))
    return F.transform(rows, lambda r: r[value])


def concat_notes(notes: DataFrame) -> DataFrame:
    """Space-join texts and categories of each admission in row order: (hadm_id, text, category)."""
    rows = F.sort_array(F.collect_list(F.struct("row_id", "text", "category")))
    joined = notes.groupBy("hadm_id").agg(rows.alias("_rows"))
    return joined.select(
        "hadm_id",
        F.array_join(F.transform("_rows", lambda r: r["text"]), " ").alias("text"),
        F.array_join(F.transform("_rows", lambda r: r["category"]), " ").alias("category"),
    )


def codes_per_admission(codes: DataFrame) -> DataFrame:
    """Comma list of the codes of each admission by sequence number: (hadm_id, codes)."""
    return codes.groupBy("hadm_id").agg(join_codes(_ordered(["seq_num"], "code")).alias("codes"))


def _complete(chosen: DataFrame, other: DataFrame) -> DataFrame:
    """Codes of the admissions that have codes of both kinds."""
    return chosen.join(other.select("hadm_id").distinct(), "hadm_id", "left_semi")


def _kinds(diag: DataFrame, proc: DataFrame, which: str) -> tuple[DataFrame, DataFrame]:
    if which not in ("diag", "proc"):
        raise ValueError(f"which must be 'diag' or 'proc', not {which!r}")
    return (diag, proc) if which == "diag" else (proc, diag)


def build_admissions(notes: DataFrame, diag: DataFrame, proc: DataFrame, which: str = "diag") -> DataFrame:
    """Text and codes of the chosen kind per admission: (hadm_id, text, category, codes).

    Only admissions with a note, a diagnosis and a procedure are kept, whichever kind is chosen. An
    admission is one record here and so must fit in memory; ``admission_codes`` and the notes
    themselves are the long forms of the same data.
    """
    both = _complete(*_kinds(diag, proc, which))
    return concat_notes(notes).join(codes_per_admission(both), "hadm_id")


def admission_codes(notes: DataFrame, diag: DataFrame, proc: DataFrame, which: str = "diag") -> DataFrame:
    """The codes of ``build_admissions`` as rows (hadm_id, code), nothing gathered."""
    both = _complete(*_kinds(diag, proc, which))
    return both.join(notes.select("hadm_id").distinct(), "hadm_id", "left_semi").select("hadm_id", "code").distinct()


def map_sets(mapping: DataFrame) -> DataFrame:
    """Sorted set of targets of each source code: (src, targets)."""
    return mapping.groupBy("src").agg(F.sort_array(F.collect_set("tgt")).alias("targets"))


def map_codes(coded: DataFrame, sets: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the target set of each row's code; codes without a target drop out (or stay, with ``left``)."""
    mapped = skew_join(coded, sets.withColumnRenamed("src", "code"), ["code"], how)
    renames = {"long_title": "long_title_source"} if "long_title" in mapped.columns else {}
    return mapped.withColumnsRenamed(renames)


def mapping_coverage(coded: DataFrame, mapping: DataFrame) -> DataFrame:
    """How many distinct codes, and how many rows, have a target."""
    per_code = coded.groupBy("code").agg(F.count("*").alias("_rows"))
    known = mapping.select(F.col("src").alias("code")).distinct().withColumn("_known", F.lit(True))
    marked = per_code.join(known, "code", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return marked.agg(
        F.count("*").alias("n_codes"),
        F.count_if("_known").alias("n_mapped_codes"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_rows"))), F.lit(0)).alias("n_mapped_rows"),
    )


def label_matrix(coded: DataFrame, labels: DataFrame) -> DataFrame:
    """Binary label matrix (row_id, label_id) from a comma list in ``codes``.

    Codes outside the dictionary ``labels`` (label_id, code) are ignored and repeats count once.
    Rows without a known code are simply absent here; the table of instances keeps them.
    """
    exploded = coded.select("row_id", F.explode(F.split("codes", ",")).alias("code")).distinct()
    return labels_of_codes(exploded, labels)


def labels_of_codes(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """Binary label matrix (row_id, label_id) from rows (row_id, code)."""
    exploded = codes.select("row_id", "code")
    return skew_join(exploded, labels.select("label_id", "code"), ["code"]).select("row_id", "label_id").distinct()


def notes_with_codes(notes: DataFrame, codes: DataFrame) -> DataFrame:
    """One row per (note, code) of the same admission, without null rows."""
    complete = drop_missing(notes, ["hadm_id", "text"])
    return skew_join(complete, drop_missing(codes, ["hadm_id", "code"]), ["hadm_id"])


def top_codes(codes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most common codes; equal counts in code order."""
    return codes.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(n)


def rows_with_any_label(y: DataFrame, labels: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances that carry at least one of ``labels``."""
    key = [c for c in labels.columns if c in y.columns]
    hits = skew_join(y, labels.select(*key).distinct(), key, "left_semi")
    return instances.join(hits.select("row_id").distinct(), "row_id", "left_semi")


def indicator_columns(coded: DataFrame, codes: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """A 0/1 column per chosen code, in the given order, from a comma list in ``codes``."""
    listed = F.split("codes", ",")
    flags = {name: F.array_contains(listed, code).cast("int") for name, code in zip(names or codes, codes)}
    return coded.withColumns(flags)


def one_hot_by_admission(
    notes: DataFrame, codes: DataFrame, values: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """One boolean column per code and the last note text of each admission that has one of the codes."""
    flags = [F.coalesce(F.bool_or(F.col("code") == v), F.lit(False)).alias(n) for v, n in zip(values, names or values)]
    hot = codes.filter(F.col("code").isin(list(values))).groupBy("hadm_id").agg(*flags)
    last = drop_missing(notes, ["hadm_id", "text"]).groupBy("hadm_id").agg(F.max("row_id").alias("row_id"))
    texts = notes.select("row_id", "text").join(last.join(hot, "hadm_id"), "row_id")
    return texts.select("hadm_id", "text", *(names or values))


def label_stats(codes: DataFrame) -> DataFrame:
    """Number of codes, of coded instances, and the largest number of distinct codes of one instance."""
    pairs = codes.select("hadm_id", "code").distinct()
    per_instance = pairs.groupBy("hadm_id").agg(F.count("*").alias("n"))
    n_codes = pairs.select("code").distinct().agg(F.count("*")).scalar()
    return per_instance.agg(
        n_codes.alias("n_codes"),
        F.count("*").alias("n_instances"),
        F.max("n").alias("max_codes"),
        F.avg("n").alias("mean_codes"),
    )


def dataset_checks(
    df: DataFrame,
    expected_columns: Sequence[str],
    keys: Sequence[str],
    empty_columns: Sequence[str] = (),
    min_rows: int = 100,
) -> DataFrame:
    """Data-contract checks as a table (check, passed, detail): columns, duplicates, nulls, size."""
    known = [c for c in expected_columns if c in df.columns]
    must_fill = [c for c in known if c not in empty_columns]
    nulls = F.lit(False)
    for c in must_fill:
        nulls = nulls | F.col(c).isNull()
    filled = F.lit(False)
    for c in empty_columns:
        filled = filled | F.col(c).isNotNull()
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("_rows"), F.count_if(nulls).alias("_nulls"), F.count_if(filled).alias("_filled")
    )
    totals = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum("_filled"), F.lit(0)).alias("filled"),
    )
    missing = len(set(expected_columns) - set(df.columns)) + len(set(df.columns) - set(expected_columns))
    checks = [
        ("columns", F.lit(missing == 0), F.lit(missing).cast("long")),
        ("duplicates", F.col("duplicates") == 0, F.col("duplicates")),
        ("nulls", F.col("nulls") == 0, F.col("nulls")),
        ("empty_columns", F.col("filled") == 0, F.col("filled")),
        ("size", F.col("rows") > min_rows, F.col("rows")),
    ]
    rows = [F.struct(F.lit(c).alias("check"), p.alias("passed"), d.cast("long").alias("detail")) for c, p, d in checks]
    return totals.select(F.inline(F.array(*rows)))
