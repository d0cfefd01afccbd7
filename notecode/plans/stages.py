"""The stages of a run. Each lands its tables in a folder, where the next stage reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.functions.text import clean_note, single_line
from notecode.operators import admissions as A
from notecode.operators import embedding, features, hierarchy, indexing, linear, sampling
from notecode.operators.evaluation import precision_recall_at_k
from notecode.operators.matrix import append_bias
from notecode.operators.skew import skew_join
from notecode.plans.config import RunConfig
from notecode.sources import files

BIAS_COLUMN = "(bias)"  # never a term: words have no parentheses


def clean_stage(notes: DataFrame, folder: str) -> DataFrame:
    """Clean the note texts once and land them: later stages read them several times."""
    cleaned = A.drop_missing(notes, ["hadm_id", "text"]).withColumn("text", clean_note(F.col("text")))
    cleaned.write.parquet(f"{folder}/notes")
    return notes.sparkSession.read.parquet(f"{folder}/notes")


def prepare_stage(
    notes: DataFrame,
    diag: DataFrame,
    proc: DataFrame,
    labels: DataFrame,
    config: RunConfig,
    folder: str,
    mapping: DataFrame | None = None,
) -> None:
    """Admissions, split, TF-IDF features and label matrix: train and test datasets in ``folder``.

    ``notes`` are cleaned, ``labels`` is the dictionary (label_id, code, label_text). Version 10 needs
    ``mapping`` (src, tgt): codes become their targets, and codes without a target drop out.
    """
    spark = notes.sparkSession
    chosen = A.first_by_text(A.filter_category(notes, config.category, config.categories))
    if config.sequence != "all":
        diag, proc = (codes.filter(F.col("seq_num") == int(config.sequence)) for codes in (diag, proc))
    codes = A.admission_codes(chosen, diag, proc, config.kind).withColumnRenamed("hadm_id", "row_id")
    if config.version == "10":
        if mapping is None:
            raise ValueError("version 10 needs an equivalence map")
        targets = mapping.select(F.col("src").alias("code"), "tgt").distinct()
        codes = skew_join(codes, targets, ["code"]).select("row_id", F.col("tgt").alias("code")).distinct()
    built = A.build_admissions(chosen, diag, proc, config.kind)
    built = built.select(F.col("hadm_id").alias("row_id"), single_line(F.col("text")).alias("text"), "codes")
    built.write.parquet(f"{folder}/admissions")
    rows = spark.read.parquet(f"{folder}/admissions")
    ids = rows.select("row_id").distinct()
    train, test = sampling.split_train_test(ids, config.train_fraction, config.seed)
    if config.subsample_train is not None:
        train = sampling.subsample(train, config.subsample_train, config.seed)
    if config.subsample_test is not None:
        test = sampling.subsample(test, config.subsample_test, config.seed)
    train.write.parquet(f"{folder}/train_ids")
    train = spark.read.parquet(f"{folder}/train_ids")
    texts = rows.filter(F.col("text").isNotNull()).select("row_id", "text")
    features.term_counts(texts, config.longest_ngram).write.parquet(f"{folder}/term_counts")
    counts = spark.read.parquet(f"{folder}/term_counts")
    train_counts = counts.join(train, "row_id", "left_semi")
    n_train = train.agg(F.count("*")).scalar()
    features.idf(features.document_frequency(train_counts), n_train, config.min_df).write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    y = A.labels_of_codes(codes, labels)
    for name, side in (("train", train), ("test", test)):
        x = features.tfidf(counts.join(side, "row_id", "left_semi"), terms)
        own = rows.join(side, "row_id", "left_semi")
        files.write_dataset(x, y.join(side, "row_id", "left_semi"), side, labels, f"{folder}/{name}", own)
        files.write_table(own, f"{folder}/{name}/table", "json", compression="gzip")


def train_stage(spark: SparkSession, config: RunConfig, folder: str, z_pred: DataFrame | None = None) -> linear.Model:
    """Label features, label tree and linear models from the train dataset; the model is stored.

    Label features are ``config.label_features``, of which "text" embeds the label texts. ``z_pred``
    (row_id, code, val) are scores of an external matcher for the schemes 0 and 2.
    """
    data = files.read_dataset(spark, f"{folder}/train")
    x, y, instances = data["X"], data["Y"], data["instances"]
    labels = data["label_map"].select("label_id")
    if config.label_features == "text":
        label_x = embedding.embed_text(data["label_map"].select("label_id", F.col("label_text").alias("text")))
    else:
        label_x = embedding.label_features(config.label_features, y, x)
    label_x.write.parquet(f"{folder}/label_features")
    depth = indexing.tree_depth(labels.count(), config.cluster_size, config.extra_depth)
    codes = indexing.index_labels(
        config.indexer,
        spark.read.parquet(f"{folder}/label_features"),
        depth=depth,
        seed=config.index_seed,
        max_iter=config.index_iterations,
        labels=labels,
    )
    codes.write.parquet(f"{folder}/codes")
    biased = append_bias(x, instances, config.bias, F.lit(BIAS_COLUMN)) if config.bias > 0 else x
    model = linear.train_model(
        biased,
        y,
        spark.read.parquet(f"{folder}/codes"),
        labels,
        instances,
        mode=config.mode,
        shallow=config.shallow,
        fit=config.fit,
        z_pred=z_pred,
        scheme=config.scheme,
        bias=config.bias,
        bias_col=BIAS_COLUMN,
    )
    files.save_model(model, f"{folder}/model", biased.select("col_id").distinct().count())
    return files.load_model(spark, f"{folder}/model")


def predict_stage(spark: SparkSession, config: RunConfig, folder: str, codes: DataFrame | None = None) -> DataFrame:
    """The best labels of every test instance: (row_id, label_id, score, rank).

    With ``codes`` (row_id, code, val), the cluster scores of an external matcher, only the bottom level
    of the model ranks the labels of those clusters. A model trained as a ranker needs them.
    """
    data = files.read_dataset(spark, f"{folder}/test")
    model = files.load_model(spark, f"{folder}/model")
    x, instances = data["X"], data["instances"]
    biased = append_bias(x, instances, model.bias, F.lit(model.bias_col)) if model.bias > 0 else x
    if codes is not None:
        model = linear.last_level(model)
    elif config.mode == "ranker":
        raise ValueError("a ranker needs cluster scores")
    pred = linear.predict_beam(
        biased, model, instances, config.beam, config.top_k, config.post, codes, blocks=True, max_depth=config.max_depth
    )
    pred.write.parquet(f"{folder}/predictions")
    return spark.read.parquet(f"{folder}/predictions")


def evaluate_stage(spark: SparkSession, config: RunConfig, folder: str) -> DataFrame:
    """Precision and recall of the stored predictions, also written as JSON."""
    data = files.read_dataset(spark, f"{folder}/test")
    pred = spark.read.parquet(f"{folder}/predictions").select("row_id", "label_id", "score")
    metrics = precision_recall_at_k(data["Y"], pred, data["instances"], config.depth)
    files.write_metrics(metrics, f"{folder}/metrics")
    return files.read_metrics(spark, f"{folder}/metrics")


def label_stage(
    dictionary: DataFrame | None, paths: DataFrame | None, config: RunConfig, mapping: DataFrame | None = None
) -> DataFrame:
    """The label dictionary with full label texts.

    Version 9 takes them from a code dictionary and a hierarchy, version 10 from ``mapping``
    (src, tgt, title).
    """
    if config.version == "10":
        return hierarchy.label_map("10", mapping=mapping)
    described = hierarchy.describe_labels(dictionary, hierarchy.path_links(paths), config.kind == "proc")
    return hierarchy.label_map("9", described=described)
