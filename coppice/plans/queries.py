"""Registered queries: one per operator or step, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.operators.columns import clean_columns, split_columns
from coppice.operators.features import training_pair
from coppice.operators.folds import fold_split, partitions_by_rows, split_distribution, with_fold
from coppice.operators.forest import forest
from coppice.operators.labels import check_label, label_distribution
from coppice.operators.labels import label_profiles as profile_labels
from coppice.operators.metrics import accuracy, confusion, per_class, summary, weighted_f1
from coppice.operators.scoring import score, vote_arrays
from coppice.operators.search import Search
from coppice.plans.fixtures import ROW_KEY, document_quality, rule_predictions, separable, table
from coppice.plans.jobs import evaluate, score_job, train_job, train_table
from coppice.plans.jobs import training_metrics as metrics_of
from coppice.session import remove_folder, run_folder
from coppice.sources.delimited import read_delimited, widened, write_delimited
from coppice.sources.staged import stage_delimited
from coppice.sources.store import load_model, publish_model, save_model, write_metrics

# The fixture is learned exactly when every quantity has its own bin and every tree
# may split on it.
EXACT = {"maxBins": 64, "featureSubsetStrategy": "all"}
UNUSED = [*ROW_KEY, "l_extendedprice"]
PARALLELISM = 4
# Partitions of the stored training tables at least, more by the number of rows, so that results do not
# depend on the input's layout.
PARTITIONS = 8


def _untidy(names: list[str]) -> list[str]:
    """Header names in the three untidy styles: padded, quoted, upper case."""
    styles = (lambda n: f"  {n.title()} ", lambda n: f'"{n}"', str.upper)
    return [styles[i % 3](name) for i, name in enumerate(names)]


def _as_text(df: DataFrame, purpose: str) -> str:
    """Write as ``;`` text under untidy names; returns the path."""
    path = run_folder(df.sparkSession, purpose)
    write_delimited(df, path, names=_untidy(df.columns))
    return path


def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_columns(read_delimited(spark, _as_text(table(spark, sf_dir, "part"), "part")))


def scan_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return clean_columns(read_delimited(spark, _as_text(customer, "customer"), schema=customer.schema))


def scan_column_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text whose files order their columns differently."""
    supplier = table(spark, sf_dir, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    back = supplier.filter(~even).select(*reversed(supplier.columns))
    paths = [_as_text(supplier.filter(even), "supplier"), _as_text(back, "supplier-back")]
    return clean_columns(read_delimited(spark, paths, schema=supplier.schema))


def _kept(result: DataFrame, *folders: str) -> DataFrame:
    """A result of few rows, computed now, and the folders it came from removed."""
    spark = result.sparkSession
    rows = spark.createDataFrame(result.collect(), result.schema)
    for folder in folders:
        remove_folder(spark, folder)
    return rows


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_text(table(spark, sf_dir, "orders"), "orders")
    folder = run_folder(spark, "typed")
    orders = clean_columns(stage_delimited(spark, path, folder).rows)
    types = [F.max(F.typeof(name)).alias(name) for name in orders.columns]
    return _kept(orders.agg(F.count("*").alias("n_rows"), *types), path, folder)


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text whose types are found over its stored columns."""
    text = _as_text(table(spark, sf_dir, "orders"), "orders")
    return clean_columns(stage_delimited(spark, text, run_folder(spark, "typed")).rows)


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with rows that lack a field, have one too many, or a word for a number."""
    key = F.col("o_orderkey")
    fields = [key.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")]
    line = (
        F.when(key % 10 == 0, F.concat_ws(";", *fields[:2]))
        .when(key % 10 == 1, F.concat_ws(";", *fields, F.lit("more")))
        .when(key % 10 == 2, F.concat_ws(";", fields[0], F.lit("none"), fields[2]))
        .otherwise(F.concat_ws(";", *fields))
    )
    path, folder = run_folder(spark, "text"), run_folder(spark, "parted")
    # One column whose name is the header, so that lines are written as they are.
    lines = table(spark, sf_dir, "orders").select(line.alias("o_orderkey;o_custkey;o_orderstatus"))
    lines.write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    found = stage_delimited(spark, path, folder, schema=schema)
    numbers = [F.lit(found.n_rows).alias("n_rows"), F.lit(found.n_rejected).alias("n_rejected")]
    return found.rejected.select("line", "reason", *numbers)


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return clean_columns(supplier.toDF(*_untidy(supplier.columns)))


def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = separable(spark, sf_dir)
    features, label = split_columns(df, drop=UNUSED)
    return df.select(*features, label)


def assemble_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = separable(spark, sf_dir)
    features, label = split_columns(df, drop=UNUSED)
    pair = training_pair(df, features, label)
    values = pair.select(vector_to_array("features").alias("v"), F.col(label).cast("int").alias(label))
    return values.select(*[F.col("v")[i].alias(f"f{i}") for i in range(len(features))], label)


def label_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = label_distribution(table(spark, sf_dir, "labels"), "quality")
    cluster = label_distribution(table(spark, sf_dir, "embeddings"), "label")
    return quality.select(F.lit("quality").alias("source"), F.col("quality").alias("label"), "n").unionByName(
        cluster.select(F.lit("cluster").alias("source"), "label", "n")
    )


def label_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = separable(spark, sf_dir).select(
        F.col("quality").alias("good"),
        (F.col("l_extendedprice") - 50000).alias("price"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") * 3).alias("gaps"),
    )
    return profile_labels(candidates, candidates.columns).withColumnRenamed("label", "candidate")


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_fold(separable(spark, sf_dir), 5, ROW_KEY, salt="outer")
    return df.groupBy("fold").agg(F.count("*").alias("n"))


def fold_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_distribution(with_fold(separable(spark, sf_dir), 5, ROW_KEY, salt="outer"), "quality", 5)


def _rule_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(rule_predictions(spark, sf_dir), "label")


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_confusion(spark, sf_dir).select(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "n"
    )


def per_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(name, 6).alias(name) for name in ("precision", "recall", "f1")]
    return per_class(_rule_confusion(spark, sf_dir)).select(F.col("class").cast("int").alias("class"), "support", *rounded)


def weighted_f1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_f1(_rule_confusion(spark, sf_dir)).select(F.round("f1", 6).alias("f1"))


def accuracy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(_rule_confusion(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


def _fitted(spark: SparkSession, sf_dir: str, trees: int = 5, depth: int = 3, **params):
    """One forest on the whole fixture, and the vectors it was trained on with their keys."""
    rows = separable(spark, sf_dir)
    df = rows.repartition(partitions_by_rows(rows, PARTITIONS), *ROW_KEY)
    features, label = split_columns(df, drop=UNUSED)
    vectors = training_pair(df, features, label, check_label(df, label), keep=ROW_KEY)
    return forest(label, numTrees=trees, maxDepth=depth, **EXACT, **params).fit(vectors), vectors, features, label


def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, vectors, _, _ = _fitted(spark, sf_dir)
    return model.transform(vectors).select(*ROW_KEY, F.col("prediction").cast("int").alias("prediction"))


def forest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes in the leaves of trees with one split, where they are shares of the leaf's rows.

    Without bootstrap every tree sees all rows and splits above 35, so a leaf's shares
    follow from counts; over 35 all rows are of one class, below they are of two.
    """
    model, vectors, _, _ = _fitted(spark, sf_dir, trees=3, depth=1, bootstrap=False)
    votes = vote_arrays(model.transform(vectors))
    total = F.aggregate("rawPrediction", F.lit(0.0), lambda acc, x: acc + x)
    leaf = F.element_at(vector_to_array("features"), 1) > 35
    shares = [F.element_at("probability", c + 1) for c in (3, 5, 7)]
    return (
        votes.select(leaf.alias("above_35"), F.array(*shares).alias("share"), total.alias("total"), "rawPrediction")
        .groupBy("above_35")
        .agg(
            F.count("*").alias("n"),
            *[F.round(F.min(F.col("share")[i]), 6).alias(f"share_{c}") for i, c in enumerate((3, 5, 7))],
            *[F.round(F.max(F.col("share")[i]), 6).alias(f"highest_share_{c}") for i, c in enumerate((3, 5, 7))],
            F.round(F.min(F.element_at("rawPrediction", 6)), 6).alias("votes_5"),
            F.round(F.min("total"), 6).alias("vote_total"),
        )
    )


def _searched(df: DataFrame, trees: tuple[int, ...], depths: tuple[int, ...], **more) -> Search:
    """Search on the fixture or a part of it, with folds by row key."""
    return train_table(
        df,
        "quality",
        UNUSED,
        trees,
        depths,
        key=ROW_KEY,
        salt="inner",
        parallelism=PARALLELISM,
        partitions=partitions_by_rows(df, PARTITIONS),
        **EXACT,
        **more,
    )


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_scores(_searched(separable(spark, sf_dir), (3, 5), (1, 3)))


def nested_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid search from one fit per fold; no bootstrap, so that it equals separate fits."""
    return _map_scores(_searched(separable(spark, sf_dir), (3, 5), (1, 3), nested=True, bootstrap=False))


def resumed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of two maps, and one of four that finds these two in its ledger."""
    ledger = run_folder(spark, "ledger")
    rows = separable(spark, sf_dir)
    _searched(rows, (3,), (1, 3), ledger=ledger)
    found = _searched(rows, (3, 5), (1, 3), ledger=ledger)
    n_parts = spark.read.parquet(ledger).select("search", "fold", "settings", "entry").distinct().count()
    return _kept(_map_scores(found).withColumn("n_parts", F.lit(n_parts)), ledger)


def _map_scores(found: Search) -> DataFrame:
    return found.scores.select(
        F.col("numTrees").cast("int").alias("num_trees"),
        F.col("maxDepth").cast("int").alias("max_depth"),
        F.round("mean_f1", 6).alias("mean_f1"),
        F.round("std_f1", 6).alias("std_f1"),
        "is_best",
    )


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _searched(separable(spark, sf_dir), (1,), (1, 2)).fold_scores
    return scores.select(
        F.col("fold").cast("int").alias("fold"),
        F.col("maxDepth").cast("int").alias("max_depth"),
        F.round("f1", 6).alias("f1"),
    )


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a training run stores: a row per param map, and one per param map and fold."""
    path = run_folder(spark, "metrics")
    write_metrics(metrics_of(_searched(separable(spark, sf_dir), (3, 5), (1, 3))), path)
    stored = spark.read.json(path)
    one_stamp = F.min("run_ts").over(Window.partitionBy()) == F.max("run_ts").over(Window.partitionBy())
    rows = stored.select(
        "dataset",
        F.col("fold").cast("int").alias("fold"),
        F.col("numTrees").cast("int").alias("num_trees"),
        F.col("maxDepth").cast("int").alias("max_depth"),
        F.round("f1", 6).alias("f1"),
        F.round("std_f1", 6).alias("std_f1"),
        "is_best",
        one_stamp.alias("one_stamp"),
    )
    return _kept(rows, path)


def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_fold(separable(spark, sf_dir), 5, ROW_KEY, salt="outer", name="part")
    train, held_out = fold_split(df, 0, "part")
    return evaluate(_searched(train.drop("part"), (3, 5), (1, 3)).model, held_out, "quality")


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two reloaded models predict otherwise than the forest in memory does."""
    model, vectors, features, _ = _fitted(spark, sf_dir)
    bare, whole = run_folder(spark, "forest"), run_folder(spark, "model")
    model.write().overwrite().save(bare)
    loaded = {"bare forest": load_model(bare, features)}
    save_model(loaded["bare forest"], whole)
    loaded["whole model"] = load_model(whole)
    for folder in (bare, whole):
        remove_folder(spark, folder)
    values = [vector_to_array("features")[i].alias(name) for i, name in enumerate(features)]
    expected = model.transform(vectors).select(*values, F.col("prediction").alias("expected"))
    wrong = F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0)
    reports = [
        confusion(score(again, expected), "expected")
        .agg(F.sum("n").alias("n_rows"), F.sum(wrong).alias("n_differ"))
        .withColumn("loaded_from", F.lit(name))
        for name, again in loaded.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "metrics")
    for name in ("first", "second"):
        write_metrics(summary(_rule_confusion(spark, sf_dir)).withColumn("run", F.lit(name)), path)
    stored = spark.read.json(path).select(
        "run",
        "n_rows",
        F.round("f1", 6).alias("f1"),
        F.round("accuracy", 6).alias("accuracy"),
        F.col("run_ts").isNotNull().alias("is_stamped"),
    )
    return _kept(stored, path)


def metrics_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, one of which is written again by a driver that takes its first try for lost."""
    path = run_folder(spark, "metrics")
    for run in ("first", "second", "first"):
        write_metrics(summary(_rule_confusion(spark, sf_dir)), path, run_id=run)
    stored = spark.read.json(path)
    rounded = [F.round(name, 6).alias(name) for name in ("f1", "accuracy")]
    return _kept(stored.select("run_id", "n_rows", *rounded), path)


def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the scoring job stores, with the metrics it takes from them on their way."""
    model, _, features, _ = _fitted(spark, sf_dir)
    bare = run_folder(spark, "forest")
    model.write().overwrite().save(bare)
    published = run_folder(spark, "model")
    publish_model(load_model(bare, features), published, widened(separable(spark, sf_dir).schema))
    text, stored = _as_text(separable(spark, sf_dir), "scored"), run_folder(spark, "predictions")
    metrics = score_job(spark, text, published, predictions_path=stored).first()
    for folder in (bare, published, text):
        remove_folder(spark, folder)
    return spark.read.parquet(stored).select(
        *[F.col(name).cast("bigint").alias(name) for name in ROW_KEY],
        F.col("prediction").cast("int").alias("prediction"),
        F.size("probability").alias("n_classes"),
        F.lit(metrics.n_rows).alias("n_rows"),
        F.lit(metrics.f1).alias("f1"),
        F.lit(metrics.accuracy).alias("accuracy"),
    )


def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both jobs, with their default grid, over untidy text: fold 0 is the test file, fold
    1 the validation file."""
    part = F.col("part")
    dataset = F.when(part == 0, "test").when(part == 1, "validation").otherwise("train")
    rows = separable(spark, sf_dir)
    parted = with_fold(rows, 5, ROW_KEY, salt="outer", name="part").select(*rows.columns, dataset.alias("dataset"))
    folder = run_folder(spark, "text")
    write_delimited(parted, folder, names=[*_untidy(rows.columns), "dataset"], by=["dataset"])
    train, validation, test = (f"{folder}/dataset={name}" for name in ("train", "validation", "test"))
    model = run_folder(spark, "model")
    trained = train_job(
        spark,
        train,
        model,
        validation,
        drop=UNUSED,
        key=ROW_KEY,
        parallelism=PARALLELISM,
        partitions=partitions_by_rows(rows, PARTITIONS),
        **EXACT,
    )
    scored = score_job(spark, test, model)
    for path in (folder, model):
        remove_folder(spark, path)
    return trained.validation.withColumn("dataset", F.lit("validation")).unionByName(
        scored.withColumn("dataset", F.lit("test"))
    )


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(name, 6).alias(name) for name in ("distinct_share", "other_share")]
    return document_quality(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_distinct", *rounded, "quality")


def document_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search the default grid on documents outside fold 0, score those inside, and
    compare with the most frequent label of the others; labels are not separable."""
    df = with_fold(document_quality(spark, sf_dir), 5, ["doc_id"], salt="outer", name="part")
    train, held_out = fold_split(df, 0, "part")
    partitions = partitions_by_rows(table(spark, sf_dir, "labels"), PARTITIONS)
    found = train_table(
        train.drop("part"), "quality", (), key=["doc_id"], parallelism=PARALLELISM, partitions=partitions
    )
    scored = evaluate(found.model, held_out, "quality").first()
    counts = label_distribution(train, "quality")
    usual = counts.orderBy(F.desc("n"), "quality").first()["quality"]
    guessed = summary(confusion(held_out.withColumn("prediction", F.lit(usual)), "quality"))
    return guessed.select(
        F.lit(scored.n_rows).alias("n_rows"),
        F.round("f1", 6).alias("majority_f1"),
        (F.lit(scored.f1) > F.col("f1")).alias("forest_is_better"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_delimited": scan_delimited,
    "scan_with_schema": scan_with_schema,
    "scan_column_orders": scan_column_orders,
    "inferred_types": inferred_types,
    "staged_rows": staged_rows,
    "rejected_rows": rejected_rows,
    "clean_columns": clean_names,
    "feature_columns": feature_columns,
    "assemble_vector": assemble_vector,
    "label_distribution": label_distributions,
    "label_profile": label_profiles,
    "fold_counts": fold_counts,
    "fold_split_counts": fold_split_counts,
    "confusion": confusion_counts,
    "per_class_scores": per_class_scores,
    "weighted_f1": weighted_f1_score,
    "accuracy": accuracy_score,
    "forest_predict": forest_predict,
    "forest_vote": forest_vote,
    "grid_search": grid_search,
    "nested_search": nested_search,
    "resumed_search": resumed_search,
    "fold_scores": fold_scores,
    "training_metrics": training_metrics,
    "holdout_metrics": holdout_metrics,
    "model_round_trip": model_round_trip,
    "metrics_sink": metrics_sink,
    "metrics_by_run": metrics_by_run,
    "prediction_sink": prediction_sink,
    "train_and_score": train_and_score,
    "document_features": document_features,
    "document_quality": document_quality_scores,
}
