"""A corpus pipeline of five stages over ``documents``: toxicity, language, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; ``run`` writes each one's result as Parquet in the shared folder and reads it again as the next one's docs. All but the last return the columns of ``docs``, extra ones too. Models are fitted on the tables in ``sf_dir``, outside the held-out fold.

Defined cases: null texts are not toxic, have no language and so go in the second stage; rows are never changed, only kept or not; an empty table stays empty through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm import common, decontamination, language, near_duplicates, packing, queries, toxicity


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named p0, p1, ... so that none clashes with an operator's; and those names of its columns."""
    names = [f"p{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = queries.toxicity_model(spark, sf_dir)
    table, at = by_place(docs)
    first, *others = table.columns
    scored = toxicity.score(table, model, first, at["text"], tuple(others))
    return scored.where(F.col("score") < queries.TOXIC_FROM).select(table.columns).toDF(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart with a sufficient margin."""
    labelled = queries.table(spark, sf_dir, "documents").where(F.coalesce(queries.fold(), F.lit(0)) != queries.HELD_OUT)
    model = language.fit(labelled)
    table, at = by_place(docs)
    first, *others = table.columns
    told = language.predict(table, model, first, at["text"], tuple(others))
    return told.where("accepted").select(table.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id (one row of it, if rows repeat). Documents without an id stay."""
    table, at = by_place(docs)
    key, text = at["doc_id"], at["text"]
    classes = near_duplicates.near_duplicates(table, key, text)
    told = common.stage(classes.where(f"{key} is not null").groupBy(F.col(key).alias("told_id"), F.coalesce("node", F.lit(0)).alias("told_node")).agg(F.count("*").alias("n"), F.max(F.col(key) == F.col("class_id")).alias("kept")), "told")
    # only rows that may go, or repeat, are shuffled; a bounded bitmap tells the others
    node = F.coalesce(F.when(F.col(text).isNotNull(), near_duplicates.node_of(F.col(text))), F.lit(0))
    rows = table.withColumn("node", node).withColumn("row", F.xxhash64(key, "node"))
    marked = common.possible(rows, told.where("n > 1 or not kept").select(F.xxhash64("told_id", "told_node").alias("row")), "row", "doubtful")
    once = Window.partitionBy("told_id", "told_node").orderBy("told_id")
    doubtful = marked.where("doubtful").join(told.where("kept"), (F.col(key) == F.col("told_id")) & (F.col("node") == F.col("told_node"))).withColumn("place", F.row_number().over(once)).where("place = 1")
    sure = marked.where(f"not doubtful or {key} is null")
    return sure.select(table.columns).union(doubtful.select(table.columns)).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    table, at = by_place(docs)
    first, *others = table.columns
    found = decontamination.contamination(table, queries.table(spark, sf_dir, "benchmark"), first, at["text"], keep=tuple(others))
    return found.where(~F.col("contaminated")).select(table.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 2048 tokens mixed by source."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, 2048, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL expresses none of the stages' models; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages keep in the shared folder goes once their result is written; so does each result once the next one is."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.new_path(spark, f"pipeline-{name}")
        with common.scratch(spark):
            new = stage(spark, docs, sf_dir)
            new.write.parquet(path)
        if before:
            common.remove(spark, before)
        docs, before = spark.read.schema(new.schema).parquet(path), path
    return docs
