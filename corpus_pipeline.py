"""A training-corpus pipeline: five stages over documents, each written as Parquet and read by the next.

language ID -> exact dedup -> MinHash near-dedup -> benchmark decontamination -> mixing sources.
All but the last stage return the columns of documents; the last returns what the mix takes of each document.

Every stage: null texts count as empty where its operator says so; repeated rows, ties and texts of any length are
taken as the operator takes them; an empty table gives an empty one. Extra columns of documents go through as they
are, whatever their names, since operators see the columns they read under names of the stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from lanternfish.llm._shared import materialize

#: Similarity in percent from which the near-dedup stage links two documents; op8's own contract is 85.
NEAR_PERCENT = 80


def _masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns p0, p1, ... and the name of each column there."""
    names = {c: f"p{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def _marked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Masked docs with mark, a hash of doc_id and text: rows that differ in neither are one document."""
    rows, names = _masked(docs)
    return rows.withColumn("mark", F.xxhash64(F.col(names["doc_id"]).cast("long"), F.xxhash64(names["text"]))), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; what they reject goes. Learns from the stage's own input.

    Null texts and texts without a letter go. Where no row has a language to learn from, all documents go.
    """
    model = language_id.train(language_id.training_rows(docs.select("doc_id", "lang", "text")))
    rows, names = _masked(docs)
    return _named(language_id.identify(rows, model, names["text"]).filter(~F.col("rejected")), names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id; of repeated rows any one.

    Null and empty texts are one group.
    """
    rows, names = _masked(docs)
    return _named(exact_dedup.exact_dedup(rows, names["text"], names["doc_id"], keep_only=True), names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; of repeated rows any one.

    Documents without words, null texts among them, are in no group and stay, each one.
    """
    rows, names = _marked(docs)
    groups = near_dedup.near_dedup(docs.select("doc_id", "text"), percent=NEAR_PERCENT)
    mark = F.xxhash64(F.col("doc_id").cast("long"), "finger").alias("mark")
    first = groups.filter("kept AND group IS NOT NULL").select("group", mark).groupBy("group").agg(F.min("mark").alias("mark"))
    empty = ~F.coalesce(F.col(names["text"]), F.lit("")).rlike(mixing.WORD)
    some = rows.filter(~empty).join(first.select("mark").hint("shuffle_hash"), "mark", "left_semi").dropDuplicates(["mark"])
    return _named(some.unionByName(rows.filter(empty)), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts have none."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs.select("doc_id", "text"), bench)
    leaked = found.select(F.xxhash64(F.col("doc_id").cast("long"), "finger").alias("mark")).distinct()
    rows, names = _marked(docs)
    return _named(rows.join(leaked.hint("shuffle_hash"), "mark", "left_anti"), names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document that the mix takes words of."""
    return mixing.Mix(docs.select("doc_id", "text", "source")).counts().filter("taken > 0")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: Near duplicates and character models aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
