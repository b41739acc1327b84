"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the shared folder and
reads them again for the next. All but the last return the columns of ``documents``; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontam, jaccard, mixing, secrets, toxicity
from gneiss.llm.common import materialize, small

#: Stages that train or sample aren't expressible in SQL; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from the labels of the rows it is given."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the least id. Documents without words or id stay. Rows that repeat
    an id are documents of their own, judged each by its text."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        gone = jaccard.join(docs).where("doc_id is not null and n_shingles > 0 and component_id <> doc_id").select("doc_id")
        gone = materialize(gone, "duplicates")
        return docs.join(small(gone, gone.count(), 1_000_000), "doc_id", "left_anti").select(*docs.columns)
    # Numbers in the order of ids and texts take the place of the ids.
    number = "row_number"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    rows = materialize(docs.where("doc_id is not null").orderBy("doc_id", "text").withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = jaccard.join(rows.select(F.col(number).alias("doc_id"), "text")).where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias(number))
    gone = materialize(gone, "duplicates")
    kept = rows.join(small(gone, gone.count(), 1_000_000), number, "left_anti")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by their kinds."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each: the whole text ``repeats`` times, and its first
    ``taken - repeats * size`` words once more (only at the edge of a source's last repetition)."""
    plan = mixing.mix(docs, whole_rows=True)
    repeats = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("long")
    return plan.where("taken > 0").withColumn("repeats", repeats)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
