"""From raw documents to packed training sequences, one operator after another."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import decontaminate, lines, packing, quality, shared, simhash
from netlens.llm.queries import tokenizer_path

#: Word shingles of the near-duplicate stage.
SHINGLE = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 1/2 or more)."""
    labels = _table(spark, sf_dir, "labels")
    machine = quality.train(_table(spark, sf_dir, "documents"), labels.where(~quality.held_out()))
    name = shared.free_name(docs.columns, "_score")
    return quality.score(docs, machine, to=name).where(F.col(name) >= 0.5).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier place has; ``n_chars`` follows."""
    out = lines.dedup(docs)
    removed = F.col(out.columns[-1])
    return out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return simhash.kept(docs, shingle=SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, piece by piece, with the ids themselves."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminated),
    ("retrieval_packing", packed),
]

#: Packing and fingerprints cannot be said in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and
    read again."""
    folder = f"{shared.shared_folder(spark).rstrip('/')}/netlens-pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, numbered: tuple) -> DataFrame:
        number, (_, function) = numbered
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        return spark.read.parquet(f"{folder}/{number}")

    return reduce(step, enumerate(STAGES), _table(spark, sf_dir, "documents"))
