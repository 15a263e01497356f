"""Documents through quality, duplication and leak filters to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``docs``.
Labels and benchmark items are read from ``sf_dir``. What a stage does with NULL, empty and repeated
rows is stated by its operator.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import decontaminate, near_dedup, prefix_bpe, quality_pu, quality_rules
from leadloom.llm.tables import row_key, stored, table
from leadloom.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier takes for bad."""
    network = quality_pu.train(docs, table(spark, sf_dir, "labels"))
    return quality_pu.keep_good(docs, network)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or an accepted cut-off of their language rejects."""
    whole = F.struct(*docs.columns).alias("_row")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep=[whole])
    return judged.where("kept").select("_row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    folder = scratch_path(spark, "positional-index")
    # Rows are indexed by their keys, so that rows which share an id, or have none, are judged one by one.
    decontaminate.build(docs.withColumn("doc_id", row_key()), folder)
    found = decontaminate.contamination(decontaminate.read(spark, folder), table(spark, sf_dir, "benchmark"))
    return near_dedup.without_rows(docs, stored(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of the text they decode to."""
    return prefix_bpe.encode(docs, columns=("doc_id", "n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: No SQL expresses the trained classifier and the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs, stage):
        return stored(stage[1](spark, docs, sf_dir), "pipeline")

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
