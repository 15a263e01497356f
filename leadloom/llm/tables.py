"""Reading the given tables and keeping intermediate ones in the shared folder."""

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import scratch_path, ship


#: Rows that a Python worker holds at once where texts are described; Spark's own default is ten times that.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """``(doc_id, text)`` alone, whatever other columns there are; a NULL text is empty."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )


def row_key():
    """A row's id and text as one hash: what rows that share an id are told apart by."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def unused(name: str, df: DataFrame) -> str:
    """A name that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of texts on their way to Python have at most ``BATCH_ROWS`` rows: a core holds one in the JVM's
    and in the worker's memory. The session's own bound holds again afterwards."""
    bound = spark.conf.get(_BATCH)
    if 0 < int(bound) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, bound)


def stored(df: DataFrame, name: str, small=False) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends there, a lost
    executor costs no recomputation, and the planner knows the size. ``small`` keeps the batches that go to Python small."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession) if small else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id, of: int):
    """crc32 of the id as text, modulo ``of``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of
