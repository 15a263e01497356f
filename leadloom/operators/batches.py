"""Tables made of batches, each of which appears whole and can be replaced whole.

A batch is written to a folder of its own attempt, ``batch_id=B/attempt=A``, which readers do not look at until a
commit names it: one row, added to ``_commits`` as one file, which is there or not. A batch that is written again gets
another attempt, and the newest commit counts, so at any moment a reader sees the old batch or the new one.
Files without an attempt (written by other programs) are always seen, unless their batch has a commit.
"""

import uuid
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

_COMMITS = "batch string, attempt string, version bigint"


def _folder(path, batch, attempt):
    return f"{path.rstrip('/')}/batch_id={quote(str(batch), safe='')}/attempt={attempt}"


def read_files(spark, path, schema):
    """All files under a path; None where there is no such path."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stage(df, path, batch):
    """Writes an attempt at a batch, which nobody sees yet. Returns its name."""
    attempt = uuid.uuid4().hex
    df.write.parquet(_folder(path, batch, attempt))
    return attempt


def commits(spark, path):
    """``(batch, attempt, version)``: the attempt that counts for each batch."""
    found = read_files(spark, f"{path.rstrip('/')}/_commits", _COMMITS)
    if found is None:
        return spark.createDataFrame([], _COMMITS)
    newest = F.max_by(F.struct("attempt", "version"), "version").alias("newest")
    return found.groupBy("batch").agg(newest).select("batch", "newest.*")


def commit(spark, path, batch, attempt):
    """From now on readers see this attempt at the batch and no other."""
    last = commits(spark, path).agg(F.max("version")).first()[0]
    row = spark.createDataFrame([(str(batch), attempt, 1 + (last or 0))], _COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/_commits")


def write_batch(df, path, batch):
    """Adds a batch, or replaces the one of the same name."""
    commit(df.sparkSession, path, batch, stage(df, path, batch))


def read_batches(spark, path, schema, skip=None):
    """The rows of all batches but ``skip``, or None where nothing was ever written."""
    rows = read_files(spark, path, schema)
    if rows is None:
        return None
    place = F.col("_metadata.file_path")
    batch = F.url_decode(F.url_decode(F.regexp_extract(place, "/batch_id=([^/]*)/", 1)))
    rows = rows.select("*", batch.alias("_batch"), F.regexp_extract(place, "/attempt=([^/]*)/[^/]*$", 1).alias("_attempt"))
    counts = commits(spark, path).select(F.col("batch").alias("_batch"), F.col("attempt").alias("_counts"))
    rows = rows.join(counts, "_batch", "left").where(F.col("_attempt") == F.coalesce("_counts", F.lit("")))
    if skip is not None:
        rows = rows.where(F.col("_batch") != str(skip))
    return rows.drop("_batch", "_attempt", "_counts")


def visible_files(spark, path, schema, skip_prefix=None):
    """Names of the files that :func:`read_batches` would read, but for batches named ``skip_prefix...``; no data is read."""
    rows = read_files(spark, path, schema)
    if rows is None:
        return []
    names = spark.createDataFrame([(unquote(f),) for f in rows.inputFiles()], "file string")
    batch = F.url_decode(F.regexp_extract("file", "/batch_id=([^/]*)/", 1))
    names = names.withColumns({"_batch": batch, "_attempt": F.regexp_extract("file", "/attempt=([^/]*)/[^/]*$", 1)})
    counts = commits(spark, path).select(F.col("batch").alias("_batch"), F.col("attempt").alias("_counts"))
    names = names.join(counts, "_batch", "left").where(F.col("_attempt") == F.coalesce("_counts", F.lit("")))
    if skip_prefix is not None:
        names = names.where(~F.startswith("_batch", F.lit(skip_prefix)))
    return [r.file for r in names.select("file").collect()]


def read_newest(spark, path, schema, skip=None):
    """The rows of the batch that was committed last, ``skip`` apart; None if there is none."""
    found = commits(spark, path)
    if skip is not None:
        found = found.where(F.col("batch") != str(skip))
    newest = found.orderBy(F.desc("version")).first()
    return None if newest is None else spark.read.schema(schema).parquet(_folder(path, newest.batch, newest.attempt))


def drop_older(spark, path, keep=2):
    """Deletes what no longer counts among the last commits: all but the ``keep`` newest batches, and attempts that were replaced.

    Call it after each commit; it looks at the last commits only, those before have been dealt with.
    """
    everything = read_files(spark, f"{path.rstrip('/')}/_commits", _COMMITS)
    if everything is None:
        return
    last = everything.orderBy(F.desc("version")).limit(8 * keep).collect()
    newest = {}
    for row in last:
        newest.setdefault(row.batch, row.attempt)
    kept = dict(list(newest.items())[:keep])
    for row in last:
        if kept.get(row.batch) != row.attempt:
            target = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, row.batch, row.attempt))
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
