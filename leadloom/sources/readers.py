"""Readers with fixed schemas."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.batches import read_batches
from leadloom.schemas import CONTACT_PAYLOAD, LEAD, LEAD_TEXT, SENT_LOG

LOG_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SENT_LOG)


def read_leads_csv(spark, path, multi_line=False):
    """Lead CSV with a header, matched by column name; absent columns read ``N/A``.

    Values stay text: ``N/A`` is kept and an empty field is NULL. ``lead_seq`` numbers the
    rows of all files, in order of path and place in the file, however Spark splits them.
    Set ``multi_line`` only for quoted line breaks: it reads each file whole.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    text = [F.col(c) if c in raw.columns else F.lit(V.MISSING).alias(c) for c in LEAD_TEXT]
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split")]
    rows = raw.select(F.monotonically_increasing_id().alias("_row"), *split, *text)
    # One row per split: the number of rows before it and the first of its own numbers.
    sizes = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    seq = (F.col("_base") + F.col("_row") - F.col("_first")).alias("lead_seq")
    return rows.join(bases, ["_file", "_split"]).select(seq, *LEAD_TEXT)


def leads_from_rows(spark, rows):
    """Leads from records collected in the calling program, numbered in list order."""
    data = [(i, *[r.get(c) for c in LEAD_TEXT]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LEAD)


def read_pages(spark, path):
    """Harvested pages; only the columns that extraction uses."""
    return spark.read.schema("page_id BIGINT, url STRING, html STRING").parquet(path)


def read_contacts(payloads):
    """One row per address in lookup payloads ``(domain, payload[, lookup_seq])``.

    ``lookup_seq`` orders several lookups of one domain; ``pos`` is the place of the
    address in its payload. Payloads that cannot be read or hold no address give no row.
    """
    seq = F.col("lookup_seq") if "lookup_seq" in payloads.columns else F.lit(0).cast("bigint")
    read = payloads.select(
        "domain",
        seq.alias("lookup_seq"),
        F.from_json("payload", CONTACT_PAYLOAD).alias("read"),
    )
    return read.select(
        "domain", "lookup_seq", F.posexplode("read.data.emails").alias("pos", "contact")
    ).select("domain", "lookup_seq", "pos", "contact.value", "contact.confidence")


def read_log(spark, path, skip_batch=None):
    """Send log, empty if it does not exist yet. ``skip_batch`` leaves one batch out.

    Batches that were not committed, or have been replaced, are not seen. Files that lie at the path
    itself belong to no batch and are read as well.
    """
    log = read_batches(spark, path, LOG_DDL, skip=skip_batch)
    return spark.createDataFrame([], SENT_LOG) if log is None else log.select(SENT_LOG.fieldNames())


def read_responses(df, text="response"):
    """Generated texts keyed by lead, one per lead, trimmed of nothing and parsed later."""
    return df.groupBy("lead_seq").agg(F.min(text).alias("response"))


def enabled_sources(df, enabled):
    """Only rows of sources that are switched on."""
    return df.where(F.col("source").isin(list(enabled)))


def searches(spark, queries, locations):
    """Every query with every location, from two configured lists."""
    both = spark.createDataFrame([(list(queries), list(locations))], "q array<string>, l array<string>")
    return both.select(F.explode("q").alias("query"), "l").select("query", F.explode("l").alias("location"))
