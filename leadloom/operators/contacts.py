"""Best address per web domain, and its join to leads."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import present, website_domain


def best_contact(contacts):
    """One address per domain: highest confidence, missing counts as 0, ties to the first listed."""
    key = F.struct(
        F.coalesce("confidence", F.lit(0.0)), -F.col("lookup_seq"), -F.col("pos")
    )
    return contacts.groupBy("domain").agg(F.max_by("value", key).alias("best_email"))


def enrich(leads, contacts):
    """Put the best address of its web domain on each lead that has a website.

    A domain without contacts keeps the old address; a best contact without an address
    gives ``N/A``. Leads without a website get spread-out keys that match nothing, so they
    do not pile up in one task, and the engine broadcasts the contact side only if its
    measured size allows; a hot domain is split by the adaptive skew join otherwise.
    """
    best = best_contact(contacts).withColumn("_found", F.lit(True))
    key = F.when(present("website"), website_domain("website")).otherwise(
        F.concat(F.lit("/"), F.pmod(F.xxhash64("lead_seq"), F.lit(100_000)).cast("string"))
    )
    found = F.col("_found") & present("website")
    return (
        leads.withColumn("_key", key)
        .join(best.withColumnRenamed("domain", "_key"), "_key", "left")
        .withColumn(
            "email",
            F.when(found, F.coalesce("best_email", F.lit(V.MISSING))).otherwise(F.col("email")),
        )
        .select(leads.columns)
    )
