"""Search addresses to harvest."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import seed_url


def seed_urls(searches, sources=None):
    """Address per search ``(query, location)`` and source; sources without a site give none."""
    known = [V.MAP_SITE["source"], V.LISTING_SITE["source"], V.SUPPLIER_SITE["source"]]
    wanted = [s for s in (known if sources is None else sources) if s in known]
    tags = F.array(*[F.lit(s) for s in wanted]).cast("array<string>")
    return searches.select("query", "location", F.explode(tags).alias("source")).withColumn(
        "url", seed_url("source", "query", "location")
    )
