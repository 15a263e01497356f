"""Row-wise and counting operators on lead tables."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.pickers import (
    first_hit, first_raw, pick_address, pick_category, pick_phone, pick_rating, pick_website,
)
from leadloom.functions.text import clean, once, present, website_domain
from leadloom.schemas import LEAD_TEXT

# Order key of a card: site, then page, then place on the page.
SITE_ORDER = [V.MAP_SITE["source"], V.LISTING_SITE["source"], V.SUPPLIER_SITE["source"]]
SITE_SHIFT = 60
PAGE_SHIFT = 20


def to_leads(cards, site, query):
    """Raw leads of one site's cards: each field picked by that site's rules.

    ``lead_seq`` orders sites, pages and cards and is unique over all sites, for page
    numbers from 0 below 2^40 and up to 2^20 cards on a page; others raise an error.
    """
    source = site["source"]
    missing = F.lit(V.MISSING)
    picked = {"name": first_hit("names"), "phone": first_hit("phones"), "address": first_hit("addresses")}
    website, rating, category = missing, missing, F.lit(query)
    if source == V.MAP_SITE["source"]:
        picked = {"name": first_raw("names"), "phone": pick_phone("phones"), "address": pick_address("addresses")}
        website, rating = pick_website("websites"), pick_rating("ratings")
        category = pick_category("categories", F.lit(query))
    elif source == V.LISTING_SITE["source"]:
        rating = first_hit("ratings")
    first = SITE_ORDER.index(source) << SITE_SHIFT
    pages, places = 1 << SITE_SHIFT - PAGE_SHIFT, 1 << PAGE_SHIFT
    fits = F.col("page_id").between(0, pages - 1) & F.col("card_pos").between(0, places - 1)
    key = F.lit(first) + F.shiftleft("page_id", PAGE_SHIFT) + F.col("card_pos")
    refuse = F.raise_error(F.format_string("page %s, card %s has no lead_seq", "page_id", "card_pos")).cast("bigint")
    return cards.select(
        F.when(fits, key).otherwise(refuse).alias("lead_seq"),
        F.lit(source).alias("source"),
        picked["name"].alias("business_name"),
        missing.alias("email"),
        picked["phone"].alias("phone"),
        picked["address"].alias("address"),
        website.alias("website"),
        category.alias("category"),
        rating.alias("rating"),
    )


def clean_leads(df):
    """Every text column cleaned; other columns as they are."""
    return df.select(*[once(c, clean).alias(c) if c in LEAD_TEXT else F.col(c) for c in df.columns])


def require_name(df):
    """Drop rows whose name, before cleaning, reads ``N/A``. An empty name stays."""
    return df.where(present("business_name"))


def with_website(df):
    return df.where(present("website"))


def with_email(df):
    return df.where(present("email"))


def union_sources(*frames):
    """All rows of all tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_columns(df):
    """Known columns in export order; absent ones are skipped."""
    return df.select([c for c in V.EXPORT_ORDER if c in df.columns])


def first_per(df, keys, *order):
    """First row per key. The rank filter is applied before the shuffle as well, so a
    key held by a third of all rows sends at most one row per task."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def dedupe_leads(df):
    """One lead per name and phone: the earliest."""
    return first_per(df, ["business_name", "phone"], "lead_seq")


def dedupe_stats(df):
    """Rows before and after :func:`dedupe_leads`, and how many it removes."""
    pairs = df.groupBy("business_name", "phone").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"),
        F.count("*").alias("kept"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("removed"),
    )


def email_coverage(df):
    return df.agg(F.count_if(present("email")).alias("with_email"))


def eligible_count(df):
    """Leads whose website allows an address lookup."""
    return df.agg(F.count_if(present("website")).alias("eligible"))


def source_counts(df):
    return df.groupBy("source").agg(F.count("*").alias("collected"))


def with_domain(df):
    """Web domain of each lead; NULL for leads without a website."""
    return df.withColumn("domain", F.when(present("website"), website_domain("website")))
