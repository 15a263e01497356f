"""Lead analytics on Spark: collection, enrichment, scoring and outreach selection."""
