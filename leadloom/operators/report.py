"""Presentation of exports: column order, labels and column widths."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.functions.text import yes_no


def presentation(scored):
    """Scored leads with the important columns first, under their labels."""
    shown = {"ml_recommend": yes_no("ml_recommend"), "ml_score": F.col("ml_score").cast("double")}
    return scored.select(
        *[shown.get(c, F.col(c)).alias(V.SCORED_LABELS[c]) for c in V.SCORED_ORDER if c in scored.columns]
    )


def labelled_export(df):
    """Plain leads in export order, under their labels."""
    return df.select(*[F.col(c).alias(V.EXPORT_LABELS[c]) for c in V.EXPORT_ORDER if c in df.columns])


def width_profile(df, wide_cap=V.EXPORT_WIDE_CAP):
    """Display width per column: longest value plus 2, label plus 4, within fixed bounds.

    Scored leads are recognised by their score and use their own order and labels.
    """
    scored = "ml_score" in df.columns
    order, labels = (V.SCORED_ORDER, V.SCORED_LABELS) if scored else (V.EXPORT_ORDER, V.EXPORT_LABELS)
    columns = [c for c in order if c in df.columns]
    longest = df.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("None")))).alias(c) for c in columns])

    def width(c):
        needed = F.greatest(F.lit(V.WIDTH_MIN), F.lit(len(labels[c]) + 4), F.coalesce(F.col(c) + 2, F.lit(0)))
        cap = min(V.WIDTH_MAX, wide_cap) if c in V.WIDE_COLUMNS else V.WIDTH_MAX
        return F.least(F.lit(cap), needed)

    rows = [F.struct(F.lit(c).alias("name"), width(c).alias("width")) for c in columns]
    return longest.select(F.inline(F.array(*rows)))
