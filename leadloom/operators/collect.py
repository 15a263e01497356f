"""Collection in source order with a cap per source and no name taken twice."""

from pyspark.sql import functions as F

from leadloom import fixed_values as V
from leadloom.operators.leads import first_per
from leadloom.operators.ranking import nth_within, value_bounds
from leadloom.session import shared_dir


def first_occurrences(leads):
    """Earliest lead per source and name."""
    return first_per(leads, ["source", "business_name"], "lead_seq")


def unseen_names(leads, taken):
    """Leads whose name no taken lead has."""
    names = taken.select("business_name").distinct()
    return leads.join(names, "business_name", "left_anti").select(leads.columns)


def collect(leads, order, max_results=V.MAX_RESULTS):
    """Take up to ``max_results`` new names per source, sources in the given order.

    A name blocks later sources only once it was taken; one cut off by a cap may be taken
    by the next source. Names are compared as they are, so clean the leads first.

    One row per name holds its first lead in each source. Whether an earlier source has taken a name
    depends on that row and the places of the earlier cuts alone, so sources need no joins with each
    other. The places are order statistics, found one after the other without sorting a source; how many
    names each source has is counted in one pass for all, and a source that its cap cannot cut needs no other.
    """
    order = list(dict.fromkeys(order))
    if max_results <= 0 or not order:
        return leads.where(F.lit(False))
    wanted = leads.where(F.col("source").isin(order))
    shared_dir(leads.sparkSession)
    firsts = [F.min(F.when(F.col("source") == s, F.col("lead_seq"))).alias(f"first_{k}") for k, s in enumerate(order)]
    names = wanted.groupBy("business_name").agg(*firsts).checkpoint()
    taken, before = [], F.lit(False)
    for source, took in zip(order, _takes(names, len(order), max_results)):
        first = F.col(f"first_{len(taken)}")
        taken.append(F.when(took & ~before, F.struct(F.lit(source).alias("_source"), first.alias("_seq"))))
        before = before | took
    keys = names.select(F.col("business_name").alias("_name"), F.explode(F.array_compact(F.array(*taken))).alias("_key"))
    keys = keys.select("_name", "_key.*")
    same = (F.col("lead_seq") == F.col("_seq")) & (F.col("source") == F.col("_source")) & F.col("business_name").eqNullSafe(F.col("_name"))
    return wanted.join(keys, same, "left_semi").select(leads.columns)


def _takes(names, sources, n):
    """For each source, whether a name's first lead there lies before the source's cut."""
    columns = [f"first_{k}" for k in range(sources)]
    before = F.lit(False)
    for column, bounds in zip(columns, value_bounds(names, columns)):
        cut = nth_within(names.where(~before), column, n, bounds)
        took = F.col(column).isNotNull() if cut is None else F.coalesce(F.col(column) <= cut, F.lit(False))
        yield took
        before = before | took
