"""Exact order statistics and ranks without a single-task sort."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.functions.text import once
from leadloom.session import deal_out, shared_dir

# Slices counted per pass, and the slice size that is simply read out.
_FAN = 1 << 16
_READ_OUT = 100_000
# Places up to which a top list finds a value in one job.
_TOP = 10_000


def nth_smallest(df, column, n):
    """Exact n-th smallest value of a BIGINT or DOUBLE column, or None if there are fewer than n.

    ``n`` is a number, or a function giving it for the number of values.

    Each pass counts slices of the remaining value range, so only a bounded number of
    counts reaches the driver and no row is moved; a slice with few rows is read out. A value's
    slice never decreases with the value, which is all that the counts need.
    """
    (bounds,) = value_bounds(df, [column])
    n = n(bounds[0]) if callable(n) else n
    if n < 1 or bounds[0] < n:
        return None
    return nth_within(df, column, n, bounds)


def value_bounds(df, columns):
    """``(values, least, greatest)`` of each column, from one pass over all of them."""
    found = df.agg(*[f(c) for c in columns for f in (F.count, F.min, F.max)]).first()
    return [tuple(found[k : k + 3]) for k in range(0, len(found), 3)]


def nth_within(df, column, n, bounds):
    """As :func:`nth_smallest`, where ``bounds`` are those of these values or of more."""
    rows, low, high = bounds
    if rows < n:
        return None
    inside = df.where(F.col(column).isNotNull())
    if n <= min(_TOP, _READ_OUT):
        found, last = inside.select(column).orderBy(column).limit(n).agg(F.count(column), F.max(column)).first()
        return last if found == n else None
    left = n
    while low < high and rows > _READ_OUT:
        slice_of = F.least(F.floor(_above(column, low, high) * (_FAN / (high - low))), F.lit(_FAN - 1)).cast("int")
        sliced = inside.withColumn("_slice", slice_of)
        counts = sliced.groupBy("_slice").agg(F.count("*"), F.min(column), F.max(column))
        for position, rows, least, most in sorted(counts.collect()):
            if rows >= left:
                break
            left -= rows
        else:
            return None
        low, high = least, most
        inside = inside.where(once(column, lambda v: v.between(low, high)))
    found, last = inside.select(column).orderBy(column).limit(left).agg(F.count(column), F.max(column)).first()
    return last if found == left else None


def _above(column, low, high):
    """How far a value lies above ``low``, without overflow over the full range of BIGINT."""
    if isinstance(low, int) and high - low < 1 << 63:
        return (F.col(column) - F.lit(low)).cast("double")
    return F.col(column).cast("double") - F.lit(float(low))


def rank_leads(scored, score="ml_score"):
    """Best first; equal scores in collection order.

    The rows are exchanged once before: a sort looks at its input twice, first for the ranges, and
    would have the scores worked out each time.
    """
    return deal_out(scored).orderBy(F.desc(score), "lead_seq")


def with_rank(scored, score="ml_score"):
    """Dense 0-based position in best-first order, for every row; NULL scores come last.

    Rows are dealt out by ranges of (score, lead_seq), so a score shared by most rows is spread too,
    sorted inside each partition and written to the shared folder. A row's position is
    its place in its partition after the sizes of the partitions before.
    """
    shared_dir(scored.sparkSession)
    order = [F.col(score).desc_nulls_last(), F.col("lead_seq")]
    # Exchanged once before, so that finding the ranges does not work the scores out a second time.
    dealt = deal_out(scored).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.select(*scored.columns, F.monotonically_increasing_id().alias("_id")).checkpoint()
    # The number of the partition is in the upper bits, the place in the lower 33.
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One offset per partition of the shuffle.
    return placed.join(F.broadcast(offsets), "_part").select(*scored.columns, (F.col("_offset") + F.col("_place")).alias("rank"))
