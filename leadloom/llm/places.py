"""Places of rows in the order of their group, for groups of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.tables import stored


def placed(rows: DataFrame, group: str, order, name: str) -> DataFrame:
    """The rows with ``place``, from 0 in the order of their ``group``, and ``n``, the group's number of rows.

    Rows are dealt out by ranges of (group, order), sorted in their parts and stored, so a group of any size
    is spread over many tasks. A place is the one in the part, plus the sizes of the group's earlier parts;
    those are one row for each part and group, which Spark joins as their measured size allows. NULL is a
    group like others. Rows that are equal in all of ``order`` follow each other in some order, which is fixed
    once they are stored; give ``order`` a tie-breaker if they may be many.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), name)
    parts = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    here = Window.partitionBy("_group")
    earlier = here.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_group", "_of", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(here).alias("n")
    )
    offsets = stored(offsets, f"{name}-parts")
    joined = dealt.join(offsets, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_row") + F.col("_shift")).select(*rows.columns, "place", "n")


def tie_breaker():
    """A scattered number for each row as it is read, to tell equal rows apart."""
    return F.xxhash64(F.monotonically_increasing_id())
