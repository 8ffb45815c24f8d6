"""Running totals over keys of any size, in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memloom.sources.tables import write_through


def ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df as a table dealt by ranges of keys and order, with _range: the ranges of one key follow each other, so a frequent key has many."""
    return write_through(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def before(placed: DataFrame, keys: list[str], order: list[str], value: Column, name: str, total: str | None = None, how: str = "sum") -> DataFrame:
    """placed (of `ranges`) with `name`: the sum (how: or maximum) of value over the rows of the same keys that come earlier, null if there are
    none; and `total`, that of all rows of the keys. Each range is summed by itself, then ranges, of which a key has no more than there are
    partitions. Rows of equal keys and order stand in any order."""
    agg = {"sum": F.sum, "max": F.max}[how]
    both = (lambda a, b: F.coalesce(a + b, a, b)) if how == "sum" else F.greatest
    earlier = (W.unboundedPreceding, -1)
    rows = placed.withColumn("_value", value)
    per = rows.groupBy(*keys, "_range").agg(agg("_value").alias("_all"))
    own = W.partitionBy(*keys)
    per = per.withColumn("_base", agg("_all").over(own.orderBy("_range").rowsBetween(*earlier)))
    if total:
        per = per.withColumn(total, agg("_all").over(own))
    inside = agg("_value").over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*earlier))
    rows = rows.withColumn("_inside", inside)
    renamed = per.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), "_base", *([total] if total else []))
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(renamed, on).withColumn(name, both(F.col("_base"), F.col("_inside")))
    return out.select(*placed.columns, name, *([total] if total else []))
