"""Orders that no single task has to hold: places in a sorted table, running sums along a book,
neighbours of rows, connected groups.

A book may be a third of a library, so its pages are worked on in stretches of STRETCH page
numbers; what passes from one stretch to the next is a row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeloom.sources.tables import written

STRETCH = 4096


def placed(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with its rows' places from 1 in that order: sorted by ranges, counted by partition."""
    rows = written(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_row", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # a row a partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = counts.select("_part", before.alias("_before"))
    out = rows.join(F.broadcast(starts), part == F.col("_part"))
    return out.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_row", "_part", "_n", "_before")


def _stretch(place: str) -> Column:
    return F.floor(F.col(place) / STRETCH)


def running_before(rows: DataFrame, key: str, place: str, value: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of value over the key's rows at smaller places (places differ)."""
    rows = rows.withColumn("_v", value).withColumn("_s", _stretch(place))
    sums = rows.groupBy(key, "_s").agg(F.sum("_v").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy(key).orderBy("_s")) - F.col("_sum")
    sums = sums.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), start.alias("_start"))
    inside = F.sum("_v").over(Window.partitionBy(key, "_s").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    out = rows.withColumn("_in", inside).join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_v", "_s", "_in", "_k", "_t", "_start")


def with_neighbours(rows: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """rows with ``before`` and ``after``: the value at the key's nearest smaller and larger place."""
    rows = rows.withColumn("_s", _stretch(place))
    ends = rows.groupBy(key, "_s").agg(F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    along = Window.partitionBy(key).orderBy("_s")
    ends = ends.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.lag("_last").over(along).alias("_from"), F.lead("_first").over(along).alias("_to"))
    inside = Window.partitionBy(key, "_s").orderBy(place)
    out = rows.withColumn("_lag", F.lag(value).over(inside)).withColumn("_lead", F.lead(value).over(inside))
    out = out.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
    return out.withColumn("before", F.coalesce("_lag", "_from")).withColumn("after", F.coalesce("_lead", "_to")).drop("_s", "_lag", "_lead", "_k", "_t", "_from", "_to")


def connected(pairs: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(key, node, least): the smallest node that each node of pairs (key, a, b) is connected to.

    Each round a node takes the least label around it, then that label's own label, so rounds
    grow with the logarithm of the longest chain.
    """
    both = pairs.select(key, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(key, F.col("b").alias("node"), F.col("a").alias("other")))
    both = written(both.distinct(), "pairs")
    labels = written(both.groupBy(key, "node").agg(F.least(F.col("node"), F.min("other")).alias("least")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(key, F.col("node").alias("other"), F.col("least").alias("l")), [key, "other"]).groupBy(key, "node").agg(F.min("l").alias("l"))
        new = labels.join(near, [key, "node"]).select(key, "node", F.least("least", "l").alias("least"), F.col("least").alias("old"))
        jump = new.select(key, F.col("node").alias("least"), F.col("least").alias("far"))
        new = written(new.join(jump, [key, "least"], "left").select(key, "node", F.least("least", F.coalesce("far", "least")).alias("least"), "old"), "labels")
        labels = new.drop("old")
        if not new.filter("least < old").limit(1).count():
            return labels
    raise RuntimeError(f"connected: not settled after {rounds} rounds")
