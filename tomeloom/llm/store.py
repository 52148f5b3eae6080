"""Joins that survive a hot key, and the tables that operators write between their steps.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``
(shared by the driver and all executors), so a lost executor costs a re-read, never a
recomputation of Python work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeloom.sources.tables import fresh_path, written

__all__ = ["fresh_path", "small_join", "two_hop_join", "written"]

#: Rows up to which a side of a join may be broadcast (checked by counting a written table).
BROADCAST_ROWS = 50_000


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 64, most: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to a written table on null-safe keys.

    The table is broadcast only if it counts at most ``most`` rows.  Beyond that
    the join shuffles, and each key is dealt over ``salts`` tasks, so that a key holding a
    third of big's rows does not meet in one task; ``salts=1`` is for keys that hold few rows
    each, as those of a single document do.
    """
    small = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & big[k].eqNullSafe(F.col(f"_k{i}"))
    drop = [f"_k{i}" for i in range(len(keys))]
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), on, how).drop(*drop)
    if salts == 1:
        return big.join(small, on, how).drop(*drop)
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in big.dtypes if t in ("bigint", "int")]), F.lit(salts)))
    small = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small, on & (F.col("_salt") == F.col("_salt2")), how).drop("_salt", "_salt2", *drop)


def two_hop_join(base: DataFrame, lookup: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """base left-joined to lookup (one row a key) where one key may hold most of base.

    The first hop joins the distinct (run, key) pairs, of which a hot key has one per run;
    the second joins rows to their own run's pair, of which a hot key has a run's rows.
    ``run`` numbers the partitions base was written in.
    """
    pairs = base.select(run, *keys).distinct()
    extra = [c for c in lookup.columns if c not in keys]
    pairs = pairs.join(lookup, keys, "inner").select(run, *keys, *extra)
    return base.join(pairs, [run, *keys], "left")
