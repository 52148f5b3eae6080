"""Connected components over a link table, by alternating large and small stars.

Edges stay a distributed table; each round writes it.  A partition first joins up what
its own links connect, which leaves few rounds for the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink
from tomeloom.llm.store import small_join, written

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: Links that a task joins up at a time.
BLOCK = 200_000


def _joined_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if up in root else up
        return x

    def flush() -> Iterator[pa.RecordBatch]:
        sink = Sink(_EDGES)
        for x in list(root):
            if (r := find(x)) != x:
                yield from sink.add((x, r))
        yield from sink.end()
        root.clear()

    n = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= BLOCK:
            yield from flush()
            n = 0
    yield from flush()


#: Neighbours from which a node's links are dealt over many tasks.
HUB = 100_000


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows with m of least (u, m, n) joined on u; no hub's links meet in one task."""
    hubs = written(least.filter(F.col("n") > HUB), "hubs")
    if not hubs.limit(1).count():
        return rows.join(least.drop("n"), "u")
    dealt = small_join(rows, hubs.drop("n"), ["u"], "left")
    return dealt.filter("m is not null").unionByName(dealt.filter("m is null").drop("m").join(least.drop("n"), "u").select("u", "v", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node where that is another.

    edges (u, v) may hold repeats, either direction and self-links; no edges, no rows.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(edges.mapInArrow(_joined_up, "u long, v long").distinct(), "edges")
    before = _mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: a node's larger neighbours move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = _with_least(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.filter("u <> v").distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
