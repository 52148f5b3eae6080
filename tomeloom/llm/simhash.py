"""Near-duplicates by SimHash fingerprints, searched with BK-trees in shards.

The search shards are exact: a 64-bit fingerprint has four 16-bit blocks, and two
fingerprints that differ in at most 2 bits agree in at least two whole blocks.  Each of the
six pairs of blocks gives a shard key of 32 bits, so every link lies inside some shard.  A
shard holds one BK-tree (children keyed by their integer Hamming distance to the parent)
that each of its fingerprints searches, following only edges within the radius.

A shard never meets all others: no fingerprint table is broadcast or collected.  Its tree is
sent nowhere either, as trees and queries of a shard are dealt to the same task.  Shards
above ``shard_limit`` are split again by the same rule on their remaining 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.components import components
from tomeloom.llm.store import two_hop_join, written

SEED = 42
SHINGLE = 3
RADIUS = 2
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles in order, repeats included; none for a text without words.

    bytes.lower() and bytes.split() touch just A-Z and x20, x09-x0D.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        shingles: Iterable[bytes] = [b" ".join(words)]
        n = 1
    else:
        n = len(words) - size + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 for a text without words.

    A bit is set if more than half of the shingles' hashes have it.
    """
    hashes = shingle_hashes(text, size)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(_PRINTS)
    for ident, text in rows_of(batches):
        fp = fingerprint(text)
        yield from sink.add((ident, fp - (1 << 64) if fp >> 63 else fp))
    yield from sink.end()


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at, new = 0, len(self.values) - 1
        while True:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, new)
            if nxt == new:
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at a distance of at most radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius:
                stack += [child for e, child in edges.items() if abs(e - d) <= radius]
            else:
                stack += [child for e in range(d - radius, d + radius + 1) if (child := edges.get(e)) is not None]
        return found


def _links_of(values: list[int], nodes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the shard's components: at most one fewer than its values."""
    tree, root = BKTree(), list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield nodes[i], nodes[j]
        tree.add(v)


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shard_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, sub, fp, node) rows sorted by shard: one shard in memory at a time."""
    sink, held = Sink(_LINKS), []

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts)
        if len(rows) > 1:
            for u, v in _links_of(rows[:, 2].view(np.uint64).tolist(), rows[:, 3].tolist(), RADIUS):
                yield from sink.add((max(u, v), min(u, v)))

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.empty((0, 4), np.int64)
        if not len(rows):
            continue
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            yield from flush(held)
            held = []
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        parts = np.split(rows, cuts) if len(cuts) else [rows]
        if len(parts) > 1:
            yield from flush([*held, parts[0]])
            for p in parts[1:-1]:
                if len(p) > 1:
                    yield from flush([p])
            held = []
        held.append(parts[-1])
    if held:
        yield from flush(held)
    yield from sink.end()


def _block_pairs(value: Column, start: int, width: int) -> Column:
    """Array of keys, one for each pair of the four blocks of ``width`` bits from bit start."""
    block = [F.shiftrightunsigned(value, start + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)]
    pairs = list(combinations(range(4), 2))
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j]) for n, (i, j) in enumerate(pairs)])


def _rest_pairs(value: Column, key: Column) -> Column:
    """The same for the 32 bits that a shard's key leaves free."""
    pairs = list(combinations(range(4), 2))
    out = F.lit(None).cast("array<bigint>")
    for n, (i, j) in enumerate(pairs):
        a, b = [x for x in range(4) if x not in (i, j)]
        rest = F.shiftleft(F.shiftrightunsigned(value, 16 * a).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftrightunsigned(value, 16 * b).bitwiseAND(F.lit(0xFFFF)))
        out = F.when(F.shiftrightunsigned(key, 32) == n, _block_pairs(rest, 0, 8)).otherwise(out)
    return out


def links(prints: DataFrame, shard_limit: int = 20_000) -> DataFrame:
    """Links u > v between the nodes of (fp, node) whose fingerprints differ in at most RADIUS bits.

    Not every such pair is a row, but all are connected by rows.
    """
    rows = prints.select(F.explode(_block_pairs(F.col("fp"), 0, 16)).alias("key"), "fp", "node")
    large = written(rows.groupBy("key").count().filter(F.col("count") > shard_limit).select("key"), "large-shards")
    plain = rows.select("key", F.lit(-1).cast("long").alias("sub"), "fp", "node")
    if large.limit(1).count():
        split = rows.join(large, "key").select("key", F.explode(_rest_pairs(F.col("fp"), F.col("key"))).alias("sub"), "fp", "node")
        plain = rows.join(large, "key", "left_anti").select("key", F.lit(-1).cast("long").alias("sub"), "fp", "node").unionByName(split)
    dealt = plain.repartition(F.col("key"), F.col("sub")).sortWithinPartitions("key", "sub", "node")
    return dealt.mapInArrow(_shard_links, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    * null, empty and blank texts share fingerprint zero and link like any other;
    * component_id is the smallest id reachable over links, the document's own included;
    * repeated rows share a component; a null id is smaller than none and never names one;
    * whole texts are read, of any length, in bounded pieces; an empty table gives none.
    """
    prints = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_fingerprints, "id long, fp long")
    base = written(prints.withColumn("run", F.spark_partition_id()), "fingerprints")
    distinct = written(base.groupBy("fp").agg(F.min("id").alias("node")), "distinct-fingerprints")
    known = distinct.filter("node is not null")
    labels = components(written(links(known), "links"))
    lookup = known.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = two_hop_join(base, lookup, "run", ["fp"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
