"""Near-duplicates of a given shingle similarity, by wide SimHash fingerprints and BK-trees.

Two texts that share a fraction s of their distinct shingles differ in each bit of a SimHash
with probability arccos(2 s / (1 + s)) / pi: 0.15 at s = 0.8, or some 10 bits of 64, which no
whole set of exact blocks finds.  So fingerprints are WIDTH bits wide, and candidates are
texts that agree in one of ``tables`` blocks of ``bits`` bits (0.99 of pairs at 0.8).  Each
block value is a shard.  Its fingerprints are taken in order of document; one without a
smaller fingerprint within the radius joins the shard's BK-tree, any other is a candidate
of what the tree finds within the radius.  Candidates are verified on whole texts: the larger
of two that are similar goes.

Each input block first drops its own copies, on the texts it has in hand, so that a group of
copies that holds a third of all documents is a few rows of each block.  A candidate then has a
pair for each tree member near it, never all pairs of a group.

Blocks and radii leave out some pairs, so what that search leaves is searched again by an exact
rule.  In any one order of all shingles, two texts that share ``least`` of theirs share one of
the first n - ceil(least n) + 1 of each (n is a text's number of shingles).  So texts meet by
the shingles of their prefixes, sizes and places in the order rule pairs out, and whole texts
decide.  The order puts the shingles first that few texts have, by counts of all texts' shingles in
SLOTS slots; it decides how much meets for nothing, never what is found.

Texts are not stored again as shingles, which take several times their room: a step that needs
whole texts makes their shingles anew.  What tasks need to know of some documents (which are
gone, which are asked about) is sent to them as numbers, so texts stay where they are.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeloom.llm.arrow import ROWS, Sink, release, released, rows_of
from tomeloom.llm.simhash import BKTree, shingle_hashes
from tomeloom.llm.store import written
from tomeloom.sources.tables import scratch

SHINGLE, LEAST = 5, 0.8
WORDS = 6
WIDTH = 64 * WORDS
#: Share of the pairs at LEAST that have a block in common.
RECALL = 0.99
#: Bits that may differ: the first holds 0.998 of the pairs at 0.8 (58 bits differ, give or take 7);
#: documents of a block that whole texts have often refuted ask with the others.
RADII = (79, 68, 58, 48, 40)
#: Tasks over which the candidates of one document are dealt, at most.
SALTS = 256
#: Documents and shingles that a task holds at a time, and rows it gives back.
BLOCK, BLOCK_SHINGLES, OUT = 8192, 4_000_000, 1 << 15
#: Refutations by whole texts after which a document of a block asks only nearer ones.
PATIENCE = 8
#: Members up to which a shard is screened for neighbours before it has a tree.
SCREEN = 512
#: Bits of a shingle's slot (its first ones); a slot counts the shingles of all texts that fall into it.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
#: Documents up to which their names, 16 bytes each, are sent to all tasks.
SENT = 4_000_000
#: Bins in which a text's shingles are counted, up to 255 each: so many, and more for texts of over BIN_LOAD times as many.
BINS, BIN_LOAD = 256, 8
_CHUNK = 255 * 16
_random = np.random.default_rng(42)
_MASKS = _random.integers(0, 1 << 64, WORDS, np.uint64)
_FACTORS = _random.integers(0, 1 << 64, (2, WORDS), np.uint64) | np.uint64(1)
#: A byte's bits, each in a byte of its own: up to 255 of these add up without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; texts without words have one in common."""
    found = shingle_hashes(text, size)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles, of all that either has."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words: a bit is set if more than half of the hashes, mixed anew for each word, have it."""
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(found), _CHUNK):
        mixed = (found[at : at + _CHUNK, None] ^ _MASKS) * _FACTORS[0]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _FACTORS[1]
        mixed ^= mixed >> np.uint64(32)
        lanes = _LANES[mixed.view(np.uint8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)


def differing(similar: float) -> float:
    """Share of the bits in which two texts of that similarity differ."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def block_plan(documents: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): blocks so wide that a shard has some 256 documents at most (12 bits to a
    million documents), and so many that ``recall`` of the pairs at ``least`` share one.

    Where that is more than WIDTH bits, tables start at places all over the fingerprint.
    """
    bits = max(12, math.ceil(math.log2(max(1, documents))) - 8)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(least)) ** bits))


_FINGER = [f"f{w}" for w in range(WORDS)]
_PRINTS = pa.schema([(c, pa.int64()) for c in ("i", "h", "n", *_FINGER)])
#: With how many shingles stand in each bin; a task's last row is no document (n = -1) and has how many stand in each slot.
_WHOLE = pa.schema([*_PRINTS, ("b", pa.binary()), ("seen", pa.binary())])
_SEEN = pa.schema([("seen", pa.binary())])
_PLACES = pa.schema([(c, pa.int64()) for c in ("g", "i", "h", "x")])
_ROWS = pa.schema([(c, pa.int64()) for c in ("key", "i", "h", "n", *_FINGER)])
_PAIRS = pa.schema([(c, pa.int64()) for c in ("i", "h", "li", "lh")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{c.name} {'binary' if c.type == pa.binary() else 'long'}" for c in schema)


def _keys(rows: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A row of shard keys for each of (i, h, n, words): the table's number, then its block."""
    unpacked = np.unpackbits(np.ascontiguousarray(rows[:, 3:]).view(np.uint8), axis=1, bitorder="little")
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)
    if bits * tables <= WIDTH:
        starts = np.arange(tables) * bits
    else:
        starts = np.arange(tables) * (WIDTH - bits) // max(1, tables - 1)
    return np.stack([(np.int64(t) << np.int64(bits)) | (unpacked[:, s : s + bits].astype(np.int64) @ powers) for t, s in enumerate(starts.tolist())], axis=1)


def _close(rows: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Which of the pairs a, b are within the radius; sizes alone may rule a pair out."""
    n, m = rows[a, 3], rows[b, 3]
    out = np.minimum(n, m) >= least * np.maximum(n, m)
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count((rows[a[at], 4:] ^ rows[b[at], 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= radius
    return out


def _crowded(rows: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Places of rows (key, i, h, n, words), sorted by key, with a neighbour in their shard, or in a large shard."""
    if not len(rows):
        return np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    sizes = np.diff(np.append(new, len(rows)))
    ends, sizes = np.repeat(new + sizes, sizes), np.repeat(sizes, sizes)
    marked = sizes > SCREEN
    left, d = np.flatnonzero(~marked & (sizes > 1)), 1
    while len(left := left[ends[left] > left + d]):
        hit = left[_close(rows, left, left + d, radius, least)]
        marked[hit] = marked[hit + d] = True
        d += 1
    return np.flatnonzero(marked)


def _led(rows: np.ndarray, radius: Callable[[int], int], least: float) -> Iterator[tuple[int, list[int], Callable[[], None]]]:
    """Shard by shard and in order: (place, places of the tree's members within the radius, how to join the tree)."""
    shard, tree, at = None, BKTree(), []
    for r in _crowded(rows, RADII[0], least).tolist():
        if rows[r, 0] != shard:
            shard, tree, at = rows[r, 0], BKTree(), []
        value, n = int.from_bytes(rows[r, 4:].tobytes(), "little"), int(rows[r, 3])
        found = [at[x] for x in tree.within(value, radius(r))]

        def join(tree: BKTree = tree, at: list[int] = at, value: int = value, r: int = r) -> None:
            tree.add(value)
            at.append(r)

        yield r, [x for x in found if min(n, rows[x, 3]) >= least * max(n, rows[x, 3])], join


def _followers(rows: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """(place, place of a smaller one within the radius) of rows sorted by key, i, h; what has no such joins its shard's tree."""
    pairs = []
    for r, found, join in _led(rows, lambda _: radius, least):
        pairs += [(r, x) for x in found if (rows[x, 1:3] != rows[r, 1:3]).any()]
        if not found:
            join()
    return pairs


def _own_copies(rows: np.ndarray, document: np.ndarray, sets: list[np.ndarray], least: float) -> set[int]:
    """Of a block's shard rows, each of a document: the documents similar to a smaller one."""
    gone: set[int] = set()
    refuted: dict[int, set[int]] = {}

    def radius(r: int) -> int:
        return RADII[min(len(refuted.get(int(document[r]), ())) // PATIENCE, len(RADII) - 1)]

    for r, found, join in _led(rows, radius, least):
        d = int(document[r])
        if d in gone:
            continue
        for x in (int(document[x]) for x in found):
            if x == d or x in refuted.get(d, ()):
                continue
            if similarity(sets[d], sets[x]) >= least:
                gone.add(d)
                break
            refuted.setdefault(d, set()).add(x)
        else:
            join()
    return gone


def _given(columns: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns), OUT):
        part = columns[a : a + OUT]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, c])) for c in range(len(schema))], schema=schema)


def _binned(found: np.ndarray) -> bytes:
    bins = BINS
    while bins * BIN_LOAD < len(found):
        bins *= 2
    return np.minimum(np.bincount((found % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _bins_allow(a: bytes, b: bytes, least: float) -> bool:
    """Whether sets of these bins may be similar: they differ in as many shingles at least as their bins do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if max(x.max(), y.max()) == 255:
        return True
    bins = min(len(x), len(y))
    x, y = x.reshape(-1, bins).sum(axis=0, dtype=np.int64), y.reshape(-1, bins).sum(axis=0, dtype=np.int64)
    return np.abs(x - y).sum() <= (1 - least) / (1 + least) * (x.sum() + y.sum() + 1e-3)


def _slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _packed(seen: np.ndarray) -> bytes:
    return zlib.compress(seen.astype(np.uint32).tobytes(), 1)


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All counts by slot as one."""
    total = np.zeros(SLOTS, np.uint64)
    for (seen,) in rows_of(batches, 1):
        total += np.frombuffer(zlib.decompress(seen), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([_packed(np.minimum(total, 0xFFFFFFFF))], pa.binary())], schema=_SEEN)


def slot_ranks(seen: DataFrame) -> np.ndarray:
    """The rank (0 to 255) of each slot, in steps of an eighth of a doubling, from its counts in rows (seen)."""
    few = seen.coalesce(8).mapInArrow(released(_added), _ddl(_SEEN))
    total = np.zeros(SLOTS, np.uint64)
    for (row,) in few.repartition(1).mapInArrow(released(_added), _ddl(_SEEN)).collect():
        total += np.frombuffer(zlib.decompress(bytes(row)), np.uint32)
    return np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)


def _stacked(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.stack([c.to_numpy() for c in batch.columns], axis=1)


def _shard_rows(prints: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows sorted by key, i, h; the place in prints that each is of)."""
    keys = _keys(prints, bits, tables).ravel()
    document = np.repeat(np.arange(len(prints)), tables)
    order = np.lexsort((prints[document, 1], prints[document, 0], keys))
    document = document[order]
    rows = np.empty((len(order), 1 + prints.shape[1]), np.int64)
    rows[:, 0] = keys[order]
    for c in range(prints.shape[1]):
        rows[:, 1 + c] = prints[document, c]
    return rows, document


def _printed(size: int, least: float, bits: int, tables: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, h, t) to fingerprints and counts of shingles; n = 0 for copies of another document of the block."""

    def block(nodes: list[tuple[int, int]], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints = np.zeros((len(nodes), 3 + WORDS), np.int64)
        prints[:, :2] = nodes
        prints[:, 2] = [len(x) for x in sets]
        for row, found in zip(prints, sets, strict=True):
            row[3:] = wide_fingerprint(found).view(np.int64)
        _, first = np.unique(prints[:, :2], axis=0, return_index=True)  # a row given twice is one document
        prints, sets = prints[first], [sets[x] for x in first.tolist()]
        rows, document = _shard_rows(prints, bits, tables)
        prints[list(_own_copies(rows, document, sets, least)), 2] = 0
        del rows, document
        for a in range(0, len(prints), ROWS):
            b = min(a + ROWS, len(prints))
            whole = [pa.array([_binned(x) for x in sets[a:b]], pa.binary()), pa.nulls(b - a, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in prints[a:b].T], *whole], schema=_WHOLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, held = [], [], 0
        seen = np.zeros(SLOTS, np.int64)
        for i, h, text in rows_of(batches):
            nodes.append((i, h))
            sets.append(shingles(text, size))
            held += len(sets[-1])
            if len(nodes) >= BLOCK or held >= BLOCK_SHINGLES:
                seen += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
                yield from block(nodes, sets)
                nodes, sets, held = [], [], 0
                release()
        if nodes:
            seen += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
            yield from block(nodes, sets)
        if seen.any():
            last = [*[0, 0, -1], *[0] * WORDS, None, _packed(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, _WHOLE.types, strict=True)], schema=_WHOLE)

    return run


def _dealt(bits: int, tables: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in _stacked(batches):
            yield from _given(_shard_rows(prints, bits, tables)[0], _ROWS)

    return run


def _whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows sorted by their first column, in parts that hold all rows of each of its values."""
    held: list[np.ndarray] = []  # of the key that the next batch may go on with
    for rows in _stacked(batches):
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if held and (last or held[-1][-1, 0] != rows[0, 0]):
            # the open key ends in this batch, or before it
            yield np.concatenate([*held, rows[:last]])
            held = []
        elif last:
            yield rows[:last]
        held.append(rows[last:])
    if held:
        yield np.concatenate(held)


def _across_blocks(radius: int, least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From shard rows sorted by key, i, h to pairs (document, smaller neighbour)."""

    def shards(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if pairs := _followers(rows, radius, least):
            member, lead = np.array(pairs).T
            yield from _given(np.unique(np.concatenate([rows[member, 1:3], rows[lead, 1:3]], axis=1), axis=0), _PAIRS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches):
            yield from shards(rows)

    return run


def candidates(prints: DataFrame, radius: int, bits: int, tables: int, least: float = LEAST) -> DataFrame:
    """(i, h, li, lh): documents of prints (i, h, n, words) and smaller ones that may be similar.

    Of any two that share a block and differ in at most ``radius`` bits, either the larger is
    a candidate of the smaller, or one of them is a candidate of a third.
    """
    rows = prints.select(_PRINTS.names).mapInArrow(released(_dealt(bits, tables)), _ddl(_ROWS))
    rows = rows.repartition("key").sortWithinPartitions("key", "i", "h")
    return rows.mapInArrow(released(_across_blocks(radius, least)), _ddl(_PAIRS)).distinct()


def _prefix(found: np.ndarray, least: float, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a text's sorted ones, of which one at least is among the first of any
    similar text's: by value, but those of ``last`` (sorted) behind all others, by their rank."""
    most = len(found) - math.ceil(least * len(found) - 1e-6) + 1
    if not len(last):
        return found[:most]
    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
    behind = last[at] == found
    return np.concatenate([found[~behind][:most], found[behind][np.argsort(rank[at[behind]], kind="stable")]])[:most]


def _placed(size: int, least: float, ranks: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (i, h, open, t) to the prefix's shingles with (size, place, open) as one number; ranks: of the slots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for i, h, open_, text in rows_of(batches):
            found = shingles(text, size)
            first = _prefix(found, least, found, ranks[_slots(found)])
            rows = np.empty((len(first), 4), np.int64)
            rows[:, 0], rows[:, 1], rows[:, 2] = first.view(np.int64), i, h
            rows[:, 3] = (len(found) << 32) | (np.arange(len(first)) << 1) | open_
            made.append(rows)
            held += len(rows)
            if held >= OUT:
                yield from _given(np.concatenate(made), _PLACES)
                made, held = [], 0
        if made:
            yield from _given(np.concatenate(made), _PLACES)

    return run


def _may_be_similar(rows: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the places a, b in rows (g, i, h, x) are of documents that may be similar, if g is the
    first shingle that they share: b is open and another document, and enough shingles are left to both."""
    xa, xb = rows[a, 3], rows[b, 3]
    n, m = xa >> 32, xb >> 32
    left = np.minimum(n - ((xa & 0xFFFFFFFF) >> 1), m - ((xb & 0xFFFFFFFF) >> 1))
    fit = (xb & 1 == 1) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6) & (left >= least / (1 + least) * (n + m) - 1e-6)
    return fit & (rows[a, 1:3] != rows[b, 1:3]).any(axis=1)


def _meeting(rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of smaller documents, of larger ones) that meet in rows sorted by g, i, h and may be similar."""
    new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    ends = np.append(new[1:], len(rows))
    sizes = ends - new
    for start, end in zip(new[sizes > SCREEN].tolist(), ends[sizes > SCREEN].tolist(), strict=True):
        for b in (start + np.flatnonzero(rows[start:end, 3] & 1)).tolist():
            a = np.arange(start, b)
            b = np.full(len(a), b)
            fit = _may_be_similar(rows, a, b, least)
            yield a[fit], b[fit]
    end = np.repeat(ends, sizes)
    left, d = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SCREEN), sizes)), 1
    while len(left := left[end[left] > left + d]):
        fit = _may_be_similar(rows, left, left + d, least)
        yield left[fit], left[fit] + d
        d += 1


def _met(least: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches):
            held, count = [], 0
            for a, b in _meeting(rows, least):
                held.append(np.concatenate([rows[b, 1:3], rows[a, 1:3]], axis=1))
                count += len(a)
                if count >= OUT:
                    yield from _given(np.unique(np.concatenate(held), axis=0), _PAIRS)
                    held, count = [], 0
            if count:
                yield from _given(np.unique(np.concatenate(held), axis=0), _PAIRS)

    return run


def all_candidates(texts: DataFrame, ranks: np.ndarray, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(i, h, li, lh): all pairs of an open document and a smaller one that may be similar, of
    documents (i, h, open, t: text); ranks: of the slots, the shingles of lower ones come first."""
    rows = texts.select("i", "h", "open", "t").mapInArrow(released(_placed(size, least, ranks)), _ddl(_PLACES))
    return rows.repartition("g").sortWithinPartitions("g", "i", "h").mapInArrow(released(_met(least)), _ddl(_PAIRS)).distinct()


def _alike(test: Callable, made: Callable = lambda what: what) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (li, lh, salt, member, i, h, what) sorted so that a leader stands before its members:
    the pairs (member, leader) that pass the test of what is made of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, lead = Sink(_PAIRS), None
        for li, lh, _, member, i, h, what in rows_of(batches, 64):
            if not member:
                lead = made(what)
            elif test(lead, made(what)):
                yield from sink.add((i, h, li, lh))
        yield from sink.end()

    return run


def _passing(pairs: DataFrame, what: DataFrame, test: Callable, made: Callable = lambda what: what) -> DataFrame:
    """The pairs that pass a test of what is made of both documents' what (i, h, what)."""
    pairs = pairs.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    members = pairs.join(what, ["i", "h"]).select("li", "lh", "salt", F.lit(1).alias("member"), "i", "h", "what")
    leads = pairs.select("li", "lh", "salt").distinct().join(what.withColumnsRenamed({"i": "li", "h": "lh"}), ["li", "lh"])
    leads = leads.select("li", "lh", "salt", F.lit(0).alias("member"), F.col("li").alias("i"), F.col("lh").alias("h"), "what")
    dealt = members.unionByName(leads).repartition("li", "lh", "salt").sortWithinPartitions("li", "lh", "salt", "member")
    return dealt.mapInArrow(released(_alike(test, made)), _ddl(_PAIRS)).distinct()


def _named(i: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number of a document; with i it tells h."""
    return h.view(np.uint64) + i.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def among(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (i, h, ...) with ``among``: whether they are of these documents (i, h).

    Up to SENT documents are sent to all tasks, and rows stay where they are; more are joined.
    """
    documents = documents.select("i", "h").distinct()
    if documents.limit(SENT + 1).count() <= SENT:
        sent = documents.toArrow()
        i, h = (sent.column(c).to_numpy() for c in ("i", "h"))
        names = _named(i, h)
        order = np.argsort(names)
        names, i = names[order], i[order]
        if (names[1:] != names[:-1]).all():

            @F.arrow_udf("boolean")
            def is_among(a: pa.Array, b: pa.Array) -> pa.Array:
                if not len(names):
                    return pa.array(np.zeros(len(a), bool))
                a, b = (np.ascontiguousarray(x.to_numpy(zero_copy_only=False)) for x in (a, b))
                asked = _named(a, b)
                at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                return pa.array((names[at] == asked) & (i[at] == a))

            return rows.withColumn("among", is_among("i", "h"))
    return rows.join(documents.withColumn("among", F.lit(True)), ["i", "h"], "left").withColumn("among", F.coalesce("among", F.lit(False)))


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(i, h) of the pairs' documents that are similar to what they follow.

    Most pairs are refuted by their counts by bins, and texts (i, h, t) are sent for the rest.
    """
    pairs = written(_passing(pairs, prints.filter("n >= 0").select("i", "h", F.col("b").alias("what")), lambda a, b: _bins_allow(a, b, least)), "by-bins")
    named = pairs.select("i", "h").unionByName(pairs.select(F.col("li").alias("i"), F.col("lh").alias("h")))
    whole = written(among(texts, named).filter("among").select("i", "h", F.col("t").alias("what")), "texts")
    found = written(_passing(pairs, whole, lambda a, b: similarity(a, b) >= least, lambda text: shingles(text, size)).select("i", "h").distinct(), "similar")
    _forget(pairs.sparkSession)
    return found


def _forget(spark: SparkSession) -> None:
    """Spark removes the shuffle files of what nothing refers to once the driver has collected it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _node(ident: Column, text: Column) -> list[Column]:
    """What names a document: its id (none is last in order) and a digest of its text."""
    return [F.coalesce(ident.cast("long"), F.lit((1 << 63) - 1)).alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")]


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose text is similar to that of a smaller id, all columns unchanged.

    * similar: a Jaccard similarity of at least ``least`` over distinct runs of ``shingle``
      words (a shorter text is one run), words as SimHash has them; whole texts decide;
    * each document goes that is similar to any smaller one, whether that one stays or goes too;
    * texts without words (null and empty ones too) are similar to each other; rows that repeat
      an id and a text stay or go together; rows without an id come last, by their text's
      digest; rows with one id and different texts are different documents;
    * an empty table gives none; other columns, whatever their names, are unread.
    """
    spark, node = docs.sparkSession, _node(F.col(id_col), F.col(text_col))
    bits, tables = block_plan(docs.count(), least)
    texts = docs.select(*node, F.col(text_col).alias("t"))
    with scratch("gone"):
        prints = written(texts.mapInArrow(released(_printed(shingle, least, bits, tables)), _ddl(_WHOLE)), "wide-fingerprints")
        pairs = written(candidates(prints.filter("n > 0"), RADII[0], bits, tables, least), "candidates")
        _forget(spark)
        found = _similar(pairs, prints, texts, shingle, least)
        # what that search left out: all the rest, by an exact rule
        gone = prints.filter("n = 0").select("i", "h").unionByName(found)
        placed = among(texts, gone).select("i", "h", F.when(F.col("among"), 0).otherwise(1).cast("long").alias("open"), "t")
        ranks = slot_ranks(prints.filter("seen is not null").select("seen"))
        pairs = written(all_candidates(placed, ranks, shingle, least), "all-candidates")
        _forget(spark)
        gone = written(gone.unionByName(_similar(pairs, prints, texts, shingle, least)).distinct(), "gone")
    return among(docs.select(F.struct("*").alias("doc"), *node), gone).filter(~F.col("among")).select("doc.*")
