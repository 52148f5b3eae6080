"""Hierarchical packing of documents into sequences of several context sizes.

Each task packs its own partition while it tokenises it, a block of documents at a time, so
nothing is shuffled.  Whole windows are cut off long documents; what remains is routed to
the smallest tier (256, 512, 1024, 2048) that holds it.  From the longest tier down, each
piece opens a window of its tier; its gap is filled with the largest pieces of shorter tiers
that fit, and in the end by cutting one.  A block's unfinished window waits for the next
block.  The last pieces of a partition fill ever smaller windows; under 256 tokens a
partition are padded.  Windows are then dealt to step groups of equal tokens and about equal
attention cost.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.tokens import token_ids

TIERS = (256, 512, 1024, 2048)
END_ID = (1).to_bytes(4, "little")
#: Tokens held at a time, and tokens of a step group.
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 32 * 2048


class _Doc:
    __slots__ = ("ident", "ids", "tokens")

    def __init__(self, ident, ids: bytes):
        self.ident, self.ids, self.tokens = ident, ids, len(ids) // 4


class Pool:
    """Pieces (length, number, document, start) by tier, each tier sorted by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.sizes = tiers
        self.tiers: list[list[tuple[int, int, _Doc, int]]] = [[] for _ in tiers]
        self.number = 0
        self.tokens = 0

    def add(self, doc: _Doc, start: int, length: int) -> None:
        t = next(i for i, size in enumerate(self.sizes) if length <= size)
        insort(self.tiers[t], (length, self.number, doc, start), key=lambda p: p[:2])
        self.number += 1
        self.tokens += length

    def _pop(self, t: int, at: int) -> tuple[int, int, _Doc, int]:
        piece = self.tiers[t].pop(at)
        self.tokens -= piece[0]
        return piece

    def take(self, tier: int, gap: int) -> tuple[_Doc, int, int]:
        """The largest piece of tiers up to ``tier`` that fits, else the head of one cut to fit."""
        for t in range(tier, -1, -1):
            if at := bisect_right(self.tiers[t], gap, key=lambda p: p[0]):
                length, _, doc, start = self._pop(t, at - 1)
                return doc, start, length
        t = next(i for i, pieces in enumerate(self.tiers) if pieces)
        length, _, doc, start = self._pop(t, -1)
        self.add(doc, start + gap, length - gap)
        return doc, start, gap

    def window(self, size: int, tier: int) -> list[tuple[_Doc, int, int]]:
        """Pieces that fill a window of ``size`` (the pool holds as much)."""
        out, left = [], size
        while left:
            doc, start, length = self.take(tier, left)
            out.append((doc, start, length))
            left -= length
        return out


def pack_block(pool: Pool, docs: list[_Doc], last: bool) -> list[tuple[int, list[tuple[_Doc, int, int]]]]:
    """Windows (size, pieces) out of docs and what the pool holds; all of it if last."""
    longest = pool.sizes[-1]
    out = []
    for doc in docs:
        start = 0
        while doc.tokens - start >= longest:
            out.append((longest, [(doc, start, longest)]))
            start += longest
        if start < doc.tokens:
            pool.add(doc, start, doc.tokens - start)
    for t in range(len(pool.sizes) - 1, -1, -1):
        size = pool.sizes[t]
        while pool.tiers[t] and pool.tokens >= size:
            length, _, doc, start = pool._pop(t, -1)
            rest = pool.window(size - length, max(t - 1, 0) if any(pool.tiers[:t]) else len(pool.sizes) - 1) if length < size else []
            out.append((size, [(doc, start, length), *rest]))
    if last:
        for size in reversed(pool.sizes):
            while pool.tokens >= size:
                out.append((size, pool.window(size, len(pool.sizes) - 1)))
        if pool.tokens:
            rest = pool.tokens
            out.append((longest if rest & (rest - 1) else rest, pool.window(rest, len(pool.sizes) - 1)))
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window: the largest first, to the group with the least tokens, then cost."""
    heap = [(0, 0, g) for g in range(max(1, sum(sizes) // step_tokens))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, cost, g = heap[0]
        out[i] = g
        heapq.heapreplace(heap, (tokens + sizes[i], cost + sizes[i] ** 2, g))
    return out


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")])
_DDL = ", ".join(f"{n} long" for n in _SCHEMA.names)


def _packer(tokenizer, tiers: tuple[int, ...], block_tokens: int, step_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pool, sink = token_ids(tokenizer.value), Pool(tiers), Sink(_SCHEMA)
        base = TaskContext.get().partitionId() << 33
        made = [0, 0]  # sequences, step groups so far

        def give(docs: list[_Doc], last: bool) -> Iterator[pa.RecordBatch]:
            windows = pack_block(pool, docs, last)
            groups = step_groups([w[0] for w in windows], step_tokens)
            for (size, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(memoryview(doc.ids)[4 * start : 4 * (start + length)])
                    yield from sink.add((doc.ident, start, length, crc, doc.tokens, base + made[0], offset, size, base + made[1] + group))
                    offset += length
                made[0] += 1
            made[1] += max(groups, default=-1) + 1

        docs, held = [], 0
        for ident, text in rows_of(batches, 64):
            docs.append(_Doc(ident, ids(text or "") + END_ID))
            held += docs[-1].tokens
            if held >= block_tokens:
                yield from give(docs, False)
                docs, held = [], 0
        yield from give(docs, True)
        yield from sink.end()

    return run


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens (with padding) and step_group.

    * a document is its text's ids and then id 1; a null or empty text is id 1 alone;
    * every id lies in exactly one piece; a sequence's pieces are gapless from offset 0;
    * documents of any length are cut; repeated rows are packed as often as they occur;
    * a null id stays null; an empty table gives no rows; other columns are unread.

    Sequences belong to the task that made them: rows that arrive by a shuffle, in an order
    that a retry may change, should be written to a table first.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of some MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(_packer(tokenizer, tuple(tiers), block_tokens, step_tokens), _DDL)
