"""URL filters over a sorted digest array.

Entries are strings host + path.  Their 64-bit xxHash keys lie sorted in one array, the
strings beside it; both are memory-mapped by the workers.  A URL's candidates (its host and
parent hosts, each with the path prefixes of lengths that entries have) are probed together
by binary search, and a hit counts only if the stored string is the candidate itself.

A table above MOST_BYTES is cut into ranges of keys.  Each range is a table of its own, sent
by itself; pages stream through one after the other, and the longest rule of any wins.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains below paths that start so.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The bytes that a table may have to be sent to every executor.
MOST_BYTES = 64 << 20


def blocklist(hosts: int = 200_000, pages: int = 10_000) -> list[str]:
    """The query's list, by rule: that many advertising hosts, and of the sections of example.net
    whose names are numbers from 1000 below ``pages`` every eleventh, in four languages."""
    out = [f"ads{k}.example.com/" for k in range(hosts)]
    return out + [f"example.net/{lang}/{k}" for lang in ("de", "en", "es", "fr") for k in range(1000, pages) if k % 11 == 0]


def _key(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"))


class DigestTable:
    """Read-only map from strings to small numbers, kept as one block of bytes.

    Layout: count n and longest host (labels) as 64-bit numbers; n sorted keys; n + 1 string
    offsets; n values; the strings.
    """

    def __init__(self, block: bytes | mmap.mmap):
        self.block = block
        n, self.labels = np.frombuffer(block, "<i8", 2).tolist()
        self.keys = np.frombuffer(block, "<u8", n, 16)
        self.offsets = np.frombuffer(block, "<i8", n + 1, 16 + 8 * n)
        self.values = np.frombuffer(block, "u1", n, 24 + 16 * n)
        self.base = 24 + 17 * n
        self.found: list[int] | None = None

    @staticmethod
    def built(entries: Sequence[tuple[str, int]], most_bytes: int = MOST_BYTES) -> list[bytes]:
        """A block for each range of keys of the (string, value) entries, none above most_bytes but
        for a single entry; of a string given twice the last value holds."""
        rows = sorted((_key(e), e.encode("utf-8", "surrogatepass"), v) for e, v in dict(entries).items())
        out, start, size = [], 0, 0
        for i, (_, e, _) in enumerate(rows):
            size += 17 + len(e)
            # equal keys stay in one block
            if size + 24 > most_bytes and i > start and rows[i][0] != rows[i - 1][0]:
                out.append(DigestTable._block(rows[start:i]))
                start, size = i, 17 + len(e)
        return [*out, DigestTable._block(rows[start:])]

    @staticmethod
    def _block(rows: list[tuple[int, bytes, int]]) -> bytes:
        offsets = np.cumsum([0, *[len(e) for _, e, _ in rows]])
        labels = max((e.partition(b"/")[0].count(b".") + 1 for _, e, _ in rows), default=0)
        return b"".join([
            np.array([len(rows), labels], "<i8").tobytes(), np.array([k for k, _, _ in rows], "<u8").tobytes(), offsets.astype("<i8").tobytes(),
            bytes(v for _, _, v in rows), *[e for _, e, _ in rows],
        ])

    @classmethod
    def mapped(cls, block: bytes) -> DigestTable:
        """The table in memory-mapped pages of a file without a name, which is in no folder and
        gone once the process ends."""
        with os.fdopen(os.memfd_create("urls"), "r+b") as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lengths(self) -> list[int]:
        """Path lengths (in characters) that entries have, ascending."""
        if self.found is None:
            self.found = sorted({len(t) - (t.find("/") if "/" in t else len(t)) for t in map(self.text, range(len(self.keys)))})
        return self.found

    def text(self, i: int) -> str:
        a, b = self.offsets[i : i + 2].tolist()
        return bytes(self.block[self.base + a : self.base + b]).decode("utf-8", "surrogatepass")

    def probe(self, candidates: Sequence[str]) -> np.ndarray:
        """The place of each candidate among the entries, -1 where it is none."""
        out = np.full(len(candidates), -1)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(_key, candidates), np.uint64, len(candidates))
        if keys.max() < self.keys[0] or keys.min() > self.keys[-1]:
            return out
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # collisions lie side by side
                if self.text(j) == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty for null or without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def candidates(host: str, path: str, labels: int, lengths: Sequence[int]) -> Iterator[str]:
    """Entries that could fit, the longest first for each host."""
    parts = host.split(".")
    for n in range(min(len(parts), labels), 0, -1):
        name = ".".join(parts[-n:])
        for size in reversed(lengths):
            if size <= len(path):
                yield name + path[:size]


_SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("listed", pa.bool_())])
_tables: dict[int, DigestTable] = {}


def _mapped_once(block: bytes, place: int) -> DigestTable:
    """The tables that this worker process was last given stay mapped."""
    key = xxhash.xxh3_64_intdigest(block, place)
    if key not in _tables:
        if not place:
            _tables.clear()
        _tables[key] = DigestTable.mapped(block)
    return _tables[key]


def _probed(shared, place: int):
    """(id, host, path, rule, listed) rows, each with what the table adds to its rule and listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _mapped_once(shared.value, place)
        lengths = table.lengths()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                hosts, paths, rule, listed = (part.column(c).to_pylist() for c in range(1, 5))
                asked, owner = [], []
                for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    for c in candidates(host, path, table.labels, lengths) if host else ():
                        asked.append(c)
                        owner.append(i)
                places = table.probe(asked)
                for k in np.flatnonzero(places >= 0).tolist():
                    i, value = owner[k], int(table.values[places[k]])
                    if value == 2:
                        listed[i] = True
                    elif rule[i] is None or len(asked[k]) > len(rule[i]):
                        rule[i] = asked[k]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rule, pa.string()), pa.array(listed, pa.bool_())], schema=_SCHEMA)

    return run


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            split = [split_url(u) for u in part.column(1).to_pylist()]
            n = len(split)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.nulls(n, pa.string()), pa.array([False] * n)], schema=_SCHEMA)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = (), most_bytes: int = MOST_BYTES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (host + path of the longest that fits), verdict.

    Where no rule fits, the verdict is block for a URL without a host and for one that an
    entry of ``blocked`` (host + path prefix, of that host and its subdomains) fits, else allow.

    * null and malformed urls have empty host and path; whole urls of any length are judged;
    * equal urls, equal verdicts; repeated rows stay; an empty table gives none.
    """
    names = {host + path: verdict for verdict, host, path in rules}
    entries = {**dict.fromkeys(blocked, 2), **{e: int(v == "allow") for e, v in names.items()}}
    schema = "page_id long, host string, path string, rule string, listed boolean"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("u")).mapInArrow(_split, schema)
    # an entry of both kinds is told by its verdict; only lists that clash need a table of their own
    both = [e for e in blocked if e in names]
    blocks = DigestTable.built(list(entries.items()), most_bytes) + (DigestTable.built([(e, 2) for e in both], most_bytes) if both else [])
    for place, block in enumerate(blocks):
        rows = rows.mapInArrow(_probed(pages.sparkSession.sparkContext.broadcast(block), place), schema)
    allowed = F.col("rule").isin([e for e, v in names.items() if v == "allow"])
    own = F.when(allowed, "allow").otherwise("block")
    other = F.when(F.col("listed") | (F.col("host") == ""), "block").otherwise("allow")
    return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.when(F.col("rule").isNotNull(), own).otherwise(other).alias("verdict"))
