"""Personal data in whole texts: patterns, and a skip-chain conditional random field.

The patterns give base spans.  The field's nodes are these spans and other stretches that
could be personal data (numbers without a telling mark, addresses written out).  Neighbours
in the text share a transition potential; nodes of the same or a similar content, however
far apart, share a skip potential.  Loopy sum-product messages run until they settle, and a
stretch whose marginal for a kind reaches ``threshold`` becomes a span: so what is certain
at one place carries to the same number or name at another.  Node weights are fitted on a
bounded sample of documents (``sample_docs``); base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.store import written

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = re.compile(r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)+", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
#: Words before a number that tell its kind.
_CUES = (("phone", re.compile(r"(?:tel|phone|call|fax|mobile)\W*$", re.IGNORECASE)), ("card", re.compile(r"(?:card|visa|payment)\W*$", re.IGNORECASE)), ("ip", re.compile(r"(?:ip|host|server|addr\w*)\W*$", re.IGNORECASE)))


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part reaches back from each @ to what its characters or the last match allow."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a run of dotted numbers, where none is above 255."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            quad = parts[i : i + 4]
            end = at + sum(map(len, quad)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in quad)):
                yield at, end
            at = end + 1


def _numbers(text: str, pattern: re.Pattern, least: int, most: int, check) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        digits = "".join(_DIGIT.findall(m.group()))
        if least <= len(digits) <= most and check(digits):
            yield m.span()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in order: leftmost, not overlapping, failing matches dropped."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        out[1] = list(_ips(text))
        out[2] = list(_numbers(text, _CARD, 13, 19, luhn))
        if "+" in text:
            out[3] = list(_numbers(text, _PHONE, 9, 15, lambda d: True))
    return out


@dataclass
class Node:
    """A stretch of text; kind is set where a pattern decided."""

    start: int
    end: int
    content: str
    features: np.ndarray
    kind: int | None


N_FEATURES = 18


def _node(text: str, start: int, end: int, kind: int | None) -> Node:
    raw = text[start:end]
    digits = "".join(_DIGIT.findall(raw))
    spelt = raw.lower().replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".").replace(" ", "")
    name = "@" in spelt
    x = np.zeros(N_FEATURES)
    x[0] = 1
    x[1] = name
    x[2 + min(6, max(0, (len(digits) - 5) // 2))] = not name  # 7-8 digits, 9-10 and so on
    x[9] = raw.startswith(("+", "("))
    x[10] = "(" in raw
    x[11] = "-" in raw
    x[12] = " " in raw
    x[13] = raw.count(".") == 3
    x[14] = 13 <= len(digits) <= 19 and luhn(digits)
    for i, (_, cue) in enumerate(_CUES):
        x[15 + i] = cue.search(text, max(0, start - 12), start) is not None
    return Node(start, end, spelt if name else digits, x, kind)


def nodes(text: str) -> tuple[list[list[tuple[int, int]]], list[Node]]:
    """Base spans, and the field's nodes in text order (base first where stretches overlap)."""
    base = base_spans(text)
    found = [_node(text, a, b, k) for k, spans in enumerate(base) for a, b in spans]
    if found or "(at)" in text or "[at]" in text or _DIGIT.search(text):
        taken = sorted((n.start, n.end) for n in found)
        for pattern in (_LOOSE, _SPELT):
            if pattern is _SPELT and not re.search(r"[(\[]at[)\]]", text, re.IGNORECASE):
                continue
            i = 0
            for m in pattern.finditer(text):
                while i < len(taken) and taken[i][1] <= m.start():
                    i += 1
                if all(a >= m.end() or b <= m.start() for a, b in taken[i : i + 4]):
                    found.append(_node(text, *m.span(), None))
    found.sort(key=lambda n: (n.start, n.end))
    return base, found


def _similar(found: list[Node]) -> list[tuple[int, int]]:
    """Pairs that share a skip potential: each node and its content's hubs, wherever they stand.

    Hubs are the first pattern's span of each kind with the same content, or the same last
    seven digits (a number with and without its prefix); without any, the first node.  So all
    repeats of a number are one step from what decides it, and there are few pairs a node.
    """
    keyed = [[n.content] if "@" in n.content else [n.content, "..." + n.content[-7:]] for n in found]
    first: dict[str, int] = {}
    marked: dict[str, dict[int, int]] = {}
    for i, n in enumerate(found):
        for k in keyed[i]:
            first.setdefault(k, i)
            if n.kind is not None:
                marked.setdefault(k, {}).setdefault(n.kind, i)
    out = []
    for i, n in enumerate(found):
        if n.kind is None:
            hubs = {j for k in keyed[i] for j in (marked[k].values() if k in marked else [first[k]])}
            out += [(min(i, j), max(i, j)) for j in sorted(hubs) if j != i]
    return out


class Field:
    """Weights of the field; marginals by loopy sum-product."""

    def __init__(self, node: np.ndarray, transition: np.ndarray, skip: float = 8.0, doubt: float = 4.0, near: int = 60):
        self.node, self.transition, self.skip, self.doubt, self.near = node, transition, skip, doubt, near

    def marginals(self, found: list[Node], rounds: int | None = None) -> np.ndarray:
        """Until messages settle; at most as many rounds as the longest chain has nodes, and 50."""
        n, k = len(found), OTHER + 1
        rounds = max(50, n) if rounds is None else rounds
        # what a stretch looks like is never certain: bounded, unlike what a pattern decided
        unary = np.stack([x.features for x in found]) @ self.node.T
        unary = np.maximum(unary - unary.max(axis=1, keepdims=True), -self.doubt)
        for i, x in enumerate(found):
            if x.kind is not None:
                unary[i] = -1e6  # beyond what any number of repeats could outvote
                unary[i, x.kind] = 0.0
        edges = [(i, i + 1, self.transition) for i in range(n - 1) if found[i + 1].start - found[i].end <= self.near]
        # a skip edge rewards equal labels, "none" too: repeating a number makes it nobody's
        agree = self.skip * np.eye(k)
        edges += [(i, j, agree) for i, j in _similar(found)]
        if not edges:
            return _softmax(unary)
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        pot = np.stack([e[2] for e in edges])
        right, left = np.zeros((len(edges), k)), np.zeros((len(edges), k))  # messages a to b, b to a
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, b, right)
            np.add.at(belief, a, left)
            new_right = _logsum((belief[a] - left)[:, :, None] + pot, 1)
            new_left = _logsum((belief[b] - right)[:, None, :] + pot, 2)
            new_right -= new_right.max(axis=1, keepdims=True)
            new_left -= new_left.max(axis=1, keepdims=True)
            change = max(np.abs(new_right - right).max(), np.abs(new_left - left).max())
            right, left = 0.5 * (right + new_right), 0.5 * (left + new_left)
            if change < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, b, right)
        np.add.at(belief, a, left)
        return _softmax(belief)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_SAMPLE = pa.schema([("features", pa.list_(pa.float64())), ("kind", pa.int64()), ("next", pa.int64())])


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sink = Sink(_SAMPLE)
    for (text,) in rows_of(batches, 64):
        found = nodes(text or "")[1]
        kinds = [OTHER if x.kind is None else x.kind for x in found]
        for i, x in enumerate(found):
            yield from sink.add((x.features.tolist(), kinds[i], kinds[i + 1] if i + 1 < len(found) else -1))
    yield from sink.end()


def fit(docs: DataFrame, sample_docs: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Weights by piecewise training on about ``sample_docs`` documents, drawn by a hash of the id.

    Labels are the patterns' own; what they leave is no personal data as far as training
    goes, so that unlinked numbers stay out.  No examples, neutral weights.  Examples with equal
    features (there are a few hundred kinds) come as counts, in one order on every run.
    """
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(draw < min(1.0, sample_docs / total)).select(F.col(text_col).alias("t"))
    seen = written(sample.mapInArrow(_examples, "features array<double>, kind long, next long").groupBy("features", "kind", "next").agg(F.count(F.lit(1)).alias("n")), "pii-examples")
    examples = sorted(map(tuple, seen.groupBy("features", "kind").agg(F.sum("n")).collect()))
    pairs = sorted(map(tuple, seen.filter("next >= 0").groupBy("kind", "next").agg(F.sum("n")).collect()))
    k = OTHER + 1
    node, transition = np.zeros((k, N_FEATURES)), np.zeros((k, k))
    node[OTHER, 0] = 3.0
    if examples:
        x, y, n = (np.array(c, float) for c in zip(*examples, strict=True))
        hot, n = np.eye(k)[y.astype(int)], (n / n.sum())[:, None]
        for _ in range(300):  # softmax regression with a ridge
            node -= 1.0 * ((n * (_softmax(x @ node.T) - hot)).T @ x + 1e-3 * node)
        counts = np.ones((k, k))
        for a, b, seen_n in pairs:
            counts[a, b] += seen_n
        joint = counts / counts.sum()
        transition = np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -1.0, 1.0)
    return Field(node, transition)


def joined(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind, then start, with commas."""
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in sorted(found))


def find(text: str | None, field: Field, threshold: float = 0.9) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(base spans, all spans) by kind, in code points."""
    base, found = nodes(text or "")
    spans = [list(s) for s in base]
    # a stretch gets its label only by a link to a pattern's span of the text, or by clear features
    if any(x.kind is None for x in found):
        p = field.marginals(found)
        for x, row in zip(found, p, strict=True):
            best = int(row[:OTHER].argmax())
            if x.kind is None and row[best] >= threshold:
                spans[best].append((x.start, x.end))
    return base, [sorted(s) for s in spans]


_OUT = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def personal_data(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256
    (of base spans as text) and spans (all spans as text).

    * null and empty texts have no spans; whole texts are read, of any length, and scanning
      is linear in it; base spans of different kinds may overlap, added ones overlap none;
    * equal texts, equal results; repeated rows stay; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, **bounds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(_OUT)
        for ident, text in rows_of(batches):
            base, spans = find(text, shared.value, threshold)
            said = joined(spans)
            yield from sink.add((ident, *map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), said), 128 + len(said))
        yield from sink.end()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
