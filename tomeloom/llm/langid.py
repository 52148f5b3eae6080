"""Language identification by interpolated Kneser-Ney character models.

Texts become letters (lower case) and single spaces.  For each language a 4-gram model with
interpolated Kneser-Ney smoothing is estimated; all of them are stored as sorted arrays of
64-bit keys (a perfect hash of up to four 16-bit characters) beside a matrix of log
probabilities with a column for each language, so one binary search scores a character in
every language.  (Characters beyond 16 bits are one symbol.)  The language of least
cross-entropy per character wins.

Rejection is calibrated on held-back training texts: a language's excess is a text's entropy
above the language's mean, in units of the spread that texts of its length have; the mean
of what the highest twentieth (ten at least) have beyond the rest, taken for an exponential
tail, gives the excess that a share of ``false_rejects`` of the language's own texts passes.

The classifier is fitted on a bounded sample of the labelled rows (``per_lang`` rows a
language, chosen by a hash of the id), of which it keeps every language and 4-gram; it scores
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, released, rows_of
from tomeloom.llm.store import small_join, written

ORDER = 4
#: Characters that a model that knows nothing takes for equally likely.
ALPHABET = 4096.0
#: Held-back texts that a language needs for a limit of its own.
TAIL = 20
_SPACE = 32
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(text: str | None) -> np.ndarray:
    """Code points: ORDER - 1 spaces, then letters with single spaces between; empty if no letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letter_table()[raw]
    if not letters.any():
        return np.empty(0, np.uint64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    out = np.where(letters, np.minimum(raw, 0xFFFF), _SPACE)[keep]
    if out[-1] != _SPACE:
        out = np.append(out, _SPACE)
    return np.concatenate([np.full(ORDER - 1, _SPACE), out]).astype(np.uint64)


def grams(chars: np.ndarray) -> np.ndarray:
    """The key of the ORDER characters up to each one."""
    n = len(chars) - ORDER + 1
    key = np.zeros(n, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(16)) | chars[i : i + n]
    return key


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to counts, combined within a task as far as memory allows."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        sink = Sink(_COUNTS)
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            for k, c in zip(keys.view(np.int64).tolist(), n.tolist(), strict=True):
                yield from sink.add((lang, k, c))
        yield from sink.end()
        held.clear()

    for lang, text in rows_of(batches):
        chars = characters(text)
        if len(chars):
            held.setdefault(lang, []).append(grams(chars))
            size += len(chars)
        if size > 4_000_000:
            yield from flush()
            size = 0
    yield from flush()


class Model:
    """Sorted key arrays and log-probability matrices by order, for a list of languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.mean = np.zeros(len(self.langs))
        self.spread = np.ones((2, len(self.langs)))
        self.limit = np.full(len(self.langs), np.inf)
        self.sharpness = 16.0
        if not self.langs:
            return
        types = {lang: [None] * (ORDER + 1) for lang in self.langs}
        for lang, (keys, n) in counts.items():
            order = np.argsort(keys)
            types[lang][ORDER] = (keys[order], n[order].astype(float))
            for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
                below, n = np.unique(types[lang][k + 1][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
                types[lang][k] = (below, n.astype(float))
        self.keys, self.logp, self.contexts, self.logback = [None], [None], [None], [None]
        lower, lower_keys = np.full((1, len(self.langs)), 1.0 / ALPHABET), None
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([types[lang][k][0] for lang in self.langs]))
            contexts = np.unique(keys >> np.uint64(16))
            p, back = np.zeros((len(keys), len(self.langs))), np.ones((len(contexts), len(self.langs)))
            at = np.searchsorted(contexts, keys >> np.uint64(16))
            for j, lang in enumerate(self.langs):
                own, n = types[lang][k]
                ones, twos = float((n == 1).sum()), float((n == 2).sum())
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                where = np.searchsorted(contexts, own >> np.uint64(16))
                total = np.bincount(where, n, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, own)] = n - discount
                p[:, j] = np.where(total[at] > 0, c / np.maximum(total[at], 1), 0.0)
            under = np.zeros(len(keys), int) if lower_keys is None else np.searchsorted(lower_keys, keys & np.uint64((1 << (16 * (k - 1))) - 1))
            p += back[at] * lower[under]
            lower, lower_keys = p, keys
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(contexts)
            self.logback.append(np.log(back).astype(np.float32))

    def log_probabilities(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """A row for each key: its last character's log probability in each language."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), -np.log(ALPHABET), np.float32)
        at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
        out = self.logp[k][at]
        missing = np.flatnonzero(self.keys[k][at] != keys)
        if len(missing):
            gone = keys[missing]
            rows = self.log_probabilities(gone & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
            context = gone >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            out[missing] = rows + np.where(known[:, None], self.logback[k][at], 0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) by language, and the count of characters (0: no letter)."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        part, rows, held = [], [], 0

        def flush() -> None:
            if part:
                starts = np.cumsum([0, *[len(p) for p in part[:-1]]])
                sums = np.add.reduceat(self.log_probabilities(np.concatenate(part)), starts, axis=0, dtype=np.float64)
                for i, p, s in zip(rows, part, sums, strict=True):
                    out[i] += s
                    sizes[i] += len(p)
                part.clear()
                rows.clear()

        for i, text in enumerate(texts):
            chars = characters(text)
            if not len(chars):
                continue
            keys = grams(chars)
            for at in range(0, len(keys), 1 << 16):
                part.append(keys[at : at + (1 << 16)])
                rows.append(i)
                held += len(part[-1])
                if held >= 1 << 16:
                    flush()
                    held = 0
        flush()
        return -out / np.maximum(sizes, 1)[:, None], sizes

    def excess(self, entropies: np.ndarray, sizes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Entropy above the language's mean, over the spread of its texts of that length: a part
        that all texts have, and one that falls with the square root of the length."""
        spread = np.sqrt(self.spread[0][lang] + self.spread[1][lang] / np.maximum(sizes, 1))
        return (entropies - self.mean[lang]) / spread

    def calibrate(self, labels: list[str], entropies: np.ndarray, sizes: np.ndarray, false_rejects: float = 1e-4) -> None:
        """Usual cross-entropy and limit of each language, and how sharply a lead tells languages apart."""
        known = np.array([self.langs.index(x) for x in labels])
        best = entropies.argmin(axis=1)
        for j in range(len(self.langs)):
            mine = (known == j) & (best == j)
            own, n = entropies[mine, j], np.maximum(sizes[mine], 1)
            if len(own) < TAIL:
                continue  # too few to know: nothing of this language is rejected
            self.mean[j] = np.average(own, weights=n / (n + 100.0))
            square = (own - self.mean[j]) ** 2
            # least squares of a + b / n on the squared differences, neither below a floor
            a, b = np.linalg.lstsq(np.stack([np.ones(len(n)), 1.0 / n], axis=1), square, rcond=None)[0]
            self.spread[:, j] = max(a, 1e-4), max(b, 1e-2)
            found = np.sort(self.excess(own, n, np.full(len(n), j)))
            beyond = max(10, len(found) // 20)
            start = found[-beyond - 1]
            self.limit[j] = start + (found[-beyond:] - start).mean() * np.log(beyond / len(found) / false_rejects)
        lead = entropies - entropies.min(axis=1, keepdims=True)
        loss = []
        for t in (steps := 2.0 ** np.arange(0, 8)):
            p = np.exp(-t * lead)
            p /= p.sum(axis=1, keepdims=True)
            loss.append(-np.log(np.maximum(p[np.arange(len(known)), known], 1e-9)).mean())
        self.sharpness = float(steps[int(np.argmin(loss))])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score from 0 to 1, cross-entropy, rejected) of each text; `und` without letters."""
        if not self.langs:
            return [("und", 0.0, None, True)] * len(texts)
        h, sizes = self.entropies(texts)
        best = h.argmin(axis=1)
        least = h[np.arange(len(best)), best]
        score = 1.0 / np.exp(-self.sharpness * (h - least[:, None])).sum(axis=1)
        over = self.excess(least, sizes, best) > self.limit[best]
        return [("und", 0.0, None, True) if not n else (self.langs[b], float(s), float(e), bool(r)) for b, s, e, r, n in zip(best.tolist(), score, least, over, sizes, strict=True)]


def held_out(ident: Column) -> Column:
    """Never learnt from: crc32 of the id as text leaves 1 when divided by 3 (or the id is null)."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, per_lang: int = 4_000, false_rejects: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled rows that are not held out: about ``per_lang`` rows a language.

    A fifth of the sample is kept back to calibrate scores and rejection.  Null labels and
    null texts teach nothing; without labelled rows every text is `und`.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("total")), "languages")
    if not sizes.limit(1).count():
        return Model({})
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = small_join(labelled, sizes, ["lang"]).filter(draw < F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("total")))
    fold = F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(5)) == 0
    sample = written(sample.select("lang", "t", fold.alias("back")), "language-sample")
    counts = sample.filter("not back").select("lang", "t").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs, keys, sums = (found.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    model = Model({lang: (keys[langs == lang].astype(np.int64).view(np.uint64), sums[langs == lang]) for lang in dict.fromkeys(langs.tolist())})
    if model.langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        back = sample.filter("back").select("lang", "t").mapInArrow(_scored(shared, len(model.langs)), "lang string, n long, h array<double>").toPandas()
        back = back[back["lang"].isin(model.langs) & (back["n"] > 0)]
        if len(back):
            model.calibrate(back["lang"].tolist(), np.stack(back["h"].to_list()), back["n"].to_numpy(), false_rejects)
    return model


def _scored(shared, width: int):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("h", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for lang, text in rows_of(batches):
            h, n = shared.value.entropies([text])
            yield from sink.add((lang, int(n[0]), h[0].tolist()))
        yield from sink.end()

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, cross_entropy, rejected.

    * null texts and texts without a letter are `und` with score 0, and rejected;
    * equal texts have equal results; ties go to the language first in order;
    * whole texts are scored, of any length, in bounded pieces; an empty table gives none;
    * neither label, id nor any other column takes part in a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds))
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                judged = zip(*model.judge(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), t) for c, t in zip(judged, schema.types[2:], strict=True)]], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("h"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """docs without the rows whose language is rejected, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds))
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array([not r[3] for r in shared.value.judge(part.column(place).to_pylist())], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
