"""The pipeline against its stages' plain versions, and what every stage must stand."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.helpers import documents, prose, with_clashes
from tests.llm.test_operators import plain_exact, plain_near, spoken
from tomeloom.llm import mixing

STAGES = dict(corpus_pipeline.STAGES)


def test_run_does_what_its_stages_do(spark, tmp_path):
    langs = ["aa", "bb"]
    data = [(i, spoken(langs[i % 2], i, 60 + i), langs[i % 2], f"s{i % 4}", None) for i in range(120)]
    data += [(200 + i, data[i][1].replace(" ", "\n", 2), "aa", "s1", None) for i in range(0, 40, 3)]  # copies
    data += [(500 + i, data[i][1] + " extra", "bb", "s2", None) for i in range(100, 110)]
    data += [(400, None, "aa", "s0", None), (401, "!!! 123", None, "s0", None)]
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in data if r[0] not in (400, 401)]
    kept = {keep for _, keep, *_ in plain_exact([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in kept]
    kept = plain_near([(r[0], r[1]) for r in rows])
    docs = documents(spark, data)
    for name in ("language", "exact", "near"):
        docs = STAGES[name](spark, docs, "")
    assert {r.doc_id for r in docs.collect()} == kept
    taken = {r.doc_id for r in mixing.mix(docs).filter("taken > 0").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == taken


@pytest.mark.parametrize("name", ["language", "exact", "near", "mixture"])
def test_stages_keep_columns(spark, name):
    docs = documents(spark)
    out = STAGES[name](spark, with_clashes(docs), "")
    assert out.columns == with_clashes(docs).columns
    assert out.count() > 0
    assert STAGES[name](spark, documents(spark, []), "").count() == 0


def test_packed_stage_stands_special_cases(spark):
    docs = documents(spark)
    got = STAGES["packed"](spark, with_clashes(docs), "").collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    sizes = {}
    for r in got:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048 and sum(r.length for r in got if r.doc_id == 5) == 1
    assert STAGES["packed"](spark, documents(spark, []), "").count() == 0


def test_stages_keep_rows_without_ids_and_with_repeated_ones(spark):
    base = [(i, spoken("aa", i, 60), "aa", "s", None) for i in range(60)]
    data = [*base, (None, spoken("aa", 900, 60), "aa", "s", None), (7, spoken("aa", 901, 60), "aa", "s", None)]
    docs = documents(spark, data)
    for name in ("language", "exact", "near", "mixture"):
        docs = STAGES[name](spark, docs, "")
        assert sorted(map(repr, (r.text for r in docs.collect()))) == sorted(repr(r[1]) for r in data), name


def test_clean_documents_stay(spark):
    docs = documents(spark, [(i, spoken("aa", i, 50) + " " + prose(i, 20), "aa", "s", None) for i in range(200)])
    for name in ("language", "exact", "near"):
        docs = STAGES[name](spark, docs, "")
        assert docs.count() == 200, name


def test_near_stage_drops_copies_at_080_to_095(spark):
    """Copies of ordinary length with words replaced: five-word similarity decides, not two bits."""
    import random

    def sim(a, b):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    r = random.Random(8)
    data, gone, stay = [], set(), set()
    for i in range(120):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(100, 400))]
        copy = list(words)
        for k in r.sample(range(len(words)), max(1, int(len(words) * r.choice([0.005, 0.01, 0.02, 0.05])))):
            copy[k] = f"new{k}"
        data += [(i, " ".join(words), "en", "s", None), (1000 + i, " ".join(copy), "en", "s", None)]
        (gone if sim(*(" ".join(x) for x in (words, copy))) >= 0.8 else stay).add(1000 + i)
    data += [(None, data[0][1] + " more", "en", "s", None), (None, "no id and like nothing else here", "en", "s", None)]
    data += [(i, "one text. " + f"hot {i}" + " more words of it" * 60, "en", "s", None) for i in range(5000, 5060)]
    assert len(gone) > 60 and len(stay) > 10
    kept = {r.doc_id for r in STAGES["near"](spark, with_clashes(documents(spark, data)).repartition(5), "").collect()}
    assert not kept & gone and stay <= kept and set(range(120)) <= kept
    assert None in kept



def test_near_makes_its_shard_rows_without_copies_of_them():
    """Workers' memory is bounded: what makes the rows of a block's shards takes less than twice their size."""
    import tracemalloc

    import numpy as np

    from tomeloom.llm import near

    prints = np.random.default_rng(0).integers(0, 1 << 62, (4000, 3 + near.WORDS), np.int64)
    bits, tables = near.block_plan(len(prints))
    tracemalloc.start()
    rows, document = near._shard_rows(prints, bits, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.8 * rows.nbytes
    assert (rows[:, 1:] == prints[document]).all() and (near._keys(prints, bits, tables)[document].T == rows[:, 0]).any(axis=0).all()
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    assert (order == np.arange(len(rows))).all()
    assert list(near.released(lambda batches: iter(batches))([1, 2])) == [1, 2]


def test_text_goes_to_workers_in_small_batches(spark):
    """An executor's memory holds batches of texts beside its heap: each is of some MB, whatever texts are like."""
    import pyarrow as pa

    from tomeloom.llm import arrow

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 2000) as t")
    before = spark.conf.get(arrow._BATCH)
    try:
        for name in ("language", "near", "packed"):
            spark.conf.set(arrow._BATCH, before)
            STAGES[name](spark, documents(spark), "")
            rows = texts.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) < 2 * arrow.SENT_BYTES, name
    finally:
        spark.conf.set(arrow._BATCH, before)


def test_workers_keep_no_tokenizer_for_other_stages():
    from tomeloom.llm import arrow
    from tomeloom.llm.queries import tokenizer_path
    from tomeloom.llm.tokens import token_ids

    with open(tokenizer_path(), encoding="utf-8") as f:
        made = token_ids(text := f.read())
    assert token_ids(text) is made  # kept for the next task of packing
    assert made("plain words, Plain words") == made.plain("plain words, Plain words")
    assert "plain" in made.chunks and "plain" not in made.pieces  # a word is kept once
    assert list(arrow.released(lambda batches: iter([*batches, len(arrow.kept)]))([7])) == [7, 0]
    assert token_ids(text) is not made
