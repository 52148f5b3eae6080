"""Each operator against a plain version of its contract, and its special cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import documents, prose, rows, with_clashes
from tomeloom.llm import components, exact_dedup, gif, langid, mixing, near, packing, pii, simhash, spans, urls, warc
from tomeloom.llm.queries import tokenizer_path

# --- 5 exact dedup ---------------------------------------------------------------------------


def plain_exact(data):
    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    groups = defaultdict(list)
    for ident, text, *_ in data:
        groups[norm(text)].append(ident)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    docs = documents(spark)
    got = exact_dedup.exact_groups(with_clashes(docs).repartition(7), fan_in=2)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == plain_exact(map(tuple, docs.collect()))
    kept = got.filter("kept")
    assert kept.count() == got.select("text_sha256").distinct().count()
    assert kept.filter("doc_id <> keep_id").count() == 0


def test_exact_empty_and_hot(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    hot = documents(spark, [(i, "same  text" if i % 3 else f"own {i}", None, None, None) for i in range(300)]).repartition(20)
    got = exact_dedup.exact_groups(hot)
    assert got.filter("group_size = 200 and keep_id = 1").count() == 200
    assert exact_dedup.drop_exact_copies(with_clashes(hot)).count() == 101
    assert exact_dedup.drop_exact_copies(documents(spark)).filter("doc_id = 10").count() == 1


# --- 2 SimHash -------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(data):
    prints = [(i, plain_fingerprint(t)) for i, t in data]
    label = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return sorted((i, f"{f:016x}", label[i]) for i, f in prints)


def test_near_groups(spark):
    data = [(i, t) for i, t, *_ in map(tuple, documents(spark).dropDuplicates(["doc_id"]).collect()) if i is not None]
    base = prose(11, 4000)
    words = base.split()
    for k in range(12):
        data.append((100 + k, " ".join(words[:k] + [f"w{k}"] + words[k:])))
    docs = documents(spark, [(i, t, None, None, None) for i, t in data])
    got = simhash.near_groups(with_clashes(docs))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = plain_components(data)
    assert rows(got) == sorted(want, key=repr)
    assert len({c for *_, c in want}) < len(want) - 3  # the near copies do link
    assert simhash.near_groups(documents(spark, [])).count() == 0


def plain_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def plain_near(data, least=0.8):
    """Ids that stay if each text similar to a smaller id's goes."""
    found = [(i, plain_shingles(t)) for i, t in sorted(data)]
    return {i for n, (i, a) in enumerate(found) if all(len(a & b) < least * len(a | b) for _, b in found[:n])}


def test_wide_fingerprint_against_plain():
    found = near.shingles(prose(3, 9000))
    for part in (found[:1], found[:300], found):
        counts = np.zeros(near.WIDTH, int)
        for f in part.tolist():
            for w in range(near.WORDS):
                x = (f ^ int(near._MASKS[w])) * int(near._FACTORS[0, w]) % 2**64
                x = (x ^ x >> 31) * int(near._FACTORS[1, w]) % 2**64
                x ^= x >> 32
                counts[64 * w : 64 * w + 64] += [x >> b & 1 for b in range(64)]
        bits = np.unpackbits(near.wide_fingerprint(part).view(np.uint8), bitorder="little")
        assert (bits == (2 * counts > len(part))).all()


def test_near_copies_against_plain(spark):
    """Hot groups of copies, texts that share much but not enough, short texts, one id on two texts."""
    import random

    r = random.Random(4)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(n)] for n in (60, 90, 200, 400)]
    data = []
    for n in range(300):
        words = list(base[n % 4] if n % 3 else [f"v{r.randint(0, 3000)}" for _ in range(80)])
        for _ in range(r.choice([0, 1, 1, 2, 12, 30])):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        data.append((n, " ".join(words)))
    data += [(1000, "one two"), (1001, "One  two"), (1002, "one two three"), (1003, ""), (1004, None), (1005, " \n")]
    docs = documents(spark, [(i, t, None, None, None) for i, t in data])
    by = {i: plain_shingles(t) for i, t in data}
    for dealt in (with_clashes(docs).repartition(6), docs.coalesce(1)):
        kept = {x.doc_id for x in near.drop_near_copies(dealt).collect()}
        similar = {(i, j) for i in by for j in by if j < i and len(by[i] & by[j]) >= 0.8 * len(by[i] | by[j])}
        assert not [p for p in similar if p[0] in kept and p[1] in kept]
        assert set(by) - kept <= {i for i, _ in similar}
        assert {1000, 1002, 1003} == kept & set(range(1000, 1010)) and len(kept) < 250
    twice = documents(spark, [(7, base[0][0] + " other text of five words", "en", "a", 1), (7, " ".join(base[1]), "en", "b", 2), (9, " ".join(base[1]) + " more", "en", "b", 2)])
    assert sorted((x.doc_id, x.source) for x in near.drop_near_copies(twice).collect()) == [(7, "a"), (7, "b")]
    assert near.drop_near_copies(documents(spark, [])).count() == 0


def test_no_near_copy_at_the_threshold_stays(spark):
    """Pairs of just 0.8, in blocks of their own: each larger one goes, and chains go as far as they reach."""
    data = []
    for n in range(3000):
        words = [f"w{n}.{k}" for k in range(13)]
        data += [(n, " ".join(words)), (10_000 + n, " ".join([*words[:12], "other"]))]
    chain = [f"c{k}" for k in range(60)]
    data += [(20_000 + k, " ".join([*chain[3 * k :], *[f"d{x}" for x in range(3 * k)]])) for k in range(8)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in data])
    kept = {x.doc_id for x in near.drop_near_copies(docs.repartition(8)).collect()}
    assert kept == plain_near(data[-8:]) | set(range(3000))


def test_prefixes_of_similar_texts_meet():
    """Whatever is ordered last, two sets of 0.8 share one of their first shingles."""
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 10, 64, 401):
        a = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[: math.ceil(0.8 * len(a))], r.integers(0, 1 << 64, 0, np.uint64)]))
        for last in (a[:0], a[::2], b, np.sort(r.integers(0, 1 << 64, 9, np.uint64))):
            rank = r.permutation(len(last))
            assert near.similarity(a, b) >= 0.8
            assert len(np.intersect1d(near._prefix(a, 0.8, last, rank), near._prefix(b, 0.8, last, rank)))


def test_near_copies_leave_little_on_disk(spark, monkeypatch):
    """Shingles of whole texts are not stored, steps' tables go when it ends, and many documents that are gone are joined."""
    from pathlib import Path

    from tomeloom.sources.tables import shared_dir

    data = [(n, prose(n, 400)) for n in range(40)] + [(100 + n, prose(n, 400) + " more") for n in range(20)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in data])
    at = Path(shared_dir(spark).removeprefix("file://")) / "tables"
    for most in (near.SENT, 5):
        monkeypatch.setattr(near, "SENT", most)
        before = set(at.glob("*")) if at.exists() else set()
        kept = {x.doc_id for x in near.drop_near_copies(docs.repartition(4)).collect()}
        assert kept == plain_near(data) and len(kept) < 60
        assert {p.name.rsplit("-", 1)[0] for p in set(at.glob("*")) - before} == {"gone"}
    assert "s" not in near._WHOLE.names


def test_long_texts_that_share_nothing_are_refuted_by_their_bins():
    r = np.random.default_rng(6)
    for n in (300, 3000, 30_000):
        a, b = (np.unique(r.integers(0, 1 << 64, n, np.uint64)) for _ in range(2))
        c = np.unique(np.concatenate([a[: int(0.95 * n)], b[: n // 50]]))
        assert not near._bins_allow(near._binned(a), near._binned(b), 0.8)
        assert near.similarity(a, c) >= 0.8 and near._bins_allow(near._binned(a), near._binned(c), 0.8)
    some = np.unique(r.integers(0, 1 << 64, 2300, np.uint64))  # of two sizes, and so of two numbers of bins
    assert near._bins_allow(near._binned(some), near._binned(some[:2000]), 0.8)


def test_shards_give_a_follower_few_pairs():
    """A hot shard is no all-pairs table, and each of its rows is led by one within the radius."""
    r = np.random.default_rng(2)
    centre = r.integers(0, 1 << 62, near.WORDS)
    rows = np.zeros((3000, 4 + near.WORDS), np.int64)
    rows[:, 1] = np.arange(3000)
    rows[:, 3] = 100
    rows[:, 4:] = centre ^ (np.int64(1) << r.integers(0, 62, (3000, near.WORDS)))
    assert near._followers(rows, 40, 0.8) == [(n, 0) for n in range(1, 3000)]
    small = rows[: near.SCREEN]
    small[::2, 4:] = r.integers(0, 1 << 62, (len(small[::2]), near.WORDS))
    assert near._followers(small, 40, 0.8) == [(n, 1) for n in range(3, len(small), 2)]


def test_repeated_and_null_ids_share_components(spark):
    got = simhash.near_groups(documents(spark))
    assert got.count() == documents(spark).count()
    assert {r.component_id for r in got.filter("doc_id in (5, 6, 7, 8)").collect()} == {5}


def test_links_in_split_shards(spark):
    """Fingerprints that all share 32 bits, in shards that must be split."""
    r = np.random.default_rng(3)
    values = {int(x) for x in r.integers(0, 1 << 32, 300)}
    values |= {v ^ (1 << int(b)) ^ (1 << int(c)) for v, b, c in zip(list(values)[:80], r.integers(0, 32, 80), r.integers(0, 32, 80))}
    data = [(v, n) for n, v in enumerate(sorted(values))]
    prints = spark.createDataFrame(data, "fp long, node long")
    found = components.components(simhash.links(prints, shard_limit=50)).collect()
    label = {r.node: r.component for r in found}
    want = {n: n for _, n in data}
    for v, n in data:
        for w, m in data:
            if (v ^ w).bit_count() <= 2:
                want[n] = min(want[n], m)
    for _ in range(20):
        for v, n in data:
            want[n] = want[want[n]]
    assert all((label.get(n, n) == label.get(m, m)) for v, n in data for w, m in data if (v ^ w).bit_count() <= 2)
    assert set(label) == {n for n, c in want.items() if c != n}


def test_bk_tree_finds_all():
    r = np.random.default_rng(5)
    values = [int(x) for x in r.integers(0, 1 << 16, 400)]
    tree = simhash.BKTree()
    for v in dict.fromkeys(values):
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2001, 2000), (2000, 2001)], "u long, v long").repartition(8)
    got = dict(map(tuple, components.components(edges).collect()))
    assert {v: got.get(v, v) for v in range(n + 1)} == dict.fromkeys(range(n + 1), 0)
    assert got[2001] == 2000 and 1000 not in got


# --- 10 mixing -------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def test_mix(spark):
    data = [(i, prose(i, 20 + i % 50), None, f"s{i % 7}" if i % 11 else None, None) for i in range(400)]
    data += [(1000 + i, prose(i, 900), None, "s0", None) for i in range(60)] + [(2000, None, None, "s1", None), (2001, "", None, "empty", None)]
    docs = documents(spark, data)
    got = mixing.mix(with_clashes(docs)).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, abs=1)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(9)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixed_documents_have_the_words_taken(spark):
    docs = documents(spark)
    plan = mixing.mix(docs).groupBy("doc_id").sum("taken").collect()
    out = mixing.mixed_documents(with_clashes(docs))
    words = defaultdict(int)
    for r in out.select("doc_id", "text", "n_chars").collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in words.items() if v} == {r[0]: r[1] for r in plan if r[1]}
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixture_takes_each_text_of_one_id(spark):
    data = [(1, "a b c. d e f", "en", "s", 1), (1, "x y", "en", "s", 1), (1, "x y", "de", "s", 1), (2, "p q r", "en", "s", 1), (None, "n n n n", "en", "s", 1)]
    docs = documents(spark, data)
    out = mixing.mixed_documents(with_clashes(docs))
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id, r.lang, r.text.split()[0]] += len(r.text.split())
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    by_id = defaultdict(int)
    for (i, *_), n in words.items():
        by_id[i] += n
    assert by_id == taken  # one source: each row once
    assert words == {(1, "en", "a"): 6, (1, "en", "x"): 2, (1, "de", "x"): 2, (2, "en", "p"): 3, (None, "en", "n"): 4}


# --- 1 packing -------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(with_clashes(docs).repartition(3), tokenizer_path(), block_tokens=5000).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append(r)
    for ident, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == len(ids[ident])
    assert set(pieces) == set(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= r.sequence_tokens <= 2048
        assert r.sequence_tokens in (at, 2048)
        padding += r.sequence_tokens - at
    assert padding <= 3 * 2047
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


def test_packing_repeated_rows_and_tiers():
    docs = [packing._Doc(i, b"\0" * 4 * n) for i, n in enumerate([100, 300, 700, 1500, 2500, 2048, 1, 90, 256] * 20)]
    total = sum(d.tokens for d in docs)
    windows = packing.pack_block(packing.Pool(packing.TIERS), docs, True)
    assert sum(length for _, pieces in windows for _, _, length in pieces) == total
    sizes = [size for size, _ in windows]
    assert sum(sizes) - total < 2048
    assert set(sizes) >= {2048, 1024, 256}
    groups = packing.step_groups(sizes, 16 * 2048)
    tokens = defaultdict(int)
    for g, s in zip(groups, sizes):
        tokens[g] += s
    assert max(tokens.values()) - min(tokens.values()) <= 2048


def test_token_ids_are_the_tokenizers():
    from tomeloom.llm.tokens import TokenIds

    with open(tokenizer_path(), encoding="utf-8") as f:
        t = TokenIds(f.read(), chunks=5, pieces=5)
    for text in ["", "it's 'TIS we'll I'd", "<|endoftext|> a<|endoftext|>b", "naïve Straße ΣΊΣΥΦΟΣ İı", "a\x1cb c\x1fd", "été ́x", "½²ª 中文😀 a b　c\x85d", "x" * 3000, "1,234.5%%%--"]:
        assert t(text) == t.plain(text), text
        assert t(text) == t.plain(text), text


# --- 3 language ------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ver"], "cc": ["eau", "tion", "ou", "ê"]}


def spoken(lang, seed, n):
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language(spark):
    langs = sorted(SYLLABLES)
    data = [(i, spoken(langs[i % 3], i, 30 + i % 20), langs[i % 3], "s", None) for i in range(600)]
    special = [(9000, None, "aa", "s", None), (9001, "12 ... !!", "bb", "s", None), (9002, "", None, None, None), (9003, "qqxj zzvw qxqj vvzz wqqx jjvq xzzw " * 30, None, "s", None)]
    docs = documents(spark, data + special)
    got = {r.doc_id: r for r in langid.identify(with_clashes(docs)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert sum(r.lang_pred == langs[r.doc_id % 3] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert got[9003].rejected and sum(r.rejected for r in got.values() if r.doc_id < 9000) == 0
    kept = langid.drop_rejected(with_clashes(docs))
    assert kept.count() == 600 and "clash" in {r.fp for r in kept.limit(1).collect()}
    # a prediction reads the text alone
    bare = documents(spark, [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, None, None) for i, t, lang, *_ in data])
    assert {r.doc_id: r.lang_pred for r in langid.identify(bare).collect()} == {i: r.lang_pred for i, r in got.items() if i < 9000}


def test_language_without_labels(spark):
    assert {r.lang_pred for r in langid.identify(documents(spark, [(1, "abc", None, None, None)])).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).count() == 0
    assert langid.identify(documents(spark)).count() == documents(spark).count()


def test_language_models_keep_all_of_the_sample(spark):
    """More 4-grams than 600,000, and more languages than 1000: none is forgotten."""
    r = np.random.default_rng(1)
    data = [(i, "".join(map(chr, r.integers(0x4E00, 0x9F00, 500))), "mm", None, None) for i in range(3000)]
    data += [(5000 + i, "".join(map(chr, r.integers(0xAC00, 0xD7A0, 60))), "zz", None, None) for i in range(40)]
    model = langid.fit(documents(spark, data))
    assert model.langs == ["mm", "zz"] and len(model.keys[langid.ORDER]) > 600_000
    assert model.judge([data[-1][1]])[0][0] == "zz"
    many = documents(spark, [(i, "banana", f"l{i:04d}", None, None) for i in range(2000)])
    assert len(langid.fit(many).langs) > 1000


def plain_kneser_ney(texts):
    """log p(next | context of up to three), straight from the definition."""
    order = langid.ORDER
    counts = [None] + [defaultdict(float) for _ in range(order)]
    for t in texts:
        c = langid.characters(t).tolist()
        for i in range(order - 1, len(c)):
            counts[order][tuple(c[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1

    def p(context, char):
        if len(context) < 0:
            return 1 / langid.ALPHABET
        k = len(context) + 1
        lower = 1 / langid.ALPHABET if k == 1 else p(context[1:], char)
        mine = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not mine:
            return lower
        ones, twos = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(mine.values())
        return max(mine.get((*context, char), 0) - d, 0) / total + d * len(mine) / total * lower

    return p


def test_kneser_ney_against_plain():
    texts = ["banana bandana cabana", "the cat in the hat", "ban the bat"]
    keys, n = np.unique(np.concatenate([langid.grams(langid.characters(t)) for t in texts]), return_counts=True)
    model, p = langid.Model({"x": (keys, n)}), plain_kneser_ney(texts)
    for asked in ("banana hat", "zebra", "cabin", "the the"):
        c = langid.characters(asked).tolist()
        want = [np.log(p(tuple(c[i - 3 : i]), c[i])) for i in range(3, len(c))]
        assert model.log_probabilities(langid.grams(langid.characters(asked)))[:, 0] == pytest.approx(want, abs=1e-4)


def test_kneser_ney_sums_to_one():
    chars = langid.characters("banana bandana cabana")
    keys, n = np.unique(langid.grams(chars), return_counts=True)
    model = langid.Model({"x": (keys, n)})
    letters = np.unique(chars)
    context = langid.grams(langid.characters("ban"))[-1] & np.uint64((1 << 48) - 1)
    p = np.exp(model.log_probabilities((context << np.uint64(16)) | letters))[:, 0]
    rest = np.exp(model.log_probabilities(np.array([(context << np.uint64(16)) | np.uint64(0x4E2D)], np.uint64)))[0, 0]
    assert p.sum() + rest * (langid.ALPHABET - len(letters)) == pytest.approx(1, abs=1e-3)


# --- 4 personal data -------------------------------------------------------------------------


def plain_base(text):
    def luhn(d):
        return pii.luhn(d)

    out = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]]
    out.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))])
    out.append([m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and luhn(d)])
    out.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15])
    return out


def test_base_spans_are_the_patterns():
    import random

    r = random.Random(4)
    for _ in range(30_000):
        text = "".join(r.choice("ab@..+-1234567890 ()_%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ["4111 1111 1111 1111", "+1 (877) 555-5242", "a@b.c@d.e", "256.1.1.1.2.3.4.5", "x@y", "1.2.3.4.5.6.7.8.9"]:
        assert pii.base_spans(text) == plain_base(text)


def test_skip_chain_carries_labels(spark):
    texts = [prose(i, 40) + f" Call +1 (877) 555-{1000 + i} now. " + prose(i + 500, 30) + (f" Again 877 555-{1000 + i} here." if i % 2 else "") for i in range(60)]
    texts += [prose(i, 30) + f" order 20{i:02d} 1234 {i:02d}77 done" for i in range(60)]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, None, None), (902, "7" * 50_000 + "@" * 50_000, None, None, None)]
    got = {r.doc_id: r for r in pii.personal_data(with_clashes(documents(spark, data))).collect()}
    for i, t, *_ in data:
        base = plain_base(t or "") if i != 902 else [[], [], [], []]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [len(b) for b in base]
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(got[i].spans.split(","))
    for i in range(60):
        assert got[i].spans.count("phone:") == 1 + i % 2, texts[i]
        assert got[60 + i].spans == ""
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_long_words_beside_a_spelt_address():
    import time

    start = time.monotonic()
    text = "A" * 80_000 + " me (at) " + "B" * 80_000 + " me(at)example(dot)org"
    _, found = pii.nodes(text)
    assert time.monotonic() - start < 1 and [text[x.start : x.end] for x in found] == ["me(at)example(dot)org"]


def test_marginals_are_exact_on_chains():
    """Sum-product on a graph without loops gives what summing over all labellings gives."""
    import itertools

    r = np.random.default_rng(3)
    k = pii.OTHER + 1
    field = pii.Field(r.normal(size=(k, pii.N_FEATURES)), r.normal(size=(k, k)), skip=2.0, doubt=50.0)
    at = [(0, "1111111"), (20, "2222222"), (200, "3333333"), (400, "1111111"), (600, "9993333333")]
    found = [pii.Node(a, a + 10, c, r.normal(size=pii.N_FEATURES), None) for a, c in at]
    links = pii._similar(found)
    assert links == [(0, 3), (2, 4)]
    unary = np.stack([x.features for x in found]) @ field.node.T
    total = np.zeros((5, k))
    for labels in itertools.product(range(k), repeat=5):
        e = sum(unary[i, y] for i, y in enumerate(labels)) + field.transition[labels[0], labels[1]] + sum(2.0 * (labels[i] == labels[j]) for i, j in links)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(e)
    # nodes are near in the text only once: 0 and 1
    assert field.marginals(found) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=2e-3)


def test_added_spans_do_not_depend_on_the_deal(spark):
    texts = [prose(i, 20) + f" Call +1 (877) 555-{1000 + i} now. " + prose(i + 50, 20) + f" again 877 555-{1000 + i} or 20{i} 1234 5{i}" for i in range(40)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    one = {r.doc_id: r.spans for r in pii.personal_data(docs.coalesce(1)).collect()}
    assert one == {r.doc_id: r.spans for r in pii.personal_data(docs.repartition(7)).collect()}


def test_one_mark_reaches_all_bare_repeats(spark):
    texts = [prose(i, 40) + f" Call +1 (877) 555-{1000 + i} now. " + prose(i + 500, 30) for i in range(60)]
    texts += [prose(i, 30) + f" order 20{i:02d} 1234 {i:02d}77 done" for i in range(60)]
    repeats = [0, 1, 2, 6, 40]
    for after in (True, False):
        for k in repeats:
            bare = "".join(f" {prose(k * 100 + j, 12)} again 877 555-9876 here. " for j in range(k))
            mark = " Call +1 (877) 555-9876 now. " + prose(k, 15)
            texts.append(mark + bare if after else bare + mark)
    got = {r.doc_id: r.spans for r in pii.personal_data(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[120 + i].count("phone:") for i in range(10)] == [1 + k for k in repeats] * 2
    assert all(got[60 + i] == "" for i in range(60))


# --- 6 WARC ----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long_page = "<p>" + prose(5, 40_000) + "é😀" * 500
    tricky = "a" * 2000 + warc.SEPARATOR + "b\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "c" * 3000 + "\r\n\r\n"
    html = {1: long_page, 2: None, 3: "", 4: "short", 5: "short", 6: tricky, 7: tricky, 8: long_page, 9: "z" * 999, 10: "z" * 999, 11: "é" * 500, 12: "é" * 500, 13: "﻿\x00\r\n"}
    data = [(i, None if i == 2 else f"http://x/{i}\r\ny", h) for i, h in html.items()] + [(8, "http://x/8", long_page), (None, None, "no id" * 300)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    got = warc.archived(with_clashes(pages), path, chunk_chars=1000)
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        last = max((j for j, _, g in data if j is not None and (g or "") == (h or "")), default=None)
        again = len(b) >= 1000 and i is not None and i < last
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    assert rows(got.drop("intact")) == sorted(want, key=repr)
    assert got.filter("not intact").count() == 0
    # the archives themselves: every record where its length says, chunks within bounds
    import gzip
    from pathlib import Path

    seen = 0
    for f in Path(path).glob("part-*.gz"):
        data_bytes = gzip.open(f).read()
        while data_bytes:
            head, _, rest = data_bytes.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n" and n <= 4 * 1000 + 100
            data_bytes = rest[n + 4 :]
            seen += 1
    assert seen > len(data)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).count() == 0


# --- 7 GIF -----------------------------------------------------------------------------------


def test_lzw_of_a_published_example():
    stream = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    samples = gif.lzw_decode(stream, 2, 100)
    assert len(samples) == 100 and samples[:10] == bytes([1] * 5 + [2] * 5)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 576, 5000, 40_000])
def test_lzw_round_trip(n):
    r = np.random.default_rng(n)
    for data in (bytes(n), r.integers(0, 256, n, dtype=np.uint8).tobytes(), (b"abcab " * n)[:n], r.integers(0, 4, n, dtype=np.uint8).tobytes()):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, n) == data
        small = bytes(b & 3 for b in data)
        assert gif.lzw_decode(gif.lzw_encode(small, 2), 2, n) == small


def small_gif(images, interlace=False):
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    out = [b"GIF89a", (4).to_bytes(2, "little"), (2).to_bytes(2, "little"), b"\x81\0\0", palette]
    for left, top, width, height, samples, disposal, transparent, delay in images:
        flags = disposal << 2 | (transparent is not None)
        out += [b"\x21\xf9\x04", bytes([flags]), delay.to_bytes(2, "little"), bytes([transparent or 0]), b"\0"]
        out += [b"\x2c", *[x.to_bytes(2, "little") for x in (left, top, width, height)], b"\x40" if interlace else b"\0", b"\x02", gif._blocks(gif.lzw_encode(samples, 2))]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_timing():
    data = small_gif([
        (0, 0, 4, 2, bytes([0] * 8), 1, None, 10),
        (1, 0, 2, 1, bytes([1, 3]), 2, 3, 20),
        (0, 1, 1, 1, bytes([2]), 3, None, 5),
        (3, 1, 1, 1, bytes([1]), 1, None, 7),
    ])
    found = list(gif.frames(data))
    assert [f[:2] for f in found] == [(0, 10), (10, 20), (30, 5), (35, 7)]
    assert found[1][2][0, 1].tolist() == [0, 255, 0, 255] and found[1][2][0, 2].tolist() == [255, 0, 0, 255]
    assert found[2][2][0, 1].tolist() == [0, 0, 0, 0]  # restored to nothing
    assert found[2][2][1, 0].tolist() == [0, 0, 255, 255]
    assert found[3][2][1, 0].tolist() == [255, 0, 0, 255]  # restored to what was before
    assert gif.colour_histogram(found[0][2]).sum() == 8
    lines = bytes(i % 4 for i in range(8) for _ in range(1))
    laced = small_gif([(0, 0, 1, 8, lines, 0, None, 0)], interlace=True)
    rows_ = next(gif.decode(laced)[2]).indices[:, 0].tolist()
    assert rows_ == [lines[i] for i in (0, 4, 2, 5, 1, 6, 3, 7)]


def test_media_columns(spark):
    docs = documents(spark)
    got = gif.media_digests(with_clashes(docs)).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    media = gif.payload_media(docs)
    frames = gif.timed_frames(media)
    assert frames.filter("error is not null").count() == 0
    assert frames.filter("id = 9").count() == -(-len(texts[9].encode()) // (576 * 64))
    broken = spark.createDataFrame([(1, None), (2, b"GIF89a"), (3, b"no")], "id long, media binary")
    assert gif.timed_frames(broken).filter("error is not null").count() == 3
    assert gif.media_digests(documents(spark, [])).count() == 0


# --- 8 URLs ----------------------------------------------------------------------------------


def test_urls(spark):
    given = [
        "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/es/", "http://example.org", "ftp://b.org/q#r", "http://x.com/fr/", "http://com/de/", "http://x.com/it/",
        "nothing", None, "", "://", "http://?a/", "http://notexample.org/es/", "http://org./x", "http://a..com/fr/x", "http://é.com/de/" + "z" * 100_000, "http://bad.net/spam/1",
    ]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(given)] + [(0, given[0], "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(with_clashes(pages), blocked=["bad.net/spam/"]).collect()}
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower() if host.isascii() else host
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if not host or host + path == "bad.net/spam/1" else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert urls.judge(pages.limit(0)).count() == 0


def test_digest_table_confirms_strings(monkeypatch):
    monkeypatch.setattr(urls, "_key", lambda e: 7)  # every entry collides
    (block,) = urls.DigestTable.built([("a/x", 1), ("b/y", 0), ("c", 1)], most_bytes=10)
    table = urls.DigestTable.mapped(block)
    assert [table.text(i) if i >= 0 else None for i in table.probe(["b/y", "c", "d", "a/x"])] == ["b/y", "c", None, "a/x"]


def test_long_blocklists_are_cut_by_key(spark):
    given = [f"http://h{n}.bad.net/x{n}/y" for n in range(300)] + ["http://com/de/1", "http://org/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    listed = [f"h{n}.bad.net/x{n}" for n in range(0, 300, 3)] + ["org/"]
    assert len(urls.DigestTable.built([(e, 2) for e in listed], 300)) > 10
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, blocked=listed, most_bytes=300).collect()}
    assert got == {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, blocked=listed).collect()}
    assert [got[n] for n in range(300)] == [(None, "allow" if n % 3 else "block") for n in range(300)]
    assert got[300] == ("com/de/", "block") and got[301] == ("org/", "allow")


# --- 9 spans ---------------------------------------------------------------------------------


def test_spans_remove_repeats_only(spark):
    passage = prose(77, 70)
    data = [(i, prose(1000 + i, 60) + " " + (passage + " " if i % 3 == 0 else "") + prose(2000 + i, 50), None, None, None) for i in range(30)]
    data += [(500, None, None, None, None), (501, "", None, None, None), (502, "Short. One.", None, None, None), (503, "Short. One.", None, None, None), (None, passage, None, None, None)]
    data += [(504, prose(5, 90), None, None, None)] * 2
    got = spans.without_repeats(with_clashes(documents(spark, data))).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    middle = " ".join(passage.split()[14:56])
    for i, text, *_ in data:
        if i is None or i >= 500:
            assert by[i].text == text and by[i].removed == 0
        elif i % 3 or not i:
            assert by[i].text == text and by[i].spans == []
        else:
            assert middle in text and middle not in by[i].text
            assert by[i].first_ids and all(f % 3 == 0 and f < i for f in by[i].first_ids)
            assert by[i].text.startswith(" ".join(prose(1000 + i, 60).split()[:40]))
            gone = "".join(text[s.start : s.end] for s in by[i].spans)
            assert len(gone) + len(by[i].text) == len(text) and set(gone.split()) <= set(passage.split()) | set(prose(1000 + i, 60).split()[-12:]) | set(prose(2000 + i, 50).split()[:12])
    assert spans.without_repeats(documents(spark, [])).count() == 0


def plain_spans(data):
    """Removed sentences of each document, by comparing all runs with all earlier ones."""
    docs = sorted({(i, t) for i, t in data if i is not None and t is not None})
    seen, out = {}, {}
    order = sorted(docs, key=lambda d: (d[0], signed_xxhash64(d[1])))
    for i, t in order:
        units = spans.sentences(t)
        covered = set()
        for at in range(len(units)):
            n = 0
            while at + n < len(units) and (n < spans.SENTENCES or sum(len(u[2]) for u in units[at : at + n]) < spans.WORDS):
                n += 1
            run = units[at : at + n]
            if n < spans.SENTENCES or sum(len(u[2]) for u in run) < spans.WORDS:
                break
            if seen.setdefault(tuple(w for u in run for w in u[2]), (i, t, at)) != (i, t, at):
                covered |= set(range(at, at + n))
        out[i, t] = len(covered)
    return out


def signed_xxhash64(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_spans_against_all_runs(spark):
    import random

    r = random.Random(6)
    shared = [prose(9000 + k, 30 + 11 * k) for k in range(6)]
    data = []
    for i in range(80):
        parts = [prose(100 + i, r.randint(5, 60))] + [r.choice(shared) for _ in range(r.randint(0, 2))] + [prose(400 + i, r.randint(5, 60))]
        data.append((i, r.choice([" ", "\n"]).join(parts)))
    data += [(5, shared[3] + " " + prose(1, 40)), (5, "One sentence."), (60, data[60][1]), (90, "\x1c a\u00a0b c. " * 12), (None, shared[0]), (91, None)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in data])
    got = sorted((x.doc_id, x.removed) for x in spans.without_repeats(with_clashes(docs).repartition(5)).collect() if x.doc_id is not None and x.doc_id != 91)
    want = plain_spans(data)
    assert got == sorted((i, want[i, t]) for i, t in data if i is not None and t is not None)
    assert sum(n > 0 for _, n in got) > 20


@pytest.mark.parametrize("n", [51, 55, 60])
def test_short_passages_in_the_middle_of_sentences(n):
    """A passage of just over 50 words without end marks is found wherever it stands."""
    import random

    r = random.Random(n)
    word = lambda: "".join(r.choice("aeiourstn") for _ in range(r.randint(2, 8)))
    missed, covered = 0, 0
    for _ in range(200):
        passage = " ".join(word() for _ in range(n))
        found = []
        for _ in range(2):
            text = " ".join([*(word() for _ in range(r.randint(3, 30))), passage, *(word() for _ in range(r.randint(3, 30)))])
            units = spans.sentences(text)
            found.append({h: [w for u in units[at : at + k] for w in u[2]] for at, k, h in spans.runs(units)})
        both = [found[0][h] for h in found[0].keys() & found[1].keys()]
        missed += not both
        covered += max((len(set().union(*map(set, both))), 0))
    assert missed <= 2 and covered / 200 > 0.75 * n


def test_runs_against_all_windows():
    units = spans.sentences(prose(3, 300) + "\n" + prose(4, 30).replace(".", ""))
    text = prose(3, 300) + "\n" + prose(4, 30).replace(".", "")
    assert [w for u in units for w in u[2]] == text.lower().split()
    for at, n, _ in spans.runs(units):
        sizes = [len(u[2]) for u in units[at : at + n]]
        assert n >= spans.SENTENCES and sum(sizes) >= spans.WORDS
        assert n == spans.SENTENCES or sum(sizes[:-1]) < spans.WORDS
