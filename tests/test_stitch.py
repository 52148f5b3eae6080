"""Torn paragraphs against a plain version of the rules."""

from __future__ import annotations

import random
import re

from tomeloom.operators import stitch

SCHEMA = (
    "book_key long, page long, idx int, x double, w double, fh double, kind string, text string, lines array<struct<top:double,left:double,right:double>>, line_h double, ref_page boolean, in_figure boolean"
)


def plain_model(ps, h):
    prose = [p for p in ps if p["kind"] == "prose" and p["fh"] > 0]
    weight = {}
    for p in prose:
        weight[round(p["fh"], 2)] = weight.get(round(p["fh"], 2), 0) + len(p["text"])
    if not weight:
        return None
    dom = max(weight, key=lambda k: (weight[k], k))
    body = [p for p in prose if abs(p["fh"] - dom) <= 0.02 * dom]
    if not body:
        return None
    chars, groups = sum(len(p["text"]) for p in body), []
    for p in sorted(body, key=lambda p: (p["x"], p["x"] + p["w"])):
        r, many, n = p["x"] + p["w"], len(p["lines"]) >= 2, len(p["text"])
        if groups and p["x"] <= groups[-1][0]:
            groups[-1] = [max(groups[-1][0], r), groups[-1][1] or many, groups[-1][2] + n]
        else:
            groups.append([r, many, n])
    if sum(many and n >= 0.15 * chars for _, many, n in groups) >= 2:
        return None
    wide, left = max(p["x"] + p["w"] for p in body), min(p["x"] for p in body)
    multi = [p for p in body if len(p["lines"]) >= 2]
    right = wide
    if multi:
        right = max(multi, key=lambda p: (sum(len(o["lines"]) - 1 for o in multi if abs(o["lines"][0][2] - p["lines"][0][2]) <= 0.3 * h), p["lines"][0][2]))["lines"][0][2]
    held = [p for p in body if p["x"] + p["w"] <= right + 0.3 * h and right - p["lines"][-1][1] >= 0.35 * (right - left)]
    if not held:
        held = [p for p in body if wide - p["lines"][-1][1] >= 0.35 * (wide - left)]
        right = wide if held else right
        held = held or body
    bars = [p["idx"] for p in ps if not p["in_figure"] and (p["kind"] == "prose" and p["fh"] >= 1.12 * dom and len(p["lines"]) <= 3 or p["kind"] == "other" and p["w"] > 0.15 * right and p["fh"] >= 0.9 * dom)]
    return right, held[-1], held[0], bars


def plain_stitch(a, b, h):
    if a is None or b is None:
        return None
    (ra, tail, _, ba), (rb, _, head, bb) = a, b
    if any(i > tail["idx"] for i in ba) or any(i < head["idx"] for i in bb):
        return None
    last, first = tail["lines"][-1], head["lines"][0]
    measure = tail["x"] + tail["w"] if len(tail["lines"]) >= 2 else ra
    if measure - last[2] > 0.3 * h or abs(ra - last[1] - (rb - first[1])) > 0.35 * h:
        return None
    said, more = tail["text"].rstrip(), head["text"].lstrip()
    if re.search(r"[.!?…][\"'”’)\]]?$", said) and not re.search(r"(?:etc|e\.g|i\.e|cf|vs|resp)\.\)$", said, re.I):
        return None
    if abs(tail["fh"] - head["fh"]) > 0.02 * max(tail["fh"], head["fh"]) or re.match(r"\s*(?:[•●▪‣∗*–—]|\(?\d{1,2}[.)]\s|[a-z]\)\s)", head["text"]):
        return None
    if not re.match("[a-zà-öø-ÿа-яё]", more) and not re.match("[Ͱ-Ͽ℀-⅏←-⋿]", more) and len(more.split()) < 4:
        return None
    return tail["idx"], head["idx"]


def test_stitch_against_plain(spark):
    r, pages, rows, h = random.Random(7), {}, [], 10.0
    texts = ["it goes on", "It ends here.", "a half (etc.)", "• item one", "Two tokens", "Four tokens are there", "αβ of it", "1) first of all", "and so on to the"]
    for book in range(60):
        for page in range(0, 12, r.choice([1, 1, 2, 4])):
            ps = []
            two = r.random() < 0.1
            for idx in range(r.randint(1, 5)):
                x = 50.0 if not two or idx % 2 else 320.0
                w = r.choice([250.0, 250.0, 250.0, 120.0])
                n = r.randint(1, 3)
                lines = [(idx * 40.0 + 12 * k, x, x + w - (r.choice([0.0, 0.0, 2.0, 80.0]) if k == n - 1 else 0.0)) for k in range(n)]
                ps.append({"idx": idx, "x": x, "w": w, "fh": r.choice([10.0] * 8 + [10.1, 14.0]), "kind": r.choice(["prose"] * 8 + ["other"]), "text": r.choice(texts), "lines": lines, "in_figure": r.random() < 0.1})
            pages[book, page] = (ps, r.random() < 0.05)
            rows += [(book, page, p["idx"], p["x"], p["w"], p["fh"], p["kind"], p["text"], p["lines"], h, pages[book, page][1], p["in_figure"]) for p in ps]
    want = set()
    for book in range(60):
        # pages whose text has a main size are pages with text
        own = sorted(p for b, p in pages if b == book and any(q["kind"] == "prose" for q in pages[b, p][0]))
        for a, b in zip(own, own[1:]):
            (pa, ref_a), (pb, ref_b) = pages[book, a], pages[book, b]
            if b - a <= 3 and not ref_a and not ref_b and (pair := plain_stitch(plain_model(pa, h), plain_model(pb, h), h)):
                want.add((book, a, pair[0], b, pair[1]))
    got = {tuple(x) for x in stitch.stitch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(want) > 10
