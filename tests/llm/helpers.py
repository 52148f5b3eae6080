"""Small tables with the cases that every operator must stand: nulls, empty and very long
texts, ties, repeated rows, an empty table, and columns whose names operators use inside."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators give their own columns.
CLASH = ("id", "t", "b", "v", "run", "row", "digest", "sha", "keep", "n", "fp", "node", "key", "size", "bucket", "cut", "level", "target", "_id", "_salt", "found", "media", "value", "copy", "chunks", "component")
WORDS = "the of and wolf river stone winter harbour quiet engine paper garden signal copper window market lantern bridge valley".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(6, 12)
        out += [r.choice(WORDS) + (str(r.randint(0, 9)) if r.random() < 0.05 else "") for _ in range(k)]
        out[-1] += "."
    return " ".join(out[:n])


def documents(spark, rows=None):
    if rows is None:
        long_text = prose(7, 30_000)
        rows = [
            (3, prose(1, 80), "en", "a", 1), (1, prose(1, 80).replace(" ", "  \n", 3), "en", "b", 1), (2, prose(2, 60), "en", None, None),
            (5, None, None, "a", None), (6, "", "en", "", 0), (7, " \t\n", "fr", "b", 3), (8, "", None, "a", 0),
            (9, long_text, "en", "c", len(long_text)), (10, prose(3, 40), "fr", "a", 1), (10, prose(3, 40), "fr", "a", 1),
            (11, "x", "en", "a", 1), (12, "Ünïcödé ß Straße 😀 中文 \x00 end", "de", "b", 1), (13, "one two", "en", "a", 7), (None, "no id here", "en", "a", 3),
        ]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows(df, *columns):
    columns = columns or df.columns
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
